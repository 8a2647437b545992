"""Operator 13: SentencePiece encoding by a table of prefixes, and decoding."""

from __future__ import annotations

import codecs
import re
from array import array
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brinewell.llm.common import without

#: The mark of a space in pieces; kinds of pieces in a model file.
MARK, NORMAL, UNKNOWN, CONTROL, BYTE = "▁", 1, 2, 3, 6
#: Segments whose ids a worker remembers, their longest, and pairs whose test it remembers: 120 MB at most together.
REMEMBERED, LONGEST, PAIRS = 300_000, 32, 400_000
#: Characters of a text that are cut into segments at once.
STRETCH = 1 << 20
_loaded: dict[str, Model] = {}


def _replaced(e: UnicodeError) -> tuple[str, int]:
    return "�" * (e.end - e.start), e.end


codecs.register_error("brinewell-each-byte", _replaced)


class Model:
    """A merge-type (BPE) model with byte fallback.

    Encoding merges, of all neighbours whose join is a piece, those with the
    best score first and the leftmost among equals. So every prefix of a text
    has one encoding, with one last token, and two tokens may stand side by
    side in an encoding exactly if the two alone encode to themselves: the
    first merge across their border would be the same one in any text. The
    table of last tokens follows from left to right, and the ids from right to
    left, without a queue of merges, in one pass over the automaton's matches.
    """

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm = proto.normalizer_spec
        kinds = {p.type for p in proto.pieces}
        if proto.trainer_spec.model_type != 2 or not kinds <= {NORMAL, UNKNOWN, CONTROL, BYTE} or BYTE not in kinds or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError(f"{path} is no merge-type model with byte fallback and without pieces of the user's own")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError(f"{path} changes characters of a text, which this encoder leaves as they are")
        self.prefix = MARK if norm.add_dummy_prefix else ""
        self.pieces = [p.piece for p in proto.pieces]
        self.size, self.lengths = len(self.pieces), [len(p) for p in self.pieces]
        self.score = {p.piece: p.score for p in proto.pieces if p.type == NORMAL}
        self.bytes = [0] * 256
        self.plain: list[bytes] = []  # what a token adds to the text
        for i, p in enumerate(proto.pieces):
            if p.type == BYTE:
                self.bytes[int(p.piece[1:-1], 16)] = i
                self.plain.append(bytes([int(p.piece[1:-1], 16)]))
            else:
                self.plain.append({CONTROL: b"", UNKNOWN: proto.trainer_spec.unk_surface.encode()}.get(p.type, p.piece.replace(MARK, " ").encode()))
        ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == CONTROL}
        self.control = np.array([p.type == CONTROL for p in proto.pieces])
        self.begin, self.end = ids[proto.trainer_spec.bos_piece], ids[proto.trainer_spec.eos_piece]
        self.apart = _borders(self.score)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, p in enumerate(proto.pieces):
            if p.type == NORMAL and self.merged(p.piece) == [p.piece]:  # others never come out of an encoding
                self.automaton.add_word(p.piece, i)
        self.automaton.make_automaton()
        self.joined: dict[int, bool] = {}
        self.packed = [np.array([i], "<u4").tobytes() for i in range(self.size)]
        self.known: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """The encoding by its definition, for the few characters of one piece or two."""
        s = list(text)
        while True:
            best = max(((self.score[a + b], -i) for i, (a, b) in enumerate(pairwise(s)) if a + b in self.score), default=None)
            if best is None:
                return s
            i = -best[1]
            s[i : i + 2] = [s[i] + s[i + 1]]

    def token(self, i: int) -> str:
        """A token's characters; tokens from `size` on are characters that are no piece."""
        return self.pieces[i] if i < self.size else chr(i - self.size)

    def compatible(self, left: int, right: int) -> bool:
        """Whether right may follow left in an encoding."""
        a, b = self.token(left), self.token(right)
        if len(self.joined) >= PAIRS:
            self.joined.clear()
        known = self.joined[left << 21 | right] = self.merged(a + b) == [a, b]
        return known

    def segment(self, text: str) -> bytes:
        """The packed ids of a segment: last tokens of its prefixes, then backwards from the end."""
        last = [-1] * len(text) if len(text) < STRETCH else array("i", [-1]) * len(text)
        length, size, joined, done = self.lengths, self.size, self.joined, -1
        for end, t in self.automaton.iter(text):
            if end == done:
                continue
            before = end - length[t]
            if before >= 0:
                left = last[before]
                left = left if left >= 0 else size + ord(text[before])
                fits = joined.get(left << 21 | t)
                if not (self.compatible(left, t) if fits is None else fits):
                    continue
            last[end] = t
            done = end
        out, at, packed = [], len(text) - 1, self.packed
        while at >= 0:
            t = last[at]
            if t >= 0:
                out.append(packed[t])
                at -= length[t]
            else:  # a character that no piece ends with stands alone, as its bytes
                out.extend(packed[self.bytes[b]] for b in reversed(text[at].encode()))
                at -= 1
        out.reverse()
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids with begin and end, as little-endian unsigned 32-bit integers."""
        out = [self.packed[self.begin]]
        known = self.known
        for part in _stretches(self.prefix + text.replace(" ", MARK) if text else "", self.apart):
            segments = self.apart.findall(part) if self.apart else [part]
            ids = list(map(known.get, segments))
            if None in ids:
                for i, x in enumerate(ids):
                    if x is None:
                        s = segments[i]
                        ids[i] = known.get(s) or self.segment(s)
                        if len(s) <= LONGEST:
                            if len(known) >= REMEMBERED:
                                known.clear()
                            known[s] = ids[i]
            out += ids
        out.append(self.packed[self.end])
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of packed ids: control tokens add nothing, the first space mark is dropped where encoding adds one, a byte that makes no character is U+FFFD."""
        held = np.frombuffer(ids, "<u4")
        edges = [-1, *np.flatnonzero(self.control[held]).tolist(), len(held)]
        runs = [held[a + 1 : b].tolist() for a, b in pairwise(edges) if b > a + 1]  # bytes on both sides of a control token make no character together
        out = [b"".join(map(self.plain.__getitem__, r)) for r in runs]
        if runs and self.prefix and self.pieces[runs[0][0]].startswith(MARK):
            out[0] = out[0][1:]
        return "".join(x.decode("utf-8", "brinewell-each-byte") for x in out)


def _borders(score: dict[str, float]) -> re.Pattern | None:
    """What parts a text: a segment is marks and a run of characters that pieces hold side by side, so no piece passes its border; None if marks come late in pieces.

    Characters that are neighbours in some piece make one class, and so do
    theirs (letters of a script, punctuation); those that have none make one too.
    """
    if any(re.search(f"[^{MARK}]{MARK}", p) for p in score):
        return None
    group: dict[str, str] = {}

    def top(c: str) -> str:
        while group.setdefault(c, c) != c:
            group[c] = c = group[group[c]]
        return c

    for p in score:
        for a, b in pairwise(p.lstrip(MARK)):
            group[top(a)] = top(b)
    classes: dict[str, list[str]] = {}
    for c in list(group):
        classes.setdefault(top(c), []).append(c)
    sets = sorted((re.escape("".join(sorted(c))) for c in classes.values()), key=len, reverse=True)
    runs = "|".join([*[f"[{c}]+" for c in sets], f"[^{MARK}{''.join(sets)}]+"])
    return re.compile(f"{MARK}*(?:{runs})|{MARK}+")


def _stretches(text: str, apart: re.Pattern | None) -> Iterator[str]:
    """text in parts of about STRETCH characters that end before a mark; whole where nothing parts it."""
    start = 0
    while start < len(text):
        border = re.compile(f"[^{MARK}]{MARK}").search(text, start + STRETCH) if apart else None
        end = border.start() + 1 if border else len(text)
        yield text[start:end]
        start = end


def model(path: str) -> Model:
    """A worker's model, read and made once."""
    if path not in _loaded:
        _loaded[path] = Model(path)
    return _loaded[path]


def _mapped(df: DataFrame, column: str, added: dict[str, str], work) -> DataFrame:
    """df with columns made from one column's values, row by row, in Arrow batches; work gives a list of values for each added column."""
    k = df.columns.index(column)
    kinds = {"binary": pa.binary(), "string": pa.string()}
    schema = T.StructType(list(df.schema.fields))
    for c, kind in added.items():
        schema = schema.add(c, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [work(v.as_py()) for v in b.column(k)]
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array([m[i] for m in made], kinds[kind]) for i, kind in enumerate(added.values())]], names=schema.names)

    return df.mapInArrow(run, schema)


def encode_pieces(df: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """Adds ``ids`` (binary: little-endian unsigned 32-bit integers, begin and end included), as the sentencepiece library encodes, without sampling.

    model_path: a file at the same path on every node. A null text counts as
    empty and gives begin and end only; rows that repeat are encoded each; an
    empty table stays empty; an input column called ids is replaced. A text is
    encoded word by word where no piece passes the border of words, and a run
    without white space in one piece of 8 bytes a character, however long.
    """
    slim = without(df, *({"ids"} - {text.lower()})).withColumn("_text", F.coalesce(F.col(f"`{text}`"), F.lit("")))
    return _mapped(slim, "_text", {"ids": "binary"}, lambda t: (model(model_path).encode(t),)).drop("_text")


def decode_pieces(df: DataFrame, model_path: str, ids: str = "ids") -> DataFrame:
    """Adds ``decoded``, the text of packed ids, as the sentencepiece library decodes; null ids give null. An input column called decoded is replaced."""
    slim = without(df, *({"decoded"} - {ids.lower()}))
    return _mapped(slim, ids, {"decoded": "string"}, lambda x: (None if x is None else model(model_path).decode(x),))


def op13_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Every document's ids under piece_bpe_32k and what they decode to, as digests."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ids = encode_pieces(docs, path).drop("text")
    both = decode_pieces(ids, path)
    return both.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
