"""Operator 6: token counts by a public tokenizer, in Arrow batches that return lengths only."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinewell.llm.common import without

#: Bytes that one round of a batch covers, and pieces whose lengths a worker remembers.
ROUND_BYTES, REMEMBERED = 1 << 21, 400_000
#: Blanks and what follows up to the next one; \x1c to \x1f are white space to this language's library, but not to the tokenizer's.
_PIECE = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+")
_loaded: dict[str, tuple[object, dict[str, int]]] = {}


def pieces(text: str) -> list[str]:
    """text cut wherever a character is followed by white space; joined, the pieces are the text.

    The pre-tokenizer never puts a character and the white space after it into
    one unit, so the pieces' counts add up to the text's, however long it is. A
    run without white space has no safe boundary and stays one piece.
    """
    return _PIECE.findall(text)


def _tokenizer(path: str) -> tuple[object, dict[str, int]]:
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_padding()
        t.no_truncation()
        _loaded[path] = t, {}
    return _loaded[path]


def _round(path: str, texts: list[list[str]]) -> list[int]:
    """Tokens of each text, given as its pieces."""
    t, known = _tokenizer(path)
    new = list(set().union(*texts).difference(known))
    if len(known) + len(new) > REMEMBERED:
        known.clear()
        new = list(set().union(*texts))
    known.update(zip(new, map(len, t.encode_batch_fast(new, add_special_tokens=False)), strict=True))
    return [sum(map(known.__getitem__, p)) for p in texts]


def _long(path: str, text: str) -> int:
    """Tokens of a text of more bytes than a round, in rounds of its pieces."""
    total, part, size = 0, [], 0
    for m in _PIECE.finditer(text):
        part.append(m[0])
        size += len(m[0].encode("utf-8", "surrogatepass"))
        if size >= ROUND_BYTES:
            total += _round(path, [part])[0]
            part, size = [], 0
    return total + (_round(path, [part])[0] if part else 0)


def _lengths(path: str, texts: pa.Array, sizes: np.ndarray) -> list[int]:
    """Tokens of each text, in rounds of about equal bytes; only a round's texts are made strings at once."""
    counts: list[int] = []
    first = held = 0

    def upto(end: int) -> None:
        nonlocal first, held
        if end > first:
            counts.extend(_round(path, [pieces(x) for x in texts.slice(first, end - first).to_pylist()]))
        first, held = end, 0

    for i, size in enumerate(sizes.tolist()):
        if size > ROUND_BYTES:
            upto(i)
            counts.append(_long(path, texts[i].as_py()))
            first = i + 1
            continue
        held += size
        if held >= ROUND_BYTES:
            upto(i + 1)
    upto(len(texts))
    return counts


def count_tokens(df: DataFrame, tokenizer_path: str, text: str = "text") -> DataFrame:
    """Adds ``n_bytes`` (UTF-8) and ``n_tokens``, both long, to every row.

    tokenizer_path: a tokenizers .json file at the same path on every node.
    Null texts count as empty (0, 0); other columns pass through untouched, but
    those called n_bytes or n_tokens are replaced; repeated rows are counted
    each; an empty table stays empty. Tasks are cut by bytes of the files (Spark's
    splits), and within a task rounds by bytes of the texts.
    """
    df = without(df, "n_bytes", "n_tokens")
    keep = [c for c in df.columns if c != text]
    slim = df.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    schema = slim.drop("_text").schema.add("n_bytes", "long").add("n_tokens", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index("_text"))
            size = pa.compute.cast(pa.compute.binary_length(texts), pa.int64())
            n = pa.array(_lengths(tokenizer_path, texts, size.to_numpy()), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(keep))] + [size, n], names=[*keep, "n_bytes", "n_tokens"])

    return slim.mapInArrow(run, schema)


def op6_tokens(spark, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document under byte_bpe_50k, and whether they pass 1,024 tokens."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).withColumn("over_limit", F.col("n_tokens") > 1024)
