"""Operator 9: removal of repeated word windows, found with an FM-index per shard."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brinewell.llm.common import without
from brinewell.llm.fmindex import FMIndex
from brinewell.session import cut

#: Words of the n-grams that route windows, words in an index shard, segments searched at once, and most windows of a segment.
GRAM, SHARD_WORDS, AT_ONCE, LONGEST = 5, 400_000, 20_000, 64
#: A routing value with more segments than MOST goes by whole windows instead, on a corpus of any size. Such values are broadcast as a map of MAP_BITS bits (8 MB);
#: a value that shares a bit with one goes the same way, which changes the route of its windows, but not the result.
MOST, MAP_BITS = 2_000, 1 << 26
_U = np.uint64
_LAST = 2**63 - 1
_BASE, _INVERSE = _U(0x9E3779B97F4A7C15), _U(pow(0x9E3779B97F4A7C15, -1, 2**64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(29))


def words_of(text: str | None) -> list[bytes]:
    """The words between ASCII white space, unchanged otherwise."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), _U, len(words))


def _grams(h: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
    """A hash of every n words in a row."""
    m = len(h) - n + 1
    out = h[:m] * _U(2 * seed + 1)
    for k in range(1, n):
        out = _mix(out) + h[k : k + m]
    return _mix(out)


def _least(v: np.ndarray, span: int) -> np.ndarray:
    """The least of every `span` values in a row."""
    have = 1
    while 2 * have <= span:
        v, have = np.minimum(v[:-have], v[have:]), 2 * have
    return np.minimum(v[: len(v) - (span - have)], v[span - have :]) if span > have else v


def segments(h: np.ndarray, width: int, hot: np.ndarray, counting: bool = False) -> tuple[np.ndarray, ...]:
    """Runs of windows that share the least n-gram hash among their words: key, content hash, first window, windows, weight, hot.

    Equal windows have equal keys, wherever they stand. weight is 2 where the
    run may hold a window twice. Runs with a key in `hot` fall apart into
    windows that are keyed by their whole content; `hot` is a bit map of keys (see
    ``_hot``), or empty. For counting, without hot keys, the content hashes are 0; otherwise, the weights are.
    """
    n = len(h) - width + 1
    if n < 1:
        z = np.empty(0, np.int64)
        return z.view(_U), z.view(_U), z, z, z, z.astype(bool)
    span = width - GRAM + 1
    g = _grams(h, GRAM)
    least = _least(g, span)
    start = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    if (long := np.diff(np.concatenate([start, [n]])) > LONGEST).any():
        ends = np.concatenate([start[1:], [n]])
        start = np.concatenate([start, *[np.arange(a + LONGEST, b, LONGEST) for a, b in zip(start[long], ends[long], strict=True)]])
        start.sort()
    size = np.diff(np.concatenate([start, [n]]))
    key = least[start]
    content = np.zeros(len(start), _U)
    if not counting:  # a polynomial of window hashes, moved to the run's start
        windows = _mix(g[: n] ^ _mix(g[width - GRAM :][:n]))
        for k in range(GRAM, width - GRAM, GRAM):
            windows = _mix(windows) + g[k : k + n]
        up = np.multiply.accumulate(np.concatenate([[_U(1)], np.full(n - 1, _BASE, _U)]))
        down = np.multiply.accumulate(np.concatenate([[_U(1)], np.full(n - 1, _INVERSE, _U)]))
        sums = np.concatenate([[_U(0)], np.cumsum(windows * up, dtype=_U)])
        content = _mix((sums[start + size] - sums[start]) * down[start])
    weight = np.zeros(len(start), np.int64)
    if counting:  # the key stands twice among a run's n-grams: a window may repeat in it
        weight += np.where(size > span, 2, 1)
        s = np.sort(g)
        r = np.flatnonzero(s[np.minimum(np.searchsorted(s, key) + 1, len(s) - 1)] == key)  # beside these, no key stands twice in the text
        reach = np.minimum(size[r] + span - 1, 2 * span)
        at = start[r][:, None] + np.arange(2 * span)[None, :]
        same = (g[np.minimum(at, len(g) - 1)] == key[r][:, None]) & (np.arange(2 * span)[None, :] < reach[:, None])
        weight[r[same.sum(1) > 1]] = 2
    whole = np.zeros(len(key), bool)
    if len(hot):
        slot = key & _U(64 * len(hot) - 1)
        is_hot = (hot[slot >> _U(6)] >> (slot & _U(63)) & _U(1)).astype(bool)
        if is_hot.any():
            one = np.repeat(is_hot, size)
            w = np.flatnonzero(one)
            second = _grams(h, width, 7)[w]
            k = ~is_hot
            key = np.concatenate([key[k], _mix(windows[w] + _U(99))])
            content = np.concatenate([content[k], second])
            start, size = np.concatenate([start[k], w]), np.concatenate([size[k], np.ones(len(w), np.int64)])
            weight = np.concatenate([weight[k], np.zeros(len(w), np.int64)])
            whole = np.concatenate([whole[k], np.ones(len(w), bool)])
    return key, content, start, size, weight, whole


def _order(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(_LAST))


def _counts(docs: DataFrame, width: int, hot) -> DataFrame:
    """key and weight of the segments, summed within a slice of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 500):
                keys, weights = [], []
                for t in b.column(2).slice(k, 500).to_pylist():
                    s = segments(word_hashes(words_of(t)), width, hot.value, True)
                    keys.append(s[0])
                    weights.append(s[4])
                u, at = np.unique(np.concatenate(keys), return_inverse=True)
                w = np.bincount(at, np.concatenate(weights), len(u)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(w)], names=["key", "w"])

    return docs.mapInArrow(run, "key long, w long").groupBy("key").agg(F.sum("w").alias("w"))


def _hot(counts: DataFrame, most: int, bits: int) -> np.ndarray:
    """The keys of more than `most` segments, as a bit map by their last bits: 64-bit words, at most bits / 64 of them, or none."""
    slot = F.col("key").bitwiseAND(F.lit(bits - 1).cast("long"))
    places = counts.where(F.col("w") > most).select(F.shiftright(slot, 6).alias("word"), F.expr(f"shiftleft(1L, cast(key & {min(bits, 64) - 1}L AS int))").alias("bit"))
    rows = places.groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    if not rows.num_rows:
        return np.empty(0, _U)
    out = np.zeros(bits // 64, _U)
    out[rows["word"].to_numpy()] = rows["bit"].to_numpy().view(_U)
    return out


def _occurrences(docs: DataFrame, width: int, hot) -> DataFrame:
    """Every segment: key, content, size, doc (order), version, start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                found = [segments(word_hashes(words_of(t)), width, hot.value) for t in part.column(2).to_pylist()]
                row = np.repeat(np.arange(part.num_rows), [len(f[0]) for f in found])
                key, content, start, size = (np.concatenate([f[i] for f in found]) for i in range(4))
                hot_row = np.concatenate([f[5] for f in found])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(content.view(np.int64)), pa.array(size.astype(np.int32)), part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), pa.array(start.astype(np.int32)), pa.array(hot_row)],
                    names=["key", "content", "size", "doc", "version", "start", "hot"],
                )

    return docs.mapInArrow(run, "key long, content long, size int, doc long, version int, start int, hot boolean")


def _texts(docs: DataFrame, classes: DataFrame, width: int, shards: int) -> DataFrame:
    """The words of every class, taken from its first occurrence, with its index shard; docs: doc, version, t and what else the result keeps.

    All columns of docs go through the join, so that it shares the exchange of
    the one that brings the spans to the texts: texts move once.
    """
    wanted = classes.groupBy(F.col("at.doc").alias("doc"), F.col("at.version").alias("version")).agg(F.collect_list(F.struct("key", "content", "size", F.col("at.start").alias("start"), "n")).alias("_s"))
    rows = docs.join(wanted, ["doc", "version"])
    # a document that stands in the table twice gives its classes' words once; its rows are together after the join
    rows = rows.dropDuplicates(["doc", "version"])
    doc, t, classed = (rows.columns.index(c) for c in ("doc", "t", "_s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                w = words_of(b.column(t)[k].as_py())
                s = b.column(classed)[k].values
                start, size = s.field("start").to_numpy(), s.field("size").to_numpy()
                parts = [b" ".join(w[i : i + m + width - 1]) for i, m in zip(start.tolist(), size.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([s.field("key"), s.field("content"), s.field("size"), pa.array(np.full(len(s), b.column(doc)[k].as_py(), np.int64)), s.field("start"), s.field("n"), pa.array(parts, pa.binary())], names=["key", "content", "size", "doc", "start", "n", "words"])

    out = rows.mapInArrow(run, "key long, content long, size int, doc long, start int, n long, words binary")
    return out.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))


def _first_starts(texts: DataFrame, width: int) -> DataFrame:
    """For every class, ranges lo..hi of its windows and where each window's sequence first starts: document `first`, word shift + window.

    One FM-index per shard holds the shard's segments; all their windows are
    searched backward in it at once. The matching statistics, followed up to the
    threshold `width`, give each window's range of suffixes, and the least
    (document, start) in that range is its first start.
    """

    def run(table: pa.Table) -> pa.Table:
        size = table["size"].to_numpy().astype(np.int64)
        doc, start = table["doc"].to_numpy(), table["start"].to_numpy().astype(np.int64)
        length = size + width  # with the separator
        flat = np.zeros(length.sum(), _U)
        begin = np.concatenate([[0], np.cumsum(length)[:-1]])
        owner = np.repeat(np.arange(len(size)), length)
        within = np.arange(len(flat)) - begin[owner]
        end = within == length[owner] - 1
        flat[~end] = word_hashes([w for part in table["words"].to_pylist() for w in part.split()])
        symbols = np.unique(flat[~end], return_inverse=True)
        text = np.zeros(len(flat), np.int64)
        text[~end] = symbols[1] + 1
        index = FMIndex(text, width)
        place_doc, place_start = doc[owner], start[owner] + within
        ranks = np.empty(len(flat), np.int64)
        order = np.lexsort((place_start, place_doc))
        ranks[order] = np.arange(len(flat))
        windows = np.flatnonzero(within < size[owner])
        lows = [index.windows(text, begin[k : k + AT_ONCE], size[k : k + AT_ONCE], width) for k in range(0, len(size), AT_ONCE)]
        lo, at = np.unique(np.concatenate(lows), return_inverse=True)
        # a range ends where the next one starts, or sooner at suffixes that begin no window: those have no place
        by_suffix = np.where((within < size[owner])[index.suffix], ranks[index.suffix], np.iinfo(np.int64).max)
        best = np.minimum.reduceat(by_suffix, lo)[at]
        first = order[best]
        first_doc, shift = place_doc[first], place_start[first] - within[windows]
        o = owner[windows]
        new = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (first_doc[1:] != first_doc[:-1]) | (shift[1:] != shift[:-1])]))
        hi = np.concatenate([new[1:], [len(windows)]]) - 1
        c = o[new]
        out = [table["key"].take(pa.array(c)), table["content"].take(pa.array(c)), table["size"].take(pa.array(c)), pa.array(within[windows[new]].astype(np.int32)), pa.array(within[windows[hi]].astype(np.int32)), pa.array(first_doc[new]), pa.array(shift[new])]
        own = (first_doc[new] == doc[c]) & (shift[new] == start[c]) & (table["n"].to_numpy()[c] == 1)
        return pa.table(out, names=["key", "content", "size", "lo", "hi", "first", "shift"]).filter(pa.array(~own))

    return texts.groupBy("shard").applyInArrow(run, "key long, content long, size int, lo int, hi int, first long, shift long")


def repeated_windows(docs: DataFrame, width: int = 20) -> DataFrame:
    """(doc, version, spans): the word ranges of each document covered by windows that start earlier elsewhere; docs: doc, version, t and others.

    Windows are routed by the least hash of their n-grams; a routing value with
    one segment in the whole corpus can't hold a repeated window and goes.
    Segments with the same words are one class in the index, with their first
    place; an occurrence's window is repeated unless it is the first start that
    the index found for it. No index shard holds more than MOST segments of one
    routing value.
    """
    sc = docs.sparkSession.sparkContext
    none = sc.broadcast(np.empty(0, _U))
    slim = docs.select("doc", "version", "t")
    counts = cut(_counts(slim, width, none).where("w > 1"), "substrings-keys")
    hot = sc.broadcast(_hot(counts, MOST, MAP_BITS))
    known = counts.select("key", F.lit(True).alias("twice"))
    found = cut(_occurrences(slim, width, hot).join(known, "key", "left").where("hot OR twice").drop("hot", "twice"), "substrings-segments")
    classes = cut(found.groupBy("key", "content", "size").agg(F.min(F.struct("doc", "start", "version")).alias("at"), F.count(F.lit(1)).alias("n")), "substrings-classes")
    words = classes.agg(F.sum(F.col("size") + width)).first()[0] or 0
    texts = _texts(docs, classes, width, max(1, -(-int(words) // SHARD_WORDS)))
    firsts = _first_starts(texts, width)
    hit = found.join(firsts, ["key", "content", "size"]).where("NOT (first = doc AND shift = start)")
    span = F.struct((F.col("start") + F.col("lo")).alias("s"), (F.col("start") + F.col("hi") + width).alias("e"))
    return hit.groupBy("doc", "version").agg(F.array_sort(F.collect_set(span)).alias("spans"))


def remove_repeats(docs: DataFrame, width: int = 20, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Adds n_words, n_removed, removed (word ranges, end exclusive) and kept_text (the words left, joined by one blank) to every row.

    A word goes when a window of `width` words around it also starts earlier:
    in a document with a smaller id, or in the same document before. A null or
    empty text, or one shorter than a window, loses nothing. Null ids come after
    all others, and ids must be numbers (others raise); rows that share an id are the same document, so a window at the
    same start in them is not earlier. Texts of any length are cut into
    segments; an empty table stays empty; input columns called as an output are
    replaced.
    """
    df = without(docs, "n_words", "n_removed", "removed", "kept_text")
    t = F.col(f"`{text}`")
    others = [c for c in df.columns if c != text]
    moved = df.select(_order(F.col(f"`{doc_id}`")).alias("doc"), F.hash(t).alias("version"), t.alias("t"), *[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(others)])
    joined = moved.join(repeated_windows(moved, width), ["doc", "version"], "left").select(*[F.col("t" if c == text else f"_{others.index(c)}").alias(c) for c in df.columns], F.col("spans").alias("_spans"))
    names = df.columns
    k = names.index(text)
    span = T.StructType([T.StructField("s", T.LongType()), T.StructField("e", T.LongType())])
    schema = T.StructType([*df.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed", T.ArrayType(span)), T.StructField("kept_text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                n_words, n_removed, removed, kept = [], [], [], []
                for t, spans in zip(part.column(k).to_pylist(), part.column(len(names)).to_pylist(), strict=True):
                    w = (t or "").encode("utf-8", "surrogatepass").split()
                    ranges: list[dict[str, int]] = []
                    for p in spans or []:
                        if ranges and p["s"] <= ranges[-1]["e"]:
                            ranges[-1]["e"] = max(ranges[-1]["e"], p["e"])
                        else:
                            ranges.append(dict(p))
                    gone = sum(p["e"] - p["s"] for p in ranges)
                    n_words.append(len(w))
                    n_removed.append(gone)
                    removed.append(ranges)
                    for p in reversed(ranges):
                        del w[p["s"] : p["e"]]
                    kept.append(b" ".join(w).decode("utf-8", "surrogatepass"))
                cols = [part.column(i) for i in range(len(names))]
                cols += [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(removed, pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))), pa.array(kept, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return joined.mapInArrow(run, schema)


def op9_substrings(spark, sf_dir: str) -> DataFrame:
    """Every document's words, words removed by repeated 20-word windows, and a digest of the rest."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = remove_repeats(docs, 20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP9_ORACLE = r"""
WITH dw AS (SELECT doc_id, row_number() OVER () AS rid, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
win AS (SELECT rid, doc_id, i, array_to_string(ws[i:i + 19], ' ') AS w FROM (SELECT rid, doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM dw WHERE len(ws) >= 20)),
later AS (SELECT rid, i FROM (SELECT rid, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + 20)) AS i FROM later),
words AS (SELECT rid, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM dw),
kept AS (SELECT rid, string_agg(w, ' ' ORDER BY i) AS t, count(*) AS n FROM words ANTI JOIN gone USING (rid, i) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM dw LEFT JOIN kept USING (rid)
"""
