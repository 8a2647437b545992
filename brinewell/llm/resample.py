"""Operator 12: resampling towards a target's distribution, by importance weights over hashed n-grams."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinewell.llm.common import ordered, without
from brinewell.session import cut

#: Buckets of the hashed features, which is also the number of gains that the driver and every task hold; bytes of a chunk.
BUCKETS, CHUNK = 10_000, 1 << 18
#: Over lower-cased UTF-8: a byte above 0x7F is part of a word.
_WORD, _APART = re.compile(rb"[0-9a-z\x80-\xff]+"), re.compile(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]")
_ANY_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def stretches(text: bytes, size: int, n: int) -> Iterator[tuple[bytes, int]]:
    """Chunks of a text, each with the count of its own leading bytes: the features that begin there are the chunk's.

    A chunk ends at the first byte from `size` on that is in no word, and
    carries the n - 1 words that follow, so every run of up to n words is
    whole in the chunk that owns its beginning, and in no other as its own.
    """
    start = 0
    while start < len(text):
        gap = _APART.search(text, start + size)
        end = stop = gap.start() if gap else len(text)
        for _ in range(n - 1):
            after = _ANY_WORD.search(text, stop)
            stop = after.end() if after else stop
        yield text[start:stop], end - start
        start = end


def features(chunk: bytes, own: int, n: int, buckets: int) -> tuple[int, np.ndarray]:
    """The words that begin in the chunk's own bytes, and the buckets of their runs of 1 to n words, joined by one space."""
    low = chunk.lower()
    words = _WORD.findall(low)
    mine = len(words) if own >= len(low) else len(_WORD.findall(low[:own]))
    hashes = list(map(crc32, words[:mine]))
    every = hashes[:]
    for k in range(1, n):
        hashes = [crc32(b" " + words[i + k], h) for i, h in enumerate(hashes) if i + k < len(words)]
        every += hashes
    return mine, np.array(every, np.int64) % buckets


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.empty(0), pa.int32()))


def hashed_chunks(texts: DataFrame, n: int, buckets: int, size: int = CHUNK) -> DataFrame:
    """(_row, _keep, words, features) of every chunk of (_row, _keep, _text); a short text is one chunk, read where it lies.

    Texts above `size` bytes are cut into chunks, which are dealt out over the
    tasks before they are hashed: a few very long texts hold up no task.
    """

    def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                for k, (chunk, own) in enumerate(stretches(b.column(2)[i].as_py(), size, n)):
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), b.column(1).slice(i, 1), pa.array([chunk], pa.binary()), pa.array([k]), pa.array([own])], names=["_row", "_keep", "_text", "_part", "_own"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [features(t.as_py(), own, n, buckets) for t, own in zip(b.column(2), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([f[0] for f in found], pa.int64()), _lists([f[1] for f in found])], names=["_row", "_keep", "words", "features"])

    long = F.octet_length("_text") > size
    keep = texts.schema["_keep"].dataType.simpleString()
    whole = texts.where(~long).select("_row", "_keep", "_text", F.octet_length("_text").cast("long").alias("_own"))
    cuts = texts.where(long).mapInArrow(parted, f"_row long, _keep {keep}, _text binary, _part long, _own long").repartition("_row", "_part")
    return whole.unionByName(cuts.drop("_part")).mapInArrow(hashed, f"_row long, _keep {keep}, words long, features array<int>")


def bucket_counts(chunks: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket over all chunks: a row a bucket and task is shuffled, `buckets` rows reach the driver."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            total += np.bincount(b.column(0).flatten().to_numpy(zero_copy_only=False), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in chunks.select("features").mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's gain: the floor of a thousand times the logarithm of the target's share over the source's, both with one added."""
    s_all, t_all, b = float(source.sum()), float(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + b) / ((s + 1.0) * (t_all + b)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def _weighed(chunks: DataFrame, gains: np.ndarray) -> DataFrame:
    """(_row, _keep, words, n_features, weight) of every chunk."""
    keep = chunks.schema["_keep"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = b.column(3)
            ends = held.offsets.to_numpy()
            sums = np.concatenate([[0], np.cumsum(gains[held.values.to_numpy(zero_copy_only=False)])])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(np.diff(ends).astype(np.int64)), pa.array((sums[ends[1:]] - sums[ends[:-1]]).astype(np.int64))], names=["_row", "_keep", "words", "n_features", "weight"])

    return chunks.mapInArrow(run, f"_row long, _keep {keep}, words long, n_features long, weight long")


def _texts(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    held = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)]) if keep else F.struct(F.lit(0).alias("c0"))
    return df.select(F.monotonically_increasing_id().alias("_row"), held.alias("_keep"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("_text"))


def resample(docs: DataFrame, target: DataFrame, text: str = "text", id: str = "doc_id", n: int = 1, buckets: int = BUCKETS, least_words: int = 20, percent: int = 10, seed: int = 2024, size: int = CHUNK) -> DataFrame:  # noqa: A002
    """Every row of docs, its text aside, with n_words, n_features, weight, score and rank (all long; null rank: not drawn).

    Features are all runs of 1 to n words of the lower-cased text, hashed into
    buckets. A bucket's gain compares its share in target and docs, a row's
    weight is the sum of its features' gains, its score adds Gumbel noise that
    the id and the seed decide. Of the rows with least_words words, percent in
    100 (rounded down) of the highest scores are drawn and ranked, ties to the
    smaller id (null ids last, noise of their own).

    Null texts in docs or target count as empty; a row without words has weight
    0. Rows that repeat each get a row, with consecutive ranks in any order. An
    empty docs table gives no rows, an empty target equal shares. Texts are
    read whole and once: chunk by chunk into a written table of buckets (4
    bytes a word at most); counts and weights are summed over a row's chunks.
    Input columns called like an output are replaced.
    """
    df = without(docs, *({"n_words", "n_features", "weight", "score", "rank"} - {id.lower(), text.lower()}))
    keep = [c for c in df.columns if c != text]
    chunks = cut(hashed_chunks(_texts(df, text, keep), n, buckets, size), "resample-chunks")
    wanted = hashed_chunks(_texts(target, text, []), n, buckets, size)
    gains = gains_of(bucket_counts(chunks, buckets), bucket_counts(wanted, buckets))
    whole = _weighed(chunks, gains).groupBy("_row").agg(F.first("_keep").alias("_keep"), *[F.sum(c).alias(c) for c in ("words", "n_features", "weight")])
    rows = whole.select(*[F.col("_keep")[f"c{i}"].alias(c) for i, c in enumerate(keep)], F.col("words").alias("n_words"), "n_features", "weight")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id}`").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    rows = rows.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))))
    placed = ordered(cut(rows.withColumn("_fit", F.col("n_words") >= least_words), "resample-scores"), "_fit", F.col("score").desc(), F.col(f"`{id}`").asc_nulls_last())
    drawn = F.col("_fit") & (F.col("_at") < F.expr(f"_of * {percent} div 100"))
    return placed.withColumn("rank", F.when(drawn, F.col("_at") + 1)).drop("_fit", "_at", "_of")


def drawn_rows(docs: DataFrame, scored: DataFrame, id: str = "doc_id") -> DataFrame:  # noqa: A002
    """The rows of docs whose id was drawn, texts included; rows that share a drawn id all come."""
    return docs.join(scored.where("rank IS NOT NULL").select(id).distinct(), id, "left_semi")


def op12_resample(spark, sf_dir: str) -> DataFrame:
    """Every document's features, weight and score towards the benchmark's words, and its rank among the 10 % drawn."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text")
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 of each distinct word by its bits, from the hexadecimal digits of its bytes.
OP12_ORACLE = r"""
WITH d AS (
  SELECT doc_id, rid, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws
  FROM (SELECT *, row_number() OVER () AS rid FROM documents)),
b AS (SELECT list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM benchmark),
dw AS (SELECT rid, unnest(ws) AS w FROM d), bw AS (SELECT unnest(ws) AS w FROM b),
hx AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
code AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(x), 2), lambda i: list_prepend(-1 - (16 * (strpos('0123456789ABCDEF', x[i]) - 1) + strpos('0123456789ABCDEF', x[i + 1]) - 1), [0, 0, 0, 0, 0, 0, 0, 0])))),
    lambda c, v: CASE WHEN v < 0 THEN xor(c, -1 - v) ELSE xor(c // 2, 3988292384 * (c % 2)) END), 4294967295) % 10000 AS bucket FROM hx),
dc AS (SELECT bucket, count(*) AS s FROM dw JOIN code USING (w) GROUP BY bucket), bc AS (SELECT bucket, count(*) AS t FROM bw JOIN code USING (w) GROUP BY bucket),
al AS (SELECT (SELECT coalesce(sum(s), 0)::DOUBLE FROM dc) AS s_all, (SELECT coalesce(sum(t), 0)::DOUBLE FROM bc) AS t_all),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * (s_all + 10000) / ((s + 1.0::DOUBLE) * (t_all + 10000))))::BIGINT AS g FROM dc LEFT JOIN bc USING (bucket), al),
wt AS (SELECT rid, sum(g)::BIGINT AS weight FROM dw JOIN code USING (w) JOIN gain USING (bucket) GROUP BY rid),
hs AS (SELECT doc_id, rid, len(ws)::BIGINT AS n_features, coalesce(weight, 0) AS weight, list_reduce(list_prepend(0::BIGINT, list_transform(range(1, 9), lambda i: strpos('0123456789abcdef', sha256('2024:' || coalesce(doc_id::VARCHAR, ''))[i]) - 1)), lambda a, x: 16 * a + x) AS h FROM d LEFT JOIN wt USING (rid)),
sc AS (SELECT doc_id, rid, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM hs),
rk AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS k, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM sc)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND k <= n * 10 // 100 THEN k END AS rank FROM rk
"""
