"""Operator 2: benchmark decontamination with one Aho-Corasick automaton over normalised item windows."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brinewell.llm.common import without
from brinewell.session import cut

#: Most bytes of item text in one automaton, and so in one broadcast; larger sets take a pass over the texts for each part.
MAX_ITEM_BYTES = 4 << 20
#: Byte to byte: A-Z to a-z, other ASCII that is no word character to a space, the rest as it is.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")
_built: dict[str, object] = {}


def fold(text: str | None) -> bytes:
    """text with every non-word byte a space; offsets are those of the text's UTF-8 bytes."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD)


class Automaton:
    """Aho-Corasick over words: its symbols are the numbers of the items' words, 0 is any other word."""

    def __init__(self, items: list[tuple[str, str]], n: int):
        import ahocorasick

        self.number: dict[bytes, int] = {}
        holders: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            w = tuple(self.number.setdefault(x, len(self.number) + 1) for x in fold(text).split())
            for i in range(max(1, len(w) - n + 1)) if w else ():
                holders.setdefault(w[i : i + n], set()).add(item)
        self.trie = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for w, ids in holders.items():
            self.trie.add_word(w, (len(w), sorted(ids)))
        if holders:
            self.trie.make_automaton()
        self.empty = not holders

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Words of a text, its hit word ranges (end exclusive, in order of their ends) and the items found, in one pass."""
        w = fold(text).split()
        if self.empty or not w:
            return len(w), [], set()
        get, spans, items = self.number.get, [], set()
        for last, (size, ids) in self.trie.iter(tuple([get(x, 0) for x in w])):
            spans.append((last + 1 - size, last + 1))
            items.update(ids)
        return len(w), spans, items


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges in order, those that touch or overlap as one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((s, e))
    return out


def byte_spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges as ranges of the original text's UTF-8 bytes."""
    if not ranges:
        return []
    at = [m.span() for m in _WORD.finditer(fold(text))]
    return [(at[s][0], at[e - 1][1]) for s, e in ranges]


def find_leaks(docs: DataFrame, items: DataFrame, n: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text", max_item_bytes: int = MAX_ITEM_BYTES, with_clean: bool = False) -> DataFrame:
    """Adds n_words, n_hit, leak_items (sorted strings), leak_spans (byte ranges of the original text) and, on request, clean_text.

    The items' windows go into one Aho-Corasick automaton over words. Its size
    is bounded by max_item_bytes of item text, which is measured first; a larger
    set is dealt by hash into parts, each with an automaton and a written pass
    over the texts of its own, which adds its finds to those before. So one
    part is broadcast and held at a time, and built once a worker.

    A null or empty text has no words and no hit; null item ids and items
    without words are passed over; repeated items and documents each count as
    they stand; empty tables give no hits or no rows; input columns called as
    an output are replaced; a text of any length is scanned whole. clean_text
    lacks the hit words and stays as it was where nothing was hit.
    """
    spark = docs.sparkSession
    added = ("n_words", "n_hit", "leak_items", "leak_spans", "clean_text")
    df = without(docs, *added)
    rows = items.select(F.col(f"`{item_id}`").cast("string").alias("i"), F.col(f"`{item_text}`").alias("t")).where("i IS NOT NULL AND t IS NOT NULL")
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = max(1, -(-int(total) // max_item_bytes))
    rows = rows.withColumn("p", F.pmod(F.xxhash64("i", "t"), F.lit(parts)))
    names, run_id = df.columns, uuid.uuid4().hex
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())])
    found = df.withColumns({"_leak_words": F.lit(0).cast("long"), "_leak_ranges": F.array().cast(T.ArrayType(span)), "_leak_items": F.array().cast("array<string>")})
    for p in range(parts):
        part = sorted({(r["i"], r["t"]) for r in rows.where(F.col("p") == p).select("i", "t").toLocalIterator()})
        found = _pass(found, text, n, spark.sparkContext.broadcast(part), f"{run_id}-{p}")
        if p < parts - 1:
            found = cut(found, "leaks")

    fields = [("n_words", T.LongType()), ("n_hit", T.LongType()), ("leak_items", T.ArrayType(T.StringType())), ("leak_spans", T.ArrayType(span))]
    schema = T.StructType([*df.schema.fields, *[T.StructField(c, t) for c, t in fields + [("clean_text", T.StringType())] * with_clean]])
    k = names.index(text)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits, spans, clean = [], [], []
            ranges = b.column(len(names) + 1).to_pylist()
            for i, r in enumerate(ranges):
                if not r and not with_clean:
                    hits.append(0)
                    spans.append([])
                    continue
                t = b.column(k)[i].as_py()
                whole = united([(x["start"], x["stop"]) for x in r])
                hits.append(sum(e - s for s, e in whole))
                at = byte_spans(t, whole)
                spans.append([{"start": s, "stop": e} for s, e in at])
                if with_clean:
                    raw = (t or "").encode()
                    edges = [0, *[x for p in at for x in p], len(raw)]
                    clean.append(b"".join(raw[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True)).decode() if at else t)
            items = [sorted(set(x)) for x in b.column(len(names) + 2).to_pylist()]
            cols = [*[b.column(i) for i in range(len(names))], b.column(len(names)), pa.array(hits, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, _SPANS)]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(clean, pa.string())] * with_clean, names=schema.names)

    return found.mapInArrow(told, schema)


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def _pass(found: DataFrame, text: str, n: int, items, key: str) -> DataFrame:
    """found with the hits of some items added to its last three columns: words, ranges (of words) and items."""
    k, last = found.columns.index(text), len(found.columns) - 3
    names = found.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _built:
            _built.clear()
            _built[key] = Automaton(items.value, n)
        a = _built[key]
        for b in batches:
            words, ranges, ids = [], b.column(last + 1).to_pylist(), b.column(last + 2).to_pylist()
            for i in range(b.num_rows):
                count, spans, got = a.scan(b.column(k)[i].as_py())
                words.append(count)
                if spans:
                    ranges[i] = [*ranges[i], *({"start": s, "stop": e} for s, e in united(spans))]
                    ids[i] = [*ids[i], *got]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(last)], pa.array(words, pa.int64()), pa.array(ranges, _SPANS), pa.array(ids, pa.list_(pa.string()))], names=names)

    return found.mapInArrow(run, found.schema)


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    """Each document's words, words inside 10-word windows of benchmark items, and those items."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = find_leaks(docs, items, n=10)
    listed = F.array_join("leak_items", ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("leak_items").cast("long").alias("n_items"), F.sha2(listed.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP2_ORACLE = r"""
WITH dw AS (
  SELECT doc_id, text, rid, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws
  FROM (SELECT *, row_number() OVER () AS rid FROM documents)),
bw AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
bp AS (
  SELECT item_id, least(len(ws), 10) AS k, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS win
  FROM (SELECT item_id, ws, unnest(range(1, greatest(2, len(ws) - 8))) AS i FROM bw WHERE len(ws) > 0)),
ks AS (SELECT DISTINCT k FROM bp),
dp AS (
  SELECT rid, i, k, array_to_string(ws[i:i + k - 1], ' ') AS win
  FROM (SELECT rid, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM dw, ks WHERE len(ws) >= k)),
hit AS (SELECT dp.rid, dp.i, dp.k, bp.item_id FROM dp JOIN bp ON dp.win = bp.win AND dp.k = bp.k),
hw AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM hit) GROUP BY rid),
hi AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT rid, item_id FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hw USING (rid) LEFT JOIN hi USING (rid)
"""
