"""Full-text search over a postings table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinewell.functions.text import unaccented, unaccented_str

K1, B = 1.2, 0.75


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, accents dropped."""
    return F.filter(F.split(F.lower(unaccented(F.coalesce(text, F.lit("")))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def query_tokens(text: str) -> list[str]:
    """A query's distinct tokens; no operator of it reaches the engine."""
    import re

    return list(dict.fromkeys(t for t in re.split(r"[\W_]+", unaccented_str(text).lower()) if t))


def postings(docs: DataFrame, id: str, text: str) -> DataFrame:  # noqa: A002
    """(token, id, tf) of every token of every text; size it once and keep it partitioned by token."""
    return docs.select(F.col(id).alias("id"), F.explode(tokens(F.col(text))).alias("token")).groupBy("token", "id").agg(F.count(F.lit(1)).alias("tf"))


def refreshed(index: DataFrame, changed: DataFrame, id: str, text: str, gone: DataFrame | None = None) -> DataFrame:  # noqa: A002
    """The index after changed texts (replaced whole) and removed ids."""
    ids = changed.select(F.col(id).alias("id"))
    if gone is not None:
        ids = ids.unionByName(gone.select(F.col(id).alias("id")))
    return index.join(ids.distinct(), "id", "left_anti").unionByName(postings(changed, id, text).select(*index.columns))


def _hits(index: DataFrame, wanted: list[str], prefix: bool) -> DataFrame:
    """(id, term) of the documents that hold a term, or a word that begins with it."""
    match = [F.when(F.col("token").startswith(t) if prefix else F.col("token") == t, F.lit(t)) for t in wanted]
    keep = F.array_compact(F.array(*match))
    narrow = index.where(F.size(keep) > 0) if prefix else index.where(F.col("token").isin(*wanted))
    return narrow.select("id", F.explode(keep).alias("term"))


def match_all(index: DataFrame, wanted: list[str], prefix: bool = False) -> DataFrame:
    """Ids of the documents that hold every term."""
    return _hits(index, wanted, prefix).groupBy("id").agg(F.count_distinct("term").alias("_n")).where(F.col("_n") == len(wanted)).select("id")


def match_any(index: DataFrame, wanted: list[str], prefix: bool = False) -> DataFrame:
    return _hits(index, wanted, prefix).select("id").distinct()


def widened(index: DataFrame, wanted: list[str]) -> DataFrame:
    """(id, step): all terms, else all as beginnings, else any as beginning; the first step that finds something.

    One pass: a document's best step follows from how many terms it holds, and
    a one-row minimum picks the step.
    """
    whole = [F.max((F.col("token") == t).cast("int")) for t in wanted]
    begun = [F.max(F.col("token").startswith(t).cast("int")) for t in wanted]
    any_term = F.lit(False)
    for t in wanted:
        any_term = any_term | F.col("token").startswith(t)
    held = index.where(any_term).groupBy("id").agg(sum(whole[1:], whole[0]).alias("w"), sum(begun[1:], begun[0]).alias("b"))
    step = held.select("id", F.when(F.col("w") == len(wanted), 1).when(F.col("b") == len(wanted), 2).otherwise(3).alias("step"))
    return step.join(F.broadcast(step.agg(F.min("step").alias("step"))), "step").select("id", "step")


def ranked(index: DataFrame, wanted: list[str], sizes: DataFrame | None = None, totals: tuple[int, int] | None = None) -> DataFrame:
    """(id, score): BM25 of the documents that hold a term.

    index: (token, id, tf), with the documents' numbers of tokens as `size` or
    in sizes; totals: how many documents have a token, and how many tokens,
    where the index keeps them.
    """
    if sizes is None and totals is None:
        sizes = index.groupBy("id").agg(F.sum("tf").alias("size"))
    if totals is None:
        totals = tuple(int(x or 0) for x in sizes.agg(F.count(F.lit(1)), F.sum("size")).first())
    n, average = totals[0], totals[1] / max(totals[0], 1)
    hits = index.where(F.col("token").isin(*wanted))
    df = hits.groupBy("token").agg(F.count(F.lit(1)).alias("df"))  # a row a query term
    j = hits.join(F.broadcast(df), "token")
    j = j if "size" in index.columns else j.join(sizes if sizes is not None else index.groupBy("id").agg(F.sum("tf").alias("size")), "id")
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    score = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.lit(average)))
    return j.groupBy("id").agg(F.sum(score).alias("score"))


def snippet(text: Column, wanted: list[str], width: int = 12) -> Column:
    """`width` words around the first hit, hits in brackets, dots where text goes on."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    plain = lambda w: F.regexp_replace(F.lower(unaccented(w)), r"[^\p{L}\p{N}]+", "")
    is_hit = lambda w: plain(w).isin(*wanted)

    def cut(w: Column) -> Column:
        at = F.coalesce(F.array_position(F.transform(w, is_hit), True), F.lit(1)).cast("int")
        first = F.greatest(F.lit(1), F.when(at == 0, 1).otherwise(at) - width // 2)
        part = F.transform(F.slice(w, first, width), lambda x: F.when(is_hit(x), F.concat(F.lit("["), x, F.lit("]"))).otherwise(x))
        return F.concat(F.when(first > 1, "… ").otherwise(""), F.array_join(part, " "), F.when(first + width <= F.size(w), " …").otherwise(""))

    return F.transform(F.array(words), cut)[0]
