"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brinewell.session import cut

#: The six ASCII white-space characters that part words, and A-Z with a-z.
SPACE = "[ \\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space; null counts as empty."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE, -1), lambda w: w != F.lit(""))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without input columns that clash with the names an operator adds (any case)."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def row_hash(df: DataFrame, seed: int = 0) -> Column:
    """A 64-bit hash of all hashable columns that also tells null from absent text."""
    cols = [f.name for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    nulls = F.concat(*[F.when(F.col(f"`{c}`").isNull(), "0").otherwise("1") for c in cols]) if cols else F.lit("")
    return F.xxhash64(F.lit(seed), nulls, *[F.col(f"`{c}`") for c in cols])


def let(value: Column, body) -> Column:
    """body(value) with value computed once, even where body uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def ordered(df: DataFrame, group: str, *order: Column) -> DataFrame:
    """Adds `_at`, a row's gapless place (from 0) in its group by `order`, and `_of`, the rows of the group.

    Rows are dealt to sorted ranges of (group, order) and written; a place is
    the row's place in its range plus the group's rows in earlier ranges. So a
    group may hold any share of the rows: none has to fit in a task, and rows
    that are equal throughout are parted too (which of them comes first is
    left open). Null groups are one group. df is read twice, so cut it first.
    """
    keys = [F.col(group), *order, F.col("_tie")]
    ranged = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = cut(ranged.withColumn("_m", F.monotonically_increasing_id()).drop("_tie"), "ordered")  # the range above bit 33, the place in it below
    placed = placed.withColumn("_range", F.shiftright("_m", 33))
    runs = placed.groupBy("_range", F.col(group).alias("_g")).agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_first"))
    earlier = Window.partitionBy("_g").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    runs = runs.select(F.col("_range").alias("_r"), "_g", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy("_g")).alias("_of"))
    j = placed.join(cut(runs, "ordered-runs"), (F.col("_range") == F.col("_r")) & F.col(group).eqNullSafe(F.col("_g")))
    return j.select(*df.columns, (F.col("_m") - F.col("_first") + F.col("_before")).alias("_at"), "_of")
