"""Rows of one event: anchored linking, and the richest row of each event."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brinewell.session import cut


#: Distinct times up to which a key is walked over in one piece.
WALKED = 20_000


def _anchors(window: int):
    @F.pandas_udf(T.ArrayType(T.LongType()))
    def anchors(times: pd.Series) -> pd.Series:
        def walk(t: np.ndarray) -> np.ndarray:
            out, at = np.empty(len(t), np.int64), 0
            while at < len(t):
                end = int(np.searchsorted(t, t[at] + window, "right"))
                out[at:end] = t[at]
                at = end
            return out

        return times.map(walk)

    return anchors


def link_events(rows: DataFrame, keys: list[str], time: str, window: int) -> DataFrame:
    """Adds `anchor`: the time of the first row of the event that each row belongs to.

    Rows of a key join the open event unless more than `window` (in the unit of
    `time`, a long) after its first row; such a row opens the next event. Rows
    without a time have no anchor; null keys are a key; rows that repeat share
    their anchor. An anchor and the keys name the event.

    Only distinct times are looked at. Keys with up to WALKED of them are
    walked over one by one, each in a bounded array; of all others every time
    finds its successor (the first time beyond the window), and the events'
    first times follow from the key's first one by doubling the successors, so
    no key has to fit in a task.
    """
    key = F.struct(*[F.col(k) for k in keys])
    times = rows.where(F.col(time).isNotNull()).select(key.alias("_key"), F.col(time).cast("long").alias("_t")).distinct()
    counted = times.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    large = cut(counted.where(F.col("_n") > WALKED), "hot-keys")
    few = times
    if not large.isEmpty():
        few = times.join(large, "_key", "left_anti")
    walked = few.groupBy("_key").agg(F.array_sort(F.collect_list("_t")).alias("_ts"))
    found = walked.select("_key", F.explode(F.arrays_zip(F.col("_ts").alias("t"), _anchors(window)("_ts").alias("a"))).alias("_z")).select("_key", F.col("_z.t").alias("_t"), F.col("_z.a").alias("anchor"))
    if not large.isEmpty():
        found = found.unionByName(_doubled(cut(times.join(large.select("_key"), "_key", "left_semi"), "hot-times"), window))
    at = found.select(*[F.col("_key")[k].alias(f"_{k}") for k in keys], "_t", "anchor")
    return rows.join(at, _same(keys, time), "left").select(*rows.columns, "anchor")


def _doubled(times: DataFrame, window: int) -> DataFrame:
    """(_key, _t, anchor) of distinct times, by blocks of the window's length: a block holds one event's first time at most."""
    t = F.col("_t")
    width = max(window, 1)
    blocked = times.withColumn("_b", F.expr(f"(_t - pmod(_t, {width}L)) div {width}L"))
    starts = cut(blocked.groupBy("_key", "_b").agg(F.min("_t").alias("_first")), "hot-blocks")  # a row a block
    line = Window.partitionBy("_key").orderBy("_b")
    later = starts.select("_key", "_b", F.lead("_b").over(line).alias("_b1"), F.lead("_first").over(line).alias("_f1"), F.lead("_first", 2).over(line).alias("_f2"))
    # times and, one block on, what they ask for: the first time beyond themselves and the window
    asks = blocked.select("_key", (F.col("_b") + 1).alias("_b"), (t + window).alias("_v"), t.alias("_from"))
    both = blocked.select("_key", "_b", t.alias("_v"), F.lit(None).cast("long").alias("_from")).unionByName(asks)
    # the time beyond v comes after it; among equal values the asking one comes last
    after = Window.partitionBy("_key", "_b").orderBy("_v", F.col("_from").isNotNull()).rowsBetween(1, Window.unboundedFollowing)
    within = both.withColumn("_next", F.min(F.when(F.col("_from").isNull(), F.col("_v"))).over(after)).where("_from IS NOT NULL").select("_key", F.col("_from").alias("_t"), (F.col("_b") - 1).alias("_b"), "_next")
    beyond = F.when(F.col("_b1") == F.col("_b") + 1, F.col("_f2")).otherwise(F.col("_f1"))
    jumps = cut(within.join(later, ["_key", "_b"]).select("_key", "_t", F.coalesce("_next", beyond).alias("_to")), "hot-successors")

    reached = cut(starts.groupBy("_key").agg(F.min("_first").alias("_t")), "hot-anchors")
    most = starts.groupBy("_key").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    for _ in range(int(most).bit_length()):
        reached = cut(reached.unionByName(reached.join(jumps, ["_key", "_t"]).where("_to IS NOT NULL").select("_key", F.col("_to").alias("_t"))).distinct(), "hot-anchors")
        onward = jumps.select("_key", F.col("_t").alias("_to"), F.col("_to").alias("_then"))
        jumps = cut(jumps.where("_to IS NOT NULL").join(onward, ["_key", "_to"]).select("_key", "_t", F.col("_then").alias("_to")), "hot-successors")
    own = reached.withColumn("_b", F.expr(f"(_t - pmod(_t, {width}L)) div {width}L")).select("_key", "_b", F.col("_t").alias("_a"))
    before = Window.partitionBy("_key").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    blocks = starts.select("_key", "_b").join(own, ["_key", "_b"], "left").withColumn("_last", F.last("_a", ignorenulls=True).over(before))
    j = blocked.join(blocks, ["_key", "_b"])
    return j.select("_key", "_t", F.when(t >= F.col("_a"), F.col("_a")).otherwise(F.col("_last")).alias("anchor"))


def _same(keys: list[str], time: str) -> Column:
    on = F.col(time) == F.col("_t")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return on


def richest(rows: DataFrame, event: list[str], *ranking: Column) -> DataFrame:
    """The first row of each event in the order of `ranking`; end it with a unique column."""
    w = Window.partitionBy(*event).orderBy(*ranking)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def largest_events(rows: DataFrame, entity: list[str], event: list[str], least: int, *ranking: Column) -> DataFrame:
    """The rows behind each entity's largest event of `least` rows or more, with `is_primary` on the one that stands for it.

    event: the columns that make an event, the entity's first; of equally large
    events the least by its columns. Counts come before the join, so only
    chosen events' rows are ranked. Null entities count as one.
    """
    sizes = rows.groupBy(*event).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    own = [c for c in event if c not in entity]
    best = sizes.groupBy(*entity).agg(F.min(F.struct((-F.col("_n")).alias("_n"), *own)).alias("_e")).select(*[F.col(c).alias(f"_{c}") for c in entity], *[F.col(f"_e.{c}").alias(f"_{c}") for c in own])
    on = F.lit(True)
    for c in event:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    chosen = rows.join(best, on, "left_semi")
    w = Window.partitionBy(*event).orderBy(*ranking)
    return chosen.withColumn("is_primary", F.row_number().over(w) == 1)
