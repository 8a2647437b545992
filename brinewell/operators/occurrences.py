"""Occurrences of recurring events, and their rebuilding where something changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def expanded(masters: DataFrame, overrides: DataFrame) -> DataFrame:
    """(series, event_id, original_start, start, end) of every occurrence of the masters.

    masters(event_id, first, every, times, duration): an occurrence at first +
    k * every for each k below times, with an override of the same series and
    original start in its place; overrides(event_id, series, original_start,
    start, end, cancelled). A cancelled override takes its occurrence away; one
    without a start keeps the original's, without an end the master's
    duration. Of several overrides of one occurrence the one with the largest
    event_id holds; those that meet no occurrence are left out, as are masters
    with a null or no number of times.
    """
    kept = overrides.groupBy("series", "original_start").agg(F.max_by(F.struct("event_id", "start", "end", "cancelled"), "event_id").alias("_o"))
    each = masters.where("times > 0").select(F.col("event_id").alias("series"), "first", "every", "duration", F.explode(F.sequence(F.lit(0), F.col("times").cast("int") - 1)).alias("_k"))
    each = each.select("series", "duration", (F.col("first") + F.col("_k") * F.col("every")).alias("original_start"))
    j = each.join(kept, ["series", "original_start"], "left").where(~F.coalesce("_o.cancelled", F.lit(False)))
    start = F.coalesce("_o.start", "original_start")
    return j.select("series", F.coalesce("_o.event_id", "series").alias("event_id"), "original_start", start.alias("start"), F.coalesce("_o.end", start + F.col("duration")).alias("end"))


def series_of(changed: DataFrame, overrides: DataFrame) -> DataFrame:
    """The distinct series that changed ids belong to: an override's master, any other id itself."""
    j = changed.select("event_id").join(overrides.select("event_id", F.col("series").alias("_s")), "event_id", "left")
    return j.select(F.coalesce("_s", "event_id").alias("series")).distinct()


def reexpanded(stored: DataFrame, masters: DataFrame, overrides: DataFrame, changed: DataFrame, dropped: DataFrame | None = None) -> DataFrame:
    """stored occurrences after masters or overrides changed: only their series are expanded again, all others stay as they are.

    changed(event_id): new, changed and removed ids; a removed override's
    series is in dropped(event_id, series), since the overrides no longer name
    it. A removed master leaves no occurrence.
    """
    before = overrides.select("event_id", "series")
    series = series_of(changed, before if dropped is None else before.unionByName(dropped))
    again = expanded(masters.join(series.withColumnRenamed("series", "event_id"), "event_id", "left_semi"), overrides.join(series, "series", "left_semi"))
    return stored.join(series, "series", "left_anti").unionByName(again)
