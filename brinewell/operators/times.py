"""Bounds, calendar arithmetic and local days."""

from __future__ import annotations

import re
import zoneinfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words for days, units of spans, and the years that a bound may lie in.
DAYS = {"today": 0, "hoje": 0, "yesterday": 1, "ontem": 1}
UNITS = {"h": "HOUR", "d": "DAY", "w": "WEEK"}
FIRST_YEAR, LAST_YEAR = 1970, 2100


def local_midnight(day: Column, zone: Column | str) -> Column:
    """The instant at which a day begins in a zone; of an unknown zone, in UTC."""
    known = F.when(zone.isin(*sorted(zoneinfo.available_timezones())), zone).otherwise("UTC") if isinstance(zone, Column) else F.lit(zone)
    return F.to_utc_timestamp(day.cast("timestamp_ntz").cast("timestamp"), known)


def local_day(instant: Column, zone: Column | str) -> Column:
    return F.from_utc_timestamp(instant, zone).cast("date")


def bound(value: str, zone: str, now: Column, end: bool = False) -> Column:
    """today, yesterday, a span back from now (12h, 7d, 2w), a day or a moment, as an instant.

    Days begin at the viewer's midnight; as an upper bound they end at the next.
    Anything else, or a year out of range, raises ValueError.
    """
    text = value.strip().casefold()
    if m := re.fullmatch(r"(\d{1,4})([hdw])", text):
        return now - F.expr(f"INTERVAL {int(m[1])} {UNITS[m[2]]}")
    if text in DAYS:
        day = F.date_sub(local_day(now, zone), DAYS[text])
    elif m := re.fullmatch(r"(\d{4})-\d{2}-\d{2}(t\d{2}:\d{2}(:\d{2})?)?", text):
        if not FIRST_YEAR <= int(m[1]) <= LAST_YEAR:
            raise ValueError(f"a year from {FIRST_YEAR} to {LAST_YEAR}, not {value}")
        if m[2]:
            return F.to_utc_timestamp(F.lit(text).cast("timestamp_ntz").cast("timestamp"), zone)
        day = F.lit(text).cast("date")
    else:
        raise ValueError(f"no bound: {value}")
    return local_midnight(F.date_add(day, 1) if end else day, zone)


def shifted(instant: Column, months: Column | int) -> Column:
    """Some calendar months on, the day clamped to the month and the time kept."""
    return instant + F.make_ym_interval(F.lit(0), F.lit(months) if isinstance(months, int) else months)


def sync_window(now: Column, back: int = 3, ahead: int = 12) -> tuple[Column, Column]:
    return shifted(now, -back), shifted(now, ahead)


def time_spec(day: Column, instant: Column, zone: Column, end_day: Column) -> Column:
    """struct(kind, order_ts, last_day): all-day entries order by their zone's midnight and end on the day before their exclusive end."""
    whole = day.isNotNull()
    return F.struct(
        F.when(whole, "all_day").otherwise("timed").alias("kind"),
        F.when(whole, local_midnight(day, zone)).otherwise(instant).alias("order_ts"),
        F.when(whole, F.greatest(day, F.date_sub(end_day, 1))).alias("last_day"),
    )


def day_matches(probes: DataFrame, calendar: DataFrame, zone: str) -> DataFrame:
    """(probe, instance) where an occurrence touches a probe's local day.

    probes(probe, day); calendar(instance, start, end), instants. Occurrences
    are dealt to the local days that they touch, so the join is on equal days.
    """
    last = F.greatest("start", F.col("end") - F.expr("INTERVAL 1 MICROSECOND"))
    days = calendar.select("instance", F.explode(F.sequence(local_day(F.col("start"), zone), local_day(last, zone))).alias("day"))
    return probes.select("probe", "day").join(days, "day").select("probe", "instance")


def between_instants(rows: DataFrame, day: str, instant: Column, since: Column, until: Column, margin: int = 2) -> DataFrame:
    """Rows whose instant is in [since, until), from a table that is partitioned by the local day of each row.

    A local day is at most a day from the day in any other zone, so days within
    `margin` of the bounds are read and the instant decides. The bounds must
    not depend on rows: then partitions of other days aren't listed. Rows
    without an instant, or without a day, are in no range.
    """
    coarse = (F.col(day) >= F.date_sub(since.cast("date"), margin)) & (F.col(day) <= F.date_add(until.cast("date"), margin))
    return rows.where(coarse).where((instant >= since) & (instant < until))
