"""Log lines of runs: counts observed while a job runs, through a list of allowed fields."""

from __future__ import annotations

import logging
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession

#: Fields that may reach a log: ids of runs, counts, times and kinds, never content.
ALLOWED = frozenset({"run_id", "kind", "status", "error_class", "rows", "added", "updated", "deleted", "pruned", "skipped", "pages", "bytes", "elapsed_ms"})
LOGGER = "brinewell.runs"


class ForbiddenField(ValueError):
    """A field that isn't on the list of allowed ones."""


def line(event: str, level: int = logging.INFO, allowed: frozenset[str] = ALLOWED, **fields: object) -> str:
    """Logs `event name=value ...` in the order of the names, and returns it; any other field than the allowed ones refuses the line."""
    bad = sorted(set(fields) - allowed)
    if bad:
        raise ForbiddenField(f"not loggable: {', '.join(bad)}")
    out = " ".join([event, *(f"{k}={fields[k]}" for k in sorted(fields))])
    logging.getLogger(LOGGER).log(level, out)
    return out


def observed(df: DataFrame, event: str, write: Callable[[DataFrame], None], allowed: frozenset[str] = ALLOWED, **counts: Column) -> dict[str, object]:
    """Writes df by `write` and logs aggregates of its rows, counted while they pass; no second job reads them.

    Refuses a forbidden field before anything is written. A write that fails
    is logged by its error's class only, and raised.
    """
    bad = sorted(set(counts) - allowed)
    if bad:
        raise ForbiddenField(f"not loggable: {', '.join(bad)}")
    seen, run, start = Observation(f"{event}-{uuid.uuid4().hex}"), uuid.uuid4().hex[:10], time.monotonic()
    try:
        write(df.observe(seen, *[c.alias(k) for k, c in counts.items()]))
    except Exception as e:
        line(event, logging.ERROR, allowed | {"run_id", "error_class", "status"}, run_id=run, error_class=type(e).__name__, status="failed")
        raise
    got = dict(seen.get)
    line(event, logging.INFO, allowed | {"run_id", "elapsed_ms", "status"}, run_id=run, status="ok", elapsed_ms=round(1000 * (time.monotonic() - start)), **got)
    return got


def as_table(spark: SparkSession, runs: list[tuple[str, dict[str, object]]]) -> DataFrame:
    """(event, field, value) of observed runs."""
    rows = [(event, k, int(v)) for event, fields in runs for k, v in fields.items()]
    return spark.createDataFrame(rows, "event string, field string, value long")
