"""Declared schemas: additive changes, and checks that send bad rows aside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tables as DDL; Spark parses it wherever a schema is asked for.
MESSAGE = "message_id STRING, thread_id STRING, internal_ts BIGINT, from_addr STRING, to_addrs STRING, cc_addrs STRING, reply_to STRING, subject STRING, snippet STRING, history_id BIGINT, labels ARRAY<STRING>, synced_at BIGINT, deleted_at BIGINT"
OCCURRENCE = "calendar_id STRING, instance_id STRING, series_event_id STRING, start_kind STRING, start_utc BIGINT, start_tz STRING, start_date DATE, end_utc BIGINT, end_tz STRING, end_date DATE, order_ts BIGINT, status STRING, is_override BOOLEAN, summary STRING, location STRING, transparency STRING, self_response_status STRING, synced_at BIGINT"
TRANSACTION = "entity_key STRING, entity_name STRING, counterparty STRING, date DATE, kind STRING, amount DOUBLE, currency STRING, ref_number STRING, message_id STRING, confidence DOUBLE, lane STRING, rule STRING, description STRING, link_key STRING, link_basis STRING, event_id BIGINT"
LIST_EVENT = "event_id BIGINT, occurred_at STRING, store STRING, item_name STRING, normalized_name STRING, unit STRING, quantity DOUBLE, action STRING, source_type STRING, actor STRING, trip_id BIGINT, note STRING, group_id BIGINT, raw_text STRING"


def evolved(df: DataFrame, schema: T.StructType, key: tuple[str, ...] = (), defaults: dict | None = None) -> DataFrame:
    """df with the schema's missing columns added; refuses a new key column, or a non-null one without a default."""
    have = {f.name: f for f in df.schema}
    out = df
    for f in schema:
        if f.name in have:
            if have[f.name].dataType != f.dataType:
                raise TypeError(f"{f.name}: {have[f.name].dataType.simpleString()} can't become {f.dataType.simpleString()}")
            continue
        if f.name in key or (not f.nullable and f.name not in (defaults or {})):
            raise ValueError(f"{f.name} can't be added")
        out = out.withColumn(f.name, F.lit((defaults or {}).get(f.name)).cast(f.dataType))
    return out


def checked(df: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that pass every check, and the others with the names of those they fail."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), name) for name, c in checks.items()]))
    marked = df.withColumn("failed_checks", failed)
    return marked.where(F.size("failed_checks") == 0).drop("failed_checks"), marked.where(F.size("failed_checks") > 0)


def occurrence_checks() -> dict[str, Column]:
    """An occurrence is timed or lies on days, never both."""
    return {
        "kind": F.expr("start_kind IN ('timed', 'all_day')"),
        "shape": F.expr("(start_kind = 'timed' AND start_utc IS NOT NULL AND start_date IS NULL) OR (start_kind = 'all_day' AND start_date IS NOT NULL AND start_utc IS NULL)"),
        "order": F.expr("coalesce(end_utc >= start_utc, end_date >= start_date, true)"),
    }
