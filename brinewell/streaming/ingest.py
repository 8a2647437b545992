"""The streaming form of incremental runs: new files in, the same batch functions on every micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from brinewell.operators.upkeep import latest
from brinewell.sources.files import merge_buckets


def stream_upserts(spark: SparkSession, source: str, schema: T.StructType, target: str, checkpoint: str, key: list[str], version: str, extract: Callable[[DataFrame], DataFrame] | None = None, buckets: int = 256) -> StreamingQuery:
    """Every micro-batch of files is merged into the bucketed table at `target`, the highest version of each key winning.

    Which files are new is the checkpoint's business, so rows about old events
    that arrive late are taken like any other; no event-time watermark drops
    them. A batch writes only the buckets of the keys that it touches (`bucketed`
    reads them); run again after a failure it gives the same table.
    """

    def newest(every: DataFrame) -> DataFrame:
        return latest(every, key, F.col(version).desc(), F.xxhash64(*[F.col(c) for c in every.columns]))

    def merge(batch: DataFrame, batch_id: int) -> None:
        merge_buckets(extract(batch) if extract else batch, target, key, newest, buckets)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time: str, width: str, late: str, *groups: str) -> DataFrame:
    """Counts by tumbling window (extension: the batch operators have none)."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *groups).agg(F.count(F.lit(1)).alias("n"))
