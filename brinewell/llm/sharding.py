"""Operator 8: reproducible global shuffle into shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brinewell.llm.common import row_hash, without
from brinewell.llm.permute import permuted, shape

#: Hash bins that number the rows; so many counts, no more, reach the driver.
BINS = 4096


def number_rows(df: DataFrame, bins: int = BINS) -> tuple[DataFrame, int]:
    """Gapless global row numbers ``_row`` (from 0) that don't depend on partitions, and their count.

    Rows are binned by a hash of their content; a bin's rows are numbered by
    two content hashes and start at the sum of the counts of earlier bins. Rows
    with the same number of the same content are interchangeable.
    """
    spark = df.sparkSession
    h = df.withColumns({"_h": row_hash(df, 1), "_g": row_hash(df, 2)}).withColumn("_bin", F.pmod("_h", F.lit(bins)).cast("int"))
    counts = sorted((r["_bin"], r["n"]) for r in h.groupBy("_bin").agg(F.count(F.lit(1)).alias("n")).collect())
    starts, n = [], 0
    for b, k in counts:
        starts.append((b, n))
        n += k
    offsets = spark.createDataFrame(starts, "_bin int, _start long")  # BINS rows at most
    w = Window.partitionBy("_bin").orderBy("_h", "_g")
    out = h.withColumn("_rn", F.row_number().over(w).cast("long")).join(F.broadcast(offsets), "_bin")
    return out.withColumn("_row", F.col("_start") + F.col("_rn") - 1).drop("_h", "_g", "_bin", "_rn", "_start"), n


def shard(df: DataFrame, shards: int = 24, seed: int = 8) -> DataFrame:
    """Adds ``shard`` (0 .. shards - 1) and ``slot`` (gapless from 0 in each shard) to every row.

    A Feistel permutation with cycle walking takes the global row number to a
    place p; the shard is p mod shards, the slot p div shards, so shard sizes
    differ by one row at most and both can be computed for any row number.
    The same rows get the same places however they are partitioned.

    Nulls in any column hash as values of their own; repeated rows each get a
    place; an empty table stays empty; long texts are only hashed; input
    columns called shard or slot (any case) are replaced.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    rows, n = number_rows(without(df, "shard", "slot"))
    a, b = shape(n)
    place = permuted("_row", f"{max(n, 1)}L", f"{a}L", f"{b}L", f"{seed}L")
    return rows.withColumn("_place", place).withColumn("shard", (F.col("_place") % shards).cast("int")).withColumn("slot", F.expr(f"_place div {shards}")).drop("_row", "_place")


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    """Every document's shard and slot, under the law `rows`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce("text", F.lit(""))
    slim = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return shard(slim, 24).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
