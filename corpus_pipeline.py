"""From raw documents to shards: quality rules, near-duplicates, decontamination, mixing, sharding.

Every stage takes (spark, docs, sf_dir), calls one corpus operator on all that
the stage before kept, and returns a DataFrame; what it returns is written as
Parquet and read again as the next stage's docs. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brinewell.llm.common import row_hash
from brinewell.llm.decontam import find_leaks
from brinewell.llm.mixing import mixed_documents
from brinewell.llm.neardup import near_duplicates
from brinewell.llm.quality import judge_quality
from brinewell.llm.sharding import shard
from brinewell.session import cut

#: Words in a shingle and similarity in percent of near-duplicates; words in a benchmark window; output shards.
SHINGLE, PERCENT, WINDOW, SHARDS = 5, 80, 10, 24


def _with_text(df: DataFrame, text, columns: list[str]) -> DataFrame:
    """df in the given columns with another text, and n_chars its length where there is that column."""
    out = df.withColumn("text", text)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*[F.col(f"`{c}`") for c in columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without the lines that their source's documents share beyond the limits."""
    judged = judge_quality(docs, with_clean=True).where("kept")
    return _with_text(judged, F.col("clean_text"), docs.columns)


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each near-duplicate group; documents without a doc_id stay.

    Where rows repeat a kept doc_id, the first by content hash stays.
    """
    kept = near_duplicates(docs, n=SHINGLE, percent=PERCENT).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    first = Window.partitionBy("doc_id").orderBy("_h")
    named = docs.where("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi").withColumn("_h", row_hash(docs))
    named = named.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return named.select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return find_leaks(docs, items, n=WINDOW).where("n_hit = 0").select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, as often as it takes them, cut where a block ends."""
    mixed = mixed_documents(docs)
    return _with_text(mixed, F.col("text"), docs.columns)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and slot."""
    return shard(docs, SHARDS)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicate_groups),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("sharding", shards),
]

#: None: chosen-path trees, keyed permutations and Spark's hashes have no DuckDB counterpart; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
