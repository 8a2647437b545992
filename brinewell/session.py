"""Session settings, table access and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}

#: Scratch folders of sessions that name none (tests), by application.
_own: dict[str, str] = {}


def local_session(cores: int | str = 8, memory: str = "8g", partitions: int = 8, name: str = "brinewell", shared: str | None = None) -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(name).config("spark.driver.memory", memory)
    b = b.config("spark.sql.shuffle.partitions", str(partitions)).config("spark.driver.host", "127.0.0.1")
    for k, v in (DEFAULTS | ({"spark.checkpoint.dir": shared} if shared else {})).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a dataset folder; any file system that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a local one only where it is unset and the master local (tests)."""
    app = spark.sparkContext.applicationId
    root = spark.conf.get("spark.checkpoint.dir", None) or _own.get(app)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder, and executors of a cluster share no local one")
        root = _own[app] = f"file://{tempfile.mkdtemp(prefix='brinewell-')}"
    return f"{root.rstrip('/')}/brinewell/{app}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back.

    Ends the lineage, so a lost executor costs a re-read, not a recomputation,
    and a table used twice is computed once. ``release`` removes what is left.
    """
    path = f"{scratch_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Deletes this application's scratch tables, after results have been written."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
