"""A kept full-text index: postings written once, by token, and replaced for changed documents only."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brinewell.functions.speech import let
from brinewell.operators.search import tokens
from brinewell.session import cut
from brinewell.sources.files import current, point_at

#: Folders that the postings of a segment are dealt to, by the first two characters of the token.
BUCKETS = 64
_HEAD = 2
#: Ids that may be broadcast (8 MB); more are joined by key.
FEW = 500_000


def _bucket(token: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.left(token, F.lit(_HEAD))), F.lit(buckets)).cast("int")


def _counts(tokens: Column) -> Column:
    """struct(size, tfs): how many tokens there are, and each distinct one with its count, in token order."""

    def runs(s: Column) -> Column:
        first = F.filter(F.transform(s, lambda t, i: F.when((i == 0) | (t != F.get(s, i - 1)), i)), lambda i: i.isNotNull())
        return let(first, lambda f: F.transform(f, lambda i, k: F.struct(F.get(s, i).alias("token"), (F.coalesce(F.get(f, k + 1), F.size(s)) - i).cast("long").alias("tf"))))

    return F.struct(F.size(tokens).cast("long").alias("size"), let(F.array_sort(tokens), runs).alias("tfs"))


def wanted_rows(rows: DataFrame, ids: DataFrame, id: str) -> DataFrame:  # noqa: A002
    """The rows whose id is among ids; up to FEW of those, counted first, go to the rows, so that texts stay where they lie."""
    few = ids.limit(FEW + 1).count() <= FEW
    return rows.join(F.broadcast(ids) if few else ids, id, "left_semi")


@dataclass
class TextIndex:
    """An opened index. A segment is a folder of postings (token, id, tf, size), of marks (id, mark, size) and of dead ids.

    A segment's rows hold for the ids that no later segment names as dead, so
    a change costs the changed documents' postings and a short list of ids,
    whatever the index's size; ``compacted`` writes the segments into one.
    """

    spark: SparkSession
    path: str
    segments: list[str] = field(default_factory=list)
    buckets: int = BUCKETS
    docs: int = 0
    total: int = 0
    stamp: str = ""
    key: str = "bigint"

    def _state(self) -> str:
        return json.dumps({k: v for k, v in vars(self).items() if k not in ("spark", "path")})

    def _alive(self, kind: str, narrow=lambda df: df) -> DataFrame:
        parts = []
        for i, s in enumerate(self.segments):
            columns = {"postings": "token string, id {}, tf bigint, size bigint, bucket int", "marks": "id {}, mark decimal(30,0), size bigint"}[kind]
            rows = narrow(self.spark.read.schema(columns.format(self.key)).parquet(f"{self.path}/{s}/{kind}"))
            later = [self.spark.read.parquet(f"{self.path}/{x}/dead") for x in self.segments[i + 1 :]]
            parts.append(rows.join(reduce(DataFrame.unionByName, later).distinct(), "id", "left_anti") if later else rows)
        return reduce(DataFrame.unionByName, parts)

    def postings(self, wanted: list[str] | None = None, prefix: bool = False) -> DataFrame:
        """(token, id, tf, size): all, or those of some tokens, or of tokens that begin with them.

        Only the folders of those tokens are listed, and within a file only the
        row groups that can hold them are read, as rows lie in token order.
        """

        def narrow(df: DataFrame) -> DataFrame:
            if wanted is None:
                return df.drop("bucket")
            if not wanted:
                return df.drop("bucket").where("false")
            if not prefix or all(len(t) >= _HEAD for t in wanted):
                df = df.where(F.col("bucket").isin(*[_bucket(F.lit(t), self.buckets) for t in wanted]))
            hit = reduce(Column.__or__, [F.col("token").startswith(t) for t in wanted]) if prefix else F.col("token").isin(*wanted)
            return df.where(hit).drop("bucket")

        return self._alive("postings", narrow)

    def marks(self) -> DataFrame:
        """(id, mark, size) of every document: a hash of its texts and its number of tokens."""
        return self._alive("marks")

    def totals(self) -> tuple[int, int]:
        """Documents with a token, and tokens; kept, not counted."""
        return self.docs, self.total

    def _added(self, rows: DataFrame, dead: DataFrame | None, stamp: str) -> TextIndex:
        """A further segment from (id, text) rows; the pointer is moved last, so readers see all of it or nothing."""
        name = f"seg-{uuid.uuid4().hex}"
        at = f"{self.path}/{name}"
        # a document's rows meet once, as texts; its tokens are counted in its own row, written once and then put in order
        said = rows.groupBy("id").agg(F.sum(F.xxhash64("text").cast("decimal(20,0)")).alias("mark"), F.concat_ws("\n", F.collect_list("text")).alias("text"))
        made = said.select("id", F.col("mark").cast("decimal(30,0)").alias("mark"), let(tokens(F.col("text")), _counts).alias("_c"))
        made = cut(made.select("id", "mark", F.col("_c.size").alias("size"), F.col("_c.tfs").alias("_tfs")), "index-counts")
        made.select("id", "mark", "size").write.parquet(f"{at}/marks")
        sizes = made.select("id", "size")
        placed = made.select("id", "size", F.inline("_tfs")).select("token", "id", "tf", "size")
        bucket = _bucket(F.col("token"), self.buckets)
        order = ["bucket", "token", "id"]
        placed.repartitionByRange(bucket, "token", "id").withColumn("bucket", bucket).sortWithinPartitions(*order).write.partitionBy("bucket").parquet(f"{at}/postings")
        (dead if dead is not None else sizes.select("id").limit(0)).write.parquet(f"{at}/dead")
        new = TextIndex(self.spark, self.path, [*self.segments, name], self.buckets, stamp=stamp, key=rows.schema["id"].dataType.simpleString())
        new.docs, new.total = (int(x or 0) for x in new.marks().where("size > 0").agg(F.count(F.lit(1)), F.sum("size")).first())
        point_at(self.spark, self.path, new._state())
        return new

    def compacted(self) -> TextIndex:
        """The same index in one segment, its rows copied without the dead ones; no text is read."""
        name = f"seg-{uuid.uuid4().hex}"
        at = f"{self.path}/{name}"
        self.marks().write.parquet(f"{at}/marks")
        order = ["bucket", "token", "id"]
        self._alive("postings").repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("bucket").parquet(f"{at}/postings")
        self.spark.read.parquet(f"{at}/marks").select("id").limit(0).write.parquet(f"{at}/dead")
        point_at(self.spark, self.path, replace(self, segments=[name])._state())
        return opened(self.spark, self.path)


def opened(spark: SparkSession, path: str) -> TextIndex | None:
    """The index at path, or None."""
    state = current(spark, path)
    return TextIndex(spark, path, **json.loads(state)) if state else None


def _rows(docs: DataFrame, id: str, text: str) -> DataFrame:  # noqa: A002
    return docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("id IS NOT NULL")


def built(docs: DataFrame, id: str, text: str, path: str, stamp: str = "", buckets: int = BUCKETS) -> TextIndex:  # noqa: A002
    """A new index of docs at path. Null texts have no tokens, rows of one id are one document, rows without an id can't be found and are left out."""
    return TextIndex(docs.sparkSession, path, [], buckets)._added(_rows(docs, id, text), None, stamp)


def synced(index: TextIndex, docs: DataFrame, id: str, text: str, stamp: str = "") -> TextIndex:  # noqa: A002
    """The index after docs became what it is now: new and changed documents are indexed, gone ones die, all others stay as they lie.

    What changed is found by comparing hashes of the texts; texts that are the
    same are neither tokenised nor moved.
    """
    rows = _rows(docs, id, text)
    now = rows.groupBy("id").agg(F.sum(F.xxhash64("text").cast("decimal(20,0)")).alias("_now"))
    j = index.marks().select("id", "mark").join(now, "id", "full")
    moved = j.where(~F.col("mark").eqNullSafe(F.col("_now")))
    at = f"{index.path}/diff-{uuid.uuid4().hex}"
    moved.select("id", F.col("mark").isNotNull().alias("was"), F.col("_now").isNotNull().alias("held")).write.parquet(at)
    diff = docs.sparkSession.read.parquet(at)
    return index._added(wanted_rows(rows, diff.where("held").select("id"), "id"), diff.where("was").select("id"), stamp)
