"""Readers and guarded writers."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brinewell.session import cut


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def snapshot(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """One immutable Parquet version; refuses if it is missing."""
    if not exists(spark, path):
        raise FileNotFoundError(f"no snapshot at {path}")
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def csv_table(spark: SparkSession, path: str, schema: str | T.StructType, sep: str = ",", header: bool = True) -> DataFrame:
    """Columns by header name, others of the schema null; without a header, by place."""
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if not header:
        return spark.read.csv(path, sep=sep, schema=wanted)
    raw = spark.read.csv(path, sep=sep, header=True)  # all text: columns may stand in any order
    have = {c.strip().lower(): c for c in raw.columns}
    cols = [F.col(f"`{have[f.name.lower()]}`").try_cast(f.dataType) if f.name.lower() in have else F.lit(None).cast(f.dataType) for f in wanted]
    return raw.select(*[c.alias(f.name) for c, f in zip(cols, wanted, strict=True)])


def tsv_rows(spark: SparkSession, path: str, required: str, first: tuple[str, ...]) -> DataFrame:
    """A tab-separated file by its header's names, all text; without `required` among them the first row is data, and the columns are named by place.

    By place the leading ones are `first`; the others keep what the first row
    says of them. Short rows are filled with empty texts, rows without a value
    of `required` are left out. All files below path have the header of the
    first. An empty file gives no rows of the columns `first`.
    """
    read = lambda header, schema=None: spark.read.csv(path, sep="\t", header=header, schema=schema, quote='"', escape='"')
    raw = read(False)
    top = raw.first() if raw.columns else None
    if top is None:
        return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in first]))
    names = [(c or "").strip() for c in top]
    by_name = required in names
    columns = names if by_name else [*first, *names[len(first) :]]
    df = read(by_name, T.StructType([T.StructField(f"_{i}", T.StringType()) for i in range(len(columns))])).toDF(*columns)
    filled = df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in columns])
    return filled.where(F.trim(f"`{required}`") != "")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line, malformed ones dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def json_arrays(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that each hold an array of objects."""
    return spark.read.schema(schema).json(path, multiLine=True)


def dropped_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, name, ext, bytes, sha256, content) of every file below a folder."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    return f.select("path", name.alias("name"), ext.alias("ext"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), "content")


def decorative(ext: Column, size: Column, most: int = 40_000) -> Column:
    """Small images that come with messages."""
    return ext.isin("png", "gif", "jpg", "jpeg", "webp", "bmp") & (size <= most)


def message_folders(spark: SparkSession, path: str, meta_schema: str) -> DataFrame:
    """A row for each folder with a meta.json: its fields, body (body.txt) and files."""
    f = dropped_files(spark, path).withColumn("folder", F.regexp_replace("path", "/[^/]+$", ""))
    text = F.decode("content", "utf-8")
    per = f.groupBy("folder").agg(
        F.max(F.when(F.col("name") == "meta.json", text)).alias("_meta"),
        F.max(F.when(F.col("name") == "body.txt", text)).alias("body"),
        F.array_sort(F.collect_list(F.when(~F.col("name").isin("meta.json", "body.txt"), F.struct("name", "ext", "bytes", "sha256")))).alias("files"),
    )
    return per.where("_meta IS NOT NULL").withColumn("_m", F.from_json("_meta", meta_schema)).select("folder", "_m.*", "body", "files")


def thin(text: Column, pages: Column, least: int = 120) -> Column:
    """Text too short for its pages: a scan."""
    return F.length(F.trim(F.coalesce(text, F.lit("")))) < least * F.greatest(pages, F.lit(1))


def item_lines(df: DataFrame, text: str) -> DataFrame:
    """name, quantity, unit and note of lines 'name | quantity | unit | note'; lines without a name go, quantities that aren't positive are null."""
    line = df.select(*[c for c in df.columns if c != text], F.explode(F.split(text, "\n")).alias("_l"))
    part = lambda k: F.trim(F.coalesce(F.get(F.split("_l", r"\|"), k), F.lit("")))
    q = part(1).try_cast("double")
    keep = [c for c in df.columns if c != text]
    return line.select(*keep, part(0).alias("name"), F.when(q > 0, q).alias("quantity"), F.nullif(part(2), F.lit("")).alias("unit"), F.nullif(part(3), F.lit("")).alias("note")).where("name <> ''")


def ics_events(spark: SparkSession, path: str) -> DataFrame:
    """Events of calendar files: uid, summary, location, status, sequence, dtstart, dtend, duration, rrule, all_day, zone."""
    text = spark.read.text(path, wholetext=True)
    flat = F.regexp_replace(F.regexp_replace(F.col("value"), "\r\n?", "\n"), "\n[ \t]", "")
    event = text.select(F.explode(F.regexp_extract_all(flat, F.lit(r"(?s)BEGIN:VEVENT\n(.*?)END:VEVENT"), 1)).alias("e"))

    def prop(name: str) -> Column:
        raw = F.regexp_extract("e", rf'(?m)^{name}(?:;(?:"[^"]*"|[^:"\n])*)?:(.*)$', 1)
        return F.nullif(F.trim(raw), F.lit(""))

    def param(name: str, key: str) -> Column:
        return F.nullif(F.regexp_extract("e", rf'(?m)^{name};[^:\n]*{key}="?([^":;\n]+)', 1), F.lit(""))

    plain = lambda c: F.regexp_replace(F.regexp_replace(c, r"\\[nN]", "\n"), r"\\([,;\\])", "$1")
    return event.select(
        prop("UID").alias("uid"), plain(prop("SUMMARY")).alias("summary"), plain(prop("LOCATION")).alias("location"),
        F.lower(prop("STATUS")).alias("status"), F.coalesce(prop("SEQUENCE").try_cast("int"), F.lit(0)).alias("sequence"),
        prop("DTSTART").alias("dtstart"), prop("DTEND").alias("dtend"), prop("DURATION").alias("duration"), prop("RRULE").alias("rrule"),
        F.coalesce(prop("DTSTART").rlike("^[0-9]{8}$"), F.lit(False)).alias("all_day"), param("DTSTART", "TZID").alias("zone"),
    )


def duration_seconds(c: Column) -> Column:
    """Seconds of an ISO duration of weeks, days, hours, minutes and seconds; null if it is none."""
    n = lambda unit: F.coalesce(F.regexp_extract(c, rf"([0-9]+){unit}", 1).try_cast("long"), F.lit(0).cast("long"))
    t = F.concat(F.lit("T"), F.substring_index(c, "T", -1))
    m = F.coalesce(F.when(c.contains("T"), F.regexp_extract(t, "([0-9]+)M", 1)).try_cast("long"), F.lit(0).cast("long"))
    total = n("W") * 604_800 + n("D") * 86_400 + n("H") * 3600 + m * 60 + n("S")
    return F.when(c.rlike(r"^[+-]?P"), F.when(c.startswith("-"), -total).otherwise(total))


def gazetteer(spark: SparkSession, path: str, key: int = 0, lat: int = 5, lon: int = 6) -> DataFrame:
    """(key, lat, lon) from fixed fields of tab-separated lines, the first line of each file left out; lines without a position are too."""
    most = max(key, lat, lon)
    t = spark.read.csv(path, schema=", ".join(f"f{i} string" for i in range(most + 1)), sep="\t", header=True, quote="", mode="PERMISSIVE")
    num = lambda i: F.trim(F.col(f"f{i}")).try_cast("double")
    return t.select(F.trim(F.col(f"f{key}")).alias("key"), num(lat).alias("lat"), num(lon).alias("lon")).where("key <> '' AND lat IS NOT NULL AND lon IS NOT NULL")


def mime_parts(messages: DataFrame, id: str, payload: str) -> DataFrame:  # noqa: A002
    """A row for each attachment and text body of nested message parts: id, path, kind, filename, mime, size, attachment_id, content.

    payload: a part as JSON, {mimeType, filename, body: {size, attachmentId,
    data}, parts: [...]}, nested to any depth. A part with a filename is an
    attachment, with the size that it states; another one of text/plain or
    text/html with data is a body, with its decoded size. Both may have parts
    of their own. path holds the places from the root down, so its order is the
    order of the tree. data is base64 in the form for URLs; content is null
    where it isn't.

    All messages are walked at once, a level a round, and each level is
    written before the next is taken out of it; rounds end when no part has
    parts. Null, empty and broken payloads have no rows; rows that repeat are
    walked each.
    """
    fields = "struct<mimeType:string,filename:string,body:struct<size:string,attachmentId:string,data:string>>"
    top = F.col(payload)
    level = cut(messages.select(F.col(id), F.array().cast("array<int>").alias("path"), top.alias("_part")).where("_part IS NOT NULL"), "mime-level")
    found: list[DataFrame] = []
    while not found or not level.isEmpty():
        p = F.from_json("_part", fields)
        mime, name, body = F.coalesce(p["mimeType"], F.lit("")), F.coalesce(p["filename"], F.lit("")), p["body"]
        kind = F.when(name != "", "attachment").when(mime.isin("text/plain", "text/html") & (F.coalesce(body["data"], F.lit("")) != ""), "body")
        sent = F.translate(body["data"], "-_=", "+/")
        content = F.try_to_binary(F.concat(sent, F.repeat(F.lit("="), F.pmod(-F.length(sent), F.lit(4)))), F.lit("base64"))
        size = F.when(name != "", F.coalesce(body["size"].try_cast("long"), F.lit(0))).otherwise(F.octet_length(content))
        flat = level.select(id, "path", kind.alias("kind"), name.alias("filename"), mime.alias("mime"), size.cast("long").alias("size"), body["attachmentId"].alias("attachment_id"), content.alias("content"))
        found.append(flat.where("kind IS NOT NULL"))
        parts = F.posexplode(F.from_json(F.get_json_object("_part", "$.parts"), "array<string>"))
        level = cut(level.select(id, F.col("path").alias("_up"), parts.alias("_i", "_part")).where("_part IS NOT NULL").select(id, F.concat("_up", F.array("_i")).alias("path"), "_part"), "mime-level")
    return reduce(DataFrame.unionByName, found)


def write_guarded(df: DataFrame, path: str, least_share: float = 0.8) -> str:
    """Writes a new version below path and points CURRENT at it; refuses an empty one, or one below a share of the last.

    The pointer is a file of its own, renamed last in one step that replaces the
    old one, so readers see whole versions only.
    """
    spark = df.sparkSession
    old = current(spark, path)
    target = f"{path}/v-{uuid.uuid4().hex}"
    df.write.parquet(target)
    n = spark.read.parquet(target).count()
    before = spark.read.parquet(old).count() if old else 0
    if n == 0 or n < least_share * before:
        fs, p = _fs(spark, target)
        fs.delete(p, True)
        raise ValueError(f"refused: {n} rows after {before}")
    point_at(spark, path, target)
    return target


def point_at(spark: SparkSession, path: str, value: str) -> None:
    """Makes CURRENT below path hold value: a new file, renamed in one step over the old one."""
    jvm = spark.sparkContext._jvm
    _, new = _fs(spark, f"{path}/{uuid.uuid4().hex}.pointer")
    paths = jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    out = _fs(spark, path)[0].create(new, True)
    out.write(bytearray(value.encode()))
    out.close()
    replace = spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 1)
    replace[0] = getattr(jvm, "org.apache.hadoop.fs.Options$Rename").OVERWRITE
    paths.rename(new, _fs(spark, f"{path}/CURRENT")[1], replace)


def stamp(table: DataFrame) -> str:
    """A digest of the names, sizes and times of a table's files; no column is read."""
    files = table.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    n, total = files.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*files.columns).cast("decimal(38,0)"))).first()
    return f"{n}-{total}"


def current(spark: SparkSession, path: str) -> str | None:
    """The version that CURRENT names."""
    if not exists(spark, f"{path}/CURRENT"):
        return None
    return spark.read.text(f"{path}/CURRENT").first()[0]


def bucketed(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of a table that ``merge_buckets`` keeps; None before the first merge."""
    now = current(spark, path)
    return spark.read.option("mergeSchema", True).parquet(*[f"{path}/{folder}" for folder in json.loads(now).values()]) if now else None


def merge_buckets(rows: DataFrame, path: str, key: list[str], merge: Callable[[DataFrame], DataFrame], buckets: int = 256) -> list[int]:
    """Merges rows into the table at path and returns the buckets of keys that were written again; the others stay as they are.

    merge takes the stored rows of those buckets and the new ones together, and
    must give the same rows when it is run again. Buckets go by a hash of the
    key; nulls count as a value. CURRENT holds the folder of each bucket and is
    replaced in one step at the end, so readers see whole versions and a run
    that fails changes nothing. `buckets` is fixed by the first merge: each
    merge writes its touched share of the table, so take as many as one task's
    memory and the table's size ask for.
    """
    spark = rows.sparkSession
    now = current(spark, path)
    have = json.loads(now) if now else {}
    n = int(next(iter(have)).split("/")[1]) if have else buckets
    numbered = lambda df: df.withColumn("_bucket", F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in key]), F.lit(n)).cast("int"))
    new = cut(numbered(rows), "merged-rows")
    touched = sorted(r[0] for r in new.select("_bucket").distinct().collect())  # `buckets` values at most
    if not touched:
        return []
    old = [f"{path}/{have[f'{b}/{n}']}" for b in touched if f"{b}/{n}" in have]
    plain = new.drop("_bucket")
    every = spark.read.option("mergeSchema", True).parquet(*old).unionByName(plain, allowMissingColumns=True) if old else plain
    version = f"v-{uuid.uuid4().hex}"
    numbered(merge(every)).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{path}/{version}")
    kept = {b for b in touched if exists(spark, f"{path}/{version}/_bucket={b}")}
    gone = {f"{b}/{n}" for b in touched}
    after = {k: v for k, v in have.items() if k not in gone} | {f"{b}/{n}": f"{version}/_bucket={b}" for b in kept}
    point_at(spark, path, json.dumps(after))
    return touched


#: A null in csv and tsv, told from an empty text; a text that is just this reads as null.
NULL = "\\N"


def write_text(df: DataFrame, path: str, kind: str) -> None:
    """Rows as csv or tsv with a header in each file, or as jsonl; quotes, separators and line ends within values are kept, and so are empty texts beside nulls."""
    if kind == "jsonl":
        df.write.option("ignoreNullFields", False).json(path)
    elif kind in ("csv", "tsv"):
        df.write.options(header=True, sep="," if kind == "csv" else "\t", quote='"', escape='"', emptyValue='""', nullValue=NULL, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    else:
        raise ValueError(f"csv, tsv or jsonl, not {kind}")


def read_text(spark: SparkSession, path: str, kind: str, schema: str | T.StructType) -> DataFrame:
    """What ``write_text`` has written."""
    if kind == "jsonl":
        return spark.read.schema(schema).json(path)
    return spark.read.schema(schema).options(header=True, sep="," if kind == "csv" else "\t", quote='"', escape='"', emptyValue="", nullValue=NULL, multiLine=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def write_blobs(df: DataFrame, path: str) -> None:
    """Contents by hash, once each, in folders by the hash's first two digits."""
    df.dropDuplicates(["sha256"]).withColumn("prefix", F.left("sha256", F.lit(2))).write.partitionBy("prefix").mode("append").parquet(path)


def cached(store: DataFrame, key: str, now: Column, ttl: int) -> DataFrame:
    """Entries that are still fresh, the latest of each key."""
    fresh = store.where(F.unix_timestamp(now) - F.unix_timestamp("fetched_at") < ttl)
    return fresh.groupBy(key).agg(F.max_by("value", "fetched_at").alias("value"), F.max("fetched_at").alias("fetched_at"))


def checked_sql(spark: SparkSession, query: str, banned: tuple[str, ...]) -> DataFrame:
    """A query over registered views, refused if its plan reads a banned column."""
    df = spark.sql(query)
    lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    used = "\n".join(x for x in lines if not re.search(r"\b(Relation|LogicalRDD|LocalRelation)\b", x))  # a scan names all columns of its table
    out = {c.lower() for c in df.columns}
    for c in banned:
        if re.search(rf"\b{re.escape(c)}#", used) or c.lower() in out:
            raise PermissionError(f"column {c} is not readable")
    return df


def markdown(rows: list, columns: list[str]) -> str:
    """A table of a small result."""
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|")
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *("| " + " | ".join(cell(r[c]) for c in columns) + " |" for r in rows)])
