"""Readers, guarded writers, schemas and the streaming form of upserts."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brinewell.sources import files, schemas
from brinewell.streaming.ingest import stream_upserts


def test_csv_by_header_name(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("class,sender\nhuman,a@b.c\n")
    assert [tuple(r) for r in files.csv_table(spark, str(p), "sender string, class string, n int").collect()] == [("a@b.c", "human", None)]


def test_json_lines_drop_malformed(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"id": 1}\n{oops\n{"id": 2}\n')
    assert sorted(r["id"] for r in files.json_lines(spark, str(p), "id int").collect()) == [1, 2]
    q = tmp_path / "b.json"
    q.write_text('[{"id": 1},\n {"id": 5}]')
    assert sorted(r["id"] for r in files.json_arrays(spark, str(q), "id int").collect()) == [1, 5]


def test_message_folders(spark, tmp_path):
    for k in (1, 2):
        d = tmp_path / f"m{k}"
        d.mkdir()
        (d / "meta.json").write_text(json.dumps({"id": k, "subject": f"s{k}"}))
        (d / "body.txt").write_text(f"body {k}")
    (tmp_path / "m1" / "scan.pdf").write_bytes(b"x" * 10)
    rows = {r["id"]: r for r in files.message_folders(spark, str(tmp_path), "id int, subject string").collect()}
    assert rows[1]["body"] == "body 1" and [f["name"] for f in rows[1]["files"]] == ["scan.pdf"] and rows[2]["files"] == []


def test_ics(spark, tmp_path):
    p = tmp_path / "c.ics"
    p.write_bytes(b"BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nUID:1@x\r\nSUMMARY:Dinner\\, with \r\n friends\r\nDTSTART;TZID=\"America/New_York\":20260721T193000\r\nDURATION:PT1H30M\r\nSEQUENCE:2\r\nSTATUS:CONFIRMED\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nUID:2@x\r\nDTSTART;VALUE=DATE:20260722\r\nEND:VEVENT\r\nEND:VCALENDAR\r\n")
    rows = {r["uid"]: r for r in files.ics_events(spark, str(p)).withColumn("secs", files.duration_seconds(F.col("duration"))).collect()}
    assert rows["1@x"]["summary"] == "Dinner, with friends" and rows["1@x"]["zone"] == "America/New_York" and rows["1@x"]["secs"] == 5400 and rows["1@x"]["sequence"] == 2
    assert rows["2@x"]["all_day"] and not rows["1@x"]["all_day"]


def test_item_lines(spark):
    df = spark.createDataFrame([("l1", "Milk | 2 | l | cold\n | 3\nEggs | -1\nBread")], "list string, text string")
    assert [tuple(r) for r in files.item_lines(df, "text").collect()] == [("l1", "Milk", 2.0, "l", "cold"), ("l1", "Eggs", None, None, None), ("l1", "Bread", None, None, None)]


def test_guarded_writes(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    first = files.write_guarded(spark.range(100), path)
    assert files.current(spark, path) == first
    for bad in (spark.range(0), spark.range(50)):
        with pytest.raises(ValueError, match="refused"):
            files.write_guarded(bad, path)
    assert files.current(spark, path) == first
    assert files.current(spark, path) != files.write_guarded(spark.range(90), path)
    with pytest.raises(FileNotFoundError):
        files.snapshot(spark, f"{path}/none")


def test_checked_sql(spark):
    spark.createDataFrame([(1, "secret")], "id int, body string").createOrReplaceTempView("mail_t")
    assert files.checked_sql(spark, "SELECT id FROM mail_t", ("body",)).count() == 1
    with pytest.raises(PermissionError):
        files.checked_sql(spark, "SELECT length(body) FROM mail_t", ("body",))


def test_schema_changes(spark):
    df = spark.createDataFrame([(1,)], "id int")
    wanted = T.StructType.fromDDL("id INT, note STRING").add("n", "long", False)
    with pytest.raises(ValueError, match="n can't"):
        schemas.evolved(df, wanted)
    assert tuple(schemas.evolved(df, wanted, defaults={"n": 7}).first()) == (1, None, 7)
    with pytest.raises(TypeError):
        schemas.evolved(df, T.StructType.fromDDL("id STRING"))


def test_occurrence_checks(spark):
    rows = [("timed", 5, None, 9, None), ("all_day", None, "2026-01-01", None, "2026-01-02"), ("timed", 5, "2026-01-01", 9, None), ("odd", 1, None, 2, None)]
    df = spark.createDataFrame(rows, "start_kind string, start_utc long, start_date string, end_utc long, end_date string").withColumns({c: F.col(c).cast("date") for c in ("start_date", "end_date")})
    good, bad = schemas.checked(df, schemas.occurrence_checks())
    assert good.count() == 2 and {tuple(r["failed_checks"]) for r in bad.collect()} == {("shape",), ("kind", "shape")}


def test_stream_equals_batch(spark, tmp_path):
    src, out = tmp_path / "in", f"file://{tmp_path}/out"
    rows = spark.createDataFrame([(i % 30, i, f"v{i}") for i in range(90)], "id long, ver long, v string")
    schema = rows.schema
    for k in range(3):
        rows.where(f"ver % 3 = {k}").coalesce(1).write.mode("append").parquet(str(src))
        q = stream_upserts(spark, str(src), schema, out, f"file://{tmp_path}/cp", ["id"], "ver")
        q.awaitTermination(120)
        assert q.exception() is None
    got = sorted(map(tuple, files.bucketed(spark, out).collect()))
    assert got == [(i, 60 + i, f"v{60 + i}") for i in range(30)]


def test_merge_writes_touched_buckets_only(spark, tmp_path):
    out = f"file://{tmp_path}/t"
    newest = lambda df: df.groupBy("id").agg(F.max_by("v", "ver").alias("v"), F.max("ver").alias("ver"))
    assert files.bucketed(spark, out) is None
    rows = spark.createDataFrame([(i, "a", 1) for i in range(40)] + [(None, "none", 1)], "id long, v string, ver long")
    assert files.merge_buckets(rows.limit(0), out, ["id"], newest, 8) == [] and files.bucketed(spark, out) is None
    assert files.merge_buckets(rows, out, ["id"], newest, 8) == list(range(8))
    before = json.loads(files.current(spark, out))
    some = spark.createDataFrame([(7, "b", 2), (7, "b", 2), (7, "old", 0)], rows.schema)
    touched = files.merge_buckets(some, out, ["id"], newest, 99)  # the first merge fixed the number
    assert len(touched) == 1
    after = json.loads(files.current(spark, out))
    assert [k for k in before if before[k] != after[k]] == [f"{touched[0]}/8"]
    files.merge_buckets(some, out, ["id"], newest)  # run again
    got = {(r["id"], r["v"]) for r in files.bucketed(spark, out).collect()}
    assert got == {(i, "b" if i == 7 else "a") for i in range(40)} | {(None, "none")}
    assert files.bucketed(spark, out).count() == 41
    files.merge_buckets(some, out, ["id"], lambda df: df.where("id <> 7"))
    assert files.bucketed(spark, out).where("id = 7").isEmpty()


def test_tsv_by_name_and_by_place(spark, tmp_path):
    new, old, none = tmp_path / "new.tsv", tmp_path / "old.tsv", tmp_path / "none.tsv"
    new.write_text("message_id\tscore\tcategory\nm1\t3\tbill\n\t4\tnone\nm2\n")
    old.write_text("bill\tm1\textra\nnote\tm2\n\n")
    none.write_text("")
    first = ("category", "message_id")
    read = lambda p: files.tsv_rows(spark, f"file://{p}", "message_id", first)
    assert [r.asDict() for r in read(new).collect()] == [{"message_id": "m1", "score": "3", "category": "bill"}, {"message_id": "m2", "score": "", "category": ""}]
    assert [tuple(r) for r in read(old).collect()] == [("bill", "m1", "extra"), ("note", "m2", "")] and read(old).columns == ["category", "message_id", "extra"]
    assert read(none).columns == list(first) and read(none).isEmpty()
