"""Touched keys, partial names, nested messages, series, local days, places, transcripts and run logs on literal rows."""

import json

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from brinewell.functions import speech
from brinewell.functions.text import FIELDS, fields_of
from brinewell.operators import geo, incremental, linking, lists, occurrences, times
from brinewell.plans import records
from brinewell.sources import files, runlog

SPELLED = [("leite", "milk"), ("milk", "milk"), ("papel toalha", "paper towels"), ("paper towel", "paper towels"), ("paper towels", "paper towels"), ("banana", "banana"), ("morango", "strawberry"), ("leite condensado", "condensed milk")]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def link(df):
    return linking.link_events(df, ["k"], "t", 10).select("id", "k", "t", "anchor")


def test_relinking_equals_a_full_run_and_leaves_other_keys(spark):
    make = lambda r: spark.createDataFrame(r, "id long, k string, t long, synced long")
    first = [(1, "a", 0, 5), (2, "a", 8, 5), (3, "a", 15, 5), (4, "b", 0, 5), (5, "b", 9, 5), (6, "c", 1, 5), (7, None, 3, 5), (8, None, 4, 5), (9, "d", 1, 5)]
    later = [r for r in first if r[0] not in (4, 9)]  # 4 and 9 went
    later = [(2, "e", 8, 20) if r[0] == 2 else r for r in later] + [(10, None, 12, 21), (11, "f", 5, 22), (12, "c", 40, 3)]  # 2 moved, 12 came late with an old stamp
    extract = lambda df: df.select("id", "k", "t")
    stored = extract(make(first))
    got_rows, got, touched = incremental.relinked(stored, link(stored), make(later), make(first).select("id"), "id", "synced", 20, ["k"], extract, link, 0)
    assert rows(got_rows) == rows(extract(make(later)))
    assert rows(got) == rows(link(extract(make(later))))
    assert {r["k"] for r in touched.collect()} == {"a", "b", "c", "d", "e", "f", None}
    _, same, none = incremental.relinked(stored, link(stored), make(first), make(first).select("id"), "id", "synced", 20, ["k"], extract, link, 0)
    assert none.count() == 0 and rows(same) == rows(link(stored))


def test_partial_names(spark):
    names = [(1, "Paper towels (Bounty)"), (2, "Leite condensado"), (3, "Iogurte (morango)"), (4, "Bounty paper towels"), (5, "Ripe Bananas organic fair trade large bunch"), (6, None), (7, "()"), (8, "Pineapple"), (8, "Pineapple")]
    asked = ["papel toalha", "bounty", "leite", "morango", "bananas organic fair trade large bunch", "apple", "de 12", "", None, "pineapple", "banana"]
    out = lists.partial_names(spark.createDataFrame(names, "id long, name string"), spark.createDataFrame([(a,) for a in asked + ["bounty"]], "ask string"), "id", spark.createDataFrame(SPELLED, "spelling string, canonical string"))
    got = {(r["ask"], r["id"]): (r["guarded"], r["sure"]) for r in out.collect()}
    assert got == {
        ("papel toalha", 1): (False, True), ("bounty", 1): (False, False), ("bounty", 4): (False, False), ("leite", 2): (True, False), ("morango", 3): (True, False),
        ("bananas organic fair trade large bunch", 5): (False, True), ("pineapple", 8): (False, False), ("banana", 5): (True, False),
    }


def part(mime, name="", data=None, size=None, parts=(), **body):
    return {"mimeType": mime, "filename": name, "body": {"size": size, "data": data} | body, "parts": list(parts)}


def test_mime_parts(spark):
    deep = part("text/html", data="PGI-")
    for _ in range(12):
        deep = part("multipart/mixed", parts=[deep])
    tree = part("multipart/mixed", parts=[part("text/plain", data="aGk="), part("image/png", "a.png", size=77, attachmentId="x"), deep, part("text/plain"), part("message/rfc822", "m.eml", parts=[part("text/plain", data="!!")])])
    payloads = [(1, json.dumps(tree)), (2, None), (3, ""), (4, "{broken"), (5, json.dumps({"mimeType": "text/plain", "body": {"data": "aGk"}})), (6, "{}"), (7, '{"parts": 3}')]
    out = files.mime_parts(spark.createDataFrame(payloads, "id long, payload string"), "id", "payload").orderBy("id", "path")
    got = [(r["id"], r["path"], r["kind"], r["filename"], r["mime"], r["size"], r["attachment_id"], None if r["content"] is None else bytes(r["content"])) for r in out.collect()]
    assert got == [
        (1, [0], "body", "", "text/plain", 2, None, b"hi"),
        (1, [1], "attachment", "a.png", "image/png", 77, "x", None),
        (1, [2, *[0] * 12], "body", "", "text/html", 3, None, b"<b>"),
        (1, [4], "attachment", "m.eml", "message/rfc822", 0, None, None),
        (1, [4, 0], "body", "", "text/plain", None, None, None),
        (5, [], "body", "", "text/plain", 2, None, b"hi"),
    ]


def test_series(spark):
    masters = spark.createDataFrame([(1, 0, 10, 3, 5), (2, 100, 10, 2, 1), (3, 0, 1, 0, 1), (4, 0, 1, None, 1)], "event_id long, first long, every long, times long, duration long")
    schema = "event_id long, series long, original_start long, start long, end long, cancelled boolean"
    before = [(11, 1, 10, 13, None, False), (12, 2, 110, None, None, True)]
    after = [(11, 1, 10, 14, 99, False), (13, 1, 10, 15, None, None), (14, 1, 999, 1, 2, False), (15, 1, 20, None, None, True)]
    stored = occurrences.expanded(masters, spark.createDataFrame(before, schema))
    assert rows(stored) == [(1, 1, 0, 0, 5), (1, 1, 20, 20, 25), (1, 11, 10, 13, 18), (2, 2, 100, 100, 101)]
    now = spark.createDataFrame(after, schema)
    changed = spark.createDataFrame([(11,), (13,), (15,), (12,)], "event_id long")
    out = occurrences.reexpanded(stored, masters, now, changed, spark.createDataFrame([(12, 2)], "event_id long, series long"))
    assert rows(out) == rows(occurrences.expanded(masters, now)) == [(1, 1, 0, 0, 5), (1, 13, 10, 15, 20), (2, 2, 100, 100, 101), (2, 2, 110, 110, 111)]
    gone = occurrences.reexpanded(stored, masters.where("event_id <> 2"), now, spark.createDataFrame([(2,)], "event_id long"))
    assert {r["series"] for r in gone.collect()} == {1}  # the master went; series 1 wasn't named, so it stays as stored
    assert (1, 11, 10, 13, 18) in rows(gone)


def test_days_are_pruned_and_instants_decide(spark):
    sf = "/root/testdata/sf0.001"
    df = records.activity_between(spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "day" in filters and "2024-01-0" in filters
    read = spark.createDataFrame([("2024-01-01", "2024-01-02T23:30:00-08:00"), ("2024-01-03", "2024-01-03T00:00:00Z"), ("2024-01-03", None)], "day string, at string").withColumn("day", F.col("day").cast("date"))
    at = F.to_timestamp("at")
    out = times.between_instants(read, "day", at, F.lit("2024-01-03T00:00:00Z").cast("timestamp"), F.lit("2024-01-03T07:30:00Z").cast("timestamp"))
    assert [r["at"] for r in out.collect()] == ["2024-01-03T00:00:00Z"]


def test_gazetteer_and_radius(spark, tmp_path):
    (tmp_path / "g.tsv").write_text('ZIP\ta\tb\tc\td\tLAT\tLON\textra\n 02139 \t-\t-\t-\t-\t42.3647\t-71.1042\tx\n10001\t"\t-\t-\t-\t 40.7506\t-73.9972 \n99999\t-\t-\t-\t-\tno\t1\n88888\t-\n')
    places = files.gazetteer(spark, f"file://{tmp_path}/g.tsv")
    assert {r["key"]: r["lat"] for r in places.collect()} == {"02139": 42.3647, "10001": 40.7506}
    origins = places.select(F.col("key").alias("o"), "lat", "lon").union(spark.createDataFrame([("none", None, None)], "o string, lat double, lon double"))
    near = {(r["o"], r["key"]): r["miles"] for r in geo.within_miles(origins, places, "o", "key", 250.0).collect()}
    assert near[("02139", "02139")] == 0 and 170 < near[("02139", "10001")] < 200 and len(near) == 4
    assert geo.within_miles(origins, places, "o", "key", 100.0).count() == 2
    assert {(r["o"], r["key"]) for r in geo.within_miles(origins, places, "o", "key", 250.0, 1).collect()} == {("02139", "02139"), ("10001", "10001")}


def _peak(spark, since=-1):
    """The last stage's id, and the most MB that a stage after `since` took in its tasks together."""
    jvm, sc = spark._jvm, spark.sparkContext
    seen = sc._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    rows = [(seen.apply(i).stageId(), seen.apply(i).peakExecutionMemory() / 1e6) for i in range(seen.size())]
    return max((i for i, _ in rows), default=-1), max((mb for i, mb in rows if i > since), default=0)


def test_nearest_places_equal_all_pairs_and_positions_are_searched_once(spark):
    places = spark.sql("SELECT id AS key, CASE WHEN id < 1500 THEN 10 + pmod(xxhash64(id), 997) / 800.0 WHEN id < 2500 THEN 55 + pmod(xxhash64(id), 997) / 33.0 ELSE pmod(xxhash64(id), 997) / 6.0 - 83 END AS lat, CASE WHEN id < 1500 THEN 20 + pmod(xxhash64(id, 1), 991) / 700.0 ELSE pmod(xxhash64(id, 1), 991) / 9.0 END AS lon FROM range(4000)")
    places = places.union(spark.sql("SELECT 4000 + id, 10.5D, 20.5D FROM range(30)"))
    origins = spark.sql("SELECT id AS o, CASE WHEN id < 200 THEN 10 + id / 160.0 ELSE (id - 200) * 0.52 - 10 END AS lat, CASE WHEN id < 200 THEN 20 + id / 150.0 ELSE (id - 200) * 0.6 END AS lon FROM range(390)").union(spark.sql("SELECT o, 10.5D, 20.5D FROM (SELECT explode(array(7L, 400L, 401L)) AS o)"))
    every = geo.within_miles(origins, places, "o", "key", 250.0)
    want = every.withColumn("n", F.row_number().over(Window.partitionBy("o").orderBy("miles", "key"))).where("n <= 5").drop("n")
    assert rows(geo.within_miles(origins, places, "o", "key", 250.0, 5)) == rows(want)
    spot = lambda name: spark.sql(f"SELECT id AS {name}, 10.5D AS lat, 20.5D AS lon FROM range(3000)")
    last, _ = _peak(spark)
    got = geo.within_miles(spot("o"), spot("key"), "o", "key", 250.0, 5).groupBy("key").count()
    assert rows(got) == [(i, 3000) for i in range(5)]
    assert _peak(spark, last)[1] < 400


@pytest.mark.parametrize(
    ("said", "left"),
    [
        ("[Music] Buy milk.", "Buy milk."), ("(sighs) ok", "ok"), ("((suspiro)) leite", "leite"), ("Two (2 kg) bags", "Two (2 kg) bags"), ("*applause*", ""), ("Muito obrigado.", ""), ("Compra leite, muito obrigado", "Compra leite, muito obrigado"),
        ("Hi. Thanks for watching!", "Hi."), ("ლლლ milk მმ", "milk"), ("♪♪", ""), (None, ""), ("a ,, b ;", "a, b;"), ("[blank_audio]", ""), ("(a very long group of words that goes on and on music)", "(a very long group of words that goes on and on music)"), (" - ", ""),
    ],
)
def test_cleaned_transcripts(spark, said, left):
    assert spark.createDataFrame([(said,)], "t string").select(speech.cleaned(F.col("t"))).first()[0] == left


def test_usable_reasons_in_order(spark):
    cases = [
        ("", 9000, 1.0, "nothing left"), (None, 9000, 1.0, "nothing left"), ("123", 9000, 1.0, "no latin text"), ("Sim.", 399, 1.0, "too little speech for an answer"), ("Sim.", 400, 0.49, "answer in an unsure language"),
        ("Isso mesmo", 400, 0.5, None), ("buy milk", 799, 1.0, "too little speech"), ("Oi", 800, 0.79, "only filler in an unsure language"), ("Oi", 800, 0.8, None), ("granola", 800, 0.79, "a single word in an unsure language"),
        ("granola", 800, 0.8, None), ("buy milk", 800, 0.0, None), ("buy milk", None, None, "too little speech"),
    ]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i long, t string, ms long, p double")
    got = {r["i"]: r["why"] for r in df.select("i", speech.unusable_reason(F.col("t"), F.col("ms"), F.col("p")).alias("why")).collect()}
    assert got == {i: c[3] for i, c in enumerate(cases)}


def test_run_log_takes_allowed_fields_only(spark, caplog):
    seen = []
    df = spark.range(10)
    with caplog.at_level("INFO", runlog.LOGGER):
        got = runlog.observed(df, "upsert", lambda d: seen.append(d.count()), rows=F.count(F.lit(1)), deleted=F.count_if(F.col("id") > 6))
        assert got == {"rows": 10, "deleted": 3} and seen == [10]
        assert "deleted=3" in caplog.text and "rows=10" in caplog.text and "status=ok" in caplog.text
        with pytest.raises(runlog.ForbiddenField):
            runlog.observed(df, "upsert", lambda d: seen.append("written"), subject=F.max("id"))
        with pytest.raises(runlog.ForbiddenField):
            runlog.line("sync", title="secret")
        with pytest.raises(ZeroDivisionError):
            runlog.observed(df, "upsert", lambda d: 1 / 0, rows=F.count(F.lit(1)))
        assert "error_class=ZeroDivisionError" in caplog.text and "division by" not in caplog.text
    assert seen == [10]
    assert runlog.line("sync", rows=2, added=1) == "sync added=1 rows=2"


def test_identifiers(spark):
    text = "Order 12345 and pedido #AB-99 | MATRÍCULA nº 12.345 | RG nº 12.345.678-9 | apólice n 77AB-1 | $12.00 then $1,200.50"
    got = {}
    for r in spark.createDataFrame([(text,)], "t string").select(F.explode(fields_of(F.col("t"), FIELDS)).alias("f")).select("f.*").collect():
        got.setdefault(r["key"], []).append(r["value"])
    assert got["order_no"] == ["12345", "AB-99"] and got["matricula"] == ["12.345"] and got["rg"] == ["12.345.678-9"] and got["amount_usd"] == ["$1,200.50", "$12.00"]


@pytest.mark.parametrize("kind", ["csv", "tsv", "jsonl"])
def test_text_sinks(spark, tmp_path, kind):
    data = [(1, 'a,"b"\tc\n"d', 1.5), (2, None, None), (3, "", -0.0), (4, " blank ", 1e300), (5, "back\\slash", 0.1)]
    df = spark.createDataFrame(data, "id long, t string, x double")
    files.write_text(df, f"file://{tmp_path}/{kind}", kind)
    assert rows(files.read_text(spark, f"file://{tmp_path}/{kind}", kind, df.schema)) == rows(df)
    with pytest.raises(ValueError):
        files.write_text(df, f"file://{tmp_path}/x", "xml")
