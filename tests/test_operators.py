"""Operators on literal rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from brinewell.functions import text as fx
from brinewell.operators import graph, incremental, intervals, linking, measures, names, rules, search, upkeep


def one(spark, column, **values):
    cols = [F.lit(v).alias(k) for k, v in values.items()]
    return spark.range(1).select(*cols).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "value", "currency"),
    [("$202.16", 202.16, "USD"), ("$1,300.00", 1300.0, "USD"), ("R$ 1.234,56", 1234.56, "BRL"), ("$ 160 . 00", 160.0, "USD"), ("", None, None), ("1,234", 1234.0, None), ("1,23", 1.23, None), (None, None, None)],
)
def test_amounts(spark, raw, value, currency):
    r = spark.createDataFrame([(raw,)], "raw string").select(fx.parse_amount(F.col("raw")).alias("x")).first()["x"]
    assert (r["value"], r["currency"]) == (value, currency)


@pytest.mark.parametrize(
    ("raw", "day_first", "want"),
    [("06/30/2026", False, "2026-06-30"), ("17/07/2025", False, "2025-07-17"), ("11/12/2024", True, "2024-12-11"), ("11/12/2024", False, "2024-11-12"), ("Jun 6, 2026", False, "2026-06-06"), ("on 5/22", False, "2025-05-22"), ("13/45/2024", False, None), ("6th June 2026", False, "2026-06-06"), ("nothing", False, None)],
)
def test_dates(spark, raw, day_first, want):
    got = spark.createDataFrame([(raw, dt.date(2025, 6, 1))], "raw string, ref date").select(fx.parse_date(F.col("raw"), F.col("ref"), day_first).alias("x")).first()["x"]
    assert (got and got.isoformat()) == want


def test_clean_and_fold(spark):
    r = spark.createDataFrame([("  Café &amp; “Bar”​ Ａ  x ",)], "t string").select(fx.clean(F.col("t")).alias("c"), fx.fold(F.col("t")).alias("f")).first()
    assert r["c"] == 'Café & "Bar" A x'
    assert r["f"].startswith("cafe amp bar")


def test_link_keys(spark):
    rows = [
        ("e", "order", "AB-123456", None, None, "m1"),
        ("e", "order", "59115", None, None, "m2"),
        ("e", "order", None, 'Shipped: "The Blue Teapot."', None, "m3"),
        ("e", "booking", None, None, "Chez Nous!", "m4"),
        ("e", "note", None, None, "Chez Nous!", "m5"),
    ]
    df = spark.createDataFrame(rows, "entity string, kind string, ref string, description string, cp string, m string").withColumn("d", F.lit("2026-07-21").cast("date"))
    got = [tuple(r["k"]) for r in df.select(fx.link_key(*[F.col(c) for c in ("entity", "kind", "ref", "description", "cp", "d", "m")]).alias("k"), "m").orderBy("m").collect()]
    assert got == [("ref:AB-123456", "ref"), ("ref:e:59115", "ref"), ("title:e:blue teapot", "title"), ("cal:cheznous:2026-07-21", "counterparty+date"), ("solo:m5", "none")]


def test_anchored_linking_does_not_chain(spark):
    rows = [("k", t) for t in (0, 5, 9, 11, 20, 21, 22, 40)] + [(None, 3), (None, 30), ("z", None)]
    out = linking.link_events(spark.createDataFrame(rows, "k string, t long"), ["k"], "t", 10)
    got = sorted(((r["k"], r["t"], r["anchor"]) for r in out.collect()), key=repr)
    want = [("k", 0, 0), ("k", 5, 0), ("k", 9, 0), ("k", 11, 11), ("k", 20, 11), ("k", 21, 11), ("k", 22, 22), ("k", 40, 40), (None, 3, 3), (None, 30, 30), ("z", None, None)]
    assert got == sorted(want, key=repr)


def test_overlaps_match_the_plain_join(spark):
    rows = [(i, i * 37 % 100, i * 37 % 100 + i * 13 % 29) for i in range(60)]
    got = {(r["a"], r["b"], r["overlap"]) for r in intervals.overlaps(spark.createDataFrame(rows, "id long, s long, e long"), "id", "s", "e", 7).collect()}
    want = {(a, b, min(f, h) - max(e, g)) for a, e, f in rows for b, g, h in rows if a < b and e < f and g < h and e < h and g < f}
    assert got == want


@pytest.mark.parametrize("paths", [None, 1])
def test_paths(spark, paths):
    nodes = spark.createDataFrame([(x,) for x in "a b c d self x y root".split()], "id string")
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "root"), ("c", "root"), ("d", "gone"), ("self", "self"), ("x", "y"), ("y", "x")], "id string, parent_id string")
    got = {}
    for r in graph.parent_paths(nodes, edges, "root", paths=paths).collect():
        got.setdefault(r["id"], []).append(("/".join(r["path"]), r["end"]))
    assert sorted(got["a"]) == [("a/b/root", "my_drive"), ("a/c/root", "my_drive")][: paths or 2]
    assert got["d"] == [("d/gone", "unresolved_parent")] and got["self"] == [("self", "cycle")]
    assert got["x"] == [("x/y", "cycle")] and got["root"] == [("root", "my_drive")]


def test_depth_limit(spark):
    n = 6
    nodes = spark.createDataFrame([(str(i),) for i in range(n)], "id string")
    edges = spark.createDataFrame([(str(i), str(i + 1)) for i in range(n - 1)], "id string, parent_id string")
    ends = {r["id"]: r["end"] for r in graph.parent_paths(nodes, edges, None, depth=3).collect()}
    assert ends["0"] == "depth_limit" and ends["4"] == "orphan"


def test_entities(spark):
    rows = [
        ('"Ann Lee" <ann@gmail.com>', "unknown", 1), ("Shop <no-reply@orders.shop.com>", "human", 1), ("Pat van Dam <pat@firm.co.uk>", "human", 2),
        ("Pat van Dam <pat@firm.co.uk>", "human", 9), ("Bluebird Ltd <x-blue@mailer.com>", "unknown", 1), ("me@own.org", "unknown", 1), ("nobody", "unknown", 1),
    ]
    df = spark.createDataFrame(rows, "raw string, cls string, n int")
    e = fx.entity_of(F.col("raw"), F.col("cls"), F.col("n"), own=("me@own.org",), platforms=("mailer.com",), streams={"shop.com": {"orders.": "orders"}})
    got = [(r["e"]["key"], r["e"]["kind"]) for r in df.select(e.alias("e")).collect()]
    assert got == [("person:ann@gmail.com", "person"), ("merchant:shop.com#orders", "merchant"), ("person:pat@firm.co.uk", "person"), ("merchant:firm.co.uk", "merchant"), ("merchant:bluebird-ltd", "merchant"), ("self:me@own.org", "self"), ("unknown", "unknown")]


def test_canonical_names(spark):
    known = spark.createDataFrame([("leite", "milk"), ("milk", "milk"), ("leite coco", "coconut milk"), ("limao", "lime"), ("castanha para", "brazil nut")], "spelling string, canonical string")
    rows = ["Leite", "MILK 2kg", "leite de coco", "limões", "castanha do pará", "castanha", "goiabada cascão", "!!!", None]
    out = names.canonical(spark.createDataFrame([(r,) for r in rows], "name string"), "name", known)
    got = {r["name"]: r["canonical"] for r in out.collect()}
    assert got == {"Leite": "milk", "MILK 2kg": "milk", "leite de coco": "coconut milk", "limões": "lime", "castanha do pará": "brazil nut", "castanha": "castanha", "goiabada cascão": "goiabada cascao", "!!!": "!!!", None: None}


def test_search(spark):
    docs = spark.createDataFrame([(1, "Café lease agreement"), (2, "lease of a car, a lease"), (3, "cafeteria leasing"), (4, None)], "id long, text string")
    index = search.postings(docs, "id", "text").cache()
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(search.match_all(index, search.query_tokens('"CAFE" AND* lease')[::2])) == [1]
    assert {(r["id"], r["step"]) for r in search.widened(index, ["cafe", "lease"]).collect()} == {(1, 1)}
    assert {(r["id"], r["step"]) for r in search.widened(index, ["cafet", "leas"]).collect()} == {(3, 2)}
    assert {(r["id"], r["step"]) for r in search.widened(index, ["car", "cafet"]).collect()} == {(2, 3), (3, 3)}
    best = search.ranked(index, ["lease"]).orderBy(F.desc("score")).collect()
    assert [r["id"] for r in best] == [2, 1]
    new = search.refreshed(index, spark.createDataFrame([(1, "gone")], "id long, text string"), "id", "text", spark.createDataFrame([(2,)], "id long"))
    assert ids(new.select("id").distinct()) == [1, 3]
    s = docs.where("id = 2").select(search.snippet(F.col("text"), ["car"], 4).alias("s")).first()["s"]
    assert "[car,]" in s and s.startswith("… ")


def test_incremental_equals_full_for_any_runs(spark):
    rows = [(i, i * 10, f"r{i}") for i in range(20)]
    late = (50, 15, "late")
    extract = lambda df: df.select("id", "body")
    make = lambda r: spark.createDataFrame(r, "id long, synced long, body string")
    first = make(rows[:12])
    state = extract(first)
    second = make([r for r in rows if r[0] != 3] + [late])
    got = incremental.incremental_run(second, state, first.select("id"), "id", "synced", 110, extract)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, extract(second).collect()))


def test_upkeep(spark):
    stored = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id long, v string, ver int")
    new = spark.createDataFrame([(2, "c", 2), (2, "d", 3), (3, "e", 1)], "id long, v string, ver int")
    assert sorted(map(tuple, upkeep.upsert(stored, new, ["id"], F.desc("ver")).collect())) == [(1, "a", 1), (2, "d", 3), (3, "e", 1)]
    assert sorted(map(tuple, upkeep.insert_missing(stored, new, ["id"], F.desc("ver")).collect())) == [(1, "a", 1), (2, "b", 1), (3, "e", 1)]
    m = upkeep.merged(stored.unionByName(new), ["id"], {"v": "last", "ver": "sum"}, "ver")
    assert sorted(map(tuple, m.collect())) == [(1, "a", 1), (2, "d", 6), (3, "e", 1)]
    t = spark.createDataFrame([(1, None), (2, 5), (3, None)], "id long, deleted_at long")
    assert sorted(map(tuple, upkeep.tombstoned(t, t.where("id < 3"), ["id"], F.lit(9)).collect()), key=repr) == [(1, None), (2, None), (3, 9)]
    rows, kids = upkeep.rekeyed(spark.createDataFrame([(1, "x", 2), (5, "x", 7), (9, "y", 1)], "id long, k string, q int"), spark.createDataFrame([(5, "c"), (9, "d")], "ref long, n string"), "id", ["k"], "ref", {"q": "max"}, "q")
    assert sorted(map(tuple, rows.select("id", "k", "q").collect())) == [(1, "x", 7), (9, "y", 1)]
    assert sorted(map(tuple, kids.collect())) == [(1, "c"), (9, "d")]


def test_rules_and_access(spark):
    base = spark.createDataFrame([(1, 100), (2, 100), (3, 5)], "id long, ts long")
    yes = spark.createDataFrame([(1,)], "id long")
    out = rules.three_valued(base, "id", yes, yes.where("false"), F.col("ts") >= 50)
    assert {r["id"]: r["state"] for r in out.collect()} == {1: "yes", 2: "no", 3: "unknown"}
    pairs = spark.createDataFrame([("x", "x", 0.95), ("x", "y", 1.0), ("y", "y", 0.12)], "a string, b string, c double")
    assert {(r["decile"], r["n"], r["agreed"]) for r in measures.calibration(pairs, "c", F.col("a") == F.col("b")).collect()} == {(9, 2, 1), (1, 1, 1)}


def test_ranked_share_of_text_keys(spark):
    rows = [(f"k{i % 40:02d}{chr(97 + i % 26)}", 1 + i % 23) for i in range(40)]
    want, cum = [], 0
    for r, (k, n) in enumerate(sorted(rows, key=lambda x: (-x[1], x[0])), 1):
        cum += n
        want.append((k, r, cum))
    got = measures.ranked_share(spark.createDataFrame(rows, "k string, n long"), "k", "n")
    assert sorted((r["k"], r["rank"], r["cum"]) for r in got.collect()) == sorted(want)
    curve = {r["mark"]: r["n"] for r in measures.coverage_curve(got).collect()}
    assert curve[0.5] == next(r for _, r, c in want if c / cum >= 0.5)


def test_sizes_stop_at_the_largest_unit(spark):
    df = spark.createDataFrame([(5,), (2048,), (3 * 2**20,), (5 * 2**30,), (None,)], "n long")
    got = [tuple(r) for r in df.select(fx.size_text(F.col("n"), "MB"), fx.size_text(F.col("n"))).collect()]
    assert got == [("5 B", "5 B"), ("2.0 KB", "2.0 KB"), ("3.0 MB", "3.0 MB"), ("5120.0 MB", "5.0 GB"), (None, None)]


def test_blanks_part_the_words_of_utterances(spark):
    texts = [None, "", "x" * 25 + " y", "one\ttwo " + "y" * 20, "a   " + "x" * 30, "word\n" * 5, "this is a fair text for it"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").orderBy("i")
    assert [r[0] for r in df.select(fx.unusable(F.col("t"))).collect()] == ["ok", "short", "few words", "few words", "ok", "few words", "ok"]
