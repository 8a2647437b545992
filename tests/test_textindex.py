"""The kept full-text index: what upkeep changes, what it leaves, and what a search reads."""

import pytest
from pyspark.sql import functions as F

from brinewell.operators import search, textindex

DOCS = [(1, "Lease of the Flat"), (2, "lease lease café"), (3, None), (4, ""), (5, "a leasing contract"), (6, "Lease"), (6, "second text of six"), (None, "lost lease")]


def docs(spark, rows):
    return spark.createDataFrame(rows, "id long, text string")


def held(index):
    return sorted(tuple(r) for r in index.postings().select("token", "id", "tf", "size").collect())


def fresh(spark, rows, path):
    return textindex.built(docs(spark, rows), "id", "text", path)


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}/index"


def test_postings(spark, path):
    index = fresh(spark, DOCS, path)
    plain = {(r["token"], r["id"]): r["tf"] for r in search.postings(docs(spark, [r for r in DOCS if r[0] is not None]), "id", "text").collect()}
    assert {(t, i): n for t, i, n, _ in held(index)} == plain
    assert {i: s for _, i, _, s in held(index)} == {1: 4, 2: 3, 5: 3, 6: 5}
    assert index.totals() == (4, 15)
    assert textindex.opened(spark, path).postings(["lease"]).count() == 3
    assert sorted({r["token"] for r in index.postings(["leas"], prefix=True).collect()}) == ["lease", "leasing"]
    assert {r["token"] for r in index.postings(["a"], prefix=True).collect()} == {"a"}
    assert index.postings([]).count() == 0
    assert textindex.opened(spark, path + "-none") is None


def test_upkeep_equals_a_new_index(spark, path):
    states = [
        DOCS,
        [(1, "Lease of the Flat"), (2, "changed"), (3, "now some text"), (6, "Lease"), (7, "a new lease")],  # changed, filled, of two rows one, gone, new
        [(1, "Lease of the Flat"), (2, "lease lease café"), (7, "a new lease")],  # back to an earlier text
        [],
        [(1, "after nothing")],
    ]
    index = fresh(spark, states[0], path)
    for k, rows in enumerate(states[1:], 1):
        index = textindex.synced(index, docs(spark, rows), "id", "text", f"s{k}")
        new = fresh(spark, rows, f"{path}-{k}")
        assert held(index) == held(new) and index.totals() == new.totals()
        assert textindex.opened(spark, path).stamp == f"s{k}" and len(index.segments) == k + 1
    whole = index.compacted()
    assert len(whole.segments) == 1 and held(whole) == held(index) and whole.totals() == index.totals()


def test_only_changed_documents_are_written(spark, path):
    rows = [(i, f"words {i} and more") for i in range(200)]
    index = fresh(spark, rows, path)
    index = textindex.synced(index, docs(spark, [*rows[:199], (199, "other")]), "id", "text")
    assert spark.read.parquet(f"{path}/{index.segments[1]}/marks").count() == 1
    assert [r["id"] for r in spark.read.parquet(f"{path}/{index.segments[1]}/dead").collect()] == [199]


def test_a_search_reads_the_folders_of_its_tokens(spark, path):
    index = fresh(spark, DOCS, path)
    plan = index.postings(["lease"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan or "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "EqualTo(token,lease)" in plan


def test_rank_with_kept_sizes(spark, path):
    index = fresh(spark, DOCS, path)
    a = {r["id"]: r["score"] for r in search.ranked(index.postings(["lease", "flat"]), ["lease", "flat"], totals=index.totals()).collect()}
    b = {r["id"]: r["score"] for r in search.ranked(search.postings(docs(spark, [r for r in DOCS if r[0] is not None]), "id", "text"), ["lease", "flat"]).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-12 for k in a)


def test_counts_of_a_document_in_its_row(spark):
    docs = spark.createDataFrame([(1, "b a b"), (1, "a c Σ"), (2, None), (3, "é e"), (4, "!")], "d long, t string")
    got = docs.groupBy("d").agg(F.concat_ws("\n", F.collect_list("t")).alias("t")).select("d", textindex._counts(search.tokens(F.col("t"))).alias("c")).orderBy("d").select("c.size", "c.tfs").collect()
    assert [(r["size"], [tuple(x) for x in r["tfs"]]) for r in got] == [(6, [("a", 2), ("b", 2), ("c", 1), ("σ", 1)]), (0, []), (2, [("e", 2)]), (0, [])]


def test_few_ids_go_to_the_rows(spark, monkeypatch):
    docs, ids = spark.range(10).withColumnRenamed("id", "d"), spark.range(3, 20, 4).withColumnRenamed("id", "d")
    assert sorted(r[0] for r in textindex.wanted_rows(docs, ids, "d").collect()) == [3, 7]
    monkeypatch.setattr(textindex, "FEW", 2)
    assert sorted(r[0] for r in textindex.wanted_rows(docs, ids, "d").collect()) == [3, 7]


def test_an_index_moves_each_text_and_each_posting_once(spark, tmp_path):
    jvm, sc = spark._jvm, spark.sparkContext

    def records():
        s = sc._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(s.apply(i).shuffleWriteRecords() for i in range(s.size()))

    before = records()
    docs = spark.range(400).selectExpr("id d", "array_join(transform(sequence(1, 500), x -> concat('w', (x * 31 + id) % 900)), ' ') t")
    index = textindex.built(docs, "d", "t", f"file://{tmp_path}/i")
    assert index.totals() == (400, 200_000)
    n = index.postings().count()
    assert records() - before < 1.2 * n
