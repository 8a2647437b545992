"""Query functions on small tables."""

import pytest
from pyspark.sql import functions as F

from brinewell import api
from brinewell.operators import census, search


@pytest.fixture(scope="module")
def mail(spark):
    rows = [(f"m{i}", f"t{i % 3}", 1000 + i, f"a{i % 2}@shop.com", ["INBOX", "IMPORTANT"] if i % 2 else ["INBOX"], f"order number {i} shipped" if i % 2 else "hello", 2000, 5 if i == 9 else None) for i in range(12)]
    df = spark.createDataFrame(rows, "message_id string, thread_id string, internal_ts long, from_addr string, labels array<string>, subject string, synced_at long, deleted_at long").cache()
    return df, search.postings(df, "message_id", "subject").cache()


def test_messages(mail):
    df, index = mail
    r = api.search_messages(df, index, "Order shipped", sender="A1@", labels=["IMPORTANT"], since=1002, limit=2, now=2100)
    assert [x["message_id"] for x in r.rows] == ["m11", "m7"] and r.truncated and not r.freshness["is_stale"]
    assert not api.search_messages(df, index, "order", until=1002).truncated
    assert [x["message_id"] for x in api.thread(df, "t0").rows] == ["m0", "m3", "m6"]
    assert len(api.search_messages(df, index, "", limit=10_000).rows) == 11


def test_calendar(spark):
    rows = [("c", "i1", "timed", 100, 200, 100, None), ("c", "i2", "timed", 150, 160, 150, None), ("c", "i3", "timed", 150, 170, 150, "declined"), ("d", "i4", "all_day", None, None, 0, None)]
    df = spark.createDataFrame(rows, "calendar_id string, instance_id string, start_kind string, start_utc long, end_utc long, order_ts long, self_response_status string").withColumns({"status": F.lit("confirmed"), "transparency": F.lit(None).cast("string"), "start_date": F.lit("2026-01-01").cast("date"), "end_date": F.lit("2026-01-01").cast("date")})
    assert [(r["a"], r["b"], r["overlap"]) for r in api.conflicts(df, 140, 500).rows] == [("i1", "i2", 10)]
    day = api.agenda(df, 0, 1000).rows
    assert [r["instance_id"] for r in day] == ["i4", "i1", "i2", "i3"] and day[0]["start_utc"] is None and day[1]["start_date"] is None
    assert len(api.agenda(df, 0, 1000, ["d"]).rows) == 1


def test_entities_and_documents(spark):
    tx = spark.createDataFrame([("Acme", "USD", "order", 5.0, "2026-01-01", "m1"), ("Acme", "BRL", "order", 7.0, "2026-01-02", "m2")], "entity_name string, currency string, kind string, amount double, date string, message_id string")
    out = api.entity(tx, "acm")
    assert [(r["currency"], r["total"]) for r in out["totals"].rows] == [("BRL", 7.0), ("USD", 5.0)]
    assert [r["entity_name"] for r in api.entity(tx, "acmo")["did_you_mean"].rows] == ["Acme"]
    docs = spark.createDataFrame([(1, "lease of house", "contract", 1), (2, "a lease, lease", "note", 3)], "doc_id long, text string, doc_type string, tier int").withColumn("sha256", F.sha2("text", 256))
    found = api.catalog_search(docs, search.postings(docs, "doc_id", "text"), "lease")
    assert [(r["doc_id"], r["text"]) for r in found.rows] == [(2, "a lease, lease"), (1, None)]
    sha = docs.first()["sha256"]
    assert api.document(docs, sha[:8]).rows[0]["doc_id"] == 1
    with pytest.raises(ValueError, match="eight"):
        api.document(docs, "abc")


def test_actors(spark):
    people = spark.createDataFrame([(1, "15551234567", "Ann Lee"), (2, "15559876543", "Ann Ray"), (3, "4471", "Bo")], "person_id int, phone string, name string")
    asks = spark.createDataFrame([(a,) for a in ("2", "4567", "ann ray", "Ann", "bo", "zed")], "ask string")
    got = {r["ask"]: (r["person_id"], r["matched"]) for r in census.resolved_actor(people, asks).collect()}
    assert got == {"2": (2, "id"), "4567": (1, "phone"), "ann ray": (2, "name"), "Ann": (None, None), "bo": (3, "name"), "zed": (None, None)}
