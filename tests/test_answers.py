"""Calendar evidence and look-ups, quoted replies, largest events: nulls, ties, repeated rows, empty tables."""

import datetime as dt
import itertools
import re

from pyspark.sql import functions as F

from brinewell import api
from brinewell.functions.text import own_reply
from brinewell.operators import intervals, linking, measures, search

DAY = dt.date(2024, 1, 10)
MIDNIGHT = 1704855600  # 2024-01-10 in Sao Paulo
PROBE = "who string, probe string, start long, end long, day date, title string"
ENTRY = "who string, instance string, start_kind string, start_utc long, end_utc long, start_date date, status string, response string, summary string"


def test_calendar_evidence(spark):
    t = MIDNIGHT + 50_000
    probes = spark.createDataFrame(
        [("u", "timed", t, t + 7200, None, "Dentist"), ("u", "open", t, None, None, None), ("u", "day", None, None, DAY, None), ("u", "both", t, None, DAY, None), ("u", "neither", None, None, None, None), ("v", "other", t, None, None, None), (None, "nobody", t, None, None, None)], PROBE
    )
    rows = [
        ("u", "same", "timed", t, t + 60, None, "confirmed", None, "dentist visit"),
        ("u", "near", "timed", t - 1800, t - 1700, None, "confirmed", "declined", "Dentist"),
        ("u", "long", "timed", t - 90_000, t + 10, None, "tentative", None, None),
        ("u", "ended", "timed", t - 90_000, t, None, "confirmed", None, "Dentist"),
        ("u", "later", "timed", t + 3601, None, None, None, None, "x"),
        ("u", "whole", "all_day", None, None, DAY, "confirmed", None, "Dentist"),
        ("u", "next", "all_day", None, None, DAY + dt.timedelta(1), "confirmed", None, "Dentist"),
        ("u", "none", "timed", None, None, None, "confirmed", None, "Dentist"),
    ]
    cal = spark.createDataFrame(rows + [rows[0]], ENTRY)
    got = intervals.calendar_evidence(probes, cal, "America/Sao_Paulo", 3600, keys=["who"])
    by = sorted((r["probe"], r["instance"], r["reason"], r["band"], r["delta"], ",".join(r["caveats"])) for r in got.collect())
    same, near, whole = "exact_start", "within_tolerance", "same_day"
    assert by == sorted(
        [("timed", "same", same, "high", 0, "title_matched")] * 2
        + [("timed", "near", near, "low", -1800, "declined,title_matched"), ("timed", "long", "overlap", "low", -90_000, "tentative,title_mismatch"), ("timed", "whole", whole, "medium", None, "title_matched")]
        + [("open", "same", same, "high", 0, "")] * 2
        + [("open", "near", near, "low", -1800, "declined"), ("open", "long", "overlap", "medium", -90_000, "tentative"), ("open", "whole", whole, "medium", None, "")]
        + [("day", "same", whole, "medium", None, "")] * 2
        + [("day", "near", whole, "low", None, "declined"), ("day", "later", whole, "medium", None, ""), ("day", "whole", "same_date", "high", None, "")]
    )
    assert {r["band"] for r in intervals.calendar_evidence(probes, cal, stale=True, keys=["who"]).collect()} == {"low"}
    assert intervals.calendar_evidence(probes, cal.limit(0), keys=["who"]).isEmpty() and intervals.calendar_evidence(probes.limit(0), cal).isEmpty()


def test_narrow_stretches_tell_pairs_once(spark):
    probes = spark.createDataFrame([("u", f"p{i}", 1000 * i, 1000 * i + 5000, None, None) for i in range(20)], PROBE)
    cal = spark.createDataFrame([("u", f"c{i}", "timed", 700 * i, 700 * i + 3000, None, "confirmed", None, None) for i in range(30)], ENTRY)
    told = lambda width: sorted(map(tuple, intervals.calendar_evidence(probes, cal, tolerance=900, width=width).select("probe", "instance", "delta").collect()))
    want = sorted((f"p{i}", f"c{k}", 700 * k - 1000 * i) for i in range(20) for k in range(30) if abs(700 * k - 1000 * i) <= 900 or (700 * k < 1000 * i + 5000 and 700 * k + 3000 > 1000 * i))
    assert told(500) == told(86_400) == want


def test_appointments_by_person(spark):
    probes = spark.createDataFrame([("a", 1, 100, "x"), ("b", 2, 100, "x")], "who string, probe long, start long, title string")
    cal = spark.createDataFrame([("a", 7, 100, "confirmed", None, "x"), ("b", 8, 900, None, None, "y")], "who string, instance long, start long, status string, response string, summary string")
    got = intervals.appointment_matches(probes, cal, 1000, keys=["who"]).collect()
    assert sorted((r["probe"], r["event"], r["band"]) for r in got) == [(1, 7, "high"), (2, 8, "medium")]
    assert intervals.appointment_matches(probes, cal, 1000).count() == 4


def test_appointment_pairs_are_not_dealt_out_again(spark):
    probes = spark.createDataFrame([(1, 100, "Big x")], "probe long, start long, title string")
    cal = spark.createDataFrame([(7, 100, "cancelled", None, "an X"), (8, 900, None, "declined", "y")], "instance long, start long, status string, response string, summary string")
    got = intervals.appointment_matches(probes, cal, 1000)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    assert sorted(map(tuple, got.collect())) == [(1, 7, 0, "exact_start", "low", ["cancelled", "title_matched"]), (1, 8, 800, "within_tolerance", "low", ["declined", "title_mismatch"])]


def test_appointment_pairs_are_dealt_out_and_judged_without_lists(spark):
    statuses, responses = (None, "cancelled", "tentative", "confirmed"), (None, "declined", "accepted")
    titles, summaries = (None, "", "One", "two words", "é-X x"), (None, "", "one two", "WORDS", "x", "none of these")
    probes = spark.createDataFrame([(i, 1000 + 700 * i, t) for i, t in enumerate(titles)], "probe long, start long, title string")
    entries = [(i, 200 + 37 * i, *e) for i, e in enumerate(itertools.product(statuses, responses, summaries))]
    cal = spark.createDataFrame(entries, "instance long, start long, status string, response string, summary string")
    words = lambda text: {w for w in re.split(r"[\W_]+", (text or "").lower()) if w}

    def plain(stale):
        for (p, title), (i, start, status, response, summary) in itertools.product(enumerate(titles), entries):
            delta, hinted, matched = start - 1000 - 700 * p, bool(words(title)), bool(words(title) & words(summary))
            if abs(delta) > 1000:
                continue
            capped = stale or status == "cancelled" or response == "declined"
            level = 0 if capped else max(0, (2 if abs(delta) <= 900 else 1) - (hinted and not matched))
            told = [status] * (status in ("cancelled", "tentative")) + ["declined"] * (response == "declined") + [["title_mismatch", "title_matched"][matched]] * hinted + ["stale_index"] * stale
            yield p, i, delta, "within_tolerance" if delta else "exact_start", ["low", "medium", "high"][level], told

    for stale in (False, True):
        got = intervals.appointment_matches(probes, cal, 1000, stale)
        assert sorted(map(tuple, got.collect())) == sorted(plain(stale))
        texts = intervals.appointment_matches(probes, cal, 1000, stale, joined=",")
        assert sorted(map(tuple, texts.collect())) == sorted((*r[:-1], ",".join(r[-1])) for r in plain(stale))
    # as many tasks whatever the tables' size, and nothing interpreted on pairs
    assert texts.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    above = texts._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert "lambda" not in above and "array_join" not in above


def test_calendar_look_ups(spark):
    rows = [("c", "e", "i1", 10, "Team lunch", "confirmed", None), ("c", "e", "i2", 20, "Team lunch", "cancelled", None), ("d", "f", "i3", 20, "Lunch team", None, "declined"), ("d", "f", "i4", 20, None, "confirmed", None)]
    o = spark.createDataFrame(rows, "calendar_id string, event_id string, instance_id string, order_ts long, summary string, status string, self_response_status string")
    index = search.postings(o, "instance_id", "summary")
    ids = lambda r: [x["instance_id"] for x in r.rows]
    o2 = o.withColumn("status", F.coalesce("status", F.lit("confirmed")))
    assert ids(api.calendar_search(o2, index, "lunch")) == ["i3", "i1"]
    assert ids(api.calendar_search(o2, index, "lunch", declined=False, cancelled=True)) == ["i2", "i1"]
    assert ids(api.calendar_search(o2, index, '"', until=15)) == ["i1"] and api.calendar_search(o2, index, "", limit=1).truncated
    attendees = spark.createDataFrame([("c", "e", "b@x"), ("c", "e", "a@x"), ("d", "e", "z@x")], "calendar_id string, event_id string, email string")
    r = api.calendar_event(o.select("calendar_id", "event_id").distinct(), o, attendees, "e", "c")
    assert len(r["event"].rows) == 1 and [x["email"] for x in r["attendees"].rows] == ["a@x", "b@x"] and ids(r["occurrences"]) == ["i1", "i2"]
    assert not api.calendar_event(o, o, attendees, "none")["event"].rows


def test_own_reply(spark):
    sig = "Yes.\nSee you\n-- \nAnn\n+55 11 98765-4321"
    bodies = {
        sig: "Yes.\nSee you",
        "ok\n> quoted\nmore\n>> deep": "ok\nmore",
        "ok\r\nOn Mon, Jan 5, 2026 at 10:00 AM\r\nAnn <a@b.c> wrote:\r\n> x": "ok",
        "certo\nEm seg., 5 de jan., Ann escreveu:\nx": "certo",
        "a\nFrom: B\nSent: today\nx": "a",
        "On time as ever, he wrote: no": "On time as ever, he wrote: no",
        "a\n----\nb": "a\n----\nb",
        "": "",
        None: None,
    }
    df = spark.createDataFrame([(k, v) for k, v in bodies.items()], "body string, want string").withColumn("got", own_reply(F.col("body")))
    assert df.where("NOT (got <=> want)").isEmpty()
    assert spark.createDataFrame([("<p>hi</p>\n-- \nx",)], "b string").select(own_reply(F.col("b"), F.lit(True))).first()[0] == "hi"


def test_largest_events(spark):
    rows = [(u, e, i) for u, e, n in (("a", 1, 3), ("a", 2, 3), ("b", 3, 2), (None, 4, 4), ("c", 5, 3)) for i in range(n)]
    df = spark.createDataFrame(rows, "user string, event long, id long")
    got = linking.largest_events(df, ["user"], ["user", "event"], 3, F.col("id")).collect()
    assert {(r["user"], r["event"]) for r in got} == {("a", 1), (None, 4), ("c", 5)} and len(got) == 10
    assert sorted(r["id"] for r in got if r["is_primary"]) == [0, 0, 0]
    assert linking.largest_events(df.limit(0), ["user"], ["user", "event"], 3, F.col("id")).isEmpty()


def test_ranked_share_of_keys_that_begin_alike(spark):
    rows = [(f"user-{i:05d}", 1 + i % 2) for i in range(3000)] + [(None, 1)]
    got = sorted((r["rank"], r["k"], r["cum"]) for r in measures.ranked_share(spark.createDataFrame(rows, "k string, n long"), "k", "n").collect())
    order = sorted(rows, key=lambda x: (-x[1], x[0] is not None, x[0] or ""))
    assert [k for _, k, _ in got] == [k for k, _ in order] and [r for r, _, _ in got] == list(range(1, 3002))
    assert got[-1][2] == sum(n for _, n in rows)


def test_skip_counts(spark):
    df = spark.createDataFrame([(1, ["a", "a", None]), (1, []), (2, ["a"]), (3, None)], "u long, s array<string>")
    assert sorted(map(tuple, measures.skip_counts(df, "s", "u").collect()), key=repr) == [("a", 3, 2), (None, 1, 1)]
