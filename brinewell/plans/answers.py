"""What the query functions answer: bounded rows with a flag of more, over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brinewell import api
from brinewell.functions.text import summary_key
from brinewell.operators import rules, upkeep
from brinewell.plans.catalog import TOKENS, TYPED, _classified, kept_index
from brinewell.plans.registry import query
from brinewell.session import table


def _told(spark, result: api.Result, like: DataFrame, *columns: str) -> DataFrame:
    """An answer's rows as a table again, with the flag of more."""
    slim = like.select(*columns)
    return spark.createDataFrame([tuple(r[c] for c in columns) for r in result.rows], slim.schema).withColumn("truncated", F.lit(result.truncated))


MAIL = "m AS (SELECT doc_id AS message_id, doc_id * 7919 % 100003 AS internal_ts, source AS from_addr, lang, doc_id % 11 = 0 AS gone FROM documents)"


def _mail(spark, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(k.alias("message_id"), (k * 7919 % 100003).alias("internal_ts"), F.col("source").alias("from_addr"), F.array("lang").alias("labels"), F.when(k % 11 == 0, F.lit(1)).alias("deleted_at"), (k % 7).cast("string").alias("thread_id"))


@query(f"""WITH {TOKENS}, {MAIL}, f AS (SELECT * FROM m WHERE NOT gone AND internal_ts >= 5000 AND internal_ts < 90000 AND contains(lower(from_addr), 'src1') AND lang = 'en'
  AND message_id IN (SELECT doc_id FROM tok WHERE token IN ('the', 'tion') GROUP BY doc_id HAVING count(DISTINCT token) = 2))
SELECT message_id, internal_ts, (SELECT count(*) FROM f) > 25 AS truncated FROM f ORDER BY internal_ts DESC, message_id LIMIT 25""")
def mail_search(spark, sf_dir):  # P-10, F-01, F-02, F-10, S-02, T-06
    m = _mail(spark, sf_dir)
    r = api.search_messages(m, kept_index(spark, sf_dir).postings(["the", "tion"]), "the +tion", sender="SRC1", labels=["en"], since=5000, until=90000, limit=25)
    return _told(spark, r, m, "message_id", "internal_ts")


@query(f"WITH {MAIL} SELECT message_id, internal_ts, (SELECT count(*) FROM m WHERE NOT gone AND message_id % 7 = 3) > 100 AS truncated FROM m WHERE NOT gone AND message_id % 7 = 3 ORDER BY internal_ts, message_id LIMIT 100")
def mail_thread(spark, sf_dir):  # P-10
    m = _mail(spark, sf_dir)
    return _told(spark, api.thread(m, "3", limit=10_000), m, "message_id", "internal_ts")


CALENDAR = "o AS (SELECT user_id % 5 AS calendar_id, event_id AS instance_id, event_id % 4 > 0 AS timed, epoch_us(ts) // 1000000 AS order_ts, ts::DATE AS day FROM events)"


@query(f"""WITH {CALENDAR}, f AS (SELECT * FROM o WHERE calendar_id IN (1, 2) AND order_ts >= 1704700000 AND order_ts < 1704900000)
SELECT instance_id, CASE WHEN timed THEN order_ts END AS start_utc, CASE WHEN NOT timed THEN day END AS start_date, (SELECT count(*) FROM f) > 50 AS truncated FROM f ORDER BY order_ts, instance_id LIMIT 50""")
def calendar_agenda(spark, sf_dir):  # P-11, F-14
    k, s = F.col("event_id"), F.unix_seconds(F.col("ts").cast("timestamp"))
    o = table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("calendar_id"), k.alias("instance_id"), F.when(k % 4 > 0, "timed").otherwise("all_day").alias("start_kind"), s.alias("order_ts"), s.alias("start_utc"), (s + 60).alias("end_utc"), F.col("ts").cast("date").alias("start_date"), F.col("ts").cast("date").alias("end_date"))
    return _told(spark, api.agenda(o, 1704700000, 1704900000, [1, 2]), o, "instance_id", "start_utc", "start_date")


OCCURRENCE = "o AS (SELECT user_id % 5 AS calendar_id, user_id AS event_id, event_id AS instance_id, epoch_us(ts) // 1000000 AS order_ts, event_type, CASE WHEN event_id % 9 = 0 THEN 'cancelled' ELSE 'confirmed' END AS status, event_id % 8 = 0 AS declined FROM events)"


def _calendar(spark, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    status = F.when(k % 9 == 0, "cancelled").otherwise("confirmed")
    return table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("calendar_id"), F.col("user_id").alias("event_id"), k.alias("instance_id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("order_ts"), F.concat(F.lit("Team "), "event_type").alias("summary"), status.alias("status"), F.when(k % 8 == 0, "declined").alias("self_response_status"))


@query(f"""WITH {OCCURRENCE}, f AS (SELECT * FROM o WHERE event_type = 'purchase' AND calendar_id IN (1, 2) AND status <> 'cancelled' AND NOT declined AND order_ts >= 1704500000)
SELECT instance_id, order_ts, (SELECT count(*) FROM f) > 30 AS truncated FROM f ORDER BY order_ts DESC, instance_id LIMIT 30""")
def calendar_search(spark, sf_dir):  # P-11
    from brinewell.operators.search import postings

    o = _calendar(spark, sf_dir)
    r = api.calendar_search(o, postings(o, "instance_id", "summary"), "PURCHASE team*", since=1704500000, calendars=[1, 2], declined=False, limit=30)
    return _told(spark, r, o, "instance_id", "order_ts")


@query(f"""WITH {OCCURRENCE} SELECT 'event' AS part, c_custkey % 5 AS a, 'RRULE:FREQ=DAILY;COUNT=' || c_nationkey AS b FROM customer WHERE c_custkey = 11
UNION ALL SELECT 'attendee', o_orderkey, o_orderstatus FROM (SELECT * FROM orders WHERE o_custkey = 11 ORDER BY o_orderkey LIMIT 100)
UNION ALL SELECT 'occurrence', instance_id, status FROM (SELECT * FROM o WHERE event_id = 11 ORDER BY order_ts, instance_id LIMIT 100)""")
def calendar_event(spark, sf_dir):  # P-11: a series, who attends it, its occurrences
    c = table(spark, sf_dir, "customer")
    series = c.select((F.col("c_custkey") % 5).alias("calendar_id"), F.col("c_custkey").alias("event_id"), F.concat(F.lit("RRULE:FREQ=DAILY;COUNT="), "c_nationkey").alias("recurrence"))
    attends = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 5).alias("calendar_id"), F.col("o_custkey").alias("event_id"), F.col("o_orderkey").alias("email"), F.col("o_orderstatus").alias("response"))
    r = api.calendar_event(series, _calendar(spark, sf_dir), attends, 11, 1)
    rows = [("event", x["calendar_id"], x["recurrence"]) for x in r["event"].rows]
    rows += [("attendee", x["email"], x["response"]) for x in r["attendees"].rows]
    rows += [("occurrence", x["instance_id"], x["status"]) for x in r["occurrences"].rows]
    return spark.createDataFrame(rows, "part string, a long, b string")


@query(f"""WITH {OCCURRENCE} SELECT (SELECT count(*) FROM supplier WHERE s_acctbal > 0 AND s_suppkey % 6 > 0) AS calendars, (SELECT count(*) FROM customer WHERE c_custkey % 10 > 0) AS events, (SELECT count(*) FROM customer WHERE c_custkey % 10 > 0 AND c_custkey % 3 = 0) AS series,
count(*) AS instances, count(*) FILTER (status = 'cancelled') AS cancelled, (SELECT arg_max(o_orderkey, (o_orderdate, o_orderkey)) FROM orders) AS last_run, (SELECT arg_max(o_orderstatus, (o_orderdate, o_orderkey)) FROM orders) AS last_status FROM o""")
def calendar_status(spark, sf_dir):  # P-11
    gone = lambda c: F.when(c, F.lit(1)).alias("deleted_at")
    calendars = table(spark, sf_dir, "supplier").select((F.col("s_acctbal") > 0).alias("selected"), gone(F.col("s_suppkey") % 6 == 0))
    k = F.col("c_custkey")
    series = table(spark, sf_dir, "customer").select(F.when(k % 3 == 0, "series").otherwise("single").alias("kind"), gone(k % 10 == 0))
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("started_at"))
    r = api.calendar_status(calendars, series, _calendar(spark, sf_dir), runs)
    return r.withColumns({"last_status": F.col("last_run.status"), "last_run": F.col("last_run.run_id")})


PAID = "p AS (SELECT c_name AS entity_name, CASE WHEN c_custkey % 2 = 0 THEN 'USD' ELSE 'BRL' END AS currency, o_orderstatus AS kind, CAST(round(CAST(o_totalprice AS DECIMAL(18,2)) * 100) AS BIGINT) AS amount, strftime(o_orderdate, '%Y-%m-%d') AS date, o_orderkey AS message_id FROM orders JOIN customer ON o_custkey = c_custkey)"


def _paid(spark, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    o = table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    return o.select(F.col("c_name").alias("entity_name"), F.when(F.col("c_custkey") % 2 == 0, "USD").otherwise("BRL").alias("currency"), F.col("o_orderstatus").alias("kind"), (F.col("o_totalprice").cast("decimal(18,2)") * 100).cast("long").alias("amount"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.col("o_orderkey").alias("message_id"))


@query(f"""WITH {PAID}, f AS (SELECT * FROM p WHERE contains(lower(entity_name), '11') AND date >= '1995-01-01')
SELECT 'total' AS part, currency AS a, kind AS b, count(*) AS n, sum(amount)::BIGINT AS amount FROM f GROUP BY currency, kind
UNION ALL SELECT 'row', entity_name, date, message_id, amount FROM (SELECT * FROM f ORDER BY date DESC, message_id LIMIT 20)
UNION ALL SELECT 'near', entity_name, NULL, d, NULL FROM (SELECT DISTINCT entity_name, levenshtein(lower(entity_name), 'custmer#000000042') AS d FROM p ORDER BY d, entity_name LIMIT 5)""")
def ledger_entity(spark, sf_dir):  # P-13, P-18
    p = _paid(spark, sf_dir)
    found, near = api.entity(p, "11", since="1995-01-01"), api.entity(p, "Custmer#000000042")
    rows = [("total", r["currency"], r["kind"], r["n"], r["total"]) for r in found["totals"].rows]
    rows += [("row", r["entity_name"], r["date"], r["message_id"], r["amount"]) for r in found["rows"].rows]
    rows += [("near", r["entity_name"], None, r["distance"], None) for r in near["did_you_mean"].rows]
    return spark.createDataFrame(rows, "part string, a string, b string, n long, amount long")


@query(f"""WITH {PAID}, g AS (SELECT entity_name, kind, count(*) AS charges, sum(amount)::BIGINT AS billed, max(date) AS last_charge FROM p WHERE date >= (SELECT strftime(max(date)::DATE - INTERVAL 12 MONTH, '%Y-%m-%d') FROM p) GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT entity_name, kind, charges, billed, last_charge FROM g ORDER BY charges DESC, entity_name, kind LIMIT 15""")
def subscriptions(spark, sf_dir):  # P-18: charged at least twice in the last twelve months
    p = _paid(spark, sf_dir)
    last = p.agg(F.date_format(F.add_months(F.max("date").cast("date"), -12), "yyyy-MM-dd").alias("_from")).withColumn("_one", F.lit(1))
    g = p.withColumn("_one", F.lit(1)).join(F.broadcast(last), "_one").where(F.col("date") >= F.col("_from")).groupBy("entity_name", "kind").agg(F.count(F.lit(1)).alias("charges"), F.sum("amount").alias("billed"), F.max("date").alias("last_charge"))
    return g.where("charges >= 2").orderBy(F.desc("charges"), "entity_name", "kind").limit(15)


@query(f"""WITH b AS (SELECT o_orderkey, o_custkey, o_orderpriority, strftime(o_orderdate, '%Y-%m-%d') AS date, CASE WHEN o_orderkey % 3 > 0 THEN strftime(o_orderdate + INTERVAL 7 DAY, '%Y-%m-%d') || CASE WHEN o_orderkey % 3 = 1 THEN ' to ' || strftime(o_orderdate + INTERVAL 9 DAY, '%Y-%m-%d') ELSE '' END END AS served FROM orders)
SELECT 'booking' AS kind, o_orderkey, date, served FROM (SELECT * FROM b WHERE o_orderpriority = '1-URGENT' AND served IS NOT NULL ORDER BY date DESC, o_orderkey LIMIT 14)
UNION ALL SELECT 'appointment', o_orderkey, date, served FROM (SELECT * FROM b WHERE o_orderpriority = '2-HIGH' ORDER BY date DESC, o_orderkey LIMIT 10)""")
def service_dates(spark, sf_dir):  # P-18: when a journey or an appointment was
    k, day = F.col("o_orderkey"), lambda n: F.date_format(F.date_add("o_orderdate", n), "yyyy-MM-dd")
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "booking").when(F.col("o_orderpriority") == "2-HIGH", "appointment")
    served = F.when(k % 3 == 1, F.concat(day(7), F.lit(" to "), day(9))).when(k % 3 == 2, day(7))
    t = table(spark, sf_dir, "orders").select(kind.alias("kind"), k.alias("message_id"), day(0).alias("date"), served.alias("service_dates"))
    found = [*api.of_kind(t, "booking", dated=True, limit=14).rows, *api.of_kind(t, "appointment", limit=10).rows]
    return spark.createDataFrame([tuple(r) for r in found], t.schema).toDF("kind", "o_orderkey", "date", "served")


@query(f"""WITH {TYPED}, {TOKENS}, t AS (SELECT doc_id, count(*) AS size, count(*) FILTER (token LIKE 'license') AS tf FROM tok GROUP BY doc_id), z AS (SELECT avg(size) AS a FROM t),
f AS (SELECT k.doc_id, tier, k.text, tf / (tf + 1.2 * (0.25 + 0.75 * size / a)) AS s FROM k JOIN t USING (doc_id), z WHERE tf > 0 AND doc_type = 'licence')
SELECT doc_id, tier, CASE WHEN tier >= 3 THEN sha256(text) END AS digest, (SELECT count(*) FROM f) > 20 AS truncated FROM f ORDER BY s DESC, doc_id LIMIT 20""")
def catalog_find(spark, sf_dir):  # P-14, T-09
    d = _classified(spark, sf_dir)
    r = api.catalog_search(d, kept_index(spark, sf_dir), "License", doc_type="licence")
    return _told(spark, r, d, "doc_id", "tier", "text").select("doc_id", "tier", F.sha2("text", 256).alias("digest"), "truncated")


@query("SELECT doc_id, sha256(coalesce(text, '')) AS sha256 FROM documents WHERE sha256(coalesce(text, '')) LIKE (SELECT left(min(sha256(coalesce(text, ''))), 8) FROM documents) || '%' ORDER BY sha256, doc_id LIMIT 2")
def catalog_get(spark, sf_dir):  # P-14: a document by the first digits of its hash
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    first = d.agg(F.min("sha256")).first()[0]
    return _told(spark, api.document(d, (first or "0" * 8)[:8].upper()), d, "doc_id", "sha256").drop("truncated")


@query("""WITH f AS (SELECT event_id, epoch_us(ts) AS at_us, event_type AS action FROM events WHERE user_id % 7 = 3 AND event_type IN ('click', 'purchase') AND epoch_us(ts) >= 1704500000000000)
SELECT event_id, at_us, action, (SELECT count(*) FROM f) > 50 AS truncated FROM f ORDER BY at_us DESC, event_id DESC LIMIT 50""")
def activity_feed(spark, sf_dir):  # P-15, F-13
    e = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 7).alias("group_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("user_id").cast("string").alias("actor"), F.col("event_type").alias("action"))
    r = api.activity(e, 3, since=1704500000000000, actions=["click", "purchase"])
    return _told(spark, r, e, "event_id", "at", "action").withColumnRenamed("at", "at_us")


STATES = ("private", "shared_with_named", "domain", "anyone_with_link")
DRIVE = "d AS (SELECT p_partkey AS file_id, p_size % 5 = 0 AS folder, p_size % 7 = 0 AS trashed, p_partkey % 11 = 0 AS gone, p_partkey * 37 % 1009 AS modified_ts, p_partkey % 5 AS s, p_brand, p_name FROM part)"


def _drive(spark, sf_dir: str) -> DataFrame:
    k, z = F.col("p_partkey"), F.col("p_size")
    state = F.get(F.array(*map(F.lit, STATES)), (k % 5).cast("int"))
    return table(spark, sf_dir, "part").select(k.alias("file_id"), F.col("p_name").alias("name"), F.when(z % 5 == 0, "folder").otherwise("file").alias("kind"), F.lit("text/plain").alias("mime_type"), (z % 7 == 0).alias("trashed"), F.when(k % 11 == 0, F.lit(1)).alias("deleted_at"), (k * 37 % 1009).alias("modified_ts"), F.array("p_brand").alias("owners"), state.alias("sharing_state"))


@query(f"""WITH {DRIVE} SELECT count(*) FILTER (NOT gone) AS files, count(*) FILTER (NOT gone AND folder) AS folders, count(*) FILTER (NOT gone AND trashed) AS trashed, count(*) FILTER (gone) AS tombstoned,
{", ".join(f"count(*) FILTER (NOT gone AND s = {i}) AS sharing_{x}" for i, x in enumerate((*STATES, "unknown")))}, (SELECT count(*) FROM lineitem) AS parent_edges FROM d""")
def drive_status(spark, sf_dir):  # P-12
    return api.drive_status(_drive(spark, sf_dir), table(spark, sf_dir, "lineitem"))


@query(f"""WITH {DRIVE}, f AS (SELECT * FROM d WHERE NOT gone AND NOT trashed AND NOT folder AND contains(lower(p_brand), 'brand#1') AND modified_ts >= 100 AND p_name = 'blue ring')
SELECT file_id, modified_ts, (SELECT count(*) FROM f) > 20 AS truncated FROM f ORDER BY modified_ts DESC, file_id LIMIT 20""")
def drive_search(spark, sf_dir):  # P-12
    from brinewell.operators.search import postings

    d = _drive(spark, sf_dir)
    return _told(spark, api.drive_search(d, postings(d, "file_id", "name"), "Ring blue", kind="file", owner="BRAND#1", since=100), d, "file_id", "modified_ts")


@query(f"WITH {DRIVE} SELECT file_id, modified_ts, (SELECT count(*) FROM d WHERE NOT gone) > 30 AS truncated FROM d WHERE NOT gone ORDER BY modified_ts DESC, file_id LIMIT 30")
def drive_recent(spark, sf_dir):  # P-12
    d = _drive(spark, sf_dir)
    return _told(spark, api.drive_recent(d, trashed=True, limit=30), d, "file_id", "modified_ts")


@query("""SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderdate, o_orderkey DESC)::INTEGER AS place FROM orders""")
def mixed_order(spark, sf_dir):  # S-03: a rule's place first, then down, then up
    status = F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2)
    w = Window.partitionBy("o_custkey").orderBy(status, F.desc("o_totalprice"), F.asc("o_orderdate"), F.desc("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.row_number().over(w).alias("place"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders UNION ALL SELECT user_id FROM events UNION ALL SELECT s_suppkey FROM supplier)")
def known_anywhere(spark, sf_dir):  # U-01
    o, e, s = (table(spark, sf_dir, t) for t in ("orders", "events", "supplier"))
    return upkeep.known_anywhere(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", (o, "o_custkey"), (e, "user_id"), (s, "s_suppkey"))


@query("""SELECT p_name || ' ' || (p_size % 3) AS summary, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY 1""")
def same_summaries(spark, sf_dir):  # X-38: titles that are written in several ways
    k = F.col("p_partkey") % 3
    written = F.when(k == 0, F.concat(F.lit("  "), F.upper("p_name"))).when(k == 1, F.regexp_replace("p_name", " ", "  \t")).otherwise(F.translate(F.initcap("p_name"), "abceginortw", "ａｂｃｅｇｉｎｏｒｔｗ"))
    p = table(spark, sf_dir, "part").select("p_partkey", summary_key(F.concat(written, F.lit("\n"), (F.col("p_size") % 3).cast("string"))).alias("summary"))
    return p.groupBy("summary").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first"))


@query("""WITH g AS (SELECT o_custkey AS sender, count(*) FILTER (o_orderstatus = 'F') AS documents FROM orders GROUP BY 1)
SELECT sender, CASE WHEN sender % 3 = 0 AND documents = 0 THEN 'never' WHEN sender % 3 = 1 THEN 'always' ELSE 'review' END AS suggested FROM g""")
def sender_suggestions(spark, sf_dir):  # P-05
    g = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("sender")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("documents"))
    klass = F.get(F.array(F.lit("marketing"), F.lit("human"), F.lit("service")), (F.col("sender") % 3).cast("int"))
    return g.select("sender", rules.suggestion(klass, F.col("documents")).alias("suggested"))
