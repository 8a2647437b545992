"""Queries on table upkeep: upserts, merges, incremental runs, retention, sets, rule cascades."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinewell.operators import incremental, linking, rules, upkeep
from brinewell.plans.ledger import HOURS_48, RICHEST, events
from brinewell.plans.registry import query
from brinewell.session import scratch_root, table
from brinewell.sources.files import exists, stamp

KEY = ["l_orderkey", "l_linenumber"]
TIES = ("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, {", ".join(TIES)}) AS k FROM lineitem) WHERE k = 1""")
def upsert_latest(spark, sf_dir):  # M-01, M-03
    rows = table(spark, sf_dir, "lineitem")
    stored = upkeep.latest(rows.where("l_linestatus = 'F'"), KEY, *[F.col(c) for c in TIES], F.col("l_shipdate"))  # an earlier state, which every line replaces
    out = upkeep.upsert(stored, rows, KEY, F.desc("l_shipdate"), *[F.col(c) for c in TIES])
    return out.select(*KEY, "l_partkey", "l_shipdate")


@query("""SELECT l_orderkey, max(l_extendedprice) AS price, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity, min(l_shipdate) AS first_ship, max(CASE WHEN l_returnflag = 'R' THEN l_tax END) AS tax FROM lineitem GROUP BY 1""")
def merge_columnwise(spark, sf_dir):  # M-02, M-09
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_extendedprice").alias("price"), F.col("l_quantity").cast("decimal(18,2)").alias("quantity"), F.col("l_shipdate").alias("first_ship"), F.when(F.col("l_returnflag") == "R", F.col("l_tax")).alias("tax"))
    out = upkeep.merged(rows, ["l_orderkey"], {"price": "max", "quantity": "sum", "first_ship": "min", "tax": "max"}, "first_ship")
    return out.withColumn("quantity", F.col("quantity").cast("double"))


def _ledger(rows: DataFrame) -> DataFrame:
    return rows.where("event_type <> 'error'").select("event_id", "user_id", "event_type", "value", "us")


@query(RICHEST.replace("FROM events)", "FROM events WHERE event_type <> 'error' AND event_id % 17 <> 0)") + " SELECT event_id, user_id, event_type, value, anchor AS anchor_us FROM r WHERE k = 1")
def incremental_equals_full(spark, sf_dir):  # I-01 to I-05, U-02, U-03
    e = events(spark, sf_dir).withColumn("synced", F.expr("(us div 1000000) + CASE WHEN event_id % 11 = 0 THEN 1500000 ELSE 0 END"))
    floor = 1_705_000_000
    first = e.where(F.col("synced") < floor)  # what the first run saw; a row of each 17 is deleted at the source later
    live = e.where("event_id % 17 <> 0")  # the others are what the source deleted in between
    rows = incremental.incremental_run(live, _ledger(first), first.select("event_id"), "event_id", "synced", floor, _ledger)
    linked = linking.link_events(rows, ["user_id", "event_type"], "us", HOURS_48)
    best = linking.richest(linked, ["user_id", "event_type", "anchor"], F.col("value").isNotNull().desc(), F.col("value").desc(), F.col("event_id"))
    return best.select("event_id", "user_id", "event_type", "value", F.col("anchor").alias("anchor_us"))


KEYS = ["user_id", "event_type"]
#: A later run: what the source received from LATER on, rows about old events that arrive late, and rows that it deleted since.
LATER, LATE, GONE = 1_706_650_000, "event_id % 997 = 0", "event_id % 1009 = 0"


def _events_of(rows: DataFrame) -> DataFrame:
    linked = linking.link_events(rows, KEYS, "us", HOURS_48)
    return linking.richest(linked, [*KEYS, "anchor"], F.col("value").isNotNull().desc(), F.col("value").desc(), F.col("event_id"))


def _received(spark, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).withColumn("synced", F.expr(f"(us div 1000000) + CASE WHEN {LATE} THEN 4000000 ELSE 0 END"))


def _first_run(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(rows, events) of the first run, kept in the shared folder until the source's files change."""
    source = table(spark, sf_dir, "events")
    path = f"{scratch_root(spark)}/ledger-{hashlib.sha256((sf_dir + stamp(source)).encode()).hexdigest()[:16]}"
    if not exists(spark, f"{path}/events/_SUCCESS"):
        _ledger(_received(spark, sf_dir).where(F.col("synced") < LATER)).write.mode("overwrite").parquet(f"{path}/rows")
        _events_of(spark.read.parquet(f"{path}/rows")).write.mode("overwrite").parquet(f"{path}/events")
    return spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/events")


@query(RICHEST.replace("FROM events)", f"FROM events WHERE event_type <> 'error' AND epoch_us(ts) // 1000000 < {LATER} AND NOT {LATE})") + " SELECT event_id, user_id, event_type, value, anchor AS anchor_us FROM r WHERE k = 1")
def incremental_first_run(spark, sf_dir):  # I-01, I-06
    return _first_run(spark, sf_dir)[1].select("event_id", "user_id", "event_type", "value", F.col("anchor").alias("anchor_us"))


@query(RICHEST.replace("FROM events)", f"FROM events WHERE event_type <> 'error' AND NOT {GONE})") + " SELECT event_id, user_id, event_type, value, anchor AS anchor_us FROM r WHERE k = 1")
def incremental_touched_keys(spark, sf_dir):  # I-01 to I-05: after the first run, only the keys that changed are linked again
    rows, kept = _first_run(spark, sf_dir)
    received = _received(spark, sf_dir)
    seen = received.where(F.col("synced") < LATER).select("event_id")
    live = received.where(f"NOT {GONE}")
    _, out, _ = incremental.relinked(rows, kept, live, seen, "event_id", "synced", LATER, KEYS, _ledger, _events_of, overlap=0)
    return out.select("event_id", "user_id", "event_type", "value", F.col("anchor").alias("anchor_us"))


@query("SELECT conv_id, turn, CASE WHEN conv_id < 40 THEN '' ELSE text END AS text FROM conversations")
def retention_blank(spark, sf_dir):  # M-11
    return upkeep.blanked(table(spark, sf_dir, "conversations"), ["text"], "conv_id", F.lit(40)).select("conv_id", "turn", "text")


@query("""SELECT user_id, CASE WHEN a IS NULL THEN 'added' WHEN b IS NULL THEN 'dropped' ELSE 'kept' END AS change FROM
(SELECT DISTINCT user_id, 1 AS a FROM events WHERE ts < TIMESTAMP '2024-01-03') FULL JOIN (SELECT DISTINCT user_id, 1 AS b FROM events WHERE ts >= TIMESTAMP '2024-01-27') USING (user_id)""")
def set_reconcile(spark, sf_dir):  # U-02, U-03, U-04, U-09
    e = table(spark, sf_dir, "events")
    at = lambda d: F.lit(d).cast("timestamp_ntz")
    return incremental.reconciled(e.where(F.col("ts") < at("2024-01-03")), e.where(F.col("ts") >= at("2024-01-27")), ["user_id"])


@query("""SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000) OR (c_acctbal > 9000 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000))""")
def orphan_prune(spark, sf_dir):  # J-06, J-07, M-07
    c = table(spark, sf_dir, "customer")
    o = table(spark, sf_dir, "orders").where("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))
    return upkeep.orphans_pruned(c, (o, ["c_custkey"]), keep=F.col("c_acctbal") > 9000).select("c_custkey", "c_name")


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'new' WHEN event_id % 3 = 1 THEN 'replay' ELSE 'conflict' END AS outcome FROM events""")
def request_receipts(spark, sf_dir):  # M-14
    e = table(spark, sf_dir, "events")
    stored = e.where("event_id % 3 > 0").select("event_id", F.sha2(F.when(F.col("event_id") % 3 == 1, F.col("props")).otherwise(""), 256).alias("digest"))
    return upkeep.receipts(e.select("event_id", "props"), stored, ["event_id"], "props").select("event_id", "outcome")


@query("""WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS seq FROM orders WHERE o_orderstatus = 'F'), h AS (SELECT o_custkey, count(*) AS have FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT o_orderkey, CASE WHEN have IS NULL THEN 'create' WHEN seq >= have THEN 'update' ELSE 'ignore' END AS decision FROM o LEFT JOIN h USING (o_custkey)""")
def import_decision(spark, sf_dir):  # M-17
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders")
    incoming = o.where("o_orderstatus = 'F'").withColumn("seq", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long")).select("o_custkey", "o_orderkey", "seq")
    existing = o.where("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("seq"))
    return upkeep.import_decisions(incoming, existing, "o_custkey", "seq").select("o_orderkey", "decision")


RULES = [
    ("src0", 1, "subject", r"^Th([a-z]+)", "extract", "th", "$1", 0.9),
    ("src0", 2, "subject", r"^[A-E]", "terminate", None, None, 0.8),
    ("src1", 1, "snippet", r"license", "extract", "licence", "yes", 0.7),
    ("src1", 2, "subject", r".", "escalate", None, None, 0.1),
]


@query("""WITH m AS (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10))[1] AS subject, coalesce(text, '') AS snippet FROM documents)
SELECT doc_id, CASE WHEN source IN ('src2', 'src3') THEN 'L0' WHEN source = 'src0' AND regexp_matches(subject, '^Th[a-z]+') THEN 'L1' WHEN source = 'src0' AND regexp_matches(subject, '^[A-E]') THEN 'L1' WHEN source = 'src1' AND contains(snippet, 'license') THEN 'L1' ELSE 'L2' END AS lane,
CASE WHEN source IN ('src2', 'src3') THEN 'terminate' WHEN source = 'src0' AND regexp_matches(subject, '^Th[a-z]+') THEN 'extract' WHEN source = 'src0' AND regexp_matches(subject, '^[A-E]') THEN 'terminate' WHEN source = 'src1' AND contains(snippet, 'license') THEN 'extract'
WHEN regexp_matches(subject, '[0-9]') THEN 'extract' ELSE 'escalate' END AS action,
CASE WHEN source IN ('src2', 'src3') THEN NULL WHEN source = 'src0' AND regexp_matches(subject, '^Th[a-z]+') THEN regexp_extract(subject, '^Th([a-z]+)', 1) WHEN source = 'src0' AND regexp_matches(subject, '^[A-E]') THEN NULL WHEN source = 'src1' AND contains(snippet, 'license') THEN 'yes'
WHEN regexp_matches(subject, '[0-9]') THEN regexp_extract(subject, '[0-9]+', 0) END AS value FROM m""")
def rule_cascade(spark, sf_dir):  # P-01, P-02, P-03
    t = F.coalesce("text", F.lit(""))
    m = table(spark, sf_dir, "documents").select("doc_id", "source", F.split(t, "\n")[0].alias("subject"), t.alias("snippet"))
    classes = spark.createDataFrame([("src2", "marketing"), ("src3", "marketing"), ("src4", "human")], "sender string, class string")
    templates = spark.createDataFrame(RULES, "sender string, rule_order int, field string, pattern string, action string, kind string, value string, confidence double")
    digits = F.regexp_extract("subject", "[0-9]+", 0)
    made = lambda action, kind, value, conf: F.struct(F.lit(action).alias("action"), F.lit(kind).cast("string").alias("kind"), value.cast("string").alias("value"), F.lit(conf).cast("double").alias("confidence"))
    generic = F.when(digits != "", made("extract", "number", digits, 0.5)).otherwise(made("escalate", None, F.lit(None), 0.0))
    return rules.cascade(m, classes, templates, generic, "doc_id", "source").select("doc_id", "lane", "action", "value")


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 100 = 0 THEN 'always' WHEN o_orderpriority = '5-LOW' THEN 'never' END AS verdict FROM orders
WHERE o_custkey % 100 = 0 OR (o_orderpriority <> '5-LOW' AND o_orderstatus <> 'F')""")
def verdict_selection(spark, sf_dir):  # P-04, J-16
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("addr"), "o_orderpriority", "o_orderstatus", "o_custkey")
    keys = table(spark, sf_dir, "customer").where("c_custkey % 100 = 0").select(F.col("c_custkey").cast("string").alias("key"), F.lit("always").alias("verdict")).union(spark.createDataFrame([("5-LOW", "never")], "key string, verdict string"))
    judged = rules.keyed_verdict(o, keys, "addr", "o_orderpriority")
    return rules.selected(judged, "verdict", "o_orderstatus", ("F",)).select("o_orderkey", "verdict")


@query("""WITH a AS (SELECT o_custkey || '/' || o_orderpriority AS id, CASE o_orderstatus WHEN 'P' THEN 'ok' ELSE 'failed' END AS s FROM orders)
SELECT id, count(*) FILTER (s = 'failed') AS failures FROM a GROUP BY id HAVING count(*) FILTER (s <> 'failed') = 0 AND count(*) FILTER (s = 'failed') < 3""")
def retry_budget(spark, sf_dir):  # I-13
    a = table(spark, sf_dir, "orders").select(F.concat_ws("/", F.col("o_custkey").cast("string"), "o_orderpriority").alias("id"), F.when(F.col("o_orderstatus") == "P", "ok").otherwise("failed").alias("s"))
    return incremental.to_retry(a, "id", "s")
