"""Ledger queries: linking, spending, censuses, ratings and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brinewell.operators import linking, measures, rules
from brinewell.plans.registry import query
from brinewell.session import table

HOURS_48 = 48 * 3600 * 1_000_000


def events(spark, sf_dir: str) -> DataFrame:
    """events with `us`, microseconds since 1970."""
    return table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))


def money(c: str):
    return F.col(c).cast("decimal(18,2)")


def _linked(spark, sf_dir: str) -> DataFrame:
    return linking.link_events(events(spark, sf_dir), ["user_id", "event_type"], "us", HOURS_48)


#: W-01 in SQL: a walk along each key's rows that carries the open event's first time.
LINKED = """
WITH RECURSIVE e AS (
  SELECT event_id, user_id, event_type, value, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events),
w AS (
  SELECT *, us AS anchor FROM e WHERE rn = 1
  UNION ALL
  SELECT e.event_id, e.user_id, e.event_type, e.value, e.us, e.rn, CASE WHEN e.us - w.anchor > 172800000000 THEN e.us ELSE w.anchor END
  FROM w JOIN e ON e.user_id = w.user_id AND e.event_type = w.event_type AND e.rn = w.rn + 1)
"""


@query(LINKED + "SELECT event_id, user_id, event_type, anchor AS anchor_us FROM w")
def event_link_anchored(spark, sf_dir):  # W-01, I-05
    return _linked(spark, sf_dir).select("event_id", "user_id", "event_type", F.col("anchor").alias("anchor_us"))


RICHEST = LINKED + ", r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, anchor ORDER BY (value IS NOT NULL) DESC, value DESC, event_id) AS k FROM w)"


@query(RICHEST + " SELECT event_id, user_id, event_type, value, anchor AS anchor_us FROM r WHERE k = 1")
def event_collapse_richest(spark, sf_dir):  # W-02
    best = linking.richest(_linked(spark, sf_dir), ["user_id", "event_type", "anchor"], F.col("value").isNotNull().desc(), F.col("value").desc(), F.col("event_id"))
    return best.select("event_id", "user_id", "event_type", "value", F.col("anchor").alias("anchor_us"))


@query(RICHEST + " SELECT user_id, count(*) AS n_events, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total, min(anchor) AS first_us, max(anchor) AS last_us FROM r WHERE k = 1 GROUP BY user_id")
def events_after_linking(spark, sf_dir):  # W-01, W-02, A-04
    best = linking.richest(_linked(spark, sf_dir), ["user_id", "event_type", "anchor"], F.col("value").isNotNull().desc(), F.col("value").desc(), F.col("event_id"))
    return best.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_events"), F.sum(money("value")).cast("double").alias("total"), F.min("anchor").alias("first_us"), F.max("anchor").alias("last_us"))


@query(RICHEST + """, n AS (SELECT user_id, event_type, anchor, count(*) AS n FROM w GROUP BY 1, 2, 3 HAVING count(*) >= 3), b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type, anchor) AS p FROM n)
SELECT r.event_id, r.user_id, r.event_type, r.anchor AS anchor_us, k = 1 AS is_primary FROM r JOIN b USING (user_id, event_type, anchor) WHERE p = 1""")
def event_evidence(spark, sf_dir):  # P-18: the rows behind each user's largest event
    e = linking.largest_events(_linked(spark, sf_dir), ["user_id"], ["user_id", "event_type", "anchor"], 3, F.col("value").isNotNull().desc(), F.col("value").desc(), F.col("event_id"))
    return e.select("event_id", "user_id", "event_type", F.col("anchor").alias("anchor_us"), "is_primary")


@query("""SELECT c_name, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total, min(o_orderdate) AS first_at, max(o_orderdate) AS last_at
FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment ILIKE '%auto%' GROUP BY c_name""")
def counterparty_spend(spark, sf_dir):  # A-01, J-01, F-05
    c = table(spark, sf_dir, "customer").where(F.col("c_mktsegment").ilike("%auto%")).select("c_custkey", "c_name")
    j = table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy("c_name").agg(F.count(F.lit(1)).alias("n"), F.sum(money("o_totalprice")).cast("double").alias("total"), F.min("o_orderdate").alias("first_at"), F.max("o_orderdate").alias("last_at"))


@query("""SELECT o_orderstatus AS kind, count(*) AS n, count(DISTINCT o_custkey) AS parties, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total,
count(*) FILTER (o_totalprice > 200000) AS large FROM orders GROUP BY 1""")
def spend_by_kind(spark, sf_dir):  # A-02, A-06, A-07
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderstatus").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("parties"), F.sum(money("o_totalprice")).cast("double").alias("total"), F.count_if(F.col("o_totalprice") > 200000).alias("large"))


@query("""SELECT c_name, o_orderpriority AS kind, count(*) AS n, count(DISTINCT strftime(o_orderdate, '%Y-%m')) AS months, min(o_orderdate) AS first_at, max(o_orderdate) AS last_at
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2 HAVING count(*) >= 3 AND count(DISTINCT strftime(o_orderdate, '%Y-%m')) >= 3""")
def recurring_charges(spark, sf_dir):  # A-05, P-18
    j = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    g = j.groupBy("c_name", F.col("o_orderpriority").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.date_format("o_orderdate", "yyyy-MM")).alias("months"), F.min("o_orderdate").alias("first_at"), F.max("o_orderdate").alias("last_at"))
    return g.where("n >= 3 AND months >= 3")


@query("""SELECT p_brand, p_name, n, CAST(rank AS INTEGER) AS rank FROM (
SELECT p_brand, p_name, count(*) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_name) AS rank FROM part GROUP BY 1, 2) WHERE rank <= 6""")
def entity_top_aliases(spark, sf_dir):  # A-13
    return measures.top_per_group(table(spark, sf_dir, "part"), ["p_brand"], "p_name", 6)


CENSUS = """WITH g AS (SELECT o_custkey AS sender, count(*) AS n FROM orders GROUP BY 1),
r AS (SELECT sender, n, row_number() OVER (ORDER BY n DESC, sender) AS rank, CAST(sum(n) OVER (ORDER BY n DESC, sender ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum FROM g)
"""


def _census(spark, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("sender")).agg(F.count(F.lit(1)).alias("n"))
    return measures.ranked_share(g, "sender", "n")


@query(CENSUS + "SELECT sender, n, rank, cum, CAST(cum AS DOUBLE) / (SELECT CAST(sum(n) AS DOUBLE) FROM g) AS coverage FROM r")
def sender_census_coverage(spark, sf_dir):  # A-11, W-03
    return _census(spark, sf_dir)


@query(CENSUS + """, c AS (SELECT *, CAST(cum AS DOUBLE) / (SELECT CAST(sum(n) AS DOUBLE) FROM g) AS coverage FROM r)
SELECT CAST(m AS DOUBLE) AS mark, (SELECT min(rank) FROM c WHERE coverage >= m) AS n FROM (SELECT unnest([0.5, 0.8, 0.95]) AS m)""")
def coverage_curve(spark, sf_dir):  # A-12
    return measures.coverage_curve(_census(spark, sf_dir))


@query("SELECT user_id FROM events WHERE event_type IN ('click', 'purchase', 'signup') GROUP BY user_id HAVING count(DISTINCT event_type) = 3")
def has_all_types(spark, sf_dir):  # F-06, F-07
    wanted = ["click", "purchase", "signup"]
    return table(spark, sf_dir, "events").where(F.col("event_type").isin(wanted)).groupBy("user_id").agg(F.count_distinct("event_type").alias("k")).where(F.col("k") == len(wanted)).select("user_id")


@query("""SELECT o_orderkey, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_discount >= 0.1) THEN 'yes'
WHEN o_orderdate >= TIMESTAMP '1996-01-01' THEN 'no' ELSE 'unknown' END AS state FROM orders""")
def attachment_state(spark, sf_dir):  # F-09, I-15, J-05, J-08
    line = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    base = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return rules.three_valued(base, "o_orderkey", line.where("l_returnflag = 'R'"), line.where("l_discount >= 0.1"), F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz")).select("o_orderkey", "state")


@query("""SELECT l_suppkey, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS votes,
(42.0 + CAST(sum(CAST(l_discount * 50 AS DECIMAL(18,2)) * CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE)) / (10.0 + CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE)) AS rating FROM lineitem GROUP BY 1""")
def shrunk_rating(spark, sf_dir):  # A-20
    votes = money("l_quantity")
    g = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.sum(votes).cast("double").alias("votes"), F.sum((F.col("l_discount") * 50).cast("decimal(18,2)") * votes).cast("double").alias("points"))
    return g.select("l_suppkey", "n", "votes", measures.shrunk_mean(F.col("points"), F.col("votes")).alias("rating"))


@query("""SELECT s_suppkey, n_name, score, row_number() OVER (ORDER BY score DESC, s_suppkey) AS rank FROM (
SELECT s_suppkey, n_name, CASE WHEN s_acctbal > 5000 THEN 20 WHEN s_acctbal > 0 THEN 6 ELSE -10 END + CASE n_regionkey WHEN 1 THEN 4 WHEN 2 THEN -40 ELSE 0 END AS score
FROM supplier JOIN nation ON s_nationkey = n_nationkey) ORDER BY rank LIMIT 8""")
def weighted_rank_topk(spark, sf_dir):  # S-01, S-07, S-12, W-09: the eight best, a feature
    s = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))  # nations: 25 rows
    balance = F.when(F.col("s_acctbal") > 5000, 20).when(F.col("s_acctbal") > 0, 6).otherwise(-10)
    region = F.when(F.col("n_regionkey") == 1, 4).when(F.col("n_regionkey") == 2, -40).otherwise(0)
    top = s.select("s_suppkey", "n_name", (balance + region).alias("score")).orderBy(F.desc("score"), "s_suppkey").limit(8)
    return top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), "s_suppkey")).cast("long"))


@query("""WITH d AS (SELECT r_name AS region, o_orderpriority AS kind FROM region, (SELECT DISTINCT o_orderpriority FROM orders)),
c AS (SELECT r_name AS region, o_orderpriority AS kind, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE o_totalprice > 498000 GROUP BY 1, 2) SELECT region, kind, coalesce(n, 0) AS n FROM d LEFT JOIN c USING (region, kind)""")
def zero_filled_counts(spark, sf_dir):  # A-03, J-02, J-03
    o = table(spark, sf_dir, "orders")
    kinds = o.groupBy().agg(F.collect_set("o_orderpriority").alias("k"))  # five priorities
    place = table(spark, sf_dir, "region").withColumn("one", F.lit(1)).join(F.broadcast(kinds.withColumn("one", F.lit(1))), "one").select(F.col("r_name").alias("region"), F.explode("k").alias("kind"))
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("region"))
    c = table(spark, sf_dir, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "region")  # nations: 25 rows
    counts = o.where("o_totalprice > 498000").join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("region", F.col("o_orderpriority").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return place.join(counts, ["region", "kind"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query("SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n, count(DISTINCT o_custkey) AS senders FROM orders GROUP BY 1")
def year_histogram(spark, sf_dir):  # A-28
    return table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("senders"))


@query("""SELECT user_id, count(*) AS n, avg(CASE WHEN event_type = 'click' THEN 1.0 ELSE 0.0 END) AS clicks, avg(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END) AS purchases FROM events GROUP BY 1""")
def label_ratios(spark, sf_dir):  # A-09
    e = table(spark, sf_dir, "events").withColumn("labels", F.array("event_type"))
    return measures.label_ratios(e, "user_id", "labels", {"click": "clicks", "purchase": "purchases"})


@query("""SELECT c_mktsegment, o_orderpriority AS usual FROM (SELECT c_mktsegment, o_orderpriority, row_number() OVER (PARTITION BY c_mktsegment ORDER BY count(*) DESC, o_orderpriority) AS k
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) WHERE k = 1""")
def usual_name(spark, sf_dir):  # A-21
    j = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return measures.mode_of(j, ["c_mktsegment"], "o_orderpriority").withColumnRenamed("o_orderpriority", "usual")


@query("""SELECT user_id, arg_max(event_id, ts) AS event_id, arg_max(event_type, ts) AS event_type, max(ts) AS ts FROM events GROUP BY 1""")
def latest_event(spark, sf_dir):  # S-08
    e = table(spark, sf_dir, "events")
    last = F.max_by(F.struct("event_id", "event_type", "ts"), F.struct("ts", "event_id"))
    return e.groupBy("user_id").agg(last.alias("l")).select("user_id", "l.event_id", "l.event_type", "l.ts")



@query("""WITH people AS (SELECT c_custkey AS person_id, c_acctbal > 0 AS active FROM customer), ids AS (
SELECT c_custkey AS person_id, 'u' || (c_custkey // 2) AS sender, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'home' END AS account FROM customer),
req AS (SELECT o_orderkey AS request, 'u' || (o_custkey // 2) AS sender, CASE WHEN o_orderkey % 3 = 0 THEN 'home' ELSE 'work' END AS account, o_orderpriority AS resource,
CASE WHEN o_orderkey % 5 = 0 THEN o_custkey END AS subject FROM orders),
who AS (SELECT request, person_id, row_number() OVER (PARTITION BY request ORDER BY ids.account DESC, person_id DESC) AS k FROM req JOIN ids ON ids.sender = req.sender AND ids.account IN (req.account, '')
JOIN people USING (person_id) WHERE active),
g AS (SELECT DISTINCT o_custkey AS person_id, o_orderpriority AS resource, o_orderstatus = 'P' AS self_only FROM orders WHERE o_orderstatus <> 'O')
SELECT req.request, who.person_id, EXISTS (SELECT 1 FROM g WHERE g.person_id = who.person_id AND g.resource = req.resource AND (NOT self_only OR req.subject IS NULL OR req.subject = who.person_id)) AS allowed
FROM req LEFT JOIN who ON who.request = req.request AND k = 1""")
def access_decision(spark, sf_dir):  # P-19, J-17
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    people = c.select(F.col("c_custkey").alias("person_id"), F.when(F.col("c_acctbal") > 0, "active").otherwise("left").alias("status"))
    half = lambda k: F.concat(F.lit("u"), F.expr(f"{k} div 2"))
    ids = c.select(F.col("c_custkey").alias("person_id"), F.lit("chat").alias("channel"), half("c_custkey").alias("sender"), F.when(F.col("c_custkey") % 2 == 0, "").otherwise("home").alias("account"))
    req = o.select(F.col("o_orderkey").alias("request"), F.lit("chat").alias("channel"), half("o_custkey").alias("sender"), F.when(F.col("o_orderkey") % 3 == 0, "home").otherwise("work").alias("account"), F.col("o_orderpriority").alias("resource"), F.lit("read").alias("action"), F.when(F.col("o_orderkey") % 5 == 0, F.col("o_custkey")).alias("subject"))
    grants = o.where("o_orderstatus <> 'O'").select(F.col("o_custkey").alias("person_id"), F.col("o_orderpriority").alias("resource"), F.lit("read").alias("action"), F.lit("active").alias("status"), (F.col("o_orderstatus") == "P").alias("self_only")).distinct()
    return rules.allowed(rules.principals(req, ids, people), grants).select("request", "person_id", "allowed")
