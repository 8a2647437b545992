"""Queries on senders, shares, references and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from brinewell.operators import census
from brinewell.plans.ledger import events
from brinewell.plans.registry import query
from brinewell.session import table

RATIOS = """r AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, avg(CASE WHEN event_type = 'view' THEN 1.0 ELSE 0 END) AS promo, avg(CASE WHEN event_type = 'click' THEN 1.0 ELSE 0 END) AS updates, avg(CASE WHEN event_type = 'signup' THEN 1.0 ELSE 0 END) AS personal,
avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0 END) AS social, avg(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0 END) AS transact FROM events GROUP BY 1, 2)"""


@query(f"""WITH {RATIOS} SELECT user_id, day, n, CASE WHEN user_id % 10 = 0 AND promo < 0.5 THEN 'human' WHEN personal > 0.5 AND n <= 20 AND user_id % 3 > 0 THEN 'human' WHEN promo > 0.6 THEN 'marketing' WHEN transact > 0.4 AND promo < 0.3 THEN 'service-transactional'
WHEN updates > 0.6 AND user_id % 3 = 0 THEN 'service-notification' WHEN social > 0.6 THEN 'service-notification' WHEN user_id % 3 = 0 THEN 'marketing' ELSE 'unknown' END AS class FROM r""")
def sender_classes(spark, sf_dir):  # X-09, A-09
    e = table(spark, sf_dir, "events").withColumn("day", F.col("ts").cast("date"))  # a user's day stands for a sender
    share = {"view": "promo", "click": "updates", "signup": "personal", "error": "social", "purchase": "transact"}
    r = e.groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("n"), *[F.avg((F.col("event_type") == k).cast("double")).alias(v) for k, v in share.items()])
    addr = F.concat(F.when(F.col("user_id") % 3 == 0, "news@").otherwise("ann@"), F.col("user_id").cast("string"), F.lit(".com"))
    c = census.sender_class(addr, *[F.col(x) for x in ("n", "promo", "updates", "personal", "social", "transact")], F.col("user_id") % 10 == 0)
    return r.select("user_id", "day", "n", c["class"].alias("class"))


@query("""SELECT event_id, CASE event_type WHEN 'signup' THEN 4 WHEN 'purchase' THEN 2 WHEN 'error' THEN 0 ELSE 1 END + CASE WHEN event_id % 2 = 0 THEN 3 ELSE 0 END + CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN event_id % 5 = 0 THEN 2 ELSE 0 END AS score FROM events""")
def message_scores(spark, sf_dir):  # S-07
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    klass = F.when(F.col("event_type") == "signup", "human").when(F.col("event_type") == "purchase", "service-transactional").when(F.col("event_type") == "error", "marketing").otherwise("other")
    labels = F.array_compact(F.array(F.when(k % 2 == 0, "IMPORTANT"), F.when(k % 3 == 0, "INBOX"), F.lit("OTHER")))
    return e.select("event_id", census.message_score(klass, labels, F.when(k % 5 == 0, F.array(F.lit("pdf")))).alias("score"))


@query("""SELECT c_custkey, CASE WHEN CAST(c_custkey AS VARCHAR) LIKE '12%' THEN 'b' WHEN CAST(c_custkey AS VARCHAR) LIKE '1%' THEN 'a' WHEN CAST(c_custkey AS VARCHAR) LIKE '7%' THEN 'c' END AS label FROM customer""")
def zone_by_prefix(spark, sf_dir):  # X-25
    p = spark.createDataFrame([("1", "a"), ("12", "b"), ("7", "c")], "prefix string, label string")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("phone"))
    return census.longest_prefix(c, "phone", p, 3).select("c_custkey", "label")


@query("""SELECT o_orderkey, CASE WHEN bool_or(l_returnflag = 'R' AND l_linestatus = 'F') THEN 'public' WHEN bool_or(l_returnflag = 'R') THEN 'link' WHEN bool_or(l_returnflag = 'A') THEN 'domain' WHEN bool_or(l_linenumber > 1) THEN 'shared' ELSE 'private' END AS sharing
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity >= 10 GROUP BY 1""")
def sharing_summary(spark, sf_dir):  # X-31
    line = table(spark, sf_dir, "lineitem")
    p = F.struct(
        F.when(F.col("l_returnflag") == "R", "anyone").when(F.col("l_returnflag") == "A", "domain").otherwise("user").alias("type"),
        F.when(F.col("l_linenumber") > 1, "reader").otherwise("owner").alias("role"), (F.col("l_linestatus") == "F").alias("discoverable"), (F.col("l_quantity") < 10).alias("deleted"),
    )
    per = line.select(F.col("l_orderkey").alias("o_orderkey"), p.alias("p")).groupBy("o_orderkey").agg(F.collect_set("p").alias("ps"))  # at most 24 kinds of permission
    o = table(spark, sf_dir, "orders").select("o_orderkey").join(per, "o_orderkey", "left")
    return o.select("o_orderkey", F.coalesce(census.sharing(F.col("ps"), "owner"), F.lit("private")).alias("sharing"))


@query("""SELECT event_type, CAST(epoch_us(max(ts)) // 1000000 AS BIGINT) AS synced_at, CAST(1706745600 - epoch_us(max(ts)) // 1000000 AS BIGINT) AS age, 1706745600 - epoch_us(max(ts)) // 1000000 > 129600 AS is_stale FROM events GROUP BY 1""")
def freshness(spark, sf_dir):  # F-16
    e = events(spark, sf_dir).withColumn("synced", F.expr("us div 1000000"))
    return census.with_freshness(e, "synced", 1_706_745_600, 36 * 3600, "event_type")


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN event_id // 4 WHEN event_id % 2 = 1 AND event_id >= 2 THEN (event_id - 1) * 10 END AS request FROM events""")
def reply_links(spark, sf_dir):  # J-21
    k = F.col("event_id")
    e = table(spark, sf_dir, "events").select("event_id", F.when(k % 4 == 0, F.concat(F.lit("Re: [#"), F.expr("event_id div 4").cast("string"), F.lit("] hi"))).otherwise("Re: hi").alias("subject"),
        F.when(k % 2 == 1, F.concat(F.lit("<m"), (k - 2).cast("string"), F.lit("@x> <m"), (k - 1).cast("string"), F.lit("@x>"))).alias("refs"))
    known = table(spark, sf_dir, "events").where("event_id > 0 AND event_id % 2 = 0").select(F.concat(F.lit("m"), k.cast("string"), F.lit("@x")).alias("message"), (k * 10).alias("request"))
    return census.reply_targets(e, known, "event_id", "subject", "refs")


@query("""WITH i AS (SELECT event_id, user_id, epoch_us(ts) // 1000000 AS s FROM events) SELECT event_id AS instance, user_id AS series, s + CASE WHEN event_id % 6 = 0 THEN 60 ELSE 0 END AS start,
s + CASE WHEN event_id % 6 = 0 THEN 60 ELSE 0 END + CASE WHEN event_id % 12 = 0 THEN 5 ELSE 1000 + user_id END AS "end", event_id % 6 = 0 AS is_override FROM i""")
def override_occurrences(spark, sf_dir):  # W-10
    e, k = events(spark, sf_dir).withColumn("s", F.expr("us div 1000000")), F.col("event_id")
    inst = e.select(F.col("user_id").alias("series"), k.alias("instance"), F.col("s").alias("start"))
    masters = e.select(F.col("user_id").alias("series")).distinct().select("series", (1000 + F.col("series")).alias("duration"), F.lit("m").alias("summary"))
    over = e.where("event_id % 6 = 0").select(k.alias("instance"), (F.col("s") + 60).alias("start"), F.when(k % 12 == 0, F.col("s") + 65).alias("end"), F.lit("o").alias("summary"), F.lit("confirmed").alias("status"))
    return census.occurrences(inst, masters, over).select("instance", "series", "start", "end", "is_override")


@query("""SELECT o_orderpriority, array_to_string(list(o_orderkey ORDER BY o_orderkey)[1:5], ',') AS ids FROM orders GROUP BY 1""")
def sample_ids(spark, sf_dir):  # A-14
    return census.first_ids(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderkey").select("o_orderpriority", F.array_join("ids", ",").alias("ids"))


@query("""SELECT count(*) AS n, count(*) FILTER (o_totalprice < 100000) AS small, count(*) FILTER (o_orderpriority = '5-LOW') AS low, count(*) FILTER (o_totalprice < 100000 AND o_orderpriority = '5-LOW') AS both_levers,
CAST(count(*) FILTER (o_totalprice < 100000) AS DOUBLE) / count(*) AS small_share FROM orders""")
def lever_counts(spark, sf_dir):  # A-18, A-23
    small, low = F.col("o_totalprice") < 100000, F.col("o_orderpriority") == "5-LOW"
    o = table(spark, sf_dir, "orders")
    return o.agg(F.count(F.lit(1)).alias("n"), F.count_if(small).alias("small"), F.count_if(low).alias("low"), F.count_if(small & low).alias("both_levers"), (F.count_if(small) / F.count(F.lit(1))).alias("small_share"))


@query("""SELECT user_id, min(coalesce(CASE WHEN event_type = 'view' THEN event_id END, 0)) AS covered_from, max(event_id) AS covered_to FROM events WHERE event_type <> 'error' GROUP BY 1""")
def coverage_bounds(spark, sf_dir):  # A-27, J-18
    e = table(spark, sf_dir, "events").where("event_type <> 'error'")
    return e.groupBy("user_id").agg(F.min(F.coalesce(F.when(F.col("event_type") == "view", F.col("event_id")), F.lit(0))).alias("covered_from"), F.max("event_id").alias("covered_to"))


@query("""SELECT source, count(*) FILTER (text <> '') AS with_text, min(doc_id) AS oldest, max(doc_id) AS newest, count(*) FILTER (doc_id < 100) AS due FROM documents GROUP BY 1""")
def retention_inventory(spark, sf_dir):  # A-29
    d = table(spark, sf_dir, "documents")
    return d.groupBy("source").agg(F.count_if(F.col("text") != "").alias("with_text"), F.min("doc_id").alias("oldest"), F.max("doc_id").alias("newest"), F.count_if(F.col("doc_id") < 100).alias("due"))


@query("""SELECT n_name, person_id, matched FROM (SELECT n_name, n_nationkey, CASE WHEN n_nationkey < 5 THEN n_nationkey END AS person_id, CASE WHEN n_nationkey < 5 THEN 'name' END AS matched FROM nation)""")
def actor_lookup(spark, sf_dir):  # P-08
    n = table(spark, sf_dir, "nation")
    people = n.where("n_nationkey < 5").select(F.col("n_nationkey").alias("person_id"), F.lit("").alias("phone"), F.col("n_name").alias("name"))
    return census.resolved_actor(people, n.select(F.col("n_name").alias("ask"))).select(F.col("ask").alias("n_name"), "person_id", "matched")
