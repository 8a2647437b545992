"""Queries on table upkeep by parents and runs, merged censuses, and sets of ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from brinewell.operators import incremental, measures, upkeep
from brinewell.plans.registry import query
from brinewell.session import table

LINE = ["l_orderkey", "l_linenumber", "l_partkey"]


@query("""WITH s AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_linenumber <= 2), n AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_linenumber = 1 AND l_orderkey % 3 = 0)
SELECT * FROM s WHERE l_orderkey % 3 > 0 UNION ALL SELECT * FROM n""")
def replaced_children(spark, sf_dir):  # M-04
    line, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    stored = line.where("l_linenumber <= 2").select(*LINE).distinct()
    parents = orders.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("l_orderkey"))
    new = line.where("l_linenumber = 1 AND l_orderkey % 3 = 0").select(*LINE).distinct()
    return upkeep.replace_children(stored, new, parents, ["l_orderkey"])


@query("""SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_linestatus = 'F' OR (l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25) AND (l_orderkey, l_linenumber, l_partkey) NOT IN (SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_linestatus = 'F'))""")
def insert_where_exists(spark, sf_dir):  # M-05, J-05
    line = table(spark, sf_dir, "lineitem")
    stored = line.where("l_linestatus = 'F'").select(*LINE).distinct()
    parents = table(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("l_partkey"))
    return upkeep.insert_where(stored, line.select(*LINE).distinct(), parents, ["l_partkey"], LINE)


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN NULL WHEN o_orderkey % 5 = 0 THEN 100 ELSE 1000 END AS deleted_at FROM orders WHERE o_orderstatus <> 'F' OR o_orderkey % 5 > 0""")
def grace_prune(spark, sf_dir):  # M-06
    o = table(spark, sf_dir, "orders")
    stored = o.select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, 100).alias("deleted_at"))  # some were gone before
    marked = upkeep.tombstoned(stored, o.where("o_orderstatus <> 'F'").select("o_orderkey"), ["o_orderkey"], F.lit(1000))
    return upkeep.pruned(marked, "deleted_at", F.lit(1000 - 7 * 86))


@query("""SELECT o_orderkey, 7 AS seen_run FROM orders WHERE o_orderpriority <> '5-LOW'""")
def mark_and_sweep(spark, sf_dir):  # M-08
    o = table(spark, sf_dir, "orders")
    stored = o.select("o_orderkey", F.lit(6).alias("seen_run"))
    seen = o.where("o_orderpriority <> '5-LOW'").select("o_orderkey", F.lit(7).alias("seen_run"))
    return upkeep.swept(upkeep.upsert(stored, seen, ["o_orderkey"], F.desc("seen_run")), "seen_run", 7)


@query("""WITH k AS (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_name) AS into_key, p_name, p_size FROM part) SELECT 'item' AS kind, into_key AS id, max(p_size) AS n FROM k GROUP BY 2 UNION ALL SELECT 'line', into_key, count(*) FROM lineitem JOIN k ON p_partkey = l_partkey GROUP BY 2""")
def rekeyed_items(spark, sf_dir):  # M-10
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    rows, moved = upkeep.rekeyed(p, line, "p_partkey", ["p_name"], "l_partkey", {"p_size": "max"}, "p_size")
    per = moved.groupBy(F.col("l_partkey").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.lit("item").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("n")).union(per.select(F.lit("line"), "id", "n"))


@query("""WITH k AS (SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1999-01-01')) SELECT 'orders' AS name, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM k UNION ALL SELECT 'lines', count(*), CAST(sum(l_orderkey) AS BIGINT) FROM lineitem WHERE l_orderkey IN (FROM k)""")
def purge_cascade(spark, sf_dir):  # M-12
    old = (F.col("o_orderstatus") == "F") & (F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz"))
    line = table(spark, sf_dir, "lineitem").withColumn("o_orderkey", F.col("l_orderkey"))
    orders, lines = upkeep.purged(table(spark, sf_dir, "orders"), "o_orderkey", old, line)
    total = lambda df, name: df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))
    return total(orders, "orders").union(total(lines, "lines"))


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN 'remove' WHEN value < 10 THEN 'exclude' ELSE 'upsert' END AS change FROM events""")
def change_triage(spark, sf_dir):  # I-10
    return upkeep.triaged(table(spark, sf_dir, "events"), F.col("event_type") == "error", F.coalesce(F.col("value") < 10, F.lit(False))).select("event_id", "change")


@query("""SELECT user_id, count(*) FILTER (event_type <> 'purchase') AS n, count(*) FILTER (event_type = 'purchase') AS sent, count(*) FILTER (event_type <> 'purchase') > 0 AND count(*) FILTER (event_type = 'purchase') > 0 AS replied FROM events GROUP BY 1""")
def two_source_census(spark, sf_dir):  # A-10, J-02
    e = table(spark, sf_dir, "events")
    return measures.merged_census(e.where("event_type <> 'purchase'"), e.where("event_type = 'purchase'"), "user_id")


@query("""SELECT event_type AS template, count(*) AS n, round(avg(coalesce(value, 0) / 1000), 3) AS confidence FROM events GROUP BY 1""")
def template_confidence(spark, sf_dir):  # A-15
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("template")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.coalesce("value", F.lit(0.0)) / 1000), 3).alias("confidence"))


@query("""SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS counts FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1""")
def nested_counts(spark, sf_dir):  # A-16
    out = measures.nested_counts(table(spark, sf_dir, "events"), ["user_id"], "event_type")
    return out.select("user_id", F.array_join(F.transform(F.map_entries("counts"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",").alias("counts"))


@query("""SELECT user_id, count(*) AS n, arg_max(event_type, (ts, event_id)) AS reason, epoch_us(max(ts)) AS last FROM events WHERE value < 50 GROUP BY 1""")
def escalation_queue(spark, sf_dir):  # A-24, J-19
    e = table(spark, sf_dir, "events").where("value < 50").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    return measures.escalations(e, "user_id", "event_type", "at", "event_id")


@query("""WITH s AS (SELECT user_id, 'k' || CAST(json_extract_string(props, '$.k') AS INTEGER) % 7 AS reason FROM events UNION ALL SELECT user_id, event_type FROM events WHERE value < 20)
SELECT reason, count(*) AS n, count(DISTINCT user_id) AS users FROM s GROUP BY 1""")
def skip_noise(spark, sf_dir):  # A-25, X-33: what a fetch skipped stands in an array of each report
    k = F.concat(F.lit("k"), (F.get_json_object("props", "$.k").cast("int") % 7).cast("string"))
    reports = table(spark, sf_dir, "events").select("user_id", F.array_compact(F.array(k, F.when(F.col("value") < 20, F.col("event_type")))).alias("skipped"))
    return measures.skip_counts(reports, "skipped", "user_id")


@query("""SELECT c_custkey AS entity, count(o_orderkey) AS n_orders, max(CASE WHEN user_id IS NULL THEN 0 ELSE 1 END) AS in_events FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN (SELECT DISTINCT user_id FROM events) ON user_id = c_custkey GROUP BY 1""")
def cross_store_entities(spark, sf_dir):  # J-22
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"))
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("entity")).agg(F.count(F.lit(1)).alias("n_orders"))
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("entity"), F.lit(1).alias("in_events")).distinct()
    return c.join(o, "entity", "left").join(e, "entity", "left").select("entity", F.coalesce("n_orders", F.lit(0)).alias("n_orders"), F.coalesce("in_events", F.lit(0)).alias("in_events"))


@query("""SELECT o_orderkey, coalesce(string_agg(l_partkey, ',' ORDER BY l_partkey), '') AS parts FROM orders LEFT JOIN (SELECT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag = 'R') ON l_orderkey = o_orderkey GROUP BY 1""")
def child_lists(spark, sf_dir):  # J-15
    kids = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
    out = measures.child_lists(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", kids, "l_partkey", "parts")
    return out.select("o_orderkey", F.array_join(F.transform("parts", lambda x: x.cast("string")), ",").alias("parts"))


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_discount > 0.09)""")
def wanted_ids(spark, sf_dir):  # J-13, J-14
    ids = table(spark, sf_dir, "lineitem").where("l_discount > 0.09").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(ids, "o_orderkey", "left_semi").select("o_orderkey", "o_totalprice")


@query("""SELECT user_id AS actor, bool_or(member) AS member FROM (SELECT c_custkey AS user_id, true AS member FROM customer WHERE c_custkey % 7 = 0 UNION ALL SELECT DISTINCT user_id, false FROM events) GROUP BY 1""")
def members_and_actors(spark, sf_dir):  # U-06
    members = table(spark, sf_dir, "customer").where("c_custkey % 7 = 0").select(F.col("c_custkey").alias("actor"), F.lit(True).alias("member"))
    actors = table(spark, sf_dir, "events").select(F.col("user_id").alias("actor"), F.lit(False).alias("member")).distinct()
    return members.union(actors).groupBy("actor").agg(F.bool_or("member").alias("member"))


@query("""WITH f AS (SELECT user_id, event_type, min(event_id) AS i FROM events GROUP BY 1, 2) SELECT user_id, string_agg(event_type, ',' ORDER BY i) AS kinds FROM f GROUP BY 1""")
def ordered_distinct(spark, sf_dir):  # U-07
    e = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("i"))
    return e.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "event_type"))), lambda x: x["event_type"]), ",").alias("kinds"))


@query("""WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS v FROM orders WHERE o_orderkey % 5 > 0), b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN 'X' ELSE o_orderstatus END AS v FROM orders WHERE o_orderkey % 7 > 0)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'add' WHEN b.k IS NULL THEN 'remove' ELSE 'replace' END AS op, a.v AS old, b.v AS new FROM a FULL JOIN b ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v""")
def structural_diff(spark, sf_dir):  # U-08
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"))
    return incremental.changes_of(o.where("k % 5 > 0"), o.where("k % 7 > 0").withColumn("v", F.when(F.col("k") % 4 == 0, "X").otherwise(F.col("v"))), "k", "v")


@query("""SELECT event_id FROM events WHERE (event_type = 'view' OR CASE WHEN value < 20 THEN 'small' ELSE 'large' END = 'view') AND ts BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-20'
UNION ALL SELECT event_id FROM events WHERE (event_type = 'small' OR CASE WHEN value < 20 THEN 'small' ELSE 'large' END = 'small') AND ts BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-20'""")
def type_or_kind(spark, sf_dir):  # F-08, F-04, F-11
    e = table(spark, sf_dir, "events").withColumn("kind", F.when(F.col("value") < 20, "small").otherwise("large"))
    at = F.col("ts").between(F.lit("2024-01-02").cast("timestamp_ntz"), F.lit("2024-01-20").cast("timestamp_ntz"))
    of = lambda asked: e.where(at & ((F.col("event_type") == asked) | (F.col("kind") == asked) if asked else F.lit(False))).select("event_id")  # noqa: E731  a name of nobody finds nothing
    return of("view").union(of("small")).union(of(None))
