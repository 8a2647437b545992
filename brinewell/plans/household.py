"""Queries on shared lists: stores, walks, statistics, due products, trips, contacts and shares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinewell import api
from brinewell.operators import household as hh
from brinewell.operators.lists import LAYOUTS
from brinewell.plans.answers import _told
from brinewell.plans.lists import WALK
from brinewell.plans.registry import query
from brinewell.session import table

SUPERMARKET = "[" + ", ".join(f"'{s}'" for s in LAYOUTS["supermarket"]) + "]"
#: What the log of events says of lists: 7 groups of 5 stores, products by key.
LOG = "log AS (SELECT event_id, user_id % 7 AS group_id, 'Store ' || user_id % 5 AS store, CAST(json_extract_string(props, '$.k') AS INTEGER) AS product, 'item ' || CAST(json_extract_string(props, '$.k') AS INTEGER) % 30 AS name, user_id, CASE event_type WHEN 'purchase' THEN 'trip_purchased' ELSE event_type END AS action, epoch_us(ts) AS \"at\" FROM events)"


def _log(spark, sf_dir: str) -> DataFrame:
    u, k = F.col("user_id"), F.get_json_object("props", "$.k").cast("int")
    action = F.when(F.col("event_type") == "purchase", hh.BOUGHT).otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", (u % 7).alias("group_id"), F.concat(F.lit("Store "), (u % 5).cast("string")).alias("store"), k.alias("product"), F.concat(F.lit("item "), (k % 30).cast("string")).alias("name"), u.cast("string").alias("actor"), action.alias("action"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))


STATS = f"""{LOG}, h AS (SELECT group_id, store, product, max(name) AS name, count(*) AS times, min("at") AS first, max("at") AS last FROM log WHERE action = 'trip_purchased' GROUP BY 1, 2, 3),
st AS (SELECT *, CASE WHEN times > 1 AND last > first THEN round((last - first) / (times - 1) / 86400000000, 1) END AS interval FROM h)"""


@query(f"WITH {STATS} SELECT * FROM st")
def household_stats(spark, sf_dir):  # P-16 stats
    return hh.product_stats(_log(spark, sf_dir), ["group_id", "store", "product"])


NOW_US = 1_709_251_200_000_000  # 2024-03-01


@query(f"""WITH {STATS}, d AS (SELECT *, round(({NOW_US} - last) / 86400000000, 1) AS elapsed FROM st WHERE times >= 2)
SELECT *, round(elapsed - interval, 1) AS overdue, CASE WHEN name IN (SELECT 'item ' || p_partkey % 30 FROM part WHERE p_partkey % 30 < 12) THEN {WALK}[CAST(substr(name, 6) AS INTEGER) % 14 + 1] ELSE 'other' END AS section
FROM d WHERE elapsed >= interval * 1.5 AND (group_id, store, product) NOT IN (SELECT group_id, store, product FROM log WHERE action = 'click')""")
def household_due(spark, sf_dir):  # P-16 due, W-05
    log = _log(spark, sf_dir)
    product = ["group_id", "store", "product"]
    k = F.col("p_partkey") % 30
    sections = table(spark, sf_dir, "part").where(k < 12).select(F.concat(F.lit("item "), k.cast("string")).alias("name"), F.get(F.array(*map(F.lit, LAYOUTS["warehouse"])), (k % 14).cast("int")).alias("section"))
    return hh.due_products(hh.product_stats(log, product), log.where("action = 'click'"), product, sections, NOW_US, slack=1.5)


@query(f"""WITH i AS (SELECT l_orderkey, l_linenumber, l_suppkey AS store, p_name || ' ' || p_partkey AS name, l_quantity / 4 AS q, CASE WHEN l_linenumber % 3 = 0 THEN 'kg' ELSE '' END AS unit, CASE WHEN l_discount > 0.05 THEN 'on sale' END AS note, {WALK}[CAST(p_size % 16 AS INTEGER) + 1] AS section FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag <> 'R'),
t AS (SELECT *, CASE WHEN q = floor(q) THEN CAST(CAST(q AS BIGINT) AS VARCHAR) ELSE printf('%g', q) END AS n FROM i)
SELECT store, l_orderkey, l_linenumber, coalesce(section, 'other') AS section, coalesce(list_position(CASE WHEN store % 2 = 0 THEN {WALK} ELSE {SUPERMARKET} END, section), 14)::INTEGER AS pos,
name || CASE WHEN n = '1' AND unit = '' THEN '' ELSE ' x' || n || CASE WHEN unit <> '' THEN ' ' || unit ELSE '' END END || CASE WHEN note IS NOT NULL THEN ' (' || note || ')' ELSE '' END AS line FROM t""")
def household_list(spark, sf_dir):  # P-16 list, S-05, X-40
    named = F.concat_ws(" ", "p_name", "p_partkey")
    p = table(spark, sf_dir, "part")
    sections = p.select(named.alias("name"), F.get(F.array(*map(F.lit, LAYOUTS["warehouse"])), (F.col("p_size") % 16).cast("int")).alias("section")).where("section IS NOT NULL")
    line = table(spark, sf_dir, "lineitem").join(p.select(F.col("p_partkey").alias("l_partkey"), named.alias("name")), "l_partkey")
    items = line.select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("store"), "name", (F.col("l_quantity") / 4).alias("quantity"), F.when(F.col("l_linenumber") % 3 == 0, "kg").alias("unit"), F.when(F.col("l_discount") > 0.05, "on sale").alias("note"), F.when(F.col("l_returnflag") == "R", "purchased").otherwise("needed").alias("status"))
    stores = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("store"), F.when(F.col("s_suppkey") % 2 == 0, "warehouse").otherwise("supermarket").alias("layout"))
    return hh.walked(items, stores, sections).select("store", "l_orderkey", "l_linenumber", "section", "pos", "line")


@query(f"""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'warehouse' WHEN s_suppkey % 3 = 1 THEN 'supermarket' ELSE 'kiosk' END AS layout, array_to_string(CASE s_suppkey % 3 WHEN 0 THEN {WALK} WHEN 1 THEN {SUPERMARKET} END, ',') AS walk FROM supplier""")
def household_layouts(spark, sf_dir):  # P-16 layout, stores
    k = F.col("s_suppkey") % 3
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(k == 0, "warehouse").when(k == 1, "supermarket").otherwise("kiosk").alias("layout"))
    return hh.layout_orders(s).withColumn("walk", F.array_join("walk", ","))


@query("""WITH t AS (SELECT o_custkey % 40 AS store, o_orderkey, o_orderdate, o_custkey, row_number() OVER (PARTITION BY o_custkey % 40 ORDER BY o_orderdate DESC, o_orderkey DESC)::INTEGER AS place FROM orders)
SELECT store, o_orderkey AS trip_id, CASE WHEN o_custkey % 3 = 0 THEN c_name ELSE '•••' || right('119' || printf('%08d', o_custkey), 4) END AS closed_by, place, count(*) FILTER (l_returnflag = 'R') AS purchased, count(*) FILTER (l_returnflag <> 'R') AS missing
FROM t JOIN customer ON c_custkey = o_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE place <= 5 GROUP BY 1, 2, 3, 4""")
def household_history(spark, sf_dir):  # P-16 history
    phone = lambda c: F.concat(F.lit("+119"), F.format_string("%08d", F.col(c)))
    trips = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("store"), F.col("o_orderkey").alias("trip_id"), F.col("o_orderdate").alias("closed_at"), phone("o_custkey").alias("closed_by"))
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("trip_id"), F.when(F.col("l_returnflag") == "R", "purchased").otherwise("missing").alias("outcome"), F.col("l_partkey").cast("string").alias("name"), F.col("l_quantity").alias("quantity"))
    people = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(phone("c_custkey").alias("actor"), F.col("c_name").alias("name"))
    h = hh.trip_history(trips, items, people, ["store"], 5)
    return h.groupBy("store", "trip_id", "closed_by", "place").agg(F.count_if(F.col("outcome") == "purchased").alias("purchased"), F.count_if(F.col("outcome") == "missing").alias("missing"))


@query(f"""WITH {LOG}, f AS (SELECT * FROM log WHERE group_id = 2 AND store = 'Store 1' AND action = 'click') SELECT event_id, "at", (SELECT count(*) FROM f) > 40 AS truncated FROM f ORDER BY "at" DESC, event_id DESC LIMIT 40""")
def household_events(spark, sf_dir):  # P-16 events
    log = _log(spark, sf_dir)
    return _told(spark, api.list_events(log, 2, store="store 1", action="click", limit=40), log, "event_id", "at")


@query(f"""WITH {LOG}, a AS (SELECT c_custkey, c_custkey % 9 AS group_id, CASE WHEN c_custkey % 4 = 0 THEN 'Corner' END AS named, CASE WHEN c_custkey % 4 = 1 THEN 'Mine ' || c_custkey END AS own FROM customer),
l AS (SELECT group_id, arg_max(store, ("at", event_id)) AS store FROM log WHERE store <> 'Store 4' AND group_id < 5 GROUP BY 1)
SELECT c_custkey, coalesce(named, own, l.store, CASE WHEN a.group_id = 7 THEN 'Only' END) AS chosen, CASE WHEN named IS NOT NULL THEN NULL WHEN own IS NOT NULL THEN 'store_personal_default' WHEN l.store IS NOT NULL THEN 'store_last_touched' WHEN a.group_id = 7 THEN 'store_only' END AS assumption FROM a LEFT JOIN l USING (group_id)""")
def household_store_choice(spark, sf_dir):  # P-08: which store is meant, and what the guess rests on
    log, k = _log(spark, sf_dir), F.col("c_custkey")
    c = table(spark, sf_dir, "customer")
    asks = c.select("c_custkey", (k % 9).alias("group_id"), k.cast("string").alias("actor"), F.when(k % 4 == 0, " Corner ").otherwise(" ").alias("store"))
    people = c.select(k.cast("string").alias("actor"), F.when(k % 4 == 1, F.concat(F.lit("Mine "), k.cast("string"))).alias("default_store"))
    known = log.where("store <> 'Store 4' AND group_id < 5").select("group_id", "store").distinct()
    only = table(spark, sf_dir, "region").where("r_regionkey = 0").select(F.lit(7).cast("long").alias("group_id"), F.lit("Only").alias("store"))
    return hh.chosen_stores(asks, known.union(only), people, log).select("c_custkey", "chosen", "assumption")


@query("""WITH m AS (SELECT c_custkey % 5 + 1 AS g, c_custkey FROM customer WHERE c_acctbal > 3000 UNION ALL SELECT c_custkey % 3 + 1, c_custkey FROM customer WHERE c_acctbal > 6000)
SELECT c_custkey, (SELECT min(g) FROM m WHERE m.c_custkey = c.c_custkey) AS strict, coalesce((SELECT min(g) FROM m WHERE m.c_custkey = c.c_custkey), 9) AS open FROM customer c""")
def acting_groups(spark, sf_dir):  # P-20: the group that a person acts in; nobody is enrolled in group 9, so that default is open
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    actor = k.cast("string").alias("actor")
    m = c.where("c_acctbal > 3000").select((k % 5 + 1).alias("group_id"), actor).union(c.where("c_acctbal > 6000").select(k % 3 + 1, actor))
    strict = hh.acting_groups(c.select("c_custkey", actor), m, 1).withColumnRenamed("group_id", "strict")
    return hh.acting_groups(strict, m, 9).withColumnRenamed("group_id", "open").select("c_custkey", "strict", "open")


PERSON = "person AS (SELECT c_custkey AS k, c_custkey % 7 AS g, '119' || printf('%08d', c_custkey) AS digits, c_mktsegment || ' ' || c_name AS name FROM customer)"


@query(f"""WITH {PERSON}, a AS (SELECT DISTINCT g, CASE k % 4 WHEN 0 THEN '+' || digits WHEN 1 THEN '(' || digits[-5] || ') ' || right(digits, 4) WHEN 2 THEN lower(name) ELSE name.split(' ')[1] END AS ask, CASE k % 4 WHEN 0 THEN digits WHEN 1 THEN right(digits, 5) END AS d, CASE WHEN k % 4 = 2 THEN k END AS whole, CASE WHEN k % 4 = 3 THEN name.split(' ')[1] END AS word FROM person)
SELECT a.g AS group_id, ask, count(*) AS n, min(k) AS first FROM a JOIN person p ON p.g = a.g AND (ends_with(digits, d) OR k = whole OR name.split(' ')[1] = word) GROUP BY 1, 2""")
def actors_named(spark, sf_dir):  # P-07: identifiers, last digits, names, first words
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    digits = F.concat(F.lit("119"), F.format_string("%08d", k))
    p = c.select(k, (k % 7).alias("group_id"), F.concat(F.lit("+"), digits).alias("actor"), digits.alias("d"), F.concat_ws(" ", "c_mktsegment", "c_name").alias("name"))
    said = F.when(k % 4 == 0, F.col("actor")).when(k % 4 == 1, F.concat(F.lit("("), F.substr("d", F.lit(-5), F.lit(1)), F.lit(") "), F.right("d", F.lit(4)))).when(k % 4 == 2, F.lower("name")).otherwise(F.substring_index("name", " ", 1))
    found = hh.actors_named(p.select("group_id", said.alias("ask")), p.where(k % 2 == 0), p.where(k % 2 == 1), p)
    return found.join(p, ["group_id", "actor"]).groupBy("group_id", "ask").agg(F.count(F.lit(1)).alias("n"), F.min("c_custkey").alias("first"))


@query("""SELECT c_custkey % 7 AS group_id, CASE WHEN c_acctbal > 9000 THEN 'owner' ELSE 'member' END AS role, c_custkey::VARCHAR AS actor, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '' END AS name, CASE WHEN c_custkey % 2 = 0 THEN 'pt' ELSE '' END AS lang FROM customer""")
def rosters(spark, sf_dir):  # P-20
    c, actor = table(spark, sf_dir, "customer"), F.col("c_custkey").cast("string").alias("actor")
    m = c.select((F.col("c_custkey") % 7).alias("group_id"), actor, F.when(F.col("c_acctbal") > 9000, "owner").otherwise("member").alias("role"))
    return hh.roster(m, c.where("c_custkey % 2 = 0").select(actor, F.col("c_name").alias("name"), F.lit("pt").alias("lang")))


SHARE = """sh AS (SELECT s_suppkey, s_nationkey, s_name, c_acctbal > 0 AS ok, s_suppkey % 5 > 0 AS own FROM supplier LEFT JOIN customer ON c_custkey = s_suppkey * 3)"""


def _shares(spark, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    s, c = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    stores = s.select(F.col("s_suppkey").alias("store_id"), F.col("s_nationkey").alias("group_id"), F.col("s_name").alias("store"))
    contacts = c.select(F.col("c_name").alias("alias"), F.lit("phone").alias("channel"), F.col("c_custkey").cast("string").alias("target"), (F.col("c_acctbal") > 0).alias("active"))
    k = F.col("s_suppkey")
    asks = s.select(k.alias("share_id"), F.when(k % 5 > 0, F.col("s_nationkey")).otherwise(-1).alias("group_id"), F.upper("s_name").alias("store"), F.concat(F.lit(" customer#"), F.format_string("%09d", k * 3)).alias("contact"))
    line = table(spark, sf_dir, "lineitem")
    items = line.select(F.col("l_suppkey").alias("store_id"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("name"), F.col("l_quantity").alias("quantity"), F.when(F.col("l_tax") > 0.05, "box").otherwise("").alias("unit"), F.lit("soon").alias("note"), F.when(F.col("l_returnflag") == "R", "needed").otherwise("purchased").alias("status"))
    return (*hh.prepared_shares(asks, contacts, stores, items, "2024-03-01"), stores)


@query(f"""WITH {SHARE}, r AS (SELECT * FROM sh WHERE ok AND own), b AS (SELECT s_suppkey, concat_ws('-', l_orderkey, l_linenumber, l_partkey) AS name, CAST(l_quantity AS BIGINT) AS q, l_tax > 0.05 AS box FROM r JOIN lineitem ON l_suppkey = s_suppkey WHERE l_returnflag = 'R')
SELECT s_suppkey AS share_id, 0 AS place, 'Grocery list — ' || s_name || ' — 2024-03-01' AS line FROM r
UNION ALL SELECT s_suppkey, row_number() OVER (PARTITION BY s_suppkey ORDER BY name, line), line FROM (SELECT *, '- ' || name || CASE WHEN q = 1 AND NOT box THEN '' ELSE ' × ' || q || CASE WHEN box THEN ' box' ELSE '' END END || ' — soon' AS line FROM b)
UNION ALL SELECT s_suppkey, 1, '(No items needed)' FROM r WHERE s_suppkey NOT IN (SELECT s_suppkey FROM b)""")
def share_lines(spark, sf_dir):  # P-20: lists rendered for allow-listed contacts
    return _shares(spark, sf_dir)[1]


@query(f"""WITH {SHARE}, t AS (SELECT *, CASE WHEN NOT coalesce(ok, false) THEN 'not allow-listed' WHEN NOT own THEN 'unknown store' ELSE 'ready' END AS status FROM sh)
SELECT s_suppkey AS share_id, status, CASE WHEN status = 'ready' THEN (s_suppkey * 3)::VARCHAR END AS target, CASE WHEN status = 'ready' AND s_suppkey % 2 = 0 THEN s_suppkey + 100 END AS delivered_at FROM t""")
def share_deliveries(spark, sf_dir):  # P-20: deliveries confirmed by their own group only
    shares, _, stores = _shares(spark, sf_dir)
    k = F.col("share_id")
    confirmed = shares.select("share_id", F.when(k % 2 == 0, F.col("group_id")).otherwise(-2).alias("group_id"), (k + 100).alias("at"))
    d = hh.delivered(shares, stores, confirmed).select("share_id", "delivered_at")
    return shares.join(d, "share_id").select("share_id", "status", "target", "delivered_at")
