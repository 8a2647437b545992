"""Queries on bounds, local days, store walks and trips."""

from __future__ import annotations

from pyspark.sql import functions as F

from brinewell.operators import lists, names, times
from brinewell.plans.registry import query
from brinewell.session import table

NOW = "2024-01-15 02:30:00"  # 23:30 of the day before in Sao Paulo


@query("""WITH b AS (SELECT * FROM (VALUES ('today', TIMESTAMP '2024-01-14 03:00:00', TIMESTAMP '2024-01-15 03:00:00'), ('yesterday', TIMESTAMP '2024-01-13 03:00:00', TIMESTAMP '2024-01-14 03:00:00'), ('12h', TIMESTAMP '2024-01-14 14:30:00', TIMESTAMP '2024-01-15 03:00:00'),
('7d', TIMESTAMP '2024-01-08 02:30:00', TIMESTAMP '2024-01-15 03:00:00'), ('2w', TIMESTAMP '2024-01-01 02:30:00', TIMESTAMP '2024-01-15 03:00:00'), ('2024-01-10', TIMESTAMP '2024-01-10 03:00:00', TIMESTAMP '2024-01-11 03:00:00')) t(bound, since, until))
SELECT bound, count(event_id) AS n, min(event_id) AS first_event FROM b LEFT JOIN events ON ts >= since AND ts < until GROUP BY 1""")
def relative_bounds(spark, sf_dir):  # X-22, F-03
    zone, now = "America/Sao_Paulo", F.lit(NOW).cast("timestamp")
    ends = {"today": "today", "yesterday": "yesterday", "2024-01-10": "2024-01-10"}
    at = F.col("ts").cast("timestamp")
    e = table(spark, sf_dir, "events")
    inside = [F.when((at >= times.bound(b, zone, now)) & (at < times.bound(ends.get(b, "today"), zone, now, end=True)), F.lit(b)) for b in ("today", "yesterday", "12h", "7d", "2w", "2024-01-10")]
    return e.select("event_id", F.explode(F.array_compact(F.array(*inside))).alias("bound")).groupBy("bound").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


@query("""SELECT o_orderkey, o_orderdate + INTERVAL 9 HOUR - INTERVAL 3 MONTH AS since, o_orderdate + INTERVAL 9 HOUR + INTERVAL 12 MONTH AS until, o_orderdate + to_months(CAST(o_orderkey % 5 AS INTEGER)) AS later FROM orders""")
def calendar_months(spark, sf_dir):  # X-23
    since, until = times.sync_window(F.col("o_orderdate") + F.expr("INTERVAL 9 HOUR"))
    later = times.shifted(F.col("o_orderdate"), (F.col("o_orderkey") % 5).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", since.alias("since"), until.alias("until"), later.alias("later"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'timed' ELSE 'all_day' END AS kind, CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate + INTERVAL 1 HOUR WHEN o_orderkey % 3 = 0 THEN o_orderdate - INTERVAL 9 HOUR ELSE o_orderdate END AS order_ts,
CASE WHEN o_orderkey % 4 > 0 THEN CAST(o_orderdate AS DATE) + greatest(CAST(o_orderkey % 3 AS INTEGER) - 1, 0) END AS last_day FROM orders""")
def time_specs(spark, sf_dir):  # X-24
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    zone = F.when(k % 3 == 0, "Asia/Tokyo").when(k % 3 == 1, "UTC").otherwise("Nowhere/Unknown")
    spec = times.time_spec(F.when(k % 4 > 0, day), (F.col("o_orderdate") + F.expr("INTERVAL 1 HOUR")).cast("timestamp"), zone, F.date_add(day, (k % 3).cast("int")))
    return table(spark, sf_dir, "orders").withColumn("s", spec).select("o_orderkey", "s.kind", F.col("s.order_ts").cast("timestamp_ntz").alias("order_ts"), "s.last_day")


@query("""WITH c AS (SELECT event_id AS instance, ts - INTERVAL 3 HOUR AS s, ts - INTERVAL 3 HOUR + to_hours(CAST(event_id % 40 AS INTEGER)) AS t FROM events WHERE event_type = 'view'), d AS (SELECT DISTINCT CAST(ts - INTERVAL 3 HOUR AS DATE) AS day FROM events)
SELECT CAST(strftime(day, '%Y%m%d') AS BIGINT) AS probe, count(*) AS n, min(instance) AS first_instance FROM d JOIN c ON s < CAST(day + INTERVAL 1 DAY AS TIMESTAMP) AND (t > CAST(day AS TIMESTAMP) OR s >= CAST(day AS TIMESTAMP)) GROUP BY 1""")
def day_matches(spark, sf_dir):  # J-11
    zone, e = "America/Sao_Paulo", table(spark, sf_dir, "events").withColumn("start", F.col("ts").cast("timestamp"))
    day = e.select(times.local_day(F.col("start"), zone).alias("day")).distinct()
    probes = day.select(F.date_format("day", "yyyyMMdd").cast("long").alias("probe"), "day")
    cal = e.where("event_type = 'view'").select(F.col("event_id").alias("instance"), "start", (F.col("start") + F.make_dt_interval(F.lit(0), (F.col("event_id") % 40).cast("int"))).alias("end"))
    return times.day_matches(probes, cal, zone).groupBy("probe").agg(F.count(F.lit(1)).alias("n"), F.min("instance").alias("first_instance"))


WALK = "['household', 'personal_care', 'baby', 'pet', 'snacks', 'pantry', 'beverages', 'bakery', 'produce', 'butcher', 'seafood', 'dairy', 'frozen', 'other']"


@query(f"""WITH p AS (SELECT p_partkey, p_name, {WALK}[CAST(p_size % 16 AS INTEGER) + 1] AS section, p_size, p_size / 8 AS q FROM part) SELECT p_partkey, coalesce(list_position({WALK}, section), 14) AS pos, upper(p_name[1]) || p_name[2:] AS display,
CASE WHEN q = floor(q) THEN CAST(CAST(q AS BIGINT) AS VARCHAR) ELSE printf('%g', q) END AS quantity, row_number() OVER (PARTITION BY section ORDER BY p_name, p_partkey) AS place FROM p""")
def store_walk(spark, sf_dir):  # S-05, S-06, X-40
    sections = F.array(*[F.lit(s) for s in lists.LAYOUTS["warehouse"]])
    p = table(spark, sf_dir, "part").withColumn("section", F.get(sections, (F.col("p_size") % 16).cast("int")))
    p = lists.folded_rank(p.withColumn("_n", F.concat_ws(" ", "p_name", F.format_string("%09d", F.col("p_partkey")))), ["section"], "_n")
    marked = F.concat(F.lit(" - "), F.regexp_replace("p_name", " ", "  "), F.lit(" ,"))
    return p.select("p_partkey", lists.walk_position(F.col("section"), "warehouse").alias("pos"), lists.display_name(marked).alias("display"), lists.quantity_text(F.col("p_size") / 8).alias("quantity"), F.col("rank").alias("place"))


@query("""WITH a AS (SELECT * FROM (VALUES ('Red'), ('blue ring'), ('gadget'), ('Small  Bolt')) t(ask)) SELECT ask, p_partkey FROM a JOIN part ON (lower(regexp_replace(ask, ' +', ' ')) || ' ') = left(p_name || ' ', length(regexp_replace(ask, ' +', ' ')) + 1) OR (ask = 'gadget' AND p_name LIKE '% widget')""")
def item_matches(spark, sf_dir):  # P-06
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"))
    # widgets and gadgets are one product
    spelled = p.withColumn("canonical", F.when(F.col("name").rlike(" (gadget|widget)$"), "gadget"))
    spelled = spelled.withColumn("canonical", F.when(F.col("name").endswith(" widget"), F.col("canonical")))
    asked = spark.createDataFrame([("Red", None), ("blue ring", None), ("gadget", "gadget"), ("Small  Bolt", None)], "ask string, canonical string")
    return lists.item_matches(spelled, asked, "p_partkey")


#: Spellings of two products and of a word.
SPELLED = [("ring", "ring"), ("anel", "ring"), ("hot plate", "plate"), ("chapa", "plate"), ("azul", "blue"), ("blue", "blue")]
ASKS = ["ring", "Aneis", "red widgets", "Brand 7 extra", "anel (azul)", "chapa", "Special Edition", "the blue ring of brand 7 extra large", "nothing here", "12", ""]


@query("""WITH n AS (SELECT p_partkey, p_name, p_partkey % 3 AS k, CASE WHEN p_brand = 'Brand#7' AND p_type = 'LARGE' THEN 1 ELSE 0 END AS b FROM part),
h AS (
  SELECT a AS ask, p_partkey, true AS guarded FROM n, (VALUES ('ring'), ('Aneis')) t(a) WHERE p_name LIKE '% ring'
  UNION ALL SELECT 'red widgets', p_partkey, false FROM n WHERE k = 2 AND p_name = 'red widget'
  UNION ALL SELECT 'Brand 7 extra', p_partkey, false FROM n WHERE k = 1 AND b = 1
  UNION ALL SELECT 'chapa', p_partkey, p_name <> 'hot plate' FROM n WHERE p_name LIKE CASE k WHEN 2 THEN 'hot plate' ELSE '% plate' END
  UNION ALL SELECT 'Special Edition', p_partkey, false FROM n WHERE k = 2
  UNION ALL SELECT 'the blue ring of brand 7 extra large', p_partkey, false FROM n WHERE k = 1 AND b = 1 AND p_name = 'blue ring')
SELECT ask, p_partkey, guarded, count(*) OVER (PARTITION BY ask) = 1 AND NOT guarded AS sure FROM h""")
def partial_names(spark, sf_dir):  # X-19, P-08
    k = F.col("p_partkey") % 3
    extra = F.when((F.col("p_brand") == "Brand#7") & (F.col("p_type") == "LARGE"), " Extra Large").otherwise("")
    name = F.when(k == 0, F.col("p_name")).when(k == 1, F.concat(F.upper("p_name"), F.lit(" ("), F.col("p_brand"), extra, F.lit(")"))).otherwise(F.concat(F.initcap("p_name"), F.lit("s (special édition)")))
    p = table(spark, sf_dir, "part").select("p_partkey", name.alias("name"))
    asked = spark.createDataFrame([(a,) for a in ASKS], "ask string")
    return lists.partial_names(p, asked, "p_partkey", spark.createDataFrame(SPELLED, "spelling string, canonical string"))


def _items(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    return line.groupBy(F.col("l_orderkey").alias("store"), F.col("l_partkey").alias("item")).agg(F.when(F.max(F.col("l_returnflag") == "R"), "purchased").otherwise("asked").alias("status"))


ITEMS = "i AS (SELECT l_orderkey AS store, l_partkey AS item, bool_or(l_returnflag = 'R') AS bought FROM lineitem GROUP BY 1, 2)"


@query(f"""WITH {ITEMS} SELECT store, count(*) FILTER (bought AND store % 3 = 0) AS purchased, count(*) FILTER (NOT bought AND store % 3 = 0) AS missing, count(*) FILTER (NOT bought OR store % 3 > 0) AS open_items, count(*) FILTER (NOT bought AND store % 3 = 0) AS needed, count(*) AS reopened FROM i GROUP BY 1""")
def trips(spark, sf_dir):  # M-15
    items = _items(spark, sf_dir)
    closing = items.select("store").distinct().where("store % 3 = 0").select("store", (F.col("store") * 10).alias("trip_id"))
    archive, left = lists.closed_trip(items, "store", closing)
    again = lists.reopened_trip(left, archive, ["store", "item"])
    zero = F.lit(0).cast("long")
    parts = [
        archive.select("store", (F.col("outcome") == "purchased").cast("long").alias("purchased"), (F.col("outcome") == "missing").cast("long").alias("missing"), zero.alias("open_items"), zero.alias("needed"), zero.alias("reopened")),
        left.select("store", zero, zero, F.lit(1).cast("long"), (F.col("status") == "needed").cast("long"), zero),
        again.select("store", zero, zero, zero, zero, F.lit(1).cast("long")),
    ]
    return parts[0].union(parts[1]).union(parts[2]).groupBy("store").agg(*[F.sum(c).alias(c) for c in ("purchased", "missing", "open_items", "needed", "reopened")])


@query("""SELECT p_partkey, CASE WHEN p_brand = 'Brand#1' THEN 'learned' WHEN p_name LIKE '% ring' THEN 'curated' ELSE 'other' END AS section FROM part""")
def learned_sections(spark, sf_dir):  # X-18
    p = table(spark, sf_dir, "part")
    learned = p.where("p_brand = 'Brand#1'").select("p_partkey", F.lit("learned").alias("_l"))
    curated = spark.createDataFrame([("ring", "curated")], "term string, _c string")
    head = F.element_at(names.name_tokens(F.col("p_name")), -1)
    j = p.join(learned, "p_partkey", "left").withColumn("term", head).join(curated, "term", "left")
    return j.select("p_partkey", F.coalesce("_l", "_c", F.lit("other")).alias("section"))
