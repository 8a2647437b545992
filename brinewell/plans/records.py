"""Queries on nested messages, places, series of events, local days, transcripts and run logs."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinewell.functions import speech
from brinewell.functions.text import FIELDS, fields_of
from brinewell.operators import geo, occurrences, times
from brinewell.plans.registry import query
from brinewell.session import cut, scratch_root, table
from brinewell.sources import files, runlog


@query("""SELECT conv_id, turn AS depth, CASE turn % 3 WHEN 0 THEN 'attachment' ELSE 'body' END AS kind, CASE turn % 3 WHEN 0 THEN 'turn-' || turn || '.txt' ELSE '' END AS filename,
octet_length(encode(text)) AS size, sha256(text) AS digest, CASE turn % 3 WHEN 0 THEN 'a' || turn END AS attachment_id FROM conversations""")
def mime_tree(spark, sf_dir):  # IO-13: every turn lies in the part before it
    c = table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    data = F.translate(F.base64(F.col("text").cast("binary")), "+/=\r\n", "-_")
    turn = F.struct("turn", data.alias("data"), F.octet_length("text").alias("size"))
    nested = F.aggregate(
        F.reverse(F.array_sort(F.collect_list(turn))),
        F.lit(""),
        lambda inner, t: F.concat(
            F.lit('{"mimeType":"'), F.when(t["turn"] % 3 == 1, "text/plain").otherwise("text/html"), F.lit('",'),
            F.when(t["turn"] % 3 == 0, F.concat(F.lit('"filename":"turn-'), t["turn"].cast("string"), F.lit('.txt",'))).otherwise(""),
            F.lit('"body":{"size":'), t["size"].cast("string"), F.when(t["turn"] % 3 == 0, F.concat(F.lit(',"attachmentId":"a'), t["turn"].cast("string"), F.lit('"'))).otherwise(""),
            F.lit(',"data":"'), t["data"], F.lit('"},"parts":['), inner, F.lit("]}"),
        ),
    )
    payloads = c.groupBy("conv_id").agg(F.concat(F.lit('{"mimeType":"multipart/mixed","parts":['), nested, F.lit("]}")).alias("payload"))
    parts = files.mime_parts(payloads, "conv_id", "payload")
    return parts.select("conv_id", (F.size("path") - 1).cast("long").alias("depth"), "kind", "filename", "size", F.sha2("content", 256).alias("digest"), "attachment_id")


#: A place for a number, as the tables have none.
LAT, LON = "({k} * 7919 % 12000) / 100.0 - 60", "({k} * 104729 % 36000) / 100.0 - 180"


@query(f"""WITH p AS (SELECT s_suppkey, {LAT.format(k="s_suppkey")} AS lat, {LON.format(k="s_suppkey")} AS lon FROM supplier), o AS (SELECT c_custkey, {LAT.format(k="c_custkey")} AS a, {LON.format(k="c_custkey")} AS b FROM customer),
j AS (SELECT c_custkey, s_suppkey, 2 * 3958.8 * asin(sqrt(pow(sin((radians(lat) - radians(a)) / 2), 2) + cos(radians(a)) * cos(radians(lat)) * pow(sin((radians(lon) - radians(b)) / 2), 2))) AS miles FROM o, p
  WHERE abs(lat - a) <= 250 / 69.0 AND abs(lon - b) <= 250 / (69.0 * greatest(cos(radians(a)), 0.1)))
SELECT c_custkey, s_suppkey, CAST(round(miles * 1000) AS BIGINT) AS mils FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY miles, s_suppkey) AS k FROM j WHERE miles <= 250) WHERE k <= 5""")
def haversine_radius(spark, sf_dir):  # X-21, IO-12: suppliers from a gazetteer of fixed fields, the five nearest within 250 miles of each customer
    s = table(spark, sf_dir, "supplier")
    path = f"{scratch_root(spark)}/gazetteer-{hashlib.sha256((sf_dir + files.stamp(s)).encode()).hexdigest()[:16]}"
    if not files.exists(spark, f"{path}/_SUCCESS"):
        at = [F.expr(e.format(k="s_suppkey")).cast("double") for e in (LAT, LON)]
        s.select("s_suppkey", *[F.lit("-").alias(f"f{i}") for i in range(1, 5)], at[0].alias("lat"), at[1].alias("lon")).write.mode("overwrite").csv(path, sep="\t", header=True)
    places = files.gazetteer(spark, path).select(F.col("key").cast("long").alias("s_suppkey"), "lat", "lon")
    origins = table(spark, sf_dir, "customer").select("c_custkey", *[F.expr(e.format(k="c_custkey")).cast("double").alias(n) for e, n in ((LAT, "lat"), (LON, "lon"))])
    near = geo.within_miles(origins, places, "c_custkey", "s_suppkey", 250.0, 5)
    return near.select("c_custkey", "s_suppkey", F.round(F.col("miles") * 1000).cast("long").alias("mils"))


WEEK = 7 * 86_400
SERIES = f"""m AS (SELECT o_orderkey AS series, epoch(o_orderdate)::BIGINT AS first, 1 + o_orderkey % 6 AS times, 3600 + o_orderkey % 7 AS duration FROM orders),
o AS (SELECT l_orderkey AS series, l_linenumber AS k, min(epoch(l_shipdate)::BIGINT) AS start, bool_or(l_returnflag = 'R') AS cancelled, min(l_tax) AS tax FROM lineitem GROUP BY 1, 2),
x AS (SELECT series, k, first + k * {WEEK} AS original_start, duration FROM (SELECT *, unnest(range(0, times)) AS k FROM m))"""


@query(f"""WITH {SERIES} SELECT x.series, CASE WHEN o.k IS NULL THEN x.series ELSE -(x.series * 10 + x.k) END AS event_id, original_start, coalesce(o.start, original_start) AS start, coalesce(o.start, original_start) + duration AS "end"
FROM x LEFT JOIN o ON o.series = x.series AND o.k = x.k WHERE NOT coalesce(cancelled, false)""")
def series_reexpansion(spark, sf_dir):  # I-12: stored occurrences, then overrides of high taxes come in
    o, line = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    k = F.col("o_orderkey")
    first = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    masters = o.select(k.alias("event_id"), first.alias("first"), F.lit(WEEK).cast("long").alias("every"), (1 + k % 6).alias("times"), (3600 + k % 7).alias("duration"))
    per = line.groupBy(F.col("l_orderkey").alias("series"), F.col("l_linenumber").cast("long").alias("k")).agg(F.min(F.unix_seconds(F.col("l_shipdate").cast("timestamp"))).alias("start"), F.max(F.col("l_returnflag") == "R").alias("cancelled"), F.min("l_tax").alias("tax"))
    overrides = per.join(masters.select(F.col("event_id").alias("series"), "first"), "series")
    overrides = overrides.select((-(F.col("series") * 10 + F.col("k"))).alias("event_id"), "series", (F.col("first") + F.col("k") * WEEK).alias("original_start"), "start", F.lit(None).cast("long").alias("end"), "cancelled", "tax")
    overrides = cut(overrides, "overrides")
    late = F.col("tax") >= 0.07
    stored = cut(occurrences.expanded(masters, overrides.where(~late).drop("tax")), "occurrences")
    return occurrences.reexpanded(stored, masters, overrides.drop("tax"), overrides.where(late).select("event_id"))


ZONES = ("America/Los_Angeles", "UTC", "Asia/Tokyo")


def activity(spark, sf_dir: str) -> DataFrame:
    """events with the text of their local time and its day, in a table partitioned by that day and kept in the shared folder."""
    source = table(spark, sf_dir, "events")
    path = f"{scratch_root(spark)}/activity-{hashlib.sha256((sf_dir + files.stamp(source)).encode()).hexdigest()[:16]}"
    if not files.exists(spark, f"{path}/_SUCCESS"):
        at, zone = F.col("ts").cast("timestamp"), F.element_at(F.array(*map(F.lit, ZONES)), (F.col("user_id") % 3 + 1).cast("int"))
        local = F.from_utc_timestamp(at, zone)
        hours = F.round((F.unix_seconds(local) - F.unix_seconds(at)) / 3600).cast("int")
        offset = F.concat(F.when(hours < 0, "-").otherwise("+"), F.lpad(F.abs(hours).cast("string"), 2, "0"), F.lit(":00"))
        rows = source.select("event_id", "user_id", F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), offset).alias("occurred_at"), local.cast("date").alias("day"))
        rows.repartition("day").write.mode("overwrite").partitionBy("day").parquet(path)
    return spark.read.parquet(path)


@query("SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-09 15:00:00' AND ts < TIMESTAMP '2024-01-11 08:00:00'")
def activity_between(spark, sf_dir):  # F-12: days with a margin from partitions, then the exact instants
    since, until = (F.lit(x).cast("timestamp") for x in ("2024-01-10T00:00:00+09:00", "2024-01-11T00:00:00-08:00"))
    instant = F.to_timestamp("occurred_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    return times.between_instants(activity(spark, sf_dir), "day", instant, since, until).select("event_id", "user_id")


@query("""WITH t AS (SELECT conv_id, turn, turn % 6 AS k, coalesce(text, '') AS text FROM conversations)
SELECT conv_id, turn, CASE WHEN k = 0 THEN 'nothing left' WHEN k = 1 AND conv_id % 2 = 0 THEN 'too little speech for an answer' WHEN k = 1 AND conv_id % 3 = 0 THEN 'answer in an unsure language' WHEN k = 1 THEN NULL
WHEN conv_id % 2 = 0 THEN 'too little speech' WHEN k = 2 AND conv_id % 3 = 0 THEN 'only filler in an unsure language' WHEN k = 3 AND conv_id % 3 = 0 THEN 'a single word in an unsure language' END AS reason,
CASE k WHEN 0 THEN '' WHEN 1 THEN 'Sim, isso mesmo.' WHEN 2 THEN 'Oi, obrigado.' WHEN 3 THEN 'Granola' WHEN 4 THEN 'Buy (2 boxes) of milk, please.' ELSE 'Compra leite, muito obrigado' END AS cleaned FROM t""")
def usable_speech(spark, sf_dir):  # X-35, X-36: the turns as a recogniser might hand them over
    said = [" [Music] (suspiros)  Muito obrigado! ", "♪ Sim, isso mesmo. Legendas por Ana", "(music playing) Oi, obrigado.", "*applause* Granola ლლლ", "Buy (2 boxes) of milk , please. Thanks for watching!", "Compra leite, muito obrigado ((laughs))"]
    c = table(spark, sf_dir, "conversations")
    text = speech.cleaned(F.element_at(F.array(*map(F.lit, said)), (F.col("turn") % 6 + 1).cast("int")))
    ms = F.when(F.col("conv_id") % 2 == 0, 300).otherwise(2000)
    p = F.when(F.col("conv_id") % 3 == 0, 0.3).otherwise(0.95)
    return c.select("conv_id", "turn", speech.let(text, lambda t: F.struct(t.alias("cleaned"), speech.unusable_reason(t, ms, p).alias("reason"))).alias("s")).select("conv_id", "turn", "s.cleaned", "s.reason")


@query("""SELECT 'orders' AS event, unnest(['rows', 'deleted']) AS field, unnest([count(*), count(*) FILTER (o_orderstatus = 'F')]) AS value FROM orders
UNION ALL SELECT 'lines', unnest(['rows', 'skipped', 'pages']), unnest([count(*), count(*) FILTER (l_returnflag = 'R'), max(l_linenumber)::BIGINT]) FROM lineitem""")
def run_log(spark, sf_dir):  # IO-22: counted while the rows are written
    write = lambda df: df.write.format("noop").mode("overwrite").save()
    orders = runlog.observed(table(spark, sf_dir, "orders"), "orders", write, rows=F.count(F.lit(1)), deleted=F.count_if(F.col("o_orderstatus") == "F"))
    lines = runlog.observed(table(spark, sf_dir, "lineitem"), "lines", write, rows=F.count(F.lit(1)), skipped=F.count_if(F.col("l_returnflag") == "R"), pages=F.max("l_linenumber"))
    return runlog.as_table(spark, [("orders", orders), ("lines", lines)])


@query("""SELECT id, key, value FROM (WITH o AS (SELECT o_orderkey AS id, o_orderkey::VARCHAR AS k, lpad(o_orderkey::VARCHAR, 11, '0') AS n, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS usd, strftime(o_orderdate, '%Y-%m-%d') AS d, strftime(o_orderdate, '%d/%m/%Y') AS b FROM orders)
SELECT id, unnest(['cpf', 'rg', 'amount_brl', 'matricula', 'date_iso', 'date_br', 'policy_no', 'student_id', 'order_no', 'envelope_id', 'cnpj']) AS key,
unnest([n[1:3] || '.' || n[4:6] || '.' || n[7:9] || '-' || n[10:11], n[1:9], 'R$ 1.234,56', n[1:6], d, b, 'AB-' || n, n[1:10], 'X' || n, 'ABCDEF01-' || n || '-FF', '12.' || n[1:3] || '.' || n[4:6] || '/0001-99']) AS value FROM o
UNION ALL SELECT id, 'amount_usd', '$' || usd FROM (SELECT id, format('{:,.2f}', CAST(usd AS DOUBLE)) AS usd FROM o)) WHERE key NOT LIKE 'date%' OR value LIKE '%20__-__-__' OR value LIKE '__/__/20__'""")
def document_identifiers(spark, sf_dir):  # X-12: the identifiers of documents in two languages
    n = F.lpad(F.col("o_orderkey").cast("string"), 11, "0")
    part = lambda a, k: F.substr(n, F.lit(a), F.lit(k))
    d = F.col("o_orderdate")
    text = F.concat(
        F.lit("CPF "), part(1, 3), F.lit("."), part(4, 3), F.lit("."), part(7, 3), F.lit("-"), part(10, 2), F.lit("\nrg: nº "), part(1, 9), F.lit(" valor R$ 1.234,56; MATRÍCULA nº "), part(1, 6),
        F.lit("\non "), F.date_format(d, "yyyy-MM-dd"), F.lit(" / "), F.date_format(d, "dd/MM/yyyy"), F.lit("\nApólice # AB-"), n, F.lit("\nStudent id: "), part(1, 10),
        F.lit("\nPedido X"), n, F.lit("\nenvelope ID: ABCDEF01-"), n, F.lit("-FF\nCNPJ 12."), part(1, 3), F.lit("."), part(4, 3), F.lit("/0001-99 total $"), F.format_number("o_totalprice", 2), F.lit("."),
    )
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.explode(fields_of(text, FIELDS)).alias("f")).select("id", "f.key", "f.value")


@query("SELECT kind, p_partkey, p_name || CASE p_partkey % 4 WHEN 0 THEN ', \"x\"' WHEN 1 THEN chr(9) || 'tab' WHEN 2 THEN chr(10) || 'line' ELSE '' END AS name, CASE WHEN p_partkey % 5 > 0 THEN p_retailprice END AS price FROM part, (VALUES ('csv'), ('tsv'), ('jsonl')) t(kind)")
def text_sinks(spark, sf_dir):  # IO-16, IO-04: written as text and read back
    k = F.col("p_partkey")
    more = F.when(k % 4 == 0, ', "x"').when(k % 4 == 1, "\ttab").when(k % 4 == 2, "\nline").otherwise("")
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", more).alias("name"), F.when(k % 5 > 0, F.col("p_retailprice")).alias("price"))
    root, out = f"{scratch_root(spark)}/text-{uuid.uuid4().hex}", []
    for kind in ("csv", "tsv", "jsonl"):
        files.write_text(p, f"{root}/{kind}", kind)
        out.append(files.read_text(spark, f"{root}/{kind}", kind, p.schema).select(F.lit(kind).alias("kind"), "*"))
    return out[0].unionByName(out[1]).unionByName(out[2])
