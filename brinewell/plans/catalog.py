"""Catalog queries: fields and classes of documents, amounts, names, links, full-text search, samples, lanes."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinewell.functions import text as fx
from brinewell.operators import measures, names, report, search, textindex
from brinewell.plans.registry import query
from brinewell.session import scratch_root, table
from brinewell.sources.files import stamp


@query("""SELECT doc_id, key, value FROM (
SELECT doc_id, 'email' AS key, unnest(list_distinct_in_order) AS value FROM (SELECT doc_id, list_filter(l, lambda x, i: list_position(l, x) = i)[1:6] AS list_distinct_in_order
FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+') AS l FROM documents))
UNION ALL SELECT doc_id, 'ipv4', unnest(u) FROM (SELECT doc_id, list_filter(l, lambda x, i: list_position(l, x) = i)[1:6] AS u FROM (SELECT doc_id, regexp_extract_all(text, '\\b[0-9]{1,3}(?:\\.[0-9]{1,3}){3}\\b') AS l FROM documents))
UNION ALL SELECT doc_id, 'card', unnest(u) FROM (SELECT doc_id, list_filter(l, lambda x, i: list_position(l, x) = i)[1:6] AS u FROM (SELECT doc_id, regexp_extract_all(text, '\\b[0-9]{16}\\b') AS l FROM documents)))""")
def domain_fields(spark, sf_dir):  # addresses, hosts and cards; a text without a digit or an @ has none
    may = F.contains("text", F.lit("@")) | F.col("text").rlike("[0-9]")
    d = table(spark, sf_dir, "documents").where(may).select("doc_id", F.explode(fx.fields_of(F.col("text"), fx.CONTACTS)).alias("f"))
    return d.select("doc_id", "f.key", "f.value")


#: Classes of documents in order, with their tiers.
CLASSES = [("licence", r"(?i)license|licence|copyright"), ("personal", r"(?i)[a-z0-9._%+-]+@[a-z0-9-]+\.[a-z]|\b[0-9]{16}\b"), ("code", r"(?i)token = \""), ("question", r"\?")]
TIERS = {"licence": 3, "personal": 1, "code": 1, "question": 2}
CASES = "CASE WHEN regexp_matches(t, '(?i)license|licence|copyright') THEN 'licence' WHEN regexp_matches(t, '(?i)[a-z0-9._%+-]+@[a-z0-9-]+\\.[a-z]|\\b[0-9]{16}\\b') THEN 'personal' WHEN regexp_matches(t, '(?i)token = \"') THEN 'code' WHEN regexp_matches(t, '\\?') THEN 'question' END"


def _classified(spark, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    t = F.coalesce("text", F.lit(""))
    return d.select("doc_id", "source", "text", fx.first_rule(t, CLASSES).alias("doc_type")).withColumn("tier", F.coalesce(F.create_map(*[F.lit(x) for p in TIERS.items() for x in p])[F.col("doc_type")], F.lit(3)))


TYPED = f"d AS (SELECT doc_id, source, text, {CASES} AS doc_type FROM (SELECT *, coalesce(text, '') AS t FROM documents)), k AS (SELECT *, CASE doc_type WHEN 'personal' THEN 1 WHEN 'code' THEN 1 WHEN 'question' THEN 2 ELSE 3 END AS tier FROM d)"


@query(f"WITH {TYPED} SELECT coalesce(doc_type, '') AS doc_type, tier, count(*) AS n, count(DISTINCT source) AS sources FROM k GROUP BY 1, 2")
def doc_classify_tier(spark, sf_dir):  # X-10, A-17
    return _classified(spark, sf_dir).groupBy(F.coalesce("doc_type", F.lit("")).alias("doc_type"), "tier").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("sources"))


@query(f"WITH {TYPED} SELECT doc_id, doc_type, CASE WHEN tier >= 3 THEN text END AS excerpt, tier < 3 AS redacted FROM k")
def redact_by_tier(spark, sf_dir):  # F-15
    k = _classified(spark, sf_dir)
    return k.select("doc_id", "doc_type", F.when(F.col("tier") >= 3, F.col("text")).alias("excerpt"), (F.col("tier") < 3).alias("redacted"))


@query("""WITH s AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '$' || printf('%.2f', o_totalprice) WHEN 1 THEN 'R$ ' || replace(printf('%.2f', o_totalprice), '.', ',') WHEN 2 THEN printf('%d', CAST(floor(o_totalprice / 1000) AS BIGINT)) || ',' || '123 USD' ELSE 'none' END AS raw, o_totalprice AS p FROM orders)
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CAST(printf('%.2f', p) AS DOUBLE) WHEN 1 THEN CAST(printf('%.2f', p) AS DOUBLE) WHEN 2 THEN floor(p / 1000) * 1000 + 123 END AS value,
CASE o_orderkey % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'BRL' WHEN 2 THEN 'USD' END AS currency FROM s""")
def amount_parse(spark, sf_dir):  # X-02
    p = F.format_string("%.2f", "o_totalprice")
    thousands = F.concat(F.floor(F.col("o_totalprice") / 1000).cast("string"), F.lit(",123 USD"))
    k = F.col("o_orderkey") % 4
    raw = F.when(k == 0, F.concat(F.lit("$"), p)).when(k == 1, F.concat(F.lit("R$ "), F.replace(p, F.lit("."), F.lit(",")))).when(k == 2, thousands).otherwise("none")
    return table(spark, sf_dir, "orders").select("o_orderkey", fx.parse_amount(raw).alias("a")).select("o_orderkey", "a.value", "a.currency")


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS parsed FROM orders""")
def date_parse(spark, sf_dir):  # X-04: each date written in one of four ways
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
    years = F.date_format(d, "yyyy")
    # years before 2000 have no pattern of their own: those dates come without a year, which the reference row supplies
    old = F.year(d) < 2000
    raw = F.when(old, F.date_format(d, "'due 'MMM d")).when(k == 0, F.date_format(d, "'on 'yyyy-MM-dd")).when(k == 1, F.date_format(d, "M/d/yyyy")).when(k == 2, F.concat(F.date_format(d, "MMMM d, "), years)).otherwise(F.concat(F.date_format(d, "d MMM "), years))
    return table(spark, sf_dir, "orders").select("o_orderkey", fx.parse_date(raw, d).alias("parsed"))


@query("""WITH f AS (SELECT p_partkey AS id, trim(regexp_replace(lower(strip_accents(p_name)), '[^0-9a-z]+', ' ', 'g')) AS key FROM part)
SELECT key, count(*) AS n, min(id) AS first_id FROM f GROUP BY key""")
def fold_key_dedup(spark, sf_dir):  # X-13
    return table(spark, sf_dir, "part").groupBy(fx.fold(F.col("p_name")).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first_id"))


@query("SELECT sha256(coalesce(text, '')) AS sha256, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def content_copies(spark, sf_dir):  # X-32, M-16
    return table(spark, sf_dir, "documents").groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


#: Spellings of products and their one key.
SPELLINGS = [("small ring", "ring"), ("anel pequeno", "ring"), ("red widget", "widget"), ("hot plate", "plate"), ("plate of heat", "plate"), ("gear old", "gear"), ("old gear", "gear")]


@query("""WITH s AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) || 's' WHEN 2 THEN '2 kg of ' || p_name ELSE p_name || ' 500g' END AS name, p_name FROM part)
SELECT p_partkey, name, CASE p_name WHEN 'small ring' THEN 'ring' WHEN 'red widget' THEN 'widget' WHEN 'hot plate' THEN 'plate' WHEN 'old gear' THEN 'gear'
ELSE trim(regexp_replace(lower(name), '[^0-9a-z]+', ' ', 'g')) END AS canonical FROM s""")
def canonical_product(spark, sf_dir):  # X-14, X-15, X-16
    k, n = F.col("p_partkey") % 4, F.col("p_name")
    name = F.when(k == 0, n).when(k == 1, F.concat(F.upper(n), F.lit("s"))).when(k == 2, F.concat(F.lit("2 kg of "), n)).otherwise(F.concat(n, F.lit(" 500g")))
    known = spark.createDataFrame(SPELLINGS, "spelling string, canonical string")
    return names.canonical(table(spark, sf_dir, "part").select("p_partkey", name.alias("name")), "name", known)


@query("""SELECT p_partkey, CASE WHEN p_name LIKE '% plate' THEN CASE WHEN p_name LIKE 'hot %' THEN 'kitchen' ELSE 'table' END WHEN p_name LIKE '% gear' OR p_name LIKE '% bolt' THEN 'tools' END AS section FROM part""")
def section_classify(spark, sf_dir):  # X-17
    terms = spark.createDataFrame([("plate", "table"), ("hot plate", "kitchen"), ("gear", "tools"), ("bolt", "tools")], "term string, section string")
    return names.section_of(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", terms).select("p_partkey", "section")


@query("""SELECT host, count(*) AS n FROM (SELECT regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)), '^www\\.', '') AS host FROM pages)
WHERE host <> '' AND NOT (host = 'example.org' OR host LIKE '%.example.org') GROUP BY host""")
def url_host_filter(spark, sf_dir):  # X-20
    h = table(spark, sf_dir, "pages").select(fx.link_host(F.col("url")).alias("host"))
    skip = (F.col("host") == "example.org") | F.col("host").endswith(".example.org")
    return h.where((F.col("host") != "") & ~skip).groupBy("host").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH l AS (SELECT page_id, unnest(ls) AS href, unnest(range(1, len(ls) + 1)) AS pos FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]+)"', 1) AS ls FROM pages)),
p AS (SELECT *, CASE WHEN href LIKE '/the%' THEN 1 WHEN href LIKE '/a%' THEN 2 ELSE 3 END AS pri FROM l)
SELECT page_id, href, CAST(k AS INTEGER) AS k FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pri, pos) AS k FROM p) WHERE k <= 2""")
def link_pick(spark, sf_dir):  # S-11: two links a page, a feature
    links = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract_all("html", F.lit('<a href="([^"]+)"'), 1).alias("l"))
    keyed = F.transform("l", lambda h, i: F.struct(F.when(h.startswith("/the"), 1).when(h.startswith("/a"), 2).otherwise(3).alias("p"), i.alias("i"), h.alias("h")))
    return links.select("page_id", F.posexplode(F.slice(F.array_sort(keyed), 1, 2)).alias("i", "x")).select("page_id", F.col("x.h").alias("href"), (F.col("i") + 1).alias("k"))


TOKENS = """tok AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(strip_accents(coalesce(text, ''))), '[^a-z0-9ß]+'), lambda t: t <> '')) AS token FROM documents)"""


def kept_index(spark, sf_dir: str) -> textindex.TextIndex:
    """The full-text index of documents in the shared folder: built by the first search, brought up to date where the files changed, else only opened."""
    docs = table(spark, sf_dir, "documents")
    path = f"{scratch_root(spark)}/fts-{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}"
    now = stamp(docs)
    index = textindex.opened(spark, path)
    if index is None:
        return textindex.built(docs, "doc_id", "text", path, now)
    return index if index.stamp == now else textindex.synced(index, docs, "doc_id", "text", now)


@query(f"WITH {TOKENS} SELECT token, count(DISTINCT doc_id) AS n_docs, count(*) AS n_hits FROM tok GROUP BY token")
def fts_index(spark, sf_dir):  # T-08
    return kept_index(spark, sf_dir).postings().groupBy("token").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("tf").alias("n_hits"))


@query(f"WITH {TOKENS} SELECT doc_id, count(*) AS n_hits, count(DISTINCT token) AS n_tokens FROM tok WHERE doc_id % 10 <> 2 GROUP BY doc_id")
def fts_index_upkeep(spark, sf_dir):  # T-08: inserted, changed and deleted documents
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    k = F.col("doc_id") % 10
    path = f"{scratch_root(spark)}/fts-upkeep-{uuid.uuid4().hex}"
    before = textindex.built(docs.where(k != 0).withColumn("text", F.when(k == 1, F.reverse("text")).otherwise(F.col("text"))), "doc_id", "text", path)
    after = textindex.synced(before, docs.where(k != 2), "doc_id", "text")
    return after.postings().groupBy(F.col("id").alias("doc_id")).agg(F.sum("tf").alias("n_hits"), F.count(F.lit(1)).alias("n_tokens"))


@query(f"WITH {TOKENS} SELECT doc_id FROM tok WHERE token IN ('the', 'tion', 'with') GROUP BY doc_id HAVING count(DISTINCT token) = 3")
def fts_and_match(spark, sf_dir):  # T-01, T-02, T-03, J-04
    wanted = search.query_tokens("The +tion; with*")
    return search.match_all(kept_index(spark, sf_dir).postings(wanted), wanted).withColumnRenamed("id", "doc_id")


@query(f"""WITH {TOKENS}, w AS (SELECT doc_id, max(token = 'lice') AND max(token = 'thea') AS a, max(token LIKE 'lice%') AND max(token LIKE 'thea%') AS b, max(token LIKE 'lice%') OR max(token LIKE 'thea%') AS c FROM tok GROUP BY doc_id)
SELECT doc_id, CAST(s AS INTEGER) AS step FROM (SELECT doc_id, 1 AS s FROM w WHERE a UNION ALL SELECT doc_id, 2 FROM w WHERE b AND NOT EXISTS (SELECT 1 FROM w WHERE a)
UNION ALL SELECT doc_id, 3 FROM w WHERE c AND NOT EXISTS (SELECT 1 FROM w WHERE a OR b))""")
def fts_widening(spark, sf_dir):  # T-04
    wanted = ["lice", "thea"]
    return search.widened(kept_index(spark, sf_dir).postings(wanted, prefix=True), wanted).withColumnRenamed("id", "doc_id")


@query(f"""WITH {TOKENS}, p AS (SELECT token, doc_id, count(*) AS tf FROM tok GROUP BY 1, 2), s AS (SELECT doc_id, sum(tf) AS size FROM p GROUP BY 1), c AS (SELECT count(*) AS n, avg(size) AS a FROM s),
d AS (SELECT token, count(*) AS df FROM p WHERE token IN ('license', 'software') GROUP BY 1)
SELECT doc_id, CAST(round(1000 * sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * size / a)))) AS BIGINT) AS score FROM p JOIN d USING (token) JOIN s USING (doc_id), c GROUP BY doc_id""")
def fts_bm25(spark, sf_dir):  # T-05
    wanted = ["license", "software"]
    index = kept_index(spark, sf_dir)
    r = search.ranked(index.postings(wanted), wanted, totals=index.totals())
    return r.select(F.col("id").alias("doc_id"), F.round(F.col("score") * 1000).cast("long").alias("score"))


@query(f"""WITH {TOKENS}, w AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS ws FROM documents WHERE doc_id IN (SELECT doc_id FROM tok WHERE token = 'license')),
h AS (SELECT doc_id, ws, list_transform(ws, lambda x: regexp_replace(lower(strip_accents(x)), '[^a-z0-9ß]+', '', 'g') = 'license') AS hit FROM w),
f AS (SELECT *, greatest(1, coalesce(nullif(list_position(hit, true), 0), 1) - 6) AS a FROM h)
SELECT doc_id, CASE WHEN a > 1 THEN '… ' ELSE '' END || array_to_string(list_transform(range(a, least(a + 12, len(ws) + 1)), lambda i: CASE WHEN hit[i] THEN '[' || ws[i] || ']' ELSE ws[i] END), ' ') || CASE WHEN a + 12 <= len(ws) THEN ' …' ELSE '' END AS snippet FROM f""")
def fts_snippet(spark, sf_dir):  # T-07: the stretch around the first hit
    hits = kept_index(spark, sf_dir).postings(["license"]).select(F.col("id").alias("doc_id"))
    d = textindex.wanted_rows(table(spark, sf_dir, "documents").select("doc_id", "text"), hits, "doc_id")
    return d.select("doc_id", search.snippet(F.col("text"), ["license"]).alias("snippet"))


@query("""SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('s7:' || doc_id), doc_id) AS k FROM documents) WHERE k <= 30""")
def stratified_sample(spark, sf_dir):  # S-09
    return measures.sample_per_stratum(table(spark, sf_dir, "documents"), "lang", "doc_id", 120, 4, "s7").select("doc_id", "lang")


@query("SELECT doc_id, lang FROM documents ORDER BY md5('s7:' || doc_id), doc_id LIMIT 50")
def simple_sample(spark, sf_dir):  # S-10
    return measures.sample(table(spark, sf_dir, "documents"), "doc_id", 50, "s7").select("doc_id", "lang")


LANES = "p AS (SELECT l.doc_id, quality AS a, CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END AS b, least(n_chars, 4000) / 4000.0 AS conf FROM labels l JOIN documents d USING (doc_id))"


def _lanes(spark, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return j.select("doc_id", F.col("quality").alias("a"), F.when(F.col("n_chars") > 1500, 1).otherwise(0).alias("b"), (F.least("n_chars", F.lit(4000)) / 4000.0).alias("conf"))


@query(f"WITH {LANES} SELECT a AS lane_a, b AS lane_b, count(*) AS n FROM p GROUP BY 1, 2")
def confusion_matrix(spark, sf_dir):  # A-19, J-20
    return measures.confusion(_lanes(spark, sf_dir), "a", "b")


@query(f"WITH {LANES} SELECT CAST(least(9, floor(conf * 10)) AS INTEGER) AS decile, count(*) AS n, count(*) FILTER (a = b) AS agreed FROM p GROUP BY 1")
def confusion_calibration(spark, sf_dir):  # A-19
    return measures.calibration(_lanes(spark, sf_dir), "conf", F.col("a") == F.col("b"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 90")
def json_status_filter(spark, sf_dir):  # X-33
    k = F.get_json_object("props", "$.k").try_cast("long")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k")).where("k >= 90")


SENDERS = "'\"' || replace(c_name, '#', ' ') || '\" <' || CASE c_custkey % 4 WHEN 0 THEN 'no-reply@orders.shop' || c_nationkey || '.com' WHEN 1 THEN 'ann' || c_custkey || '@gmail.com' WHEN 2 THEN 'x@mail.shop' || c_nationkey || '.co.uk' ELSE 'nobody' END || '>'"


@query(f"""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'merchant:shop' || c_nationkey || '.com#orders' WHEN 1 THEN 'person:ann' || c_custkey || '@gmail.com' WHEN 2 THEN 'merchant:shop' || c_nationkey || '.co.uk' ELSE 'unknown' END AS key,
replace(c_name, '#', ' ') AS name, CASE c_custkey % 4 WHEN 0 THEN 'merchant' WHEN 1 THEN 'person' WHEN 2 THEN 'merchant' ELSE 'unknown' END AS kind FROM customer""")
def entity_resolve(spark, sf_dir):  # X-05, X-06, X-07, X-08
    c = table(spark, sf_dir, "customer").withColumn("raw", F.expr(SENDERS))
    streams = {f"shop{i}.com": {"orders.": "orders"} for i in range(25)}
    return c.select("c_custkey", fx.entity_of(F.col("raw"), F.lit("unknown"), F.lit(1), streams=streams).alias("e")).select("c_custkey", "e.key", "e.name", "e.kind")



ARTIFACTS = f"""{TYPED}, a AS (SELECT k.doc_id AS id, k.source AS sender, k.doc_type, k.tier, octet_length(encode(coalesce(k.text, ''))) AS bytes, 2015 + k.doc_id % 8 AS year, d.lang AS ext, length(trim(coalesce(k.text, ''))) < 120 AS review FROM k JOIN documents d USING (doc_id)),
f AS (SELECT CASE WHEN turn % 5 = 4 THEN 'failed' ELSE 'ok' END AS status, CASE turn % 3 WHEN 0 THEN 'chrome' WHEN 1 THEN 'oversize' END AS reason, length(text) AS size FROM conversations),
t AS (SELECT count(*)::DOUBLE AS n, (count(*) FILTER (doc_type IS DISTINCT FROM 'question'))::DOUBLE AS docs FROM a),
s AS (SELECT coalesce(sender, '(none)') AS sender, count(*) AS n, count(*) FILTER (doc_type IS DISTINCT FROM 'question') AS docs, sum(bytes) AS bytes FROM a GROUP BY 1),
c AS (SELECT row_number() OVER (ORDER BY n DESC, sender) AS rank, sum(n) OVER (ORDER BY n DESC, sender) / (SELECT n FROM t) AS coverage FROM s)
"""


@query(f"""WITH {ARTIFACTS}
SELECT 'senders' AS section, sender AS label, n, docs AS documents, bytes::BIGINT AS bytes, docs / (SELECT docs FROM t) AS share FROM (SELECT * FROM s ORDER BY docs DESC, n DESC, sender LIMIT 40)
UNION ALL SELECT 'coverage', CAST(m * 100 AS INTEGER) || '%', (SELECT min(rank) FROM c WHERE coverage >= m), NULL, NULL, NULL FROM (SELECT unnest([0.5, 0.8, 0.95])::DOUBLE AS m)
UNION ALL SELECT 'types', coalesce(doc_type, '(none)') || '/T' || tier, count(*), count(*) FILTER (doc_type IS DISTINCT FROM 'question'), sum(bytes)::BIGINT, count(*) / (SELECT n FROM t) FROM a GROUP BY doc_type, tier
UNION ALL SELECT 'years', year::VARCHAR, count(*), count(*) FILTER (doc_type IS DISTINCT FROM 'question'), sum(bytes)::BIGINT, count(*) / (SELECT n FROM t) FROM a GROUP BY year
UNION ALL SELECT 'biggest', id::VARCHAR, 1, NULL, bytes, NULL FROM (SELECT * FROM a WHERE doc_type IS DISTINCT FROM 'question' ORDER BY bytes DESC, id LIMIT 25)
UNION ALL SELECT 'untyped', id::VARCHAR, 1, NULL, bytes, NULL FROM (SELECT * FROM a WHERE doc_type IS NULL ORDER BY bytes DESC, id LIMIT 40)
UNION ALL SELECT 'failures', ext, n, docs, bytes, n / (SELECT n FROM t) FROM (SELECT ext, count(*) AS n, count(*) FILTER (doc_type IS DISTINCT FROM 'question') AS docs, sum(bytes)::BIGINT AS bytes FROM a WHERE review GROUP BY ext ORDER BY n DESC, ext LIMIT 20)
UNION ALL SELECT 'noise', status || '/' || coalesce(reason, '(none)'), count(*), NULL, sum(size)::BIGINT, count(*) / (SELECT count(*)::DOUBLE FROM f) FROM f GROUP BY status, reason
UNION ALL SELECT 'sample', id::VARCHAR, 1, NULL, bytes, NULL FROM (SELECT * FROM a ORDER BY md5('7:' || id), id LIMIT 20)
UNION ALL SELECT 'levers', label, k, NULL, NULL, k / (SELECT n FROM t) FROM (SELECT unnest(['drop question', 'drop under 20000 bytes', 'drop under 50000 bytes', 'drop tier 3', 'drop untyped', 'drop for review']) AS label,
  unnest([count(*) FILTER (doc_type = 'question'), count(*) FILTER (bytes < 20000), count(*) FILTER (bytes < 50000), count(*) FILTER (tier = 3), count(*) FILTER (doc_type IS NULL), count(*) FILTER (review)]) AS k FROM a)""")
def calibration_report(spark, sf_dir):  # P-21, A-17, A-18, A-23
    d = _classified(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    t = F.coalesce("text", F.lit(""))
    artifacts = d.select(F.col("doc_id").alias("id"), F.col("source").alias("sender"), "doc_type", "tier", F.octet_length(t).cast("long").alias("bytes"), (2015 + F.col("doc_id") % 8).alias("year"), F.col("lang").alias("ext"), (F.length(F.trim(t)) < 120).alias("needs_review"))
    c = table(spark, sf_dir, "conversations")
    manifest = c.select(F.when(F.col("turn") % 5 == 4, "failed").otherwise("ok").alias("status"), F.when(F.col("turn") % 3 == 0, "chrome").when(F.col("turn") % 3 == 1, "oversize").alias("reason"), F.length("text").alias("size"))
    return report.calibration_report(artifacts, manifest, body="question", seed="7")
