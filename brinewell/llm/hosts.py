"""Operator 3: URL filters by rules and empirical-Bayes host reputation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinewell.llm.common import ascii_lower, without
from brinewell.session import cut

#: Rules as (host, path, verdict), and common public suffixes of two labels, where no table of them is given.
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
TWO_LABELS = ("ac.uk", "co.jp", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "net.au", "org.au", "org.uk")
#: The posterior bound's normal quantile, the bad share it must pass, and the least and most pages a prior weighs.
Z, BAD_SHARE, LEAST, MOST = 1.645, 0.5, 1.0, 1000.0


def url_host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    rest = F.substring_index(F.regexp_replace(F.regexp_replace(_rest(url), r"(?s)[?#].*", ""), r"(?s)^([^/]*)/.*", "$1"), "/", 1)
    return ascii_lower(rest)


def url_path(url: Column) -> Column:
    """From the host's end up to ? # or the end; empty without ://."""
    return F.regexp_replace(F.regexp_replace(_rest(url), r"(?s)[?#].*", ""), r"(?s)^[^/]*", "")


def _rest(url: Column) -> Column:
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, "://")
    return F.when(at > 0, F.substr(u, at + 3)).otherwise("")


def registered(hosts: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """hosts with suffix, the longest public suffix that the host ends in (its last label where none does), and domain, one label more.

    suffixes: a table with a column suffix (``co.uk``, without wildcards); by
    default TWO_LABELS. A host is dealt to its own endings, so the match is an
    equi-join of distinct hosts.
    """
    if suffixes is None:
        suffixes = hosts.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, TWO_LABELS))).alias("suffix"))
    listed = suffixes.select(F.lower("suffix").alias("_end")).distinct()
    deepest = listed.agg(F.max(F.size(F.split("_end", r"\.", -1)))).first()[0] or 1  # labels of the longest suffix: longer endings match none
    ends = hosts.select("host", F.explode(F.sequence(F.lit(1), F.lit(deepest))).alias("_labels")).where(F.col("_labels") <= F.length("host") - F.length(F.translate("host", ".", "")) + 1)
    ends = ends.withColumn("_end", F.expr("substring_index(host, '.', -_labels)"))
    best = ends.join(listed, "_end").groupBy("host").agg(F.max("_labels").alias("_labels"))
    out = hosts.join(best, "host", "left").withColumn("_labels", F.coalesce("_labels", F.lit(1)))
    return out.withColumns({"suffix": F.expr("substring_index(host, '.', -_labels)"), "domain": F.expr("substring_index(host, '.', -(_labels + 1))")}).drop("_labels")


def _rule(host: Column, path: Column, rules) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null where none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _strength(df: DataFrame) -> DataFrame:
    """How many pages the level above weighs in this one: method of moments over its groups.

    df: n, bad and m (the parent's mean) of each group. The spread of the groups'
    shares beyond binomial noise gives the between-group variance t, and
    m (1 - m) / t - 1 is the beta prior's a + b.
    """
    v = F.col("m") * (1 - F.col("m"))
    s = df.where("n > 0").agg(
        F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("m"), 2)).alias("s"),
        F.sum(v).alias("noise"),
        F.sum(F.col("n")).alias("total"),
        F.sum(F.col("n") * v).alias("nv"),
    )
    t = (F.col("s") - F.col("noise")) / F.col("total")
    raw = F.when(t > 0, F.col("nv") / F.col("total") / t - 1).otherwise(MOST)
    return s.select(F.least(F.greatest(F.coalesce(raw, F.lit(MOST)), F.lit(LEAST)), F.lit(MOST)).alias("w"), F.lit(1).alias("one"))


def _shrunk(df: DataFrame, strength: DataFrame) -> DataFrame:
    """df with its posterior's a and b; the one-row strength joins by a constant key."""
    out = df.withColumn("one", F.lit(1)).join(F.broadcast(strength), "one").drop("one")
    return out.withColumn("a", F.col("bad") + F.col("w") * F.col("m")).withColumn("b", F.col("n") - F.col("bad") + F.col("w") * (1 - F.col("m"))).drop("w")


def reputation(outcomes: DataFrame, z: float = Z, bad_share: float = BAD_SHARE, suffixes: DataFrame | None = None) -> DataFrame:
    """Per host of outcomes(host, bad): n, n_bad, bad_mean, bad_bound and blocked.

    bad: 1, 0 or null (page without a label; it only names its host). Suffixes
    shrink towards the overall share, registered domains towards their suffix,
    hosts towards their domain, each by a beta-binomial prior whose weight comes
    from the data. A host is blocked when the lower bound of its share of bad
    pages, mean - z deviations of the posterior, is above bad_share. (A normal
    bound: Spark has no quantile of the beta distribution among its functions.)
    Each level is written once; the levels above the hosts are small, and their
    measured size lets Spark broadcast them.
    """
    hosts = cut(outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")), "hosts-counts")
    hosts = cut(registered(hosts, suffixes), "hosts")
    domains = cut(hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "hosts-domains")
    tops = cut(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "hosts-suffixes")
    overall = tops.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 0.5) / (F.coalesce(F.sum("n"), F.lit(0)) + 1.0)).alias("m"), F.lit(1).alias("one"))

    level = tops.withColumn("one", F.lit(1)).join(F.broadcast(overall), "one").drop("one")
    level = _shrunk(level, _strength(level)).select("suffix", (F.col("a") / (F.col("a") + F.col("b"))).alias("m"))
    level = cut(domains.join(level, "suffix"), "hosts-domains")
    level = _shrunk(level, _strength(level)).select("suffix", "domain", (F.col("a") / (F.col("a") + F.col("b"))).alias("m"))
    level = cut(hosts.join(level, ["suffix", "domain"]), "hosts")
    level = _shrunk(level, _strength(level))
    total = F.col("a") + F.col("b")
    mean = F.col("a") / total
    bound = mean - z * F.sqrt(mean * (1 - mean) / (total + 1))
    return level.select("host", "n", F.col("bad").alias("n_bad"), mean.alias("bad_mean"), bound.alias("bad_bound"), (bound > bad_share).alias("blocked"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, url: str = "url", page_id: str = "page_id", rules=RULES, z: float = Z, bad_share: float = BAD_SHARE, suffixes: DataFrame | None = None) -> DataFrame:
    """Adds host, path, rule, verdict, bad_mean and bad_bound to every page.

    outcomes: page_id and bad (boolean); several outcomes of a page count as bad
    if one is. The longest fitting rule decides, else the host's reputation.
    suffixes: a table of public suffixes (see ``registered``).

    A null url, or one without ://, has an empty host and path and is judged as
    the host ''; null page ids take no outcome; repeated pages are judged each
    (and count each towards their host); without any outcome every host keeps
    the prior and is allowed; an empty table stays empty; input columns called
    as an output are replaced.
    """
    added = ("host", "path", "rule", "verdict", "bad_mean", "bad_bound")
    p = without(pages, *added).withColumns({"host": url_host(F.col(f"`{url}`")), "path": url_path(F.col(f"`{url}`"))})
    seen = outcomes.where(F.col("page_id").isNotNull() & F.col("bad").isNotNull()).groupBy("page_id").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    known = p.select(F.col(f"`{page_id}`").alias("page_id"), "host").join(seen, "page_id", "left").select("host", "bad")
    rep = cut(reputation(known, z, bad_share, suffixes).select("host", "blocked", "bad_mean", "bad_bound"), "hosts-reputation")
    rule = _rule(F.col("host"), F.col("path"), rules)
    out = p.join(rep, "host", "left").withColumn("_r", rule)
    return out.withColumns({"rule": F.col("_r.rule"), "verdict": F.coalesce(F.col("_r.verdict"), F.when(F.col("blocked"), "block").otherwise("allow"))}).drop("_r", "blocked")


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    """Every page's host, path, fitting rule and verdict; outcomes are the labels of the same id."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return judge_urls(pages, outcomes).select("page_id", "host", "path", "rule", "verdict")
