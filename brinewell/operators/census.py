"""Senders, actors and shares: classes by ratios, labels by prefix, summaries of permissions, references between messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Labels that score a message, and classes that score its sender.
LABEL_SCORE = {"IMPORTANT": 3, "STARRED": 3, "CATEGORY_PERSONAL": 2, "SENT": 2, "INBOX": 1}
CLASS_SCORE = {"human": 4, "service-transactional": 2, "service-notification": 1, "unknown": 1, "marketing": 0}
BULK = r"(?i)^(no-?reply|news(letter)?|marketing|promo|info|hello|deals)[@+.-]|@(news|mail|email|e|promo)\."


def sender_class(address: Column, n: Column, promo: Column, updates: Column, personal: Column, social: Column, transactional: Column, replied: Column) -> Column:
    """struct(class, evidence) of a sender from shares of its messages; the first rule that fits."""
    bulk = address.rlike(BULK)
    of = lambda c, why: F.struct(F.lit(c).alias("class"), F.lit(why).alias("evidence"))
    return (
        F.when(replied & (promo < 0.5), of("human", "written to"))
        .when((personal > 0.5) & (n <= 20) & ~bulk, of("human", "personal, low volume"))
        .when(promo > 0.6, of("marketing", "promotions"))
        .when((transactional > 0.4) & (promo < 0.3), of("service-transactional", "transactional subjects"))
        .when((updates > 0.6) & bulk, of("service-notification", "updates, bulk address"))
        .when(social > 0.6, of("service-notification", "social"))
        .when(bulk, of("marketing", "bulk address"))
        .otherwise(of("unknown", "no rule"))
    )


def message_score(klass: Column, labels: Column, hints: Column, hint_score: dict[str, int] | None = None) -> Column:
    """The sender's class, the labels and the hints, added up."""
    of = lambda table, c, default=0: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in table.items() for x in p]), c), F.lit(default))
    add = lambda table, arr: F.aggregate(F.coalesce(arr, F.array().cast("array<string>")), F.lit(0), lambda a, x: a + of(table, x))
    return of(CLASS_SCORE, klass, 1) + add(LABEL_SCORE, labels) + add(hint_score or {"pdf": 2, "doc": 2, "sheet": 1, "large": 2}, hints)


def longest_prefix(df: DataFrame, value: str, prefixes: DataFrame, longest: int = 6) -> DataFrame:
    """df with the label of the longest prefix of `value`; prefixes(prefix, label)."""
    tries = F.explode(F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda k: F.left(F.col(value), k)))
    found = df.select(value).distinct().select(value, tries.alias("prefix")).join(prefixes, "prefix")
    best = found.groupBy(F.col(value).alias("_v")).agg(F.max_by("label", F.length("prefix")).alias("label"))
    return df.join(best, F.col(value) == F.col("_v"), "left").drop("_v")


def sharing(permissions: Column, owner: str) -> Column:
    """private, shared, domain, link or public of array<struct<type, role, discoverable, deleted>>."""
    live = F.filter(permissions, lambda p: ~F.coalesce(p["deleted"], F.lit(False)))
    has = lambda f: F.exists(live, f)
    return (
        F.when(has(lambda p: (p["type"] == "anyone") & F.coalesce(p["discoverable"], F.lit(False))), "public")
        .when(has(lambda p: p["type"] == "anyone"), "link")
        .when(has(lambda p: p["type"] == "domain"), "domain")
        .when(has(lambda p: p["role"] != owner), "shared")
        .otherwise("private")
    )


def with_freshness(df: DataFrame, synced: str, now: int, stale_after: int, *group: str) -> DataFrame:
    """One row, or one a group: the last sync, its age in seconds and whether it is stale."""
    last = df.groupBy(*group).agg(F.max(synced).alias("synced_at"))
    age = F.lit(now) - F.col("synced_at")
    return last.select(*group, "synced_at", age.alias("age"), (F.col("synced_at").isNull() | (age > stale_after)).alias("is_stale"))


def reply_targets(messages: DataFrame, known: DataFrame, id: str, subject: str, references: str, tag: str = r"\[#([0-9]+)\]") -> DataFrame:  # noqa: A002
    """(id, request): the request that a message answers, by the tag in its subject, else by the last of its references that is known(message, request)."""
    by_tag = F.nullif(F.regexp_extract(subject, tag, 1), F.lit(""))
    refs = messages.select(id, F.posexplode(F.regexp_extract_all(references, F.lit("<([^>]+)>"), 1)).alias("_i", "message")).join(known, "message")
    by_ref = refs.groupBy(id).agg(F.max_by("request", "_i").alias("_r"))
    return messages.join(by_ref, id, "left").select(id, F.coalesce(by_tag.try_cast("long"), F.col("_r").cast("long")).alias("request"))


def occurrences(instances: DataFrame, masters: DataFrame, overrides: DataFrame) -> DataFrame:
    """Instances with their override's start, summary and status where there is one, and the end from its own or the master's duration.

    instances(series, instance, start), masters(series, duration, summary),
    overrides(instance, start, end, summary, status).
    """
    o = overrides.select("instance", F.col("start").alias("_s"), F.col("end").alias("_e"), F.col("summary").alias("_t"), F.col("status").alias("_st"), F.lit(True).alias("_o"))
    j = instances.join(masters, "series", "left").join(o, "instance", "left")
    start = F.coalesce("_s", "start")
    return j.select("series", "instance", start.alias("start"), F.coalesce(F.col("_e"), start + F.col("duration")).alias("end"), F.coalesce("_t", "summary").alias("summary"), F.coalesce("_st", F.lit("confirmed")).alias("status"), F.coalesce("_o", F.lit(False)).alias("is_override"))


def first_ids(df: DataFrame, group: list[str], id: str, most: int = 5) -> DataFrame:  # noqa: A002
    """(group, ids): the least ids of each group."""
    w = Window.partitionBy(*group).orderBy(id)
    top = df.select(*group, id).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most)
    return top.groupBy(*group).agg(F.array_sort(F.collect_list(id)).alias("ids"))


def resolved_actor(people: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(ask) with person_id and how it matched: id, last digits of the phone (4 or more), name, first word; null if none or several.

    people(person_id, phone, name).
    """
    p = people.withColumns({"_n": F.lower("name"), "_w": F.substring_index(F.lower("name"), " ", 1)})
    keys = F.array(
        F.struct(F.lit(1).alias("k"), F.col("person_id").cast("string").alias("v")),
        F.struct(F.lit(3).alias("k"), F.col("_n").alias("v")),
        F.struct(F.lit(4).alias("k"), F.col("_w").alias("v")),
    )
    ends = F.transform(F.sequence(F.lit(4), F.greatest(F.length("phone"), F.lit(4))), lambda n: F.struct(F.lit(2).alias("k"), F.right(F.col("phone"), n).alias("v")))
    index = p.select("person_id", F.explode(F.array_distinct(F.concat(keys, ends))).alias("x")).select("person_id", "x.k", "x.v")
    hits = wanted.select("ask", F.lower(F.trim("ask")).alias("v")).join(index, "v").groupBy("ask", "k").agg(F.count_distinct("person_id").alias("n"), F.min("person_id").alias("person_id"))
    best = hits.groupBy(F.col("ask").alias("_a")).agg(F.min_by(F.struct("k", "n", "person_id"), "k").alias("b"))
    return wanted.join(best, F.col("ask") == F.col("_a"), "left").select(*wanted.columns, F.when(F.col("b.n") == 1, F.col("b.person_id")).alias("person_id"), F.when(F.col("b.n") == 1, F.element_at(F.array(F.lit("id"), F.lit("phone"), F.lit("name"), F.lit("first word")), F.col("b.k"))).alias("matched"))
