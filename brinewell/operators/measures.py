"""Aggregates of censuses, ratings, lanes and purchase histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ranked_share(groups: DataFrame, key: str, n: str) -> DataFrame:
    """groups (a row each) with rank, cum and coverage from the most frequent on; ties by key.

    Groups are binned by their count (the rarest, which are most, also by a
    stretch of their keys). Bins are summed first and the running sums go over
    one bin at a time, so no task sees all groups; there are at most some
    thousand bins.
    """
    count, low = F.col(n), 16
    level = F.when(count <= low, count).otherwise(low + 1 + F.floor((F.log2(count.cast("double")) - 4) * 8)).cast("int")
    if isinstance(groups.schema[key].dataType, T.NumericType):
        ends = groups.agg(F.min(key).alias("_lo"), F.max(key).alias("_hi")).withColumn("_one", F.lit(1))
        g = groups.withColumn("_one", F.lit(1)).join(F.broadcast(ends), "_one").withColumn("_at", F.floor((F.col(key) - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1.0) * 128).cast("int")).drop("_one", "_lo", "_hi")
    else:
        # borders: the keys of the 127 least hashes, an even draw from all keys whatever they begin with
        drawn = groups.where(count <= low).select(F.col(key).alias("_k"), F.xxhash64(key).alias("_h")).where("_k IS NOT NULL").orderBy("_h", "_k").limit(127)
        borders = drawn.agg(F.array_sort(F.collect_set("_k")).alias("_borders")).withColumn("_one", F.lit(1))
        g = groups.withColumn("_one", F.lit(1)).join(F.broadcast(borders), "_one").withColumn("_at", F.size(F.filter("_borders", lambda b: b <= F.col(key)))).drop("_one", "_borders")
    g = g.withColumn("_bin", F.struct(level.alias("l"), F.when(count <= low, F.coalesce("_at", F.lit(-1))).otherwise(0).alias("c"))).drop("_at")
    per = g.groupBy("_bin").agg(F.sum(n).alias("_s"), F.count(F.lit(1)).alias("_k"))
    whole = Window.partitionBy(F.lit(1)).orderBy(F.col("_bin.l").desc(), F.col("_bin.c"))
    before = whole.rowsBetween(Window.unboundedPreceding, -1)
    starts = per.select("_bin", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s0"), F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_k0"), F.sum("_s").over(Window.partitionBy(F.lit(1))).alias("_total"))
    w = Window.partitionBy("_bin").orderBy(count.desc(), key)
    j = g.join(F.broadcast(starts), "_bin")
    cum = F.col("_s0") + F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = j.withColumn("rank", (F.col("_k0") + F.row_number().over(w)).cast("long")).withColumn("cum", cum.cast("long"))
    return out.withColumn("coverage", F.col("cum") / F.col("_total")).drop("_bin", "_s0", "_k0", "_total")


def coverage_curve(ranked: DataFrame, marks=(0.5, 0.8, 0.95)) -> DataFrame:
    """(mark, n): the fewest groups that reach each share."""
    ends = ranked.agg(*[F.min(F.when(F.col("coverage") >= m, F.col("rank"))).alias(f"m{i}") for i, m in enumerate(marks)], F.count(F.lit(1)).alias("all"))
    rows = F.array(*[F.struct(F.lit(float(m)).alias("mark"), F.coalesce(F.col(f"m{i}"), F.col("all")).cast("long").alias("n")) for i, m in enumerate(marks)])
    return ends.select(F.explode(rows).alias("r")).select("r.mark", "r.n")


def top_per_group(df: DataFrame, group: list[str], value: str, most: int) -> DataFrame:
    """(group, value, n, rank) of the most frequent values of each group; ties by value."""
    counted = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*group).orderBy(F.col("n").desc(), value)
    return counted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def zero_filled(counts: DataFrame, domain: DataFrame, key: str, n: str = "n") -> DataFrame:
    """Counts over a fixed domain, 0 where there are none."""
    return domain.join(counts, key, "left").withColumn(n, F.coalesce(n, F.lit(0)))


def shrunk_mean(total: Column, n: Column, prior: float = 4.2, weight: float = 10.0) -> Column:
    """A mean pulled towards a prior that weighs as much as `weight` votes."""
    return (F.lit(prior * weight) + total) / (F.lit(weight) + n)


def confusion(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n) of two lanes' classes."""
    return pairs.groupBy(F.col(a).alias("lane_a"), F.col(b).alias("lane_b")).agg(F.count(F.lit(1)).alias("n"))


def calibration(pairs: DataFrame, confidence: str, agree: Column) -> DataFrame:
    """(decile, n, agreed) by stated confidence."""
    decile = F.least(F.lit(9), F.floor(F.col(confidence) * 10)).cast("int")
    return pairs.groupBy(decile.alias("decile")).agg(F.count(F.lit(1)).alias("n"), F.count_if(agree).alias("agreed"))


def purchase_history(events: DataFrame, product: list[str], at: str) -> DataFrame:
    """(product, times, first, last, interval): interval is the mean gap in days, null below two purchases; `at`: microseconds."""
    h = events.groupBy(*product).agg(F.count(F.lit(1)).alias("times"), F.min(at).alias("first"), F.max(at).alias("last"))
    return h.withColumn("interval", F.when(F.col("times") > 1, (F.col("last") - F.col("first")) / 86_400_000_000 / (F.col("times") - 1)))


def due(history: DataFrame, present: DataFrame, product: list[str], now: int, slack: float = 1.0, least: int = 2) -> DataFrame:
    """Products that are usually bought again by now and aren't on the list, with elapsed and overdue days."""
    elapsed = (F.lit(now) - F.col("last")) / 86_400_000_000
    out = history.where(F.col("times") >= least).join(present.select(*product).distinct(), product, "left_anti").withColumn("elapsed", elapsed)
    return out.where(F.col("elapsed") >= F.col("interval") * slack).withColumn("overdue", F.col("elapsed") - F.col("interval"))


def runs(df: DataFrame, partition: list[str], order: list[str], same: list[str]) -> DataFrame:
    """df with `run`: the number of the adjacent rows that agree on `same`, within a partition."""
    w = Window.partitionBy(*partition).orderBy(*order)
    new = F.lit(False)
    for c in same:
        new = new | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    first = F.row_number().over(w) == 1
    return df.withColumn("run", F.sum((new | first).cast("int")).over(w))


def sample_per_stratum(df: DataFrame, stratum: str, id: str, total: int, strata: int, seed: str) -> DataFrame:  # noqa: A002
    """max(1, total // strata) rows of each stratum, the first by a seeded hash of the id."""
    key = F.md5(F.concat(F.lit(seed), F.lit(":"), F.col(id).cast("string")))
    w = Window.partitionBy(stratum).orderBy(key, id)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= max(1, total // strata)).drop("_rn")


def sample(df: DataFrame, id: str, total: int, seed: str) -> DataFrame:  # noqa: A002
    """`total` rows, the first by a seeded hash of the id."""
    return df.orderBy(F.md5(F.concat(F.lit(seed), F.lit(":"), F.col(id).cast("string"))), id).limit(total)


def label_ratios(messages: DataFrame, sender: str, labels: str, wanted: dict[str, str]) -> DataFrame:
    """Per sender: n and the share of messages that carry each label; wanted: label -> column."""
    share = [F.avg(F.array_contains(labels, label).cast("double")).alias(name) for label, name in wanted.items()]
    return messages.groupBy(sender).agg(F.count(F.lit(1)).alias("n"), *share)


def mode_of(df: DataFrame, group: list[str], value: str, accept: Column | None = None) -> DataFrame:
    """(group, value): the most frequent value, by value on ties, among those accepted where there are any."""
    counted = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    liked = F.lit(0) if accept is None else F.when(accept, 0).otherwise(1)
    best = F.min_by(F.col(value), F.struct(liked, -F.col("_n"), F.col(value)))
    return counted.groupBy(*group).agg(best.alias(value))


def merged_census(received: DataFrame, sent: DataFrame, key: str) -> DataFrame:
    """One row a key of either source: what came in (n), what went out (sent), and whether both did (replied)."""
    a = received.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    b = sent.groupBy(key).agg(F.count(F.lit(1)).alias("sent"))
    j = a.join(b, key, "full")
    return j.select(key, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("sent", F.lit(0)).alias("sent"), (F.col("n").isNotNull() & F.col("sent").isNotNull()).alias("replied"))


def nested_counts(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, counts): a map from each value to its number of rows; counted before the maps are made."""
    per = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    return per.groupBy(*group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(value, "_n")))).alias("counts"))


def skip_counts(reports: DataFrame, skipped: str, who: str) -> DataFrame:
    """(reason, n, users) over the arrays of reasons that reports hold; null and empty arrays count nothing."""
    return reports.select(who, F.explode(skipped).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(who).alias("users"))


def escalations(df: DataFrame, sender: str, reason: str, at: str, id: str) -> DataFrame:  # noqa: A002
    """(sender, n, reason, last): how many rows wait of each sender, and the reason of the last."""
    return df.groupBy(sender).agg(F.count(F.lit(1)).alias("n"), F.max_by(F.col(reason), F.struct(at, id)).alias("reason"), F.max(at).alias("last"))


def child_lists(parents: DataFrame, key: str, children: DataFrame, value: str, name: str) -> DataFrame:
    """parents with an array of their children's values, in order; gathered before the join, empty where there are none."""
    lists = children.groupBy(key).agg(F.array_sort(F.collect_list(value)).alias(name))
    return parents.join(lists, key, "left").withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))
