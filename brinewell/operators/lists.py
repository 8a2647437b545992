"""Shopping lists: store walks, names, trips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brinewell.functions.text import fold
from brinewell.operators.names import CONNECTORS, canonical, product_group
from brinewell.session import cut

#: Sections in the order of a walk through a kind of store.
LAYOUTS = {
    "supermarket": ("produce", "bakery", "butcher", "seafood", "dairy", "frozen", "pantry", "snacks", "beverages", "household", "personal_care", "baby", "pet", "other"),
    "warehouse": ("household", "personal_care", "baby", "pet", "snacks", "pantry", "beverages", "bakery", "produce", "butcher", "seafood", "dairy", "frozen", "other"),
}


def walk_position(section: Column, layout: str) -> Column:
    """The section's place in the walk, from 1; unknown sections come last."""
    order = F.array(*[F.lit(s) for s in LAYOUTS[layout]])
    at = F.array_position(order, F.coalesce(section, F.lit("")))
    return F.when(at > 0, at).otherwise(F.lit(len(LAYOUTS[layout]))).cast("int")


def quantity_text(n: Column) -> Column:
    """Whole numbers without a point, others to six digits without trailing zeros."""
    places = F.greatest(F.lit(0), 5 - F.floor(F.log10(F.abs(n)))).cast("int")
    short = F.round(n * F.pow(F.lit(10.0), places), 0) / F.pow(F.lit(10.0), places)
    return F.when(n == F.floor(n), n.cast("long").cast("string")).otherwise(F.regexp_replace(short.cast("decimal(24,10)").cast("string"), r"\.?0+$", ""))


def display_name(name: Column) -> Column:
    """Without list marks and end punctuation, blanks single, the first letter a capital."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"^[\s\-–—*•]+", ""), r"\s+", " "), r"^[ ,.;]+|[ ,.;]+$", "")
    return F.concat(F.upper(F.left(plain, F.lit(1))), F.substr(plain, F.lit(2)))


def item_matches(names: DataFrame, asked: DataFrame, id: str) -> DataFrame:  # noqa: A002
    """(ask, id) where the canonical names are equal, or the folded name begins with the folded words asked for.

    names(id, name, canonical); asked(ask, canonical). Both are joins on equal
    keys: names are dealt to the beginnings that end at a word.
    """
    same = asked.where("canonical IS NOT NULL").join(names.select(id, "canonical"), "canonical").select("ask", id)
    w = F.split(fold(F.col("name")), " ")
    begun = names.select(id, F.explode(F.transform(F.sequence(F.lit(1), F.size(w)), lambda k: F.array_join(F.slice(w, 1, k), " "))).alias("_b"))
    return same.union(asked.withColumn("_b", fold(F.col("ask"))).where("_b <> ''").join(begun, "_b").select("ask", id)).distinct()


def match_tokens(name: Column) -> Column:
    """Folded words without connecting words and bare numbers."""
    return F.filter(F.split(fold(F.coalesce(name, F.lit(""))), " "), lambda t: (t != "") & ~t.isin(*CONNECTORS) & ~t.rlike("^[0-9]+$"))


def partial_names(names: DataFrame, asked: DataFrame, id: str, spellings: DataFrame) -> DataFrame:  # noqa: A002
    """(ask, id, guarded, sure): the names that an ask without an exact match may mean; sure: only one, and it isn't guarded.

    A name is a candidate if, without its parentheticals, it is the same
    product as the ask; if the ask is one of its parentheticals, usually the
    brand; or if it holds the words of the ask in a row. Words are equal if
    they are the same product by themselves: plurals and the spellings of
    both languages, but no parts of words. A candidate that isn't the same
    product is guarded where the ask is a product of its own, so that "milk"
    isn't taken for "condensed milk".

    names(id, name), asked(ask), spellings(spelling, canonical). An ask's
    first word finds the places where it may begin, by a join on equal keys,
    and the words from there on decide: asks of any length match. Null and
    empty names match nothing; asks without a word give no row; rows that
    repeat an ask count once, rows that repeat an id each; ties are all told.
    """
    asks = asked.select("ask").where("ask IS NOT NULL").distinct()
    texts = names.select("name").where("name IS NOT NULL").distinct()
    brands = texts.select("name", F.explode(F.regexp_extract_all("name", F.lit(r"\(([^()]*)\)"), 1)).alias("line"))
    bare = texts.withColumn("line", F.regexp_replace("name", r"\([^()]*\)", " ")).where(F.size(match_tokens(F.col("line"))) > 0)
    lines = asks.select(F.col("ask").alias("line")).union(texts.select("name")).union(brands.select("line")).distinct()
    words = lines.select("line", F.posexplode(match_tokens(F.col("line"))).alias("_i", "word"))
    # one look-up for words, whole asks and names without parentheticals
    every = words.select(F.col("word").alias("line")).union(asks.select("ask")).union(bare.select("line")).distinct()
    keys = cut(canonical(product_group(every, "line", spellings).withColumnRenamed("group", "_known"), "line", spellings, "_known").withColumn("_known", F.col("_known").isNotNull()), "partial-keys")
    run = F.array_sort(F.collect_list(F.struct("_i", "canonical")))
    classed = words.join(keys.select(F.col("line").alias("word"), "canonical"), "word").groupBy("line").agg(F.transform(run, lambda x: x["canonical"]).alias("classes"))
    classed = cut(classed, "partial-classes")
    spoken = asks.join(classed, F.col("ask") == F.col("line")).select("ask", F.col("classes").alias("_spoken"))

    held = texts.join(classed, F.col("name") == F.col("line")).select("name", "classes", F.posexplode("classes").alias("_i", "_first"))
    runs = held.join(spoken.withColumn("_first", F.get("_spoken", F.lit(0))), "_first").where(F.slice("classes", F.col("_i") + 1, F.size("_spoken")) == F.col("_spoken"))
    whole = brands.join(classed, "line").join(spoken.withColumnRenamed("_spoken", "classes"), "classes")
    asked_keys = spoken.join(keys, F.col("ask") == F.col("line")).select("ask", "canonical", "_known")
    same = bare.join(keys.select("line", "canonical"), "line").join(asked_keys, "canonical")
    hits = runs.select("ask", "name", F.lit(False).alias("_same")).union(whole.select("ask", "name", F.lit(False))).union(same.select("ask", "name", F.lit(True)))
    hits = hits.groupBy("ask", "name").agg(F.max("_same").alias("_same"))
    known = asked_keys.select("ask", "_known")
    guarded = F.col("_known") & ~F.col("_same")
    found = hits.join(known, "ask").select("ask", "name", guarded.alias("guarded")).join(names.select(id, "name"), "name")
    alone = found.groupBy("ask").agg((F.count(F.lit(1)) == 1).alias("_alone"))
    return found.join(alone, "ask").select("ask", id, "guarded", (F.col("_alone") & ~F.col("guarded")).alias("sure"))


def closed_trip(items: DataFrame, store: str, closing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(archive, items) after some stores' trips close: closing(store, trip_id).

    The archive has every item of the trip with its outcome; purchased items
    leave the list, the others are needed again.
    """
    c = closing.select(F.col(store), "trip_id")
    outcome = F.when(F.col("status") == "purchased", "purchased").otherwise("missing")
    archive = items.join(c, store).withColumn("outcome", outcome)
    left = items.join(c.withColumn("_closed", F.lit(True)).drop("trip_id"), store, "left").where(F.col("_closed").isNull() | (F.col("status") != "purchased"))
    return archive, left.withColumn("status", F.when(F.col("_closed"), "needed").otherwise(F.col("status"))).select(*items.columns)


def reopened_trip(items: DataFrame, archive: DataFrame, key: list[str]) -> DataFrame:
    """The list before the trip closed: archived items come back as purchased or needed, in place of what was carried forward."""
    back = archive.withColumn("status", F.when(F.col("outcome") == "purchased", "purchased").otherwise("needed")).select(*items.columns)
    return items.join(archive.select(*key), key, "left_anti").unionByName(back)


def folded_rank(df: DataFrame, group: list[str], name: str) -> DataFrame:
    """df with `rank`, the place within the group by the accent-folded name, then the name itself."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(fold(F.col(name)), name)))
