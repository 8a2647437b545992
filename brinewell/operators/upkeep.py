"""Upserts, merges, deletions and retention of tables that are rewritten whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """Last write wins: the first row of each key in `order`, which must be total."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def upsert(stored: DataFrame, incoming: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """stored with the latest incoming row of each key instead of its own; a null tombstone column comes with the row."""
    new = latest(incoming, key, *order)
    return stored.join(new.select(*key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def insert_missing(stored: DataFrame, incoming: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """stored and the incoming rows of keys that it lacks."""
    return stored.unionByName(latest(incoming, key, *order).join(stored.select(*key), key, "left_anti"), allowMissingColumns=True)


def merged(rows: DataFrame, key: list[str], rules: dict[str, str], version: str) -> DataFrame:
    """One row a key, column by column: max, min, sum, first or last (not null, by `version`)."""
    aggs = []
    for c, how in rules.items():
        given = F.col(c).isNotNull()
        pick = {
            "max": F.max(c),
            "min": F.min(c),
            "sum": F.sum(c),
            "first": F.min_by(F.col(c), F.when(given, F.col(version))),
            "last": F.max_by(F.col(c), F.when(given, F.col(version))),
        }[how]
        aggs.append(pick.alias(c))
    return rows.groupBy(*key).agg(*aggs)


def replace_children(stored: DataFrame, incoming: DataFrame, parents: DataFrame, parent: list[str]) -> DataFrame:
    """The child rows with those of the given parents replaced by the incoming ones, which may be none."""
    return stored.join(parents.select(*parent).distinct(), parent, "left_anti").unionByName(incoming)


def tombstoned(rows: DataFrame, seen: DataFrame, key: list[str], now: Column, deleted: str = "deleted_at") -> DataFrame:
    """rows with `deleted` set to now where the source no longer has the key, and cleared where it has it again."""
    marks = seen.select(*key).distinct().withColumn("_seen", F.lit(True))
    j = rows.join(marks, key, "left")
    return j.withColumn(deleted, F.when(F.col("_seen"), None).otherwise(F.coalesce(F.col(deleted), now))).select(*rows.columns)


def pruned(rows: DataFrame, deleted: str, before: Column) -> DataFrame:
    """Without the rows that were deleted before a moment."""
    return rows.where(F.col(deleted).isNull() | (F.col(deleted) >= before))


def orphans_pruned(parents: DataFrame, *children: tuple[DataFrame, list[str]], keep: Column | None = None) -> DataFrame:
    """Parents with a row in any child table, or those that `keep` holds for."""
    out = parents
    if not children:
        return out
    key = children[0][1]
    used = children[0][0].select(*key)
    for child, k in children[1:]:
        used = used.union(child.select(*k))
    held = parents.join(used.distinct(), key, "left_semi")
    if keep is None:
        return held
    return held.unionByName(parents.where(keep).join(used.distinct(), key, "left_anti"))


def swept(rows: DataFrame, run: str, current: int) -> DataFrame:
    """Only what the current run has marked."""
    return rows.where(F.col(run) >= current)


def blanked(rows: DataFrame, texts: list[str], at: str, before: Column) -> DataFrame:
    """Rows with their texts blanked from a moment on; the rows stay."""
    old = F.coalesce(F.col(at) < before, F.lit(False))
    return rows.withColumns({t: F.when(old, "").otherwise(F.col(t)) for t in texts})


def rekeyed(rows: DataFrame, children: DataFrame, id: str, key: list[str], ref: str, rules: dict[str, str], version: str) -> tuple[DataFrame, DataFrame]:  # noqa: A002
    """Rows merged under a new key, named by their least id, and children pointing at it."""
    named = rows.withColumn("_to", F.min(id).over(Window.partitionBy(*key)))
    out = merged(named, [*key, "_to"], rules, version).withColumnRenamed("_to", id)
    moved = children.join(named.select(F.col(id).alias(ref), "_to"), ref, "left").withColumn(ref, F.coalesce("_to", ref)).drop("_to")
    return out, moved.select(*children.columns)


def content_deduped(rows: DataFrame, content: str, id: str) -> DataFrame:  # noqa: A002
    """The row with the least id of each content, found by its SHA-256."""
    keyed = rows.withColumn("sha256", F.sha2(F.col(content), 256))
    firsts = keyed.groupBy("sha256").agg(F.min(id).alias(id))
    return keyed.join(firsts, ["sha256", id], "left_semi")


def import_decisions(incoming: DataFrame, existing: DataFrame, uid: str, seq: str) -> DataFrame:
    """incoming with `decision`: create, update (same or newer sequence) or ignore."""
    have = existing.groupBy(uid).agg(F.max(seq).alias("_have"))
    d = F.when(F.col("_have").isNull(), "create").when(F.col(seq) >= F.col("_have"), "update").otherwise("ignore")
    return incoming.join(have, uid, "left").withColumn("decision", d).drop("_have")


def receipts(requests: DataFrame, stored: DataFrame, key: list[str], body: str) -> DataFrame:
    """requests with `outcome`: new, replay (same digest) or conflict (another)."""
    have = stored.select(*key, F.col("digest").alias("_have"))
    r = requests.withColumn("digest", F.sha2(F.col(body), 256)).join(have, key, "left")
    return r.withColumn("outcome", F.when(F.col("_have").isNull(), "new").when(F.col("_have") == F.col("digest"), "replay").otherwise("conflict")).drop("_have")


def insert_where(stored: DataFrame, incoming: DataFrame, parents: DataFrame, parent: list[str], key: list[str]) -> DataFrame:
    """stored and the incoming rows whose parent exists and whose key is new."""
    new = incoming.join(parents.select(*parent).distinct(), parent, "left_semi").join(stored.select(*key), key, "left_anti")
    return stored.unionByName(new)


def purged(parents: DataFrame, key: str, old: Column, *children: DataFrame) -> list[DataFrame]:
    """The parents that aren't old, and the rows of each child table that belong to one of them."""
    kept = parents.where(~F.coalesce(old, F.lit(False)))
    return [kept, *[c.join(kept.select(key), key, "left_semi") for c in children]]


def triaged(changes: DataFrame, removed: Column, excluded: Column) -> DataFrame:
    """changes with `change`: remove, exclude (what the source holds but we don't) or upsert."""
    return changes.withColumn("change", F.when(removed, "remove").when(excluded, "exclude").otherwise("upsert"))


def known_anywhere(ids: DataFrame, key: str, *tables: tuple[DataFrame, str]) -> DataFrame:
    """The ids that some table holds, each table with the column that has them; an id in several tables, or several times, comes once a row of ids."""
    held = [t.select(F.col(c).alias(key)) for t, c in tables]
    every = held[0]
    for h in held[1:]:
        every = every.unionByName(h)
    return ids.join(every.distinct(), key, "left_semi")
