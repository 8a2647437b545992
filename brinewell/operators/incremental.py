"""Incremental runs that equal a full one: by ingestion time, with late rows found by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinewell.session import cut

OVERLAP = 2 * 86_400


def to_process(source: DataFrame, seen: DataFrame, id: str, synced: str, floor: int | None, overlap: int = OVERLAP) -> DataFrame:  # noqa: A002
    """Rows synced at or after the floor less the overlap, and rows of any age whose id no run has seen.

    The mark is on ingestion time: rows about old events that arrive late are
    new to it. Without a floor everything is processed.
    """
    if floor is None:
        return source
    changed = source.where(F.col(synced) >= floor - overlap)
    missed = source.where(F.col(synced) < floor - overlap).join(seen.select(id).distinct(), id, "left_anti")
    return changed.unionByName(missed)


def superseded(prior: DataFrame, fresh: DataFrame, processed: DataFrame, live: DataFrame, id: str) -> DataFrame:  # noqa: A002
    """Prior rows without those of processed ids or of ids the source lost, and the fresh rows."""
    kept = prior.join(processed.select(id).distinct(), id, "left_anti").join(live.select(id).distinct(), id, "left_semi")
    return kept.unionByName(fresh)


def next_floor(source: DataFrame, synced: str, floor: int | None) -> int | None:
    """The largest ingestion time read; the mark never goes back."""
    top = source.agg(F.max(synced)).first()[0]
    return floor if top is None else max(top, floor or top)


def incremental_run(source: DataFrame, prior: DataFrame | None, seen: DataFrame | None, id: str, synced: str, floor: int | None, extract) -> DataFrame:  # noqa: A002
    """The extracted rows after this run: equal to extract(source) whatever the runs before it were."""
    if prior is None or seen is None or floor is None:
        return extract(source)
    todo = to_process(source, seen, id, synced, floor)
    return superseded(prior, extract(todo), todo, source, id)


def reconciled(stored: DataFrame, live: DataFrame, key: list[str]) -> DataFrame:
    """(key, change): added, dropped or kept, of two sets of keys."""
    a = stored.select(*key).distinct().withColumn("_a", F.lit(True))
    b = live.select(*key).distinct().withColumn("_b", F.lit(True))
    j = a.join(b, key, "full")
    return j.select(*key, F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "dropped").otherwise("kept").alias("change"))


def to_retry(attempts: DataFrame, id: str, status: str, most: int = 3) -> DataFrame:  # noqa: A002
    """Ids that aren't done: no ok or skipped attempt, no permanent failure, fewer than `most` failures."""
    s = F.col(status)
    per = attempts.groupBy(id).agg(F.count_if(s.isin("ok", "skipped", "permanent")).alias("_done"), F.count_if(s == "failed").alias("failures"))
    return per.where((F.col("_done") == 0) & (F.col("failures") < most)).select(id, "failures")


def changes_of(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, op, old, new) between two flattened objects: add, remove or replace."""
    j = old.select(F.col(key), F.col(value).alias("old"), F.lit(True).alias("_o")).join(new.select(F.col(key), F.col(value).alias("new"), F.lit(True).alias("_n")), key, "full")
    op = F.when(F.col("_o").isNull(), "add").when(F.col("_n").isNull(), "remove").otherwise("replace")
    return j.where(F.col("_o").isNull() | F.col("_n").isNull() | ~F.col("old").eqNullSafe(F.col("new"))).select(key, op.alias("op"), "old", "new")


def touched_keys(stored: DataFrame, fresh: DataFrame, changed: DataFrame, keys: list[str], id: str) -> DataFrame:  # noqa: A002
    """The keys whose rows an update changes: those of stored rows of changed ids, and those of the fresh rows."""
    return stored.join(changed.select(id), id, "left_semi").select(*keys).unionByName(fresh.select(*keys)).distinct()


def _on(keys: list[str], right: DataFrame) -> tuple[DataFrame, Column]:
    """right with its keys renamed, and the condition that they are the same, null with null."""
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return right.select(*[F.col(k).alias(f"_{k}") for k in keys]), on


def relinked(rows: DataFrame, linked: DataFrame, source: DataFrame, seen: DataFrame, id: str, synced: str, floor: int, keys: list[str], extract, link, overlap: int = OVERLAP) -> tuple[DataFrame, DataFrame, DataFrame]:  # noqa: A002
    """(rows, linked, touched) after this run: as a full run over the source would give them, at the cost of the keys that changed.

    rows, linked: what the last run stored, extracted rows and link(rows);
    seen: every id that it processed. Rows of ids that are read again or that
    the source lost make their keys touched, and so do fresh rows. Only the
    touched keys' rows are linked again; the other keys' links are taken over
    as they are, because link works on each key's rows alone. Null keys are a
    key. Ids and ingestion times must not be null; of an id whose rows moved to
    another key, both keys are touched.
    """
    start = floor - overlap
    # one join tells the ids that came late and those that went; of both there are few
    both = source.select(id, F.col(synced).alias("_synced")).join(seen.select(id).distinct().withColumn("_seen", F.lit(True)), id, "full")
    moved = both.where(F.col("_synced").isNull() | (F.col("_seen").isNull() & (F.col("_synced") < start)))
    moved = cut(moved.select(id, F.col("_synced").isNull().alias("_gone")), "incremental-moved")
    late = source.where(F.col(synced) < start).join(moved.where("NOT _gone").select(id), id, "left_semi")
    todo = cut(source.where(F.col(synced) >= start).unionByName(late), "incremental-todo")
    changed = cut(todo.select(id).unionByName(moved.where("_gone").select(id)).distinct(), "incremental-changed")
    fresh = extract(todo)
    touched = cut(touched_keys(rows, fresh, changed, keys, id), "incremental-keys")
    renamed, same = _on(keys, touched)
    kept = rows.join(changed, id, "left_anti")
    again = link(cut(kept.join(renamed, same, "left_semi").unionByName(fresh), "incremental-rows"))
    return kept.unionByName(fresh), linked.join(renamed, same, "left_anti").unionByName(again), touched
