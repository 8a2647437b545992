"""Query functions that answer with rows, freshness and a flag of more rows."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from brinewell.operators import search
from brinewell.operators.census import with_freshness
from brinewell.operators.intervals import overlaps
from brinewell.operators.textindex import TextIndex

#: Most rows of an answer.
MOST = 100


class Result(NamedTuple):
    rows: list[Row]
    truncated: bool
    freshness: Row | None = None


def answer(df: DataFrame, limit: int, *order: Column, freshness: DataFrame | None = None) -> Result:
    """The first rows in order; one more than asked for tells whether there are more."""
    n = max(1, min(int(limit), MOST))
    rows = df.orderBy(*order).limit(n + 1).collect()
    return Result(rows[:n], len(rows) > n, freshness.first() if freshness is not None else None)


def _narrowed(df: DataFrame, equal: dict[str, object], since: tuple[str, object] | None, until: tuple[str, object] | None) -> DataFrame:
    """Only the filters that were given; ranges are half open."""
    for c, v in equal.items():
        if v is not None:
            df = df.where(F.col(c).isin(*v) if isinstance(v, (list, tuple, set)) else F.col(c) == v)
    if since and since[1] is not None:
        df = df.where(F.col(since[0]) >= since[1])
    if until and until[1] is not None:
        df = df.where(F.col(until[0]) < until[1])
    return df


def search_messages(messages: DataFrame, index: DataFrame, text: str = "", sender: str | None = None, labels: list[str] | None = None, since: int | None = None, until: int | None = None, limit: int = 20, now: int | None = None, stale_after: int = 36 * 3600) -> Result:
    """Live messages by words, part of the sender, all of some labels and time; the newest first."""
    df = _narrowed(messages.where("deleted_at IS NULL"), {}, ("internal_ts", since), ("internal_ts", until))
    if sender:
        df = df.where(F.lower("from_addr").contains(sender.lower()))
    for label in labels or []:
        df = df.where(F.array_contains("labels", label))
    if wanted := search.query_tokens(text):
        df = df.join(search.match_all(index, wanted).withColumnRenamed("id", "message_id"), "message_id", "left_semi")
    fresh = with_freshness(messages, "synced_at", now, stale_after) if now is not None else None
    return answer(df, limit, F.desc("internal_ts"), F.col("message_id"), freshness=fresh)


def thread(messages: DataFrame, thread_id: str, limit: int = MOST) -> Result:
    return answer(messages.where("deleted_at IS NULL").where(F.col("thread_id") == thread_id), limit, F.col("internal_ts"), F.col("message_id"))


def agenda(occurrences: DataFrame, since: int, until: int, calendars: list[str] | None = None, limit: int = 50) -> Result:
    """Occurrences by their ordering time; all-day ones keep their dates and show no instants."""
    df = _narrowed(occurrences, {"calendar_id": calendars}, ("order_ts", since), ("order_ts", until))
    timed = F.col("start_kind") == "timed"
    shown = df.withColumns({c: F.when(timed, F.col(c)) for c in ("start_utc", "end_utc")}).withColumns({c: F.when(~timed, F.col(c)) for c in ("start_date", "end_date")})
    return answer(shown, limit, F.col("order_ts"), F.col("instance_id"))


def _shown(df: DataFrame, calendars: list[str] | None, declined: bool, cancelled: bool, since: int | None, until: int | None) -> DataFrame:
    df = _narrowed(df, {"calendar_id": calendars}, ("order_ts", since), ("order_ts", until))
    if not cancelled:
        df = df.where("status <> 'cancelled'")
    return df if declined else df.where("coalesce(self_response_status, '') <> 'declined'")


def calendar_search(occurrences: DataFrame, index: DataFrame, text: str, since: int | None = None, until: int | None = None, calendars: list[str] | None = None, declined: bool = True, cancelled: bool = False, limit: int = 20) -> Result:
    """Occurrences by words of their titles and places, the latest first; without words the filters alone."""
    df = _shown(occurrences, calendars, declined, cancelled, since, until)
    if wanted := search.query_tokens(text):
        df = df.join(search.match_all(index, wanted).withColumnRenamed("id", "instance_id"), "instance_id", "left_semi")
    return answer(df, limit, F.desc("order_ts"), F.col("instance_id"))


def calendar_event(events: DataFrame, occurrences: DataFrame, attendees: DataFrame, event_id: object, calendar_id: object = None, limit: int = MOST) -> dict[str, Result]:
    """A series with its rule as it was sent, who attends it, and its occurrences in order; in one calendar or in all."""
    mine = {"calendar_id": calendar_id, "event_id": event_id}
    return {
        "event": answer(_narrowed(events, mine, None, None), MOST, F.col("calendar_id")),
        "attendees": answer(_narrowed(attendees, mine, None, None), MOST, F.col("calendar_id"), F.col("email")),
        "occurrences": answer(_narrowed(occurrences, mine, None, None), limit, F.col("order_ts"), F.col("instance_id")),
    }


def calendar_status(calendars: DataFrame, events: DataFrame, occurrences: DataFrame, runs: DataFrame) -> DataFrame:
    """One row: live selected calendars, live events and series, occurrences and cancelled ones, and the last run."""
    live = F.col("deleted_at").isNull()
    last = F.max_by(F.struct("run_id", "status", "started_at"), F.struct("started_at", "run_id"))
    parts = [
        calendars.agg(F.count_if(live & F.col("selected")).alias("calendars")),
        events.agg(F.count_if(live).alias("events"), F.count_if(live & (F.col("kind") == "series")).alias("series")),
        occurrences.agg(F.count(F.lit(1)).alias("instances"), F.count_if(F.col("status") == "cancelled").alias("cancelled")),
        runs.agg(last.alias("last_run")),
    ]
    out = parts[0].withColumn("_one", F.lit(1))
    for p in parts[1:]:
        out = out.join(F.broadcast(p.withColumn("_one", F.lit(1))), "_one")
    return out.drop("_one")


def conflicts(occurrences: DataFrame, since: int, until: int, limit: int = MOST, width: int = 3600) -> Result:
    """Pairs of busy timed occurrences that overlap, where either begins in the range."""
    busy = occurrences.where("start_kind = 'timed' AND status <> 'cancelled' AND coalesce(transparency, 'opaque') = 'opaque' AND coalesce(self_response_status, '') <> 'declined'")
    pairs = overlaps(busy, "instance_id", "start_utc", "end_utc", width)
    starts = busy.select("instance_id", "start_utc")
    j = pairs.join(starts.toDF("a", "a_start"), "a").join(starts.toDF("b", "b_start"), "b")
    inside = lambda c: (F.col(c) >= since) & (F.col(c) < until)
    return answer(j.where(inside("a_start") | inside("b_start")), limit, F.least("a_start", "b_start"), F.col("a"), F.col("b"))


def entity(transactions: DataFrame, name: str, since=None, until=None, limit: int = 20) -> dict[str, Result]:
    """Totals by currency and kind, and the latest rows, of the counterparties that hold a name; similar names if there are none."""
    df = _narrowed(transactions.where(F.lower("entity_name").contains(name.lower())), {}, ("date", since), ("date", until))
    totals = df.groupBy("currency", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("total"), F.min("date").alias("first"), F.max("date").alias("last"))
    out = {"totals": answer(totals, MOST, F.col("currency"), F.col("kind")), "rows": answer(df, limit, F.desc("date"), F.col("message_id"))}
    if not out["rows"].rows:
        near = transactions.select("entity_name").distinct().withColumn("distance", F.levenshtein(F.lower("entity_name"), F.lit(name.lower())))
        out["did_you_mean"] = answer(near, 5, F.col("distance"), F.col("entity_name"))
    return out


def of_kind(transactions: DataFrame, kind: str, dated: bool = False, limit: int = 20) -> Result:
    """The latest transactions of a kind; dated: only those that say when the service is."""
    df = transactions.where(F.col("kind") == kind)
    return answer(df.where("service_dates IS NOT NULL") if dated else df, limit, F.desc("date"), F.col("message_id"))


def catalog_search(docs: DataFrame, index: DataFrame | TextIndex, text: str, doc_type: str | None = None, least_tier: int | None = None, limit: int = 20) -> Result:
    """Documents by words (of postings, or of a kept index), the search widened until something is found; filters come before the limit; texts below tier 3 are withheld."""
    wanted = search.query_tokens(text)
    begun, totals = (index.postings(wanted, prefix=True), index.totals()) if isinstance(index, TextIndex) else (index, None)
    found = search.widened(begun, wanted).join(search.ranked(begun, wanted, totals=totals), "id", "left")
    df = _narrowed(docs, {"doc_type": doc_type}, ("tier", least_tier), None).join(found, F.col("doc_id") == F.col("id")).drop("id")
    shown = df.withColumn("text", F.when(F.col("tier") >= 3, F.col("text")))
    return answer(shown, limit, F.coalesce("score", F.lit(0.0)).desc(), F.col("doc_id"))


def document(docs: DataFrame, sha: str) -> Result:
    """The document of a content hash, or of its first eight or more digits."""
    if len(sha) < 8:
        raise ValueError("give eight digits of the hash, or more")
    return answer(docs.where(F.col("sha256").startswith(sha.lower())), 2, F.col("sha256"))


def activity(events: DataFrame, group: int, since=None, until=None, actor: str | None = None, actions: list[str] | None = None, limit: int = 50) -> Result:
    """A group's events, the newest first; rows without a group belong to nobody."""
    df = _narrowed(events.where(F.col("group_id") == group), {"actor": actor, "action": actions}, ("at", since), ("at", until))
    return answer(df, limit, F.desc("at"), F.desc("event_id"))


def list_events(events: DataFrame, group: int, store: str | None = None, product: str | None = None, action: str | None = None, by: str | None = None, limit: int = 50) -> Result:
    """What happened on a group's lists, the newest first; the store's name in any letter case."""
    df = _narrowed(events.where(F.col("group_id") == group), {"product": product, "action": action, "actor": by}, None, None)
    if store is not None:
        df = df.where(F.lower("store") == store.strip().lower())
    return answer(df, limit, F.desc("at"), F.desc("event_id"))


def drive_search(files: DataFrame, index: DataFrame | None = None, text: str = "", kind: str | None = None, owner: str | None = None, since: int | None = None, trashed: bool = False, limit: int = 20) -> Result:
    """Live files by words of their names, mime type or kind, part of an owner and time, the last modified first; without words only the filters count; trashed ones on request."""
    df = _narrowed(files.where("deleted_at IS NULL"), {}, ("modified_ts", since), None)
    if not trashed:
        df = df.where(~F.col("trashed"))
    if kind:
        df = df.where((F.col("mime_type") == kind) | (F.col("kind") == kind))
    if owner:
        df = df.where(F.exists("owners", lambda o: F.lower(o).contains(owner.lower())))
    if (wanted := search.query_tokens(text)) and index is not None:
        df = df.join(search.match_all(index, wanted).withColumnRenamed("id", "file_id"), "file_id", "left_semi")
    return answer(df, limit, F.desc("modified_ts"), F.col("file_id"))


def drive_recent(files: DataFrame, trashed: bool = False, limit: int = 20) -> Result:
    """The live files that were modified last."""
    return drive_search(files, trashed=trashed, limit=limit)


def drive_status(files: DataFrame, parents: DataFrame, states: tuple[str, ...] = ("private", "shared_with_named", "domain", "anyone_with_link", "unknown")) -> DataFrame:
    """One row: live files, folders, trashed and tombstoned ones, edges to parents, and live files by sharing state, zeros included."""
    live = F.col("deleted_at").isNull()
    counts = files.agg(
        F.count_if(live).alias("files"), F.count_if(live & (F.col("kind") == "folder")).alias("folders"), F.count_if(live & F.col("trashed")).alias("trashed"), F.count_if(~live).alias("tombstoned"),
        *[F.count_if(live & (F.coalesce("sharing_state", F.lit("unknown")) == s)).alias(f"sharing_{s}") for s in states],
    )
    edges = parents.agg(F.count(F.lit(1)).alias("parent_edges"))
    return counts.withColumn("_one", F.lit(1)).join(F.broadcast(edges.withColumn("_one", F.lit(1))), "_one").drop("_one")
