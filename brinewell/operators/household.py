"""Shared lists of households: who asks, which store is meant, what is needed, bought, due and shared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brinewell.functions.text import fold, masked, phone_digits, squeeze
from brinewell.operators.lists import LAYOUTS, quantity_text, walk_position

#: The action that confirms a purchase; items marked before their trip closes can still be unmarked.
BOUGHT = "trip_purchased"
DAY_US = 86_400_000_000


def _name_key(c: Column) -> Column:
    return F.lower(F.trim(squeeze(c)))


def acting_groups(asks: DataFrame, members: DataFrame, default: int) -> DataFrame:
    """asks(ask, actor) with group_id: the actor's first group by id; null if refused.

    An actor of no group acts in the default one as long as nobody is enrolled
    there; members(group_id, actor). A null actor is in no group. Members that
    repeat count once.
    """
    own = members.groupBy("actor").agg(F.min("group_id").alias("_g"))
    open_ = members.where(F.col("group_id") == default).limit(1).agg(F.count(F.lit(1)).alias("_n")).withColumn("_one", F.lit(1))
    j = asks.join(own, "actor", "left").withColumn("_one", F.lit(1)).join(F.broadcast(open_), "_one")
    free = F.when(F.col("_n") == 0, F.lit(default))
    return j.withColumn("group_id", F.coalesce("_g", free)).select(*asks.columns, "group_id")


def chosen_stores(asks: DataFrame, stores: DataFrame, people: DataFrame, events: DataFrame, default: str | None = None) -> DataFrame:
    """asks(ask, group_id, actor, store) with `chosen` and `assumption`, which says what the choice rests on.

    In this order: the store that the ask names (assumption null), the one the
    actor prefers (people(actor, default_store)), the group's store that was
    touched last (events(event_id, group_id, store, at), ties by event_id), the
    only one of stores(group_id, store), the default. Null if none of them is
    there. Stores of other groups are never chosen; blank names count as none.
    """
    named = F.nullif(F.trim("store"), F.lit(""))
    own = people.where(F.trim("default_store") != "").groupBy("actor").agg(F.min("default_store").alias("_own"))
    seen = events.join(stores.select("group_id", "store").distinct(), ["group_id", "store"], "left_semi")
    last = seen.groupBy("group_id").agg(F.max_by("store", F.struct("at", "event_id")).alias("_last"))
    only = stores.groupBy("group_id").agg(F.when(F.count(F.lit(1)) == 1, F.min("store")).alias("_only"))
    j = asks.join(own, "actor", "left").join(last, "group_id", "left").join(only, "group_id", "left")
    steps = [("store_personal_default", F.col("_own")), ("store_last_touched", F.col("_last")), ("store_only", F.col("_only")), ("store_default", F.lit(default).cast("string"))]
    why = F.when(named.isNotNull(), F.lit(None).cast("string"))
    for kind, c in steps:
        why = why.when(c.isNotNull(), F.lit(kind))
    return j.withColumn("chosen", F.coalesce(named, *[c for _, c in steps])).withColumn("assumption", why).select(*asks.columns, "chosen", "assumption")


def actors_named(asks: DataFrame, members: DataFrame, events: DataFrame, people: DataFrame) -> DataFrame:
    """(group_id, ask, actor): everybody of a group that an ask names; asks(group_id, ask).

    Candidates are the group's members(group_id, actor) and whoever its
    events(group_id, actor) name, members who left included. An ask names them
    by identifier, by the last four or more digits of their number if it is
    written as one, by their folded name or its first word (people(actor,
    name)). Everyone who fits is told; null and blank asks name nobody.
    """
    blank = F.coalesce(F.trim("actor"), F.lit("")) == ""
    known = members.select("group_id", "actor").union(events.select("group_id", "actor")).where(~blank).distinct()
    names = people.groupBy("actor").agg(F.min("name").alias("name"))
    digits, name = phone_digits(F.col("actor")), fold(F.coalesce("name", F.lit("")))
    key = lambda kind, v: F.struct(F.lit(kind).alias("k"), v.alias("v"))
    ends = F.when(F.length(digits) >= 4, F.transform(F.sequence(F.lit(4), F.greatest(F.length(digits), F.lit(4))), lambda n: key("digits", F.right(digits, n)))).otherwise(F.array().cast("array<struct<k:string,v:string>>"))
    own = F.concat(F.array(key("id", squeeze(F.trim("actor"))), key("name", name), key("name", F.substring_index(name, " ", 1))), ends)
    index = known.join(names, "actor", "left").select("group_id", "actor", F.explode(F.array_distinct(own)).alias("x")).select("group_id", "actor", "x.k", "x.v").where("v <> ''")
    numeric = F.trim("ask").rlike(r"^[0-9\s+().-]+$")
    said = F.array(key("id", squeeze(F.trim("ask"))), key("name", fold(F.col("ask"))), F.when(numeric, key("digits", phone_digits(F.col("ask")))))
    wanted = asks.where(F.trim("ask") != "").select("group_id", "ask").distinct().select("group_id", "ask", F.explode(F.array_compact(said)).alias("y")).select("group_id", "ask", "y.k", "y.v")
    return wanted.join(index, ["group_id", "k", "v"]).select("group_id", "ask", "actor").distinct()


def public_label(actor: Column, name: Column) -> Column:
    """How one person is named to another: by name, else by the last digits of the number, else as identified; empty for nobody."""
    digits = phone_digits(actor)
    return F.coalesce(F.nullif(name, F.lit("")), F.when(digits != "", masked(digits)), actor, F.lit(""))


def item_line(name: Column, quantity: Column, unit: Column, note: Column, times: str = " x", before: str = " (", after: str = ")") -> Column:
    """A line of a list: the name, how much of it unless one without a unit, the note."""
    n, u, remark = quantity_text(quantity.cast("double")), F.coalesce(unit, F.lit("")), F.coalesce(note, F.lit(""))
    amount = F.when((n == "1") & (u == ""), "").otherwise(F.concat(F.lit(times), n, F.when(u != "", F.concat(F.lit(" "), u)).otherwise("")))
    return F.concat(name, F.coalesce(amount, F.lit("")), F.when(remark != "", F.concat(F.lit(before), remark, F.lit(after))).otherwise(""))


def walked(items: DataFrame, stores: DataFrame, sections: DataFrame, needed_only: bool = True) -> DataFrame:
    """items with section, pos (the section's place in the walk through their store, by its layout) and line.

    items(store, name, quantity, unit, note, status), stores(store, layout),
    sections(name, section). Names without a section are `other`; unknown
    layouts are supermarkets. Rows order by pos, then name; no list is gathered.
    """
    rows = items.where("status = 'needed'") if needed_only else items
    s = sections.select("name", "section").dropDuplicates(["name"])
    j = rows.join(stores.select("store", F.col("layout").alias("_layout")).dropDuplicates(["store"]), "store").join(s, "name", "left")
    section = F.coalesce("section", F.lit("other"))
    pos = walk_position(section, "supermarket")
    for layout in LAYOUTS:
        pos = F.when(F.col("_layout") == layout, walk_position(section, layout)).otherwise(pos)
    line = item_line(F.col("name"), F.col("quantity"), F.col("unit"), F.col("note"))
    return j.withColumn("section", section).select(*items.columns, "section", pos.alias("pos"), line.alias("line"))


def layout_orders(stores: DataFrame) -> DataFrame:
    """stores(store, layout) with `walk`: the sections in the order of their layout; null for an unknown one."""
    known = F.create_map(*[x for k, v in LAYOUTS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return stores.withColumn("walk", F.try_element_at(known, F.col("layout")))


def product_stats(events: DataFrame, product: list[str]) -> DataFrame:
    """(product, name, times, first, last, interval) of confirmed purchases; events(product, name, action, at in microseconds).

    interval: the mean days between purchases, to a tenth; null below two, or
    where all were at one instant. Summed before the shuffle, so a product with
    a third of the rows costs no more than another.
    """
    h = events.where(F.col("action") == BOUGHT).groupBy(*product).agg(F.max("name").alias("name"), F.count(F.lit(1)).alias("times"), F.min("at").alias("first"), F.max("at").alias("last"))
    span = F.col("last") - F.col("first")
    return h.withColumn("interval", F.when((F.col("times") > 1) & (span > 0), F.round(span / (F.col("times") - 1) / DAY_US, 1)))


def due_products(stats: DataFrame, present: DataFrame, product: list[str], sections: DataFrame, now: int, slack: float = 1.0, least: int = 2, section: str | None = None) -> DataFrame:
    """Products of product_stats that are usually bought again by now and aren't on the list: with section, elapsed and overdue days, to a tenth.

    present(product) are the lists as they stand. A product needs an interval
    and `least` purchases; `slack` stretches the interval.
    """
    elapsed = F.round((F.lit(now) - F.col("last")) / DAY_US, 1)
    late = stats.where(F.col("times") >= least).withColumn("elapsed", elapsed).where(F.col("elapsed") >= F.col("interval") * slack)
    left = late.join(present.select(*product).distinct(), product, "left_anti")
    out = left.join(sections.select("name", "section").dropDuplicates(["name"]), "name", "left").withColumn("section", F.coalesce("section", F.lit("other")))
    out = out.withColumn("overdue", F.round(F.col("elapsed") - F.col("interval"), 1))
    return out if section is None else out.where(F.col("section") == section)


def trip_history(trips: DataFrame, items: DataFrame, people: DataFrame, store: list[str], most: int = 10) -> DataFrame:
    """The last `most` closed trips of each store and what they held, a row an item: store, trip_id, closed_at, closed_by, place, outcome, name, quantity.

    trips(store, trip_id, closed_at, closed_by), items(trip_id, outcome, name,
    quantity), people(actor, name). closed_by is a label, never a number; ties
    go to the higher trip_id. A trip without items keeps one row with nulls.
    """
    w = Window.partitionBy(*store).orderBy(F.desc("closed_at"), F.desc("trip_id"))
    last = trips.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
    names = people.groupBy(F.col("actor").alias("closed_by")).agg(F.min("name").alias("_name"))
    j = last.join(names, "closed_by", "left").join(items.select("trip_id", "outcome", "name", "quantity"), "trip_id", "left")
    return j.withColumn("closed_by", public_label(F.col("closed_by"), F.col("_name"))).select(*store, "trip_id", "closed_at", "closed_by", "place", "outcome", "name", "quantity")


def roster(members: DataFrame, people: DataFrame) -> DataFrame:
    """members(group_id, actor, role) with name and lang of people(actor, name, lang), empty where unknown."""
    p = people.select("actor", "name", "lang").dropDuplicates(["actor"])
    return members.join(p, "actor", "left").select("group_id", "role", "actor", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("lang", F.lit("")).alias("lang"))


def prepared_shares(asks: DataFrame, contacts: DataFrame, stores: DataFrame, items: DataFrame, day: str) -> tuple[DataFrame, DataFrame]:
    """(shares, lines) of lists that go to contacts: asks(share_id, group_id, store, contact).

    shares: asks with contact's channel and target and a status: ready,
    `not allow-listed` where no active contacts(alias, channel, target, active)
    has that name in any letter case, `unknown store` where stores(store_id,
    group_id, store) has none of that name in the asker's own group.
    lines(share_id, place, line): the text of ready ones; line 0 is the head,
    the needed items(store_id, name, quantity, unit, note, status) follow by
    name, or one line that says there are none.
    """
    c = contacts.where("active").select(_name_key(F.col("alias")).alias("_c"), F.col("alias").alias("_alias"), "channel", "target").dropDuplicates(["_c"])
    s = stores.select("group_id", _name_key(F.col("store")).alias("_s"), "store_id", F.col("store").alias("_store")).dropDuplicates(["group_id", "_s"])
    j = asks.withColumns({"_c": _name_key(F.col("contact")), "_s": _name_key(F.col("store"))}).join(c, "_c", "left").join(s, ["group_id", "_s"], "left")
    status = F.when(F.col("_alias").isNull(), "not allow-listed").when(F.col("store_id").isNull(), "unknown store").otherwise("ready")
    j = j.withColumn("status", status)
    ready = j.where("status = 'ready'").select("share_id", "store_id", "_store")
    line = item_line(F.col("name"), F.col("quantity"), F.col("unit"), F.col("note"), " × ", " — ", "")
    needed = items.where("status = 'needed'").select("store_id", "name", F.concat(F.lit("- "), line).alias("line"))
    head = ready.select("share_id", F.lit(0).alias("place"), F.concat(F.lit("Grocery list — "), "_store", F.lit(f" — {day}")).alias("line"))
    w = Window.partitionBy("share_id").orderBy(_name_key(F.col("name")), "line")
    body = ready.join(needed, "store_id").select("share_id", F.row_number().over(w).alias("place"), "line")
    none = ready.join(needed.select("store_id").distinct(), "store_id", "left_anti").select("share_id", F.lit(1), F.lit("(No items needed)"))
    held = ["channel", "target"]
    shares = j.select(*asks.columns, "store_id", *[F.when(F.col("status") == "ready", F.col(h)).alias(h) for h in held], "status")
    return shares, head.union(body).union(none)


def delivered(shares: DataFrame, stores: DataFrame, confirmed: DataFrame) -> DataFrame:
    """confirmed(share_id, group_id, at) with delivered_at: null where the share isn't one of the caller's own group, as if there were none."""
    own = shares.where("status = 'ready'").join(stores.select("store_id", F.col("group_id").alias("_g")).dropDuplicates(["store_id"]), "store_id").select("share_id", "_g").distinct()
    j = confirmed.join(own, (confirmed.share_id == own.share_id) & (confirmed.group_id == F.col("_g")), "left")
    return j.select(*[confirmed[c] for c in confirmed.columns], F.when(F.col("_g").isNotNull(), confirmed["at"]).alias("delivered_at"))
