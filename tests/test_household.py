"""Lists of households: nulls, ties, repeated rows, rows of other groups, empty tables."""

from brinewell.operators import household as hh


def told(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_acting_groups(spark):
    asks = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "ask long, actor string")
    members = spark.createDataFrame([(5, "a"), (4, "a"), (4, "a"), (1, None)], "group_id long, actor string")
    assert told(hh.acting_groups(asks, members, 4), "ask", "group_id") == [(1, 4), (2, None), (3, None)]
    assert told(hh.acting_groups(asks, members, 9), "ask", "group_id") == [(1, 4), (2, 9), (3, 9)]
    assert told(hh.acting_groups(asks, members.limit(0), 9), "ask", "group_id") == [(1, 9), (2, 9), (3, 9)]


def test_chosen_stores(spark):
    asks = spark.createDataFrame([(1, 1, "a", "Named"), (2, 1, "a", " "), (3, 1, "b", None), (4, 2, "b", None), (5, 3, None, None)], "ask long, group_id long, actor string, store string")
    stores = spark.createDataFrame([(1, "X"), (1, "Y"), (2, "Only"), (2, "Only2"), (3, "Single")], "group_id long, store string")
    people = spark.createDataFrame([("a", "Mine"), ("b", ""), ("c", None)], "actor string, default_store string")
    # two events at one instant, and one in another group's store
    events = spark.createDataFrame([(1, 1, "X", 10), (2, 1, "Y", 10), (3, 2, "X", 99)], "event_id long, group_id long, store string, at long")
    got = told(hh.chosen_stores(asks, stores, people, events), "ask", "chosen", "assumption")
    assert got == [(1, "Named", None), (2, "Mine", "store_personal_default"), (3, "Y", "store_last_touched"), (4, None, None), (5, "Single", "store_only")]
    got = told(hh.chosen_stores(asks, stores, people, events.limit(0), "Home"), "ask", "chosen", "assumption")
    assert got[2:4] == [(3, "Home", "store_default"), (4, "Home", "store_default")]


def test_actors_named(spark):
    m = spark.createDataFrame([(1, "+55 11 98765-4321"), (1, "bot"), (2, "+55 11 90000-4321"), (1, None)], "group_id long, actor string")
    e = spark.createDataFrame([(1, "+1 555 0004321"), (1, ""), (1, "bot")], "group_id long, actor string")
    p = spark.createDataFrame([("+55 11 98765-4321", "José da Silva"), ("+1 555 0004321", "jose"), ("bot", None)], "actor string, name string")
    asks = spark.createDataFrame([(1, a) for a in ("4321", "321", "JOSE", "josé da silva", "bot", "silva", "", None, "4321")], "group_id long, ask string")
    got = told(hh.actors_named(asks, m, e, p), "ask", "actor")
    assert got == [("4321", "+1 555 0004321"), ("4321", "+55 11 98765-4321"), ("JOSE", "+1 555 0004321"), ("JOSE", "+55 11 98765-4321"), ("bot", "bot"), ("josé da silva", "+55 11 98765-4321")]


def test_walked(spark):
    items = spark.createDataFrame([("s", "Milk", 1.0, "", None, "needed"), ("s", "Rice", 2.5, "kg", "white", "needed"), ("s", "Nails", 1.0, "box", "", "needed"), ("s", "Old", 1.0, None, None, "purchased"), ("gone", "Milk", 1.0, None, None, "needed"), ("s", None, None, None, None, "needed")], "store string, name string, quantity double, unit string, note string, status string")
    stores = spark.createDataFrame([("s", "nowhere"), ("s", "nowhere")], "store string, layout string")
    sections = spark.createDataFrame([("Milk", "dairy"), ("Milk", "dairy"), ("Rice", "pantry")], "name string, section string")
    got = told(hh.walked(items, stores, sections), "pos", "section", "line")
    assert got == [(14, "other", "Nails x1 box"), (14, "other", None), (5, "dairy", "Milk"), (7, "pantry", "Rice x2.5 kg (white)")]
    assert hh.walked(items, stores, sections, needed_only=False).count() == 5
    assert [r["walk"] is None for r in hh.layout_orders(stores).collect()] == [True, True]


def test_stats_and_due(spark):
    day = hh.DAY_US
    rows = [("p", "Milk", hh.BOUGHT, 0), ("p", "milk", hh.BOUGHT, 2 * day), ("p", "x", "needed", 3 * day), ("q", "Rice", hh.BOUGHT, day), ("r", "Salt", hh.BOUGHT, day), ("r", "Salt", hh.BOUGHT, day), (None, "?", hh.BOUGHT, day)]
    e = spark.createDataFrame(rows, "product string, name string, action string, at long")
    stats = hh.product_stats(e, ["product"])
    assert told(stats, "product", "name", "times", "interval") == [("p", "milk", 2, 2.0), ("q", "Rice", 1, None), ("r", "Salt", 2, None), (None, "?", 1, None)]
    none, sections = e.limit(0), spark.createDataFrame([("milk", "dairy")], "name string, section string")
    assert told(hh.due_products(stats, none, ["product"], sections, 4 * day), "product", "section", "elapsed", "overdue") == [("p", "dairy", 2.0, 0.0)]
    assert hh.due_products(stats, none, ["product"], sections, 4 * day, slack=1.5).isEmpty()
    assert hh.due_products(stats, none, ["product"], sections, 9 * day, section="pantry").isEmpty()
    assert hh.due_products(stats, e, ["product"], sections, 9 * day).isEmpty()


def test_history(spark):
    trips = spark.createDataFrame([("s", 1, 10, "+5511987654321"), ("s", 2, 10, "bot"), ("s", 3, 5, None), ("t", 4, 1, "ann")], "store string, trip_id long, closed_at long, closed_by string")
    items = spark.createDataFrame([(1, "purchased", "Milk", 1.0), (1, "missing", "Rice", 2.0), (4, "purchased", None, None)], "trip_id long, outcome string, name string, quantity double")
    people = spark.createDataFrame([("ann", "Ann"), ("bot", "")], "actor string, name string")
    got = told(hh.trip_history(trips, items, people, ["store"], 2), "store", "place", "trip_id", "closed_by", "name")
    assert got == [("s", 1, 2, "bot", None), ("s", 2, 1, "•••4321", "Milk"), ("s", 2, 1, "•••4321", "Rice"), ("t", 1, 4, "Ann", None)]
    assert told(hh.trip_history(trips, items, people, ["store"], 9).where("trip_id = 3"), "closed_by") == [("",)]


def test_shares(spark):
    contacts = spark.createDataFrame([("Mom", "phone", "1", True), ("MOM ", "phone", "1", True), ("Bob", "phone", "2", False)], "alias string, channel string, target string, active boolean")
    stores = spark.createDataFrame([(10, 1, "Corner"), (20, 2, "Corner"), (30, 1, "Empty")], "store_id long, group_id long, store string")
    items = spark.createDataFrame([(10, "Rice", 2.0, "", "white", "needed"), (10, "milk", 1.0, None, None, "needed"), (20, "Secret", 1.0, None, None, "needed"), (30, "Old", 1.0, None, None, "purchased")], "store_id long, name string, quantity double, unit string, note string, status string")
    asks = spark.createDataFrame([(1, 1, "corner", " mom"), (2, 1, "Empty", "Mom"), (3, 1, "Corner", "Bob"), (4, 3, "Corner", "mom"), (5, None, None, None)], "share_id long, group_id long, store string, contact string")
    shares, lines = hh.prepared_shares(asks, contacts, stores, items, "2024-03-01")
    assert told(shares, "share_id", "status", "target") == [(1, "ready", "1"), (2, "ready", "1"), (3, "not allow-listed", None), (4, "unknown store", None), (5, "not allow-listed", None)]
    assert told(lines, "share_id", "place", "line") == [(1, 0, "Grocery list — Corner — 2024-03-01"), (1, 1, "- milk"), (1, 2, "- Rice × 2 — white"), (2, 0, "Grocery list — Empty — 2024-03-01"), (2, 1, "(No items needed)")]
    confirmed = spark.createDataFrame([(1, 1, 7), (2, 2, 7), (3, 1, 7), (None, 1, 7)], "share_id long, group_id long, at long")
    assert told(hh.delivered(shares, stores, confirmed), "share_id", "delivered_at") == [(1, 7), (2, None), (3, None), (None, None)]
