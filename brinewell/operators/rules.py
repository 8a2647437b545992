"""Rules as data: a cascade of sender classes, templates and generic patterns; verdicts; access."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _with_template(messages: DataFrame, rules: DataFrame, sender: str) -> DataFrame:
    """messages with `_t`: rule, action, kind, value and confidence of their sender's first rule that fits, else null.

    A sender's rules are gathered in their order, so a message meets them in one
    join, with nothing to sort or to join back.
    """
    r = F.struct("rule_order", "field", "pattern", "action", "kind", "value", "confidence")
    per = rules.groupBy(F.col("sender").alias(sender)).agg(F.array_sort(F.collect_list(r)).alias("_rules"))
    text = lambda x: F.coalesce(F.when(x["field"] == "snippet", F.col("snippet")).otherwise(F.col("subject")), F.lit(""))
    first = F.get(F.filter("_rules", lambda x: F.regexp_like(text(x), x["pattern"])), 0)
    j = messages.join(per, sender, "left").withColumn("_f", first)
    f = F.col("_f")
    value = F.when(f["value"] == "$1", F.call_function("regexp_extract", text(f), f["pattern"], F.lit(1))).otherwise(f["value"])
    t = F.struct(f["rule_order"].alias("rule"), f["action"].alias("action"), f["kind"].alias("kind"), value.alias("value"), f["confidence"].cast("double").alias("confidence"))
    return j.withColumn("_t", F.when(f.isNotNull(), t)).drop("_rules", "_f")


def first_template(messages: DataFrame, rules: DataFrame, id: str, sender: str) -> DataFrame:  # noqa: A002
    """Each message's first matching rule of its sender: id, rule, action, kind, value and confidence.

    rules(sender, rule_order, field, pattern, action, kind, value, confidence);
    `field` names subject or snippet; value is a constant, or the pattern's
    first group for '$1'.
    """
    return _with_template(messages, rules, sender).where(F.col("_t").isNotNull()).select(id, "_t.*")


def cascade(messages: DataFrame, classes: DataFrame, rules: DataFrame, generic: Column, id: str, sender: str) -> DataFrame:  # noqa: A002
    """messages with lane (L0, L1, L2), action (extract, terminate, escalate), kind, value and confidence.

    L0 ends marketing senders; L1 is the sender's first template, unless it
    escalates; L2 is `generic`, a struct(action, kind, value, confidence).
    """
    c = classes.select(F.col("sender").alias(sender), F.col("class").alias("_class"))
    j = _with_template(messages.join(c, sender, "left"), rules, sender)
    ended = F.coalesce(F.col("_class") == "marketing", F.lit(False))
    by_template = F.coalesce(F.col("_t.action").isin("extract", "terminate"), F.lit(False))
    lane = F.when(ended, "L0").when(by_template, "L1").otherwise("L2")
    own = F.struct(*[F.col(f"_t.{f}").alias(f) for f in ("action", "kind", "value", "confidence")])
    out = F.when(by_template, own).otherwise(generic)
    pick = {f: F.when(~ended, out[f]) for f in ("kind", "value", "confidence")}
    return j.withColumns({"lane": lane, "action": F.when(ended, "terminate").otherwise(out["action"]), **pick}).select(*messages.columns, "lane", "action", "kind", "value", "confidence")


def keyed_verdict(rows: DataFrame, verdicts: DataFrame, exact: str, wider: str) -> DataFrame:
    """rows with `verdict` by their exact key, else by the wider one; verdicts(key, verdict)."""
    a = verdicts.select(F.col("key").alias(exact), F.col("verdict").alias("_a"))
    b = verdicts.select(F.col("key").alias(wider), F.col("verdict").alias("_b"))
    return rows.join(a, exact, "left").join(b, wider, "left").withColumn("verdict", F.coalesce("_a", "_b")).select(*rows.columns, "verdict")


def selected(rows: DataFrame, verdict: str, klass: str, excluded: tuple[str, ...]) -> DataFrame:
    """never goes, always stays, else the class decides."""
    v = F.coalesce(F.col(verdict), F.lit(""))
    return rows.where((v != "never") & ((v == "always") | ~F.coalesce(F.col(klass), F.lit("unknown")).isin(*excluded)))


def suggestion(klass: Column, documents: Column) -> Column:
    return F.when((klass == "marketing") & (documents == 0), "never").when(klass == "human", "always").otherwise("review")


def principals(requests: DataFrame, identities: DataFrame, people: DataFrame) -> DataFrame:
    """requests(request, channel, sender, account) with person_id: an identity of that account before one of any account ('')."""
    i = identities.join(people.where("status = 'active'").select("person_id"), "person_id", "left_semi").select("channel", "sender", F.col("account").alias("_account"), "person_id")
    j = requests.join(i, ["channel", "sender"], "left").where(F.col("_account").isNull() | (F.col("_account") == F.col("account")) | (F.col("_account") == ""))
    best = j.groupBy("request").agg(F.max(F.struct("_account", F.col("person_id"))).alias("_b"))
    return requests.join(best, "request", "left").select(*requests.columns, F.col("_b.person_id").alias("person_id"))


def allowed(requests: DataFrame, grants: DataFrame) -> DataFrame:
    """requests(request, person_id, resource, action, subject) with `allowed`: an active grant that isn't about oneself only, or is about oneself; else no."""
    g = grants.where("status = 'active'").select("person_id", "resource", "action", "self_only")
    j = requests.join(g, ["person_id", "resource", "action"])
    fits = ~F.coalesce("self_only", F.lit(False)) | F.col("subject").isNull() | (F.col("subject") == F.col("person_id"))
    yes = j.where(fits).select("request").distinct().withColumn("_yes", F.lit(True))
    return requests.join(yes, "request", "left").withColumn("allowed", F.coalesce("_yes", F.lit(False))).drop("_yes")


def three_valued(base: DataFrame, key: str, evidence: DataFrame, hints: DataFrame, covered: Column) -> DataFrame:
    """base with `state`: yes with evidence or a hint, no where a run has covered the row without any, else unknown."""
    e = evidence.select(key).distinct().withColumn("_e", F.lit(True))
    h = hints.select(key).distinct().withColumn("_h", F.lit(True))
    j = base.join(e, key, "left").join(h, key, "left")
    state = F.when(F.col("_e") | F.col("_h"), "yes").when(covered, "no").otherwise("unknown")
    return j.withColumn("state", state).select(*base.columns, "state")
