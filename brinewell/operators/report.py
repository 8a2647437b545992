"""A calibration report over a catalog: nine sections of counts and shares, from few scans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinewell.operators.measures import coverage_curve, ranked_share, sample
from brinewell.session import cut
from brinewell.sources.files import markdown

#: Rows that the lists of a report show at most: each is a feature of its section.
SENDERS, BIGGEST, UNTYPED, FAILURES, SAMPLE = 40, 25, 40, 20, 20
#: Fixed order of the sections.
SECTIONS = ("senders", "coverage", "types", "years", "biggest", "untyped", "failures", "noise", "sample", "levers")
COLUMNS = ("section", "label", "n", "documents", "bytes", "share")


def _rows(df: DataFrame, section: str, label: Column, n: Column, documents: Column | None = None, size: Column | None = None, share: Column | None = None) -> DataFrame:
    none = F.lit(None)
    made = [F.lit(section), label.cast("string"), n.cast("long"), (none if documents is None else documents).cast("long"), (none if size is None else size).cast("long"), (none if share is None else share).cast("double")]
    return df.select(*[c.alias(name) for c, name in zip(made, COLUMNS, strict=True)])


def calibration_report(artifacts: DataFrame, manifest: DataFrame, body: str = "correspondence", seed: str = "0") -> DataFrame:
    """(section, label, n, documents, bytes, share) of a catalog: what to decide on, and what each rule would cost.

    artifacts(id, sender, doc_type, tier, bytes, year, ext, needs_review): one
    scan groups them by sender, by type and tier, by year, by extension of
    what failed, and in all (grouping sets), with the counts that the levers
    need; its groups are written, and all sections but the lists of single
    artifacts come from them. manifest(status, reason, size): what a fetch
    returned, a row a message or skipped attachment.

    senders: the SENDERS with most documents, with their share of documents;
    coverage: the fewest senders that hold half, 80 and 95 % of the artifacts;
    types and years with their share of artifacts; biggest and untyped
    artifacts by size; failures by extension; noise by status and reason with
    its share of the manifest; a seeded sample; levers: artifacts that a rule
    would drop. documents are the artifacts that aren't of type `body`. Nulls
    are groups of their own, called (none); ties go by label or id; an empty
    catalog has zero levers and no other row.
    """
    keys = ["sender", "doc_type", "tier", "year", "ext"]
    documents = F.count_if(~F.col("doc_type").eqNullSafe(F.lit(body)))
    small = lambda k: F.count_if(F.col("bytes") < k)
    typed = artifacts.withColumn("ext", F.when(F.col("needs_review"), F.coalesce("ext", F.lit("(none)"))))
    sets = [["sender"], ["doc_type", "tier"], ["year"], ["ext"], []]
    groups = typed.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in keys]).agg(
        F.grouping_id(*keys).alias("_set"), F.count(F.lit(1)).alias("n"), documents.alias("documents"), F.sum("bytes").alias("bytes"), F.count_if(F.col("needs_review")).alias("review"),
        F.count_if(F.col("doc_type").isNull()).alias("untyped"), small(20_000).alias("small20"), small(50_000).alias("small50"), F.count_if(F.col("tier") == 3).alias("tier3"),
    )
    groups = cut(groups, "report-groups")
    by = lambda *names: groups.where(F.col("_set") == sum(1 << (len(keys) - 1 - keys.index(k)) for k in keys if k not in names))
    total = by().select(*[F.col(c).alias(f"_{c}") for c in ("n", "documents", "untyped", "review", "small20", "small50", "tier3")]).first()
    n, held = (total["_n"], total["_documents"]) if total else (0, 0)
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("(none)"))
    of = lambda c, whole: c / F.lit(float(max(whole, 1)))
    count, docs, size = F.col("n"), F.col("documents"), F.col("bytes")

    senders = by("sender").withColumn("sender", named("sender"))
    top = senders.orderBy(docs.desc(), count.desc(), "sender").limit(SENDERS)
    curve = coverage_curve(ranked_share(senders.select("sender", "n"), "sender", "n")) if n else None
    fetched = manifest.groupBy("status", "reason").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    messages = manifest.count()
    levers = {f"drop {body}": n - held, "drop under 20000 bytes": total and total["_small20"], "drop under 50000 bytes": total and total["_small50"], "drop tier 3": total and total["_tier3"], "drop untyped": total and total["_untyped"], "drop for review": total and total["_review"]}
    spark = artifacts.sparkSession
    cost = spark.createDataFrame([(k, int(v or 0)) for k, v in levers.items()], "label string, n long")
    parts = [
        _rows(top, "senders", F.col("sender"), count, docs, size, of(docs, held)),
        _rows(by("doc_type", "tier"), "types", F.concat(named("doc_type"), F.lit("/T"), named("tier")), count, docs, size, of(count, n)),
        _rows(by("year"), "years", named("year"), count, docs, size, of(count, n)),
        _rows(artifacts.where(~F.col("doc_type").eqNullSafe(F.lit(body))).orderBy(F.col("bytes").desc_nulls_last(), "id").limit(BIGGEST), "biggest", F.col("id"), F.lit(1), size=size),
        _rows(artifacts.where("doc_type IS NULL").orderBy(F.col("bytes").desc_nulls_last(), "id").limit(UNTYPED), "untyped", F.col("id"), F.lit(1), size=size),
        _rows(by("ext").where("ext IS NOT NULL").orderBy(count.desc(), "ext").limit(FAILURES), "failures", F.col("ext"), count, docs, size, of(count, n)),
        _rows(fetched, "noise", F.concat(named("status"), F.lit("/"), named("reason")), count, size=size, share=of(count, messages)),
        _rows(sample(artifacts, "id", SAMPLE, seed), "sample", F.col("id"), F.lit(1), size=size),
        _rows(cost, "levers", F.col("label"), count, share=of(count, n)),
    ]
    if curve is not None:
        parts.append(_rows(curve, "coverage", F.concat((F.col("mark") * 100).cast("int").cast("string"), F.lit("%")), count))
    return reduce(DataFrame.unionByName, parts)


def report_markdown(report: DataFrame, most: int = 200) -> str:
    """The report as text: a table a section, in order; `most` rows of a section at most reach the driver, and what is left out is said."""
    out = []
    for s in SECTIONS:
        rows = report.where(F.col("section") == s).orderBy(F.col("n").desc(), F.col("bytes").desc_nulls_last(), "label").limit(most + 1).collect()
        more = "\n\nMore rows are not shown." if len(rows) > most else ""
        out.append(f"## {s}\n\n{markdown(rows[:most], list(COLUMNS[1:]))}{more}" if rows else f"## {s}\n\nNothing.")
    return "\n\n".join(out) + "\n"
