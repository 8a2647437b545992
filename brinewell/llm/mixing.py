"""Operator 5: mixing sources to target weights, in fixed-length blocks drawn by index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brinewell.llm.common import let, row_hash, without, words
from brinewell.llm.permute import permuted
from brinewell.session import cut

#: Words in a block, slots in an output shard, times a source may be repeated, and bins that part a source's documents.
BLOCK, SHARD_SLOTS, MOST_TIMES, BINS = 128, 4096, 2, 1024
#: Up to so many sources, counted first, the tables with a row a source are broadcast; beyond, they are joined by key.
BROADCAST_SOURCES = 20_000
#: Parts of the unit interval that draws are looked up by; each part meets a few sources.
_UNIT, _PARTS = 1 << 40, 1024


def source_targets(sizes: DataFrame, weights: Column, share: float, most_times: int = MOST_TIMES) -> DataFrame:
    """sizes(source, source_size) with each source's target.

    weights: an expression over ``rank``, the source's place by code point from
    0, null last. The targets share `share` times all words by weight, none
    above most_times its source's size: with sources in order of size / weight,
    the first k are held at their cap for the least k at which the rest, shared
    by weight, stays below the next cap.
    """
    everything = Window.partitionBy(F.lit(1))  # one row a source
    ranked = sizes.withColumn("rank", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1)
    w = ranked.withColumn("w", weights.cast("double")).withColumn("cap", (F.col("source_size") * most_times).cast("double"))
    order = everything.orderBy(F.col("cap") / F.col("w"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    leveled = w.withColumn("level", level).withColumn("at", F.row_number().over(order))
    free = F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct("at", "level"))
    first = leveled.withColumn("at", F.min(free).over(everything)["level"])
    return first.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("at") * F.col("w"), F.col("cap"))).alias("target"))


def _pieces(rows: DataFrame, block: int) -> DataFrame:
    """Each document's words as pieces of its source's blocks: _k1, _k2, _copy, _source, _block, _words, _at (in the text) and _off (in the block).

    A source's words are packed one after another in the order of a content
    hash. Its documents lie in BINS bins; running sums within a bin start at the
    sum of the bins before, so a source that holds a third of all rows is dealt
    over BINS groups.
    """
    r = rows.withColumn("_bin", F.pmod("_k1", F.lit(BINS)).cast("int"))
    bins = r.groupBy("_source", "_bin").agg(F.sum("size").alias("_sum"))
    starts = bins.withColumn("_start", F.coalesce(F.sum("_sum").over(Window.partitionBy("_source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    w = Window.partitionBy("_source", "_bin").orderBy("_k1", "_k2", "_copy").rowsBetween(Window.unboundedPreceding, -1)
    placed = r.withColumn("_before", F.coalesce(F.sum("size").over(w), F.lit(0))).join(starts.select("_source", "_bin", "_start"), ["_source", "_bin"])
    placed = placed.withColumn("_from", F.col("_start") + F.col("_before")).where("size > 0")
    parts = placed.withColumn("_block", F.explode(F.expr(f"sequence(_from div {block}, (_from + size - 1) div {block})")))
    lo, hi = F.greatest(F.col("_from"), F.col("_block") * block), F.least(F.col("_from") + F.col("size"), (F.col("_block") + 1) * block)
    return parts.select("_k1", "_k2", "_copy", "_source", "_block", (hi - lo).alias("_words"), (lo - F.col("_from")).alias("_at"), (lo - F.col("_block") * block).alias("_off"))


def _small(df: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(df) if few else df


def draws(targets: DataFrame, block: int, shard_slots: int, seed: int, few: bool) -> DataFrame:
    """(source key, block, epoch, output shard, _take, _whole_block) of every slot of the mix; _take: how many of the block's words, from its first.

    Each slot of each output shard draws its source from the targets' shares, so
    a shard's source counts are multinomial. A source's slots, numbered through
    all shards, must end at its quota of blocks: slots drawn beyond it go, by
    number, to sources that drew too few, which keeps every source at its
    target and none above its cap. A source's j-th slot is epoch j div B and
    block p(j mod B), with p a keyed Feistel permutation of its B blocks. A
    source's last block may be short, and the last slot of its last epoch is cut
    where its target is reached, so even a source of a few words gets its share.
    """
    spark = targets.sparkSession
    t = targets.where("source_size > 0 AND target > 0").withColumn("_source", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    t = t.withColumn("_blocks", F.ceil(F.col("source_size") / block).cast("long")).withColumn("_whole", F.floor(F.col("target") / F.col("source_size")).cast("long"))
    t = t.withColumns({"_rest": F.round("target").cast("long") - F.col("_whole") * F.col("source_size"), "_last": F.col("source_size") - (F.col("_blocks") - 1) * block})
    more = F.when(F.col("_rest") > 0, F.least(F.col("_blocks"), F.ceil((F.col("_rest") + block - F.col("_last")) / block).cast("long"))).otherwise(F.lit(0))
    t = t.withColumn("_quota", F.col("_whole") * F.col("_blocks") + more)
    everything = Window.partitionBy(F.lit(1)).orderBy("_source")
    t = t.withColumn("_total", F.sum("_quota").over(Window.partitionBy(F.lit(1)))).withColumn("_upto", F.sum("_quota").over(everything))
    t = t.withColumn("_lo", F.floor((F.col("_upto") - F.col("_quota")) / F.col("_total") * _UNIT).cast("long")).withColumn("_hi", F.floor(F.col("_upto") / F.col("_total") * _UNIT).cast("long"))
    slots = int(t.agg(F.sum("_quota")).first()[0] or 0)
    step = _UNIT // _PARTS
    by_part = t.where("_hi > _lo").withColumn("_part", F.explode(F.expr(f"sequence(_lo div {step}, (_hi - 1) div {step})"))).select("_source", "_part", "_lo", "_hi")
    u = F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(_UNIT))
    drawn = spark.range(slots).withColumn("_shard", F.expr(f"id div {shard_slots}")).withColumn("_u", u).withColumn("_part", F.expr(f"_u div {step}"))
    drawn = drawn.join(_small(by_part, few), "_part").where("_u >= _lo AND _u < _hi").select("id", "_shard", "_source")

    counts = drawn.groupBy("_source", "_shard").agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy("_source").orderBy("_shard")
    starts = counts.withColumn("_first", F.sum("_n").over(order) - F.col("_n"))
    within = Window.partitionBy("_source", "_shard").orderBy("id")
    numbered = drawn.withColumn("_i", F.row_number().over(within) - 1).join(starts.select("_source", "_shard", "_first"), ["_source", "_shard"])
    numbered = numbered.withColumn("_j", F.col("_first") + F.col("_i")).select("_source", "_shard", "_j")

    got = counts.groupBy("_source").agg(F.sum("_n").alias("_got"))
    b = t.join(got, "_source", "left").withColumn("_got", F.coalesce("_got", F.lit(0)))
    b = b.withColumn("_more", F.greatest(F.col("_got") - F.col("_quota"), F.lit(0))).withColumn("_less", F.greatest(F.col("_quota") - F.col("_got"), F.lit(0)))
    b = b.withColumn("_more_at", F.sum("_more").over(everything) - F.col("_more")).withColumn("_less_at", F.sum("_less").over(everything) - F.col("_less"))
    own = ["_blocks", "_whole", "_rest", "_last"]
    b = b.select("_source", "_quota", *own, "_got", "_less", "_more_at", "_less_at")

    j = numbered.join(_small(b, few), "_source")
    inside = j.where("_j < _quota").select("_source", "_shard", "_j", *own)
    extra = j.where("_j >= _quota").select(F.col("_shard"), (F.col("_more_at") + F.col("_j") - F.col("_quota")).alias("_e"))
    gaps = b.where("_less > 0").withColumn("_d", F.explode(F.expr("sequence(0L, _less - 1)")))
    gaps = gaps.select("_source", (F.col("_got") + F.col("_d")).alias("_j"), (F.col("_less_at") + F.col("_d")).alias("_e"), *own)
    moved = extra.join(gaps, "_e").select("_source", "_shard", "_j", *own)
    all_slots = inside.unionByName(moved)

    side = F.ceil(F.sqrt(F.col("_blocks").cast("double"))).cast("long")
    keyed = all_slots.withColumns({"_epoch": F.expr("_j div _blocks"), "_x": F.expr("_j % _blocks"), "_a": side, "_b": F.ceil(F.col("_blocks") / side).cast("long")})
    keyed = keyed.withColumn("_key", F.xxhash64(F.lit(seed), "_source", "_epoch"))
    placed = cut(keyed.withColumn("_block", permuted("_x", "_blocks", "_a", "_b", "_key")).select("_source", "_shard", "_epoch", "_x", "_block", *own), "mix-slots")
    short = (F.col("_block") == F.col("_blocks") - 1) & (F.col("_epoch") == F.col("_whole"))
    at = placed.where(short).select("_source", F.col("_x").alias("_short"))  # one a source at most
    size = F.when(F.col("_block") == F.col("_blocks") - 1, F.col("_last")).otherwise(F.lit(block))
    before = F.col("_x") * block - F.when(F.col("_x") > F.col("_short"), block - F.col("_last")).otherwise(F.lit(0))
    take = F.when(F.col("_epoch") < F.col("_whole"), size).otherwise(F.greatest(F.lit(0), F.least(size, F.col("_rest") - before)))
    cut_off = placed.join(_small(at, few), "_source", "left").withColumn("_take", take).where("_take > 0")
    return cut_off.select("_source", "_block", "_epoch", "_shard", "_take", (F.col("_take") == size).alias("_whole_block"))


def mix(
    docs: DataFrame,
    weights=None,
    share: float = 1.5,
    text: str = "text",
    source: str = "source",
    most_times: int = MOST_TIMES,
    block: int = BLOCK,
    shard_slots: int = SHARD_SLOTS,
    seed: int = 5,
) -> tuple[DataFrame, DataFrame]:
    """The mix of docs: its documents with size, source_size, target, taken, and the pieces it takes.

    weights: a function from the column of a source's rank (by code point, null
    last) to its weight; 3, 1, 2 in turn by default. The second frame has _k1,
    _k2, _copy (which document), _at and _words (which of its words), epoch and
    out_shard of each piece taken, repeats included.

    Sizes are numbers of words; a null text has size 0 and is never taken; null
    sources form one source; repeated rows are packed one after another; an
    empty table gives an empty mix; input columns called as an output are
    replaced. The same rows give the same mix, however they are partitioned.
    """
    weights = weights or (lambda rank: F.element_at(F.array(F.lit(3), F.lit(1), F.lit(2)), (rank % 3 + 1).cast("int")))
    df = without(docs, "size", "source_size", "target", "taken")
    src = F.col(f"`{source}`").cast("string")
    df = df.withColumns({"size": F.size(words(F.col(f"`{text}`"))).cast("long"), "_source": F.coalesce(F.concat(F.lit("s"), src), F.lit("n")), "_k1": row_hash(df, 51), "_k2": row_hash(df, 52)})
    df = df.withColumn("_copy", F.row_number().over(Window.partitionBy("_k1", "_k2").orderBy("_source")))
    rows = cut(df.select("_k1", "_k2", "_copy", "_source", "size"), "mix-rows")
    sizes = rows.groupBy("_source").agg(F.sum("size").alias("source_size"))
    sizes = sizes.select(F.when(F.col("_source") != "n", F.substr("_source", F.lit(2))).alias("source"), "source_size")
    targets = cut(source_targets(sizes, weights(F.col("rank")), share, most_times), "mix-targets")
    few = targets.count() <= BROADCAST_SOURCES
    pieces = _pieces(rows, block)
    drawn = draws(targets, block, shard_slots, seed, few)
    some = F.greatest(F.lit(0), F.least(F.col("_words"), F.col("_take") - F.col("_off")))
    taken = pieces.join(drawn, ["_source", "_block"]).withColumn("_words", some).where("_words > 0").select("_k1", "_k2", "_copy", "_at", "_words", F.col("_epoch").alias("epoch"), F.col("_shard").alias("out_shard"))

    times = drawn.groupBy("_source", "_block").agg(F.count_if("_whole_block").alias("_times"), F.max(F.when(~F.col("_whole_block"), F.col("_take"))).alias("_take"))  # one cut slot a source at most
    every = F.col("_words") * F.col("_times") + F.when(F.col("_take").isNotNull(), some).otherwise(F.lit(0))
    words_taken = pieces.join(times, ["_source", "_block"]).groupBy("_k1", "_k2", "_copy").agg(F.sum(every).alias("_taken"))
    per_source = targets.withColumn("_source", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).drop("source")
    out = df.join(_small(per_source, few), "_source").join(words_taken, ["_k1", "_k2", "_copy"], "left")
    return out.withColumn("taken", F.coalesce("_taken", F.lit(0)).cast("long")).drop("_taken", "_source"), taken


def mixed_documents(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The mix's texts in the columns of docs: a row for each document and epoch that takes from it.

    A document that an epoch takes whole keeps its text; of one that lies in
    blocks taken and not taken, the words taken are joined by single blanks.
    Nulls, repeated rows, empty tables and clashing names: see ``mix``.
    """
    mixed, taken = mix(docs, text=text, **options)
    parts = taken.groupBy("_k1", "_k2", "_copy", "epoch").agg(F.sum("_words").alias("_got"), F.array_sort(F.collect_list(F.struct("_at", "_words"))).alias("_parts"))
    j = mixed.join(parts, ["_k1", "_k2", "_copy"])
    t = F.col(f"`{text}`")
    some = F.array_join(let(words(t), lambda w: F.flatten(F.transform("_parts", lambda p: F.slice(w, (p["_at"] + 1).cast("int"), p["_words"].cast("int"))))), " ")
    new = F.when(F.col("_got") == F.col("size"), t).otherwise(some)
    return j.withColumn(text, new).select(*[F.col(f"`{c}`") for c in docs.columns if c in j.columns])


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document, with its source's size and target."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    mixed, _ = mix(docs)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")
