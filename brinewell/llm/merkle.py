"""Operator 11: Merkle manifest of a dataset, with the proof path of every row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinewell.llm.common import LOWER, UPPER, ordered
from brinewell.session import cut

#: Children of a node; characters of a digest; the columns of documents that a leaf binds, in order.
FANOUT, DIGEST, COLUMNS = 8, 64, ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: Column) -> Column:
    """Lower-case hex SHA-256."""
    return F.sha2(text, 256)


def leaf_of(*values: Column) -> Column:
    """Digest of the values one after another, each `-` if null, else its UTF-8 bytes' count, a colon and itself; no two rows share an encoding."""
    parts = [v.cast("string") for v in values]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts]))


def siblings(path: Column) -> Column:
    """The digests beside a node, level by level up to the root: each ancestor's preimage without the slot on the way."""
    return F.array_join(F.transform(path, lambda a: F.concat(F.substring(a["preimage"], F.lit(1), a["slot"] * DIGEST), F.substring(a["preimage"], a["slot"] * DIGEST + DIGEST + 1, F.length(a["preimage"])))), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path give: at each level the node so far is put into its slot and hashed."""
    return F.aggregate(path, leaf, lambda h, a: digest(F.overlay(a["preimage"], h, a["slot"] * DIGEST + 1)))


def _grown(nodes: DataFrame, most: int, fanout: int) -> list[DataFrame]:
    """Parents of nodes (_tree, _at, _of, _h), level by level until every tree has one node; each with its children's digests as _preimage.

    A level is one aggregation on (tree, place div fanout), of at most `fanout`
    rows a group whatever the tree's size, and is written before the next one.
    """
    levels, m = [], most
    while m > 1:
        run = F.array_sort(F.collect_list(F.struct("_at", "_h")))
        grouped = nodes.where("_of > 1").groupBy("_tree", F.expr(f"_at div {fanout}").alias("_up"), F.expr(f"(_of + {fanout - 1}) div {fanout}").alias("_n")).agg(run.alias("_run"))
        parents = grouped.select("_tree", F.col("_up").alias("_at"), F.col("_n").alias("_of"), F.array_join(F.transform("_run", lambda c: c["_h"]), "").alias("_preimage"))
        nodes = cut(parents.withColumn("_h", digest(F.col("_preimage"))), "merkle-level")
        levels.append(nodes)
        m = -(-m // fanout)
    return levels


def _climbed(nodes: DataFrame, above: DataFrame | None, tops: DataFrame, fanout: int) -> DataFrame:
    """Nodes with `path`, the ancestors from the nearest one up as struct(slot, preimage), and `subroot`.

    above: the parents of the nodes of trees with more of them, with paths of their own; tops: (_t, _path, _subroot) of the trees.
    """
    single = nodes.where("_of = 1").join(tops, F.col("_tree") == F.col("_t")).select(*nodes.columns, F.col("_path").alias("path"), F.col("_subroot").alias("subroot"))
    if above is None:
        return single
    up = above.select(F.col("_tree").alias("_t"), F.col("_at").alias("_up"), F.col("_preimage").alias("_pre"), F.col("path").alias("_rest"), F.col("subroot").alias("_subroot"))
    j = nodes.where("_of > 1").join(up, (F.col("_tree") == F.col("_t")) & (F.expr(f"_at div {fanout}") == F.col("_up")))
    here = F.array(F.struct((F.col("_at") % fanout).cast("int").alias("slot"), F.col("_pre").alias("preimage")))
    return j.select(*nodes.columns, F.concat(here, F.col("_rest")).alias("path"), F.col("_subroot").alias("subroot")).unionByName(single)


def _down(nodes: DataFrame, levels: list[DataFrame], tops: DataFrame, fanout: int) -> DataFrame:
    """Nodes with their paths, by joins from the root down: a level joins the one above it once, and so takes over all that is above."""
    above = None
    for level in reversed(levels):
        above = cut(_climbed(level, above, tops, fanout), "merkle-paths")
    return _climbed(nodes, above, tops, fanout)


def merkle_paths(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, group: str = "lang", order: str = "doc_id", fanout: int = FANOUT, keep: tuple[str, ...] = ()) -> DataFrame:
    """order, group, keep, leaf, subroot, root and path of every row: a tree a group over the rows in order, and one over the groups' subroots.

    While a tree has several nodes, every `fanout` consecutive ones become the
    digest of their digests; the last run may be shorter, and a run of one is
    hashed too. A lone leaf is its group's subroot. Groups are ordered by their
    UTF-8 bytes, null first. Parents hold their children's digests as one
    string (the preimage): ``siblings`` cuts a node's own slot out of it,
    ``folded`` puts another digest in.

    Null values have a leaf of their own, null groups form one tree, null
    orders come first. Rows of the same order are put in the order of their
    leaves; rows that are equal throughout get consecutive places. An empty
    table gives no rows. Texts are hashed whole and only their digests move.
    Columns not named are left out, so none can clash; a kept column called
    like an output is refused.
    """
    clash = {"leaf", "subroot", "root", "path"} & {c.lower() for c in (order, group, *keep)}
    if clash:
        raise ValueError(f"columns {sorted(clash)} are made here")
    slim = docs.select(F.col(f"`{order}`").alias("_order"), F.col(f"`{group}`").alias("_group"), *[F.col(f"`{c}`").alias(f"_keep{i}") for i, c in enumerate(keep)], leaf_of(*[F.col(f"`{c}`") for c in columns]).alias("_h"))
    placed = ordered(cut(slim, "merkle-leaves"), "_group", F.col("_order"), F.col("_h"))
    groups = cut(placed.groupBy("_group").agg(F.max("_of").alias("_size")).withColumn("_all", F.lit(0)), "merkle-groups")
    trees = ordered(groups, "_all", F.col("_group")).select(F.col("_group").alias("_named"), F.col("_at").alias("_tree"), F.col("_of").alias("_trees"), "_size")
    trees = cut(trees, "merkle-trees")
    leaves = placed.join(trees.select("_named", "_tree"), F.col("_group").eqNullSafe(F.col("_named"))).drop("_named")
    sizes = trees.agg(F.max("_size").alias("most"), F.max("_trees").alias("trees")).first()
    levels = _grown(leaves.select("_tree", "_at", "_of", "_h"), sizes["most"] or 0, fanout)

    done = [n.where("_of = 1").select("_tree", "_h") for n in (leaves, *levels)]
    subroots = trees.select("_tree", "_trees").join(reduce(DataFrame.unionByName, done), "_tree")
    subroots = cut(subroots.select(F.lit(-1).cast("long").alias("_tree"), F.col("_tree").alias("_at"), F.col("_trees").alias("_of"), "_h"), "merkle-subroots")
    upper = _grown(subroots, sizes["trees"] or 0, fanout)
    root = (upper[-1] if upper else subroots).select("_h").first()  # one digest
    none = F.array().cast("array<struct<slot:int,preimage:string>>")
    over = _down(subroots, upper, subroots.sparkSession.range(1).select(F.lit(-1).cast("long").alias("_t"), none.alias("_path"), F.lit(None).cast("string").alias("_subroot")), fanout)
    tops = cut(over.select(F.col("_at").alias("_t"), F.col("path").alias("_path"), F.col("_h").alias("_subroot")), "merkle-tops")
    out = _down(leaves, levels, tops, fanout)
    named = [F.col("_order").alias(order), F.col("_group").alias(group), *[F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)]]
    return out.select(*named, F.col("_h").alias("leaf"), "subroot", F.lit(root[0] if root else None).cast("string").alias("root"), "path")


def op11_merkle(spark, sf_dir: str) -> DataFrame:
    """Every document's leaf, subroot, root and proof, and the root that it gives where a third of the texts are tampered with."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0
    lowered = leaf_of(*[F.translate(c, UPPER, LOWER) if c == "text" else F.col(c) for c in COLUMNS])
    paths = merkle_paths(docs.withColumn("claimed", F.when(tampered, lowered)), keep=("claimed",))
    out = paths.select("doc_id", "leaf", "subroot", "root", digest(siblings(F.col("path"))).alias("proof_sha256"), folded(F.coalesce("claimed", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: CRC-32 by its bits; the tree level by level, then every leaf's way up.
OP11_ORACLE = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, text, coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-')
    || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') AS head,
    list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: list_prepend(-1 - ascii(substr(doc_id::VARCHAR, i, 1)), [0, 0, 0, 0, 0, 0, 0, 0])))),
      lambda c, x: CASE WHEN x < 0 THEN xor(c, -1 - x) ELSE xor(c // 2, 3988292384 * (c % 2)) END) AS crc
  FROM documents),
h AS (SELECT doc_id, lang, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
  CASE WHEN xor(crc, 4294967295) % 3 = 0 THEN sha256(head || coalesce(octet_length(encode(text)) || ':' || translate(text, '{UPPER}', '{LOWER}'), '-')) END AS claimed FROM d),
leaves AS (SELECT doc_id, leaf, coalesce(claimed, leaf) AS claimed, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
  row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM h),
low AS (
  SELECT tree, 0 AS level, pos, n, NULL::VARCHAR AS pre, leaf AS h FROM leaves
  UNION ALL SELECT tree, level + 1, up, (n + 7) // 8, pre, sha256(pre) FROM (SELECT tree, level, n, pos // 8 AS up, string_agg(h, '' ORDER BY pos) AS pre FROM low WHERE n > 1 GROUP BY tree, level, n, pos // 8)),
top AS (
  SELECT 0 AS level, tree AS pos, (SELECT count(*) FROM low WHERE n = 1) AS n, NULL::VARCHAR AS pre, h FROM low WHERE n = 1
  UNION ALL SELECT level + 1, up, (n + 7) // 8, pre, sha256(pre) FROM (SELECT level, n, pos // 8 AS up, string_agg(h, '' ORDER BY pos) AS pre FROM top WHERE n > 1 GROUP BY level, n, pos // 8)),
nodes AS (SELECT tree, level, pos, pre FROM low WHERE level > 0 UNION ALL SELECT -1, level, pos, pre FROM top WHERE level > 0),
depth AS (SELECT tree, max(level) AS depth FROM low GROUP BY tree),
walk AS (
  SELECT l.doc_id, l.leaf, l.tree AS lang, l.pos AS first, 0 AS step, l.tree AS tree, l.pos AS pos, 0 AS level, l.claimed AS h, '' AS sib FROM leaves l
  UNION ALL
  SELECT w.doc_id, w.leaf, w.lang, w.first, step + 1, n.tree, n.pos, n.level, sha256(left(n.pre, 64 * (slot % 8)) || w.h || substr(n.pre, 64 * (slot % 8) + 65)), w.sib || left(n.pre, 64 * (slot % 8)) || substr(n.pre, 64 * (slot % 8) + 65)
  FROM (SELECT walk.*, depth, CASE WHEN walk.tree >= 0 AND level = depth THEN -1 ELSE walk.tree END AS to_tree, CASE WHEN walk.tree >= 0 AND level = depth THEN walk.tree ELSE pos END AS slot, CASE WHEN walk.tree >= 0 AND level = depth THEN 1 ELSE level + 1 END AS to_level FROM walk LEFT JOIN depth ON depth.tree = walk.tree) w
  JOIN nodes n ON n.tree = w.to_tree AND n.level = w.to_level AND n.pos = w.slot // 8)
SELECT doc_id, leaf, s.h AS subroot, r.h AS root, sha256(sib) AS proof_sha256, w.h AS folded_root, w.h = r.h AS verified
FROM (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY lang, first ORDER BY step DESC) = 1) w JOIN low s ON s.tree = w.lang AND s.n = 1 JOIN (SELECT h FROM top WHERE n = 1) r ON true
"""
