"""Operator 10: near-duplicates by a chosen-path set similarity join over minwise tokens."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from brinewell.llm.common import without
from brinewell.session import cut

#: Minwise positions of a group of trees, and groups, each with positions of its own; trees and levels of the join; the share of paths that pick a second position, down to these levels and below.
POSITIONS, GROUPS, TREES, LEVELS, TWICE, TWICE_BELOW = 64, 2, 24, 3, 0.25, 0.5
#: Nodes of up to so many sets are compared pair by pair; in larger ones each set meets its node's pivot first, the best PIVOTS of all trees.
SMALL, PIVOTS = 32, 3
#: Trees whose larger nodes are swept at the first levels; shingles in a part of a sweep, beyond which a node branches on; rounds, of two more levels each.
SWEPT, PART, ROUNDS = 14, 4_000_000, 3
#: Bits of each minimum in a sketch; up to so many candidate pairs, counted first, the ids of their documents are broadcast.
SKETCH, BROADCAST_PAIRS = 4, 500_000
#: Equal minwise positions from which a pair is a candidate: five deviations below 0.8.
MAYBE = 35
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (fixed values: its multipliers)."""
    x = x.astype(_U)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(text: str | None, n: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's n-word shingles; of fewer words, but not none, the whole sequence."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not w:
        return np.empty(0, _U)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), _U, len(w))
    if len(w) < n:
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes(), seed=1)], _U)
    s = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        s = _mix(s) + h[k : len(h) - n + 1 + k]
    return np.unique(_mix(s))


def _minima(sets: list[np.ndarray]) -> np.ndarray:
    """GROUPS * POSITIONS minwise values of each (non-empty) set, as rows of 32-bit numbers."""
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    seeds = _mix(np.arange(1, GROUPS * POSITIONS + 1, dtype=_U)) | _U(1)
    out = np.empty((len(sets), GROUPS * POSITIONS), np.uint32)
    for i, a in enumerate(seeds):
        v = flat * a
        out[:, i] = np.minimum.reduceat((v ^ (v >> _U(29))) * _U(0x9E3779B97F4A7C15) >> _U(32), starts).astype(np.uint32)
    return out


def _branch(path: np.ndarray, row: np.ndarray, minima: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """One level down: each path picks one position of its group by its own hash, a share of them two; a set goes on by its value there. The last bits of a path name its group."""
    h = _mix(path)  # GROUPS is a power of 2, so no path overflows
    first = (h % _U(POSITIONS)).astype(np.int64)
    second = (first + 1 + ((h >> _U(8)) % _U(POSITIONS - 1)).astype(np.int64)) % POSITIONS
    twice = (h >> _U(32)).astype(np.float64) / 2**32 < share
    p = np.concatenate([path, path[twice]])
    at = np.concatenate([first, second[twice]])
    r = np.concatenate([row, row[twice]])
    group = p % _U(GROUPS)
    below = _mix(p * _U(31) + at.astype(_U) * _U(0x100000001B3) + _mix(minima[r, group.astype(np.int64) * POSITIONS + at].astype(_U)))
    return below - below % _U(GROUPS) + group, r


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, GROUPS * POSITIONS)


def _sketch(minima: np.ndarray) -> list[pa.Array]:
    """SKETCH 64-bit words of each set: bit p of word k is bit k of the minimum at position p of the first group."""
    return [pa.array(np.packbits((minima[:, :POSITIONS] >> np.uint32(k) & np.uint32(1)).astype(np.uint8), axis=1, bitorder="little").view(np.int64).ravel()) for k in range(SKETCH)]


def missed(similarity: float, levels: int, trees: int = TREES) -> float:
    """The share of pairs of a similarity that meet in no tree's nodes at a level: trees of a group read the same positions, groups read their own."""
    alone = 0.0
    for equal in range(POSITIONS + 1):
        p, meet = equal / POSITIONS, 1.0
        for level in reversed(range(levels)):
            share = TWICE if level < LEVELS else TWICE_BELOW
            meet = 1 - (1 - share) * (1 - p * meet) - share * (1 - p * meet) ** 2
        alone += comb(POSITIONS, equal) * similarity**equal * (1 - similarity) ** (POSITIONS - equal) * (1 - meet) ** (trees // GROUPS)
    return alone**GROUPS


def alike(a: str, b: str, percent: int) -> tuple[Column, Column]:
    """(same, maybe) of two sets with sketches and sizes a.k0.., b.k0..: positions whose sketch bits agree, and whether the pair can be a link.

    Equal minima have equal bits, so no pair with MAYBE equal positions is lost.
    """
    differ = F.col(f"{a}.k0").bitwiseXOR(F.col(f"{b}.k0"))
    for k in range(1, SKETCH):
        differ = differ.bitwiseOR(F.col(f"{a}.k{k}").bitwiseXOR(F.col(f"{b}.k{k}")))
    same = F.lit(POSITIONS) - F.bit_count(differ)
    low, high = F.least(f"{a}.size", f"{b}.size"), F.greatest(f"{a}.size", f"{b}.size")
    return same, (same >= MAYBE) & (100 * low >= percent * high)


def signatures(docs: DataFrame, n: int, text: str, doc_id: str) -> DataFrame:
    """doc_id, n_shingles, set_key (128-bit hash of the set, null of an empty one), minima and sketch of every document."""
    slim = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                part = b.slice(k, 1000)
                sets = [shingles(t, n) for t in part.column(1).to_pylist()]
                full = [i for i, s in enumerate(sets) if len(s)]
                minima = np.zeros((len(sets), GROUPS * POSITIONS), np.uint32)
                if full:
                    minima[full] = _minima([sets[i] for i in full])
                keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array([m.tobytes() for m in minima], pa.binary()), *_sketch(minima)], names=["doc_id", "n_shingles", "set_key", "minima", *[f"k{i}" for i in range(SKETCH)]])

    return slim.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, minima binary, " + ", ".join(f"k{i} long" for i in range(SKETCH)))


def _nodes(classes: DataFrame, trees: int) -> DataFrame:
    """(path, rep, tree) of every set in every tree, LEVELS down."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 2000):
                part = b.slice(k, 2000)
                reps, minima = part.column(0).to_numpy(), _matrix(part.column(1))
                for tree in range(trees):
                    row = np.arange(len(reps))
                    path = np.full(len(reps), _mix(np.array([tree + 1]))[0] // _U(GROUPS) * _U(GROUPS) + _U(tree % GROUPS))
                    for _ in range(LEVELS):
                        path, row = _branch(path, row, minima, TWICE)
                    yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), pa.array(reps[row]), pa.array(np.full(len(row), tree, np.int32))], names=["path", "rep", "tree"])

    return classes.select("rep", "minima").mapInArrow(run, "path long, rep long, tree int")


def _deeper(rows: DataFrame) -> DataFrame:
    """Two levels more of (path, rep, tree, minima)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            path, reps, trees, minima = b.column(0).to_numpy().view(_U), b.column(1).to_numpy(), b.column(2).to_numpy(), _matrix(b.column(3))
            row = np.arange(len(reps))
            for _ in range(2):
                path, row = _branch(path, row, minima, TWICE_BELOW)
            yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), pa.array(reps[row]), pa.array(trees[row])], names=["path", "rep", "tree"])

    return rows.select("path", "rep", "tree", "minima").mapInArrow(run, "path long, rep long, tree int")


#: A set in the join: its sketch and size.
_SET = ["size", *[f"k{i}" for i in range(SKETCH)]]


def _within_small(nodes: DataFrame, percent: int) -> DataFrame:
    """Candidates (a, b) among all sets of every node of SMALL sets at most."""
    same, maybe = alike("x", "y", percent)
    rows = nodes.where(F.col("n") <= SMALL)
    return rows.alias("x").join(rows.alias("y"), (F.col("x.path") == F.col("y.path")) & (F.col("x.rep") < F.col("y.rep")) & maybe).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))


def _against_pivots(nodes: DataFrame, percent: int) -> DataFrame:
    """Candidates (a, b) of every set with the most alike of its larger nodes' pivots; a node's pivot is its set with the least hash."""
    rows = nodes.where(F.col("n") > SMALL)
    pivots = rows.groupBy("path").agg(F.min(F.struct(F.xxhash64("rep", "path").alias("h"), "rep", *_SET)).alias("p")).select("path", "p.rep", *[f"p.{c}" for c in _SET])
    same, maybe = alike("x", "y", percent)
    met = rows.alias("x").join(pivots.alias("y"), (F.col("x.path") == F.col("y.path")) & (F.col("x.rep") != F.col("y.rep")) & maybe)
    met = met.select(F.col("x.rep").alias("x"), F.struct(same.cast("int").alias("same"), F.col("y.rep").alias("y")).alias("p"))
    best = met.groupBy("x").agg(F.slice(F.sort_array(F.collect_set("p"), asc=False), 1, PIVOTS).alias("p")).select("x", F.explode("p.y").alias("y"))
    return best.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _open(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(path, rep, tree, size, root, main, weight) of the larger nodes that links don't make one component yet.

    main: the component with the most sets of the node; weight: the node's
    shingles. Of nodes with the same sets, one stays.
    """
    rooted = nodes.where(F.col("n") > SMALL).select("path", "rep", "tree", "size").join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    by_root = rooted.groupBy("path", "root").agg(F.min("tree").alias("tree"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.sum(F.xxhash64("rep") % (1 << 40)).alias("print"))
    info = by_root.groupBy("path").agg(F.min("tree").alias("tree"), F.count(F.lit(1)).alias("roots"), F.max(F.struct("n", "root")).alias("m"), F.sum("n").alias("n"), F.sum("size").alias("weight"), F.sum("print").alias("print")).where("roots > 1")
    info = info.groupBy("n", "print", "weight").agg(F.min(F.struct("tree", "path", F.col("m.root").alias("main"))).alias("i")).select("i.path", "i.main", "weight")
    return rooted.join(info, "path")


def _sweep(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among all sets of every open node, enough to join what they join: compared exhaustively, on the full sets.

    The sets outside a node's main component are compared with all of its sets,
    so two sets that links join already are not. A node of more than PART
    shingles is dealt over parts of PART each, by sets and by those outside,
    and every part meets every other in a task of its own.
    """
    outside = rows.groupBy("path").agg(F.sum(F.when(F.col("root") != F.col("main"), F.col("size")).otherwise(0)).alias("out"))
    r = rows.join(outside, "path").withColumns({"blocks": F.ceil(F.col("weight") / PART).cast("int"), "chunks": F.ceil(F.greatest("out", F.lit(1)) / PART).cast("int"), "h": F.xxhash64("rep", "path")})
    lone = F.col("root") != F.col("main")
    whole = (F.col("blocks") == 1) & (F.col("chunks") == 1)
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    one = r.where(whole).select("path", "rep", "root", F.lit(0).alias("block"), F.lit(0).alias("chunk"), lone.alias("asks"), F.lit(True).alias("answers"))
    many = r.where(~whole)
    answers = many.withColumn("chunk", F.explode(every("chunks"))).select("path", "rep", "root", F.pmod("h", "blocks").cast("int").alias("block"), "chunk", F.lit(False).alias("asks"), F.lit(True).alias("answers"))
    asks = many.where(lone).withColumn("block", F.explode(every("blocks"))).select("path", "rep", "root", "block", F.pmod(F.shiftright("h", 20), "chunks").cast("int").alias("chunk"), F.lit(True).alias("asks"), F.lit(False).alias("answers"))
    met = one.unionByName(answers).unionByName(asks).join(sets, "rep")
    return met.groupBy("path", "block", "chunk").applyInArrow(lambda t: _links_in(t, percent), "a long, b long")


def _links_in(t: pa.Table, percent: int) -> pa.Table:
    """Of one part: links between its asking and its answering sets, one for each two components that they join."""
    rep, root = t.column("rep").to_numpy(), np.unique(t.column("root").to_numpy(), return_inverse=True)[1]
    asks, answers = np.flatnonzero(t.column("asks").to_numpy()), np.flatnonzero(t.column("answers").to_numpy())
    lists = t.column("s").combine_chunks()
    offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    size = np.diff(offsets)
    held = np.concatenate([flat[offsets[i] : offsets[i + 1]] for i in answers]) if len(answers) else flat[:0]
    starts = np.concatenate([[0], np.cumsum(size[answers])[:-1]]) if len(answers) else np.empty(0, int)
    known, code = np.unique(held, return_inverse=True)
    mine, out = np.zeros(len(known) + 1, bool), []
    for i in asks if len(answers) else ():
        apart = root[answers] != root[i]
        if not apart.any():
            continue
        own = flat[offsets[i] : offsets[i + 1]]
        at = np.searchsorted(known, own)
        at = at[known[np.minimum(at, len(known) - 1)] == own]
        mine[at] = True
        both = np.add.reduceat(mine[code], starts, dtype=np.int64)
        mine[at] = False
        linked = np.flatnonzero(apart & (100 * both >= percent * (size[answers] + size[i] - both)))
        for r, k in zip(*np.unique(root[answers[linked]], return_index=True), strict=True):
            out.append((rep[i], rep[answers[linked[k]]]))
            root[root == r] = root[i]
    pairs = np.sort(np.array(out, np.int64).reshape(-1, 2), axis=1)
    return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})


def join_sets(classes: DataFrame, sets, percent: int, trees: int = TREES) -> DataFrame:
    """(node, root) of the sets in links, by chosen-path trees; classes: rep, size, minima, sketch; sets: (reps, few) -> rep and its full set s.

    Small nodes are compared pair by pair. In larger ones every set meets a
    pivot first, which joins large groups of near copies by few links a set;
    larger nodes that the links make one component are done: what else they
    hold adds nothing. In the others, the sets outside the main component are
    compared with all. Nodes of more than PART shingles branch on before, two
    levels a round, and are swept in parts where the last round leaves them so.
    """
    sketch = classes.select("rep", *_SET)

    def shared(paths) -> DataFrame:
        sizes = paths().groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        return cut(paths().join(sizes, "path").join(sketch, "rep").select("path", "rep", "tree", "n", *_SET), "neardup-nodes")

    nodes, edges, roots = shared(lambda: _nodes(classes, trees)), None, None
    for k in range(ROUNDS):
        todo = cut(_within_small(nodes, percent).unionByName(_against_pivots(nodes, percent)).distinct(), "neardup-candidates")
        few = todo.count() <= BROADCAST_PAIRS
        links = cut(confirmed(todo, sets(todo.select(F.col("a").alias("rep")).union(todo.select("b")).distinct(), few), percent), "neardup-links")
        edges = links if edges is None else edges.unionByName(links)
        roots = components(edges)
        rows = cut(_open(nodes, roots), "neardup-open")
        last = k == ROUNDS - 1
        now = rows if last else rows.where(F.col("weight") <= PART)
        now = now if k else now.where(F.col("tree") < SWEPT)
        reps = cut(now.select("rep").distinct(), "neardup-asked")
        if n := reps.count():
            edges = edges.unionByName(cut(_sweep(now, sets(reps, n <= BROADCAST_PAIRS), percent), "neardup-links"))
            roots = components(edges)
        large = rows.where(F.col("weight") > PART)
        if last or large.isEmpty():
            break
        below = cut(_deeper(large.select("path", "rep", "tree").join(classes.select("rep", "minima"), "rep")), "neardup-below")
        nodes = shared(lambda below=below: below)
    return roots


def full_sets(docs: DataFrame, reps: DataFrame, n: int, text: str, doc_id: str, few: bool) -> DataFrame:
    """rep and s, the shingles of its text, of the documents in reps; few: their number is known to be bounded."""
    slim = docs.select(F.col(f"`{doc_id}`").cast("long").alias("rep"), F.col(f"`{text}`").alias("t")).join(F.broadcast(reps) if few else reps, "rep", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                sets = [shingles(t, n) for t in part.column(1).to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                flat = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["rep", "s"])

    return slim.mapInArrow(run, "rep long, s array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full shingle sets have 100 * intersection >= percent * union."""
    both = pairs.join(sets.select(F.col("rep").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("rep").alias("b"), F.col("s").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.select("a", "b", shared.alias("i"), (F.size("sa") + F.size("sb") - shared).alias("u")).where(100 * F.col("i") >= percent * F.col("u")).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b): the least node of its component.

    Alternating large-star and small-star rounds, each written to the shared
    folder; a node's neighbours are never gathered, only their least is taken.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "components")
    before = None
    for round_ in itertools.count():
        sym = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = sym.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        # a forest of stars stays as it is: every node has one neighbour below it, which has none
        seen = Observation(f"components-{round_}")
        e = cut(small.where("u > v").distinct().observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_003).alias("h")), "components")
        if seen.get == before or not seen.get["n"]:
            break
        before = seen.get
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v")).distinct()


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id", trees: int = TREES) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (doc_id is the component's least) of every document.

    Two documents are linked when their sets of n-word shingles (A-Z lowered,
    words parted by ASCII white space) share percent in 100 of their union.
    Documents with the same set are one class from the start and stand in the
    join as one set. In each of `trees` trees a set branches by its minwise value
    at the positions that its path picks; GROUPS of trees read positions of
    their own. Small nodes are compared pair by pair, larger ones by pivots and
    then exhaustively between what stays apart (``join_sets``). A pair at 0.8
    meets in no node with the probability `missed`: 3.8e-09 at level 3 (4e-06 in
    the SWEPT trees whose larger nodes are compared there), 3.7e-07 at level 5,
    3.0e-06 at 7. The sketches' filter (MAYBE) of small nodes loses 1.2e-6
    besides. Every link is confirmed on the full sets.

    A text without words (null, empty) has n_shingles 0 and is a component of
    its own. A null doc_id links with nothing, has a null component_id and is
    kept. Rows that repeat a doc_id are one document with several texts. An
    empty table stays empty. Other columns don't matter.
    """
    docs = without(docs.select(F.col(f"`{doc_id}`"), F.col(f"`{text}`")))
    rows = cut(signatures(docs, n, text, doc_id), "neardup-sets")
    classes = rows.where("set_key IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("size"), F.min("minima").alias("minima"), *[F.min(f"k{i}").alias(f"k{i}") for i in range(SKETCH)])
    classes = cut(classes, "neardup-classes")
    roots = join_sets(classes, lambda reps, few: full_sets(docs, reps, n, text, doc_id, few), percent, trees)
    named = classes.select("set_key", "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("set_key", F.coalesce("root", "rep").alias("root"))
    out = rows.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op10_neardup(spark, sf_dir: str) -> DataFrame:
    """Every document's near-duplicate component over 2-word shingles at 0.8."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, n=2, percent=80)


OP10_ORACLE = r"""
WITH RECURSIVE dw AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 1], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws)))) AS i FROM dw WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
e AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2) JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS start, doc_id AS node FROM documents UNION SELECT r.start, both_ways.b FROM r JOIN both_ways ON both_ways.a = r.node)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, doc_id = c.component_id AS kept FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT start AS doc_id, min(node) AS component_id FROM r GROUP BY 1) c USING (doc_id)
"""
