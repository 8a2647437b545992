"""Upward paths in a graph of parents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brinewell.session import cut

DEPTH, PATHS = 32, 8


def parent_paths(nodes: DataFrame, edges: DataFrame, root: str | None, start: DataFrame | None = None, depth: int = DEPTH, paths: int | None = PATHS) -> DataFrame:
    """(id, path, end) of every upward path: end is my_drive, orphan, unresolved_parent, cycle or depth_limit.

    nodes(id), edges(id, parent_id), start(id): whose paths (all nodes by
    default). All paths go up one level a round, so a round is one join of the
    open paths with the edges; each is written before the next, and the visited
    ids are the path's own. `paths` keeps the first of each start, in the order
    of the ids on them.
    """
    known = nodes.select(F.col("id").alias("parent_id"), F.lit(True).alias("known")).distinct()
    up = edges.select(F.col("id").alias("at"), "parent_id").distinct()
    open_paths = (start if start is not None else nodes).select("id").distinct().select("id", F.col("id").alias("at"), F.array("id").alias("path"))
    done: list[DataFrame] = []
    level = 1
    while True:
        step = open_paths.join(up, "at", "left").join(known, "parent_id", "left")
        p = F.col("parent_id")
        end = (
            F.when(p.isNull(), F.when(F.col("at") == F.lit(root), "my_drive").otherwise("orphan"))
            .when(F.array_contains("path", p), "cycle")
            .when(F.lit(level >= depth), "depth_limit")
            .when(p == F.lit(root), "my_drive")
            .when(F.col("known").isNull(), "unresolved_parent")
        )
        longer = F.when(p.isNull() | F.col("end").isin("cycle", "depth_limit"), F.col("path")).otherwise(F.concat("path", F.array(p)))
        step = cut(step.withColumn("end", end).withColumn("path", longer).select("id", F.coalesce("parent_id", "at").alias("at"), "path", "end"), "paths")
        done.append(step.where("end IS NOT NULL").select("id", "path", "end"))
        open_paths = step.where("end IS NULL").select("id", "at", "path")
        level += 1
        if level > depth + 1 or open_paths.isEmpty():
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    if paths is None:
        return out
    w = Window.partitionBy("id").orderBy(F.array_join("path", "/"), "end")
    return out.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= paths).drop("_rn")
