"""Connected components by alternating large-star and small-star rounds; edges never leave the executors."""

import numpy as np
import pandas as pd

from pyspark.sql import DataFrame, functions as F

from stepforge.llm.storage import discard, map_frames, materialize

#: Edges that one task contracts to stars before the rounds.
PART_EDGES = 1 << 18

#: Keys with more rows than HOT_ROWS and more than a MOST_HOT-th of all rows are hot; there are fewer than MOST_HOT.
HOT_ROWS, MOST_HOT = 50_000, 10_000


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """left joined with right, which has one row a key and, in column `size`, about how many of the `total` rows of left have
    it. Rows of hot keys, fewer than MOST_HOT keys whatever the tables, meet theirs by broadcast, so no task gets one key
    with a share of all rows; the others are dealt by key. Both sides are read more than once: written tables do best."""
    limit = max(HOT_ROWS, total // MOST_HOT)
    hot = right.where(F.col(size) > limit)
    if hot.isEmpty():
        return left.join(right, keys)
    cold = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(right.where(F.col(size) <= limit), keys)
    return left.join(F.broadcast(hot), keys).unionByName(cold)


def _with_lowest(e: DataFrame, rows: int) -> DataFrame:
    """e with m, the lowest v of each u. A hub, which may be an end of most edges, doesn't gather in one task."""
    low = e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    if rows <= HOT_ROWS:
        return e.join(low.drop("n"), "u")
    low = materialize(low, "lowest")
    return hot_join(e, low, ["u"], "n", rows).drop("n")


def _large_star(e: DataFrame, rows: int) -> DataFrame:
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_lowest(both, 2 * rows).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(e: DataFrame, rows: int) -> DataFrame:
    down = e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    joined = _with_lowest(down, rows)
    rest = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.union(joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join the same nodes as (u, v): from each node to the smallest that it reaches, but for those smallest nodes."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(apart := np.flatnonzero(root[a] != root[b])):
        x, y = root[a[apart]], root[b[apart]]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    leaves = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[leaves], nodes[root[leaves]]


def _contracted(e: DataFrame, parts: int) -> DataFrame:
    """e dealt evenly over parts, each reduced to its stars; a single part holds the components as they are."""

    def run(frames):
        rows = [pdf[["u", "v"]].to_numpy(np.int64) for pdf in frames]
        if rows:
            yield pd.DataFrame(dict(zip("uv", stars(*np.concatenate(rows).T), strict=True)))

    return map_frames(e.repartition(parts), run, "u long, v long")


def connected_components(edges: DataFrame, a: str = "u", b: str = "v") -> DataFrame:
    """(node, component) for every node with an edge to another node; component is the smallest node reachable.
    Parts of the edges are contracted first, which leaves no round to do where one part holds all.
    Rounds are O(log^2 n); each is written to the shared folder, so a lost executor costs one round at most, and the one before
    is deleted. Null ends and loops are ignored; no edges: no rows."""
    e = materialize(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    rows, mark = e.count(), None
    parts = -(-rows // PART_EDGES)
    if rows:
        first, e = e, materialize(_contracted(e, parts), "edges")
        discard(first)
        rows = e.count()
    while parts > 1:
        half = _large_star(e, rows)
        e2 = materialize(_small_star(materialize(half, "large-star") if rows > HOT_ROWS else half, rows), "edges")
        discard(e)
        now = tuple(e2.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        e, rows = e2, now[0]
        if now == mark:
            break
        mark = now
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
