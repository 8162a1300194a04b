"""Embedding near-duplicates by dual traversal of cover trees.

Vectors are scaled to length 1, so cosine >= t means distance <= r = sqrt(2 - 2t). Equal unit vectors are one class from
the start. Classes are dealt to shards, each a part of a ball: pivots are a bounded sample, as many as full shards are
needed (MAX_PIVOTS at most); a class goes to its nearest pivot; a ball that holds more than a shard's rows is cut into
rings of distance from its pivot, and only a ring of one width of distance (1 / BINS) that is still too full is cut by a
hash. Each shard gets a cover tree: nested levels whose radii halve, each level's centres more than its radius apart, each
node with its measured covering radius. The rings with their measured inner and outer radii are the level above: pairs of
shards that the triangle inequality keeps further apart than r are dropped; each other pair is one task that walks both
trees level by level. Node pairs go by distance > covering radii + r; where distance + covering radii <= r, all pairs of
their rows are links and are counted without being listed; what remains ends in exact double-precision cosines. A task
returns counts of links for each vector and the links that join components within the task, never all pairs.

Cost: pairs of shards whose rings come close are compared, all of them if the vectors have no clusters at this radius; a
shard's rows are then moved once for each other shard. Shards are as large as a task can hold, so up to
SHARD_ROWS * LEAST_SHARDS rows that number doesn't grow.

Defined cases: null, zero, empty, non-finite vectors or ones with null components link with nothing; ids repeated with
equal vectors count as vectors each but are one node; an id repeated with other vectors has the largest of their numbers of
links and the smallest of their components, which it doesn't join; null ids keep their row, link with nothing and are kept;
ids are whole at any size; vectors of other lengths than most never meet (they are compared by length); an empty table
gives no rows; extra columns (labels among them) are ignored.
"""

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from stepforge.llm.components import connected_components, hot_join
from stepforge.llm.storage import bounded_batches, bounded_broadcast, hash_sample, map_frames, materialize

SHARD_ROWS, LEAST_SHARDS, FEW_ROWS, MAX_PIVOTS, BINS = 12_288, 4, 2048, 512, 2048
SLACK = 1e-9
#: For bounds in single precision.
ROOM = 1e-4
_SMALL, _CENTRES = 4096, 256


def _greedy(x: np.ndarray, rows: np.ndarray, radius: float):
    """Rows in groups within radius of the first of each, centres in the order of rows."""
    pts = x[rows]
    left = np.arange(len(rows))
    while len(left):
        close = 2 - 2 * (pts[left[:_CENTRES]] @ pts[left].T) <= radius * radius
        taken = np.zeros(len(left), bool)
        for k in range(len(close)):
            if not taken[k]:
                near = close[k] & ~taken
                near[k] = True
                taken |= near
                yield rows[left[near]]
        left = left[~taken]


class CoverTree:
    """Levels of nodes over the rows of unit vectors x; rows are reordered so that each node's rows are contiguous."""

    def __init__(self, x: np.ndarray, reach: float = 0.5):
        """Radii halve from the first reach * 2^k of at least 2, so that one level's radius is the reach searched for."""
        n, lowest = len(x), reach / 4
        order, radius = np.arange(n), reach * 2.0 ** np.ceil(np.log2(2.0 / reach))
        spans = np.array([[0, n]])
        centres = np.array([0] if n else [], int)
        levels = [(spans, centres)]
        while n and radius > lowest and len(spans) < n:
            radius /= 2
            new_order, sizes = [], []
            for (lo, hi), c in zip(spans.tolist(), levels[-1][1].tolist(), strict=True):
                rows = order[lo:hi]
                if hi - lo > 1:  # nested: a centre stays one
                    groups = list(_greedy(x, np.concatenate(([c], rows[rows != c])), radius))
                else:
                    groups = [rows]
                new_order += groups
                sizes += map(len, groups)
            order, ends = np.concatenate(new_order), np.cumsum(sizes)
            spans, centres = np.stack([ends - sizes, ends], 1), np.array([g[0] for g in new_order])
            levels.append((spans, centres))
        self.order = order
        place = np.empty(n, int)
        place[order] = np.arange(n)
        self.levels = []
        y = x[order]
        for s, c in levels:  # a span of rows is a node; nodes of later levels split it
            cover = np.zeros(len(s))
            for k in np.flatnonzero(s[:, 1] - s[:, 0] > 1) if n else ():
                cover[k] = np.sqrt(max(0.0, 2 - 2 * (y[s[k, 0] : s[k, 1]] @ x[c[k]]).min()))
            self.levels.append((s, place[c], cover if n else np.empty(0)))
        if n and len(spans) < n:  # the last level: rows
            self.levels.append((np.stack([np.arange(n), np.arange(1, n + 1)], 1), np.arange(n), np.zeros(n)))


def _children(upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """For each span of a level, the range of the spans of the next level within it."""
    return np.stack([np.searchsorted(lower[:, 0], upper[:, 0]), np.searchsorted(lower[:, 0], upper[:, 1])], 1)


def close_pairs(ta, a: np.ndarray, tb, b: np.ndarray, reach: float, same: bool = False):
    """Yields ("all", spans of a, spans of b) for node pairs whose rows are all within reach of one another, at last
    ("maybe", i, j): row pairs that may be. a, b are in tree order; same: one tree, of which no pair comes twice."""
    depth = max(len(ta.levels), len(tb.levels))
    la = ta.levels + [ta.levels[-1]] * (depth - len(ta.levels))
    lb = tb.levels + [tb.levels[-1]] * (depth - len(tb.levels))
    pairs = (np.zeros(1, int), np.zeros(1, int))
    a32, b32 = a.astype(np.float32), b.astype(np.float32)
    for k in range(1, depth):
        ca, cb = _children(la[k - 1][0], la[k][0]), _children(lb[k - 1][0], lb[k][0])
        (sa, pa, ra), (sb, pb, rb) = la[k], lb[k]
        out: list[tuple[np.ndarray, np.ndarray]] = []
        every: list[tuple[np.ndarray, np.ndarray]] = []

        def sift(x, y, dots, room, sa=sa, sb=sb, ra=ra, rb=rb, out=out, every=every):
            if same:
                once = x <= y
                x, y, dots = x[once], y[once], dots[once]
            far, radii = np.sqrt(np.maximum(0, 2 - 2 * dots)), ra[x] + rb[y]
            keep = np.maximum(0, 2 - 2 * dots) <= (reach + radii + room) ** 2 + room
            # a node of one row has no pair of its own; near 0, distances from single precision are only good to their root
            inner = keep & (far + radii + room + np.sqrt(room) <= reach) & ((sa[x, 1] - sa[x, 0] > 1) | (sb[y, 1] - sb[y, 0] > 1))
            every.append((x[inner], y[inner]))
            keep &= ~inner
            out.append((x[keep], y[keep]))

        ua, ub = ca[pairs[0]], cb[pairs[1]]
        size = (ua[:, 1] - ua[:, 0]) * (ub[:, 1] - ub[:, 0])
        for i in np.flatnonzero(size > _SMALL):
            x, y = np.arange(*ua[i]), np.arange(*ub[i])
            by = b32[pb[y]].T
            widest = float(rb[y].max())
            for lo in range(0, len(x), 512):
                xs = x[lo : lo + 512]
                dots = a32[pa[xs]] @ by
                # single precision with room to spare and the widest node of the other side; then each pair's own bound
                low = 1 - np.minimum(2.0, reach + ra[xs] + widest + ROOM) ** 2 / 2 - ROOM
                p, q = np.nonzero(dots >= low.astype(np.float32)[:, None])
                sift(xs[p], y[q], dots[p, q].astype(float), ROOM)
        small = np.flatnonzero((size <= _SMALL) & (size > 0))
        for lo in range(0, len(small), 1024):
            i = small[lo : lo + 1024]
            n = size[i]
            own = np.repeat(np.arange(len(i)), n)
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            wide = (ub[i, 1] - ub[i, 0])[own]
            x, y = ua[i, 0][own] + nth // wide, ub[i, 0][own] + nth % wide
            for s in range(0, len(x), 1 << 16):
                xs, ys = x[s : s + (1 << 16)], y[s : s + (1 << 16)]
                sift(xs, ys, np.einsum("ij,ij->i", a[pa[xs]], b[pb[ys]]), SLACK)
        x, y = (np.concatenate(v) for v in zip(*every, strict=True)) if every else (np.empty(0, int),) * 2
        if len(x):
            yield "all", sa[x], sb[y]
        pairs = tuple(np.concatenate(v) for v in zip(*out, strict=True)) if out else (np.empty(0, int),) * 2
        if not len(pairs[0]):
            return
    yield "maybe", *pairs


def _tree_order(rows: pd.DataFrame, reach: float) -> bytes:
    """Not a format to keep: the shard's tree, pickled for the tasks that read it."""
    x = np.stack([np.frombuffer(v, np.float64) for v in rows["vector"]])
    tree = CoverTree(x, reach)
    o = tree.order
    return pickle.dumps((rows["node"].to_numpy(np.int64)[o], rows["copies"].to_numpy(np.int64)[o], x[o], tree.levels), protocol=5)


class _Stored:
    def __init__(self, data: bytes):
        self.ids, self.copies, self.x, self.levels = pickle.loads(data)
        self.counts = np.zeros(len(self.ids), np.int64)
        self.steps = np.zeros(len(self.ids) + 1, np.int64)  # differences of counts that hold for spans of rows
        self.weight = np.concatenate(([0], np.cumsum(self.copies)))
        self.joined: set = set()  # spans whose rows are one component

    def linked(self) -> np.ndarray:
        return self.counts + np.cumsum(self.steps[:-1])


def _links(left: bytes, right: bytes | None, cosine: float):
    """(ids, counts) of linked vectors for each node of both sides, and links that join components of this task. Without a
    right side, of the left side with itself."""
    a = _Stored(left)
    b, same = (a, True) if right is None else (_Stored(right), False)
    parent: dict = {}
    joins = []

    def root(c):
        while parent.get(c, c) != c:
            parent[c] = parent.get(parent[c], parent[c])
            c = parent[c]
        return c

    def join(x, y):
        rx, ry = root(x), root(y)
        if rx != ry:
            parent[max(rx, ry)] = min(rx, ry)
            joins.append((x, y))

    def span(side, lo, hi, one):
        if (lo, hi) not in side.joined:
            side.joined.add((lo, hi))
            for c in side.ids[lo:hi].tolist():
                join(c, one)

    for kind, i, j in close_pairs(a, a.x, b, b.x, float(np.sqrt(2 - 2 * cosine)), same):
        if kind == "all":
            for (alo, ahi), (blo, bhi) in zip(i.tolist(), j.tolist(), strict=True):
                wa, wb = int(a.weight[ahi] - a.weight[alo]), int(b.weight[bhi] - b.weight[blo])
                if same and alo == blo:  # a node with itself: all but one's own
                    a.steps[alo] += wa
                    a.steps[ahi] -= wa
                    a.counts[alo:ahi] -= a.copies[alo:ahi]
                else:
                    a.steps[alo] += wb
                    a.steps[ahi] -= wb
                    b.steps[blo] += wa
                    b.steps[bhi] -= wa
                span(a, alo, ahi, int(b.ids[blo]))
                span(b, blo, bhi, int(a.ids[alo]))
                join(int(a.ids[alo]), int(b.ids[blo]))
            continue
        if same:
            i, j = i[i < j], j[i < j]
        for lo in range(0, len(i), 1 << 16):
            p, q = i[lo : lo + (1 << 16)], j[lo : lo + (1 << 16)]
            linked = np.einsum("ij,ij->i", a.x[p], b.x[q]) >= cosine
            p, q = p[linked], q[linked]
            np.add.at(a.counts, p, b.copies[q])
            np.add.at(b.counts, q, a.copies[p])
            for x, y in zip(a.ids[p].tolist(), b.ids[q].tolist(), strict=True):
                join(x, y)
    ids, counts = (a.ids, a.linked()) if same else (np.concatenate((a.ids, b.ids)), np.concatenate((a.linked(), b.linked())))
    return ids[counts > 0], counts[counts > 0], joins


def unit_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """__id and the unit vector's bytes (null for vectors that link with nothing)."""

    def run(frames):
        for pdf in frames:
            out = []
            for v in pdf["v"]:
                a = None if v is None else np.array([np.nan if c is None else c for c in v] if getattr(v, "dtype", None) == object else v, np.float64)
                norm = None if a is None or not len(a) or not np.isfinite(a).all() else np.sqrt((a * a).sum())
                if norm is not None and not (np.isfinite(norm) and norm > 1e-150):
                    a = a / np.abs(a).max() if np.abs(a).max() > 0 else None
                    norm = None if a is None else np.sqrt((a * a).sum())
                out.append(None if norm is None else (a / norm + 0.0).tobytes())
            yield pd.DataFrame({"__id": pdf["id"], "vector": out})

    return map_frames(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")), run, "__id long, vector binary")


def _pivots(classes: DataFrame, n: int, shard_rows: int) -> dict[int, np.ndarray]:
    """Pivots for each length of vectors, farthest first from a bounded sample by hash."""
    wanted = min(MAX_PIVOTS, max(LEAST_SHARDS if n > FEW_ROWS else 1, -(-n // shard_rows)))
    points: dict[int, list] = {}
    for r in hash_sample(classes, "node", 8 * wanted, ["vector"]):
        v = np.frombuffer(bytes(r["vector"]), np.float64)
        points.setdefault(len(v), []).append(v)
    pivots = {}
    for dim, vs in points.items():
        x = np.stack(vs)
        chosen, far = [0], 2 - 2 * (x @ x[0])
        while len(chosen) < min(wanted, len(x)):
            k = int(far.argmax())
            if far[k] <= 1e-12:
                break
            chosen.append(k)
            far = np.minimum(far, 2 - 2 * (x @ x[k]))
        pivots[dim] = x[chosen]
    return pivots


def shards(classes: DataFrame, pivots: dict[int, np.ndarray], shard_rows: int) -> DataFrame:
    """classes with dim, pivot and shard (a ring, or a part of a ring that is too full) and dist from the pivot."""

    def nearest(frames):
        for pdf in frames:
            vs = [np.frombuffer(v, np.float64) for v in pdf["vector"]]
            dims = np.array([len(v) for v in vs])
            piv, dist = np.full(len(vs), -1), np.full(len(vs), 2.0)
            for d in np.unique(dims):
                if int(d) in pivots:
                    at = np.flatnonzero(dims == d)
                    s = np.stack([vs[i] for i in at]) @ pivots[int(d)].T
                    piv[at], dist[at] = s.argmax(1), np.sqrt(np.maximum(0, 2 - 2 * s.max(1)))
            yield pdf.assign(dim=dims, pivot=piv, dist=dist, bin=(dist * BINS).astype(int))

    placed = materialize(map_frames(classes, nearest, "vector binary, node long, copies long, dim int, pivot int, dist double, bin int"), "placed")
    order = Window.partitionBy("dim", "pivot").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # 2 * BINS rows a ball at most
    bins = placed.groupBy("dim", "pivot", "bin").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)))
    parts = F.ceil(F.col("n") / F.lit(shard_rows)).cast("int")
    rings = materialize(bins.select("dim", "pivot", "bin", F.floor(F.col("before") / F.lit(shard_rows)).cast("int").alias("ring"), parts.alias("parts")), "rings")
    dealt = placed.join(bounded_broadcast(rings, rings.count()), ["dim", "pivot", "bin"])
    part = F.when(F.col("parts") > 1, 1 + F.pmod(F.xxhash64("node"), "parts")).otherwise(0).cast("int")
    return dealt.select("vector", "node", "copies", "dim", "pivot", F.concat_ws("-", "ring", F.when(part > 0, F.col("bin")).otherwise(0), part).alias("shard"), "dist")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = 0.9, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of vectors."""
    spark = vectors.sparkSession
    unit = materialize(unit_vectors(vectors, id_col, vec_col), "unit")
    good = unit.where("vector is not null and __id is not null")
    classes = materialize(good.groupBy("vector").agg(F.min("__id").alias("node"), F.count("*").alias("copies")), "classes")
    n = classes.count()
    pivots = _pivots(classes, n, shard_rows)
    reach = float(np.sqrt(2 - 2 * cosine))

    def plant(pdf: pd.DataFrame) -> pd.DataFrame:
        one = pdf.iloc[0]
        return pd.DataFrame({"dim": [one["dim"]], "pivot": [one["pivot"]], "shard": [one["shard"]], "inner": [pdf["dist"].min()], "radius": [pdf["dist"].max()], "tree": [_tree_order(pdf, reach)]})

    planted = shards(classes, pivots, shard_rows).groupBy("dim", "pivot", "shard").applyInPandas(plant, "dim int, pivot int, shard string, inner double, radius double, tree binary")
    trees = materialize(planted, "trees")
    gaps = [(d, i, j, float(np.sqrt(max(0.0, 2 - 2 * p[i] @ p[j])))) for d, p in pivots.items() for i in range(len(p)) for j in range(i, len(p))]  # MAX_PIVOTS squared at most a length
    gaps += [(d, -1, -1, 0.0) for d in {r["dim"] for r in trees.select("dim").distinct().collect()} - set(pivots)]
    gap = spark.createDataFrame(gaps or [(0, 0, 0, 0.0)], "dim int, pa int, pb int, gap double")
    side = lambda s: trees.select("dim", *(F.col(c).alias(f"{n}{s}") for c, n in (("pivot", "p"), ("shard", "k"), ("inner", "i"), ("radius", "r"))))
    near = (F.col("gap") <= F.col("ra") + F.col("rb") + reach + SLACK) & (F.col("ia") <= F.col("gap") + F.col("rb") + reach + SLACK) & (F.col("ib") <= F.col("gap") + F.col("ra") + reach + SLACK)
    pairs = side("a").join(gap, ["dim", "pa"]).join(side("b"), ["dim", "pb"]).where((F.col("pa") < F.col("pb")) | (F.col("ka") <= F.col("kb"))).where(near).select("dim", "pa", "ka", "pb", "kb")
    pairs = materialize(pairs, "tree-pairs")
    tree = lambda s, name: trees.select("dim", F.col("pivot").alias(f"p{s}"), F.col("shard").alias(f"k{s}"), F.col("tree").alias(name))
    self_ = (F.col("pa") == F.col("pb")) & (F.col("ka") == F.col("kb"))
    both = pairs.where(~self_).join(tree("a", "left"), ["dim", "pa", "ka"]).join(tree("b", "right"), ["dim", "pb", "kb"]).select("left", "right")
    both = both.union(pairs.where(self_).join(tree("a", "left"), ["dim", "pa", "ka"]).select("left", F.lit(None).cast("binary").alias("right")))
    # a pair of shards is a task's work: as many partitions as pairs, in turn
    both = bounded_batches(both.repartition(max(1, min(pairs.count(), 4096))))

    def walk(frames):
        for pdf in frames:
            for left, right in zip(pdf["left"], pdf["right"], strict=True):
                ids, counts, joins = _links(left, right, cosine)
                if len(ids):
                    yield pd.DataFrame({"u": ids, "v": pd.array([None] * len(ids), "Int64"), "n": counts})
                if joins:
                    yield pd.DataFrame({"u": [x for x, _ in joins], "v": pd.array([y for _, y in joins], "Int64"), "n": 0})

    found = materialize(map_frames(both, walk, "u long, v long, n long"), "links")
    comps = connected_components(found.where("v is not null").select("u", "v"))
    counts = found.where("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("n"))
    per_class = materialize(classes.join(counts.join(comps, "node", "full"), "node", "left"), "class-links")
    each = hot_join(good.dropDuplicates(["__id", "vector"]), per_class, ["vector"], "copies", unit.count())
    full = each.select("__id", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("c"))
    smallest = full.groupBy("__id").agg(F.max("n_links").alias("n_links"), F.min("c").alias("c"))
    out = unit.select("__id", F.col("vector").isNotNull().alias("ok")).join(smallest, "__id", "left")
    links = F.when(F.col("ok"), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long")
    cid = F.when(F.col("ok"), F.coalesce("c", "__id")).otherwise(F.col("__id"))
    return out.select(F.col("__id").alias(id_col), links.alias("n_links"), cid.alias("component_id"), F.coalesce(F.col("__id") == cid, F.lit(True)).alias("kept"))
