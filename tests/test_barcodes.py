"""Barcodes, their summaries and homology."""

import math

import numpy as np
import pytest

from stepforge import api
from stepforge.operators import barcodes, homology
from stepforge.sources import construct as C, random as R

INF = math.inf


def functions(t):
    return [[(p["t"], p["v"]) for p in r["x"]] for r in t.df.orderBy(*t.df.columns[:-1]).collect()]


def test_stable_rank(spark):
    b = C.barcode_tensor(spark, [[(0, 1), (0, 3), (0, 2), (0, 2), (1, 3)], [(0, 1), (0, 3), (0, 2), (0, INF), (1, 3)], []])
    assert functions(api.barcode_to_stable_rank(b)) == [[(0, 5), (1, 4), (2, 1), (3, 0)], [(0, 5), (1, 4), (2, 2), (3, 1)], [(0, 0)]]


def test_betti_curve(spark):
    b = C.barcode_tensor(spark, [[(0, 2), (1, 3), (0.5, 1.5)], [(1, 3)], [(0, INF), (1, 2)], []])
    assert functions(api.barcode_to_betti_curve(b)) == [[(0, 1), (0.5, 2), (1, 3), (1.5, 2), (2, 1), (3, 0)], [(0, 0), (1, 1), (3, 0)], [(0, 1), (1, 2), (2, 1)], [(0, 0)]]


def test_accumulated_persistence(spark):
    b = C.barcode_tensor(spark, [[(1, 3)], [(0, 0.5)] * 3 + [(0.62, 0.75)], [], [(0, INF)]])
    full = functions(api.barcode_to_accumulated_persistence(b))
    assert full[0] == [(0, 0), (2, 2)] and full[2] == full[3] == [(0, 0)]
    assert np.allclose(full[1], [(0, 0), (0.25, 1.5), (0.685, 1.63)])
    assert np.allclose(functions(api.barcode_to_accumulated_persistence(b, 0.6))[1], [(0, 0), (0.25, 1.5)])


def test_isomorphism_and_order(spark):
    a, b = C.barcode_tensor(spark, [[(0, 1), (0, 2), (0, 1)]]), C.barcode_tensor(spark, [[(0, 2), (0, 1), (0, 1)]])
    assert api.is_isomorphic(a, b) and not (a == b).all_of() and not api.is_isomorphic(a, C.barcode_tensor(spark, [[(0, 2), (0, 1)]]))
    assert [tuple(r) for r in barcodes.bar_order(api.to_bars(C.barcode_tensor(spark, [[(0, 1), (1, 2), (0, 3)]])).select("birth", "death")).collect()] == [(1, 2), (0, 3), (0, 1)]
    with pytest.raises(ValueError):
        C.barcode_tensor(spark, [np.zeros((2, 3))])


def bars(spark, points, max_dim=1, **k):
    h = api.compute_persistent_homology(C.point_clouds(spark, [np.array(points, float)]), max_dim, **k)
    return [sorted((b["birth"], b["death"]) for b in r["x"]) for r in h.df.orderBy("i1").collect()]


def test_homology_of_small_clouds(spark):
    box = [(0, 0), (0, 4), (3, 0), (3, 4)]
    assert bars(spark, box, 2) == [[(0, 3), (0, 3), (0, 4), (0, INF)], [(4, 5)], []]
    assert bars(spark, box, 2, reduced=True)[0] == [(0, 3), (0, 3), (0, 4)]
    assert bars(spark, np.empty((0, 2))) == [[], []] and bars(spark, [(0, 0)]) == [[(0, INF)], []]
    assert bars(spark, [(0, 0), (0, 3)]) == [[(0, 3), (0, INF)], []] and bars(spark, [(1, 1)] * 5) == [[(0, INF)], []]
    assert bars(spark, [(k, 0) for k in range(6)])[1] == []


def naive(dist, top):
    """Bars of a full boundary matrix's reduction."""
    from itertools import combinations

    n, limit = len(dist), dist.max(1).min()
    cells = sorted((max([dist[a, b] for a, b in combinations(s, 2)], default=0.0), len(s), s) for k in range(1, top + 3) for s in combinations(range(n), k))
    cells = [c for c in cells if c[0] <= limit]
    at = {s: i for i, (_, _, s) in enumerate(cells)}
    low, cols, out, dead = {}, {}, [[] for _ in range(top + 1)], set()
    for i, (d, k, s) in enumerate(cells):
        col = {at[f] for f in combinations(s, k - 1)} if k > 1 else set()
        while col and max(col) in low:
            col ^= cols[low[max(col)]]
        if col:
            low[max(col)] = i
            cols[i] = col
            dead |= {i, max(col)}
            b = cells[max(col)]
            if b[1] - 1 <= top and d > b[0]:
                out[b[1] - 1].append((b[0], d))
    for i, (d, k, _) in enumerate(cells):
        if i not in dead and k - 1 <= top:
            out[k - 1].append((d, INF))
    return [sorted(x) for x in out]


@pytest.mark.parametrize(("n", "dim", "top"), [(12, 2, 1), (14, 3, 1), (9, 3, 2), (10, 2, 2)])
def test_homology_equals_a_plain_reduction(n, dim, top):
    for seed in range(6):
        x = np.random.default_rng(seed).normal(size=(n, dim))
        if seed == 5:
            x = np.round(x)  # ties
        d = homology.distances(x)
        got = [sorted(b) for b in homology.rips_barcodes(d, top)]
        assert [len(b) for b in got] == [len(b) for b in naive(d, top)] and all(np.allclose(a, b) for a, b in zip(got, naive(d, top), strict=True) if a)


def test_matrices_and_clouds_agree(spark):
    from stepforge.operators.matrices import DistanceMatrix, stack_matrices

    x = np.random.default_rng(1).normal(size=(10, 2))
    h = api.compute_persistent_homology(stack_matrices([DistanceMatrix.from_numpy(spark, homology.distances(x))]), 1)
    assert [sorted((b["birth"], b["death"]) for b in r["x"]) for r in h.df.orderBy("i1").collect()] == bars(spark, x)
    for one in (x, C.from_numpy(spark, x), DistanceMatrix.from_numpy(spark, homology.distances(x))):
        h = api.compute_persistent_homology(one, 1, spark=spark)
        assert h.shape == (2,) and len(api.element_to_numpy(h[0:1])) == 10
    with pytest.raises(TypeError):
        api.compute_persistent_homology(C.zeros(spark, (1,), "int64"))
    with pytest.raises(ValueError):
        api.compute_persistent_homology(np.zeros(3), spark=spark)


def test_h0_bars_from_pairs(spark):
    d = homology.distances(np.random.default_rng(2).normal(size=(12, 2)))
    edges = spark.createDataFrame([(0, i, j, float(d[i, j])) for i in range(12) for j in range(i)], "k long, i long, j long, d double")
    got = sorted(r["death"] for r in homology.h0_bars(edges, ["k"]).collect())
    assert np.allclose(got, [b[1] for b in sorted(homology.rips_barcodes(d, 0, True)[0])])


def test_forests_of_parts_merge_to_the_smallest_tree(spark, monkeypatch):
    monkeypatch.setattr(homology, "FOREST_EDGES", 40)
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for k, n in enumerate((30, 7, 2)):
        d = np.floor(homology.distances(rng.normal(size=(n, 2))) * 4)  # with ties and zeros
        rows += [(k, f"v{i}", f"v{j}", float(d[i, j])) for i in range(n) for j in range(i)]
        tree, out = {0}, []
        while len(tree) < n:  # the nearest vertex outside, one by one
            w, j = min((d[i, j], j) for i in tree for j in range(n) if j not in tree)
            tree.add(j)
            out.append(float(w))
        want[k] = sorted(w for w in out if w > 0)
    got = {k: [] for k in want}
    for r in homology.h0_bars(spark.createDataFrame(rows, "k int, i string, j string, d double"), ["k"]).collect():
        got[r["k"]].append(r["death"])
        assert r["birth"] == 0
    assert {k: sorted(v) for k, v in got.items()} == want
    some = spark.createDataFrame(rows, "k int, i string, j string, d double").where("k = 1").select("i", "j", "d")
    assert sorted(r["death"] for r in homology.h0_bars(some, []).collect()) == want[1] and homology.h0_bars(some.limit(0), []).count() == 0


def test_clouds_to_distances_end_to_end(spark):
    clouds = R.sample_poisson(spark, (5,), 2, 12.0, generator=R.Generator(3))
    h = api.compute_persistent_homology(clouds, 1)
    assert h.shape == (5, 2)
    d = api.pdist(api.barcode_to_stable_rank(h)[:, 1]).to_numpy()
    assert d.shape == (5, 5) and np.allclose(d, d.T) and (np.diag(d) == 0).all()


def test_rips_h1_query_takes_whole_clouds(spark, tmp_path):
    from itertools import combinations

    from stepforge.plans import catalogue

    rng = np.random.default_rng(5)
    clouds = [rng.normal(size=(34, 2)).astype("float32"), rng.normal(size=(3, 2)).astype("float32")]
    rows = [(100 * k + i, k, [float(c) for c in p]) for k, x in enumerate(clouds) for i, p in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r["i0"], r["i1"], r["t"]): r["v"] for r in catalogue.QUERIES["rips_h1_stable_rank"](spark, str(tmp_path)).collect()}
    want = {}
    for k, x in enumerate(clouds):
        x = x.astype(float)
        dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
        size = lambda s: max((dist[a, b] for a, b in combinations(s, 2)), default=0.0)
        order = sorted((s for m in (1, 2, 3) for s in combinations(range(len(x)), m)), key=lambda s: (size(s), len(s), s))
        at, low, ends = {s: n for n, s in enumerate(order)}, {}, {}
        for n, s in enumerate(order):  # columns of the boundary matrix, by addition from the left
            col = {at[f] for f in combinations(s, len(s) - 1)} if len(s) > 1 else set()
            while col and max(col) in low:
                col ^= low[max(col)]
            if col:
                low[max(col)] = col
                ends[max(col)] = n
        for dim in (0, 1):
            born = [n for n, s in enumerate(order) if len(s) == dim + 1 and n not in ends.values()]
            lengths = [size(order[ends[n]]) - size(order[n]) if n in ends else float("inf") for n in born]
            lengths = [v for v in lengths if v > 0]
            for t in [0.0, *(v for v in lengths if v < float("inf"))]:
                want[k, dim, round(t, 6)] = float(sum(v > t for v in lengths))
    assert got == want


def test_large_clouds_in_bounded_memory(monkeypatch):
    """Widest distances and smallest trees hold no matrix of all coordinates' differences, and no matrix of distances."""
    import tracemalloc

    x = np.random.default_rng(8).normal(size=(1500, 8))
    x[7] = x[3]
    monkeypatch.setattr(homology, "DIFFERENCES", 1 << 14)
    tracemalloc.start()
    wide, tree = homology.widest(x), homology.tree_lengths(x)
    top = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert top < 4_000_000  # the matrix alone would be 18 MB
    d = homology.distances(x)
    assert wide == d.max() and np.allclose([(x[5] - x[9]) @ (x[5] - x[9])], d[5, 9] ** 2)
    i, j = np.triu_indices(1500, 1)
    order = np.argsort(d[i, j], kind="stable")
    assert np.allclose(tree, d[i, j][order][homology._forest(i[order], j[order], 1500)]) and tree[0] == 0
    assert homology._cloud_h0(x, False).count((0.0, INF)) == 1 and len(homology._cloud_h0(x, True)) == 1498
    assert homology._cloud_h0([], False) == [] and homology._cloud_h0([[1.0]], False) == [(0.0, INF)] and homology.widest([]) == 0


def test_dimension_one_lists_no_triangles(monkeypatch):
    """No table of all triangles is held; columns kept by their edges give the same bars."""
    import tracemalloc

    rng = np.random.default_rng(4)
    angle = np.sort(rng.uniform(0, 2 * np.pi, 300))
    d = homology.distances(np.stack((np.cos(angle), np.sin(angle)), 1))
    tracemalloc.start()
    bars = homology.rips_barcodes(d, 1)[1]
    top = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert top < 40_000_000  # 4.5 million triangles, for which a table took over 100 MB
    (longest,) = [b for b in bars if b[1] - b[0] > 0.5]
    gap = max(*np.diff(angle), 2 * np.pi + angle[0] - angle[-1])
    assert longest[0] == pytest.approx(2 * np.sin(gap / 2)) and longest[1] == pytest.approx(3**0.5, abs=0.05)
    d = homology.distances(rng.normal(size=(40, 5)).round(1))
    want = sorted(homology.rips_barcodes(d, 1)[1])
    monkeypatch.setattr(homology, "KEPT_BYTES", 0)
    monkeypatch.setattr(homology, "DIFFERENCES", 64)
    assert sorted(homology.rips_barcodes(d, 1)[1]) == want and len(want) > 5
