"""Golden values of evaluation, algebra, norms, distances and reductions on tiny inputs."""

import math

import numpy as np
import pytest

from pyspark.sql import functions as F

from stepforge import api
from stepforge.functions.numeric import MAX
from stepforge.operators import blocks, pairs, steps
from stepforge.sources import construct as C, random as R
from stepforge.tensor import Tensor, from_points, to_points

INF = math.inf
F1, G1 = [(0, 3.0), (1, 2.0), (4, 5.0), (6, 0.0)], [(0, 2.0), (3, 4.0), (4, 2.0), (5, 1.0), (8, 3.0)]
#: A (2, 3) tensor whose L1 norms are [[30, 42, 36], [25, 0, 6]] and last times [[10, 6, 4], [3, 8, 2]].
TABLE = [
    [[(0, 3.0), (10, 0.0)], [(0, 7.0), (6, 0.0)], [(0, 9.0), (4, 0.0)]],
    [[(0, 10.0), (2, 5.0), (3, 3.0)], [(0, 0.0), (8, 0.0)], [(0, 3.0), (2, 0.0)]],
]


def pts(t):
    return [(r["t"], r["v"]) for r in t.df.first()["x"]]


def rects(spark, **k):
    rows = api.iterate_rectangles(C.pcf(spark, F1), C.pcf(spark, G1), **k).orderBy("l").collect()
    return [tuple(r) for r in rows]


ALL = [(0, 1, 3, 2), (1, 3, 2, 2), (3, 4, 2, 4), (4, 5, 5, 2), (5, 6, 5, 1), (6, 8, 0, 1), (8, INF, 0, 3)]


@pytest.mark.parametrize(("k", "expected"), [({}, ALL), ({"b": 4.0}, ALL[:3]), ({"a": 2.0, "b": 4.5}, [(2, 3, 2, 2), (3, 4, 2, 4), (4, 4.5, 5, 2)]), ({"a": 1.0, "b": 1.0}, [])])
def test_rectangles(spark, k, expected):
    assert rects(spark, **k) == expected


def test_segments_beyond_the_last_breakpoint_and_before_the_first(spark):
    p = to_points(C.pcf(spark, F1))
    assert [tuple(r) for r in steps.iterate_segments(p, [], a=10.0).collect()] == [(10.0, MAX, 0.0)]
    late = spark.createDataFrame([(2.0, 7.0), (3.0, 8.0)], "t double, v double")
    assert [tuple(r) for r in steps.iterate_segments(late, [], 1.0, 2.5).collect()] == [(1.0, 2.5, 7.0)]


def test_sums_are_compacted_and_scalars_are_not(spark):
    f, g = C.pcf(spark, [(0, 0.0), (1, 1.0), (2, 0.0)]), C.pcf(spark, [(0, 1.0), (1, 0.0), (2, 0.0)])
    assert pts(f + g) == [(0, 1), (2, 0)]
    assert pts(f - g) == [(0, -1), (1, 1), (2, 0)]
    assert pts(g + 1) == [(0, 2), (1, 1), (2, 1)] and pts(2 - f) == [(0, 2), (1, 1), (2, 2)]
    assert pts(f * 3) == [(0, 0), (1, 3), (2, 0)] and pts(1 / f) == [(0, INF), (1, 1), (2, INF)]
    assert pts(-g) == [(0, -1), (1, 0), (2, 0)] and pts(f / g)[0] == (0, 0)
    assert math.isnan(pts(f / f)[0][1])
    f += g
    assert pts(f) == [(0, 1), (2, 0)]


def test_power_warns_of_infinities(spark):
    f = C.pcf(spark, [(0, 2.0), (1, 3.0)])
    assert pts(f**2) == [(0, 4), (1, 9)]
    with pytest.warns(RuntimeWarning):
        C.pcf(spark, [(0, 0.0)]) ** -1


def test_whole_number_functions_divide_towards_zero(spark):
    f = C.pcf(spark, np.array([[0, 7], [2, -7]]))
    assert f.dtype.name == "pcf64i" and pts(f / 2) == [(0, 3), (2, -3)] and pts(f + f) == [(0, 14), (2, -14)]


def test_evaluation(spark):
    f = C.pcf(spark, F1)
    assert [f(t).item() for t in (0, 0.5, 1, 5.9, 6, 100)] == [3, 3, 2, 5, 0, 0]
    assert f([[4, 0], [0.5, 7]]).to_numpy().tolist() == [[5, 3], [3, 0]]
    x = C.pcf_tensor(spark, [F1, G1])
    assert x(3.5).to_numpy().tolist() == [2, 4] and x([0, 3.5]).to_numpy().tolist() == [[3, 2], [2, 4]]
    t = C.from_numpy(spark, np.array([8.0, 5.0]))
    assert x(t).to_numpy().tolist() == [[0, 5], [3, 1]]
    for bad in (-1, [1, -1]):
        with pytest.raises(ValueError):
            x(bad)


def test_evaluation_at_many_times_takes_the_other_plan(spark):
    times = spark.range(10_500).select(F.col("id").alias("k"), (F.col("id") / 1000).alias("time"))
    got = steps.evaluate_at(to_points(C.pcf_tensor(spark, [F1, G1])), ["i0"], times).groupBy("i0").agg(F.sum("v").alias("v"), F.count("*").alias("n"))
    want = {k: sum(max((t, v) for t, v in f if t <= i / 1000)[1] for i in range(10_500)) for k, f in enumerate([F1, G1])}
    assert {r["i0"]: (r["v"], r["n"]) for r in got.collect()} == {k: (v, 10_500) for k, v in want.items()}


def test_norms(spark):
    x = C.pcf_tensor(spark, TABLE)
    x[1, 0] = [(0, 10.0), (2, 5.0), (3, 0.0)]
    assert api.lp_norm(x).to_numpy().tolist() == [[30, 42, 36], [25, 0, 6]]
    for f, p, n in [([(0, 3.0), (4, 0.0)], 2, 6), ([(0, 1.0), (1, 2.0), (2, 0.0)], 2, 5**0.5), ([(0, 1.0), (1, 3.0), (2, 0.0)], 3, 28 ** (1 / 3))]:
        assert api.lp_norm(C.pcf(spark, f), p).item() == pytest.approx(n)
    assert api.linfinity_norm(C.pcf(spark, [(0, -4.0), (1, 3.0)])).item() == 4
    assert api.l2_norm(C.pcf(spark, [(0, 3.0), (4, 0.0)])).item() == 6
    with pytest.raises(ValueError):
        api.lp_norm(x, 0.5)


def test_distances(spark):
    assert api.lp_distance(C.pcf(spark, [(0, 3.0), (1, 0.0)]), C.pcf(spark, [(0, 1.0), (2, 0.0)])) == 3
    x = C.pcf_tensor(spark, [[(0, 10.0), (2, 5.0), (3, 0.0)], [(0, 5.0), (6, 0.0)]])
    assert api.pdist(x).to_numpy().tolist() == [[0, 25], [25, 0]] == api.cdist(x, x).to_numpy().tolist()
    y = C.pcf_tensor(spark, [[(0, 4.0), (1, 0.0)], [(0, 1.0), (1, 0.0)]])
    assert api.pdist(y, 3).to_numpy()[0, 1] == pytest.approx(3)
    assert api.l2_kernel(y).to_numpy().tolist() == [[16, 4], [4, 1]] == api.l2_cross_kernel(y, y).to_numpy().tolist()
    tails = C.pcf_tensor(spark, [[(0, 1.0), (1, 2.0)], [(0, 0.0), (1, 2.0)]])
    assert api.pdist(tails).to_numpy()[0, 1] == 1
    fs = [C.pcf(spark, [(0, 10.0), (2, 5.0), (3, 0.0)]), C.pcf(spark, [(0, 5.0), (6, 0.0)])]
    assert api.pdist(fs)[1, 0] == 25 and api.element_to_numpy(fs[1]).tolist() == [[0, 5], [6, 0]]
    with pytest.raises(ValueError):
        api.pdist(C.pcf_tensor(spark, TABLE))
    with pytest.raises(ValueError):
        api.pdist(x, 0.5)
    with pytest.raises(TypeError):
        api.cdist(x, x.astype("pcf32"))


@pytest.mark.parametrize("p", [1.0, 2.0, 3.0])
def test_join_strategies_agree(spark, p):
    x = to_points(R.noisy_sin(spark, (25,), 30, "pcf64", R.Generator(5)))
    a, b = (pairs.pdist(x, p=p, strategy=s).toPandas().sort_values(["i", "j"]) for s in ("plain", "bucket"))
    assert len(a) == len(b) == 300 and np.allclose(a["d"], b["d"], rtol=1e-12)
    one = pairs.cdist(x, x, ["i0"], ["i0"], p, "bucket").where("i0 = 3 and j0 = 7").first()["d"]
    assert one == pytest.approx(a[(a.i == 3) & (a.j == 7)]["d"].iloc[0])


def test_reductions(spark):
    x = C.pcf_tensor(spark, [[(0, 1.0), (2, 3.0)], [(0, 0.0)]])
    m = api.mean(x)
    assert m.shape == (1,) and pts(m) == [(0, 0.5), (2, 1.5)]
    t = C.pcf_tensor(spark, TABLE)
    assert api.max_time(t, 0).to_numpy().tolist() == [10, 8, 4] and api.max_time(t, 1).to_numpy().tolist() == [10, 8]
    three = C.pcf_tensor(spark, [[(0, 0.1), (1, 0.0)], [(0, 0.2), (2, 0.0)], [(0, 0.3), (3, 0.0)]])
    assert pts(api.mean(three))[-1] == (3, 0.0)
    huge = C.pcf_tensor(spark, [[(0, 1e200), (1, 0.0)], [(0, 1e200), (2, 0.0)]])
    assert pts(api.mean(huge)) == [(0, 1e200), (1, 5e199), (2, 0.0)]
    assert pts(api.reduce(x, "max")) == [(0, 1), (2, 3)] and pts(api.reduce(x, lambda v: F.sum(F.col(v) * 2))) == [(0, 2), (2, 6)]


def test_running_sums_over_several_ranges(spark, monkeypatch):
    monkeypatch.setattr(steps, "ROWS_A_RANGE", 50)
    rows = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("t"), F.lit(1.0).alias("n"))
    got = steps.running_sum(rows, ["k"], "t", "n", "s").toPandas().sort_values(["k", "t"])
    assert (got.groupby("k")["n"].cumsum() == got["s"]).all() and len(got) == 1000


def test_numbering_over_several_ranges(spark, monkeypatch):
    monkeypatch.setattr(C, "NUMBERED_ROWS", 100)
    df = spark.range(950).select((F.col("id") * 7919 % 950).alias("a"), F.concat(F.lit("k"), F.col("id") % 5).alias("b"))
    got = C.numbered(df, ["b", "a"], "n").orderBy("n").collect()
    assert [r["n"] for r in got] == list(range(950)) and [(r["b"], r["a"]) for r in got] == sorted((r["b"], r["a"]) for r in got)


def test_construction(spark):
    assert pts(C.pcf(spark, [(0, 1.0), (3, 3.0), (2, 2.0)])) == [(0, 1), (2, 2), (3, 3)] and pts(C.pcf(spark, [])) == [(0, 0)]
    with pytest.raises(ValueError):
        C.pcf(spark, [(1, 1.0)])
    with pytest.raises(ValueError):
        C.pcf_tensor(spark, [[[(0, 1.0)]], [[(0, 1.0)], [(0, 2.0)]]])
    content = spark.createDataFrame([(k, float(k % 3), float(k)) for k in range(9)], "row long, t double, v double")
    cells = [(0, 0, 3), (1, 3, 6), (2, 6, 8)]
    x = C.from_serial_content(content, spark.createDataFrame(cells, "i0 long, start long, stop long"), (3,))
    assert [len(r["x"]) for r in x.df.orderBy("i0").collect()] == [3, 3, 2]
    with pytest.raises(ValueError):
        C.from_serial_content(content, spark.createDataFrame([(0, 3, 3)], "i0 long, start long, stop long"), (1,))
    assert from_points(to_points(x), (5,)).df.count() == 5


def test_random_functions_repeat(spark):
    a, b = (R.noisy_cos(spark, (2, 3), 12, "pcf64", R.Generator(3)) for _ in range(2))
    assert a.array_equal(b) and not a.array_equal(R.noisy_cos(spark, (2, 3), 12, "pcf64", R.Generator(4)))
    f = pts(a)
    assert len(f) == 12 and f[0][0] == 0 and f[-1][1] == 0 and all(0 < t < 1 for t, _ in f[1:])
    clouds = R.sample_poisson(spark, (40,), 2, 30.0, [0, 1], [1, 2], R.Generator(2))
    n = [len(r["x"]) for r in clouds.df.collect()]
    assert 25 < np.mean(n) < 35 and all(0 <= p[0] <= 1 <= p[1] <= 2 for r in clouds.df.collect() for p in r["x"])
    for lo, hi in (([1, 1], [0, 2]), ([0], [1, 1])):
        with pytest.raises(ValueError):
            R.sample_poisson(spark, (1,), 2, 1.0, lo, hi)
    with pytest.raises(TypeError):
        R.noisy_sin(spark, (1,), dtype="float64")


def test_wrapper_knows_its_shape(spark):
    x = C.pcf_tensor(spark, TABLE)
    assert isinstance(x, Tensor) and (x.shape, x.ndim, x.size, len(x), x.strides, x.offset) == ((2, 3), 2, 6, 2, (3, 1), 0)


def test_blocks_travel_by_group(spark, monkeypatch):
    """A block goes to each pair of groups that its own is in, not to each pair of blocks."""
    monkeypatch.setattr(blocks, "BLOCK_POINTS", 64)
    monkeypatch.setattr(blocks, "BLOCK_FUNCTIONS", 4)
    monkeypatch.setattr(blocks, "GROUP_BLOCKS", 5)
    x = to_points(R.noisy_sin(spark, (60,), 16, "pcf64", R.Generator(5)))
    count, most, _ = blocks.extent(x, ["i0"])
    made = blocks.blocks(x, ["i0"], count).localCheckpoint()
    rows, met = blocks.dealt(made, most, None, most)
    assert (made.count(), most, met) == (15, 16, 36) and rows.count() == 15 * 9 < 15 * 16
    for a, b in ((pairs.pdist(x), pairs.pdist(x, strategy="plain")), (pairs.l2_kernel(x), pairs.l2_kernel(x, strategy="plain"))):
        a, b = (d.toPandas().sort_values(["i", "j"]) for d in (a, b))
        assert a[["i", "j"]].to_numpy().tolist() == b[["i", "j"]].to_numpy().tolist() and np.allclose(a.iloc[:, 2], b.iloc[:, 2], rtol=1e-12)
    y = x.where("i0 % 3 = 0").withColumn("t", F.col("t") + 0.25)  # begins late
    a, b = (pairs.cdist(x, y, ["i0"], ["i0"], strategy=s).toPandas().sort_values(["i0", "j0"])["d"].to_numpy() for s in ("block", "plain"))
    assert len(a) == len(b) == 1200 and np.allclose(a, b, rtol=1e-12)


def test_functions_too_long_for_a_table_are_looked_up(monkeypatch):
    rng = np.random.default_rng(3)
    t = [np.sort(rng.integers(0, 40, n)).astype(float) for n in (5, 30, 1, 12)]
    t = [np.unique(x) for x in t]
    v = [rng.normal(size=len(x)) for x in t]
    for x in v:
        x[-1] = 0.0
    block = blocks.Block([np.arange(4)], np.cumsum([0, *map(len, t)])[:-1], np.concatenate(t), np.concatenate(v))
    want = [blocks.Sweep(block).integrals(a, b, np.multiply) for a, b in zip(t, v, strict=True)]
    grid = np.arange(41.0)
    at = lambda f, g: np.array([g[np.searchsorted(f, x, "right") - 1] if x >= f[0] else 0.0 for x in grid])
    assert np.allclose(want, [[(at(a, b) * at(c, d))[:-1].sum() for c, d in zip(t, v, strict=True)] for a, b in zip(t, v, strict=True)])
    monkeypatch.setattr(blocks, "TABLE_CELLS", 0)
    monkeypatch.setattr(blocks, "CHUNK_CELLS", 8)
    assert np.allclose([blocks.Sweep(block).integrals(a, b, np.multiply) for a, b in zip(t, v, strict=True)], want, rtol=1e-12)


def test_own_pair_integrals_go_by_block(spark):
    x = to_points(R.noisy_sin(spark, (20,), 30, "pcf64", R.Generator(5)))
    x = x.union(spark.createDataFrame([(20, 0.6, 1.0), (20, 0.65, -2.0), (21, 0.9, 1.0)], x.schema))  # begins within, and after the end
    got, want = (pairs.integrate_all(x, F.least, np.fmin, a=0.2, b=0.7, strategy=s) for s in ("auto", "plain"))
    assert "MapInPandas" in got._jdf.queryExecution().toString() or "MapInArrow" in got._jdf.queryExecution().toString()
    a, b = (d.toPandas().sort_values(["i", "j"]) for d in (got, want))
    assert len(a) == 210 and a[["i", "j"]].to_numpy().tolist() == b[["i", "j"]].to_numpy().tolist() and np.allclose(a["d"], b["d"], rtol=1e-12)


def test_many_groups_of_blocks_are_written_once(spark, monkeypatch):
    """Beyond DEALT_GROUPS groups no block is copied: pairs of partitions of one written table make all pairs of functions."""
    for name, value in (("BLOCK_POINTS", 64), ("BLOCK_FUNCTIONS", 4), ("LEAST_GROUPS", 3), ("DEALT_GROUPS", 2)):
        monkeypatch.setattr(blocks, name, value)
    x = to_points(R.noisy_sin(spark, (30,), 16, "pcf64", R.Generator(5)))
    count, most, _ = blocks.extent(x, ["i0"])
    made = blocks.written_groups(blocks.blocks(x, ["i0"], count), most)
    met = blocks.met(made, None)
    assert (made.count(), made.rdd.getNumPartitions(), met.count()) == (8, 4, 8 * 9 // 2) and "CartesianProduct" in met._jdf.queryExecution().toString()
    y = x.where("i0 % 3 = 0").withColumn("t", F.col("t") + 0.25)  # begins late
    uneven = lambda a, b: a - 2 * b
    for fn in (lambda s: pairs.cdist(x, y, ["i0"], ["i0"], strategy=s), lambda s: pairs.integrate_all(x, uneven, uneven, a=0.2, b=0.7, strategy=s)):
        made = fn("block")
        a, b = (d.toPandas().sort_values(d.columns[:2]) for d in (made, fn("plain")))
        assert len(a) in (300, 435) and a.iloc[:, :2].to_numpy().tolist() == b.iloc[:, :2].to_numpy().tolist() and np.allclose(a.iloc[:, 2], b.iloc[:, 2], rtol=1e-12)
        assert "CartesianProduct" in made._jdf.queryExecution().toString()
