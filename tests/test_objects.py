"""Blocks of functions, pickling, lists of functions, files of the binary format, and dimension 1 of homology."""

import pickle
import struct

import numpy as np
import pytest

from pyspark.sql import functions as F

from stepforge import api
from stepforge.operators import blocks, homology, matrices, pairs, steps
from stepforge.sources import binary, construct as C


def random_points(spark, n, seed, keys=1):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        t = np.unique(np.concatenate(([0.0], rng.integers(0, 12, rng.integers(0, 9)) / 2)))
        v = np.append(rng.integers(-3, 4, len(t) - 1).astype(float), 0.0)
        rows += [((k,) if keys == 1 else (k // 3, k % 3)) + (float(a), float(b)) for a, b in zip(t, v, strict=True)]
    return spark.createDataFrame(rows, ", ".join(f"i{k} long" for k in range(keys)) + ", t double, v double")


def rows_of(df, digits=9):
    return sorted(tuple(round(x, digits) if isinstance(x, float) else x for x in r) for r in df.collect())


@pytest.mark.parametrize("p", [1.0, 2.0, 3.0])
def test_blocks_equal_joins(spark, monkeypatch, p):
    x, y = random_points(spark, 23, 1), random_points(spark, 11, 2, 2)
    monkeypatch.setattr(blocks, "BLOCK_POINTS", 24)
    monkeypatch.setattr(blocks, "BLOCK_FUNCTIONS", 8)
    for how in ("plain", "bucket"):
        assert rows_of(pairs.pdist(x, "i0", p, "block")) == rows_of(pairs.pdist(x, "i0", p, how))
        assert rows_of(pairs.cdist(x, y, ["i0"], ["i0", "i1"], p, "block")) == rows_of(pairs.cdist(x, y, ["i0"], ["i0", "i1"], p, how))
        assert rows_of(pairs.l2_kernel(x, "i0", "block")) == rows_of(pairs.l2_kernel(x, "i0", how))


def test_functions_too_long_for_a_block_take_the_join(spark, monkeypatch):
    x = random_points(spark, 6, 3)
    monkeypatch.setattr(pairs, "LONGEST", 3)
    assert not pairs._by_block("auto", (x, ["i0"])) and rows_of(pairs.pdist(x)) == rows_of(pairs.pdist(x, "i0", 1.0, "block"))


@pytest.mark.parametrize("size", [1e-300, 1e-20, 1e-12, 1.0, 1e14, 1e300])
def test_means_of_any_size_are_exact(spark, size):
    f = spark.createDataFrame([(0, 0.0, size), (0, 2.0, 0.0), (1, 0.0, 3 * size), (1, 1.0, -size), (1, 3.0, 0.0)], "i0 long, t double, v double")
    got = {r["t"]: r["v"] for r in steps.mean(f, [], "i0", 2).collect()}
    want = {0.0: 2 * size, 1.0: 0.0, 2.0: -size / 2, 3.0: 0.0}
    assert got.keys() == want.keys() and all(abs(got[t] - want[t]) <= 1e-15 * size for t in want)


def test_means_over_ranges(spark, monkeypatch):
    x = random_points(spark, 40, 4)
    whole = rows_of(steps.mean(x, [], "i0", 40))
    monkeypatch.setattr(steps, "ROWS_A_RANGE", 3)
    assert rows_of(steps.mean(x, [], "i0", 40)) == whole
    grouped = x.withColumn("k", F.col("i0") % 2)
    cut = rows_of(steps.mean(grouped, ["k"], "i0", 20))
    monkeypatch.setattr(steps, "ROWS_A_RANGE", 500_000)
    assert cut == rows_of(steps.mean(grouped, ["k"], "i0", 20))


@pytest.mark.parametrize("op", ["max", "min"])
@pytest.mark.parametrize("zero", [True, False])
def test_tournaments_equal_the_join(spark, monkeypatch, op, zero):
    x = random_points(spark, 17, 5).withColumn("k", F.col("i0") % 3)
    quick = rows_of(steps.fold(x, ["k"], "i0", op, zero)), rows_of(steps.fold(x, [], "i0", op, zero))
    monkeypatch.setattr(steps, "FOLD_POINTS", 0)
    assert quick == (rows_of(steps.fold(x, ["k"], "i0", op, zero)), rows_of(steps.fold(x, [], "i0", op, zero)))


def test_pickles(spark):
    x = C.pcf_tensor(spark, [[(0, 1), (2, 0)], [(0, 3), (1, 0)]], "pcf64")
    y = pickle.loads(pickle.dumps(x))
    assert y.shape == x.shape and y.dtype == x.dtype and x.array_equal(y)
    b = C.barcode_tensor(spark, [[(0, 2), (1, float("inf"))], []])
    assert b.array_equal(pickle.loads(pickle.dumps(b)))
    m = pickle.loads(pickle.dumps(api.pdist(x)))
    assert isinstance(m, matrices.DistanceMatrix) and m.to_numpy().tolist() == api.pdist(x).to_numpy().tolist()


def test_lists_of_functions(spark):
    x = C.pcf_tensor(spark, [[(0, 10), (2, 5), (3, 0)], [(0, 5), (6, 0)]], "pcf64")
    fs = [x[0], x[1]]
    assert api.pdist(fs).to_numpy().tolist() == api.pdist(x).to_numpy().tolist()
    assert api.cdist(fs, fs).to_numpy().tolist() == api.cdist(x, x).to_numpy().tolist() == [[0, 25], [25, 0]]
    assert api.lp_norm(fs).to_numpy().tolist() == [25, 30]
    assert api.pdist([]).size == 0 and api.cdist(fs, []).shape == (2, 0) and api.lp_norm([]).shape == (0,)
    with pytest.raises(TypeError):
        api.pdist([x[0], 3])
    assert api.pdist([x[0:1], x[1]]).to_numpy().tolist() == api.pdist(x).to_numpy().tolist()
    assert api.to_string(x[1:2]) == "[(0, 5), (6, 0)]" and api.n_points(x).to_numpy().tolist() == [3, 2]


def as_file(tmp_path, version, kind, code, body):
    text = lambda s: struct.pack("<Q", len(s)) + s.encode()
    data = binary.MAGIC + b"e" + struct.pack("<i", version) + b"".join(text(s) for s in ("0.4.0", "today", "linux-x86_64")[: version + 1]) + struct.pack("<I", kind) + struct.pack("<ii", *code) + body
    path = tmp_path / f"{version}-{kind}-{code[0]}-{code[1]}.bin"
    path.write_bytes(data)
    return str(path)


def test_binary_files(spark, tmp_path):
    shape = lambda *n: struct.pack(f"<{1 + 2 * len(n)}Q", len(n), *(v for k in range(len(n)) for v in (n[k], int(np.prod(n[k + 1 :])))))
    load = lambda *a: binary.load_binary(spark, as_file(tmp_path, *a))
    x = load(2, 1, (1, 64), shape(2, 3) + np.arange(6.0).tobytes())
    assert x.dtype.name == "float64" and x.to_numpy().tolist() == [[0, 1, 2], [3, 4, 5]]
    assert load(1, 1, (2, 32), shape(2) + np.array([7, -8], "i4").tobytes()).to_numpy().tolist() == [7, -8]
    assert load(2, 1, (4, 8), shape(2) + b"\x01\x00").to_numpy().tolist() == [True, False]
    assert [int(v) for v in load(2, 1, (3, 64), shape(1) + np.array([2**63 + 5], "u8").tobytes()).df.toPandas()["x"]] == [2**63 + 5]
    one = struct.pack("<Q", 2) + np.array([0.0, 3.0, 1.5, 0.0], "f4").tobytes()
    f = load(2, 1, (100, 32), shape(2) + one + struct.pack("<Q", 1) + np.zeros(2, "f4").tobytes())
    assert f.shape == (2,) and api.element_to_numpy(f[0:1]).tolist() == [[0, 3], [1.5, 0]]
    assert api.element_to_numpy(load(1, 2, (100, 32), one)).tolist() == [[0, 3], [1.5, 0]]
    bars = load(2, 2, (10000, 64), struct.pack("<Q", 1) + np.array([0.0, np.inf]).tobytes())
    assert api.element_to_numpy(bars).tolist() == [[0, np.inf]]
    assert load(2, 2, (1120, 64), struct.pack("<Q", 3) + np.array([1.0, 2.0, 3.0]).tobytes()).to_numpy().tolist() == [[0, 1, 2], [1, 0, 3], [2, 3, 0]]
    assert load(2, 2, (1100, 64), struct.pack("<Q", 2) + np.array([1.0, 2.0, 3.0]).tobytes()).to_numpy().tolist() == [[1, 2], [2, 3]]
    cloud = load(2, 1, (1000, 64), shape(1) + struct.pack("<ii", 1, 64) + shape(2, 2) + np.arange(4.0).tobytes())
    assert [list(map(list, r["x"])) for r in cloud.df.collect()] == [[[0, 1], [2, 3]]]
    for bad in ((3, 1, (1, 64), b""), (2, 9, (1, 64), b""), (2, 1, (5, 5), b""), (2, 1, (1, 64), shape(9))):
        with pytest.raises(ValueError):
            load(*bad)


def test_dimension_one_in_both_ways(monkeypatch):
    rng = np.random.default_rng(6)
    for _ in range(40):
        d = homology.distances(rng.normal(size=(rng.integers(3, 13), 2)).round(int(rng.integers(0, 3))))
        quick = homology.rips_barcodes(d, 1)
        with monkeypatch.context() as m:
            m.setattr(homology, "RANKED_TRIANGLES", -1)
            assert [sorted(b) for b in quick] == [sorted(b) for b in homology.rips_barcodes(d, 1)]
