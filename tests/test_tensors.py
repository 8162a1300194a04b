"""Tensors against NumPy."""

import math

import numpy as np
import pytest

from stepforge import api, dtypes
from stepforge.operators.matrices import DistanceMatrix, SymmetricMatrix, matrix_cells, stack_matrices
from stepforge.sources import construct as C
from stepforge.sources.storage import load, save
from stepforge.tensor import Tensor, allclose

A = np.arange(24.0).reshape(2, 3, 4)


@pytest.fixture
def x(spark):
    return C.from_numpy(spark, A)


@pytest.mark.parametrize("key", [0, (1, 2), (slice(None), 1), (slice(None, None, -1), slice(0, 3, 2)), (slice(-1, None), slice(None, -1)), (Ellipsis, 3), (slice(5, 9),), (0, [1, 1, 2]), ([-1, 0],), (slice(None), slice(None), [-1, -2]), (slice(None), [True, False, True])])
def test_reading(x, key):
    assert np.array_equal(x[key].to_numpy(), A[key])


def test_outer_reading_and_elements(x):
    assert np.array_equal(x[[0, 1], [0, 2], [1, 3]].to_numpy(), A[np.ix_([0, 1], [0, 2], [1, 3])])
    assert np.array_equal(x[[True, False], [0, 2, 2]].to_numpy(), A[np.ix_([0], [0, 2, 2])])
    assert x[1, 2, 3] == 23 and np.array_equal(x[A % 3 == 0].to_numpy(), A[A % 3 == 0])
    assert np.array_equal(x[x > 7.0].to_numpy(), A[A > 7]) and [t.shape for t in x] == [(3, 4)] * 2
    ten = C.from_numpy(x.spark, np.array([10, 20, 30, 40, 50]))
    assert ten[[1, 1, 2, 0]].to_numpy().tolist() == [20, 20, 30, 10] and ten[[-1, -2]].to_numpy().tolist() == [50, 40]
    for key in (2, (0, 0, 4), [3], (0, 0, 0, 0), [True]):
        with pytest.raises(IndexError):
            x[key]


@pytest.mark.parametrize("key", [0, (slice(None), 1), (0, slice(1, None), slice(None, None, 2)), (slice(None), [0, 2]), (slice(None), slice(None), [True, False, False, True]), ([1], [2, 0], [3])])
def test_writing_one_value(x, key):
    b = A.copy()
    b[np.ix_(*key) if isinstance(key, tuple) and all(isinstance(k, list) for k in key) else key] = -1
    y = x.copy()
    y[key] = -1.0
    assert np.array_equal(y.to_numpy(), b) and np.array_equal(x.to_numpy(), A)


def test_writing_tensors(x):
    b, y = A.copy(), x.copy()
    y[1] = x[0, 0]
    b[1] = A[0, 0]
    y[b > 8] = -2.0
    b[b > 8] = -2
    assert np.array_equal(y.to_numpy(), b)
    mask = A % 5 == 0
    y[mask] = C.from_numpy(x.spark, np.arange(5.0))
    b[mask] = np.arange(5.0)
    assert np.array_equal(y.to_numpy(), b)
    y[:, [1, 1], :] = C.from_numpy(x.spark, np.arange(2.0).reshape(1, 2, 1))  # the last one named wins
    b[:, 1, :] = 1
    assert np.array_equal(y.to_numpy(), b)
    with pytest.raises(ValueError):
        y[0, 0] = x
    with pytest.raises(ValueError):
        y[mask] = C.from_numpy(x.spark, np.arange(4.0))
    for bad in ("a", True, C.from_numpy(x.spark, np.arange(4))):
        with pytest.raises(TypeError):
            y[0, 0] = bad


def test_shapes(x):
    for t, e in [
        (x.T, A.T), (x.transpose([1, 0, 2]), A.transpose(1, 0, 2)), (x.swapaxes(0, -1), A.swapaxes(0, -1)), (x.reshape(4, -1), A.reshape(4, -1)), (x.reshape((24,)), A.ravel()),
        (x.flatten(), A.ravel()), (x.expand_dims(-1), A[..., None]), (x.expand_dims(1).squeeze(1), A), (x[0:1].squeeze(), A[0]), (x[0, 0].broadcast_to((2, 3, 4)), np.broadcast_to(A[0, 0], (2, 3, 4))),
        (C.concatenate([x, x], -1), np.concatenate([A, A], -1)), (C.stack([x, x], -1), np.stack([A, A], -1)), (C.stack([x, x]), np.stack([A, A])),
    ]:
        assert t.shape == e.shape and np.array_equal(t.to_numpy(), e)
    nine = C.from_numpy(x.spark, np.arange(9.0))
    assert [t.shape[0] for t in C.array_split(nine, 4)] == [3, 2, 2, 2]
    assert [t.to_numpy().tolist() for t in C.split(nine, [2, 5])] == [[0, 1], [2, 3, 4], [5, 6, 7, 8]] and len(C.split(nine, 3)) == 3
    for f in (lambda: C.split(nine, 4), lambda: x.reshape(5, 5), lambda: x.squeeze(0), lambda: x.broadcast_to((3, 4)), lambda: x + C.from_numpy(x.spark, np.arange(3.0)), lambda: C.concatenate([x, x[0]])):
        with pytest.raises(ValueError):
            f()


def test_arithmetic(x):
    col = C.from_numpy(x.spark, np.arange(3.0).reshape(3, 1))
    c = np.arange(3.0).reshape(3, 1)
    with np.errstate(all="ignore"):
        for t, e in [(x + col, A + c), (x - col, A - c), (x * col, A * c), (x / col, A / c), (2 - x, 2 - A), (x / 0, A / 0), (-x, -A), (x**2, A**2), (x // 5, A // 5), (x // col, A // c), (x < 5.0, A < 5), (x >= col, A >= c), (x == col, A == c), (x != 3.0, A != 3)]:
            assert np.array_equal(t.to_numpy(), e, equal_nan=t.dtype.family == "float")
    y = x.copy()
    y *= col
    assert np.array_equal(y.to_numpy(), A * c)
    with pytest.raises(ValueError):
        col += x
    assert ((x > 3.0) * (x < 9.0)).to_numpy().sum() == 5
    assert float(C.from_numpy(x.spark, np.array([2.5]))) == 2.5 and int(C.from_numpy(x.spark, np.array([7]))) == 7 and bool(C.from_numpy(x.spark, np.array([True])))
    with pytest.raises(ValueError):
        float(x)
    with pytest.raises(TypeError):
        x + C.from_numpy(x.spark, np.arange(4))


def test_whole_numbers(spark):
    i = C.from_numpy(spark, np.array([7, -7, 5]))
    assert (i // -2).to_numpy().tolist() == [-4, 3, -3] and (i // 0).to_numpy().tolist() == [0, 0, 0]
    assert (i / 2).dtype.name == "float64" and (i / 2).to_numpy().tolist() == [3.5, -3.5, 2.5]
    with pytest.raises(TypeError):
        i /= 2
    assert C.from_numpy(spark, np.array([1.9, -1.9])).astype("int32").to_numpy().tolist() == [1, -1]
    u = i.astype("uint32")
    with pytest.raises(TypeError):
        -u
    with pytest.raises(TypeError):
        u.astype("float64")
    assert dtypes.numpy_type("pcf32i") is np.int32


def test_equality_and_closeness(spark, x):
    assert x.array_equal(x.copy()) and not x.array_equal(x + 1) and not x.array_equal(x[0])
    assert allclose(x, x + 1e-9) and not allclose(x, x + 1) and not allclose(x, x[0])
    nan = C.from_numpy(spark, np.array([math.nan, 1.0]))
    assert not nan.array_equal(nan) and (nan == nan).to_numpy().tolist() == [False, True] and (nan > 0.0).to_numpy().tolist() == [False, True]
    f = C.pcf_tensor(spark, [[(0, 1.0)], [(0, 2.0), (1, 3.0)]])
    assert (f == f[0:1]).to_numpy().tolist() == [True, False] and f.array_equal(f.copy())
    with pytest.raises(TypeError):
        allclose(f, f)
    m = stack_matrices([DistanceMatrix.from_numpy(spark, [[0, 1], [1, 0]])])
    assert allclose(m, m)
    with pytest.raises(TypeError):
        f < f  # noqa: B015


def test_broadcasting_of_functions(spark):
    f = C.pcf_tensor(spark, [[(0, 1.0), (2, 0.0)], [(0, 5.0)]])
    g = f.reshape(2, 1) + f
    assert g.shape == (2, 2) and [[(p["t"], p["v"]) for p in r["x"]] for r in g.df.orderBy("i0", "i1").collect()] == [[(0, 2), (2, 0)], [(0, 6), (2, 5)], [(0, 6), (2, 5)], [(0, 10)]]
    assert api.combine(f, f, lambda a, b: a - b).array_equal(C.zeros(spark, (2,), "pcf64"))


def test_matrices(spark):
    d = DistanceMatrix.zeros(spark, 3)
    d[0, 2] = 4.0
    d[2, 0] = 5.0
    assert d[0, 2] == d[2, 0] == 5 and d[1, 1] == 0
    for key, v, error in [((0, 1), -1, ValueError), ((1, 1), 1, ValueError), ((0, 3), 1, IndexError)]:
        with pytest.raises(error):
            d[key] = v
    full = [[0, 1, 2], [1, 0, 3], [2, 3, 0]]
    m = DistanceMatrix.from_numpy(spark, full)
    assert m.to_numpy().tolist() == full and m.to_dense().count() == 9
    for bad in ([[0, 1], [2, 0]], [[1, 1], [1, 0]], [[0, -1], [-1, 0]], [[0, 1]]):
        with pytest.raises(ValueError):
            DistanceMatrix.from_numpy(spark, bad)
    s = SymmetricMatrix.from_numpy(spark, [[-1, 2], [2, 3]])
    assert s.to_numpy().tolist() == [[-1, 2], [2, 3]]
    t = stack_matrices([m, m])
    assert t.shape == (2,) and t[1:].flatten().shape == (1,)
    assert sorted(tuple(r) for r in matrix_cells(t[0:1]).collect()) == [(0, 1, 0, 1.0), (0, 2, 0, 2.0), (0, 2, 1, 3.0)]
    assert sorted(tuple(r)[1:] for r in matrix_cells(stack_matrices([s])).collect()) == [(0, 0, -1.0), (1, 0, 2.0), (1, 1, 3.0)]


def test_whole_matrices_need_no_join(spark):
    """Squares and cells of matrices all of whose pairs are known are made row by row, whatever their size."""
    x = C.pcf_tensor(spark, [[(0, 10.0), (2, 5.0), (3, 0.0)], [(0, 5.0), (6, 0.0)], [(0, 1.0), (1, 0.0)]])
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for m in (api.pdist(x), api.l2_kernel(x)):
        assert sorted(map(tuple, m.to_dense().collect())) == sorted((i, j, m[i, j]) for i in range(3) for j in range(3))
        assert plan(m.to_dense()).count("Join") == plan(m.pairs).count("Join")
        t = stack_matrices([m, m])
        cells = sorted(map(tuple, matrix_cells(t).collect()))
        assert cells == sorted(map(tuple, matrix_cells(t[0:2]).collect())) and "collect_list" not in plan(matrix_cells(t)).split("MapInPandas")[0]
    m[2, 0] = 7.0
    assert m.to_numpy()[0, 2] == 7 and m.to_dense().count() == 9
    d = api.pdist(x)
    assert DistanceMatrix.from_dense(d.to_dense(), 3).to_numpy().tolist() == d.to_numpy().tolist()
    square = d.to_dense().collect()
    cell = [tuple(r) for r in square if r["i"] != r["j"]]
    for bad in (square[1:], [*square[1:], (1, 2, 0.0)], [(i, j, v + (i < j)) for i, j, v in square], [*square[:-1], (7, 7, 0.0)], [*((i, i, 0.0) for i in range(3)), *[cell[0]] * 6]):
        with pytest.raises(ValueError):
            DistanceMatrix.from_dense(spark.createDataFrame(bad, "i long, j long, v double"), 3)


@pytest.mark.parametrize("dtype", list(dtypes.DTYPES))
def test_saving_every_dtype(spark, tmp_path, dtype):
    z = C.zeros(spark, (2, 2), dtype)
    save(z, f"{tmp_path}/t")
    back = load(spark, f"{tmp_path}/t")
    assert (back.shape, back.dtype) == (z.shape, z.dtype) and sorted(back.df.collect()) == sorted(z.df.collect())


def test_loading_something_else(spark, tmp_path):
    (tmp_path / "head").mkdir()
    (tmp_path / "head" / "x.txt").write_text("{}")
    with pytest.raises(ValueError):
        load(spark, str(tmp_path))


def test_construction_errors(spark):
    with pytest.raises(TypeError):
        C.from_numpy(spark, np.array([object()]))
    with pytest.raises(TypeError):
        dtypes.dtype("complex64")
    assert C.mapping_tensor(spark, (2, 3)).to_numpy().tolist() == [[0, 1, 2], [10, 11, 12]]
    assert isinstance(C.pcf(spark, [(0, 1.0)]), Tensor)
