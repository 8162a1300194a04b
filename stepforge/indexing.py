"""Reading and writing parts of tensors: integers, slices, boolean masks and integer lists, combined axis by axis.

Several masks or lists index outer-wise, each on its own axis. Slices follow NumPy, negative bounds included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stepforge.tensor import Tensor, axes, flat_index


def _is_mask(k) -> bool:
    return (isinstance(k, Tensor) and k.dtype.family == "bool") or getattr(getattr(k, "dtype", None), "kind", "") == "b" or (isinstance(k, list) and k and all(isinstance(v, bool) for v in k))


def _is_list(k) -> bool:
    return isinstance(k, (list, Tensor)) or hasattr(k, "__array__")


def _values(k) -> list:
    """A mask or index list as a Python list: one entry for each place of an axis, as the caller gave it."""
    if isinstance(k, Tensor):
        return k.to_numpy().tolist()
    return k.tolist() if hasattr(k, "tolist") else list(k)


class _Axis:
    """How one axis is read: kept positions as old position -> new positions."""

    def __init__(self, n: int, key):
        self.gone = False
        if isinstance(key, slice):
            r = range(n)[key]
            self.length, self.range = len(r), r
        elif isinstance(key, int) and not isinstance(key, bool):
            if not -n <= key < n:
                raise IndexError(f"{key} is out of {n}")
            self.length, self.range, self.gone = 1, range(key % n, key % n + 1), True
        else:
            v = _values(key)
            if v and isinstance(v[0], list):
                raise IndexError("masks and lists for one axis have one dimension")
            if _is_mask(key):
                if len(v) != n:
                    raise IndexError(f"a mask of {len(v)} for an axis of {n}")
                v = [i for i, m in enumerate(v) if m]
            if any(not -n <= i < n for i in v):
                raise IndexError(f"an index is out of {n}")
            self.range, self.length = [i % n for i in v], len(v)

    def place(self, df: DataFrame, col: str) -> DataFrame:
        """df without the rows that aren't read, with col at its new position."""
        c = F.col(col)
        if isinstance(self.range, range):
            r = self.range
            if not len(r):
                return df.where(F.lit(False))
            lo, hi = min(r[0], r[-1]), max(r[0], r[-1])
            here = (c >= lo) & (c <= hi) & ((c - r[0]) % r.step == 0)
            return df.where(here).withColumn(col, ((c - r[0]) / r.step).cast("bigint"))
        table = df.sparkSession.createDataFrame([(new, old) for new, old in enumerate(self.range)], "__new bigint, __old bigint")
        joined = df.join(F.broadcast(table) if self.length <= 1_000_000 else table, c == F.col("__old"))  # the caller's list, from the driver
        return joined.withColumn(col, F.col("__new")).drop("__new", "__old")


def _keys(x: Tensor, key) -> list[_Axis]:
    key = list(key) if isinstance(key, tuple) else [key]
    if Ellipsis in [k for k in key if not _is_list(k)]:
        at = next(i for i, k in enumerate(key) if k is Ellipsis)
        key[at : at + 1] = [slice(None)] * (x.ndim - len(key) + 1)
    if len(key) > x.ndim:
        raise IndexError(f"{len(key)} indices for {x.ndim} axes")
    key += [slice(None)] * (x.ndim - len(key))
    return [_Axis(n, k) for n, k in zip(x.shape, key, strict=True)]


def _full_mask(x: Tensor, key) -> Tensor | None:
    if not _is_mask(key) or isinstance(key, list):
        return None
    shape = tuple(key.shape)
    if len(shape) < 2 and x.ndim != 1:
        return None
    if shape != x.shape:
        raise IndexError(f"a mask of {shape} for {x.shape}")
    if isinstance(key, Tensor):
        return key
    from stepforge.sources.construct import from_numpy

    return from_numpy(x.spark, key)


def numbered(df: DataFrame, shape, by: Column) -> DataFrame:
    """Rows where by is true with __rn, their rank in row-major order: counts before blocks of cells, then within them."""
    from pyspark.sql import Window

    rows = df.withColumn("__f", flat_index(shape)).where(by).withColumn("__blk", F.floor(F.col("__f") / 100_000))
    counts = rows.groupBy("__blk").agg(F.count("*").alias("__c"))
    before = counts.withColumn("__e", F.sum("__c").over(Window.orderBy("__blk")) - F.col("__c")).drop("__c")
    return rows.join(before, "__blk").withColumn("__rn", F.col("__e") + F.row_number().over(Window.partitionBy("__blk").orderBy("__f")) - 1).drop("__blk", "__e", "__f")


def get(x: Tensor, key):
    mask = _full_mask(x, key)
    if mask is not None:
        df = x.df.join(mask.df.withColumnRenamed("x", "__m"), axes(x.ndim))
        picked = numbered(df, x.shape, F.col("__m")).select(F.col("__rn").alias("i0"), "x")
        return Tensor(picked, (mask.df.where("x").count(),), x.dtype)
    ks = _keys(x, key)
    df = x.df
    for k, a in enumerate(ks):
        df = a.place(df, f"i{k}")
    kept = [k for k, a in enumerate(ks) if not a.gone]
    if not kept:
        row = df.first()
        return row["x"] if row else None
    return Tensor(df.select(*[F.col(f"i{k}").alias(f"i{n}") for n, k in enumerate(kept)], "x"), [ks[k].length for k in kept], x.dtype)


def _checked(x: Tensor, value) -> None:
    if isinstance(value, Tensor):
        if value.dtype != x.dtype:
            raise TypeError(f"{value.dtype} can't be put into {x.dtype}")
        return
    simple = {"float": (int, float), "int": (int,), "uint": (int,), "bool": (bool,)}.get(x.dtype.family)
    if simple and (not isinstance(value, simple) or isinstance(value, bool) != (x.dtype.family == "bool")):
        raise TypeError(f"{value!r} can't be put into {x.dtype}")


def _literal(x: Tensor, value) -> Column:
    if x.dtype.family in ("float", "int", "uint", "bool"):
        return F.lit(value).cast(x.dtype.spark)
    from stepforge.sources.construct import element

    return F.lit(element(value, x.dtype)) if isinstance(value, (int, float)) else element(value, x.dtype)


def put(x: Tensor, key, value) -> Tensor:
    """x with value in the places of key; a tensor of values is broadcast to them, and at places named twice the last wins."""
    _checked(x, value)
    keys = axes(x.ndim)
    mask = _full_mask(x, key)
    if mask is not None:
        df = x.df.join(mask.df.withColumnRenamed("x", "__m"), keys)
        if not isinstance(value, Tensor):
            return Tensor(df.withColumn("x", F.when(F.col("__m"), _literal(x, value)).otherwise(F.col("x"))), x.shape, x.dtype)
        n = mask.df.where("x").count()
        if value.shape != (n,):
            raise ValueError(f"{value.shape} values for {n} places")
        places = numbered(df, x.shape, F.col("__m")).select(*keys, "__rn")
        new = places.join(value.df.select(F.col("i0").alias("__rn"), F.col("x").alias("__v")), "__rn").drop("__rn").withColumn("__set", F.lit(True))
        out = x.df.join(new, keys, "left")
        return Tensor(out.withColumn("x", F.when(F.col("__set"), F.col("__v")).otherwise(F.col("x"))), x.shape, x.dtype)
    ks = _keys(x, key)
    df = x.df.select(*keys, *[F.col(k).alias(f"p{n}") for n, k in enumerate(keys)])
    for n, a in enumerate(ks):
        df = a.place(df, f"p{n}")
    kept = [n for n, a in enumerate(ks) if not a.gone]
    shape = tuple(ks[n].length for n in kept)
    if isinstance(value, Tensor):
        v = value.broadcast_to(shape)  # ValueError if the places would have to grow
        new = v.df.select(*[F.col(f"i{m}").alias(f"q{m}") for m in range(len(kept))], F.col("x").alias("__v"))
        on = [F.col(f"p{n}") == F.col(f"q{m}") for m, n in enumerate(kept)]
        hit = df.join(new, on) if on else df.join(new)
    else:
        hit = df.withColumn("__v", _literal(x, value))
    order = F.struct(*[f"p{n}" for n in range(x.ndim)])
    new = hit.groupBy(*[F.col(k) for k in keys]).agg(F.max_by(F.struct("__v"), order).alias("__s"))
    out = x.df.join(new, keys, "left")
    return Tensor(out.withColumn("x", F.when(F.col("__s").isNotNull(), F.col("__s.__v")).otherwise(F.col("x"))), x.shape, x.dtype)


def masked_fill(x: Tensor, mask, value) -> Tensor:
    return put(x, mask, value)


def masked_assign(x: Tensor, mask, values: Tensor) -> Tensor:
    return put(x, mask, values)


def axis_fill(x: Tensor, axis: int, mask, value) -> Tensor:
    return put(x, _on_axis(x, axis, mask), value)


def axis_assign(x: Tensor, axis: int, mask, values: Tensor) -> Tensor:
    return put(x, _on_axis(x, axis, mask), values)


def index_fill(x: Tensor, axis: int, index, value) -> Tensor:
    return put(x, _on_axis(x, axis, index), value)


def index_assign(x: Tensor, axis: int, index, values: Tensor) -> Tensor:
    return put(x, _on_axis(x, axis, index), values)


def outer_fill(x: Tensor, keys: tuple, value) -> Tensor:
    """Masks, lists or slices for several axes at once."""
    return put(x, keys, value)


def outer_assign(x: Tensor, keys: tuple, values: Tensor) -> Tensor:
    return put(x, keys, values)


def _on_axis(x: Tensor, axis: int, key) -> tuple:
    return (*[slice(None)] * x._axis(axis), key)
