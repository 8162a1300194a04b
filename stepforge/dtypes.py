"""Element types of tensors: the name used by callers, the family, the Spark type of the column x and the NumPy type."""

from dataclasses import dataclass

PCF64 = "array<struct<t:double,v:double>>"
PCF32 = "array<struct<t:float,v:float>>"


@dataclass(frozen=True)
class DType:
    name: str
    family: str
    spark: str
    numpy: str | None = None

    def __repr__(self) -> str:
        return self.name


_TABLE = [
    DType("float32", "float", "float", "float32"),
    DType("float64", "float", "double", "float64"),
    DType("int32", "int", "int", "int32"),
    DType("int64", "int", "bigint", "int64"),
    DType("uint32", "uint", "bigint", "uint32"),
    DType("uint64", "uint", "decimal(20,0)", "uint64"),
    DType("boolean", "bool", "boolean", "bool"),
    DType("pcf32", "pcf", PCF32, "float32"),
    DType("pcf64", "pcf", PCF64, "float64"),
    DType("pcf32i", "ipcf", "array<struct<t:int,v:int>>", "int32"),
    DType("pcf64i", "ipcf", "array<struct<t:bigint,v:bigint>>", "int64"),
    DType("pcloud32", "pcloud", "array<array<float>>", "float32"),
    DType("pcloud64", "pcloud", "array<array<double>>", "float64"),
    DType("barcode32", "barcode", "array<struct<birth:float,death:float>>", "float32"),
    DType("barcode64", "barcode", "array<struct<birth:double,death:double>>", "float64"),
    DType("symmat32", "symmat", "struct<n:bigint,vals:array<float>>", "float32"),
    DType("symmat64", "symmat", "struct<n:bigint,vals:array<double>>", "float64"),
    DType("distmat32", "distmat", "struct<n:bigint,vals:array<float>>", "float32"),
    DType("distmat64", "distmat", "struct<n:bigint,vals:array<double>>", "float64"),
]
DTYPES = {d.name: d for d in _TABLE}
globals().update(DTYPES)

#: The zero element of each family as a SQL expression.
ZERO = {
    "float": "0", "int": "0", "uint": "0", "bool": "false", "pcf": "array(named_struct('t', 0, 'v', 0))", "ipcf": "array(named_struct('t', 0, 'v', 0))",
    "pcloud": "array()", "barcode": "array()", "symmat": "named_struct('n', 0L, 'vals', array())", "distmat": "named_struct('n', 0L, 'vals', array())",
}

_NUMERIC = ("float32", "float64", "int32", "int64")
#: Casts that exist, by source; others are TypeErrors.
CASTS = {
    **{a: {b for b in _NUMERIC} for a in _NUMERIC},
    "uint32": {"uint32", "uint64", "int32", "int64"}, "uint64": {"uint32", "uint64", "int32", "int64"},
    "boolean": {"boolean"}, "pcf32": {"pcf32", "pcf64"}, "pcf64": {"pcf32", "pcf64"}, "pcf32i": {"pcf32i", "pcf64i"}, "pcf64i": {"pcf32i", "pcf64i"},
    "pcloud32": {"pcloud32", "pcloud64"}, "pcloud64": {"pcloud32", "pcloud64"},
    **{a: {a} for a in ("barcode32", "barcode64", "symmat32", "symmat64", "distmat32", "distmat64")},
}
for _a in ("int32", "int64"):
    CASTS[_a] = CASTS[_a] | {"uint32", "uint64"}


def dtype(d) -> DType:
    """A DType from a DType, its name or a NumPy dtype."""
    if isinstance(d, DType):
        return d
    name = getattr(d, "name", None) or (d if isinstance(d, str) else getattr(d, "__name__", str(d)))
    name = {"bool": "boolean", "bool_": "boolean", "float": "float64", "int": "int64"}.get(name, name)
    if name not in DTYPES:
        raise TypeError(f"unknown dtype {d!r}")
    return DTYPES[name]


def numpy_type(d):
    """The NumPy scalar type behind a dtype."""
    import numpy as np

    return np.dtype(dtype(d).numpy).type
