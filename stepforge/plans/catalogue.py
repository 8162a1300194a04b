"""Registered queries over the driver's tables, each with its equivalent SQL where SQL can express it."""

from __future__ import annotations

import math
import uuid

from collections.abc import Callable

import numpy as np

from pyspark.sql import DataFrame, SparkSession, functions as F

from stepforge import api, dtypes
from stepforge.functions.numeric import INF, round_scaled
from stepforge.operators import barcodes, homology, matrices, pairs, steps
from stepforge.sources import construct, random as rnd, storage
from stepforge.tensor import Tensor, allclose, cells, from_points, to_points

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return register


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _r(c, name: str | None = None, digits: int = 6):
    col = F.col(c) if isinstance(c, str) else c
    return round_scaled(col.cast("double"), digits).alias(name or c)


# ---- inputs ------------------------------------------------------------------------------------------------------------

def user_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i0, t, v): one function for each user of events."""
    events = _read(spark, sf_dir, "events")
    return construct.points_from_events(events).join(construct.rank_axis(events, "user_id"), "user_id").select("i0", "t", "v")


_USERS = """
e AS (SELECT dense_rank() OVER (ORDER BY user_id) - 1 AS i0, event_id, epoch_us(ts) AS us, value FROM events),
p AS (SELECT i0, (us - min(us) OVER (PARTITION BY i0)) / 86400000000.0::DOUBLE AS t,
        CASE WHEN row_number() OVER (PARTITION BY i0 ORDER BY us DESC, event_id DESC) = 1 THEN 0.0::DOUBLE ELSE value END AS v FROM e),
s AS (SELECT i0, t AS l, coalesce(lead(t) OVER (PARTITION BY i0 ORDER BY t), 1.7976931348623157e308) AS r, v FROM p)
"""


def user_tensor(spark: SparkSession, sf_dir: str) -> Tensor:
    points = user_points(spark, sf_dir)
    n = points.select("i0").distinct().count()
    return from_points(points, (n,), "pcf64", complete=True)


def type_user_points(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, tuple[int, int]]:
    """(i0, i1, t, v): one function for each event type and user; absent pairs are zero functions."""
    ev = _read(spark, sf_dir, "events")
    points = construct.points_from_events(ev, ["event_type", "user_id"])
    kinds, users = construct.rank_axis(ev, "event_type"), construct.rank_axis(ev, "user_id", "i1")
    return points.join(kinds, "event_type").join(users, "user_id").select("i0", "i1", "t", "v"), (kinds.count(), users.count())


_TYPES = """
e AS (SELECT dense_rank() OVER (ORDER BY event_type) - 1 AS i0, dense_rank() OVER (ORDER BY user_id) - 1 AS i1, event_id, epoch_us(ts) AS us, value FROM events),
p AS (SELECT i0, i1, (us - min(us) OVER (PARTITION BY i0, i1)) / 86400000000.0::DOUBLE AS t,
        CASE WHEN row_number() OVER (PARTITION BY i0, i1 ORDER BY us DESC, event_id DESC) = 1 THEN 0.0::DOUBLE ELSE value END AS v FROM e),
s AS (SELECT i0, i1, t AS l, coalesce(lead(t) OVER (PARTITION BY i0, i1 ORDER BY t), 1.7976931348623157e308) AS r, v FROM p)
"""


def grid(spark: SparkSession, sf_dir: str) -> Tensor:
    """Float tensor (event type, user): the largest value, 0 for absent pairs."""
    ev = _read(spark, sf_dir, "events")
    kinds, users = construct.rank_axis(ev, "event_type"), construct.rank_axis(ev, "user_id", "i1")
    shape = (kinds.count(), users.count())
    top = ev.groupBy("event_type", "user_id").agg(F.max("value").alias("m")).join(kinds, "event_type").join(users, "user_id")
    return Tensor(cells(spark, shape).join(top.select("i0", "i1", "m"), ["i0", "i1"], "left").withColumn("x", F.coalesce("m", F.lit(0.0))), shape, "float64")


_GRID = """
k AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS i0 FROM (SELECT DISTINCT event_type FROM events)),
u AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS i1 FROM (SELECT DISTINCT user_id FROM events)),
m AS (SELECT event_type, user_id, max(value) AS m FROM events GROUP BY ALL),
g AS (SELECT i0, i1, coalesce(m, 0.0::DOUBLE) AS x, (SELECT count(*) FROM k) AS n0, (SELECT count(*) FROM u) AS n1
      FROM k CROSS JOIN u LEFT JOIN m USING (event_type, user_id))
"""


def bars(spark: SparkSession, sf_dir: str, infinite: bool = False) -> DataFrame:
    """(o_orderpriority, birth, death) in days from order to shipment; infinite: lines still open never die."""
    o, li = _read(spark, sf_dir, "orders"), _read(spark, sf_dir, "lineitem")
    day = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / F.lit(86_400_000_000.0)
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"]).where(F.col("l_shipdate") > F.col("o_orderdate"))
    death = F.when(F.col("l_linestatus") == "O", F.lit(INF)).otherwise(day("l_shipdate")) if infinite else day("l_shipdate")
    return j.select("o_orderpriority", day("o_orderdate").alias("birth"), death.alias("death"))


def _bars_sql(infinite: bool = False) -> str:
    d = "epoch_us(l_shipdate) / 86400000000.0::DOUBLE"
    d = f"CASE WHEN l_linestatus = 'O' THEN 'Infinity'::DOUBLE ELSE {d} END" if infinite else d
    return f"""b AS (SELECT o_orderpriority, epoch_us(o_orderdate) / 86400000000.0::DOUBLE AS birth, {d} AS death
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate > o_orderdate)"""


# ---- constructors and evaluation ---------------------------------------------------------------------------------------

@query(f"WITH {_USERS} SELECT i0, round(t, 6) AS t, v FROM p")
def pcf_from_events(spark, d):
    return user_points(spark, d).select("i0", _r("t"), "v")


@query(f"WITH {_USERS} SELECT i0, round(l, 6) AS l, CASE WHEN r > 1e300 THEN NULL ELSE round(r, 6) END AS r, v FROM s")
def segments(spark, d):
    return steps.segments(user_points(spark, d), ["i0"]).select("i0", _r("l"), F.when(F.col("r") <= 1e300, _r("r")).alias("r"), "v")


@query(f"WITH {_USERS} SELECT i0, round(greatest(l, 5), 6) AS l, round(least(r, 20), 6) AS r, v FROM s WHERE r > 5 AND l < 20")
def segments_clipped(spark, d):
    return steps.iterate_segments(user_points(spark, d), ["i0"], 5.0, 20.0).select("i0", _r("l"), _r("r"), "v")


@query(f"WITH {_USERS} SELECT i0, v FROM s WHERE l <= 10 AND 10 < r")
def eval_scalar(spark, d):
    return steps.evaluate(user_points(spark, d), ["i0"], 10.0)


@query(f"WITH {_USERS}, q AS (SELECT i AS i1, i * 2.5::DOUBLE AS time FROM range(13) t(i)) SELECT i0, i1, v AS x FROM s JOIN q ON l <= time AND time < r")
def eval_grid(spark, d):
    return user_tensor(spark, d)(np.arange(13) * 2.5).df


@query(f"WITH {_USERS}, q AS (SELECT i AS k, i * 0.003::DOUBLE AS time FROM range(11000) t(i)) SELECT i0, k, v FROM s JOIN q ON l <= time AND time < r")
def eval_many_times(spark, d):
    """All users at many times."""
    times = spark.range(11000).select(F.col("id").alias("k"), (F.col("id") * 0.003).alias("time"))
    return steps.evaluate_at(user_points(spark, d), ["i0"], times).select("i0", "k", "v")


_PAIR = f"WITH {_USERS}, f AS (SELECT i0 // 2 AS i0, l, r, v FROM s WHERE i0 % 2 = 0), g AS (SELECT i0 // 2 AS i0, l, r, v FROM s WHERE i0 % 2 = 1)"


def _even_odd(spark, d):
    """Functions of even and of odd users, paired."""
    p = user_points(spark, d)
    half = lambda k: p.where(F.col("i0") % 2 == k).withColumn("i0", F.floor(F.col("i0") / 2))
    f, g = half(0), half(1)
    both = f.select("i0").intersect(g.select("i0"))
    return f.join(both, "i0", "left_semi"), g.join(both, "i0", "left_semi")


@query(f"{_PAIR} SELECT f.i0, round(greatest(f.l, g.l), 6) AS l, round(least(f.r, g.r), 6) AS r, f.v AS fv, g.v AS gv FROM f JOIN g ON f.i0 = g.i0 AND f.l < g.r AND g.l < f.r WHERE least(f.r, g.r) < 1e300")
def rectangles_pair(spark, d):
    f, g = _even_odd(spark, d)
    return steps.rectangles(f, g, ["i0"]).where(F.col("r") < 1e300).select("i0", _r("l"), _r("r"), "fv", "gv")


def _algebra(op: str, sql_op: str):
    def fn(spark, d):
        f, g = _even_odd(spark, d)
        return steps.combine(f, g, ["i0"], op).select("i0", _r("t"), _r("v"))

    fn.__name__ = {"+": "add_pcf", "-": "sub_pcf", "*": "mul_pcf", "/": "div_pcf"}[op]
    query(f"""{_PAIR}, c AS (SELECT f.i0, greatest(f.l, g.l) AS t, {sql_op} AS v FROM f JOIN g ON f.i0 = g.i0 AND f.l < g.r AND g.l < f.r),
      w AS (SELECT *, lag(v) OVER (PARTITION BY i0 ORDER BY t) AS b, row_number() OVER (PARTITION BY i0 ORDER BY t) AS n FROM c)
      SELECT i0, round(t, 6) AS t, round(v, 6) AS v FROM w WHERE n = 1 OR v <> b OR isnan(v)""")(fn)


_algebra("+", "f.v + g.v")
_algebra("-", "f.v - g.v")
_algebra("*", "f.v * g.v")
_algebra("/", "CASE WHEN g.v = 0 THEN CASE WHEN f.v = 0 THEN 'NaN'::DOUBLE WHEN f.v > 0 THEN 'Infinity'::DOUBLE ELSE '-Infinity'::DOUBLE END ELSE f.v / g.v END")


@query(f"""WITH {_USERS} SELECT i0, round(t, 6) AS t, v + 2.5 AS a, 2.5 - v AS b, v * 3 AS c, round(v / 4, 6) AS e,
  CASE WHEN v = 0 THEN 'Infinity'::DOUBLE ELSE round(1 / v, 6) END AS f, -v AS g, round(v * v, 6) AS h, round(pow(v, 3.0), 4) AS k FROM p""")
def scalar_ops(spark, d):
    p = user_points(spark, d)
    # each works on the same rows: a row of results for each breakpoint, also where a user has two at one time
    out = p.withColumn("value", F.col("v"))
    for name, one in {
        "a": lambda q: steps.scalar(q, "+", 2.5), "b": lambda q: steps.scalar(q, "-", 2.5, reverse=True), "c": lambda q: steps.scalar(q, "*", 3.0), "e": lambda q: steps.scalar(q, "/", 4.0),
        "f": lambda q: steps.scalar(q, "/", 1.0, reverse=True), "g": steps.negate, "h": lambda q: steps.power(q, 2), "k": lambda q: steps.power(q, 3),
    }.items():
        out = one(out.withColumn("v", F.col("value"))).withColumnRenamed("v", name)
    return out.select("i0", _r("t"), "a", "b", "c", _r("e"), _r("f"), "g", _r("h"), _r("k", digits=4))


@query(f"""WITH {_USERS}, i AS (SELECT i0, CAST(floor(t) AS BIGINT) AS t, CAST(trunc(max_by(v, t)) AS BIGINT) AS v FROM p GROUP BY i0, floor(t)) SELECT i0, t, v + 7 AS a, v * 3 AS b, v // 4 AS c, (-v) // 4 AS e FROM i""")
def integer_pcf(spark, d):
    whole = user_points(spark, d).groupBy("i0", F.floor("t").alias("t")).agg(F.max_by("v", "t").cast("bigint").alias("v"))
    neg = steps.negate(whole)
    q = lambda p, op, c, name: steps.scalar(p, op, c, integer=True).select("i0", "t", F.col("v").cast("bigint").alias(name))
    return q(whole, "+", 7, "a").join(q(whole, "*", 3, "b"), ["i0", "t"]).join(q(whole, "/", 4, "c"), ["i0", "t"]).join(q(neg, "/", 4, "e"), ["i0", "t"])


# ---- reductions --------------------------------------------------------------------------------------------------------

_FILLED = "SELECT {keys} q.t, {agg} AS v FROM s JOIN (SELECT DISTINCT {keys} t FROM p) q ON {on} s.l <= q.t AND q.t < s.r GROUP BY {group} q.t"
_COMPACT = "SELECT *, lag(v) OVER ({part} ORDER BY t) AS b FROM c"


def _fold_sql(agg: str, key: str | None, base: str, divide: str = "") -> str:
    keys, on = (f"q.{key},", f"s.{key} = q.{key} AND") if key else ("", "")
    filled = f"SELECT {keys} q.t, {agg} AS v FROM s JOIN (SELECT DISTINCT {f'{key},' if key else ''} t FROM p) q ON {on} s.l <= q.t AND q.t < s.r GROUP BY {keys} q.t"
    part = f"PARTITION BY {key}" if key else ""
    return f"WITH {base}, c AS ({filled}), w AS (SELECT *, lag(v) OVER ({part} ORDER BY t) AS b FROM c) SELECT {f'{key} AS i0,' if key else ''} round(t, 6) AS t, round(v{divide}, 6) AS v FROM w WHERE b IS NULL OR round(v, 9) <> round(b, 9)"


@query(_fold_sql("greatest(max(s.v), 0)", "i0", _TYPES))
def fold_max(spark, d):
    """The largest of each event type's functions, zero among them."""
    p, _ = type_user_points(spark, d)
    return steps.fold(p, ["i0"], "i1", "max").select("i0", _r("t"), _r("v"))


@query(_fold_sql("sum(s.v::DECIMAL(38,9))::DOUBLE", "i0", _TYPES, " / (SELECT count(DISTINCT user_id) FROM events)"))
def mean_dim1(spark, d):
    """Mean over users for each event type."""
    p, (_, n) = type_user_points(spark, d)
    return steps.mean(p, ["i0"], "i1", n).select("i0", _r("t"), _r("v"))


@query(_fold_sql("sum(s.v::DECIMAL(38,9))::DOUBLE", "i1", _TYPES, " / (SELECT count(DISTINCT event_type) FROM events)"))
def mean_dim0(spark, d):
    """Mean over event types for each user."""
    p, (n, _) = type_user_points(spark, d)
    return steps.mean(p, ["i1"], "i0", n).select(F.col("i1").alias("i0"), _r("t"), _r("v"))


@query(_fold_sql("sum(s.v::DECIMAL(38,9))::DOUBLE", None, _USERS, " / (SELECT count(DISTINCT user_id) FROM events)"))
def mean_all(spark, d):
    """Mean over all users: one function."""
    p = user_points(spark, d)
    return steps.mean(p, [], "i0", p.select("i0").distinct().count()).select(_r("t"), _r("v"))


@query(ORACLE_SQL["mean_all"])
def mean_small_values(spark, d):
    """Mean over all users of values of the size 1e-20, shown 1e20 times as large."""
    p = user_points(spark, d)
    out = steps.mean(p.withColumn("v", F.col("v") * 1e-20), [], "i0", p.select("i0").distinct().count())
    return out.select(_r("t"), _r(F.col("v") * 1e20, "v"))


@query(f"WITH {_TYPES} SELECT i1 AS i0, round(max(t), 6) AS x FROM p GROUP BY i1")
def max_time_dim0(spark, d):
    points, shape = type_user_points(spark, d)
    return api.max_time(from_points(points, shape), 0).df.select("i0", _r("x"))


@query(f"WITH {_TYPES} SELECT i0, round(max(t), 6) AS x FROM p GROUP BY i0")
def max_time_dim1(spark, d):
    p, _ = type_user_points(spark, d)
    return steps.max_time(p, ["i0"]).select("i0", _r("x"))


# ---- norms, distances, kernels -----------------------------------------------------------------------------------------

@query(f"WITH {_USERS} SELECT i0, round(sum((r - l) * abs(v)), 6) AS x FROM s GROUP BY i0")
def norm_l1(spark, d):
    return steps.lp_norm(user_points(spark, d), ["i0"]).select("i0", _r("x"))


@query(f"WITH {_USERS} SELECT i0, round(sqrt(sum((r - l) * v * v)), 6) AS x FROM s GROUP BY i0")
def norm_l2(spark, d):
    return steps.l2_norm(user_points(spark, d), ["i0"]).select("i0", _r("x"))


@query(f"WITH {_USERS} SELECT i0, round(pow(sum((r - l) * pow(abs(v), 3)), 1.0::DOUBLE / 3), 6) AS x FROM s GROUP BY i0")
def norm_l3(spark, d):
    return steps.lp_norm(user_points(spark, d), ["i0"], 3.0).select("i0", _r("x"))


@query(f"WITH {_USERS} SELECT i0, max(abs(v)) AS x FROM s GROUP BY i0")
def norm_linf(spark, d):
    return steps.linfinity_norm(user_points(spark, d), ["i0"])


def _pair_sql(cols: str, cond: str, where: str = "") -> str:
    return f"WITH {_USERS} SELECT f.i0 AS i, g.i0 AS j, {cols} FROM s f JOIN s g ON {cond} AND f.l < g.r AND g.l < f.r {where} GROUP BY f.i0, g.i0"


_W = "(least(f.r, g.r) - greatest(f.l, g.l))"


@query(_pair_sql(f"round(sum({_W} * abs(f.v - g.v)), 6) AS d", "f.i0 = 0 AND g.i0 = 1").replace("f.i0 AS i, g.i0 AS j, ", ""))
def lp_distance(spark, d):
    p = user_points(spark, d)
    return pairs.lp_distance(p.where("i0 = 0"), p.where("i0 = 1")).select(_r("d"))


@query(_pair_sql(f"round(sum({_W} * abs(f.v - g.v)), 6) AS d", "f.i0 < g.i0"))
def pdist_l1(spark, d):
    return pairs.pdist(user_points(spark, d)).select("i", "j", _r("d"))


@query(_pair_sql(f"round(sqrt(sum({_W} * (f.v - g.v) * (f.v - g.v))), 6) AS d", "f.i0 < g.i0"))
def pdist_l2(spark, d):
    return pairs.pdist(user_points(spark, d), p=2.0).select("i", "j", _r("d"))


@query(_pair_sql(f"round(sum({_W} * f.v * g.v), 4) AS k", "f.i0 <= g.i0"))
def l2_kernel(spark, d):
    return pairs.l2_kernel(user_points(spark, d)).select("i", "j", _r("k", digits=4))


@query(_pair_sql(f"round(sum({_W} * abs(f.v - g.v)), 6) AS d", "f.i0 % 2 = 0 AND g.i0 % 2 = 1").replace("f.i0 AS i, g.i0 AS j", "f.i0 // 2 AS i0, g.i0 // 2 AS j0"))
def cdist_l1(spark, d):
    """Users of even rank against those of odd rank: every user takes part."""
    p = user_points(spark, d)
    part = lambda k: p.where(F.col("i0") % 2 == k).withColumn("i0", F.floor(F.col("i0") / 2))
    return pairs.cdist(part(0), part(1), ["i0"], ["i0"]).select("i0", "j0", _r("d"))


@query(_pair_sql(f"round(sum({_W} * f.v * g.v), 4) AS k", "f.i0 % 2 = 0 AND g.i0 % 2 = 1"))
def l2_cross_kernel(spark, d):
    """Users of even rank against those of odd rank."""
    p = user_points(spark, d)
    return pairs.l2_cross_kernel(p.where(F.col("i0") % 2 == 0), p.where(F.col("i0") % 2 == 1)).select("i", "j", _r("k", digits=4))


@query(_pair_sql("round(sum((least(f.r, g.r, 20) - greatest(f.l, g.l, 5)) * least(f.v, g.v)), 6) AS d", "f.i0 < g.i0", "WHERE least(f.r, g.r, 20) > greatest(f.l, g.l, 5)"))
def integrate_minimum(spark, d):
    """A pair integral of one's own: the smaller of both, over [5, 20)."""
    return pairs.integrate_all(user_points(spark, d), F.least, np.fmin, a=5.0, b=20.0).select("i", "j", _r("d"))


# ---- barcodes ----------------------------------------------------------------------------------------------------------

def _summary_sql(events: str, infinite: bool = False, digits: int = 6) -> str:
    return f"""WITH {_bars_sql(infinite)}, ev AS ({events} UNION ALL SELECT DISTINCT o_orderpriority, 0.0::DOUBLE, 0.0::DOUBLE FROM b),
      a AS (SELECT o_orderpriority, t, sum(n) AS n FROM ev GROUP BY ALL)
      SELECT o_orderpriority, round(t, 6) AS t, round(sum(n) OVER (PARTITION BY o_orderpriority ORDER BY t), {digits}) AS v FROM a"""


_RANK = "SELECT o_orderpriority, 0.0::DOUBLE AS t, 1.0::DOUBLE AS n FROM b UNION ALL SELECT o_orderpriority, death - birth, -1.0 FROM b WHERE death < 1e300"
_BETTI = "SELECT o_orderpriority, birth AS t, 1.0::DOUBLE AS n FROM b UNION ALL SELECT o_orderpriority, death, -1.0 FROM b WHERE death < 1e300"
_APF = "SELECT o_orderpriority, (birth + death) / 2 AS t, death - birth AS n FROM b WHERE death < 1e300"


def _bar_query(name: str, fn, sql: str, infinite: bool, **more) -> None:
    def run(spark, d):
        return fn(bars(spark, d, infinite), ["o_orderpriority"], **more).select("o_orderpriority", _r("t"), _r("v"))

    run.__name__ = name
    query(_summary_sql(sql, infinite))(run)


_bar_query("stable_rank", barcodes.stable_rank, _RANK, False)
_bar_query("stable_rank_infinite", barcodes.stable_rank, _RANK, True)
_bar_query("betti", barcodes.betti_curve, _BETTI, False)
_bar_query("betti_infinite", barcodes.betti_curve, _BETTI, True)
_bar_query("apf", barcodes.accumulated_persistence, _APF, False)
_bar_query("apf_max_death", barcodes.accumulated_persistence, _APF + " AND death <= 20000", True, max_death=20000.0)


@query(f"WITH {_bars_sql()}, x AS (SELECT o_orderpriority, birth, death FROM b) SELECT (SELECT count(*) FROM (FROM x EXCEPT ALL (FROM x ORDER BY death DESC))) = 0 AS same, (SELECT count(*) FROM (SELECT o_orderpriority, birth, death + 1 FROM x EXCEPT ALL FROM x)) = 0 AS moved")
def barcode_isomorphic(spark, d):
    """Every priority's barcode against itself in another order, and against itself with deaths moved."""
    b = bars(spark, d)
    moved = b.withColumn("death", F.col("death") + 1)
    keys = ["o_orderpriority"]
    return spark.createDataFrame([(barcodes.is_isomorphic(b, b.orderBy(F.desc("death")), keys), barcodes.is_isomorphic(b, moved, keys))], "same boolean, moved boolean")


@query(f"WITH {_bars_sql()} SELECT row_number() OVER (ORDER BY birth DESC, death - birth DESC) AS n, birth, death FROM b")
def bar_order(spark, d):
    """The rank of every bar in drawing order."""
    b = bars(spark, d).select((-F.col("birth")).alias("__b"), (F.col("birth") - F.col("death")).alias("__l"), "birth", "death")
    return construct.numbered(b, ["__b", "__l"], "n").select((F.col("n") + 1).alias("n"), "birth", "death")


# ---- homology ----------------------------------------------------------------------------------------------------------

def _clouds(spark, d) -> Tensor:
    """One cloud for each label of embeddings."""
    e = _read(spark, d, "embeddings")
    ranks = construct.rank_axis(e, "label")
    x = F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda s: s["embedding"].cast("array<double>"))
    df = e.join(ranks, "label").groupBy("i0").agg(x.alias("x"))
    return Tensor(df, (ranks.count(),), "pcloud64")


@query("""WITH RECURSIVE v AS (SELECT dense_rank() OVER (ORDER BY label) - 1 AS i0, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT i0, vec_id, e, list_distance(e, first_value(e) OVER w) AS d FROM v WINDOW w AS (PARTITION BY i0 ORDER BY vec_id)
      QUALIFY row_number() OVER w > 1),
g AS (SELECT 1 AS step, i0, vec_id, e, d, first_value(vec_id) OVER w AS pick, first_value(e) OVER w AS spot, min(d) OVER w AS least FROM s WINDOW w AS (PARTITION BY i0 ORDER BY d, vec_id)
      UNION ALL
      SELECT step, i0, vec_id, e, d, first_value(vec_id) OVER w, first_value(e) OVER w, min(d) OVER w
      FROM (SELECT step + 1 AS step, i0, vec_id, e, least(d, list_distance(e, spot)) AS d FROM g WHERE vec_id <> pick) WINDOW w AS (PARTITION BY i0 ORDER BY d, vec_id))
SELECT i0, 0::BIGINT AS i1, 0.0::DOUBLE AS birth, round(least, 6) AS death FROM g WHERE vec_id = pick AND least > 0
UNION ALL SELECT DISTINCT i0, 0, 0.0, 'Infinity'::DOUBLE FROM v""")
def rips_h0(spark, d):
    """Dimension 0 of each label's whole cloud."""
    h = homology.persistent_homology(_clouds(spark, d), max_dim=0)
    return api.to_bars(h).select("i0", "i1", _r("birth"), _r("death"))


@query()
def rips_h1_stable_rank(spark, d):
    """Clouds to barcodes to stable ranks in dimensions 0 and 1: the whole pipeline, on each label's whole cloud."""
    h = homology.persistent_homology(_clouds(spark, d), max_dim=1)
    return to_points(api.barcode_to_stable_rank(h)).select("i0", "i1", _r("t"), "v")


@query("""WITH v AS (SELECT dense_rank() OVER (ORDER BY label) - 1 AS i0, vec_id, embedding::DOUBLE[] AS e FROM embeddings)
SELECT a.i0, count(*) AS pairs, round(max(list_distance(a.e, b.e)), 6) AS widest FROM v a JOIN v b ON a.i0 = b.i0 AND a.vec_id < b.vec_id GROUP BY a.i0""")
def cloud_distances(spark, d):
    """The distance matrices behind the complexes."""

    def widest(frames):
        import pandas as pd

        for pdf in frames:
            n = [len(x) for x in pdf["x"]]
            yield pd.DataFrame({"i0": pdf["i0"], "pairs": [k * (k - 1) // 2 for k in n], "widest": [homology.widest([list(p) for p in x]) for x in pdf["x"]]})

    clouds = _clouds(spark, d)
    return clouds.df.repartition(max(1, clouds.size), "i0").mapInPandas(widest, "i0 bigint, pairs bigint, widest double").where("pairs > 0").select("i0", "pairs", _r("widest"))


# ---- tensors -----------------------------------------------------------------------------------------------------------

def _tensor_query(name: str, sql: str, fn) -> None:
    def run(spark, d):
        out = fn(grid(spark, d))
        return out.df if isinstance(out, Tensor) else out

    run.__name__ = name
    query(f"WITH {_GRID} {sql}")(run)


def _mask(g: Tensor) -> Tensor:
    return g > 20.0


_FLAT = "i0 * n1 + i1"
for _name, _sql, _fn in [
    ("slice_step", "SELECT i0, (i1 - 1) // 3 AS i1, x FROM g WHERE i1 >= 1 AND (i1 - 1) % 3 = 0", lambda g: g[:, 1::3]),
    ("slice_reverse", "SELECT n0 - 1 - i0 AS i0, n1 - 1 - i1 AS i1, x FROM g", lambda g: g[::-1, ::-1]),
    ("slice_negative", "SELECT i0 - (n0 - 2) AS i0, i1, x FROM g WHERE i0 >= n0 - 2 AND i1 < n1 - 1", lambda g: g[-2:, :-1]),
    ("index_row", "SELECT i1 AS i0, x FROM g WHERE i0 = 2", lambda g: g[2]),
    ("mask_full", f"SELECT row_number() OVER (ORDER BY {_FLAT}) - 1 AS i0, x FROM g WHERE x > 20", lambda g: g[_mask(g)]),
    ("mask_axis", "SELECT i0 // 2 AS i0, i1, x FROM g WHERE i0 % 2 = 0", lambda g: g[[k % 2 == 0 for k in range(g.shape[0])], :]),
    ("gather", "SELECT t.new AS i0, i1, x FROM g JOIN (VALUES (0, 1), (1, 1), (2, 2), (3, 0), (4, 4)) t(new, old) ON i0 = t.old", lambda g: g[[1, 1, 2, 0, -1]]),
    ("outer_index", "SELECT a.new AS i0, b.new AS i1, x FROM g JOIN (VALUES (0, 3), (1, 0)) a(new, old) ON i0 = a.old JOIN (VALUES (0, 5), (1, 2), (2, 5)) b(new, old) ON i1 = b.old", lambda g: g[[3, 0], [5, 2, 5]]),
    ("reshape", f"SELECT ({_FLAT}) // n0 AS i0, ({_FLAT}) % n0 AS i1, x FROM g", lambda g: g.reshape(-1, g.shape[0])),
    ("flatten", f"SELECT {_FLAT} AS i0, x FROM g", lambda g: g.flatten()),
    ("transpose", "SELECT i1 AS i0, i0 AS i1, x FROM g", lambda g: g.T),
    ("swapaxes", "SELECT i1 AS i0, i0 AS i1, x FROM g", lambda g: g.swapaxes(0, -1)),
    ("expand_dims", "SELECT i0, 0::BIGINT AS i1, i1 AS i2, x FROM g", lambda g: g.expand_dims(1)),
    ("squeeze", "SELECT i0, i1, x FROM g", lambda g: g.expand_dims(0).squeeze()),
    ("broadcast_to", "SELECT k AS i0, i0 AS i1, i1 AS i2, x FROM g CROSS JOIN range(3) t(k)", lambda g: g.broadcast_to((3, *g.shape))),
    ("broadcast_add", "SELECT g.i0, g.i1, g.x + r.x AS x FROM g JOIN g r ON r.i0 = 0 AND r.i1 = g.i1", lambda g: g + g[0]),
    ("broadcast_column", "SELECT g.i0, g.i1, g.x * r.x AS x FROM g JOIN g r ON r.i1 = 0 AND r.i0 = g.i0", lambda g: g * g[:, 0:1]),
    ("tensor_arithmetic", "SELECT i0, i1, round((x + 1) * 2 - x / 4, 6) AS x FROM g", lambda g: ((g + 1) * 2 - g / 4).df.select("i0", "i1", _r("x"))),
    ("tensor_divide", "SELECT i0, i1, CASE WHEN x = 0 THEN 'Infinity'::DOUBLE ELSE 1 / x END AS x FROM g", lambda g: 1 / g),
    ("tensor_negate", "SELECT i0, i1, -x AS x FROM g", lambda g: -g),
    ("tensor_power", "SELECT i0, i1, x * x AS x FROM g", lambda g: g**2),
    ("floor_divide", "SELECT i0, i1, floor(x / 7) AS x FROM g", lambda g: g // 7),
    ("compare_less", "SELECT i0, i1, x < 20 AS x FROM g", lambda g: g < 20.0),
    ("compare_equal", "SELECT g.i0, g.i1, g.x = r.x AS x FROM g JOIN g r ON r.i0 = 0 AND r.i1 = g.i1", lambda g: g == g[0]),
    ("bool_and", "SELECT i0, i1, x > 20 AND x < 60 AS x FROM g", lambda g: (g > 20.0) * (g < 60.0)),
    ("concatenate", "SELECT i0, i1, x FROM g UNION ALL SELECT i0 + n0, i1, x * 2 FROM g", lambda g: construct.concatenate([g, g * 2], 0)),
    ("stack", "SELECT i0, 0::BIGINT AS i1, i1 AS i2, x FROM g UNION ALL SELECT i0, 1, i1, -x FROM g", lambda g: construct.stack([g, -g], 1)),
    ("split_middle", "SELECT i0, i1 - 2 AS i1, x FROM g WHERE i1 >= 2 AND i1 < 5", lambda g: construct.split(g, [2, 5], 1)[1]),
    ("array_split_first", "SELECT i0, i1, x FROM g WHERE i1 < n1 // 4 + CASE WHEN n1 % 4 > 0 THEN 1 ELSE 0 END", lambda g: construct.array_split(g, 4, 1)[0]),
    ("astype", "SELECT i0, i1, trunc(x)::BIGINT AS x FROM g", lambda g: g.astype("int64")),
]:
    _tensor_query(_name, _sql, _fn)


def _written(change):
    def run(g: Tensor) -> Tensor:
        out = g.copy()
        change(out)
        return out

    return run


def _put(key, value):
    return _written(lambda g: g.__setitem__(key(g), value(g)))


for _name, _sql, _fn in [
    ("assign_slice", "SELECT i0, i1, CASE WHEN i1 % 2 = 0 THEN -1.0 ELSE x END AS x FROM g", _put(lambda g: (slice(None), slice(None, None, 2)), lambda g: -1.0)),
    ("assign_row_tensor", "SELECT g.i0, g.i1, CASE WHEN g.i0 = 3 THEN r.x ELSE g.x END AS x FROM g JOIN g r ON r.i0 = 0 AND r.i1 = g.i1", _put(lambda g: 3, lambda g: g[0])),
    ("masked_fill", "SELECT i0, i1, CASE WHEN x > 20 THEN 0.5 ELSE x END AS x FROM g", _put(_mask, lambda g: 0.5)),
    ("masked_assign", f"SELECT i0, i1, CASE WHEN x > 20 THEN row_number() OVER (PARTITION BY x > 20 ORDER BY {_FLAT}) - 1 ELSE x END::DOUBLE AS x FROM g", _put(_mask, lambda g: _counted(g[_mask(g)]))),
    ("axis_fill", "SELECT i0, i1, CASE WHEN i0 % 2 = 0 THEN 9.0 ELSE x END AS x FROM g", _put(lambda g: ([k % 2 == 0 for k in range(g.shape[0])], slice(None)), lambda g: 9.0)),
    ("index_assign", "SELECT g.i0, g.i1, CASE WHEN g.i0 = 1 THEN r.x WHEN g.i0 = 4 THEN q.x ELSE g.x END AS x FROM g JOIN g r ON r.i0 = 2 AND r.i1 = g.i1 JOIN g q ON q.i0 = 1 AND q.i1 = g.i1", _put(lambda g: [1, 4, 1], lambda g: g[[0, 1, 2]])),
    ("outer_fill", "SELECT i0, i1, CASE WHEN i0 IN (0, 2) AND i1 IN (1, 3) THEN 5.0 ELSE x END AS x FROM g", _put(lambda g: ([0, 2], [1, 3]), lambda g: 5.0)),
    ("inplace_add", "SELECT g.i0, g.i1, g.x + r.x AS x FROM g JOIN g r ON r.i0 = 0 AND r.i1 = g.i1", _written(lambda g: g.__iadd__(g[0]))),
]:
    _tensor_query(_name, _sql, _fn)


def _counted(t: Tensor) -> Tensor:
    """Cells that hold their own index."""
    return Tensor(t.df.withColumn("x", F.col("i0").cast("double")), t.shape, t.dtype)


@query(f"WITH {_GRID} SELECT (SELECT bool_and(a.x = b.x) FROM g a JOIN g b USING (i0, i1)) AS same, (SELECT bool_and(a.x = b.x + 1) FROM g a JOIN g b USING (i0, i1)) AS other, (SELECT bool_and(abs(a.x - (b.x + 1e-9)) <= 1e-8 + 1e-5 * abs(b.x + 1e-9)) FROM g a JOIN g b USING (i0, i1)) AS near, (SELECT bool_and(abs(a.x - (b.x + 1)) <= 1e-8 + 1e-5 * abs(b.x + 1)) FROM g a JOIN g b USING (i0, i1)) AS far, (SELECT bool_or(x > 20) FROM g) AS some, (SELECT bool_and(x >= 0) FROM g) AS every")
def tensor_questions(spark, d):
    g = grid(spark, d)
    row = (g.array_equal(g.copy()), g.array_equal(g + 1), allclose(g, g + 1e-9), allclose(g, g + 1), g.any_of(lambda x: x > 20), g.all_of(lambda x: x >= 0))
    return spark.createDataFrame([row], "same boolean, other boolean, near boolean, far boolean, some boolean, every boolean")


@query("SELECT i AS i0, j AS i1, k AS i2, (i * 100 + j * 10 + k)::BIGINT AS x FROM range(4) a(i), range(5) b(j), range(6) c(k)")
def mapping_tensor(spark, d):
    return construct.mapping_tensor(spark, (4, 5, 6)).df


@query("SELECT i AS i0, j AS i1, 0.0::DOUBLE AS t, 0.0::DOUBLE AS v FROM range(3) a(i), range(4) b(j)")
def zeros(spark, d):
    return to_points(construct.zeros(spark, (3, 4), "pcf64"))


@query(f"""WITH {_USERS}, c AS (SELECT *, row_number() OVER (ORDER BY i0, t) - 1 AS row FROM p), n AS (SELECT i0, min(row) AS a, max(row) + 1 AS b FROM c GROUP BY i0)
SELECT n.i0, round(t, 6) AS t, v FROM n JOIN c ON row >= a AND row < b""")
def from_serial_content(spark, d):
    """Users' functions as one numbered table of breakpoints with ranges, read back to a tensor."""
    p = user_points(spark, d)
    numbered = construct.numbered(p, ["i0", "t"], "row")
    ranges = numbered.groupBy("i0").agg(F.min("row").alias("start"), (F.max("row") + 1).alias("stop"))
    x = construct.from_serial_content(numbered.select("row", "t", "v"), ranges, (ranges.count(),))
    return to_points(x).select("i0", _r("t"), "v")


@query(_pair_sql(f"round(sum({_W} * abs(f.v - g.v)), 6) AS v", "f.i0 <> g.i0").replace("GROUP BY f.i0, g.i0", "GROUP BY f.i0, g.i0 UNION ALL SELECT DISTINCT i0, i0, 0.0 FROM p"))
def pdist_dense(spark, d):
    """The whole square of the distance matrix."""
    return api.pdist(user_tensor(spark, d)).to_dense().select("i", "j", _r("v"))


@query(_pair_sql(f"round(sum({_W} * abs(f.v - g.v)), 6) AS v", "f.i0 > g.i0").replace("f.i0 AS i, g.i0 AS j,", "0::BIGINT AS i0, f.i0 AS i, g.i0 AS j,"))
def matrix_tensor_cells(spark, d):
    """A tensor of matrices, from a dense square that is checked on the way, as triangle cells."""
    p = user_points(spark, d)
    n = p.select("i0").distinct().count()
    m = matrices.DistanceMatrix.from_dense(matrices.DistanceMatrix(pairs.pdist(p), n, complete=True).to_dense(), n)
    return matrices.matrix_cells(matrices.stack_matrices([m])).select("i0", "i", "j", _r("v"))


@query(f"WITH {_GRID} SELECT i0, i1, x FROM g")
def save_load(spark, d):
    """A tensor saved and loaded."""
    path = f"{storage.shared_root(spark)}/tensor-{uuid.uuid4().hex}"
    storage.save(grid(spark, d), path)
    return storage.load(spark, path).df


@query()
def noisy_functions(spark, d):
    """Random functions and the mean of each row."""
    x = rnd.noisy_sin(spark, (4, 25), 20, "pcf64", rnd.Generator(7))
    return to_points(api.mean(x, 1)).select("i0", _r("t"), _r("v"))


@query("SELECT i AS i0, j AS i1, 20 AS points, 0.0::DOUBLE AS first, 0.0::DOUBLE AS final, 20 AS times, true AS rising, true AS inside, true AS near FROM range(4) a(i), range(25) b(j)")
def noisy_support(spark, d):
    """What holds for every random function: how many breakpoints, where they lie, and how far values are from the sine."""
    x = rnd.noisy_sin(spark, (4, 25), 20, "pcf64", rnd.Generator(7)).df
    t, last = F.transform("x", lambda p: p["t"]), F.element_at("x", -1)
    near = F.forall(F.slice("x", 1, 19), lambda p: F.abs(p["v"] - F.sin(2 * math.pi * p["t"])) < 1.0)  # ten deviations
    return x.select(
        "i0", "i1", F.size("x").alias("points"), F.col("x")[0]["t"].alias("first"), last["v"].alias("final"), F.size(F.array_distinct(t)).alias("times"),
        (t == F.array_sort(t)).alias("rising"), F.forall(t, lambda v: (v >= 0) & (v < 1)).alias("inside"), near.alias("near"),
    )


@query("SELECT i AS i0, true AS inside, true AS plane, true AS likely FROM range(10) a(i)")
def poisson_support(spark, d):
    """What holds for every cloud: points of the plane inside the box, and a number within six deviations of the rate."""
    x = rnd.sample_poisson(spark, (10,), 2, 25.0, [1.0, 2.0], [2.0, 4.0], rnd.Generator(7)).df
    inside = F.forall("x", lambda p: (p[0] >= 1) & (p[0] < 2) & (p[1] >= 2) & (p[1] < 4))
    return x.select("i0", inside.alias("inside"), F.forall("x", lambda p: F.size(p) == 2).alias("plane"), (F.abs(F.size("x") - 50) <= 6 * math.sqrt(50)).alias("likely"))


@query()
def poisson_clouds(spark, d):
    x = rnd.sample_poisson(spark, (10,), 2, 25.0, generator=rnd.Generator(7))
    return x.df.select("i0", F.size("x").alias("points"))


# ---- objects and their parts -------------------------------------------------------------------------------------------

@query(f"WITH {_USERS} SELECT i0, count(*) AS x FROM p GROUP BY i0")
def points_of_functions(spark, d):
    """How many breakpoints each user's function has (A6)."""
    return api.n_points(user_tensor(spark, d)).df


@query("SELECT * FROM (VALUES (0::BIGINT, 0::BIGINT, 0.0::DOUBLE, 3.0::DOUBLE), (0, 0, 1, 2), (0, 0, 4, 5), (0, 1, 0, 2), (0, 1, 3, 4), (1, 0, 0, 0), (1, 1, 0, 1), (1, 1, 2.5, -1)) q(i0, i1, t, v)")
def nested_functions(spark, d):
    """Functions from nested lists, one of them with its points out of order, one empty (A1, A4)."""
    x = construct.pcf_tensor(spark, [[[(0, 3), (4, 5), (1, 2)], [(0, 2), (3, 4)]], [[(0, 0)], [(0, 1), (2.5, -1)]]], "pcf64")
    return to_points(x)


@query("SELECT * FROM (VALUES (0::BIGINT, 0.0::DOUBLE, 2.0::DOUBLE), (0, 1, 'Infinity'::DOUBLE), (1, 0.5, 1.5)) q(i0, birth, death)")
def nested_barcodes(spark, d):
    """Barcodes from nested lists, one of them empty (S4)."""
    return api.to_bars(construct.barcode_tensor(spark, [[(0, 2), (1, INF)], [(0.5, 1.5)], []]))


@query(f"WITH {_GRID} SELECT i0, i1, trunc(x)::BIGINT / 3.0::DOUBLE AS x FROM g")
def integer_divide(spark, d):
    """Whole numbers divide to floats (T7)."""
    return (grid(spark, d).astype("int64") / 3).df


@query(f"WITH {_GRID} SELECT (x <> 0) AS b, x AS f, trunc(x)::BIGINT AS i FROM g WHERE i0 = 1 AND i1 = 2")
def single_values(spark, d):
    """One element as a Python value of each kind (T10)."""
    one = grid(spark, d)[1, 2]
    return spark.createDataFrame([(bool(one), float(one), int(one))], "b boolean, f double, i bigint")


@query(f"WITH {_GRID} SELECT (max(i0) + 1)::BIGINT AS rows, (max(i1) + 1)::BIGINT AS columns, count(*)::BIGINT AS size, 2::BIGINT AS axes, (max(i1) + 1)::BIGINT AS stride FROM g")
def tensor_metadata(spark, d):
    """What a tensor knows of itself (I12)."""
    g = grid(spark, d)
    return spark.createDataFrame([(len(g), g.shape[1], g.size, g.ndim, g.strides[0])], "rows bigint, columns bigint, size bigint, axes bigint, stride bigint")


@query(f"WITH {_GRID} SELECT i0, i1, sum(x) AS x FROM g GROUP BY ALL")
def numpy_round_trip(spark, d):
    """A tensor out to NumPy and back (A5), with the NumPy type behind its dtype (X5)."""
    g = grid(spark, d)
    return construct.from_numpy(spark, g.to_numpy().astype(dtypes.numpy_type(g.dtype))).df


@query(_pair_sql(f"round(sum({_W} * f.v * g.v), 4) AS v", "true"))
def kernel_dense(spark, d):
    """The whole square of a symmetric matrix (M3)."""
    return api.l2_kernel(user_tensor(spark, d)).to_dense().select("i", "j", _r("v", digits=4))
