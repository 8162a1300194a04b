"""The entry module: its queries against their SQL, and its life without the corpus operators."""

import os
import subprocess
import sys

from pathlib import Path

import pytest

from stepforge.plans import catalogue

ROOT = Path(__file__).resolve().parent.parent
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")


@needs_data
@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = catalogue.QUERIES[name](spark, DATA).toPandas(), con.sql(catalogue.ORACLE_SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda d: sorted(map(tuple, d[cols].map(str).to_numpy()))
    assert rows(got) == rows(want)


@needs_data
@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).count() > 0


def test_entry_without_the_corpus_operators(tmp_path):
    for p in ROOT.iterdir():
        if p.name not in ("stepforge", "corpus_pipeline.py") and not p.name.startswith("."):
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "stepforge").mkdir()
    for p in (ROOT / "stepforge").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "stepforge" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_nothing_else_imports_the_corpus_operators():
    for p in (ROOT / "stepforge").rglob("*.py"):
        if "llm" not in p.parts:
            assert "stepforge.llm" not in p.read_text()


def small_events(spark, tmp_path, users=25):
    import datetime
    import random

    rng, start = random.Random(31), datetime.datetime(2024, 1, 1)
    rows = [(n, 7 * (n % users), start + datetime.timedelta(seconds=rng.randrange(30 * 86400)), "ab"[n % 2], float(rng.randrange(1, 9))) for n in range(8 * users)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    functions = {}
    for u in sorted({r[1] for r in rows}):
        own = sorted((r[2], r[0], r[4]) for r in rows if r[1] == u)
        functions[len(functions)] = [((t - own[0][0]).total_seconds() / 86400, 0.0 if k == len(own) - 1 else v) for k, (t, _, v) in enumerate(own)]
    return functions


def value_at(points, t):
    return [v for at, v in points if at <= t][-1]


def pair_integral(f, g, op):
    cuts = sorted({t for t, _ in (*f, *g)})
    return sum((b - a) * op(value_at(f, a), value_at(g, a)) for a, b in zip(cuts, cuts[1:], strict=False))


def test_all_users_at_many_times_and_in_matrices(spark, tmp_path):
    f = small_events(spark, tmp_path)
    got = catalogue.QUERIES["eval_many_times"](spark, str(tmp_path)).toPandas()
    assert len(got) == 25 * 11000 and not got.duplicated(["i0", "k"]).any()
    assert all(value_at(f[r.i0], r.k * 0.003) == r.v for r in got[got["k"] % 97 == 0].itertuples())
    cells = {(r["i"], r["j"]): r["v"] for r in catalogue.QUERIES["matrix_tensor_cells"](spark, str(tmp_path)).collect()}
    assert set(cells) == {(i, j) for i in range(25) for j in range(i)}
    assert all(abs(v - pair_integral(f[i], f[j], lambda x, y: abs(x - y))) < 1e-5 for (i, j), v in cells.items())


def test_cross_pairs_of_all_users(spark, tmp_path):
    f = small_events(spark, tmp_path)
    d = {(2 * r["i0"], 2 * r["j0"] + 1): r["d"] for r in catalogue.QUERIES["cdist_l1"](spark, str(tmp_path)).collect()}
    k = {(r["i"], r["j"]): r["k"] for r in catalogue.QUERIES["l2_cross_kernel"](spark, str(tmp_path)).collect()}
    assert set(d) == set(k) == {(i, j) for i in range(0, 25, 2) for j in range(1, 25, 2)}
    assert all(abs(v - pair_integral(f[i], f[j], lambda x, y: abs(x - y))) < 1e-5 for (i, j), v in d.items())
    assert all(abs(v - pair_integral(f[i], f[j], lambda x, y: x * y)) < 1e-3 for (i, j), v in k.items())


def small_bars(spark, tmp_path):
    import datetime

    day = lambda k: datetime.date(2024, 1, 1) + datetime.timedelta(days=k)
    spark.createDataFrame([(k, f"{k % 4 + 2}-OTHER", day(k % 9)) for k in range(90)], "o_orderkey long, o_orderpriority string, o_orderdate date").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(k, day(k % 9 + 1 + k % 13 + n), "OF"[n]) for k in range(90) for n in range(2)], "l_orderkey long, l_shipdate date, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    return sorted(((float((day(k % 9) - day(0)).days), float(1 + k % 13 + n)) for k in range(90) for n in range(2)), reverse=True)


def test_isomorphism_reads_all_priorities(spark, tmp_path):
    small_bars(spark, tmp_path)
    assert [tuple(r) for r in catalogue.QUERIES["barcode_isomorphic"](spark, str(tmp_path)).collect()] == [(True, False)]


def test_every_bar_has_its_rank(spark, tmp_path, monkeypatch):
    want = small_bars(spark, tmp_path)
    for rows in (1_000_000, 50):  # in one range and in several
        monkeypatch.setattr("stepforge.sources.construct.NUMBERED_ROWS", rows)
        got = sorted((r["n"], r["birth"], r["death"]) for r in catalogue.QUERIES["bar_order"](spark, str(tmp_path)).collect())
        assert [n for n, _, _ in got] == list(range(1, 181))
        assert [(b - got[-1][1], e - b) for _, b, e in got] == want


def test_quotients_round_as_their_sql(spark, tmp_path):
    """Quotients that leave half a unit in the last digit (113.05 / 224 and others)."""
    import datetime

    import duckdb

    start = datetime.datetime(2024, 1, 1)
    some = [(113.05, 224.0), (207.57, 6.4), (207.72, 25.6), (19.95, 160.0), (51.48, 25.6), (165.69, 160.0), (0.0, 3.0), (3.0, 0.0)]
    rows = [(4 * k + 2 * s + n, 2 * k + s, start + datetime.timedelta(days=n), "a", (v, 1.0)[n]) for k, p in enumerate(some) for s, v in enumerate(p) for n in range(2)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    for name in ("div_pcf", "scalar_ops"):
        got, want = catalogue.QUERIES[name](spark, str(tmp_path)).toPandas(), con.sql(catalogue.ORACLE_SQL[name]).df()
        cols = sorted(got.columns)
        assert sorted(map(tuple, got[cols].map(str).to_numpy())) == sorted(map(tuple, want[cols].map(str).to_numpy()))


def test_scalar_arithmetic_keeps_rows_of_one_time(spark, tmp_path):
    """Two events of a user at one time are two breakpoints, each with one row of results."""
    import datetime

    at = [datetime.datetime(2024, 1, 1 + n) for n in (0, 1, 1, 2)]
    spark.createDataFrame([(n, 5, t, "a", float(n + 1)) for n, t in enumerate(at)], "event_id long, user_id long, ts timestamp, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = sorted((r["t"], r["a"], r["h"]) for r in catalogue.QUERIES["scalar_ops"](spark, str(tmp_path)).collect())
    assert got == [(0.0, 3.5, 1.0), (1.0, 4.5, 4.0), (1.0, 5.5, 9.0), (2.0, 2.5, 0.0)]


def test_powers_of_large_values_equal_their_sql(spark, tmp_path):
    """Cubes up to 2.7e13, whose last digit Spark's pow gives otherwise; null stays null."""
    import datetime
    import random

    import duckdb

    rng, start = random.Random(5), datetime.datetime(2024, 1, 1)
    rows = [(k, k % 40, start + datetime.timedelta(minutes=k), "a", round(rng.uniform(0, 30000), 2)) for k in range(4000)] + [(4000, 3, start, "a", None)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got, want = catalogue.QUERIES["scalar_ops"](spark, str(tmp_path)).toPandas(), con.sql(catalogue.ORACLE_SQL["scalar_ops"]).df()
    cols = sorted(got.columns)
    assert sorted(map(tuple, got[cols].map(str).to_numpy())) == sorted(map(tuple, want[cols].map(str).to_numpy()))
