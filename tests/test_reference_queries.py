import math

import duckdb
import pytest

from wavelark.plans.reference import ORACLE_SQL, QUERIES, rounded

from .oracle import compare


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    assert compare(spark, QUERIES[name], ORACLE_SQL[name], "/root/testdata/sf0.001") == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


@pytest.mark.parametrize("digits", [1, 4, 6])
def test_rounds_as_sql(spark, digits):
    halves = [k * (n + 0.5) / 10**digits for n in [*range(0, 3000, 7), 259237] for k in (1, -1)]
    xs = [y for x in halves for y in (math.nextafter(x, -math.inf), x, math.nextafter(x, math.inf))] + [0.0, 1e305, -1e305, math.inf, -math.inf, math.nan, None]
    got = [r.x for r in rounded(spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i long, x double"), digits).orderBy("i").collect()]
    want = [r[0] for r in duckdb.execute(f"SELECT round(x, {digits}) FROM (SELECT unnest(?::DOUBLE[]) AS x)", [xs]).fetchall()]
    same = lambda v: None if v is None else str(v + 0.0)  # noqa: E731  (nan equals itself, zero has no sign)
    assert list(map(same, got)) == list(map(same, want))


def test_pulse_widths_to_the_last_digit(spark):
    """Record 135 rises in 25.92375 samples, as a double just below it."""
    df = QUERIES["wave_pulse_width"](spark, "/root/testdata/sf0.01")
    duckdb.execute("CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.01/embeddings.parquet'")
    found = duckdb.execute(ORACLE_SQL["wave_pulse_width"])
    names = [c[0] for c in found.description]
    assert sorted(map(tuple, df.select(names).collect())) == sorted(found.fetchall())
