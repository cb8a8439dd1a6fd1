"""Queries on tables that the given ones don't show: rows as DuckDB gives them."""

import math

import pytest

from tessera import registry


def both(spark, folder, name, table, rows, schema):
    """(rows of the query, rows of its SQL) over one table."""
    duckdb = pytest.importorskip("duckdb")
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    df = registry.queries()[name](spark, str(folder))
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    return sorted(map(tuple, df.collect()), key=str), sorted(want, key=str)


@pytest.mark.parametrize("base", [0.0, -0.0, 0.5, math.nan, None])
def test_speedup_over_a_base_of_zero(spark, tmp_path, base):
    rows = [("view", base), ("click", 0.0), ("error", 2.0), ("signup", -3.0), ("purchase", math.nan), ("idle", math.inf)]
    got, want = both(spark, tmp_path, "speedup", "events", rows, "event_type string, value double")
    assert str(got) == str(want) and len(got) == 6


def test_a_part_with_the_id_that_the_run_lacks_stays(spark, tmp_path):
    rows = [(31,), (30,), (61,), (999_999,), (1_000_003,), (1_000_004,), (1_000_004,), (1_000_010,), (None,)]
    got, want = both(spark, tmp_path, "mask_runs", "part", rows, "p_partkey long")
    assert got == want and (1_000_004,) in got and len(got) == 14
