"""Every query with SQL gives what DuckDB gives."""

import math

import duckdb
import pytest

from rastermill.jobs import queries as raster

JOBS = [n for n in raster.QUERIES if n.startswith("job_")]


def test_every_query_has_sql():
    assert set(raster.QUERIES) == set(raster.ORACLE)


@pytest.fixture(scope="session")
def duck(sf_dir):
    from pathlib import Path

    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda x: "null" if x is None or isinstance(x, float) and math.isnan(x) else repr(float(x)) if isinstance(x, float) else str(x)
    return sorted(columns), sorted(tuple(clean(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", list(raster.ORACLE))
def test_same_as_sql(spark, sf_dir, duck, name):
    df = raster.QUERIES[name](spark, sf_dir)
    result = duck.execute(raster.ORACLE[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([d[0] for d in result.description], result.fetchall())


@pytest.mark.parametrize("name", JOBS)
def test_jobs_give_reports(spark, sf_dir, name):
    df = raster.QUERIES[name](spark, sf_dir)
    assert df.columns == ["task", "subject", "measure", "value"] and df.count() > 0


def test_levels_and_grids_add_up(spark, sf_dir):
    for name in ("job_across_levels", "job_across_grids"):
        report = {(r.subject, r.measure): r.value for r in raster.QUERIES[name](spark, sf_dir).collect()}
        whole = "countries" if name == "job_across_levels" else "zones"
        assert report[(whole, "bias")] == 0 and report[(whole, "pearson")] == 1


def test_province_code_map_on_a_tall_grid(spark, sf_dir, tmp_path):
    """1,400 rows of cells: at an eighth of a degree they would reach beyond the pole, and no zone would be read."""
    base = spark.read.parquet(f"{sf_dir}/orders.parquet")
    tall = base.crossJoin(spark.range(140)).selectExpr("o_orderkey + id * 1500 AS o_orderkey", "o_orderstatus", "o_totalprice")
    tall.write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    for name in ("customer", "nation", "region"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{sf_dir}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    df = raster.QUERIES["job_province_code_map"](spark, str(tmp_path))
    result = con.execute(raster.ORACLE["job_province_code_map"])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([d[0] for d in result.description], result.fetchall())


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
