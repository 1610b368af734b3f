"""Every registered query against its oracle in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from mosaicq.plans.all_queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(df):
    def plain(v):
        if v is None or isinstance(v, (str, bool, np.bool_)):
            return str(v)
        if not isinstance(v, (list, np.ndarray)) and pd.isna(v):
            return "None"
        if isinstance(v, (list, np.ndarray)):
            return str([round(float(x), 6) for x in v])
        return str(round(float(v), 6) + 0.0)

    return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in ORACLES:
        want = duck.execute(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry_module_lists_what_is_registered():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(ORACLES) <= set(e.oracle_sql()) <= set(e.queries())


def test_stencils_shuffle_once(spark):
    """All taps of the predictors come from one exchange of the samples."""
    plan = QUERIES["win02_predictors"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(img") + plan.count("Exchange hashpartitioning(l_suppkey") <= 2


def test_scans_read_only_their_columns(spark):
    plan = QUERIES["agg24_folder_means"](spark, SF)._jdf.queryExecution().toString()
    schema = plan[plan.rindex("ReadSchema") :]
    assert "l_shipdate" not in schema and "l_partkey" not in schema


def test_command_line_lists_runs_and_writes(spark, tmp_path, capsys):
    from mosaicq.__main__ import main

    assert main(["list", "--like", "agg0"]) == 0 and "agg09_palette" in capsys.readouterr().out
    assert main(["run", "agg09_palette", "--tables", SF, "--sql"]) == 0 and "SELECT" in capsys.readouterr().out
    assert main(["run", "agg09_palette", "--tables", SF + "/", "--out", str(tmp_path / "out")]) == 0
    assert spark.read.parquet(str(tmp_path / "out")).count() == QUERIES["agg09_palette"](spark, SF).count()
    with pytest.raises(SystemExit):
        main(["run", "no such query", "--tables", SF])
