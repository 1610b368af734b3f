"""What a task holds doesn't grow with the input, and kernels over many groups give what they give group by group."""

import re

import duckdb
import numpy as np
import pandas as pd
import pytest

from mosaicq.operators import kernels as k
from mosaicq.plans.all_queries import ORACLES, QUERIES
from mosaicq.plans.kernels import tree_inputs, whole_rows
from mosaicq.sources import planes

SF = "/root/testdata/sf0.001"
DEALT = ["join10_touching_colors", "opt13_separable_fit", "agg10_cooccurrence", "agg08_index_cost", "agg18_edge_model", "sup08_group_gather", "opt01_learned_trees", "sup16_local_trees", "opt08_rounding_trellis", "opt16_preset_fit", "win03_weighted_predictor", "win07_squeeze_inverse", "flt06_rich_tiles", "join02_two_level_lookup", "win13_box_moments", "win10_sharpen", "ent16_repetition_screen"]


@pytest.mark.parametrize("name", DEALT)
def test_partitions_grow_with_the_input(spark, monkeypatch, name):
    """Samples are dealt once, to a partition for so many bytes of input, whatever spark.sql.shuffle.partitions says."""
    monkeypatch.setattr(planes, "PART_BYTES", 1 << 14)
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    dealt = [int(n) for n in re.findall(r"Exchange hashpartitioning\((?:l_suppkey|stream)#\d+L?, (\d+)\), REPARTITION_BY_NUM", plan)]
    assert len(dealt) == 1 and dealt[0] > 6
    assert len(re.findall(r"Exchange hashpartitioning\((?:l_suppkey|stream|img)", plan)) == 1


def test_planes_of_less_than_a_row_have_trees_too():
    x, symbol = tree_inputs(np.arange(20) * 5)
    assert x.shape == (20, 6) and symbol.shape == (20, 4) and k.grow_tree(x, symbol, 16, price=20.0)[0][0] == -1


def test_many_chains_cost_what_each_costs_alone():
    r = np.random.default_rng(3)
    parts = [r.normal(0, 9, n) for n in (5, 1, 30, 12, 30)]
    price = lambda d: np.log2(1 + np.abs(d))
    starts = np.cumsum([0, *map(len, parts)])[:-1]
    assert k.cheapest_roundings(np.concatenate(parts), starts, price, 0.3).tolist() == [k.cheapest_rounding(p, price, 0.3) for p in parts]


def test_many_planes_leave_what_each_leaves_alone():
    r = np.random.default_rng(4)
    planes_of = [r.integers(0, 255, n) for n in (70, 3, 640, 32)]
    starts = np.cumsum([0, *map(len, planes_of)])[:-1]
    for shares, p in k.WP_PRESETS:
        rows, y, at = whole_rows(np.concatenate(planes_of), starts)
        got = k.weighted_residuals_of(rows, y, shares, p).reshape(-1)[at]
        alone = [k.weighted_residuals(np.append(v, np.zeros(-len(v) % 32, int)).reshape(-1, 32), shares, p).reshape(-1)[: len(v)] for v in planes_of]
        assert got.tolist() == np.concatenate(alone).tolist()


def test_many_rows_are_squeezed_at_once():
    rows = np.random.default_rng(5).integers(-99, 99, (40, 31))
    average, rest = k.squeeze(rows)
    assert average.shape == (40, 16) and (k.unsqueeze(average, rest) == rows).all()
    assert all((k.squeeze(row)[1] == d).all() for row, d in zip(rows, rest, strict=True))


def test_no_filter_works_out_tokens(spark):
    plan = QUERIES["join02_two_level_lookup"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "bin(" in line or "Filter isnotnull(CASE" in line]


def items(n: int) -> pd.DataFrame:
    """Line items of two images, the first samples of one null."""
    r = np.random.default_rng(6)
    quantity = r.integers(1, 51, n).astype(float)
    quantity[:3] = np.nan
    return pd.DataFrame({"l_orderkey": np.arange(n), "l_linenumber": 1, "l_partkey": 1, "l_suppkey": (np.arange(n) >= 70).astype(int), "l_extendedprice": 1.0, "l_quantity": quantity, "l_discount": r.integers(0, 11, n) / 100, "l_tax": r.integers(0, 9, n) / 100})


@pytest.mark.parametrize("name", ["win10_sharpen", "win13_box_moments"])
def test_null_samples_count_as_nothing(spark, tmp_path, name):
    items(300).to_parquet(tmp_path / "lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    want = con.execute(ORACLES[name]).df()
    got = QUERIES[name](spark, str(tmp_path)).toPandas()[list(want.columns)]
    by = ["img", "c", "x", "y"]
    pd.testing.assert_frame_equal(got.sort_values(by, ignore_index=True).astype(float), want.sort_values(by, ignore_index=True).astype(float), atol=2e-6, rtol=0)


@pytest.mark.parametrize("name", ["ent15_priced_parse", "ent05_rans_round_trip", "ent14_lz_round_trip"])
def test_coders_get_whole_texts(spark, name):
    """No row a byte, which would be sorted again into texts."""
    assert "Generate" not in QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_chains_of_earlier_places():
    r = np.random.default_rng(7)
    for top in (2, 5, 300):
        v = k._sliceable(r.integers(0, top, 200).tolist())
        for n in (3, 4):
            want = [max((j for j in range(i) if len(v[i : i + n]) == n and v[j : j + n] == v[i : i + n]), default=-1) for i in range(len(v))]
            assert k._before(v, n) == want


def test_the_race_takes_samples_apart_once(spark):
    plan = QUERIES["race04_margins"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Generate stack\(3", plan)) == 1


def test_paragraphs_that_meet_in_several_bands_are_held_once(spark):
    from mosaicq.llm.paragraphs import _once

    bands = {1: {7, 8}, 2: {7, 8}, 3: {7, 8, 9}, 4: {9}, 5: {-7, 8}, 6: {8, 7}}
    rows = [(content, band) for band, contents in bands.items() for content in contents]
    kept = {(r.band, r.content) for r in _once(spark.createDataFrame(rows, "content long, band long")).collect()}
    assert kept == {(1, 7), (1, 8), (3, 7), (3, 8), (3, 9), (5, -7), (5, 8)}
