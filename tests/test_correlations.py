"""Runs whose scores have no spread, against the registered SQL."""

import datetime
import random

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

COLUMNS = ["scored_at", "run_id", "axis_key", "entity_id", "latent_mean", "latent_std"]


@pytest.fixture
def tables(tmp_path):
    """Runs a and b with spread, c whose scores are all nought, d of four entities only."""
    scores = {"a": [1.0, 2.0, 4.0, 3.0, 6.0, 5.0], "b": [2.0, 1.0, 5.0, 2.0, 4.0, 9.0], "c": [0.0, -0.0, 0.0, 0.0, -0.0, 0.0], "d": [1.0, 1.0, 1.0, 1.0]}
    rows = [(datetime.datetime(2024, 1, 1), f" {run.upper()}", "clarity", f"e{k}", x, 0.1) for run, own in scores.items() for k, x in enumerate(own)]
    pd.DataFrame(rows, columns=COLUMNS).astype({"scored_at": "datetime64[us]"}).to_parquet(tmp_path / "scores.parquet")
    return str(tmp_path)


def both(spark, tables, name):
    con = duckdb.connect()
    con.execute(f"create view scores as select * from '{tables}/scores.parquet'")
    got, want = entry.queries()[name](spark, tables).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    order = list(want.select_dtypes(exclude="number").columns)
    return [(x.sort_values(order, ignore_index=True) if order else x)[list(want.columns)] for x in (got, want)]


def test_methods_are_compared_where_a_run_has_no_spread(spark, tables):
    got, want = both(spark, tables, "method_comparison")
    pd.testing.assert_frame_equal(got, want, check_dtype=False)
    assert got[["wins", "losses", "ties"]].to_numpy().sum() == 3


def test_runs_without_spread_have_no_rho(spark, tables):
    got, want = both(spark, tables, "spearman_runs")
    pd.testing.assert_frame_equal(got, want, check_dtype=False)
    assert len(got) == 6 and got["rho"].isna().sum() == 5


def test_runs_are_paired_by_what_they_share_beside_anchors(spark, tmp_path):
    """Two anchors in nearly every run, a few entities of its own, some shared by one pair only."""
    rng = random.Random(5)
    rows = []
    for run in range(60):
        own = {f"e{rng.randrange(25):02}" for _ in range(rng.randrange(1, 7))} | {a for a in ("e98", "e99") if rng.random() < 0.9}
        rows += [(datetime.datetime(2024, 1, 1), f"r{run}", "clarity", e, float(rng.randrange(6)), 0.1) for e in sorted(own)]
    pd.DataFrame(rows, columns=COLUMNS).astype({"scored_at": "datetime64[us]"}).to_parquet(tmp_path / "scores.parquet")
    got, want = both(spark, str(tmp_path), "spearman_runs")
    pd.testing.assert_frame_equal(got, want, check_dtype=False)
    assert 100 < len(got) < 1500 and set(got["n"]) >= {3, 4}
