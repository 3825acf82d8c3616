"""Checks against DuckDB at sf0.001: a quick selection, or all of them with FULL=1."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import DATA, compare, connect

SF = f"{DATA}/sf0.001"
QUICK = (
    "s2_detect_roles_with_ids", "f1_apply_filters", "f6_sample_stratified_quota", "f9_frequency_with_other", "a1_table_info", "a2_numeric_summary", "a8_group_summary", "a14_resample_w",
    "m5_fill_mode", "m7_interpolate_grouped", "o7_cap_iqr", "e1_one_hot", "e4_target", "e5_binary", "n3_robust", "n10_quantile_uniform", "u6_recipe_replay_undo", "g1_group_aggregates",
    "g2_rolling_grouped", "g9_datetime_features", "g10_text_features", "t1_kendall", "t5_chi2_yates", "t10_kruskal", "p4_box_plot", "l4_chi2", "f12_stratified_sizes", "v4_classification_report",
    "v6_roc_curve", "c2_knn_classify", "c3_ridge", "io1b_csv_null_tokens", "io3_xml_round_trip", "stream_resample",
)
LARGE = ("a2_numeric_summary", "m7_interpolate_grouped", "m7_interpolate_time", "g2_rolling_ungrouped", "g3_lag_grouped", "f13_in_batches", "t8_mann_whitney", "v6_roc_curve", "e2_label", "c5_dbscan")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_registry():
    names, sqls = entry.queries(), entry.oracle_sql()
    assert set(sqls) <= set(names) and len(names) > 250
    assert set(QUICK + LARGE) <= set(names)


@pytest.mark.parametrize("name", sorted(entry.queries()) if os.environ.get("FULL") else QUICK)
def test_check(spark, duck, name):
    assert compare(spark, duck, SF, entry.queries()[name], entry.oracle_sql().get(name)) is None


@pytest.mark.parametrize("name", LARGE)
def test_large_plan(spark, duck, large_plans, name):
    assert compare(spark, duck, SF, entry.queries()[name], entry.oracle_sql()[name]) is None


def test_entry(spark):
    assert entry.entry(spark).count() == 3


def test_vectors_have_all_values(spark):
    import numpy as np

    from checks.modelling import _E, vectors

    held = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    got = vectors(spark, SF).collect()
    assert len(_E) == 64 and all([r[e] for e in _E] == [float(x) for x in held[r["vec_id"]]] for r in got)
    # The distance to the assigned centre is least over all 64 values, not over a prefix.
    out = entry.queries()["c4_kmeans"](spark, SF).toPandas()
    cluster = [c for c in out.columns if c not in ("vec_id", "label", *_E)][0]
    x = out[_E].to_numpy()
    centres = np.array([x[out[cluster] == k].mean(0) for k in sorted(out[cluster].unique())])
    nearest = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
    assert (np.array(sorted(out[cluster].unique()))[nearest] == out[cluster]).mean() > 0.95
