"""Plans: push-down, no Python or cross joins where expressions suffice, one job per fit."""

import contextlib
import io

import pytest

from checks.common import load
from millrace.operators.create import group_aggregates
from millrace.plans.spec import Recipe, fit
from millrace.sources.readers import load_parquet

SF = "/root/testdata/sf0.001"


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_filter_and_columns_reach_the_scan(spark):
    text = plan(load_parquet(spark, f"{SF}/lineitem.parquet", ["l_orderkey"], "l_discount > 0.05"))
    assert "GreaterThan(l_discount,0.05)" in text and "ReadSchema: struct<l_orderkey:bigint,l_discount:double>" in text


@pytest.mark.parametrize("kind,columns,params", [
    ("fill_median", ["l_quantity"], {}), ("cap_outliers", ["l_extendedprice"], {}), ("standard", None, {}), ("one_hot", ["l_returnflag"], {}), ("bins", ["l_tax"], {}), ("polynomial", ["l_tax", "l_discount"], {}),
])
def test_fitted_steps_are_projections(spark, kind, columns, params):
    text = plan(fit(kind, load(spark, SF, "lineitem"), columns, **params).transform(load(spark, SF, "lineitem")))
    assert not any(w in text for w in ("Exchange", "Join", "Python", "Window"))


def test_fit_is_one_job(spark):
    df = load(spark, SF, "lineitem")
    spark.sparkContext.setJobGroup("one-fit", "fit")
    fit("standard", df)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("one-fit")
    spark.sparkContext.setJobGroup("other", "")
    # Adaptive execution runs the shuffle stage and the result stage of one aggregate as two jobs.
    assert len(jobs) <= 2


def test_group_features_do_not_partition_by_group(spark):
    text = plan(group_aggregates(load(spark, SF, "lineitem"), ["l_returnflag"], ["l_quantity"]))
    assert "BroadcastHashJoin" in text and "Window" not in text and "CartesianProduct" not in text


def test_recipe_has_no_python(spark):
    df = load(spark, SF, "lineitem")
    out = Recipe().add("fill_mean", ["l_tax"]).add("target", ["l_returnflag"], target="l_quantity").apply(df)
    assert "Python" not in plan(out)
