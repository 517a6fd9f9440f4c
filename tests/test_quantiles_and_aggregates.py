import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest

from tests.frames import to_pandas, to_spark
from tidemark.operators import aggregates, frames, metrics, quality, selection
from tidemark.operators.quantiles import BELOW, quantile_exact, with_ordered_bits

PROBS = [0.0, 0.25, 0.5, 0.75, 0.999, 1.0]


def groups(seed):
    rng = np.random.default_rng(seed)
    sizes = {"one": 1, "two": 2, "three": 3, "ties": 500, "hot": 60_000, "skewed": 5_000}
    parts = []
    for k, n in sizes.items():
        v = rng.normal(0, 10, n)
        if k == "ties":
            v = rng.integers(0, 3, n).astype(float)
        if k == "skewed":
            v = np.exp(rng.normal(0, 4, n))
        parts.append(pd.DataFrame({"k": k, "v": v}))
    return pd.concat(parts, ignore_index=True)


@pytest.mark.parametrize("below", [BELOW, (60, 40), (20, 4)])
def test_quantiles_equal_numpy(spark, below):
    pdf = groups(7)
    df = spark.createDataFrame(pdf)
    names = [f"q{i}" for i in range(len(PROBS))]
    got = quantile_exact(df, ["k"], "v", PROBS, names, below).toPandas().set_index("k")
    want = pdf.groupby("k")["v"].quantile(PROBS).unstack()
    assert set(got.index) == set(want.index)
    for i, p in enumerate(PROBS):
        np.testing.assert_allclose(got.loc[want.index, f"q{i}"], want[p], rtol=1e-12)


def test_bits_order_like_doubles(spark):
    rng = np.random.default_rng(2)
    bits = rng.integers(0, 2**63 - 2**52, 4000).astype(np.int64).view(np.float64)
    edges = [0.0, 5e-324, 1e-310, 2.2250738585072014e-308, 2.225073858507201e-308, 1.0, 1.9999999999999998, 2.0, 1.7976931348623157e308, math.inf]
    powers = [2.0**e for e in range(-1074, 1024)]
    v = np.unique(np.concatenate([bits, edges, powers, np.nextafter(powers, 0), np.nextafter(powers, np.inf)]))
    v = np.concatenate([-v[::-1], v])
    got = with_ordered_bits(spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "i int, v double"), "v", "u").orderBy("i").collect()
    want = np.where(v > 0, 1, -1) * np.abs(v).view(np.int64)
    assert [r["u"] for r in got] == want.tolist()
    assert with_ordered_bits(spark.createDataFrame([(math.nan,)], "v double"), "v", "u").first()["u"] > want.max()


def test_quantiles_of_odd_values_and_keys(spark):
    nan, inf = math.nan, math.inf
    rows = [("inf", x) for x in (-inf, -inf, 1.0, inf, inf)] + [("nan", x) for x in (1.0, nan, nan)] + [("zero", -0.0), ("zero", 0.0)]
    rows += [(None, 3.0), (None, 4.0), (None, None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: tuple(r)[1:] for r in quantile_exact(df, ["k"], "v", [0.0, 0.1, 0.5, 0.6, 1.0]).collect()}
    assert set(got) == {"inf", "nan", "zero", None}
    assert got["inf"][:3] == (-inf, -inf, 1.0) and got["inf"][4] == inf and got["inf"][3] == inf
    assert got["nan"][0] == 1.0 and math.isnan(got["nan"][2]) and math.isnan(got["nan"][4])
    assert got["zero"] == (0.0,) * 5 and got[None] == (3.0, 3.1, 3.5, 3.6, 4.0)
    assert quantile_exact(df.limit(0), ["k"], "v", [0.5]).count() == 0


def test_quantiles_start_no_job_and_gather_no_key(spark):
    rng = np.random.default_rng(4)
    rows = [("hot" if i % 3 else f"k{i}", float(x)) for i, x in enumerate(rng.normal(50, 9, 6000))]
    df = spark.createDataFrame(rows, "k string, v double")
    spark.sparkContext.setJobGroup("plan", "plan")
    plan = quantile_exact(df, ["k"], "v", [0.5])
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("plan")
    spark.sparkContext.setJobGroup("run", "run")
    hot = sorted(x for k, x in rows if k == "hot")
    assert plan.where("k = 'hot'").first()["q0.5"] == pytest.approx(np.median(hot), rel=1e-15)
    text = plan._jdf.queryExecution().toString()
    assert "percentile" not in text and "SinglePartition" not in text


def test_outliers_become_null_after_the_quantile(spark):
    rows = [("a", float(i % 90 + 30)) for i in range(1000)] + [("a", 1500.0), ("a", None), ("b", 1500.0)]
    got = frames.null_if_outlier(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").toPandas()
    assert got[got.k == "a"]["v"].isna().sum() == 2
    assert got[got.k == "b"]["v"].tolist() == [1500.0]


def test_metrics_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("m", 0.0, 1.0), ("m", 2.0, 1.0), ("m", nan, 1.0), ("m", 4.0, inf), ("m", None, 3.0),
            ("flat", 5.0, 6.0), ("flat", 5.0, 4.0), ("none", None, 1.0)]
    df = spark.createDataFrame(rows, "model string, actual double, predicted double")
    got = {r["model"]: r for r in metrics.regression_metrics(df, ["model"]).collect()}
    assert set(got) == {"m", "flat"}
    m = got["m"]
    assert (m["mae"], m["rmse"], m["mape"], m["r2"], m["n_predictions"]) == (1.0, 1.0, 50.0, 0.0, 2)
    assert got["flat"]["r2"] is None and got["flat"]["mape"] == 20.0
    assert metrics.regression_metrics(df.limit(0), ["model"]).count() == 0
    by_hour = metrics.mae_by_hour(df.selectExpr("*", "int(7) as h"), ["model"], "h", "actual", "predicted")
    assert by_hour.count() == 3 * 24
    best = {r["metric"]: r["model"] for r in metrics.best_per_metric(metrics.regression_metrics(df, ["model"]), "model").collect()}
    assert best == {"mae": "flat", "rmse": "flat", "mape": "flat", "r2": "m"}


def test_histogram_equals_numpy(spark):
    rng = np.random.default_rng(3)
    v = np.round(rng.normal(0, 5, 3000), 1)
    pdf = pd.DataFrame({"k": "a", "v": v})
    got = to_pandas(aggregates.histogram(spark.createDataFrame(pdf), ["k"], "v", 60), ["bin"])
    n, edges = np.histogram(v, bins=60)
    assert got["n"].sum() == 3000 and abs(got["n"].to_numpy() - n).sum() <= 4  # values on an edge
    np.testing.assert_allclose(got["bin_start"], edges[:-1])
    flat = aggregates.histogram(spark.createDataFrame([("a", 2.0)] * 3, "k string, v double"), ["k"], "v", 4).collect()
    assert [(r["bin_start"], r["n"]) for r in sorted(flat, key=lambda r: r["bin"])] == [(1.5, 0), (1.75, 0), (2.0, 3), (2.25, 0)]


def test_trend_equals_polyfit(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(0, 10, 200)
    y = 3 - 2 * x + rng.normal(0, 1, 200)
    got = to_pandas(aggregates.linear_trend(spark.createDataFrame(pd.DataFrame({"k": "a", "x": x, "y": y})), ["k"], "x", "y"), ["point"])
    slope, intercept = np.polyfit(x, y, 1)
    np.testing.assert_allclose(got[["slope", "intercept"]].iloc[0], [slope, intercept])
    np.testing.assert_allclose(got["x"], np.linspace(x.min(), x.max(), 200))


def test_latest_day_includes_both_ends(spark):
    start = datetime(2024, 1, 1)
    rows = [("a", start + timedelta(hours=i), float(i)) for i in range(60)] + [("b", start, 4.0)]
    got = {r["k"]: r for r in aggregates.kpi_latest_24h(spark.createDataFrame(rows, "k string, t timestamp, v double"), ["k"], "t", "v").collect()}
    assert (got["a"]["latest"], got["a"]["min_24h"], got["a"]["max_24h"], got["a"]["mean_24h"]) == (59.0, 35.0, 59.0, 47.0)
    assert got["b"]["mean_24h"] == 4.0


def test_minmax_keeps_constants_at_zero_and_inverts(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    fitted = aggregates.minmax_fit(df, ["a", "b"])
    later = spark.createDataFrame([(5.0, 6.0)], "a double, b double")
    scaled = aggregates.minmax_scale(later, fitted, ["a", "b"])
    assert tuple(scaled.first()) == (2.0, 1.0)
    assert aggregates.minmax_inverse(scaled, fitted, "a", "a").first()["a"] == 5.0


def test_quality_report(spark):
    t = datetime(2024, 1, 1)
    good = spark.createDataFrame([(t + timedelta(hours=i), 1.0) for i in range(30)], "datetime timestamp, v double")
    assert quality.passes(quality.data_quality(good))
    assert not quality.passes(quality.data_quality(good.union(good)))
    holes = good.selectExpr("datetime", "case when hour(datetime) > 4 then v end as v")
    failed = quality.data_quality(holes).where("not passed").collect()
    assert [(r["check"], r["column"]) for r in failed] == [("null_share", "v")]
    empty_column = quality.data_quality(good.selectExpr("datetime", "cast(null as double) as v")).where("not passed")
    assert {r["check"] for r in empty_column.collect()} == {"all_null", "null_share"}
    assert quality.passes(quality.data_quality(good.drop("datetime")))
    two_nulls = spark.createDataFrame([(None, 1.0), (None, 1.0), (t, 1.0)], "datetime timestamp, v double")
    repeated = quality.data_quality(two_nulls, max_null=1.0).where("check = 'repeated_time'").first()
    assert repeated["n"] == 1


def test_sample_is_exact_repeatable_and_ordered(spark):
    df = spark.range(5000).selectExpr("id", "timestamp_seconds(id) as t").repartition(7)
    got = [r["id"] for r in selection.sample_cap(df, 300, ["id"], "t").collect()]
    again = [r["id"] for r in selection.sample_cap(df.repartition(3), 300, ["id"], "t").collect()]
    assert len(set(got)) == 300 and got == sorted(got) and got == again
    assert selection.sample_cap(df, 300, ["id"], "t", seed=1).subtract(selection.sample_cap(df, 300, ["id"], "t")).count() > 0
    assert selection.sample_cap(df.limit(10), 300, ["id"], "t").count() == 10


def test_describe_matches_pandas(spark):
    pdf = groups(2).query("k == 'hot'")
    got = aggregates.describe_series(spark.createDataFrame(pdf), ["k"], "v").first()
    want = pdf["v"].describe()
    for c, w in (("mean", "mean"), ("std", "std"), ("min", "min"), ("p25", "25%"), ("p50", "50%"), ("p75", "75%"), ("max", "max")):
        assert math.isclose(got[c], round(want[w], 2), abs_tol=1e-9), c


def test_correlations_use_complete_pairs(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame(rng.normal(size=(200, 3)), columns=["y", "a", "b"])
    pdf.loc[::3, "a"] = np.nan
    pdf.insert(0, "k", "x")
    df = to_spark(spark, pdf, "k string, y double, a double, b double")
    got = {r["variable"]: r["correlation"] for r in aggregates.correlations(df, ["k"], "y", ["a", "b"]).collect()}
    want = pdf[["y", "a", "b"]].corr()["y"]
    assert math.isclose(got["a"], want["a"]) and math.isclose(got["b"], want["b"])
