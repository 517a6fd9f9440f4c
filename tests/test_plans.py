"""Compositions: cleaning, features, models; and the shape of the physical plans."""

from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from tests.frames import to_pandas
from tidemark import catalog
from tidemark.operators import gaps, windows
from tidemark.plans import cleaning, forecast, report, seasonal
from tidemark.plans.cells import boost_cells
from tidemark.plans.features import FEATURES, build_feature_matrix
from tidemark.sources.schemas import GENERATION_COLUMNS

PRICE = "datetime timestamp, barra string, cmg_usd_mwh double"
START = datetime(2024, 1, 1)


def test_negative_prices_are_imputed_and_flagged(spark):
    rows = [(START + timedelta(hours=i), b, -5.0 if (i, b) == (1, "a") else 50.0 + i) for b in ("a", "b") for i in range(10)]
    got = to_pandas(cleaning.clean_prices(spark.createDataFrame(rows, PRICE), trees=5), ["barra", "datetime"])
    assert (got["cmg_usd_mwh"] >= 0).all() and got["is_imputed"].tolist() == [False, True] + [False] * 18
    assert got["cmg_usd_mwh"][1] == 51.0


def test_a_spike_is_imputed(spark):
    rng = np.random.default_rng(0)
    rows = [(START + timedelta(hours=i), "a", float(v)) for i, v in enumerate([*rng.uniform(30, 120, 1000), 1500.0])]
    got = to_pandas(cleaning.clean_prices(spark.createDataFrame(rows, PRICE), trees=5), ["datetime"])
    assert got["is_imputed"].iloc[-1] and got["cmg_usd_mwh"].iloc[-1] < 1500
    assert not got["is_imputed"].iloc[:-1].any()


def test_long_gaps_are_filled_by_the_model_and_the_start_by_the_median(spark):
    hours = 24 * 30
    v = 50 + 20 * np.sin(np.arange(hours) * 2 * np.pi / 24)
    hole = set(range(600, 612)) | {0, 1}
    rows = [(START + timedelta(hours=i), "a", None if i in hole else float(v[i])) for i in range(hours)]
    df = spark.createDataFrame(rows, PRICE)
    got = to_pandas(cleaning.clean_prices(df, trees=30, method="how"), ["datetime"])
    assert got["cmg_usd_mwh"].notna().all()
    assert got["how"].value_counts().to_dict() == {"observed": hours - 14, "interpolated": 3, "model": 9, "median": 2}
    model = got[got.how == "model"]
    assert np.abs(model["cmg_usd_mwh"] - v[model.index]).mean() < 8
    few = cleaning.clean_prices(df.where("datetime < '2024-01-03'"), trees=30, method="how")
    assert few.where("how = 'model'").count() == 0


def test_generation_total_is_null_only_without_any_value(spark):
    rows = [("s", START + timedelta(hours=12 + i), None if i < 6 else 1.0, -1.0 if i < 6 else 2.0) for i in range(8)]
    df = spark.createDataFrame(rows, "k string, datetime timestamp, gen_gas_mw double, gen_coal_mw double")
    got = to_pandas(cleaning.clean_generation(df, ["k"]), ["datetime"])
    assert got["gen_total_mw"].isna().tolist() == [True] * 6 + [False] * 2
    assert got["gen_total_mw"].iloc[-1] == 3.0


def matrix_inputs(spark, hours=400):
    times = [START + timedelta(hours=i) for i in range(hours)]
    prices = spark.createDataFrame([(t, b, float(i + o), False) for b, o in (("a", 0), ("b", 1000)) for i, t in enumerate(times)],
                                   PRICE + ", is_imputed boolean")
    gen = spark.createDataFrame([(t, *[1.0] * 8) for t in times], "datetime timestamp, " + ", ".join(f"{c} double" for c in GENERATION_COLUMNS))
    levels = spark.createDataFrame([(date(2024, 1, 2), 10.0), (date(2024, 1, 10), None)], "date date, energy_gwh double")
    sky = spark.createDataFrame([(date(2024, 1, 1), 30.0)], "date date, temp_max_c double")
    days = spark.createDataFrame([(date(2024, 1, 1),)], "date date")
    return prices, gen, levels, sky, days


def test_feature_matrix_columns_range_and_history(spark):
    tables = matrix_inputs(spark)
    cut = build_feature_matrix(*tables, start="2024-01-05", end="2024-01-06", holiday_years=(2023, 2024))
    assert cut.columns == ["barra", "datetime", "cmg_usd_mwh", "is_imputed", *FEATURES] and len(FEATURES) == 29
    got = to_pandas(cut, ["barra", "datetime"])
    a = got[got.barra == "a"]
    assert len(a) == 49 and str(a["datetime"].iloc[-1]) == "2024-01-07 00:00:00"
    assert pd.isna(a["lag_cmg_usd_mwh_1h"].iloc[0]) and got[got.barra == "b"]["lag_cmg_usd_mwh_1h"].iloc[1] == 1096.0
    long = to_pandas(build_feature_matrix(*tables, start="2024-01-05", end="2024-01-06", lookback=True, holiday_years=(2023, 2024)), ["barra", "datetime"])
    assert long["lag_cmg_usd_mwh_1h"].iloc[0] == 95.0 and len(long) == 98
    first = to_pandas(build_feature_matrix(*tables, start="2024-01-01", end="2024-01-12", holiday_years=(2023, 2024)), ["barra", "datetime"])
    assert first["energy_gwh"].iloc[0] == 10.0  # taken from the next day
    assert pd.isna(first["energy_gwh"].iloc[24 * 9])  # nothing later to fill from
    assert first["is_holiday"].sum() == 2 * 24  # local first of January, which starts at 03:00
    plain = to_pandas(build_feature_matrix(*tables, start="2024-01-01", end="2024-01-12", bfill_missing=False, holiday_years=(2023, 2024)), ["barra", "datetime"])
    assert plain["energy_gwh"].isna().iloc[0] and plain["energy_gwh"].iloc[24] == 10.0


def test_best_round_waits_for_patience():
    assert forecast.best_round([5, 4, 3, 3.5, 3.4, 2], patience=3) == 6
    assert forecast.best_round([5, 4, 3, 3.5, 3.4, 2], patience=2) == 3
    assert forecast.best_round([1, 2, 3], patience=50) == 1


def plain_boosting(rows, trees, rate, depth, min_leaf):
    """Rows of (bins, target or None), one by one; the same rules without cells or histograms."""
    known = [(x, y) for x, y in rows if y is not None]
    f = {i: sum(y for _, y in known) / len(known) for i in range(len(rows))}

    def grow(members, level):
        """Leaves as lists of row numbers."""
        learn = [i for i in members if rows[i][1] is not None]
        best = (0.0, None, None)
        total = sum(rows[i][1] - f[i] for i in learn)
        for j in range(len(rows[0][0])) if level else ():
            for cut in range(max(x[j] for x, _ in rows)):
                left = [i for i in learn if rows[i][0][j] <= cut]
                if min(len(left), len(learn) - len(left)) < min_leaf:
                    continue
                g = sum(rows[i][1] - f[i] for i in left)
                gain = round(g * g / len(left) + (total - g) ** 2 / (len(learn) - len(left)) - total * total / len(learn), 6)
                if gain > best[0]:
                    best = (gain, j, cut)
        if best[1] is None:
            return [members]
        _, j, cut = best
        return [leaf for side in (True, False) for leaf in grow([i for i in members if (rows[i][0][j] <= cut) == side], level - 1)]

    for _ in range(trees):
        leaves = grow(list(range(len(rows))), depth)
        steps = {}
        for leaf in leaves:
            learn = [rows[i][1] - f[i] for i in leaf if rows[i][1] is not None]
            steps |= dict.fromkeys(leaf, rate * sum(learn) / len(learn))
        f = {i: f[i] + steps[i] for i in f}
    return [f[i] for i in range(len(rows))]


@pytest.mark.parametrize("depth, min_leaf", [(1, 1), (3, 5), (4, 2)])
def test_trees_over_cells_equal_trees_over_rows(depth, min_leaf):
    rng = np.random.default_rng(depth)
    x = rng.integers(0, 5, (160, 3))
    y = np.round(10 * (x[:, 0] > 2) + 3 * x[:, 1] * (x[:, 2] > 1) + rng.normal(0, 1, 160), 3)
    rows = [(tuple(int(v) for v in b), None if rng.random() < 0.1 else float(v)) for b, v in zip(x, y, strict=True)]
    want = plain_boosting(rows, 6, 0.3, depth, min_leaf)
    cells = sorted({b for b, _ in rows})
    n = np.array([sum(v is not None for b, v in rows if b == c) for c in cells])
    total = np.array([sum(v for b, v in rows if b == c and v is not None) for c in cells])
    got = boost_cells(np.array(cells), n, total, 6, 0.3, depth, min_leaf)
    np.testing.assert_allclose([got[cells.index(b)] for b, _ in rows], want, rtol=1e-9)


def test_every_series_has_a_model_and_a_floor_of_its_own(spark):
    hours = 24 * 20
    rows = []
    for k, level, n in (("a", 10.0, hours), ("b", 5000.0, hours), ("short", 70.0, 24 * 9)):
        for i in range(n):
            hole = n - 8 <= i < n - 3
            rows.append((START + timedelta(hours=i), k, None if hole else level + (i % 24)))
    got = to_pandas(cleaning.impute_gbt(spark.createDataFrame(rows, PRICE), ["barra"], "datetime", "cmg_usd_mwh", method="how"), ["barra", "datetime"])
    for k, level in (("a", 10.0), ("b", 5000.0)):
        model = got[(got.barra == k) & (got.how == "model")]
        assert len(model) == 5
        np.testing.assert_allclose(model["cmg_usd_mwh"], level + model["datetime"].dt.hour, atol=1.5)
    # Nine days leave 48 complete rows, too few; the other series do not lend theirs.
    assert set(got[(got.barra == "short") & got.how.ne("observed")]["how"]) == {"median"}


def test_a_series_without_holes_is_left_as_it_is(spark):
    rows = [(START + timedelta(hours=i), "a", float(i)) for i in range(30)]
    df = spark.createDataFrame(rows, PRICE)
    got = cleaning.impute_gbt(df, ["barra"], "datetime", "cmg_usd_mwh", method="how")
    assert got.columns == [*df.columns, "how"] and sorted(tuple(r) for r in got.collect()) == [(*r, "observed") for r in rows]
    assert cleaning.impute_gbt(df.limit(0), ["barra"], "datetime", "cmg_usd_mwh").count() == 0


def boosting_rows(spark, n=500):
    rng = np.random.default_rng(3)
    x = rng.uniform(0, 1, (n, 4))
    y = 10 * (x[:, 0] > 0.5) + 4 * x[:, 1] + rng.normal(0, 0.5, n)
    pdf = pd.DataFrame(x, columns=list("abcd")).assign(y=y, part=np.where(np.arange(n) < n * 0.7, "train", "val"))
    df = spark.createDataFrame(pdf)
    return df.where("part = 'train'"), df.where("part = 'val'")


def test_an_interrupted_fit_goes_on_to_the_same_model(spark, tmp_path):
    train, val = boosting_rows(spark)
    seen = []

    def crash(number, error):
        seen.append(number)
        if number == 4:
            raise KeyboardInterrupt

    def predictions(model):
        return sorted(r["predicted"] for r in forecast.score(model, val).collect())

    fit = {"rounds": 7, "patience": 50, "trees": forecast.Trees(depth=3)}
    with pytest.raises(KeyboardInterrupt):
        forecast.fit_gbt(train, list("abcd"), "y", val, checkpoint=str(tmp_path / "c"), on_round=crash, **fit)
    later = []
    resumed = forecast.fit_gbt(train, list("abcd"), "y", val, checkpoint=str(tmp_path / "c"), on_round=lambda n, e: later.append(n), **fit)
    whole = forecast.fit_gbt(train, list("abcd"), "y", val, **fit)
    assert seen == [0, 1, 2, 3, 4] and later == [5, 6, 7]
    np.testing.assert_allclose(predictions(resumed), predictions(whole), rtol=1e-12)


def test_fitting_stops_by_patience_and_keeps_the_best_round(spark):
    train, val = boosting_rows(spark, 300)
    rounds = []
    # Targets without any relation: the mean is soon the best there is.
    noise = train.withColumn("y", F.pmod(F.xxhash64("a"), F.lit(100)).cast("double"))
    other = val.withColumn("y", F.pmod(F.xxhash64("a"), F.lit(100)).cast("double"))
    model = forecast.fit_gbt(noise, list("abcd"), "y", other, rounds=60, patience=4, on_round=lambda n, e: rounds.append(e))
    best = forecast.best_round(rounds[1:], 4)
    assert len(rounds) - 1 == min(60, best + 4) < 60 and model.stages[-1].getNumTrees == best + 1
    error = forecast.score(model, other).agg(F.avg(F.abs(F.col("y") - F.col("predicted")))).first()[0]
    assert error == pytest.approx(rounds[best], rel=1e-9)


def test_report_over_all_inputs(spark, tmp_path):
    matrix = build_feature_matrix(*matrix_inputs(spark, 24 * 24), start="2024-01-01", end="2024-01-24", holiday_years=(2023, 2024))
    matrix = matrix.fillna({"energy_gwh": 10.0})
    bounds = report.Bounds("2024-01-18", "2024-01-20", None, None)
    got = report.train_and_report(matrix, str(tmp_path), bounds, rounds=3, trees=forecast.Trees(depth=4))
    metrics = {r["split"]: r for r in got.metrics.collect()}
    assert set(metrics) == {"val", "test"} and got.importance.count() == len(FEATURES) == 29
    assert got.stored["inserted"] == metrics["test"]["n_predictions"] > 0
    assert metrics["test"]["mae"] < 600  # the mean of both buses alone is 500 off
    again = report.train_and_report(matrix, str(tmp_path), bounds, rounds=3, trees=forecast.Trees(depth=4))
    assert again.stored["inserted"] == 0 and spark.read.option("header", True).csv(f"{tmp_path}/reports/gbt/1.0/metrics").count() == 2
    with pytest.raises(ValueError, match="no complete rows for test"):
        report.train_and_report(matrix, str(tmp_path / "x"), report.Bounds("2024-01-18", "2024-01-30", None, None), rounds=1)


def test_boosting_learns_and_ranks_features(spark):
    rng = np.random.default_rng(0)
    x = rng.uniform(0, 1, (600, 3))
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(y=10 * (x[:, 0] > 0.5) + x[:, 1], is_val=np.arange(600) >= 400)
    df = spark.createDataFrame(pdf)
    model = forecast.fit_gbt(df.where("not is_val"), ["a", "b", "c"], "y", df.where("is_val"), rounds=15, patience=5)
    scored = forecast.score(model, df.where("is_val"))
    assert scored.agg(F.avg(F.abs(F.col("predicted") - F.col("y")))).first()[0] < 3
    weights = {r["feature"]: r["importance"] for r in forecast.feature_importance(model).collect()}
    assert max(weights, key=weights.get) == "a"
    assert "<=" in model.stages[-1].toDebugString and " in {" not in model.stages[-1].toDebugString


def test_seasonal_model_equals_least_squares(spark):
    rng = np.random.default_rng(4)
    n = 24 * 40
    y = np.zeros(n)
    for t in range(n):
        base = 50 + 10 * np.sin(2 * np.pi * t / 24)
        y[t] = base + (0.6 * (y[t - 1] - 50 - 10 * np.sin(2 * np.pi * (t - 1) / 24)) if t else 0) + rng.normal()
    rows = [(k, START + timedelta(hours=i), float(v + o)) for k, o in (("a", 0), ("b", 7)) for i, v in enumerate(y)]
    df = spark.createDataFrame(rows, "k string, t timestamp, y double")
    got = to_pandas(seasonal.seasonal_ar(df, ["k"], "t", "y", horizon=30), ["k", "t"])
    z = y[24:] - y[:-24]
    m = len(z)
    target = z[24:]
    columns = [np.ones(m - 24), z[23 : m - 1], z[22 : m - 2], z[: m - 24]]
    fits = {}
    for p in (0, 1, 2):
        x = np.column_stack([columns[0], *columns[1 : p + 1], columns[3]])
        beta, *_ = np.linalg.lstsq(x, target, rcond=None)
        sse = ((target - x @ beta) ** 2).sum()
        fits[p] = (len(target) * np.log(sse / len(target)) + 2 * (x.shape[1] + 1), beta)
    best = min(fits, key=lambda p: fits[p][0])
    a = got[got.k == "a"]
    assert a["p"].iloc[0] == best and abs(a["aic"].iloc[0] - fits[best][0]) < 1e-4
    beta = fits[best][1]
    weights = np.array([beta[0], *beta[1 : best + 1], *[0.0] * (2 - best), beta[-1]])
    np.testing.assert_allclose(a["predicted"], seasonal.forecast_path(list(y[-50:]), weights, 30), rtol=1e-6)
    assert a["t"].iloc[0] == pd.Timestamp(START + timedelta(hours=n)) and a["horizon_h"].tolist() == list(range(1, 31))
    np.testing.assert_allclose(got[got.k == "b"]["predicted"].to_numpy(), a["predicted"].to_numpy() + 7, rtol=1e-6)


def test_short_and_flat_series_in_the_seasonal_model(spark):
    rows = [("short", START + timedelta(hours=i), 1.0) for i in range(40)]
    rows += [("flat", START + timedelta(hours=i), float(i % 24)) for i in range(24 * 5)]
    got = to_pandas(seasonal.seasonal_ar(spark.createDataFrame(rows, "k string, t timestamp, y double"), ["k"], "t", "y"), ["t"])
    assert set(got["k"]) == {"flat"} and got["predicted"].tolist() == [float(h) for h in range(24)]
    assert set(got["p"]) == {-1}


SF = "/root/testdata/sf0.001"
# Results that come from Python workers or from small result sets built on the driver.
PYTHON_OK = {"seasonal_ar"}


def _over_slots(window):
    """Whether a window's rows are an aggregate's, one per clock slot (a single series has no other key)."""
    below = window.children().apply(0)
    while below.nodeName() in ("Project", "Window", "Filter"):
        below = below.children().apply(0)
    return below.nodeName() == "Aggregate" and "_slot" in below.groupingExpressions().toString()


LAZY = [n for n in contract.queries() if n not in {
    "backfill", "incremental_load", "stream_prices", "fit_gbt", "score", "feature_importance", "top_k_importance",
    "save_model", "insert_summary", "write_predictions", "clean_prices_filled", "impute_observed", "load_counts", "refresh_features",
    "train_and_report",
} and not n.startswith("op") and n != "pipeline"]


@pytest.mark.parametrize("name", LAZY)
def test_plans_have_no_cross_join_or_unkeyed_window(spark, name, capsys):
    df = contract.queries()[name](spark, SF)
    df.explain("simple")
    plan = capsys.readouterr().out
    for node in _nodes(df._jdf.queryExecution().optimizedPlan()):
        if node.nodeName() == "Window":
            groups = node.partitionSpec()
            named = [groups.apply(i).references().nonEmpty() for i in range(groups.size())]
            assert any(named) or _over_slots(node), f"a window over all rows: {node.toString()}"
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, plan
    if name not in PYTHON_OK:
        assert "Python" not in plan and "InPandas" not in plan, plan


def _nodes(plan):
    yield plan
    below = plan.children()
    for i in range(below.size()):
        yield from _nodes(below.apply(i))


@pytest.mark.parametrize("name, most", [("lags", 2), ("rolling_stats", 2), ("imputer_lags", 2), ("ffill", 1), ("interpolate_limited", 1)])
def test_row_order_operators_shuffle_their_rows_as_often_as_needed(spark, tmp_path, name, most):
    """Exchanges of whole rows, with neither broadcasts nor adaptive execution."""
    path = str(tmp_path / "rows")
    start = F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 3600)
    rows = spark.range(50).select(F.lit("a").alias("k"), start.alias("t"), F.col("id").cast("double").alias("y"), F.lit("x").alias("payload"))
    rows.write.parquet(path)
    stored = spark.read.parquet(path)
    run = {
        "lags": lambda: windows.lags(stored, ["k"], "t", "y"),
        "rolling_stats": lambda: windows.rolling_stats(stored, ["k"], "t", "y"),
        "imputer_lags": lambda: windows.imputer_lags(stored, ["k"], "t", "y"),
        "ffill": lambda: gaps.ffill(stored, ["k"], "t", ["y"]),
        "interpolate_limited": lambda: gaps.interpolate_limited(stored, ["k"], "t", ["y"]),
    }[name]
    off = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in off}
    try:
        for k, v in off.items():
            spark.conf.set(k, v)
        plan = run()._jdf.queryExecution().executedPlan()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    whole = [p for p in _nodes(plan) if p.nodeName() == "Exchange" and "payload" in p.output().mkString(",")]
    assert 0 < len(whole) <= most, plan.toString()


def test_filters_and_columns_reach_the_scan(spark, capsys):
    catalog.queries()["filter_year_from"](spark, SF).explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThanOrEqual(o_orderdate" in plan and "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp>" in plan
