from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.frames import random_series, same, to_pandas, to_spark
from tidemark.operators import buckets, gaps, windows
from tidemark.operators.joins import regularize_hourly

SCHEMA = "k string, ts timestamp, v double"


def by_key(pdf, fn):
    ordered = pdf.sort_values(["k", "ts"])
    return ordered.assign(w=ordered.groupby("k")["v"].transform(fn)).reset_index(drop=True)


@pytest.mark.parametrize("seed", [1, 2])
def test_lags_and_rolling_by_rows_match_pandas(spark, seed):
    pdf = random_series(seed)
    df = to_spark(spark, pdf, SCHEMA)
    got = to_pandas(windows.lags_and_rolling(df, ["k"], "ts", "v", [1, 5, 30], [7, 30]), ["k", "ts"])
    for h in (1, 5, 30):
        same(got, by_key(pdf, lambda s: s.shift(h)).rename(columns={"w": f"lag_v_{h}h"}), [f"lag_v_{h}h"])
    for n in (7, 30):
        mean = by_key(pdf, lambda s: s.shift(1).rolling(n, min_periods=1).mean())
        std = by_key(pdf, lambda s: s.shift(1).rolling(n, min_periods=1).std())
        same(got, mean.rename(columns={"w": f"rolling_mean_v_{n}h"}), [f"rolling_mean_v_{n}h"])
        same(got, std.rename(columns={"w": f"rolling_std_v_{n}h"}), [f"rolling_std_v_{n}h"])


def test_long_windows_composed_of_short_ones_match_pandas(spark):
    pdf = random_series(6, holes=0.7)
    pdf.loc[pdf.k == "k3", "v"] = pdf["v"].where(pdf["v"].isna(), 1e6 + 0.25)  # constant: deviation exactly 0
    pdf.loc[pdf.k == "k4", "v"] = None
    got = to_pandas(windows.rolling_stats(to_spark(spark, pdf, SCHEMA), ["k"], "ts", "v", [6, 30, 36, 13]), ["k", "ts"])
    assert list(got.columns)[3:] == [f"rolling_{s}_v_{n}h" for n in (6, 30, 36, 13) for s in ("mean", "std")]
    for n in (6, 30, 36, 13):
        mean = by_key(pdf, lambda s: s.shift(1).rolling(n, min_periods=1).mean())
        std = by_key(pdf, lambda s: s.shift(1).rolling(n, min_periods=1).apply(lambda x: x.std()))
        np.testing.assert_allclose(got[f"rolling_mean_v_{n}h"], mean["w"], rtol=1e-9)
        np.testing.assert_allclose(got[f"rolling_std_v_{n}h"], std["w"], rtol=1e-7, atol=1e-9)


def test_small_buckets_give_the_same_lags(spark):
    pdf = random_series(3)
    df = to_spark(spark, pdf, SCHEMA)

    def columns(w):
        return {"x": F.lag("v", 3).over(w), "m": F.avg("v").over(w.rowsBetween(-3, -1))}

    small = to_pandas(buckets.over_rows(df, ["k"], "ts", 3, columns, slot_hours=10, stretch_rows=24), ["k", "ts"])
    want = by_key(pdf, lambda s: s.shift(3)).rename(columns={"w": "x"})
    same(small, want, ["x"])
    mean = by_key(pdf, lambda s: s.shift(1).rolling(3, min_periods=1).mean()).rename(columns={"w": "m"})
    same(small, mean, ["m"])
    assert list(small.columns) == ["k", "ts", "v", "x", "m"]


def test_lags_by_time_look_up_the_hour(spark):
    pdf = random_series(4)
    got = to_pandas(windows.lags(to_spark(spark, pdf, SCHEMA), ["k"], "ts", "v", [2, 24], mode="time"), ["k", "ts"])
    for h in (2, 24):
        earlier = pdf.assign(ts=pdf.ts + pd.Timedelta(hours=h)).rename(columns={"v": f"lag_v_{h}h"})
        want = pdf.merge(earlier, on=["k", "ts"], how="left").sort_values(["k", "ts"]).reset_index(drop=True)
        same(got, want, [f"lag_v_{h}h"])


def test_first_lag_is_null_and_others_shift(spark):
    start = datetime(2024, 1, 1)
    rows = [(k, start + timedelta(hours=i), float(10 * i + o)) for k, o in (("a", 0), ("b", 5)) for i in range(10)]
    got = to_pandas(windows.lags(spark.createDataFrame(rows, SCHEMA), ["k"], "ts", "v", [1]), ["k", "ts"])
    assert got["lag_v_1h"].isna().tolist() == ([True] + [False] * 9) * 2
    assert got["lag_v_1h"].dropna().tolist() == [10.0 * i for i in range(9)] + [10.0 * i + 5 for i in range(9)]


def test_rolling_excludes_the_current_row(spark):
    start = datetime(2024, 1, 1)
    rows = [("a", start + timedelta(hours=i), 100.0 if i < 49 else 999.0) for i in range(50)]
    got = to_pandas(windows.rolling_stats(spark.createDataFrame(rows, SCHEMA), ["k"], "ts", "v", [24]), ["ts"])
    assert got["rolling_mean_v_24h"].iloc[-1] == 100.0
    assert pd.isna(got["rolling_std_v_24h"].iloc[1])


@pytest.mark.parametrize("slot_hours", [7, 2160])
def test_fills_match_pandas(spark, slot_hours):
    pdf = random_series(5, holes=0.6)
    df = to_spark(spark, pdf, SCHEMA)
    cases = {
        "ffill": (gaps.ffill(df, ["k"], "ts", ["v"], slot_hours), lambda s: s.ffill()),
        "bfill": (gaps.bfill(df, ["k"], "ts", ["v"], slot_hours), lambda s: s.bfill()),
        "limit 3": (
            gaps.interpolate_limited(df, ["k"], "ts", ["v"], 3, slot_hours=slot_hours),
            lambda s: s.interpolate(method="linear", limit=3, limit_direction="forward"),
        ),
        "all": (
            gaps.interpolate_all(df, ["k"], "ts", ["v"]),
            lambda s: s.interpolate(method="linear").ffill().bfill(),
        ),
    }
    for name, (found, fn) in cases.items():
        got = to_pandas(found, ["k", "ts"])
        print(name)
        same(got, by_key(pdf, fn).drop(columns="v").rename(columns={"w": "v"}), ["v"])


def test_interpolation_of_each_kind_of_gap(spark):
    cells = [None, 1, None, None, None, None, None, 7, None, None, None, None]
    start = datetime(2024, 1, 1)
    rows = [("a", start + timedelta(hours=i), None if c is None else float(c)) for i, c in enumerate(cells)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = to_pandas(gaps.interpolate_limited(df, ["k"], "ts", ["v"]), ["ts"])["v"].tolist()
    want = [None, 1, 2, 3, 4, None, None, 7, 7, 7, 7, None]
    assert [None if pd.isna(x) else x for x in got] == want
    short = to_pandas(gaps.interpolate_limited(df, ["k"], "ts", ["v"], short_gaps_only=True), ["ts"])["v"].tolist()
    assert [None if pd.isna(x) else x for x in short] == cells


def test_sequences_start_after_enough_rows_and_keep_sets_apart(spark):
    start = datetime(2024, 1, 1)
    rows = [("a", s, start + timedelta(hours=i), float(i)) for s, lo, hi in (("x", 0, 6), ("y", 6, 9)) for i in range(lo, hi)]
    df = spark.createDataFrame(rows, "k string, s string, ts timestamp, v double")
    got = to_pandas(windows.sliding_sequences(df, ["k", "s"], "ts", ["v"], "v", n=4), ["ts"])
    assert got["target"].tolist() == [4.0, 5.0]
    assert [[r["v"] for r in q] for q in got["sequence"]] == [[0, 1, 2, 3], [1, 2, 3, 4]]


def test_regularize_adds_missing_hours_across_slots(spark):
    start = datetime(2024, 1, 1)
    rows = [("a", start, 1.0), ("a", start + timedelta(hours=5000), 2.0), ("b", start, 3.0)]
    got = regularize_hourly(spark.createDataFrame(rows, SCHEMA), ["k"], "ts")
    counts = {r["k"]: (r["n"], r["m"], r["d"]) for r in got.groupBy("k").agg(
        F.count("*").alias("n"), F.count("v").alias("m"), F.count_distinct("ts").alias("d")).collect()}
    assert counts == {"a": (5001, 2, 5001), "b": (1, 1, 1)}


def test_dedupe_takes_the_smallest_by_tie_break(spark):
    rows = [("a", 2, "x"), ("a", 1, "z"), ("a", 1, "y"), ("b", 9, None)]
    got = windows.dedupe_first(spark.createDataFrame(rows, "k string, o int, v string"), ["k"], ["o"]).collect()
    assert sorted(tuple(r) for r in got) == [("a", 1, "y"), ("b", 9, None)]


def test_keys_are_required(spark):
    df = spark.createDataFrame([("a", datetime(2024, 1, 1), 1.0)], SCHEMA)
    for call in (lambda: windows.lags(df, [], "ts", "v"), lambda: gaps.ffill(df, [], "ts", ["v"])):
        with pytest.raises(ValueError):
            call()
