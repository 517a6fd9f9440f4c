from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from tests.frames import same, to_pandas, to_spark
from tidemark.operators import joins
from tidemark.operators.calendar import easter, national_holidays

FAST, SLOW = "k string, ts timestamp", "k string, d timestamp, x double"


def test_asof_equals_merge_asof_over_several_keys(spark):
    rng = np.random.default_rng(11)
    fast, slow = [], []
    for k in ("a", "b", "c"):
        n = 4000 if k == "a" else 300
        fast.append(pd.DataFrame({"k": k, "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.sort(rng.choice(9000, n, replace=False)), unit="h")}))
        at = np.sort(rng.choice(9000 * 60, 90, replace=False))
        x = rng.normal(size=90)
        x[::5] = np.nan
        slow.append(pd.DataFrame({"k": k, "d": pd.Timestamp("2024-01-10") + pd.to_timedelta(at, unit="min"), "x": x}))
    fast, slow = pd.concat(fast), pd.concat(slow)
    got = to_pandas(
        joins.asof_ffill(to_spark(spark, fast, FAST), to_spark(spark, slow, SLOW), ["k"], "ts", "d", ["x"]), ["k", "ts"]
    )
    want = pd.merge_asof(fast.sort_values("ts"), slow.sort_values("d"), left_on="ts", right_on="d", by="k")
    same(got, want.sort_values(["k", "ts"]).reset_index(drop=True), ["x"])


def test_asof_matches_null_rows_and_optionally_fills_backwards(spark):
    start = datetime(2024, 1, 1)
    fast = spark.createDataFrame([("a", start + timedelta(hours=12 * i)) for i in range(10)], FAST)
    slow = spark.createDataFrame([(date(2024, 1, 2), 1.0), (date(2024, 1, 3), None), (date(2024, 1, 5), 3.0)], "d date, x double")
    plain = to_pandas(joins.asof_ffill(fast, slow, [], "ts", "d", ["x"]), ["ts"])["x"].tolist()
    assert [None if pd.isna(x) else x for x in plain] == [None, None, 1, 1, None, None, None, None, 3, 3]
    filled = to_pandas(joins.asof_ffill(fast, slow, [], "ts", "d", ["x"], True, ["k"]), ["ts"])["x"].tolist()
    assert filled == [1, 1, 1, 1, 3, 3, 3, 3, 3, 3]


def test_asof_without_any_slow_row_keeps_the_fast_rows(spark):
    fast = spark.createDataFrame([("a", datetime(2024, 1, 1))], FAST)
    slow = spark.createDataFrame([], "d date, x double")
    assert joins.asof_ffill(fast, slow, [], "ts", "d", ["x"]).first()["x"] is None


def test_empty_join_is_an_error(spark):
    a = spark.createDataFrame([(datetime(2024, 1, 1), 1.0)], "datetime timestamp, p double")
    b = spark.createDataFrame([(datetime(2024, 1, 2), 1.0)], "datetime timestamp, g double")
    with pytest.raises(ValueError):
        joins.require_rows(joins.join_price_generation(a, b), "join")
    assert joins.require_rows(a, "prices") is a


def test_domain_has_every_cell_for_every_key_including_null_keys(spark):
    df = spark.createDataFrame([("a", 3, 1.0), (None, 5, 2.0)], "k string, h int, v double")
    got = joins.reindex_domain(df, ["k"], "h", 0, 23)
    assert got.count() == 48 and got.where("v is not null").count() == 2


def test_asof_without_keys_equals_merge_asof_over_many_slots(spark):
    rng = np.random.default_rng(12)
    fast = pd.DataFrame({"ts": pd.Timestamp("2020-01-01") + pd.to_timedelta(np.sort(rng.choice(40000, 3000, replace=False)), unit="h")})
    at = np.sort(rng.choice(40000 * 60, 60, replace=False))
    at = at[(at < 8000 * 60) | (at > 26000 * 60)]  # slots without a slow row
    slow = pd.DataFrame({"d": pd.Timestamp("2020-02-01") + pd.to_timedelta(at, unit="min"), "x": rng.normal(size=len(at))})
    df = joins.asof_ffill(to_spark(spark, fast, "ts timestamp"), to_spark(spark, slow, "d timestamp, x double"), [], "ts", "d", ["x"])
    same(to_pandas(df, ["ts"]), pd.merge_asof(fast, slow, left_on="ts", right_on="d"), ["x"])
    twice = spark.createDataFrame([(date(2024, 1, 2), 1.0), (date(2024, 1, 2), 2.0)], "d date, x double")
    with pytest.raises(Exception, match="several slow rows"):
        joins.asof_ffill(spark.createDataFrame([(datetime(2024, 1, 5),)], "ts timestamp"), twice, [], "ts", "d", ["x"]).collect()


def test_holidays_follow_the_rules_and_unknown_years_are_errors(spark):
    days = {str(r["date"]) for r in national_holidays(spark, 2019, 2025).collect()}
    known = """2019-01-01 2019-04-19 2019-04-20 2019-05-01 2019-05-21 2019-06-29 2019-07-16 2019-08-15 2019-09-18 2019-09-19 2019-09-20
      2019-10-12 2019-10-31 2019-11-01 2019-12-08 2019-12-25""".split()
    assert {d for d in days if d.startswith("2019")} == set(known)
    expected = {"2021-06-21", "2022-06-21", "2023-06-21", "2024-06-20", "2025-06-20", "2021-09-17", "2023-10-27", "2023-01-02", "2020-10-12",
                "2024-03-29", "2025-04-18", "2023-10-09", "2021-06-28", "2023-06-26", "2024-09-20"}
    assert expected <= days and "2018-12-25" not in days and "2020-06-21" not in days and "2023-10-31" not in days
    df = spark.createDataFrame([(date(2019, 9, 18),), (date(2019, 9, 17),), (None,)], "d date")
    got = {r["d"]: r["is_holiday"] for r in joins.lookup_holiday(df, "d", national_holidays(spark, 2019, 2019)).collect()}
    assert got == {date(2019, 9, 18): True, date(2019, 9, 17): False, None: False}
    for table, years in ((national_holidays(spark, 2020, 2021), None), (national_holidays(spark, 2019, 2021), (2020, 2021)), (national_holidays(spark, 2019, 2019).limit(0), None)):
        with pytest.raises(Exception, match="no holidays are known for the year 2019"):
            joins.lookup_holiday(df, "d", table, years=years).collect()


def test_easter_equals_the_known_sundays(spark):
    known = {1961: "04-02", 2000: "04-23", 2008: "03-23", 2011: "04-24", 2016: "03-27", 2019: "04-21", 2020: "04-12", 2023: "04-09", 2024: "03-31", 2025: "04-20", 2038: "04-25"}
    got = spark.createDataFrame([(y,) for y in known], "y int").select("y", easter(F.col("y")).alias("e")).collect()
    assert {r["y"]: str(r["e"])[5:] for r in got} == known
