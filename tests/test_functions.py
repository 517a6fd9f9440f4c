import pytest
from pyspark.sql import functions as F

from tidemark import functions as fn
from tidemark.operators import frames


def one(spark, value, expr, kind="string"):
    df = spark.createDataFrame([(value,)], f"c {kind}")
    return df.select(expr(F.col("c")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, value",
    [("59,80", 59.8), (" 110,25\t", 110.25), ("-3,5", -3.5), ("1e3", 1000.0), ("1.234,5", None), ("", None),
     ("1d", None), ("NaN", None), ("abc", None), (None, None), ("7", 7.0), (",5", 0.5)],
)
def test_decimal_comma(spark, text, value):
    assert one(spark, text, fn.parse_decimal_comma) == value


@pytest.mark.parametrize(
    "text, fmt, value",
    [("2024-03-10", "yyyy-M-d", "2024-03-10"), ("2024-13-10", "yyyy-M-d", None), ("31/12/2024", "d/M/yyyy", "2024-12-31"),
     ("12/31/2024", "d/M/yyyy", None), ("2024-03-10x", "yyyy-M-d", None), (" 1/2/2024 ", "d/M/yyyy", "2024-02-01")],
)
def test_strict_dates(spark, text, fmt, value):
    got = one(spark, text, lambda c: fn.parse_date_strict(c, fmt))
    assert (str(got) if got else None) == value


@pytest.mark.parametrize(
    "day, hour, utc",
    [
        ("2024-01-15", 1, "2024-01-15 03:00:00"),
        ("2024-01-15", 24, "2024-01-16 02:00:00"),
        ("2023-09-03", 1, "2023-09-03 04:00:00"),  # skipped by the spring change
        ("2023-09-03", 2, "2023-09-03 04:00:00"),
        ("2024-04-06", 24, "2024-04-07 02:00:00"),  # repeated in autumn: daylight-saving time
        ("2024-04-07", 1, "2024-04-07 04:00:00"),
    ],
)
def test_hour_labels_across_clock_changes(spark, day, hour, utc):
    df = spark.createDataFrame([(day, hour)], "d string, h int")
    local = fn.hour24_to_ts(fn.parse_date_strict(F.col("d"), "yyyy-M-d"), F.col("h"))
    assert df.select(fn.local_to_utc(local).cast("string").alias("x")).first()["x"] == utc


def test_missing_markers(spark):
    df = spark.createDataFrame([("NA", "null", "x"), ("", "N/A", "NULL"), ("n/a", "NaN", "-")], "a string, b string, c string")
    got = [tuple(r) for r in frames.null_tokens(df).collect()]
    assert got == [(None, None, "x"), (None, None, "NULL"), ("n/a", "NaN", "-")]


def test_row_sum(spark):
    df = spark.createDataFrame([(1.0, None), (None, None)], "a double, b double")
    got = df.select(fn.row_sum([F.col("a"), F.col("b")]).alias("x"), fn.row_sum([F.col("a"), F.col("b")], 1).alias("y"))
    assert [tuple(r) for r in got.collect()] == [(1.0, 1.0), (0.0, None)]


def test_night_zero_replaces_null_until_six(spark):
    rows = [(f"2024-01-15 {h:02d}:00:00", None) for h in (0, 2, 3, 8, 9, 12, 23)]
    df = spark.createDataFrame(rows, "t string, v double").withColumn("t", F.col("t").cast("timestamp"))
    got = [r["x"] for r in df.select(fn.zero_at_night(F.col("v"), F.col("t")).alias("x")).collect()]
    # local hours 21, 23, 0, 5, 6, 9, 20
    assert got == [0.0, 0.0, 0.0, 0.0, None, None, None]


def test_cyclic_encoding_is_bounded_and_joins_midnight(spark):
    df = spark.range(24).select(F.expr("timestamp'2024-06-03 04:00:00' + make_interval(0,0,0,0,cast(id as int))").alias("ts"))
    rows = frames.cyclic_encode(df, "ts").orderBy("ts").collect()
    names = [f"{p}_{w}" for p in ("hora", "dow", "mes") for w in ("sin", "cos")]
    assert all(-1 <= r[n] <= 1 for r in rows for n in names)
    first, last = rows[0], rows[-1]
    assert ((first["hora_sin"] - last["hora_sin"]) ** 2 + (first["hora_cos"] - last["hora_cos"]) ** 2) ** 0.5 < 0.3


def test_header_clean_up(spark):
    df = spark.createDataFrame([("1", "2")], "a string, b string").toDF("ï»¿FECHA ", " central")
    assert frames.normalize_header(df, "fecha").columns == ["fecha", "central"]
    with pytest.raises(ValueError, match="cota_msnm"):
        frames.require_columns(df, ["cota_msnm"])


def test_split_boundaries(spark):
    rows = ["2023-06-30 23:00:00", "2023-07-01 00:00:00", "2023-12-31 23:00:00", "2024-01-01 00:00:00"]
    df = spark.createDataFrame([(r,) for r in rows], "t string").withColumn("t", F.col("t").cast("timestamp"))
    got = [r["split"] for r in frames.split_chronological(df, "t").orderBy("t").collect()]
    assert got == ["train", "val", "val", "test"]
    rows = ["2015-05-05 00:00:00", "2020-12-31 23:00:00", "2021-01-01 00:00:00", "2024-12-31 23:00:00", "2025-01-01 00:00:00", "2030-05-05 00:00:00"]
    df = spark.createDataFrame([(r,) for r in rows], "t string").withColumn("t", F.col("t").cast("timestamp"))
    assert [r["split"] for r in frames.split_chronological(df, "t").orderBy("t").collect()] == [None, None, "train", "test", None, None]
    open_ended = frames.split_chronological(df, "t", train_start=None, test_end=None).orderBy("t").collect()
    assert [r["split"] for r in open_ended] == ["train"] * 3 + ["test"] * 3


def test_half_even_rounding(spark):
    assert one(spark, 2.12345, lambda c: fn.round_to(c, 4), "double") == 2.1234
