"""Window operators and scaling over hourly and daily series."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.base import register, table
from tidemark.catalog.stand_ins import KEY, daily, grid, series, with_ctes
from tidemark.operators import aggregates, frames, windows

LAG_SQL = ", ".join(f"lag(value, {h}) OVER w AS lag_value_{h}h" for h in windows.LAG_HOURS)
ROLL_SQL = ", ".join(
    f"{fn}(value) OVER (PARTITION BY event_type ORDER BY hour ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    f" AS rolling_{stat}_value_{n}h"
    for n in windows.ROLLING_HOURS
    for stat, fn in (("mean", "avg"), ("std", "stddev_samp"))
)
ROLL_NAMES = [f"rolling_{stat}_value_{n}h" for n in windows.ROLLING_HOURS for stat in ("mean", "std")]
W_SQL = "WINDOW w AS (PARTITION BY event_type ORDER BY hour)"


@register("lags", with_ctes("h", body=f"SELECT event_type, hour, value, {LAG_SQL} FROM h {W_SQL}"))
def _lags(spark, sf):
    return windows.lags(series(spark, sf), KEY, "hour", "value")


@register(
    "lags_by_time",
    with_ctes(
        "h",
        body="SELECT a.event_type, a.hour, a.value, "
        + ", ".join(f"b{h}.value AS lag_value_{h}h" for h in windows.LAG_HOURS)
        + " FROM h a "
        + " ".join(
            f"LEFT JOIN h b{h} ON b{h}.event_type = a.event_type AND b{h}.hour = a.hour - INTERVAL {h} HOUR"
            for h in windows.LAG_HOURS
        ),
    ),
)
def _lags_by_time(spark, sf):
    return windows.lags(series(spark, sf), KEY, "hour", "value", mode="time")


@register(
    "rolling_stats", with_ctes("h", body=f"SELECT event_type, hour, value, {ROLL_SQL} FROM h"), floats=ROLL_NAMES
)
def _rolling(spark, sf):
    return windows.rolling_stats(series(spark, sf), KEY, "hour", "value")


@register(
    "lags_and_rolling",
    with_ctes("h", body=f"SELECT event_type, hour, value, {LAG_SQL}, {ROLL_SQL} FROM h {W_SQL}"),
    floats=ROLL_NAMES,
)
def lag_roll(spark, sf):
    return windows.lags_and_rolling(series(spark, sf), KEY, "hour", "value")


@register(
    "rolling_stats_by_time",
    with_ctes(
        "h",
        body="""SELECT event_type, hour, value,
            avg(value) OVER w AS rolling_mean_value_24h, stddev_samp(value) OVER w AS rolling_std_value_24h
        FROM h WINDOW w AS (PARTITION BY event_type ORDER BY hour
            RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND INTERVAL 1 HOUR PRECEDING)""",
    ),
    floats=["rolling_mean_value_24h", "rolling_std_value_24h"],
)
def _rolling_by_time(spark, sf):
    return windows.rolling_stats(series(spark, sf), KEY, "hour", "value", [24], mode="time")


@register(
    "imputer_lags",
    with_ctes(
        "g",
        body=f"SELECT event_type, hour, value, lag(value, 24) OVER w AS lag_24h, lag(value, 168) OVER w AS lag_168h "
        f"FROM g {W_SQL}",
    ),
)
def _imputer_lags(spark, sf):
    return windows.imputer_lags(grid(spark, sf), KEY, "hour", "value")


@register(
    "sliding_sequences",
    with_ctes(
        "h",
        body="""SELECT event_type, hour, value AS target, 168 AS steps, lag(value, 168) OVER w AS first_value,
            lag(value, 1) OVER w AS last_value,
            sum(value) OVER (PARTITION BY event_type ORDER BY hour ROWS BETWEEN 168 PRECEDING AND 1 PRECEDING)
              AS sum_value
        FROM h WINDOW w AS (PARTITION BY event_type ORDER BY hour)
        QUALIFY row_number() OVER w > 168""",
    ),
    floats={"sum_value": 4},
)
def _sequences(spark, sf):
    found = windows.sliding_sequences(series(spark, sf), KEY, "hour", ["value"], "value")
    values = F.col("sequence.value")
    return found.select(
        "event_type", "hour", "target", F.size("sequence").alias("steps"), values[0].alias("first_value"),
        F.element_at(values, -1).alias("last_value"),
        F.aggregate(values, F.lit(0.0), lambda a, x: a + x).alias("sum_value"),
    )


@register(
    "moving_average_full",
    with_ctes(
        "d",
        body="""SELECT o_orderpriority, day, total,
            CASE WHEN count(total) OVER w = 30 THEN avg(total) OVER w END AS moving_avg_total_30d
        FROM d WINDOW w AS (PARTITION BY o_orderpriority ORDER BY day
            RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW)""",
    ),
    floats={"moving_avg_total_30d": 4},
)
def _moving(spark, sf):
    return windows.moving_average_full(daily(spark, sf), ["o_orderpriority"], "day", "total")


@register(
    "dedupe_first",
    """SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice, o_orderpriority FROM orders
       QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey) = 1""",
)
def _dedupe(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_custkey", "o_orderdate", "o_orderkey", "o_totalprice", "o_orderpriority"
    )
    return windows.dedupe_first(orders, ["o_custkey", "o_orderdate"], ["o_orderkey"])


@register(
    "first_n_days",
    """SELECT o.o_custkey, o.o_orderkey, o.o_orderdate FROM orders o
       JOIN (SELECT o_custkey, min(o_orderdate) AS start FROM orders GROUP BY 1) s ON s.o_custkey = o.o_custkey
       WHERE o.o_orderdate <= s.start + INTERVAL 30 DAY""",
)
def _first_days(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return windows.first_n_days(orders, ["o_custkey"], "o_orderdate")


@register(
    "last_n_days",
    """SELECT o_orderkey, o_orderdate FROM orders
       WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 30 DAY""",
)
def _last_days(spark, sf):
    return windows.last_n_days(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate")


@register(
    "minmax_fit",
    """SELECT min(l_quantity) AS l_quantity_min, max(l_quantity) AS l_quantity_max,
              min(l_extendedprice) AS l_extendedprice_min, max(l_extendedprice) AS l_extendedprice_max
       FROM lineitem WHERE l_shipdate < TIMESTAMP '1999-01-01'""",
)
def _minmax_fit(spark, sf):
    items = table(spark, sf, "lineitem")
    train = items.where(F.col("l_shipdate") < F.lit("1999-01-01").cast("timestamp"))
    return aggregates.minmax_fit(train, ["l_quantity", "l_extendedprice"])


@register(
    "minmax_scale",
    """WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem
                  WHERE l_shipdate < TIMESTAMP '1999-01-01')
       SELECT l_orderkey, l_linenumber, l_partkey, (l_extendedprice - lo) / (hi - lo) AS l_extendedprice
       FROM lineitem, e""",
    floats=["l_extendedprice"],
)
def _minmax_scale(spark, sf):
    items = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate"
    )
    train = items.where(F.col("l_shipdate") < F.lit("1999-01-01").cast("timestamp"))
    fitted = aggregates.minmax_fit(train, ["l_extendedprice"])
    return aggregates.minmax_scale(items.drop("l_shipdate"), fitted, ["l_extendedprice"])


@register(
    "minmax_inverse",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem",
    floats={"l_extendedprice": 4},
)
def _minmax_inverse(spark, sf):
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    fitted = aggregates.minmax_fit(items, ["l_extendedprice"])
    scaled = aggregates.minmax_scale(items, fitted, ["l_extendedprice"])
    return aggregates.minmax_inverse(scaled, fitted, "l_extendedprice", "l_extendedprice")


@register(
    "split_chronological",
    """SELECT o_orderkey, CASE WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN NULL
                               WHEN o_orderdate < TIMESTAMP '1998-07-01' THEN 'train'
                               WHEN o_orderdate < TIMESTAMP '1999-01-01' THEN 'val'
                               WHEN o_orderdate < TIMESTAMP '1999-07-01' THEN 'test' END AS split
       FROM orders""",
)
def _split(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return frames.split_chronological(
        orders, "o_orderdate", "1998-06-30", "1998-12-31", train_start="1996-01-01", test_end="1999-06-30"
    ).drop("o_orderdate")
