"""Aggregations, profiles, quality reports and selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.base import register, table
from tidemark.catalog.stand_ins import KEY, daily, grid, hourly, with_ctes
from tidemark.operators import aggregates, frames, quality, quantiles, selection

PRIORITY = ["o_orderpriority"]


@register(
    "agg_sum",
    """SELECT l_suppkey, l_returnflag, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS l_extendedprice
       FROM lineitem GROUP BY 1, 2""",
)
def _sum(spark, sf):
    items = table(spark, sf, "lineitem").select(
        "l_suppkey", "l_returnflag", F.col("l_extendedprice").cast("decimal(18,2)").alias("l_extendedprice")
    )
    return aggregates.agg_sum(items, ["l_suppkey", "l_returnflag"], "l_extendedprice")


@register(
    "agg_month_mean_distinct",
    """SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS date, round(avg(o_totalprice) + 1e-9, 4) AS avg_total,
              CAST(count(DISTINCT o_custkey) AS BIGINT) AS n_customers FROM orders GROUP BY 1""",
    floats={"avg_total": 2},
)
def _month_mean(spark, sf):
    o = table(spark, sf, "orders")
    return aggregates.agg_month_mean_distinct(o, "o_orderdate", "o_totalprice", "o_custkey", "avg_total", "n_customers")


@register(
    "quantile_exact",
    """SELECT l_suppkey, quantile_cont(l_extendedprice, 0.25) AS q25, quantile_cont(l_extendedprice, 0.5) AS q50,
              quantile_cont(l_extendedprice, 0.999) AS q999 FROM lineitem GROUP BY 1""",
    floats={"q25": 5, "q50": 5, "q999": 5},
)
def _quantile(spark, sf):
    items = table(spark, sf, "lineitem")
    return quantiles.quantile_exact(items, ["l_suppkey"], "l_extendedprice", [0.25, 0.5, 0.999], ["q25", "q50", "q999"])


@register(
    "quantile_exact_large_groups",
    """SELECT l_returnflag, quantile_cont(l_extendedprice, 0.001) AS q001, quantile_cont(l_extendedprice, 0.5) AS q50,
              quantile_cont(l_extendedprice, 0.999) AS q999 FROM lineitem GROUP BY 1""",
    floats={"q001": 5, "q50": 5, "q999": 5},
)
def _quantile_large(spark, sf):
    # Groups of a third of all rows each, by the same plan.
    items = table(spark, sf, "lineitem")
    probs, names = [0.001, 0.5, 0.999], ["q001", "q50", "q999"]
    return quantiles.quantile_exact(items, ["l_returnflag"], "l_extendedprice", probs, names)


@register(
    "median_exact",
    "SELECT l_returnflag, l_linestatus, median(l_extendedprice) AS median FROM lineitem GROUP BY 1, 2",
    floats={"median": 4},
)
def _median(spark, sf):
    return quantiles.median_exact(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice")


@register(
    "profile_hour",
    """SELECT event_type, CAST(hour(ts) AS BIGINT) AS hour, avg(value) AS mean, median(value) AS median,
              stddev_samp(value) AS std FROM events GROUP BY 1, 2""",
    floats=["mean", "median", "std"],
)
def _profile_hour(spark, sf):
    e = table(spark, sf, "events").select("event_type", F.hour("ts").alias("hour"), "value")
    return aggregates.profile_hour(e, KEY, "hour", "value")


@register(
    "profile_hour_extremes",
    """WITH p AS (SELECT event_type, hour(ts) AS hour,
                    CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS mean FROM events GROUP BY 1, 2)
       SELECT event_type, CAST(arg_min(hour, (mean, hour)) AS BIGINT) AS min_hour, min(mean) AS min_mean,
              CAST(arg_max(hour, (mean, -hour)) AS BIGINT) AS max_hour, max(mean) AS max_mean FROM p GROUP BY 1""",
    floats=["min_mean", "max_mean"],
)
def _extremes(spark, sf):
    e = table(spark, sf, "events").groupBy("event_type", F.hour("ts").alias("hour")).agg(
        (F.sum(F.col("value").cast("decimal(18,2)")).cast("double") / F.count(F.lit(1))).alias("mean")
    )
    return aggregates.profile_extremes(e, KEY, "hour")


@register(
    "profile_dow",
    """SELECT o_orderpriority, CAST(isodow(o_orderdate) - 1 AS BIGINT) AS dow, avg(o_totalprice) AS mean
       FROM orders GROUP BY 1, 2""",
    floats={"mean": 3},
)
def _dow(spark, sf):
    return aggregates.profile_dow_month(_order_parts(spark, sf), PRIORITY, "dow", "mon", "o_totalprice")[0]


@register(
    "profile_dow_month",
    """SELECT k.o_orderpriority, k.mon, mean FROM
         (SELECT DISTINCT o_orderpriority, CAST(unnest(range(1, 13)) AS BIGINT) AS mon FROM orders) k
       LEFT JOIN (SELECT o_orderpriority, month(o_orderdate) AS mon, avg(o_totalprice) AS mean FROM orders GROUP BY 1, 2) m
         ON m.o_orderpriority = k.o_orderpriority AND m.mon = k.mon""",
    floats={"mean": 3},
)
def _dow_month(spark, sf):
    return aggregates.profile_dow_month(_order_parts(spark, sf), PRIORITY, "dow", "mon", "o_totalprice")[1]


def _order_parts(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderpriority", F.weekday("o_orderdate").alias("dow"), F.month("o_orderdate").alias("mon"), "o_totalprice"
    )


@register(
    "profile_hour_month",
    """SELECT event_type, CAST(hour(ts) AS BIGINT) AS hour, CAST(month(ts) AS BIGINT) AS month, avg(value) AS mean
       FROM events GROUP BY 1, 2, 3""",
    floats=["mean"],
)
def _hour_month(spark, sf):
    e = table(spark, sf, "events").select("event_type", F.hour("ts").alias("hour"), F.month("ts").alias("month"), "value")
    return aggregates.profile_hour_month(e, KEY, "hour", "month", "value")


@register(
    "kpi_latest_24h",
    with_ctes(
        "h",
        body="""SELECT event_type, max(hour) AS latest_ts, arg_max(value, hour) AS latest, avg(value) AS mean_24h,
            max(value) AS max_24h, min(value) AS min_24h
        FROM (SELECT *, max(hour) OVER (PARTITION BY event_type) AS newest FROM h)
        WHERE hour >= newest - INTERVAL 24 HOUR GROUP BY 1""",
    ),
    floats=["mean_24h"],
)
def _kpi(spark, sf):
    return aggregates.kpi_latest_24h(hourly(spark, sf), KEY, "hour", "value")


@register(
    "describe_series",
    """SELECT l_returnflag, CAST(count(l_quantity) AS BIGINT) AS count, round(avg(l_quantity), 2) AS mean,
              round(stddev_samp(l_quantity), 2) AS std, min(l_quantity) AS min, max(l_quantity) AS max,
              CAST(count(*) FILTER (l_quantity = 0) AS BIGINT) AS n_zero,
              CAST(count(*) FILTER (l_quantity < 5) AS BIGINT) AS n_below_5,
              CAST(count(*) FILTER (l_quantity > 40) AS BIGINT) AS n_above_40,
              quantile_cont(l_quantity, 0.25) AS p25, quantile_cont(l_quantity, 0.5) AS p50,
              quantile_cont(l_quantity, 0.75) AS p75
       FROM lineitem GROUP BY 1""",
)
def _describe(spark, sf):
    return aggregates.describe_series(table(spark, sf, "lineitem"), ["l_returnflag"], "l_quantity", above=(40,))


@register(
    "split_stats",
    """SELECT o_orderpriority, CASE WHEN o_orderdate < TIMESTAMP '1998-07-01' THEN 'train'
           WHEN o_orderdate < TIMESTAMP '1999-01-01' THEN 'val' ELSE 'test' END AS split,
           CAST(count(*) AS BIGINT) AS n, avg(o_totalprice) AS mean, stddev_samp(o_totalprice) AS std
       FROM orders GROUP BY 1, 2""",
    floats={"mean": 3, "std": 3},
)
def _split_stats(spark, sf):
    o = table(spark, sf, "orders").select("o_orderpriority", "o_orderdate", "o_totalprice")
    labelled = frames.split_chronological(o, "o_orderdate", "1998-06-30", "1998-12-31", train_start=None, test_end=None)
    return aggregates.split_stats(labelled, PRIORITY, "o_totalprice")


HISTOGRAM_SQL = """WITH e AS (SELECT {key}, min({v}) AS lo, max({v}) AS hi FROM {source} GROUP BY 1),
  c AS (SELECT s.{key}, least(CAST(floor((s.{v} - lo) / ((hi - lo) / {bins}.0)) AS BIGINT), {last}) AS bin, count(*) AS n
        FROM {source} s JOIN e ON e.{key} = s.{key} GROUP BY 1, 2),
  k AS (SELECT *, unnest(range(0, {bins})) AS bin FROM e)
SELECT k.{key}, CAST(k.bin AS BIGINT) AS bin, lo + k.bin * ((hi - lo) / {bins}.0) AS bin_start,
       lo + (k.bin + 1) * ((hi - lo) / {bins}.0) AS bin_end, CAST(coalesce(n, 0) AS BIGINT) AS n
FROM k LEFT JOIN c ON c.{key} = k.{key} AND c.bin = k.bin"""


@register(
    "histogram",
    HISTOGRAM_SQL.format(key="l_returnflag", v="l_extendedprice", source="lineitem", bins=80, last=79),
    floats={"bin_start": 4, "bin_end": 4},
)
def _histogram(spark, sf):
    return aggregates.histogram(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", 80)


@register(
    "boxplot_stats",
    """WITH q AS (SELECT year(o_orderdate) AS year, quantile_cont(o_totalprice, 0.25) AS q1,
                    quantile_cont(o_totalprice, 0.5) AS median, quantile_cont(o_totalprice, 0.75) AS q3
                  FROM orders GROUP BY 1)
       SELECT CAST(q.year AS BIGINT) AS year, q1, median, q3,
           min(o_totalprice) FILTER (o_totalprice >= q1 - 1.5 * (q3 - q1) AND o_totalprice <= q3 + 1.5 * (q3 - q1))
             AS whisker_low,
           max(o_totalprice) FILTER (o_totalprice >= q1 - 1.5 * (q3 - q1) AND o_totalprice <= q3 + 1.5 * (q3 - q1))
             AS whisker_high,
           CAST(count(*) FILTER (o_totalprice < q1 - 1.5 * (q3 - q1) OR o_totalprice > q3 + 1.5 * (q3 - q1)) AS BIGINT)
             AS n_outliers
       FROM orders JOIN q ON q.year = year(o_orderdate) GROUP BY 1, 2, 3, 4""",
    floats={"q1": 4, "median": 4, "q3": 4},
)
def _boxplot(spark, sf):
    o = table(spark, sf, "orders").select(F.year("o_orderdate").alias("year"), "o_totalprice")
    return aggregates.boxplot_stats(o, ["year"], "o_totalprice")


NUMERIC = ["l_extendedprice", "l_discount", "l_tax"]


@register(
    "correlations",
    " UNION ALL ".join(
        f"SELECT l_returnflag, '{c}' AS variable, corr(l_quantity, {c}) AS correlation FROM lineitem GROUP BY 1"
        for c in NUMERIC
    ),
    floats=["correlation"],
)
def _correlations(spark, sf):
    return aggregates.correlations(table(spark, sf, "lineitem"), ["l_returnflag"], "l_quantity", NUMERIC)


@register(
    "linear_trend",
    """WITH f AS (SELECT l_linestatus, regr_slope(l_extendedprice, l_quantity) AS slope,
                    regr_intercept(l_extendedprice, l_quantity) AS intercept, min(l_quantity) AS lo, max(l_quantity) AS hi
                  FROM lineitem GROUP BY 1)
       SELECT l_linestatus, slope, intercept, CAST(point AS BIGINT) AS point, lo + (hi - lo) * point / 199.0 AS x,
              intercept + slope * (lo + (hi - lo) * point / 199.0) AS y
       FROM (SELECT *, unnest(range(0, 200)) AS point FROM f)""",
    floats={"slope": 4, "intercept": 3, "x": 6, "y": 3},
)
def _trend(spark, sf):
    return aggregates.linear_trend(table(spark, sf, "lineitem"), ["l_linestatus"], "l_quantity", "l_extendedprice")


@register(
    "resample_daily",
    """SELECT k.o_orderpriority, k.day, o.o_totalprice FROM
         (SELECT o_orderpriority, unnest(generate_series(min(o_orderdate), max(o_orderdate), INTERVAL 1 DAY)) AS day
          FROM orders GROUP BY 1) k
       LEFT JOIN (SELECT o_orderpriority, o_orderdate, avg(o_totalprice) AS o_totalprice FROM orders GROUP BY 1, 2) o
         ON o.o_orderpriority = k.o_orderpriority AND o.o_orderdate = k.day""",
    floats={"o_totalprice": 3},
)
def _resample(spark, sf):
    o = table(spark, sf, "orders").select("o_orderpriority", "o_orderdate", "o_totalprice")
    return aggregates.resample_daily(o, PRIORITY, "o_orderdate", "o_totalprice")


@register(
    "data_quality",
    """WITH t AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS price,
                    CAST(NULL AS DOUBLE) AS nothing, o_orderdate FROM orders),
       c AS (SELECT 'o_orderkey' AS col, count(*) - count(o_orderkey) AS n, count(*) AS rows FROM t
             UNION ALL SELECT 'price', count(*) - count(price), count(*) FROM t
             UNION ALL SELECT 'nothing', count(*) - count(nothing), count(*) FROM t
             UNION ALL SELECT 'o_orderdate', count(*) - count(o_orderdate), count(*) FROM t)
       SELECT 'all_null' AS "check", col AS "column", CAST(n AS BIGINT) AS n, n / rows AS share, n < rows AS passed FROM c
       UNION ALL SELECT 'null_share', col, CAST(n AS BIGINT), n / rows, n / rows <= 0.05 FROM c
       UNION ALL SELECT 'repeated_time', 'o_orderdate', CAST(count(*) - count(DISTINCT o_orderdate) AS BIGINT),
                        (count(*) - count(DISTINCT o_orderdate)) / count(*), count(*) = count(DISTINCT o_orderdate) FROM t""",
    floats=["share"],
)
def _quality(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("price"),
        F.lit(None).cast("double").alias("nothing"), "o_orderdate",
    )
    return quality.data_quality(o, "o_orderdate")


@register(
    "null_profile",
    with_ctes(
        "g",
        body="""SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(3 AS BIGINT) AS n_columns, min(hour) AS first_ts,
            max(hour) AS last_ts, 'value' AS "column", CAST(count(*) - count(value) AS BIGINT) AS n_null
        FROM g HAVING count(*) > count(value)""",
    ),
)
def _null_profile(spark, sf):
    return quality.null_profile(grid(spark, sf), "hour")


@register("sort_series", "SELECT o_orderpriority, day, total FROM (" + with_ctes("d", body="SELECT * FROM d") + ")")
def _sort(spark, sf):
    return selection.sort_series(daily(spark, sf), ["o_orderpriority", "day"])


@register(
    "sample_cap",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate, l_extendedprice FROM (
         SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity,
           md5(concat_ws(':', '42', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR),
                         CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR))) AS r FROM lineitem)
       ORDER BY r, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 20000""",
)
def _sample(spark, sf):
    items = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity"
    ).distinct()
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return selection.sample_cap(items, 20_000, keys, "l_shipdate").drop("l_suppkey", "l_quantity")


