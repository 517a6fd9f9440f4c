"""Parsing, clock and column clean-up operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import functions as fn
from tidemark.catalog.base import register, table
from tidemark.catalog.stand_ins import TECH_OF, generation, hourly, local_sql, predictions, weather, with_ctes
from tidemark.operators import frames, reshape


@register(
    "parse_decimal_comma",
    """SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN NULL WHEN 'SMALL' THEN NULL ELSE p_retailprice END AS price
       FROM part""",
)
def _decimal(spark, sf):
    # Economy parts get a thousands separator, small ones a word; both are malformed.
    part = table(spark, sf, "part")
    text = F.replace(F.col("p_retailprice").cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(","))
    text = (
        F.when(F.col("p_type") == "ECONOMY", F.concat(F.lit("1."), text))
        .when(F.col("p_type") == "SMALL", F.lit("sin dato"))
        .otherwise(F.concat(F.lit("  "), text, F.lit(" ")))
    )
    return part.select("p_partkey", fn.parse_decimal_comma(text).alias("price"))


@register(
    "parse_date_strict",
    """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders""",
)
def _date(spark, sf):
    # Pending orders get a month that does not exist.
    text = F.when(F.col("o_orderstatus") == "P", F.date_format("o_orderdate", "dd/'13'/yyyy")).otherwise(
        F.date_format("o_orderdate", " dd/MM/yyyy ")
    )
    return table(spark, sf, "orders").select("o_orderkey", fn.parse_date_strict(text, "d/M/yyyy").alias("day"))


@register("hour24_to_ts", "SELECT event_id, date_trunc('hour', ts)::TIMESTAMP AS starts FROM events")
def _hour24(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", fn.hour24_to_ts(F.to_date("ts"), F.hour("ts") + 1).alias("starts"))


@register("regex_hour", "SELECT event_id, CAST(hour(ts) + 1 AS BIGINT) AS label_hour FROM events")
def _regex_hour(spark, sf):
    label = F.concat(F.lit("Hora "), (F.hour("ts") + 1).cast("string"))
    return table(spark, sf, "events").select("event_id", fn.regex_hour(label).alias("label_hour"))


@register(
    "local_to_utc",
    "SELECT event_id, timezone('UTC', timezone('America/Santiago', ts)) AS utc FROM events",
)
def _to_utc(spark, sf):
    return table(spark, sf, "events").select("event_id", fn.local_to_utc(F.col("ts")).alias("utc"))


@register(
    "utc_to_local",
    f"""SELECT event_id, local AS local_ts, CAST(hour(local) AS BIGINT) AS hour, CAST(month(local) AS BIGINT) AS month,
               CAST(isodow(local) - 1 AS BIGINT) AS weekday, strftime(local, '%Y-%m-%d') AS day
        FROM (SELECT event_id, {local_sql("ts")} AS local FROM events)""",
)
def _to_local(spark, sf):
    local = fn.utc_to_local(F.col("ts"))
    return table(spark, sf, "events").select(
        "event_id", local.alias("local_ts"), F.hour(local).alias("hour"), F.month(local).alias("month"),
        fn.weekday_of(local).alias("weekday"), F.to_date(local).alias("day"),
    )


@register("normalize_utc", "SELECT event_id, date_trunc('second', ts)::TIMESTAMP AS utc FROM events")
def _normalize(spark, sf):
    # The same instants written with three different offsets, or none.
    base = F.date_trunc("second", "ts")
    shape = "yyyy-MM-dd'T'HH:mm:ss"
    text = (
        F.when(F.col("event_type") == "click", F.date_format(base, shape))
        .when(
            F.col("event_type") == "view",
            F.concat(F.date_format(base - F.expr("INTERVAL 3 HOURS"), shape), F.lit("-03:00")),
        )
        .when(
            F.col("event_type") == "error",
            F.concat(F.date_format(base - F.expr("INTERVAL 4 HOURS"), shape), F.lit("-04:00")),
        )
        .otherwise(F.concat(F.date_format(base, shape), F.lit("Z")))
    )
    return table(spark, sf, "events").select("event_id", fn.normalize_utc(text).alias("utc"))


@register(
    "null_tokens",
    """SELECT status, CAST(count(*) AS BIGINT) AS n FROM (
         SELECT CASE o_orderpriority WHEN '1-URGENT' THEN NULL WHEN '2-HIGH' THEN NULL WHEN '3-MEDIUM' THEN NULL
                WHEN '4-NOT SPECIFIED' THEN NULL ELSE 'NULL' END AS status FROM orders) GROUP BY 1""",
)
def _tokens(spark, sf):
    words = {"1-URGENT": "", "2-HIGH": "NA", "3-MEDIUM": "N/A", "4-NOT SPECIFIED": "null"}
    named = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
    raw = table(spark, sf, "orders").select(F.coalesce(named[F.col("o_orderpriority")], F.lit("NULL")).alias("status"))
    return frames.null_tokens(raw).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@register("normalize_header", "SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS fecha FROM orders")
def _header(spark, sf):
    raw = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    return frames.normalize_header(raw.toDF("\ufeff id ", " Fecha"), date_name="fecha")


@register("require_columns", "SELECT c_custkey, c_acctbal FROM customer")
def _require(spark, sf):
    return frames.require_columns(table(spark, sf, "customer"), ["c_custkey", "c_acctbal"]).select(
        "c_custkey", "c_acctbal"
    )


@register(
    "map_category",
    """SELECT category, CAST(count(*) AS BIGINT) AS n FROM (
         SELECT CASE WHEN l_returnflag = 'A' THEN 'returned' WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'open'
                WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 'done' END AS category FROM lineitem)
       WHERE category IS NOT NULL GROUP BY 1""",
)
def _category(spark, sf):
    mapping = spark.createDataFrame(
        [("A", None, "returned"), ("N", "O", "open"), ("N", "F", "done")],
        "kind string, subkind string, category string",
    )
    items = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus")
    found = frames.map_category(items, mapping, "l_returnflag", "l_linestatus")
    return found.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@register(
    "filter_in_list",
    "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')",
)
def _in_list(spark, sf):
    raw = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit(" "), "o_orderpriority").alias("o_orderpriority"))
    return frames.filter_in_list(raw, "o_orderpriority", ["1-URGENT", "5-LOW"])


@register("filter_year_from", "SELECT o_orderkey, o_orderdate FROM orders WHERE year(o_orderdate) >= 1999")
def _year_from(spark, sf):
    return frames.filter_year_from(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", 1999)


@register(
    "drop_missing", "SELECT c_custkey, c_acctbal AS balance FROM customer WHERE c_acctbal >= 0"
)
def _drop(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", fn.null_if_negative(F.col("c_acctbal")).alias("balance"))
    return frames.drop_missing(c, ["balance"])


@register("null_if_negative", "SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS c_acctbal FROM customer")
def _negative(spark, sf):
    return frames.null_negatives(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"])


@register(
    "null_if_outlier",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag,
              CASE WHEN l_extendedprice > 0.5 * q THEN NULL ELSE l_extendedprice END AS l_extendedprice
       FROM lineitem JOIN (SELECT l_returnflag AS f, quantile_cont(l_extendedprice, 0.999) AS q FROM lineitem GROUP BY 1)
         ON f = l_returnflag""",
)
def _outlier(spark, sf):
    items = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_extendedprice"
    )
    return frames.null_if_outlier(items, ["l_returnflag"], "l_extendedprice", factor=0.5)


@register(
    "zero_at_night",
    f"""SELECT event_id, CASE WHEN hour(local) >= 21 OR hour(local) < 6 THEN 0.0 ELSE value END AS value
        FROM (SELECT event_id, value, {local_sql("ts")} AS local FROM events)""",
)
def _night(spark, sf):
    return table(spark, sf, "events").select("event_id", fn.zero_at_night(F.col("value"), F.col("ts")).alias("value"))


@register(
    "row_sum",
    with_ctes(
        "h",
        body="""SELECT hour, sum(value) FILTER (event_type IN ('click', 'error')) AS strict_sum,
            coalesce(sum(value) FILTER (event_type IN ('click', 'error')), 0.0) AS total
        FROM h GROUP BY hour""",
    ),
    floats={"strict_sum": 4, "total": 4},
)
def _row_sum(spark, sf):
    wide = reshape.pivot_category(hourly(spark, sf), ["hour"], "event_type", "value", list(TECH_OF))
    cols = [F.col("click"), F.col("error")]
    return wide.select("hour", fn.row_sum(cols, 1).alias("strict_sum"), fn.row_sum(cols).alias("total"))


@register(
    "fill_zero",
    with_ctes(
        "h",
        body="""SELECT hour, coalesce(sum(value) FILTER (event_type = 'click'), 0.0) AS click,
            coalesce(sum(value) FILTER (event_type = 'error'), 0.0) AS error FROM h GROUP BY hour""",
    ),
)
def _fill_zero(spark, sf):
    wide = reshape.pivot_category(hourly(spark, sf), ["hour"], "event_type", "value", ["click", "error"])
    return frames.fill_zero(wide, ["click", "error"])


@register(
    "ensure_columns",
    with_ctes("generation", body="SELECT datetime, gen_solar_mw, gen_diesel_mw, gen_total_mw FROM generation"),
    floats={"gen_total_mw": 4},
)
def _ensure(spark, sf):
    return generation(spark, sf).select("datetime", "gen_solar_mw", "gen_diesel_mw", "gen_total_mw")


@register("tag_constant", "SELECT c_custkey, 'Santiago' AS region FROM customer")
def _tag(spark, sf):
    return frames.tag_constant(table(spark, sf, "customer").select("c_custkey"), "region", "Santiago")


@register("rename_proxy", "SELECT p_partkey, p_retailprice AS energy_gwh FROM part")
def _rename(spark, sf):
    return frames.rename_proxy(table(spark, sf, "part").select("p_partkey", "p_retailprice"), "p_retailprice", "energy_gwh")


@register("round_to", "SELECT l_orderkey, l_linenumber, l_partkey, round_even(l_extendedprice / 7.0, 2) AS unit FROM lineitem")
def _round(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", fn.round_to(F.col("l_extendedprice") / 7.0, 2).alias("unit")
    )


WAVES = [f"{p}_{w}" for p in ("hora", "dow", "mes") for w in ("sin", "cos")]


@register(
    "cyclic_encode",
    f"""SELECT event_id, sin(2*pi()*hour(l)/24.0) AS hora_sin, cos(2*pi()*hour(l)/24.0) AS hora_cos,
           sin(2*pi()*(isodow(l)-1)/7.0) AS dow_sin, cos(2*pi()*(isodow(l)-1)/7.0) AS dow_cos,
           sin(2*pi()*(month(l)-1)/12.0) AS mes_sin, cos(2*pi()*(month(l)-1)/12.0) AS mes_cos
        FROM (SELECT event_id, {local_sql("ts")} AS l FROM events)""",
    floats=WAVES,
)
def _cyclic(spark, sf):
    return frames.cyclic_encode(table(spark, sf, "events").select("event_id", "ts"), "ts").drop("ts")


@register("is_weekend", "SELECT o_orderkey, isodow(o_orderdate) >= 6 AS is_weekend FROM orders")
def _weekend(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", fn.is_weekend(F.col("o_orderdate")).alias("is_weekend"))


@register(
    "temporal_features",
    """SELECT event_id, CAST(hour(ts) AS BIGINT) AS hour_of_day, CAST(isodow(ts) - 1 AS BIGINT) AS day_of_week,
              CAST(month(ts) AS BIGINT) AS month FROM events""",
)
def _temporal(spark, sf):
    return frames.temporal_features(table(spark, sf, "events").select("event_id", "ts"), "ts").drop("ts")


@register("month_floor", "SELECT o_orderkey, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month FROM orders")
def _month(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", fn.month_floor(F.col("o_orderdate")).alias("month"))


@register("year_of", "SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS year FROM orders")
def _year(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", fn.year_of(F.col("o_orderdate")).alias("year"))


@register(
    "time_range",
    """SELECT o_orderkey, o_orderdate FROM orders
       WHERE o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1999-12-31'""",
)
def _range(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return frames.time_range(orders, "o_orderdate", "1997-01-01", "1999-12-31")


@register(
    "error_columns",
    with_ctes(
        "p",
        body="""SELECT event_type, hour, model, abs(predicted - actual) AS abs_error, predicted - actual AS error,
            actual IS NOT NULL AND predicted IS NOT NULL AS is_finite,
            coalesce(actual IS NOT NULL AND predicted IS NOT NULL AND actual <> 0, FALSE) AS is_scorable FROM p""",
    ),
    floats=["abs_error", "error"],
)
def _errors(spark, sf):
    found = frames.error_columns(predictions(spark, sf), "actual", "predicted")
    return found.select(
        "event_type", "hour", "model", "abs_error", "error", "is_finite",
        F.coalesce("is_scorable", F.lit(False)).alias("is_scorable"),
    )


HOURS = [f"Hora {h}" for h in range(1, 25)]


@register(
    "unpivot_hours",
    with_ctes(
        "h",
        body="""SELECT event_type, strftime(day, '%Y-%m-%d') AS day, 'Hora ' || hr AS hora_col, value AS mw
        FROM (SELECT event_type, day, unnest(range(1, 25)) AS hr
              FROM (SELECT DISTINCT event_type, date_trunc('day', hour) AS day FROM h)) k
        LEFT JOIN (SELECT event_type AS e, date_trunc('day', hour) AS dd, hour(hour) + 1 AS hh, value FROM h)
          ON e = event_type AND dd = day AND hh = hr""",
    ),
)
def _unpivot(spark, sf):
    return reshape.unpivot_hours(wide_hours(spark, sf), ["event_type", "day"], HOURS)


def wide_hours(spark, sf):
    """One row per type and day with a column per hour."""
    h = hourly(spark, sf).withColumn("label", F.concat(F.lit("Hora "), (F.hour("hour") + 1).cast("string")))
    return reshape.pivot_category(h.withColumn("day", F.to_date("hour")), ["event_type", "day"], "label", "value", HOURS)


@register(
    "pivot_category",
    with_ctes(
        "h",
        body="SELECT hour, "
        + ", ".join(f"sum(value) FILTER (event_type = '{k}') AS {k}" for k in TECH_OF)
        + " FROM h GROUP BY hour",
    ),
)
def _pivot(spark, sf):
    return reshape.pivot_category(hourly(spark, sf), ["hour"], "event_type", "value", list(TECH_OF))


@register(
    "pivot_heatmap",
    """WITH c AS (SELECT o_orderpriority, dayofmonth(o_orderdate) AS dom, month(o_orderdate) AS mon, o_totalprice
                  FROM orders)
       SELECT k.o_orderpriority, k.dom AS dom, """
    + ", ".join(f"avg(o_totalprice) FILTER (mon = {m}) AS m{m}" for m in range(1, 13))
    + """ FROM (SELECT DISTINCT o_orderpriority, CAST(unnest(range(1, 32)) AS BIGINT) AS dom FROM orders) k
       LEFT JOIN c ON c.o_orderpriority = k.o_orderpriority AND c.dom = k.dom GROUP BY 1, 2""",
    floats={f"m{m}": 3 for m in range(1, 13)},
)
def _heatmap(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderpriority", F.dayofmonth("o_orderdate").alias("dom"), F.month("o_orderdate").alias("mon"), "o_totalprice"
    )
    return reshape.pivot_heatmap(o, ["o_orderpriority"], "dom", "mon", "o_totalprice", rows=(1, 31))


@register(
    "explode_arrays",
    with_ctes("weather", body="SELECT region, CAST(date AS VARCHAR) AS time, temp_max_c, precip_mm FROM weather"),
)
def _explode(spark, sf):
    daily = weather(spark, sf).groupBy("region").agg(
        F.sort_array(F.collect_list(F.struct(F.col("date").cast("string").alias("time"), "temp_max_c", "precip_mm"))).alias("d")
    )
    arrays = daily.select("region", F.col("d.time"), F.col("d.temp_max_c"), F.col("d.precip_mm"))
    return reshape.explode_arrays(arrays, ["time", "temp_max_c", "precip_mm"], keep=["region"])
