"""Gap filling, regular grids and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.base import register, table
from tidemark.catalog.stand_ins import (
    KEY,
    generation,
    grid,
    holidays,
    hourly,
    local_sql,
    prices,
    reservoirs,
    weather,
    with_ctes,
)
from tidemark.operators import gaps, joins, selection
from tidemark.operators.calendar import national_holidays
from tidemark.plans.cleaning import clean_generation
from tidemark.plans.features import FEATURES, build_feature_matrix
from tidemark.session import scratch_path
from tidemark.sinks.tables import materialize_features, read_table
from tidemark.sources.schemas import GENERATION_COLUMNS, TECH_COLUMNS

NEAR_SQL = """SELECT *, row_number() OVER w AS p,
    last_value(value IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pv,
    last_value(CASE WHEN value IS NOT NULL THEN rn END IGNORE NULLS)
      OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pp,
    first_value(value IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv,
    first_value(CASE WHEN value IS NOT NULL THEN rn END IGNORE NULLS)
      OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS np
  FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY hour) AS rn FROM {source})
  WINDOW w AS (PARTITION BY event_type ORDER BY hour)"""
LINE = "pv + (nv - pv) * (p - pp) / (np - pp)"


@register(
    "regularize_hourly", with_ctes("g", body="SELECT event_type, hour, value FROM g")
)
def _regular(spark, sf):
    return grid(spark, sf)


@register("ffill", with_ctes("g", body=f"SELECT event_type, hour, pv AS value FROM ({NEAR_SQL.format(source='g')})"))
def _ffill(spark, sf):
    return gaps.ffill(grid(spark, sf), KEY, "hour", ["value"])


@register("bfill", with_ctes("g", body=f"SELECT event_type, hour, nv AS value FROM ({NEAR_SQL.format(source='g')})"))
def _bfill(spark, sf):
    return gaps.bfill(grid(spark, sf), KEY, "hour", ["value"])


@register(
    "interpolate_limited",
    with_ctes(
        "g",
        body=f"""SELECT event_type, hour, CASE WHEN value IS NOT NULL THEN value WHEN p - pp <= 3 THEN
             CASE WHEN nv IS NULL THEN pv ELSE {LINE} END END AS value FROM ({NEAR_SQL.format(source='g')})""",
    ),
    floats=["value"],
)
def _interpolate(spark, sf):
    return gaps.interpolate_limited(grid(spark, sf), KEY, "hour", ["value"])


SPARSE = "(SELECT event_type, hour, CASE WHEN value >= 400 THEN value END AS value FROM g)"


@register(
    "interpolate_limited_long_gaps",
    with_ctes(
        "g",
        body=f"""SELECT event_type, hour, CASE WHEN value IS NOT NULL THEN value WHEN p - pp <= 3 THEN
             CASE WHEN nv IS NULL THEN pv ELSE {LINE} END END AS value FROM ({NEAR_SQL.format(source=SPARSE)})""",
    ),
    floats=["value"],
)
def _interpolate_long(spark, sf):
    sparse = grid(spark, sf).withColumn("value", F.when(F.col("value") >= 400, F.col("value")))
    return gaps.interpolate_limited(sparse, KEY, "hour", ["value"])


@register(
    "interpolate_all",
    with_ctes(
        "g",
        body=f"""SELECT event_type, hour, coalesce(value, CASE WHEN nv IS NOT NULL AND pv IS NOT NULL THEN {LINE} END,
             pv, nv) AS value FROM ({NEAR_SQL.format(source=SPARSE)})""",
    ),
    floats=["value"],
)
def _interpolate_all(spark, sf):
    sparse = grid(spark, sf).withColumn("value", F.when(F.col("value") >= 400, F.col("value")))
    return gaps.interpolate_all(sparse, KEY, "hour", ["value"])


GEN_LIST = ", ".join(GENERATION_COLUMNS)


@register(
    "join_price_generation",
    with_ctes("prices", "generation", body=f"SELECT datetime, barra, cmg_usd_mwh, {GEN_LIST} FROM prices JOIN generation USING (datetime)"),
    floats={"gen_total_mw": 4},
)
def _price_generation(spark, sf):
    joined = joins.join_price_generation(prices(spark, sf).drop("is_imputed"), generation(spark, sf))
    return joins.require_rows(joined, "price and generation join")


@register(
    "join_drivers",
    with_ctes(
        "prices", "generation",
        body="""SELECT datetime, barra, cmg_usd_mwh, gen_solar_mw, gen_gas_mw FROM prices JOIN generation USING (datetime)""",
    ),
)
def _drivers(spark, sf):
    return joins.join_drivers(
        prices(spark, sf).drop("is_imputed"), generation(spark, sf).select("datetime", "gen_solar_mw", "gen_gas_mw")
    )


DEMAND_SQL = "(SELECT hour AS datetime, sum(value) AS demand_mw FROM h WHERE event_type = 'view' GROUP BY 1)"


def demand(spark, sf):
    return hourly(spark, sf).where(F.col("event_type") == "view").select(
        F.col("hour").alias("datetime"), F.col("value").alias("demand_mw")
    )


def _feature_store(spark, sf):
    return joins.join_feature_store(
        prices(spark, sf), generation(spark, sf), demand(spark, sf), reservoirs(spark, sf), weather(spark, sf),
        region="signup",
    )


STORE_SQL = with_ctes(
    "prices", "generation", "reservoirs", "weather",
    body=f"""SELECT a.datetime, a.l AS datetime_local, CAST(CAST(a.l AS DATE) AS VARCHAR) AS date_local, a.barra,
        a.cmg_usd_mwh, a.is_imputed AS cmg_is_imputed, {", ".join("g." + c for c in GENERATION_COLUMNS)}, d.demand_mw,
        r.energy_gwh AS reservoir_gwh, w.temp_max_c, w.precip_mm
    FROM (SELECT *, {local_sql("datetime")} AS l FROM prices) a
    LEFT JOIN generation g ON g.datetime = a.datetime
    LEFT JOIN {DEMAND_SQL} d ON d.datetime = a.datetime
    LEFT JOIN reservoirs r ON r.date = CAST(a.l AS DATE)
    LEFT JOIN weather w ON w.date = CAST(a.l AS DATE) AND w.region = 'signup'""",
)
register("join_feature_store", STORE_SQL, floats={"gen_total_mw": 4})(_feature_store)


@register("materialize_features", STORE_SQL, floats={"gen_total_mw": 4})
def _materialize(spark, sf):
    path = scratch_path(spark, "feature-store")
    wide = _feature_store(spark, sf)
    materialize_features(wide, path)
    materialize_features(wide, path)  # a refresh replaces the same months
    return read_table(spark, path, wide.schema).drop("month")


@register(
    "join_eda",
    with_ctes(
        "prices", "generation", "weather",
        body="""SELECT p.datetime, p.barra, p.cmg_usd_mwh, g.gen_solar_mw, g.gen_gas_mw, w.temp_max_c FROM prices p
        LEFT JOIN generation g ON g.datetime = p.datetime
        LEFT JOIN weather w ON w.date = CAST(p.datetime AS DATE) AND w.region = 'view'""",
    ),
)
def _eda(spark, sf):
    return joins.join_eda(
        prices(spark, sf).drop("is_imputed"), generation(spark, sf).select("datetime", "gen_solar_mw", "gen_gas_mw"),
        weather(spark, sf), "view",
    )


ASOF_SQL = """SELECT h.event_type, h.hour, h.value, w.temp_max_c, w.precip_mm FROM h
    ASOF LEFT JOIN (SELECT region, CAST(CAST(date AS DATE) - CAST(CASE WHEN isodow(date) IN (2, 3, 4) THEN isodow(date) - 2
                        ELSE (isodow(date) + 2) % 7 END AS INTEGER) AS TIMESTAMP) AS at,
                        max(temp_max_c) AS temp_max_c, max(precip_mm) AS precip_mm FROM weather GROUP BY 1, 2) w
      ON h.event_type = w.region AND h.hour >= w.at"""


def _sparse_weather(spark, sf):
    """Highest values of the days from each Tuesday and each Friday on, so that hours lie between slow rows."""
    back = F.when(F.weekday("date").between(1, 3), F.weekday("date") - 1).otherwise((F.weekday("date") + 3) % 7)
    half = F.date_sub("date", back).alias("date")
    highest = weather(spark, sf).groupBy(F.col("region").alias("event_type"), half)
    return highest.agg(F.max("temp_max_c").alias("temp_max_c"), F.max("precip_mm").alias("precip_mm"))


@register("asof_ffill", with_ctes("h", "weather", body=ASOF_SQL))
def _asof(spark, sf):
    return joins.asof_ffill(
        hourly(spark, sf), _sparse_weather(spark, sf), KEY, "hour", "date", ["temp_max_c", "precip_mm"]
    )


@register(
    "asof_ffill_bfill",
    with_ctes(
        "h", "weather",
        body=f"""SELECT event_type, hour, value,
            first_value(temp_max_c IGNORE NULLS) OVER w AS temp_max_c, first_value(precip_mm IGNORE NULLS) OVER w AS precip_mm
        FROM ({ASOF_SQL}) WINDOW w AS (PARTITION BY event_type ORDER BY hour
            ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
    ),
)
def _asof_bfill(spark, sf):
    return joins.asof_ffill(
        hourly(spark, sf), _sparse_weather(spark, sf), KEY, "hour", "date", ["temp_max_c", "precip_mm"], True, KEY
    )


@register(
    "lookup_holiday",
    with_ctes("holidays", body="SELECT event_id, CAST(ts AS DATE) IN (SELECT date FROM holidays) AS is_holiday FROM events"),
)
def _holiday(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.to_date("ts").alias("day"))
    return joins.lookup_holiday(e, "day", holidays(spark, sf)).drop("day")


CALENDAR_SQL = """WITH y AS (SELECT unnest(range(2005, 2031)) AS y),
  p AS (SELECT y, (19 * (y % 19) + y // 100 - y // 400 - (y // 100 - (y // 100 + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM y),
  q AS (SELECT y, h, (32 + 2 * ((y // 100) % 4) + 2 * ((y % 100) // 4) - h - (y % 100) % 4) % 7 AS l FROM p),
  r AS (SELECT y, h + l - 7 * ((y % 19 + 11 * h + 22 * l) // 451) + 114 AS t, (y - 2000) / 1000.0::DOUBLE AS k FROM q),
  s AS (SELECT y, make_date(y, t // 31, t % 31 + 1) AS easter, DATE '2000-01-01' + CAST(floor(
          2451716.56767::DOUBLE + k * 365241.62603::DOUBLE + k * k * 0.00325::DOUBLE - 2451544.5::DOUBLE - 4 / 24::DOUBLE) AS INTEGER) AS solstice FROM r),
  d AS (
    SELECT make_date(y, m, n) AS d FROM y, (VALUES (1, 1), (5, 1), (5, 21), (7, 16), (8, 15), (9, 18), (9, 19), (11, 1), (12, 8), (12, 25)) f(m, n)
    UNION SELECT easter - 2 FROM s UNION SELECT easter - 1 FROM s UNION SELECT CASE WHEN y = 2021 THEN DATE '2021-06-21' ELSE solstice END FROM s WHERE y >= 2021
    UNION SELECT CASE WHEN isodow(x) BETWEEN 2 AND 4 THEN x - CAST(isodow(x) - 1 AS INTEGER) WHEN isodow(x) = 5 THEN x + 3 ELSE x END
      FROM (SELECT make_date(y, 6, 29) AS x FROM y UNION ALL SELECT make_date(y, 10, 12) FROM y)
    UNION SELECT CASE isodow(x) WHEN 2 THEN x - 4 WHEN 3 THEN x + 2 ELSE x END FROM (SELECT make_date(y, 10, 31) AS x FROM y WHERE y >= 2008)
    UNION SELECT x - 1 FROM (SELECT y, make_date(y, 9, 18) AS x FROM y) WHERE isodow(x) = 2 AND y >= 2007 OR isodow(x) = 6 AND y >= 2017
    UNION SELECT x + 2 FROM (SELECT y, make_date(y, 9, 18) AS x FROM y) WHERE isodow(x) = 3 AND y >= 2007
    UNION SELECT x + 1 FROM (SELECT y, make_date(y, 1, 1) AS x FROM y) WHERE isodow(x) = 7 AND y >= 2017)
SELECT o_orderkey, CAST(o_orderdate + INTERVAL 20 YEAR AS DATE) IN (SELECT d FROM d) AS is_holiday FROM orders"""


@register("holiday_calendar", CALENDAR_SQL)
def _calendar(spark, sf):
    # Orders moved on by twenty years, into those of the rules.
    o = table(spark, sf, "orders").select("o_orderkey", F.add_months(F.to_date("o_orderdate"), 240).alias("day"))
    return joins.lookup_holiday(o, "day", national_holidays(spark, 2005, 2030)).drop("day")


@register(
    "anti_existing",
    """SELECT o_custkey, o_orderkey FROM orders o WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND NOT EXISTS (
         SELECT 1 FROM orders t WHERE t.o_custkey = o.o_custkey AND t.o_orderdate < TIMESTAMP '1998-01-01')""",
)
def _anti(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    cut = F.lit("1998-01-01").cast("timestamp")
    found = joins.anti_existing(o.where(F.col("o_orderdate") >= cut), o.where(F.col("o_orderdate") < cut), ["o_custkey"])
    return found.select("o_custkey", "o_orderkey")


@register(
    "reindex_domain",
    """SELECT k.o_custkey, k.mon, n FROM
         (SELECT o_custkey, CAST(unnest(range(1, 13)) AS BIGINT) AS mon FROM (SELECT DISTINCT o_custkey FROM orders)) k
       LEFT JOIN (SELECT o_custkey, month(o_orderdate) AS mon, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1, 2) c
         ON c.o_custkey = k.o_custkey AND c.mon = k.mon""",
)
def _reindex(spark, sf):
    o = table(spark, sf, "orders")
    counts = o.groupBy("o_custkey", F.month("o_orderdate").alias("mon")).agg(F.count(F.lit(1)).alias("n"))
    return joins.reindex_domain(counts, ["o_custkey"], "mon", 1, 12)


@register(
    "align_actuals",
    with_ctes(
        "h",
        body="""SELECT a.event_type, a.hour + INTERVAL 24 HOUR AS hour, a.value AS predicted, b.value AS actual
        FROM h a LEFT JOIN h b ON b.event_type = a.event_type AND b.hour = a.hour + INTERVAL 24 HOUR""",
    ),
)
def _align(spark, sf):
    h = hourly(spark, sf)
    forecast = h.select(
        "event_type", (F.col("hour") + F.expr("INTERVAL 24 HOURS")).alias("hour"), F.col("value").alias("predicted")
    )
    return joins.align_actuals(forecast, h.withColumnRenamed("value", "actual"), ["event_type", "hour"])


@register(
    "union_files",
    """SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01'
       UNION ALL SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'""",
)
def _union(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return selection.union_files(
        o.where(F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp")),
        o.where(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp")).select("o_orderdate", "o_orderkey"),
    )


# Generation with holes: a technology's value is missing where it is small, and negative where large.
_HOLES = {c: f"CASE WHEN {c} < 200 THEN NULL WHEN {c} > 900 THEN -{c} ELSE {c} END" for c in TECH_COLUMNS}


def _clean_generation_sql() -> str:
    steps = []
    for c in TECH_COLUMNS:
        held = f"CASE WHEN {c} < 200 OR {c} > 900 THEN NULL ELSE {c} END"
        if c == "gen_solar_mw":
            local = local_sql("datetime")
            held = f"CASE WHEN hour({local}) >= 21 OR hour({local}) < 6 THEN 0.0 ELSE {held} END"
        steps.append(f"{held} AS {c}")
    filled = []
    for c in TECH_COLUMNS:
        last = "last_value({} IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        nxt = "first_value({} IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
        place = f"CASE WHEN {c} IS NOT NULL THEN rn END"
        pv, pp, nv, np = last.format(c), last.format(place), nxt.format(c), nxt.format(place)
        filled.append(
            f"CASE WHEN {c} IS NOT NULL THEN {c} WHEN rn - {pp} <= 3 THEN CASE WHEN {nv} IS NULL THEN {pv} "
            f"ELSE {pv} + ({nv} - {pv}) * (rn - {pp}) / ({np} - {pp}) END END AS {c}"
        )
    present = " OR ".join(f"{c} IS NOT NULL" for c in TECH_COLUMNS)
    total = " + ".join(f"coalesce({c}, 0)" for c in TECH_COLUMNS)
    return with_ctes(
        "generation",
        body=f"""SELECT datetime, {", ".join(TECH_COLUMNS)}, CASE WHEN {present} THEN {total} END AS gen_total_mw FROM (
          SELECT datetime, {", ".join(filled)} FROM (
            SELECT *, row_number() OVER (ORDER BY datetime) AS rn FROM (
              SELECT datetime, {", ".join(steps)} FROM generation))
          WINDOW w AS (ORDER BY datetime))""",
    )


@register("clean_generation", _clean_generation_sql(), floats={c: 4 for c in GENERATION_COLUMNS})
def _clean_generation(spark, sf):
    raw = generation(spark, sf).withColumns({c: F.expr(e) for c, e in _HOLES.items()})
    return clean_generation(raw.withColumn("series", F.lit("all")), ["series"]).select("datetime", *GENERATION_COLUMNS)


def matrix_sql() -> str:
    lag = ", ".join(f"lag(cmg_usd_mwh, {h}) OVER w AS lag_cmg_usd_mwh_{h}h" for h in (1, 2, 3, 6, 12, 24, 168))
    roll = ", ".join(
        f"{fn}(cmg_usd_mwh) OVER (PARTITION BY barra ORDER BY datetime ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
        f" AS rolling_{stat}_cmg_usd_mwh_{n}h"
        for n in (24, 168)
        for stat, fn in (("mean", "avg"), ("std", "stddev_samp"))
    )
    return with_ctes(
        "prices", "generation", "reservoirs", "weather", "holidays",
        body=f"""SELECT barra, datetime, cmg_usd_mwh, is_imputed, {", ".join(FEATURES)} FROM (
          SELECT *, {lag}, {roll},
            sin(2*pi()*hour(l)/24.0) AS hora_sin, cos(2*pi()*hour(l)/24.0) AS hora_cos,
            sin(2*pi()*(isodow(l)-1)/7.0) AS dow_sin, cos(2*pi()*(isodow(l)-1)/7.0) AS dow_cos,
            sin(2*pi()*(month(l)-1)/12.0) AS mes_sin, cos(2*pi()*(month(l)-1)/12.0) AS mes_cos,
            isodow(l) >= 6 AS is_weekend, CAST(l AS DATE) IN (SELECT date FROM holidays) AS is_holiday
          FROM (SELECT * REPLACE (
                  first_value(energy_gwh IGNORE NULLS) OVER f AS energy_gwh,
                  first_value(temp_max_c IGNORE NULLS) OVER f AS temp_max_c), {local_sql("datetime")} AS l
                FROM (SELECT j.*, r.energy_gwh, w.temp_max_c
                      FROM (SELECT * FROM prices JOIN generation USING (datetime)) j
                      ASOF LEFT JOIN (SELECT CAST(date AS TIMESTAMP) AS at, energy_gwh FROM reservoirs) r
                        ON j.datetime >= r.at
                      ASOF LEFT JOIN (SELECT CAST(date AS TIMESTAMP) AS at, temp_max_c FROM weather WHERE region = 'signup') w
                        ON j.datetime >= w.at)
                WINDOW f AS (PARTITION BY barra ORDER BY datetime ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
          WHERE datetime BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2025-01-01'
          WINDOW w AS (PARTITION BY barra ORDER BY datetime))""",
    )


@register(
    "build_feature_matrix",
    matrix_sql(),
    floats={c: 6 for c in FEATURES if c.startswith(("rolling", "hora", "dow", "mes"))} | {"gen_total_mw": 4},
)
def feature_matrix(spark, sf):
    sky = weather(spark, sf).where(F.col("region") == "signup")
    return build_feature_matrix(
        prices(spark, sf), generation(spark, sf), reservoirs(spark, sf), sky, holidays(spark, sf),
        "2024-01-01", "2024-12-31", holiday_years=(2023, 2024),
    )
