"""Readers and writers, over files written from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.catalog.base import register, table
from tidemark.catalog.evaluation import stored_predictions
from tidemark.catalog.gaps_and_joins import STORE_SQL, demand
from tidemark.catalog.scalars import HOURS, wide_hours
from tidemark.catalog.stand_ins import generation, hourly, prices, reservoirs, weather, with_ctes
from tidemark.operators.selection import union_files
from tidemark.plans.jobs import LoadConfig, backfill, incremental_load, refresh_features
from tidemark.session import prepare, scratch_path
from tidemark.sinks.tables import insert_if_absent, load_table, read_table
from tidemark.sources.delimited import outcomes
from tidemark.sources.files import (
    generation_lines,
    hourly_generation,
    read_generation_tsv,
    read_price_tsv,
    read_reservoir_csv,
    read_weather_json,
    scan_files,
    scan_glob,
    text_schema,
)
from tidemark.sources.schemas import KEYS, PREDICTIONS, PRICES, TABLES
from tidemark.streaming.arrivals import stream_prices

# How event types and order priorities are spelled in the raw files.
PLANTS = {
    "click": ("Solar", "Fotovoltaica"),
    "error": ("Eólicas", "Eólica"),
    "purchase": ("Hidroeléctricas", "Embalse"),
    "signup": ("Termoeléctricas", "Gas Natural"),
    "view": ("Termoeléctricas", "Otras"),
}
LAKES = {"1-URGENT": "Colbún", "2-HIGH": "Laja", "3-MEDIUM": "Maule", "4-NOT SPECIFIED": "Otro lago", "5-LOW": "Rapel"}


def _named(pairs: dict, column: str):
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])[F.col(column)]


def _comma(c):
    return F.replace(c.cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(","))


def write_price_files(spark: SparkSession, sf: str) -> str:
    """Hourly prices as tab-separated files with 1-24 hour labels; returns the folder."""
    path = scratch_path(spark, "price-files")
    h = hourly(spark, sf)
    rows = h.select(
        F.col("event_type").alias("barra_mnemotecnico"), F.lit("REF").alias("barra_referencia_mnemotecnico"),
        F.date_format("hour", "yyyy-MM-dd").alias("fecha"), (F.hour("hour") + 1).cast("string").alias("hora"),
        _comma(F.col("value")).alias("costo_en_dolares"), F.lit("0").alias("costo_en_pesos"), F.lit("bus").alias("nombre"),
    )
    rows.write.options(sep="\t", header="true").csv(path)
    return path


def write_generation_files(spark: SparkSession, sf: str) -> str:
    path = scratch_path(spark, "generation-files")
    wide = wide_hours(spark, sf)
    kinds = {k: v[0] for k, v in PLANTS.items()}
    subkinds = {k: v[1] for k, v in PLANTS.items()}
    rows = wide.select(
        _named(kinds, "event_type").alias("Tipo"), _named(subkinds, "event_type").alias("Subtipo"),
        F.date_format("day", "yyyy-MM-dd").alias("Fecha"), *[_comma(F.col(c)).alias(c) for c in HOURS],
    )
    rows.write.options(sep="\t", header="true").csv(path)
    return path


def write_generation_layouts(spark: SparkSession, sf: str) -> str:
    """The same lines in three folders: columns in their usual order, in reverse with one more, and without the last hour.

    The day of the month says which; on every fifth day the lines of signups have no usable date.
    """
    path = scratch_path(spark, "generation-layouts")
    day = F.dayofmonth("day")
    broken = (F.col("event_type") == "signup") & (day % 5 == 0)
    rows = wide_hours(spark, sf).select(
        (day % 3).alias("layout"),
        _named({k: v[0] for k, v in PLANTS.items()}, "event_type").alias("Tipo"),
        _named({k: v[1] for k, v in PLANTS.items()}, "event_type").alias("Subtipo"),
        F.when(broken, "2024-13-45").otherwise(F.date_format("day", "yyyy-MM-dd")).alias("Fecha"),
        *[_comma(F.col(c)).alias(c) for c in HOURS],
    )
    names = rows.columns[1:]
    orders = {0: names, 1: ["Nota", *names[::-1]], 2: names[:-1]}
    for layout, order in orders.items():
        part = rows.where(F.col("layout") == layout).withColumn("Nota", F.lit("x")).select(*order)
        part.write.options(sep="\t", header="true").csv(f"{path}/layout={layout}")
    return f"{path}/*/*.csv"


def write_reservoir_files(spark: SparkSession, sf: str) -> str:
    path = scratch_path(spark, "reservoir-files")
    rows = table(spark, sf, "orders").select(
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("Fecha"), _named(LAKES, "o_orderpriority").alias("central"),
        _comma(F.col("o_totalprice")).alias("cota_msnm"),
    )
    rows.write.options(sep=";", header="true", encoding="ISO-8859-1").csv(path)
    return path


def write_weather_files(spark: SparkSession, sf: str) -> str:
    """One payload document per region, named after it."""
    path = scratch_path(spark, "weather-files")
    days = weather(spark, sf).groupBy("region").agg(
        F.sort_array(F.collect_list(F.struct(F.col("date").cast("string").alias("d"), "temp_max_c", "precip_mm"))).alias("x")
    )
    daily = F.struct(
        F.col("x.d").alias("time"), F.col("x.temp_max_c").alias("temperature_2m_max"),
        F.col("x.precip_mm").alias("precipitation_sum"),
    )
    text = F.to_json(F.struct(daily.alias("daily")), {"ignoreNullFields": "false"})
    days.select("region", text.alias("value")).repartition("region").write.partitionBy("region").text(path)
    return path


@register(
    "read_price_tsv",
    with_ctes("h", body="SELECT hour + INTERVAL 3 HOUR AS datetime, event_type AS barra, value AS cmg_usd_mwh FROM h"),
)
def _read_prices(spark, sf):
    return read_price_tsv(spark, write_price_files(spark, sf), barra=None)


GENERATION_FILE_SQL = """SELECT hour + INTERVAL 3 HOUR AS datetime,
    coalesce(sum(value) FILTER (event_type = 'click'), 0.0) AS gen_solar_mw,
    coalesce(sum(value) FILTER (event_type = 'error'), 0.0) AS gen_wind_mw,
    coalesce(sum(value) FILTER (event_type = 'purchase'), 0.0) AS gen_hydro_reservoir_mw,
    0.0 AS gen_hydro_runofriver_mw, coalesce(sum(value) FILTER (event_type = 'signup'), 0.0) AS gen_gas_mw,
    0.0 AS gen_coal_mw, 0.0 AS gen_diesel_mw, sum(value) AS gen_total_mw
  FROM h WHERE event_type <> 'view' GROUP BY 1"""


@register(
    "read_generation_tsv",
    with_ctes(
        "h",
        body=f"SELECT * REPLACE (CAST(gen_hydro_runofriver_mw AS DOUBLE) AS gen_hydro_runofriver_mw, "
        f"CAST(gen_coal_mw AS DOUBLE) AS gen_coal_mw, CAST(gen_diesel_mw AS DOUBLE) AS gen_diesel_mw) "
        f"FROM ({GENERATION_FILE_SQL})",
    ),
    floats={"gen_total_mw": 4},
)
def _read_generation(spark, sf):
    return read_generation_tsv(spark, write_generation_files(spark, sf))


LINES_SQL = """lines AS (SELECT event_type, CAST(hour AS DATE) AS day, day(hour) % 3 AS layout,
    event_type = 'signup' AND day(hour) % 5 = 0 AS bad FROM h GROUP BY ALL)"""


@register(
    "read_generation_by_header",
    with_ctes(
        "h",
        body=f", {LINES_SQL}, kept AS (SELECT h.* FROM h JOIN lines ON lines.event_type = h.event_type"
        " AND lines.day = CAST(hour AS DATE) WHERE layout <> 2 AND NOT bad)"
        f" SELECT * REPLACE (CAST(gen_hydro_runofriver_mw AS DOUBLE) AS gen_hydro_runofriver_mw, CAST(gen_coal_mw AS DOUBLE) AS gen_coal_mw,"
        f" CAST(gen_diesel_mw AS DOUBLE) AS gen_diesel_mw) FROM ({GENERATION_FILE_SQL.replace('FROM h', 'FROM kept')})",
    ),
    floats={"gen_total_mw": 4},
)
def _generation_by_header(spark, sf):
    lines, _ = generation_lines(spark, write_generation_layouts(spark, sf))
    return hourly_generation(lines)


@register(
    "generation_file_outcomes",
    with_ctes(
        "h",
        body=f""", {LINES_SQL}, good AS (SELECT *, event_type = 'view' AS outside FROM lines WHERE layout <> 2)
        SELECT layout, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (NOT bad AND NOT outside) AS BIGINT) AS used,
          CAST(count(*) FILTER (NOT bad AND outside) AS BIGINT) AS other, CAST(count(*) FILTER (bad) AS BIGINT) AS rejected,
          CAST(NULL AS VARCHAR) AS error FROM good GROUP BY layout
        UNION ALL SELECT 2, 0, 0, 0, 0, 'missing columns Hora 24'""",
    ),
)
def _generation_outcomes(spark, sf):
    lines, files = generation_lines(spark, write_generation_layouts(spark, sf))
    found = outcomes(lines, files).withColumn("layout", F.regexp_extract("file", "layout=([0-9])", 1).cast("long"))
    sums = [F.sum(c).alias(c) for c in ("n_lines", "used", "other", "rejected")]
    return found.groupBy("layout").agg(*sums, F.max("error").alias("error"))


RESERVOIR_SQL = """SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS date, avg(o_totalprice) AS avg_cota_msnm,
    CAST(count(DISTINCT o_orderpriority) AS BIGINT) AS n_embalses
  FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderpriority <> '4-NOT SPECIFIED' GROUP BY 1"""


@register("read_reservoir_csv", RESERVOIR_SQL, floats={"avg_cota_msnm": 2})
def _read_reservoirs(spark, sf):
    return read_reservoir_csv(spark, write_reservoir_files(spark, sf), from_year=1996)


@register(
    "read_weather_json",
    with_ctes("weather", body="SELECT CAST(date AS VARCHAR) AS date, temp_max_c, precip_mm, region FROM weather"),
)
def _read_weather(spark, sf):
    # The folder of each file names its region.
    path = write_weather_files(spark, sf)
    return read_weather_json(spark, f"{path}/*/*", region=r"region=([^/]+)")


@register(
    "scan_glob",
    """SELECT o_orderstatus = 'P' AS broken, CAST(count(*) AS BIGINT) AS n, CAST(sum(o_custkey) AS BIGINT) AS keys
       FROM orders GROUP BY 1""",
)
def _scan_glob(spark, sf):
    # Rows of pending orders are cut short, so they do not fit the schema.
    path = scratch_path(spark, "mixed-files")
    line = F.when(F.col("o_orderstatus") == "P", F.col("o_custkey").cast("string")).otherwise(
        F.concat_ws("\t", "o_custkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd"))
    )
    table(spark, sf, "orders").select(line.alias("value")).write.text(path)
    good, bad = scan_glob(spark, f"{path}/part-*", text_schema(["key", "status", "day"]), sep="\t", header="false")
    both = union_files(
        good.select("key", F.lit(False).alias("broken")), bad.select("key", F.lit(True).alias("broken"))
    )
    return both.groupBy("broken").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("key").cast("long")).alias("keys"))


@register(
    "scan_files",
    """SELECT CAST(sum(n) AS BIGINT) AS n_lines, CAST(sum(n) FILTER (s <> 'P') AS BIGINT) AS used, 0 AS other,
              CAST(sum(n) FILTER (s = 'P') AS BIGINT) AS rejected, 0 AS n_errors
       FROM (SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1)""",
)
def _scan_files(spark, sf):
    path = scratch_path(spark, "mixed-files")
    line = F.when(F.col("o_orderstatus") == "P", F.col("o_custkey").cast("string")).otherwise(
        F.concat_ws("\t", "o_custkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd"))
    )
    table(spark, sf, "orders").select(line.alias("value")).write.text(path)
    _, _, became = scan_files(spark, f"{path}/part-*", text_schema(["key", "status", "day"]), sep="\t", header="false")
    sums = [F.sum(c).alias(c) for c in ("n_lines", "used", "other", "rejected")]
    return became.agg(*sums, F.count("error").alias("n_errors"))


def _insert_twice(spark: SparkSession, sf: str) -> tuple[str, T.StructType, list[dict[str, int]]]:
    """Two overlapping slices of orders; the second offers other prices for known keys."""
    o = table(spark, sf, "orders").select("o_orderdate", "o_custkey", "o_orderkey", "o_totalprice")
    schema = T.StructType([o.schema[c] for c in ("o_orderdate", "o_custkey", "o_totalprice")])
    path = scratch_path(spark, "orders")
    first = o.where(F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp"))
    second = o.where(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp")).withColumn(
        "o_totalprice", F.col("o_totalprice") + 1
    )
    counts = [
        insert_if_absent(spark, part, path, ["o_orderdate", "o_custkey"], ["o_orderkey"], schema)
        for part in (first, second, second)
    ]
    return path, schema, counts


INSERT_SQL = """SELECT o_orderdate, o_custkey,
      CASE WHEN o_orderdate < TIMESTAMP '1999-01-01' THEN o_totalprice ELSE o_totalprice + 1 END AS o_totalprice
    FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderdate, o_custkey ORDER BY o_orderkey) = 1"""


@register("insert_if_absent", INSERT_SQL, floats={"o_totalprice": 4})
def _insert(spark, sf):
    prepare(spark)
    path, schema, _ = _insert_twice(spark, sf)
    return read_table(spark, path, schema).drop("month")


def _count_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


@register(
    "insert_summary",
    """WITH k AS (SELECT o_orderdate, o_custkey, count(*) AS n FROM orders GROUP BY 1, 2)
       SELECT CAST(1 AS BIGINT) AS load, CAST(sum(n) AS BIGINT) AS attempted, CAST(count(*) AS BIGINT) AS inserted,
              CAST(sum(n) - count(*) AS BIGINT) AS ignored FROM k WHERE o_orderdate < TIMESTAMP '1999-01-01'
       UNION ALL SELECT 2, CAST(sum(n) AS BIGINT), CAST(count(*) FILTER (o_orderdate >= TIMESTAMP '1999-01-01') AS BIGINT),
              CAST(sum(n) - count(*) FILTER (o_orderdate >= TIMESTAMP '1999-01-01') AS BIGINT)
         FROM k WHERE o_orderdate >= TIMESTAMP '1998-01-01'
       UNION ALL SELECT 3, CAST(sum(n) AS BIGINT), 0, CAST(sum(n) AS BIGINT)
         FROM k WHERE o_orderdate >= TIMESTAMP '1998-01-01'""",
)
def _insert_summary(spark, sf):
    _, _, counts = _insert_twice(spark, sf)
    rows = [(i, c["attempted"], c["inserted"], c["ignored"]) for i, c in enumerate(counts, start=1)]
    return _count_frame(spark, rows, "load long, attempted long, inserted long, ignored long")


@register(
    "write_predictions",
    with_ctes(
        "p",
        body="""SELECT hour AS datetime, event_type AS barra, model AS model_name, '1.0' AS model_version,
            predicted AS predicted_cmg, actual AS actual_cmg, CAST(1 AS BIGINT) AS horizon_h
        FROM p WHERE predicted IS NOT NULL""",
    ),
)
def _write_predictions(spark, sf):
    root = scratch_path(spark, "tables")
    rows = stored_predictions(spark, sf)
    for _ in range(2):
        load_table(spark, rows, root, "predictions")
    return read_table(spark, f"{root}/predictions", PREDICTIONS).drop("month")


def _config(spark: SparkSession, sf: str, root: str) -> LoadConfig:
    return LoadConfig(
        root=root,
        prices=write_price_files(spark, sf),
        generation=write_generation_files(spark, sf),
        reservoirs=write_reservoir_files(spark, sf),
        weather=f"{write_weather_files(spark, sf)}/*/*",
        barra=None,
        region=r"region=([^/]+)",
        reservoir_from_year=1996,
    )


def _stored(spark: SparkSession, root: str, inserted: dict[str, int]) -> DataFrame:
    """Rows per table as reported by the load and as found on disk."""
    names = {
        "cmg": "marginal_costs", "generation": "generation_by_tech", "reservoirs": "reservoir_levels", "weather": "weather",
    }
    parts = []
    for step, name in names.items():
        stored = read_table(spark, f"{root}/{name}", TABLES[name])
        parts.append(
            stored.groupBy().agg(F.count(F.lit(1)).alias("n_stored"), F.count_distinct(*KEYS[name]).alias("n_keys"))
            .select(F.lit(step).alias("step"), F.lit(inserted[step]).cast("long").alias("n_inserted"), "n_stored", "n_keys")
        )
    return union_files(*parts)


_BACKFILL_SQL = with_ctes(
    "h", "weather",
    body=f"""SELECT step, n AS n_inserted, n AS n_stored, n AS n_keys FROM (
      SELECT 'cmg' AS step, CAST(count(*) AS BIGINT) AS n FROM h
      UNION ALL SELECT 'generation', CAST(count(DISTINCT hour) AS BIGINT) FROM h WHERE event_type <> 'view'
      UNION ALL SELECT 'reservoirs', CAST(count(*) AS BIGINT) FROM ({RESERVOIR_SQL})
      UNION ALL SELECT 'weather', CAST(count(*) AS BIGINT) FROM weather)""",
)


@register("backfill", _BACKFILL_SQL)
def _backfill(spark, sf):
    root = scratch_path(spark, "tables")
    cfg = _config(spark, sf, root)
    return _stored(spark, root, backfill(spark, cfg))


@register(
    "incremental_load",
    with_ctes(
        "h", "weather",
        body="""SELECT step, n AS n_inserted, n AS n_stored, n AS n_keys FROM (
          SELECT 'cmg' AS step, CAST(count(*) AS BIGINT) AS n FROM h WHERE CAST(hour AS DATE) = DATE '2024-01-20'
          UNION ALL SELECT 'generation', CAST(count(DISTINCT hour) AS BIGINT) FROM h
            WHERE event_type <> 'view' AND CAST(hour AS DATE) = DATE '2024-01-20'
          UNION ALL SELECT 'reservoirs', CAST(0 AS BIGINT)
          UNION ALL SELECT 'weather', CAST(count(*) AS BIGINT) FROM weather WHERE date = DATE '2024-01-20')""",
    ),
)
def _incremental(spark, sf):
    root = scratch_path(spark, "tables")
    cfg = _config(spark, sf, root)
    inserted = incremental_load(spark, cfg, "2024-01-20")
    again = incremental_load(spark, cfg, "2024-01-20")
    return _stored(spark, root, {step: n + again[step] for step, n in inserted.items()})


@register(
    "load_counts",
    with_ctes(
        "h",
        body="""SELECT CAST(count(*) + count(*) FILTER (event_type = 'click') AS BIGINT) AS attempted,
          CAST(count(*) FILTER (event_type <> 'error') AS BIGINT) AS inserted,
          CAST(count(*) FILTER (event_type = 'click') AS BIGINT) AS ignored,
          CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS rejected FROM h""",
    ),
)
def _load_counts(spark, sf):
    # Lines of clicks are there twice, those of errors lack the bus.
    lines = spark.read.text(write_price_files(spark, sf)).where(~F.col("value").startswith("barra"))
    again = lines.where(F.col("value").startswith("click"))
    path = scratch_path(spark, "repeated-lines")
    cut = F.regexp_replace("value", "^error", "")
    head = spark.range(1).select(F.lit("\t".join(["barra", "referencia", "fecha", "hora", "usd", "clp", "nombre"])).alias("value"), F.lit(0).alias("at"))
    body = lines.unionAll(again).select(cut.alias("value"), F.lit(1).alias("at"))
    head.unionByName(body).coalesce(1).sortWithinPartitions("at").select("value").write.text(path)
    counts = backfill(spark, LoadConfig(root=scratch_path(spark, "tables"), prices=path, trees=1)).details["cmg"]
    return spark.createDataFrame([tuple(counts[c] for c in COUNTS)], ", ".join(f"{c} long" for c in COUNTS))


COUNTS = ("attempted", "inserted", "ignored", "rejected")


@register("refresh_features", f"SELECT * EXCLUDE (precip_mm) FROM ({STORE_SQL})", floats={"gen_total_mw": 2})
def _refresh(spark, sf):
    """The feature table after two loads with a refresh behind each, against one built at once."""
    root = scratch_path(spark, "tables")
    sky = weather(spark, sf).withColumn("precip_mm", F.lit(None).cast("double"))
    sources = {
        "marginal_costs": prices(spark, sf), "generation_by_tech": generation(spark, sf), "demand": demand(spark, sf),
        "reservoir_levels": reservoirs(spark, sf), "weather": sky,
    }
    cut = F.lit("2024-01-16").cast("timestamp")
    for first in (True, False):
        for name, rows in sources.items():
            early = F.col(KEYS[name][0]).cast("timestamp") < cut
            load_table(spark, rows.where(early if first else ~early), root, name)
        refresh_features(spark, root, "signup")
    return spark.read.parquet(f"{root}/feature_store").drop("month", "precip_mm")


@register(
    "stream_prices",
    with_ctes(
        "h",
        body="""SELECT hour + INTERVAL 3 HOUR AS datetime, event_type AS barra, value AS cmg_usd_mwh, FALSE AS is_imputed
        FROM h""",
    ),
)
def _stream(spark, sf):
    files, root, marks = write_price_files(spark, sf), scratch_path(spark, "tables"), scratch_path(spark, "marks")
    for _ in range(2):
        stream_prices(spark, files, root, marks, barra=None).awaitTermination()
    return read_table(spark, f"{root}/marginal_costs", PRICES).drop("month")


