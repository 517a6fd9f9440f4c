"""Raw file readers.

Each reader takes any number of paths or globs. Cells arrive as text and are typed by expressions, so a
bad cell becomes NULL. Every source has one typed frame of its lines with the reason why a line is
rejected; readers take the usable lines, loads also store the others and count both.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import hour24_to_ts, local_to_utc, parse_date_strict, parse_decimal_comma, regex_hour, row_sum, tidy
from tidemark.functions.clock import DEFAULT_TZ
from tidemark.operators.aggregates import agg_month_mean_distinct
from tidemark.operators.frames import MISSING_TOKENS, ensure_columns, fill_zero, map_category, null_tokens
from tidemark.operators.reshape import explode_arrays, pivot_category, unpivot_hours
from tidemark.session import prepare
from tidemark.sources.delimited import Layout, listed_files, named_cells, outcomes, readable_files, require_good, survey
from tidemark.sources.schemas import TECH_COLUMNS

# Layouts and names of the raw files.
PRICE_COLUMNS = (
    "barra_mnemotecnico",
    "barra_referencia_mnemotecnico",
    "fecha",
    "hora",
    "costo_en_dolares",
    "costo_en_pesos",
    "nombre",
)
HOUR_COLUMNS = tuple(f"Hora {h}" for h in range(1, 25))
GENERATION_REQUIRED = ("Tipo", "Subtipo", "Fecha")
TECHNOLOGIES = (
    ("Solar", None, "gen_solar_mw"),
    ("Eólicas", None, "gen_wind_mw"),
    ("Hidroeléctricas", "Embalse", "gen_hydro_reservoir_mw"),
    ("Hidroeléctricas", "Pasada", "gen_hydro_runofriver_mw"),
    ("Termoeléctricas", "Gas Natural", "gen_gas_mw"),
    ("Termoeléctricas", "Carbón", "gen_coal_mw"),
    ("Termoeléctricas", "Diésel", "gen_diesel_mw"),
)
RESERVOIRS = ("Colbún", "Laja", "Maule", "Rapel", "Ralco", "Chapo", "Melado", "La Invernada")
RESERVOIR_FROM_YEAR = 2019
DEFAULT_BARRA = "Quillota 220kV"
DEFAULT_REGION = "Santiago"
GENERATION_LAYOUT = Layout("\t", (*GENERATION_REQUIRED, *HOUR_COLUMNS))
RESERVOIR_LAYOUT = Layout(";", ("fecha", "central", "cota_msnm"), "ISO-8859-1", "fecha")
ISO_DATE = "yyyy-M-d"
DMY_DATE = "d/M/yyyy"

PAYLOAD = T.StructType(
    [
        T.StructField(
            "daily",
            T.StructType(
                [
                    T.StructField("time", T.ArrayType(T.StringType())),
                    T.StructField("temperature_2m_max", T.ArrayType(T.StringType())),
                    T.StructField("precipitation_sum", T.ArrayType(T.StringType())),
                ]
            ),
        )
    ]
)


def scan_glob(
    spark: SparkSession, paths: str | Sequence[str], schema: T.StructType, **options: str
) -> tuple[DataFrame, DataFrame]:
    """Delimited files as (good rows, rows that do not fit the schema), each with ``_file``.

    One scan over all files; a broken file contributes to the second frame and does not stop
    the others. Columns are not pruned while parsing, because a row with too few cells goes
    unnoticed if only its first cells are asked for.
    """
    with_bad = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    rows = (
        spark.read.schema(with_bad)
        .options(**{"header": "true", **options})
        .options(mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt", enforceSchema="true", columnPruning="false")
        .csv(paths if isinstance(paths, str) else list(paths))
        .withColumn("_file", F.col("_metadata.file_path"))
    )
    # Spark refuses to look at the bad-row column alone, so the conditions name a data column too.
    always = F.length(F.coalesce(F.col(schema[0].name).cast("string"), F.lit(""))) >= 0
    good = rows.where(F.col("_corrupt").isNull() & always).drop("_corrupt")
    return good, rows.where(F.col("_corrupt").isNotNull() & always)


def scan_files(
    spark: SparkSession, paths: str | Sequence[str], schema: T.StructType, **options: str
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``scan_glob`` of the files that can be read, and the outcome of every file.

    The third frame has file, n_lines, used, other (always 0), rejected and error; a file that breaks
    off while it is read contributes nothing but its error.
    """
    readable, errors = readable_files(spark, paths)
    if readable:
        good, bad = scan_glob(spark, readable, schema, **options)
    else:
        good = spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("_file", T.StringType())]))
        bad = good.withColumn("_corrupt", F.lit(None).cast("string"))
    none = F.lit(None).cast("string")
    lines = good.select(F.col("_file").alias("file"), none.alias("reason")).unionByName(
        bad.select(F.col("_file").alias("file"), F.coalesce("_corrupt", F.lit("")).alias("reason"))
    )
    return good, bad, outcomes(lines.withColumn("outside", F.lit(False)), listed_files(spark, paths, errors))


def text_schema(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


# One way to read price lines, for batches and streams: short lines keep the cells they have, and a
# line that does not have exactly the expected cells is also there as it stands.
PRICE_SCHEMA = text_schema((*PRICE_COLUMNS, "_corrupt"))
PRICE_OPTIONS = {
    "sep": "\t", "header": "true", "encoding": "UTF-8", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt",
    "enforceSchema": "true", "columnPruning": "false",
}


def price_cells(raw: DataFrame) -> DataFrame:
    """Cells as text with missing-value tokens NULL, the file, the line, and its number of cells."""
    cells = [F.col(c) for c in PRICE_COLUMNS]
    line = F.coalesce(F.col("_corrupt"), F.concat_ws("\t", *[F.coalesce(c, F.lit("")) for c in cells]))
    n_cells = F.when(F.col("_corrupt").isNull(), len(PRICE_COLUMNS)).otherwise(F.size(F.split("_corrupt", "\t")))
    kept = raw.select(*cells, F.col("_metadata.file_path").alias("_file"), line.alias("_line"), n_cells.alias("_cells"))
    clean = null_tokens(kept.select(*cells, "_file", "_line", "_cells"))
    return clean


def price_rows(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Price files as text columns, named by position whatever their header says."""
    prepare(spark)
    raw = spark.read.schema(PRICE_SCHEMA).options(**PRICE_OPTIONS).csv(paths if isinstance(paths, str) else list(paths))
    return price_cells(raw)


def type_prices(
    raw: DataFrame, bus_map: Mapping[str, str] | None = None, barra: str | None = None, tz: str = DEFAULT_TZ
) -> DataFrame:
    """Text columns of price files -> typed rows with the file's own date and hour, file, line, and why it is rejected.

    ``reason`` is NULL for usable rows; a line with too few cells is usable if it has a time and a bus.
    """
    code = tidy(F.col("barra_mnemotecnico"))
    if barra is not None:
        name = F.lit(barra)
    elif bus_map:
        pairs = [F.lit(x) for pair in bus_map.items() for x in pair]
        name = F.coalesce(F.create_map(*pairs)[code], code)
    else:
        name = code
    date = parse_date_strict(F.col("fecha"), ISO_DATE)
    hour = parse_decimal_comma(F.col("hora")).try_cast("int")
    typed = raw.select(
        local_to_utc(hour24_to_ts(date, hour), tz).alias("datetime"),
        name.alias("barra"),
        parse_decimal_comma(F.col("costo_en_dolares")).alias("cmg_usd_mwh"),
        date.alias("file_date"),
        hour.alias("file_hour"),
        F.col("_file").alias("file"),
        F.col("_line").alias("line"),
        "_cells",
    )
    reason = (
        F.when(F.col("_cells") > len(PRICE_COLUMNS), "too many cells")
        .when(F.col("datetime").isNull(), "no usable time")
        .when(F.col("barra").isNull(), "no bus")
    )
    return typed.withColumn("reason", reason).drop("_cells")


def read_price_tsv(
    spark: SparkSession,
    paths: str | Sequence[str],
    bus_map: Mapping[str, str] | None = None,
    barra: str | None = None,
    tz: str = DEFAULT_TZ,
    keep_hour: bool = False,
) -> DataFrame:
    """(datetime, barra, cmg_usd_mwh) of all usable lines of price files.

    The bus is the file's code, translated by ``bus_map`` where it has an entry, so that files of
    many buses load together; ``barra`` gives every row one name instead. ``keep_hour`` adds the
    file's date and hour, the tie-break for the hour a spring change makes occur twice. The other
    lines are those of ``rejected_prices``.
    """
    typed = type_prices(price_rows(spark, paths), bus_map, barra, tz)
    usable = typed.where(F.col("reason").isNull()).drop("file", "line", "reason")
    return usable if keep_hour else usable.drop("file_date", "file_hour")


def rejected_prices(
    spark: SparkSession,
    paths: str | Sequence[str],
    bus_map: Mapping[str, str] | None = None,
    barra: str | None = None,
    tz: str = DEFAULT_TZ,
) -> DataFrame:
    """(file, line, reason) of the lines that ``read_price_tsv`` cannot use, given the same arguments."""
    typed = type_prices(price_rows(spark, paths), bus_map, barra, tz)
    return typed.where(F.col("reason").isNotNull()).select("file", "line", "reason")


def quarantine(df: DataFrame, required: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Split rows into those with all required cells and the others."""
    complete = F.lit(True)
    for c in required:
        complete &= F.col(c).isNotNull()
    return df.where(complete), df.where(~complete)


def category_map(spark: SparkSession, entries: Sequence[tuple[str, str | None, str]] = TECHNOLOGIES) -> DataFrame:
    """Mapping table (kind, subkind, category); extend it to cover more plant types."""
    return spark.createDataFrame(list(entries), "kind string, subkind string, category string")


def _without_tokens(cells: DataFrame, cols: Sequence[str]) -> DataFrame:
    return cells.withColumns({c: F.when(~F.col(c).isin(*MISSING_TOKENS), F.col(c)) for c in cols})


def generation_lines(
    spark: SparkSession, paths: str | Sequence[str], mapping: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Plant-day lines and the files they come from.

    Lines: file, line, reason, outside (of no mapped technology), date, tech and the 24 hours as text.
    Files: as ``survey`` gives them. Columns are found by each file's own header.
    """
    prepare(spark)
    files, readable = survey(spark, paths, GENERATION_LAYOUT)
    wanted = GENERATION_LAYOUT.required
    cells = _without_tokens(named_cells(spark, readable, files, GENERATION_LAYOUT, wanted), wanted)
    plants = cells.withColumns({c: tidy(F.col(c)) for c in GENERATION_REQUIRED})
    mapping = mapping if mapping is not None else category_map(spark)
    known = map_category(plants, mapping, "Tipo", "Subtipo", "tech", keep_others=True)
    date = parse_date_strict(F.col("Fecha"), ISO_DATE)
    reason = F.when(F.col("_cells") > F.col("_names"), "too many cells").when(
        F.col("tech").isNotNull() & date.isNull(), "no usable date"
    )
    lines = known.select(
        F.col("_file").alias("file"), F.col("_line").alias("line"), reason.alias("reason"),
        F.col("tech").isNull().alias("outside"), date.alias("date"), "tech", *HOUR_COLUMNS,
    )
    return lines, files


def hourly_generation(lines: DataFrame, tz: str = DEFAULT_TZ, dst_duplicates: str = "sum") -> DataFrame:
    """Usable plant-day lines -> hourly MW per technology and in total."""
    usable = lines.where(F.col("reason").isNull() & ~F.col("outside"))
    long = unpivot_hours(usable, ["date", "tech"], HOUR_COLUMNS)
    hour = regex_hour(F.col("hora_col"))
    hourly = long.select(
        local_to_utc(hour24_to_ts(F.col("date"), hour), tz).alias("datetime"),
        hour.alias("_hour"),
        "tech",
        parse_decimal_comma(F.col("mw")).alias("mw"),
    ).dropna(subset=["datetime", "mw"])
    if dst_duplicates == "mean":
        hourly = (
            hourly.groupBy("datetime", "tech", "_hour").agg(F.sum("mw").alias("mw"))
            .groupBy("datetime", "tech").agg(F.avg("mw").alias("mw"))
        )
    elif dst_duplicates != "sum":
        raise ValueError("dst_duplicates must be 'sum' or 'mean'")
    wide = pivot_category(hourly, ["datetime"], "tech", "mw", TECH_COLUMNS)
    wide = fill_zero(ensure_columns(wide, TECH_COLUMNS), TECH_COLUMNS)
    return wide.withColumn("gen_total_mw", row_sum([F.col(c) for c in TECH_COLUMNS]))


def read_generation_tsv(
    spark: SparkSession,
    paths: str | Sequence[str],
    mapping: DataFrame | None = None,
    tz: str = DEFAULT_TZ,
    dst_duplicates: str = "sum",
) -> DataFrame:
    """Hourly MW per technology from plant-day rows with 24 hour columns.

    In spring two file hours fall on one instant; ``sum`` adds them, ``mean`` averages the two
    file hours of each technology. A file without the required columns is a ValueError.
    """
    lines, files = generation_lines(spark, paths, mapping)
    require_good(files)
    return hourly_generation(lines, tz, dst_duplicates)


def reservoir_lines(
    spark: SparkSession,
    paths: str | Sequence[str],
    names: Sequence[str] = RESERVOIRS,
    from_year: int = RESERVOIR_FROM_YEAR,
) -> tuple[DataFrame, DataFrame]:
    """Daily levels and the files they come from; lines of other reservoirs and earlier years are ``outside``."""
    prepare(spark)
    files, readable = survey(spark, paths, RESERVOIR_LAYOUT)
    wanted = RESERVOIR_LAYOUT.required
    cells = _without_tokens(named_cells(spark, readable, files, RESERVOIR_LAYOUT, wanted), wanted)
    central, date = tidy(F.col("central")), parse_date_strict(F.col("fecha"), DMY_DATE)
    among = F.coalesce(central.isin(*names), F.lit(False))
    reason = F.when(F.col("_cells") > F.col("_names"), "too many cells").when(among & date.isNull(), "no usable date")
    early = F.coalesce(date < F.lit(f"{from_year}-01-01").cast("date"), F.lit(False))
    lines = cells.select(
        F.col("_file").alias("file"), F.col("_line").alias("line"), reason.alias("reason"), (~among | early).alias("outside"),
        date.alias("fecha"), central.alias("central"), parse_decimal_comma(F.col("cota_msnm")).alias("cota_msnm"),
    )
    return lines, files


def monthly_levels(lines: DataFrame) -> DataFrame:
    """Usable daily levels -> (date, avg_cota_msnm, n_embalses) per month."""
    usable = lines.where(F.col("reason").isNull() & ~F.col("outside"))
    return agg_month_mean_distinct(usable, "fecha", "cota_msnm", "central", "avg_cota_msnm", "n_embalses")


def read_reservoir_csv(
    spark: SparkSession,
    paths: str | Sequence[str],
    names: Sequence[str] = RESERVOIRS,
    from_year: int = RESERVOIR_FROM_YEAR,
) -> DataFrame:
    """Monthly (date, avg_cota_msnm, n_embalses) from daily reservoir levels."""
    lines, files = reservoir_lines(spark, paths, names, from_year)
    require_good(files)
    return monthly_levels(lines)


PAYLOAD_FIELDS = ("time", "temperature_2m_max", "precipitation_sum")


def _payloads(spark: SparkSession, paths: str | Sequence[str], region: str) -> DataFrame:
    """(file, region, the payload's arrays, error) of every document."""
    prepare(spark)
    docs = spark.read.text(paths if isinstance(paths, str) else list(paths), wholetext=True)
    file = F.col("_metadata.file_path")
    where = F.regexp_extract(F.try_url_decode(file), region, 1) if "(" in region else F.lit(region)
    parsed = docs.select(file.alias("file"), where.alias("region"), F.from_json("value", PAYLOAD).alias("payload"))
    parsed = parsed.select("file", "region", "payload.daily.*")
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(f"daily.{c}")) for c in PAYLOAD_FIELDS]))
    error = F.concat(F.lit("weather payload lacks "), F.array_join(missing, ", "))
    return parsed.withColumn("error", F.when(F.size(missing) > 0, error))


def _days(payloads: DataFrame) -> DataFrame:
    rows = explode_arrays(payloads, PAYLOAD_FIELDS, keep=["file", "region"])
    date = parse_date_strict(F.col("time"), ISO_DATE)
    return rows.select(
        "file", F.coalesce("time", F.lit("")).alias("line"), F.when(date.isNull(), "no usable date").alias("reason"),
        F.lit(False).alias("outside"), date.alias("date"),
        parse_decimal_comma(F.col("temperature_2m_max")).alias("temp_max_c"),
        parse_decimal_comma(F.col("precipitation_sum")).alias("precip_mm"),
        "region",
    )


def weather_days(
    spark: SparkSession, paths: str | Sequence[str], region: str = DEFAULT_REGION
) -> tuple[DataFrame, DataFrame]:
    """Days of stored payload files, and the files; a payload without the expected fields is its file's error."""
    payloads = _payloads(spark, paths, region)
    return _days(payloads.where(F.col("error").isNull())), payloads.select(F.col("file").alias("_file"), "error")


def read_weather_json(
    spark: SparkSession, paths: str | Sequence[str], region: str = DEFAULT_REGION
) -> DataFrame:
    """(date, temp_max_c, precip_mm, region) from stored payload files, one document per file.

    A payload without the expected fields fails the job. ``region`` may be a pattern with one
    group, which then takes each file's region from its path.
    """
    payloads = _payloads(spark, paths, region)
    fails = F.raise_error(F.col("error")).cast("array<string>")
    payloads = payloads.withColumn("time", F.when(F.col("error").isNull(), F.col("time")).otherwise(fails))
    return _days(payloads).select("date", "temp_max_c", "precip_mm", "region")
