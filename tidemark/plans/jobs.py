"""Loading jobs over the raw files.

Every source is read as one frame of lines, which is split once: usable lines are loaded, lines of no interest
left alone, rejected ones stored below ``quarantine`` with file and reason, in a folder per load. What
became of every file is stored below ``outcomes``; a file that cannot be used keeps no other from loading.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.clock import DEFAULT_TZ
from tidemark.operators.frames import rename_proxy, tag_constant
from tidemark.operators.joins import join_feature_store
from tidemark.operators.keyed import settled
from tidemark.operators.selection import union_files
from tidemark.operators.windows import dedupe_first
from tidemark.plans.cleaning import IMPUTER_TREES, clean_generation, clean_prices
from tidemark.session import prepare
from tidemark.sinks.tables import committed_loads, load_name, load_table, materialize_features, read_table, touched_months
from tidemark.sources.delimited import listed_files, outcomes, readable_files
from tidemark.sources.files import (
    DEFAULT_REGION,
    RESERVOIR_FROM_YEAR,
    RESERVOIRS,
    generation_lines,
    hourly_generation,
    monthly_levels,
    price_rows,
    reservoir_lines,
    type_prices,
    weather_days,
)
from tidemark.sources.schemas import KEYS, PRICES, TABLES

log = logging.getLogger(__name__)

CONTEXT_DAYS = 14

SEEN = T.StructType([T.StructField("table", T.StringType()), T.StructField("load", T.StringType())])


@dataclass(frozen=True)
class LoadConfig:
    """Where the raw files are and where the tables go. A source without paths is skipped."""

    root: str
    prices: str | Sequence[str] | None = None
    generation: str | Sequence[str] | None = None
    reservoirs: str | Sequence[str] | None = None
    weather: str | Sequence[str] | None = None
    barra: str | None = None
    bus_map: Mapping[str, str] | None = None
    region: str = DEFAULT_REGION
    reservoir_names: Sequence[str] = RESERVOIRS
    reservoir_from_year: int = RESERVOIR_FROM_YEAR
    tz: str = DEFAULT_TZ
    trees: int = IMPUTER_TREES


@dataclass
class Load:
    """One load: its name, the local day it is limited to, and what became of the files of each source."""

    day: str | None = None
    name: str = field(default_factory=load_name)
    failed_files: dict[str, dict[str, str]] = field(default_factory=dict)

    def of_day(self, lines: DataFrame, date: str) -> DataFrame:
        """Lines of the day, and those whose day cannot be read."""
        if self.day is None:
            return lines
        return lines.where(F.col(date).isNull() | (F.col(date) == F.lit(self.day).cast("date")))

    def settle(self, cfg: LoadConfig, source: str, lines: DataFrame, files: DataFrame) -> tuple[DataFrame, int]:
        """Store the lines, the rejected ones and the files' outcomes; the usable lines and how many were rejected."""
        lines = settled(lines, source)
        bad = F.col("reason").isNotNull()
        at = f"{cfg.root}/quarantine/{source}/load={self.name}"
        lines.where(bad).select("file", "line", "reason").write.parquet(at)
        became = f"{cfg.root}/outcomes/{source}/load={self.name}"
        outcomes(lines, files).write.parquet(became)
        found = lines.sparkSession.read.parquet(became)
        totals = found.agg(F.sum("rejected").alias("rejected"), F.count_if(F.col("error").isNull()).alias("good")).first()
        broken = {r["file"]: r["error"] for r in found.where("error IS NOT NULL").select("file", "error").toLocalIterator()}
        if broken:
            self.failed_files[source] = broken
            log.error("%s: %d files cannot be used", source, len(broken))
            if not totals["good"]:
                raise ValueError("; ".join(f"{f}: {e}" for f, e in broken.items()))
        return lines.where(~bad & ~F.col("outside")), totals["rejected"] or 0


def _counted(summary: dict[str, int], given: int, rejected: int) -> dict[str, int]:
    """Counts in lines: repeated lines count as ignored, so that attempted = inserted + ignored + rejected."""
    rejected += summary["rejected"]
    inserted = summary["inserted"]
    return {"attempted": given + rejected, "inserted": inserted, "ignored": given - summary["rejected"] - inserted, "rejected": rejected}


def price_lines(spark: SparkSession, cfg: LoadConfig) -> tuple[DataFrame, DataFrame]:
    """Typed price lines and the files they come from."""

    def typed(paths):
        lines = type_prices(price_rows(spark, paths), cfg.bus_map, cfg.barra, cfg.tz)
        return settled(lines.withColumn("outside", F.lit(False)), "price-lines")

    try:
        return typed(cfg.prices), listed_files(spark, cfg.prices, {})
    except Exception:
        readable, errors = readable_files(spark, cfg.prices)
        if not errors or not readable:
            raise
        return typed(readable), listed_files(spark, cfg.prices, errors)


def load_prices(spark: SparkSession, cfg: LoadConfig, load: Load) -> dict[str, int]:
    lines, files = price_lines(spark, cfg)
    usable, rejected = load.settle(cfg, "prices", load.of_day(lines, "file_date"), files)
    rows = usable.select("datetime", "barra", "cmg_usd_mwh", "file_hour")
    # The hour a spring change repeats: the earlier file hour counts, unless its price is unreadable.
    raw = dedupe_first(rows, ["datetime", "barra"], ["file_hour"]).drop("file_hour")
    if load.day is not None:
        raw = settled(_with_context(spark, cfg, raw, load.day), "prices")
    # Stored before the insert, which reads its batch twice.
    clean = settled(clean_prices(raw.drop("_new"), trees=cfg.trees), "clean-prices")
    if load.day is not None:
        clean = clean.join(raw.where("_new").select("barra", "datetime"), ["barra", "datetime"], "left_semi")
    summary = load_table(spark, clean, cfg.root, "marginal_costs")
    return _counted(summary, usable.count(), rejected)


def _with_context(spark: SparkSession, cfg: LoadConfig, new: DataFrame, day: str, days: int = CONTEXT_DAYS) -> DataFrame:
    """Add the observed rows of the preceding days, so that one day is cleaned like a long series."""
    stored = read_table(spark, f"{cfg.root}/marginal_costs", PRICES)
    start = F.to_utc_timestamp(F.date_sub(F.lit(day).cast("date"), days).cast("timestamp"), cfg.tz)
    end = F.to_utc_timestamp(F.date_add(F.lit(day).cast("date"), 2).cast("timestamp"), cfg.tz)
    near = stored.where(
        F.col("month").between(F.date_format(start, "yyyy-MM"), F.date_format(end, "yyyy-MM"))
        & F.col("datetime").between(start, end)
        & ~F.col("is_imputed")
    )
    earlier = near.select("datetime", "barra", F.col("cmg_usd_mwh").cast("double").alias("cmg_usd_mwh"))
    earlier = earlier.join(new, ["datetime", "barra"], "left_anti").withColumn("_new", F.lit(False))
    return union_files(new.withColumn("_new", F.lit(True)), earlier)


def load_generation(spark: SparkSession, cfg: LoadConfig, load: Load) -> dict[str, int]:
    """Counts are hours; rejected ones are those without a time. Lines are counted in the outcomes."""
    lines, files = generation_lines(spark, cfg.generation)
    if load.day is not None:
        # The days around it, so that the day's gaps are filled as in a load of everything.
        around = F.abs(F.date_diff(F.col("date"), F.lit(load.day).cast("date"))) <= CONTEXT_DAYS
        lines = lines.where(F.col("date").isNull() | around)
    usable, _ = load.settle(cfg, "generation", lines, files)
    rows = settled(hourly_generation(usable, cfg.tz), "generation")
    clean = clean_generation(tag_constant(rows, "_series_", "all"), ["_series_"], tz=cfg.tz).drop("_series_")
    if load.day is not None:
        clean = _local_day(clean, "datetime", load.day, cfg.tz)
    return load_table(spark, settled(clean, "clean-generation"), cfg.root, "generation_by_tech")


def load_reservoirs(spark: SparkSession, cfg: LoadConfig, load: Load) -> dict[str, int]:
    """Counts are months."""
    lines, files = reservoir_lines(spark, cfg.reservoirs, cfg.reservoir_names, cfg.reservoir_from_year)
    if load.day is not None:
        month = F.trunc(F.lit(load.day).cast("date"), "MM")
        lines = lines.where(F.col("fecha").isNull() | (F.trunc("fecha", "MM") == month))
    usable, _ = load.settle(cfg, "reservoirs", lines, files)
    levels = rename_proxy(monthly_levels(usable), "avg_cota_msnm", "energy_gwh").drop("n_embalses")
    return load_table(spark, levels, cfg.root, "reservoir_levels")


def load_weather(spark: SparkSession, cfg: LoadConfig, load: Load) -> dict[str, int]:
    days, files = weather_days(spark, cfg.weather, cfg.region)
    usable, rejected = load.settle(cfg, "weather", load.of_day(days, "date"), files)
    summary = load_table(spark, usable, cfg.root, "weather")
    return _counted(summary, summary["attempted"], rejected)


def _local_day(df: DataFrame, ts: str, day: str, tz: str, around: int = 0) -> DataFrame:
    """Rows of the local day and of ``around`` days on each side of it."""
    date = F.lit(day).cast("date")
    start = F.to_utc_timestamp(F.date_sub(date, around).cast("timestamp"), tz)
    end = F.to_utc_timestamp(F.date_add(date, around + 1).cast("timestamp"), tz)
    return df.where((F.col(ts) >= start) & (F.col(ts) < end))


class Loaded(dict):
    """Rows inserted per source. ``details``: attempted, inserted, ignored and rejected rows of each source
    that was loaded; ``failed``: the error of each source that could not be; ``failed_files``: those of single
    files; ``name``: the load's folder below ``quarantine`` and ``outcomes``."""

    def __init__(self, steps, load: Load):
        super().__init__(dict.fromkeys(steps, 0))
        self.name, self.failed_files = load.name, load.failed_files
        self.details: dict[str, dict[str, int]] = {}
        self.failed: dict[str, str] = {}


STEPS: dict[str, tuple[str, Callable[..., dict[str, int]]]] = {
    "cmg": ("prices", load_prices),
    "generation": ("generation", load_generation),
    "reservoirs": ("reservoirs", load_reservoirs),
    "weather": ("weather", load_weather),
}


def _run(spark: SparkSession, cfg: LoadConfig, day: str | None) -> Loaded:
    prepare(spark)
    one = Load(day)
    loaded = Loaded(STEPS, one)
    for name, (source, load) in STEPS.items():
        if not getattr(cfg, source):
            log.warning("no paths for %s, skipped", source)
            continue
        try:
            loaded.details[name] = load(spark, cfg, one)
            loaded[name] = loaded.details[name]["inserted"]
        except Exception as error:
            # One broken source must not keep the others from loading.
            log.exception("loading %s failed", source)
            loaded.failed[name] = str(error)
    return loaded


def backfill(spark: SparkSession, cfg: LoadConfig) -> Loaded:
    """Load all sources independently; rows inserted per source, with counts and failures."""
    return _run(spark, cfg, None)


def incremental_load(spark: SparkSession, cfg: LoadConfig, day: str) -> Loaded:
    """The same loads for one local day. A late row fills a hole and never overwrites."""
    return _run(spark, cfg, day)


#: Tables behind the feature table, and how many days around its own a row can reach: slow rows are matched
#: by local date, which overlaps two UTC days.
FEATURE_SOURCES = {"marginal_costs": 0, "generation_by_tech": 0, "demand": 0, "reservoir_levels": 1, "weather": 1}


def refresh_features(
    spark: SparkSession, root: str, region: str, barra: str | None = None, tz: str = DEFAULT_TZ, name: str = "feature_store"
) -> list[str]:
    """Bring the feature table below ``root`` up to date with all committed loads; the months replaced.

    Only the months are computed anew to which a load since the last refresh has added rows; a refresh
    that was interrupted does them again. What it has seen is stored below ``refreshed``.
    """
    seen_at = f"{root}/refreshed/{name}"
    loads = {t: committed_loads(spark, f"{root}/{t}") or [] for t in FEATURE_SOURCES}
    seen = read_table(spark, seen_at, SEEN)
    done = {(r["table"], r["load"]) for r in seen.select("table", "load").toLocalIterator()}
    new = {t: [x for x in names if (t, x) not in done] for t, names in loads.items()}
    months: set[str] = set()
    for table, around in FEATURE_SOURCES.items():
        if new[table]:
            months |= touched_months(spark, f"{root}/{table}", new[table], KEYS[table][0], TABLES[table], around)
    if months:
        stored = {t: read_table(spark, f"{root}/{t}", TABLES[t]) for t in FEATURE_SOURCES}
        prices = stored["marginal_costs"].where(F.col("month").isin(*sorted(months)))
        others = [stored[t].drop("month") for t in list(FEATURE_SOURCES)[1:]]
        materialize_features(join_feature_store(prices, *others, barra=barra, region=region, tz=tz), f"{root}/{name}")
    rows = [(t, x) for t, names in new.items() for x in names]
    if rows:
        spark.createDataFrame(rows, SEEN).withColumn("month", F.lit("all")).write.mode("append").partitionBy("month").parquet(seen_at)
    return sorted(months)
