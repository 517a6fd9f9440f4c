"""Imputation and forecasting.

SQL follows the learners where trees are stumps and rounds few: the same bins, the same best split, the
same steps. Deeper trees are tested against a plain implementation.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tidemark.catalog.base import register
from tidemark.catalog.gaps_and_joins import LINE, NEAR_SQL, feature_matrix, matrix_sql
from tidemark.catalog.stand_ins import KEY, grid, series, with_ctes
from tidemark.operators.frames import split_chronological
from tidemark.operators.keyed import settled
from tidemark.operators.selection import top_k_importance
from tidemark.plans.cleaning import LAG_BINS, MIN_LEAF_ROWS, MIN_TRAIN_ROWS, clean_prices, impute_gbt
from tidemark.plans.features import CYCLIC, FEATURES, TARGET
from tidemark.plans.forecast import BINS, RATE, Trees, feature_importance, fit_gbt, model_rows, score
from tidemark.plans.report import Bounds, train_and_report
from tidemark.plans.seasonal import ORDERS, SEASON, seasonal_ar
from tidemark.session import scratch_path
from tidemark.sinks.tables import save_model

ROUNDS = 3
STUMPS = Trees(depth=1, min_leaf=20, row_share=1.0, column_share=1.0)
TRAIN_END, VAL_END = "2024-01-17", "2024-01-20"
# Calendar inputs cut the rows in the same ways as each other, which leaves the choice between them open; the
# thinnest test tables have no row with the weekly lag.
INPUTS = tuple(c for c in FEATURES if c not in CYCLIC and not c.startswith("is_") and c != f"lag_{TARGET}_168h")


def stumps_sql(rows: str, key: str, rounds: int, min_leaf: int, min_rows: int = 1, first: float = RATE) -> str:
    """CTEs f0, s0, p1, s1, ... : boosting of stumps over ``rows`` (key, t: target or NULL, b: list of bins)."""
    parts = [
        f"f0 AS (SELECT {key}, avg(t) AS f FROM {rows} GROUP BY ALL HAVING count(t) >= {min_rows})",
        f"s0 AS MATERIALIZED (SELECT * FROM {rows} JOIN f0 USING ({key}))",
    ]
    for k in range(1, rounds + 1):
        parts += [
            f"l{k} AS (SELECT {key}, j, b, sum(t - f) AS g, count(*) AS n FROM (SELECT {key}, t, f, unnest(range(len(b))) AS j,"
            f" unnest(b) AS b FROM s{k - 1} WHERE t IS NOT NULL) GROUP BY ALL)",
            f"c{k} AS (SELECT {key}, j, b, sum(g) OVER w AS gl, sum(n) OVER w AS nl, sum(g) OVER a AS g, sum(n) OVER a AS n FROM l{k}"
            f" WINDOW w AS (PARTITION BY {key}, j ORDER BY b), a AS (PARTITION BY {key}, j))",
            f"p{k} AS MATERIALIZED (SELECT * FROM (SELECT {key}, j, b AS cut, gl / nl AS lv, (g - gl) / (n - nl) AS rv,"
            f" round(gl * gl / nl + (g - gl) * (g - gl) / (n - nl) - g * g / n, 6) AS gain FROM c{k}"
            f" WHERE nl >= {min_leaf} AND n - nl >= {min_leaf}) WHERE gain > 0"
            f" QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY gain DESC, j, cut) = 1)",
            f"s{k} AS MATERIALIZED (SELECT s.* REPLACE (s.f + {RATE if k > 1 else first}::DOUBLE * coalesce(CASE WHEN s.b[p.j + 1] <= cut THEN lv ELSE rv END, 0)"
            f" AS f) FROM s{k - 1} s LEFT JOIN p{k} p USING ({key}))",
        ]
    return ",\n".join(parts)


def _quantiles(n: int) -> str:
    return "[" + ", ".join(f"{i}/{n}.0" for i in range(1, n)) + "]"


def _forecast_sql(body: str) -> str:
    """``every``: predictions after each round; ``best``: the round of the least validation error."""
    known = " AND ".join(f"{c} IS NOT NULL" for c in (*INPUTS, TARGET))
    values = ", ".join(f"{c}::DOUBLE" for c in INPUTS)
    every = " UNION ALL ".join(f"SELECT {k} AS round, * FROM s{k}" for k in range(1, ROUNDS + 1))
    cuts = " UNION ALL ".join(f"SELECT {k} AS round, j, gain FROM p{k}" for k in range(1, ROUNDS + 1))
    return f"""WITH x AS MATERIALIZED (
      SELECT 1 AS one, barra, datetime, {TARGET} AS y, [{values}] AS v,
        CASE WHEN datetime < TIMESTAMP '{TRAIN_END}' + INTERVAL 1 DAY THEN 'train'
             WHEN datetime < TIMESTAMP '{VAL_END}' + INTERVAL 1 DAY THEN 'val' ELSE 'test' END AS split
      FROM ({matrix_sql()}) WHERE {known}),
    e AS (SELECT j, list_distinct(quantile_cont(z, {_quantiles(BINS)})) AS edges
          FROM (SELECT unnest(range(len(v))) AS j, unnest(v) AS z FROM x WHERE split = 'train') GROUP BY j),
    binned AS (SELECT barra, datetime, list(len(list_filter(edges, lambda q: q <= z)) ORDER BY j) AS b
               FROM (SELECT barra, datetime, unnest(range(len(v))) AS j, unnest(v) AS z FROM x) JOIN e USING (j) GROUP BY ALL),
    ready AS MATERIALIZED (SELECT one, barra, datetime, y, split, CASE WHEN split = 'train' THEN y END AS t, b
                           FROM x JOIN binned USING (barra, datetime)),
    {stumps_sql("ready", "one", ROUNDS, STUMPS.min_leaf, first=1.0)},
    every AS ({every}),
    best AS (SELECT round FROM every WHERE split = 'val' GROUP BY round ORDER BY avg(abs(y - f)), round LIMIT 1),
    cuts AS ({cuts})
    {body}"""


IMPORTANCE_SQL = f"""SELECT feature, coalesce(sum(gain) / (SELECT sum(gain) FROM cuts, best WHERE cuts.round <= best.round), 0) AS importance
  FROM (SELECT unnest(range({len(INPUTS)})) AS j, unnest([{", ".join(f"'{c}'" for c in INPUTS)}]) AS feature) names
  LEFT JOIN (SELECT cuts.j, cuts.gain FROM cuts, best WHERE cuts.round <= best.round) won USING (j) GROUP BY feature"""


def _splits(spark, sf):
    labelled = settled(split_chronological(feature_matrix(spark, sf), "datetime", TRAIN_END, VAL_END), "matrix")
    return [labelled.where(F.col("split") == s) for s in ("train", "val", "test")]


def _fitted(spark, sf):
    train, val, test = _splits(spark, sf)
    return fit_gbt(train, INPUTS, TARGET, val, rounds=ROUNDS, trees=STUMPS), val, test


@register(
    "fit_gbt",
    _forecast_sql(f"SELECT barra, datetime, y AS {TARGET}, f AS predicted FROM every JOIN best USING (round) WHERE split = 'val'"),
    floats=["predicted"],
)
def _fit(spark, sf):
    model, val, _ = _fitted(spark, sf)
    return score(model, model_rows(val, INPUTS, TARGET)).select("barra", "datetime", TARGET, "predicted")


TEST_SQL = _forecast_sql("SELECT barra, datetime, f AS predicted FROM every JOIN best USING (round) WHERE split = 'test'")


@register("score", TEST_SQL, floats=["predicted"])
def _score(spark, sf):
    model, _, test = _fitted(spark, sf)
    return score(model, model_rows(test, INPUTS, TARGET)).select("barra", "datetime", "predicted")


@register("feature_importance", _forecast_sql(IMPORTANCE_SQL), floats=["importance"])
def _importance(spark, sf):
    return feature_importance(_fitted(spark, sf)[0])


@register(
    "top_k_importance",
    _forecast_sql(f"SELECT * FROM ({IMPORTANCE_SQL}) WHERE importance > 0"),
    floats=["importance"],
)
def _top(spark, sf):
    # Inputs that no split uses share the last places.
    return top_k_importance(feature_importance(_fitted(spark, sf)[0])).where(F.col("importance") > 0)


@register("save_model", TEST_SQL, floats=["predicted"])
def _save(spark, sf):
    model, _, test = _fitted(spark, sf)
    path = scratch_path(spark, "model")
    save_model(model, path)
    rows = model_rows(test, INPUTS, TARGET)
    return score(PipelineModel.load(path), rows).select("barra", "datetime", "predicted")


REPORT_SQL = """SELECT split, avg(abs(f - y)) AS mae, sqrt(avg((f - y) * (f - y))) AS rmse,
    100 * avg(abs((f - y) / y)) FILTER (y <> 0) AS mape,
    CASE WHEN max(y) > min(y) THEN 1 - sum((f - y) * (f - y)) / (var_pop(y) * count(*)) END AS r2, CAST(count(*) AS BIGINT) AS n_predictions
  FROM every JOIN best USING (round) WHERE split <> 'train' GROUP BY split"""


@register("train_and_report", _forecast_sql(REPORT_SQL), floats=["mae", "rmse", "mape", "r2"])
def _report(spark, sf):
    bounds = Bounds(TRAIN_END, VAL_END, None, None)
    root = scratch_path(spark, "report")
    return train_and_report(feature_matrix(spark, sf), root, bounds, INPUTS, rounds=ROUNDS, trees=STUMPS).metrics


def impute_ctes(source: str, rounds: int) -> str:
    """CTE ``filled`` (event_type, hour, value, how) of ``source`` (event_type, hour, value)."""
    return f"""lagged AS MATERIALIZED (
      SELECT event_type, hour, value, lag(value, 24) OVER w AS x24, lag(value, 168) OVER w AS x168,
        [hour(hour), isodow(hour) - 1, month(hour)] AS parts FROM {source} WINDOW w AS (PARTITION BY event_type ORDER BY hour)),
    edges AS (SELECT event_type, quantile_cont(x24, {_quantiles(LAG_BINS)}) AS e24, quantile_cont(x168, {_quantiles(LAG_BINS)}) AS e168
      FROM lagged WHERE value IS NOT NULL AND x24 IS NOT NULL AND x168 IS NOT NULL GROUP BY event_type),
    ready AS MATERIALIZED (SELECT event_type, hour, value AS t,
        parts || [len(list_filter(e24, lambda q: q <= x24)), len(list_filter(e168, lambda q: q <= x168))] AS b
      FROM lagged JOIN edges USING (event_type) WHERE x24 IS NOT NULL AND x168 IS NOT NULL),
    {stumps_sql("ready", "event_type", rounds, MIN_LEAF_ROWS, MIN_TRAIN_ROWS)},
    filled AS (SELECT g.event_type, g.hour, coalesce(g.value, f, middle) AS value,
        CASE WHEN g.value IS NOT NULL THEN 'observed' WHEN f IS NOT NULL THEN 'model' ELSE 'median' END AS how
      FROM {source} g LEFT JOIN s{rounds} s ON s.event_type = g.event_type AND s.hour = g.hour
      LEFT JOIN (SELECT event_type, median(value) AS middle FROM {source} GROUP BY 1) m ON m.event_type = g.event_type)"""


SPARSE_GRID = "(SELECT event_type, hour, CASE WHEN value >= 150 THEN value END AS value FROM g)"


@register(
    "impute_gbt",
    with_ctes("g", body=",\n" + impute_ctes(SPARSE_GRID, ROUNDS) + " SELECT * FROM filled"),
    floats=["value"],
)
def _impute(spark, sf):
    sparse = grid(spark, sf).withColumn("value", F.when(F.col("value") >= 150, F.col("value")))
    return impute_gbt(sparse, KEY, "hour", "value", trees=ROUNDS, method="how", depth=1)


@register(
    "impute_observed",
    with_ctes("g", body="SELECT event_type, hour, value FROM g WHERE value IS NOT NULL"),
)
def _impute_observed(spark, sf):
    filled = impute_gbt(grid(spark, sf), KEY, "hour", "value", method="how")
    return filled.where(F.col("how") == "observed").select("event_type", "hour", "value")


# Prices with holes: values under 100 count as negative, and a low factor makes outliers.
RAW_PRICE = "CASE WHEN value < 100 THEN -value ELSE value END"

EXACT_SQL = f"""SELECT event_type, hour, was IS NULL AS is_imputed, CASE WHEN value IS NOT NULL THEN value
              WHEN p - pp <= 3 THEN CASE WHEN nv IS NULL THEN pv ELSE {LINE} END END AS value
        FROM ({NEAR_SQL.format(source='''(SELECT event_type, hour, r AS value, r AS was FROM
           (SELECT g.event_type, hour, CASE WHEN value < 100 OR value > 3 * q THEN NULL ELSE value END AS r FROM g
            JOIN (SELECT event_type, quantile_cont(value, 0.999) AS q FROM g WHERE value >= 100 GROUP BY 1) l
              ON l.event_type = g.event_type))''')})"""


def _raw_prices(spark, sf):
    return grid(spark, sf).select(
        F.col("event_type").alias("barra"), F.col("hour").alias("datetime"), F.expr(RAW_PRICE).alias("cmg_usd_mwh")
    )


@register(
    "clean_prices",
    with_ctes("g", body=f"SELECT event_type AS barra, hour AS datetime, is_imputed, value AS filled_exactly FROM ({EXACT_SQL})"),
    floats=["filled_exactly"],
)
def _clean(spark, sf):
    clean = clean_prices(_raw_prices(spark, sf), method="how")
    exact = F.when(F.col("how").isin("observed", "interpolated"), F.col("cmg_usd_mwh"))
    return clean.select("barra", "datetime", "is_imputed", exact.alias("filled_exactly"))


@register(
    "clean_prices_filled",
    with_ctes(
        "g",
        body=f""", exact AS MATERIALIZED ({EXACT_SQL}), {impute_ctes("exact", ROUNDS)}
        SELECT exact.event_type AS barra, exact.hour AS datetime, filled.value AS cmg_usd_mwh, is_imputed
        FROM exact JOIN filled ON filled.event_type = exact.event_type AND filled.hour = exact.hour""",
    ),
    floats=["cmg_usd_mwh"],
)
def _clean_filled(spark, sf):
    return clean_prices(_raw_prices(spark, sf), trees=ROUNDS, depth=1)


def _solved(p: int) -> str:
    """CTEs that solve the normal equations of order ``p`` by elimination, one pivot a step; the last is ``w{p}``."""
    used = [0, *range(1, p + 1), 3]
    size, keep = len(used), "event_type, n, yy"
    cells = [f"xx{min(i, j)}{max(i, j)} AS a{r}{c}" for r, i in enumerate(used) for c, j in enumerate(used)]
    parts = [f"e{p}_0 AS (SELECT {keep}, {', '.join(cells)}, {', '.join(f'xy{i} AS b{r}' for r, i in enumerate(used))} FROM sums)"]
    for k in range(size):
        below = [
            (f"a{r}{c} - a{r}{k} / a{k}{k} * a{k}{c} AS a{r}{c}" if r > k else f"a{r}{c}") for r in range(size) for c in range(size)
        ]
        right = [(f"b{r} - a{r}{k} / a{k}{k} * b{k} AS b{r}" if r > k else f"b{r}") for r in range(size)]
        parts.append(f"e{p}_{k + 1} AS (SELECT {keep}, {', '.join(below)}, {', '.join(right)} FROM e{p}_{k})")
    last = f"e{p}_{size}"
    for r in range(size - 1, -1, -1):
        rest = "".join(f" - a{r}{c} * v{c}" for c in range(r + 1, size))
        parts.append(f"v{p}_{r} AS (SELECT *, (b{r}{rest}) / a{r}{r} AS v{r} FROM {last})")
        last = f"v{p}_{r}"
    explained = " + ".join(f"b{r} * b{r} / a{r}{r}" for r in range(size))
    weights = {i: f"v{r}" for r, i in enumerate(used)}
    columns = ", ".join(f"{weights.get(i, '0.0')} AS w{i}" for i in range(4))
    parts.append(f"w{p} AS (SELECT event_type, {p} AS p, n * ln((yy - ({explained})) / n) + {2 * (size + 1)} AS aic, {columns} FROM {last})")
    return ",\n".join(parts)


def _seasonal_sql() -> str:
    x = ["1.0", "z1", "z2", "z3"]
    sums = [f"sum({x[i]} * {x[j]})::DOUBLE AS xx{i}{j}" for i in range(4) for j in range(i, 4)]
    sums += [f"sum({x[i]} * z0)::DOUBLE AS xy{i}" for i in range(4)]
    orders = " UNION ALL ".join(f"SELECT * FROM w{p}" for p in ORDERS)
    season = f"y[-{SEASON}]"
    step = f"{season} + w0 + w1 * (y[-1] - y[-{SEASON + 1}]) + w2 * (y[-2] - y[-{SEASON + 2}]) + w3 * ({season} - y[-{2 * SEASON}])"
    return with_ctes(
        "g",
        body=f""", RECURSIVE_MARK whole AS (SELECT event_type, hour, coalesce(value, CASE WHEN nv IS NOT NULL AND pv IS NOT NULL THEN {LINE} END, pv, nv) AS y
            FROM ({NEAR_SQL.format(source="g")})),
        z AS (SELECT event_type, y - lag(y, 24) OVER w AS z0, lag(y, 1) OVER w - lag(y, 25) OVER w AS z1,
              lag(y, 2) OVER w - lag(y, 26) OVER w AS z2, lag(y, 24) OVER w - lag(y, 48) OVER w AS z3
            FROM whole WINDOW w AS (PARTITION BY event_type ORDER BY hour)),
        sums AS (SELECT event_type, count(*)::DOUBLE AS n, sum(z0 * z0) AS yy, {", ".join(sums)} FROM z WHERE z3 IS NOT NULL GROUP BY 1),
        {", ".join(_solved(p) for p in ORDERS)},
        chosen AS (SELECT * FROM ({orders}) QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY aic, p) = 1),
        tails AS (SELECT event_type, max(hour) AS newest, list(y ORDER BY hour) AS y FROM whole GROUP BY 1),
        path AS (SELECT event_type, newest, p, aic, w0, w1, w2, w3, 0 AS step, y[-{2 * SEASON + 2}:] AS y FROM tails JOIN chosen USING (event_type)
          UNION ALL SELECT event_type, newest, p, aic, w0, w1, w2, w3, step + 1, list_append(y, {step}) FROM path WHERE step < {SEASON})
        SELECT event_type, newest + to_hours(step) AS hour, CAST(step AS BIGINT) AS horizon_h, y[-1] AS predicted, CAST(p AS BIGINT) AS p, aic
        FROM path WHERE step > 0""",
    ).replace("WITH g AS", "WITH RECURSIVE g AS", 1).replace("WITH h AS", "WITH RECURSIVE h AS", 1).replace("RECURSIVE_MARK ", "")


@register("seasonal_ar", _seasonal_sql(), floats=["predicted", "aic"])
def _seasonal(spark, sf):
    return seasonal_ar(series(spark, sf), KEY, "hour", "value", horizon=24)
