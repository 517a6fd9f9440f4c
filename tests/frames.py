"""Random keyed series as pandas and Spark frames."""

from __future__ import annotations

import numpy as np
import pandas as pd


def random_series(seed: int, keys: int = 12, rows: int = 120, holes: float = 0.3, drop: float = 0.2) -> pd.DataFrame:
    """Hourly series with NULL cells and missing rows; one key holds a third of all rows."""
    rng = np.random.default_rng(seed)
    parts = []
    for k in range(keys):
        n = rows * keys // 2 if k == 0 else rows
        ts = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n), unit="h")
        v = np.round(rng.normal(50, 20, n), 2)
        v[rng.random(n) < holes] = np.nan
        part = pd.DataFrame({"k": f"k{k}", "ts": ts, "v": v})
        parts.append(part[rng.random(n) >= drop])
    return pd.concat(parts, ignore_index=True).sample(frac=1, random_state=seed).reset_index(drop=True)


def to_spark(spark, pdf: pd.DataFrame, schema: str):
    rows = pdf.astype(object).where(pdf.notna(), None).values.tolist()
    rows = [[x.to_pydatetime() if isinstance(x, pd.Timestamp) else x for x in r] for r in rows]
    return spark.createDataFrame(rows, schema)


def to_pandas(df, by: list[str]) -> pd.DataFrame:
    return df.toPandas().sort_values(by).reset_index(drop=True)


def same(got: pd.DataFrame, want: pd.DataFrame, cols: list[str]) -> None:
    assert len(got) == len(want)
    for c in cols:
        np.testing.assert_allclose(
            got[c].astype(float).to_numpy(), want[c].astype(float).to_numpy(), rtol=1e-9, atol=1e-9, err_msg=c
        )
