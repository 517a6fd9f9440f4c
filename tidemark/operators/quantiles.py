"""Exact quantiles by radix selection: one lazy plan for groups of every size.

Every value has a 64-bit whole number that orders like it. A wanted rank is narrowed down by that
number's digits: a histogram of the leading digit says which digit holds the rank, then only the rows
with that digit go into the next histogram, and so on; the last digit leaves a single value. Rows are
first counted per distinct value, with map-side combining, so ties cost nothing, and the three
steps read that one exchange. A window spans one histogram, whose number of rows the digit's
width bounds; no group of a key's rows ever meets in one task.

NaN is one value, larger than all others; minus zero equals zero; infinities are values like others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.keyed import keyed_join, require_keys

#: Bits below the first and below the second digit. Histograms have at most 2^20, 2^20 and 2^24 rows.
BELOW = (44, 24)


def with_ordered_bits(df: DataFrame, value: str, name: str) -> DataFrame:
    """Add a double column as the 64-bit whole number that orders like it: sign, exponent and fraction, NaN on top.

    The exponent from the logarithm may be one off; comparing the fraction with 1 and 2 mends that. Each step is
    a column of its own, since the next one uses it more than once.
    """
    size, guess, scaled, exponent, fraction = (F.col(f"_{x}") for x in ("size", "guess", "scaled", "exponent", "fraction"))
    steps = {
        "_size": F.abs(F.col(value)),
        # log2 of zero and infinity end at the bounds.
        "_guess": F.greatest(F.lit(-1022.0), F.least(F.lit(1023.0), F.coalesce(F.floor(F.log2(size)).cast("double"), F.lit(-1022.0)))),
        "_scaled": size / F.pow(F.lit(2.0), guess),
        "_exponent": F.when(scaled >= 2, guess + 1).when((scaled < 1) & (guess > -1022), guess - 1).otherwise(guess),
        "_fraction": size / F.pow(F.lit(2.0), exponent),
    }
    for column, expression in steps.items():
        df = df.withColumn(column, expression)
    # Below the smallest normal number the exponent stays, and the fraction has no leading one.
    normal = (exponent + 1023).cast("long") * F.lit(1 << 52) + ((fraction - 1) * F.lit(2.0**52)).cast("long")
    bits = F.when(size == float("inf"), F.lit(2047 << 52)).when(fraction >= 1, normal).otherwise((fraction * F.lit(2.0**52)).cast("long"))
    df = df.withColumn("_magnitude", F.when(F.isnan(value), F.lit((2047 << 52) + 1)).otherwise(bits))
    negative = (F.col(value) < 0) & ~F.isnan(value)
    return df.withColumn(name, F.when(negative, -F.col("_magnitude")).otherwise(F.col("_magnitude"))).drop(*steps, "_magnitude")


def _narrowed(counts: DataFrame, group: list[str], digit: str, carried: Sequence[str]) -> DataFrame:
    """Rows of ``counts`` (group, digit, _c, _before, _ranks, carried) that hold a wanted rank.

    ``_before`` and ``_ranks`` belong to the group; afterwards they belong to the row.
    """
    earlier = W.partitionBy(*group).orderBy(digit).rowsBetween(W.unboundedPreceding, -1)
    placed = counts.withColumn("_before", F.col("_before") + F.coalesce(F.sum("_c").over(earlier), F.lit(0)))
    inside = F.filter("_ranks", lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_c")))
    return placed.withColumn("_ranks", inside).where(F.size("_ranks") > 0).select(*dict.fromkeys([*group, digit]), "_before", "_ranks", *carried)


def quantile_exact(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float],
    names: Sequence[str] | None = None,
    below: tuple[int, int] = BELOW,
) -> DataFrame:
    """Linearly interpolated quantiles of the non-NULL values, one row per key."""
    keys = require_keys(keys)
    names = list(names or [f"q{p:g}" for p in probs])
    number = F.col(value).cast("double")
    # One spelling per value: zero has no sign, NaN one bit pattern.
    number = F.when(F.isnan(number), F.lit(float("nan"))).otherwise(number + F.lit(0.0))
    values = df.where(F.col(value).isNotNull()).select(*keys, number.alias("_v")).groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    digits = with_ordered_bits(values, "_v", "_u")
    digits = digits.withColumns({"_d1": F.shiftright("_u", below[0]), "_d2": F.shiftright("_u", below[1])}).drop("_u")

    top = digits.groupBy(*keys, "_d1").agg(F.sum("_c").alias("_c"))
    top = top.withColumn("_n", F.sum("_c").over(W.partitionBy(*keys)))
    place = [(F.col("_n") - 1) * F.lit(float(p)) for p in probs]
    ranks = F.array_distinct(F.array(*[f(x).cast("long") for x in place for f in (F.floor, F.ceil)]))
    first = _narrowed(top.withColumns({"_before": F.lit(0).cast("long"), "_ranks": ranks}), keys, "_d1", ["_n"])

    middle = keyed_join(digits.select(*keys, "_d1", "_d2", "_c"), first, [*keys, "_d1"])
    middle = middle.groupBy(*keys, "_d1", "_d2", "_before", "_ranks", "_n").agg(F.sum("_c").alias("_c"))
    second = _narrowed(middle, [*keys, "_d1"], "_d2", ["_n"]).drop("_d1")

    last = keyed_join(digits.select(*keys, "_d2", "_v", "_c"), second, [*keys, "_d2"])
    found = _narrowed(last, [*keys, "_d2"], "_v", ["_n"]).select(*keys, "_n", "_v", F.explode("_ranks").alias("_r"))

    at = found.groupBy(*keys).agg(
        F.first("_n").alias("_n"), F.map_from_entries(F.collect_list(F.struct("_r", "_v"))).alias("_at")
    )

    def interpolated(x: Column) -> Column:
        lo, hi = (F.try_element_at(F.col("_at"), f(x).cast("long")) for f in (F.floor, F.ceil))
        share = x - F.floor(x)
        # Between equal values, infinite ones included, and exactly on a value there is nothing to interpolate.
        return F.when((share == 0) | (lo == hi), lo).otherwise(lo + (hi - lo) * share)

    return at.select(*keys, *[interpolated(x).alias(name) for x, name in zip(place, names, strict=True)])


def median_exact(df: DataFrame, keys: Sequence[str], value: str, name: str = "median") -> DataFrame:
    return quantile_exact(df, keys, value, [0.5], [name])
