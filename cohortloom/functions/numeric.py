"""Numbers, bins, rates and reproducible random values."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Fixed values: "not measured", pounds per kilogram, the 97.5 % normal quantile.
NOT_MEASURED = -9999
POUNDS_PER_KG = 2.2046
Z_975 = 1.959963984540054


def fill_not_measured(df: DataFrame, columns: Iterable[str] | None = None, value: float = NOT_MEASURED) -> DataFrame:
    """Put an extreme value for missing numbers; text columns stay as they are."""
    if columns is None:
        columns = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    return df.fillna(value, subset=list(columns))


def measured(col: Column) -> Column:
    return col != NOT_MEASURED


def left_closed_bin(col: Column, low: float, high: float, width: float) -> Column:
    """Label `[a,b)` of the equal-width bin, null outside `[low, high)`."""
    start = F.floor((col - low) / width) * width + low
    whole = float(low).is_integer() and float(width).is_integer()
    ends = [c.cast("long").cast("string") if whole else c.cast("string") for c in (start, start + width)]
    return F.when((col >= low) & (col < high), F.concat(F.lit("["), ends[0], F.lit(","), ends[1], F.lit(")")))


def normal_bounds(rate: Column, n: Column) -> tuple[Column, Column]:
    """95 % normal interval of a proportion."""
    half = Z_975 * F.sqrt(rate * (1 - rate) / n)
    return rate - half, rate + half


def shock_index(heart_rate: Column, systolic: Column) -> Column:
    return heart_rate / F.nullif(systolic, F.lit(0).cast("double"))


def shock_index_by_age(heart_rate: Column, systolic: Column, age: Column) -> Column:
    return shock_index(heart_rate, systolic) * age


def hash_number(seed: int | str, *key: Column) -> Column:
    """A number in [0, 2**32) from the seed and the key alone: same row, same number, however the data is cut."""
    return F.conv(F.substring(hash_text(seed, *key), 1, 8), 16, 10).cast("long")


def hash_text(seed: int | str, *key: Column) -> Column:
    """md5 of `seed:key[:key...]`."""
    parts = [F.lit(str(seed))]
    for k in key:
        parts += [F.lit(":"), k.cast("string")]
    return F.md5(F.concat(*parts))


def never_happened(col: Column, seed: int | str, *key: Column, low: int = 2000, high: int = 4000) -> Column:
    """Fill a missing "days since" with a large number drawn from the key."""
    return F.coalesce(col, F.lit(low) + F.pmod(hash_number(seed, *key), F.lit(high - low)))


def cost_ratio(prevalence: float, cost: float) -> float:
    """Weight of specificity when a missed case costs `cost` times a false alarm."""
    return (1 - prevalence) / (cost * prevalence)


def row_sum(*cols: str) -> Column:
    """Sum over columns of one row; null if any of them is null."""
    total = F.col(cols[0])
    for c in cols[1:]:
        total = total + F.col(c)
    return total
