"""Load figures and guards gathered while rows are written: no second pass, and a build stops before anybody reads a bad table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, functions as F

from ..session import written_once


class LoadError(ValueError):
    """Figures of a written table are outside their limits; `broken` says which."""

    def __init__(self, broken: Mapping[str, str]):
        super().__init__("; ".join(f"{k}: {v}" for k, v in broken.items()))
        self.broken = dict(broken)


@dataclass(frozen=True)
class Limits:
    """What a load may look like. `most_missing` is the allowed share of nulls per column; `checks` are conditions that no row may break."""

    least_rows: int = 0
    most_rows: int | None = None
    most_missing: Mapping[str, float] = field(default_factory=dict)
    checks: Mapping[str, Column] = field(default_factory=dict)


@dataclass(frozen=True)
class Load:
    """A written table and its figures."""

    rows: DataFrame
    figures: Mapping[str, object]

    def table(self) -> DataFrame:
        """figure, value (as text): one row per figure."""
        spark = self.rows.sparkSession
        return spark.createDataFrame([(k, None if v is None else str(v)) for k, v in self.figures.items()], "figure string, value string")


def observed_write(df: DataFrame, limits: Limits | None = None, *, columns: Sequence[str] = (), ranges: Sequence[str] = (), join: tuple[DataFrame, Sequence[str]] | None = None, how: str = "left") -> Load:
    """Write `df` and gather, in the same job: rows, nulls of `columns`, least and greatest of `ranges`, rows that break a check.

    With `join` = (other table, keys) the joined rows are written, rows of `df` are counted before the join and after it, and
    `fan_out` is by how many the join made them more (fewer: negative). Raises LoadError if a figure is outside `limits`.
    """
    limits = limits or Limits()
    before, after = Observation(), Observation()
    work = df
    if join is not None:
        other, keys = join
        work = df.observe(before, F.count(F.lit(1)).alias("rows_before_join")).join(other, list(keys), how)
    every = list(dict.fromkeys([*columns, *limits.most_missing]))
    figures = [F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"missing {c}") for c in every]]
    figures += [f(c).cast("string").alias(f"{name} {c}") for c in ranges for name, f in (("least", F.min), ("greatest", F.max))]
    figures += [F.count_if(~F.coalesce(ok, F.lit(False))).alias(f"broken {name}") for name, ok in limits.checks.items()]
    rows = written_once(work.observe(after, *figures))
    found = dict(after.get)
    if join is not None:
        found["rows_before_join"] = before.get["rows_before_join"]
        found["fan_out"] = found["rows"] - found["rows_before_join"]
    n, broken = found["rows"], {}
    if n < limits.least_rows or (limits.most_rows is not None and n > limits.most_rows):
        broken["rows"] = str(n)
    for c, share in limits.most_missing.items():
        if found[f"missing {c}"] > share * n:
            broken[f"missing {c}"] = f"{found[f'missing {c}']} of {n}"
    for name in limits.checks:
        if found[f"broken {name}"]:
            broken[name] = f"{found[f'broken {name}']} rows"
    if broken:
        raise LoadError(broken)
    return Load(rows, found)


def fan_out_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys that `df` holds more than once, with their number, most first: what to look at when a join fans out."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").orderBy(F.desc("n"), *keys)
