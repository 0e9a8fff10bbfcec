"""Who is in the cohort."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.time import within_dates


@dataclass(frozen=True)
class CohortRule:
    """Typed parameters in place of spliced query text."""

    first_discharge: str
    last_discharge: str
    min_age: float = 18
    source_system: str | None = None
    excluded_groups: Sequence[str] = ()
    excluded_facilities: Sequence[str] = ()
    facility_type: str | None = None

    def visits(self, *, ed: str, ip: str, age: str, discharge: str, source: str | None = None) -> Column:
        """Emergency or inpatient, old enough, discharged in the period."""
        test = ((F.col(ed) == 1) | (F.col(ip) == 1)) & (F.col(age) >= self.min_age)
        test &= within_dates(F.col(discharge), self.first_discharge, self.last_discharge)
        if self.source_system is not None and source is not None:
            test &= F.col(source) == self.source_system
        return test

    def facilities(self, *, kind: str, group: str, code: str) -> Column:
        """Right type, a known group, none of the excluded ones. A missing value is never kept."""
        test = F.col(group).isNotNull()
        if self.facility_type is not None:
            test &= F.col(kind) == self.facility_type
        if self.excluded_groups:
            test &= ~F.col(group).isin(list(self.excluded_groups))
        if self.excluded_facilities:
            test &= ~F.col(code).isin(list(self.excluded_facilities))
        return test


def star_join(fact: DataFrame, dims: Iterable[tuple[DataFrame, str, str]]) -> DataFrame:
    """Left join of dimensions by `(dimension, fact key, dimension key)`; the dimension key column is dropped."""
    out = fact
    for dim, fact_key, dim_key in dims:
        renamed = dim.withColumnRenamed(dim_key, f"_{dim_key}")
        out = out.join(renamed, out[fact_key] == renamed[f"_{dim_key}"], "left").drop(f"_{dim_key}")
    return out


def drop_matching(df: DataFrame, patterns: Sequence[str], names: Iterable[str] = ()) -> DataFrame:
    """Drop the named columns and those whose name matches a pattern."""
    gone = set(names) | {c for c in df.columns if any(re.search(p, c) for p in patterns)}
    return df.select(*[c for c in df.columns if c not in gone])


def labelled(df: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Attach a readable label to columns as metadata."""
    for name, text in labels.items():
        df = df.withMetadata(name, {"label": text})
    return df
