"""The lab and vital panel: one row per encounter and snapshot hour."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.numeric import fill_not_measured
from ..functions.time import within_dates
from ..operators.cohort import drop_matching
from ..operators.panel import SNAPSHOT_HOURS
from ..sources.readers import lower_names, renamed

# Names that mark time columns, and bookkeeping columns of the wide table.
TIME_COLUMN_PATTERNS = ("(_ts)|(dt_tm)$", "time[12]$")
BOOKKEEPING = (
    "encntr_id", "hour_start_ts", "hour_end_ts", "admit_ts", "discharge_ts", "birth_dt_tm", "encounterid_daac",
    "sepsis_narrow", "sepsis_icd", "sepsis_icd2", "v7chfc", "fact_clinical_encounter_unique_id",
)


def extract_panel(wide: DataFrame, first: str, last: str, hours: Sequence[int] = SNAPSHOT_HOURS, min_age: float = 18, slop_days: int = 2) -> DataFrame:
    """All hours in one scan: adults discharged in the period, give or take `slop_days`."""
    rows = lower_names(wide)
    return rows.filter(
        F.col("hour").isin(list(hours)) & (F.col("age_at_admit") >= min_age) & within_dates(F.col("discharge_ts"), first, last, slop_days)
    ).distinct()


def clean_panel(panel: DataFrame, drop: Iterable[str] = BOOKKEEPING) -> DataFrame:
    """Id renamed, time and bookkeeping columns dropped, missing numbers set to "not measured"."""
    named = renamed(panel, {"encounterid": "encounter_id"})
    return fill_not_measured(drop_matching(named, TIME_COLUMN_PATTERNS, drop))
