"""Flags from code and order tables, one pass over the facts for all of them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.recode import present_on_admission
from ..functions.text import any_phrase, flag_or_null
from ..functions.time import within_dates

# Word groups that mark an order as a catheter or a central line. All words of a group must occur.
URINARY_CATHETER = [["urin", "cath", "insert"], ["uret", "cath", "insert"], ["foley", "cath", "insert"]]
URINARY_CATHETER_EXACT = ["foley catheterization"]
CENTRAL_LINE = [
    ["central line", "insert"],
    ["picc", "insert"],
    ["cvc", "insert"],
    ["cv", "cath", "insert"],
    ["port", "cath", "insert"],
]
# Status texts of a finished order.
DONE_STATUS = ("completed", "comp")
# Patterns on ward names.
WARD_PATTERNS = {
    "trauma_ward": "trauma",
    "ob_location": "obstetrics|labor",
    "surg_location": "surgical|cardiac surg|surg/inv diag|surg/diag obs",
    "rehab_location": "rehab",
}


def flags_per_key(facts: DataFrame, keys: Sequence[str], rules: Mapping[str, Column]) -> DataFrame:
    """0/1 per key and rule: does any row of the key satisfy it. Only keys with at least one hit are returned."""
    anything = None
    for test in rules.values():
        anything = test if anything is None else anything | test
    hits = facts.filter(anything)
    return hits.groupBy(*keys).agg(*[F.max(F.when(test, 1).otherwise(0)).alias(name) for name, test in rules.items()])


def code_pivot(facts: DataFrame, keys: Sequence[str], code: str, codes: Mapping[str, Sequence[str]], present: str | None = None) -> DataFrame:
    """Per key one 0/1 column for each code list and, with `present`, `<name>_poa` (1, 0 or null).

    A key that has a code twice with different marks gets the stronger one: yes, then no, then unknown.
    """
    wanted = sorted({c for group in codes.values() for c in group})
    hits = facts.filter(F.col(code).isin(wanted))
    aggs = []
    for name, group in codes.items():
        test = F.col(code).isin(list(group))
        aggs.append(F.max(F.when(test, 1).otherwise(0)).alias(name))
        if present is not None:
            aggs.append(F.max(F.when(test, present_on_admission(F.col(present)))).alias(f"{name}_poa"))
    return hits.groupBy(*keys).agg(*aggs)


def with_flags(df: DataFrame, flags: DataFrame, on: Sequence[str], zero: Sequence[str]) -> DataFrame:
    """Left join of a flag table; keys without a row get 0 in the `zero` columns."""
    return df.join(flags, list(on), "left").fillna(0, subset=list(zero))


def first_order_times(
    orders: DataFrame,
    keys: Sequence[str],
    *,
    text: str,
    status: str,
    written: str,
    rules: Mapping[str, tuple[Sequence[Sequence[str]], Sequence[str]]],
    done: Sequence[str] = DONE_STATUS,
    system_flag: str | None = None,
) -> DataFrame:
    """Per key and kind of finished order: `<name>` 0/1 and the earliest time `<name>_ts`.

    `rules = {name: (word groups, exact texts)}`. Only keys with at least one such order are returned.
    """
    tests = {name: any_phrase(F.col(text), groups, exact) for name, (groups, exact) in rules.items()}
    anything = None
    for test in tests.values():
        anything = test if anything is None else anything | test
    finished = orders.filter(F.lower(F.col(status)).isin(list(done)) & anything)
    if system_flag is not None:
        finished = finished.filter(flag_or_null(F.col(system_flag)))
    return finished.groupBy(*keys).agg(
        *[F.max(F.when(t, 1).otherwise(0)).alias(n) for n, t in tests.items()],
        *[F.min(F.when(t, F.col(written))).alias(f"{n}_ts") for n, t in tests.items()],
    )


def exposures(
    given: DataFrame,
    orders: DataFrame,
    drugs: DataFrame,
    classes: DataFrame,
    *,
    therapeutic_class: str,
    first_day: str,
    last_day: str,
    statuses: Sequence[str],
) -> DataFrame:
    """Drugs of one class given in a period, with the order each came from.

    Expected columns: given(unique_id, status, discharge_dt, ...), orders(source_id,
    order_id, catalog_cd), drugs(medication_cd, ...), classes(medication_cd, class_name).
    Ids are `source~order` and `source~catalog`. Filters run before the joins.
    """
    period = given.filter(
        within_dates(F.col("discharge_dt"), first_day, last_day)
        & F.col("status").isin(list(statuses))
    )
    keyed = orders.select(
        "source_id",
        "order_id",
        F.concat("source_id", F.lit("~"), F.col("order_id").cast("string")).alias("unique_id"),
        F.concat("source_id", F.lit("~"), F.col("catalog_cd").cast("string")).alias("medication_cd"),
    )
    wanted = classes.filter(F.upper("class_name") == therapeutic_class)
    return period.join(keyed, "unique_id").join(drugs, "medication_cd").join(wanted, "medication_cd")
