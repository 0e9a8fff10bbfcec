"""Recoding of categories."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

# Marital status groups; the last rule is a substring test.
MARITAL_GROUPS = {
    "single": ["single"],
    "married": ["married", "life partner", "significant other"],
    "divorced": ["divorced"],
    "separated": ["legally separated"],
}
MARITAL_CONTAINS = {"widow": "widow"}

# Admission sources.
ADMIT_HOSPITAL_TRANSFER = ["transfer from hospital", "transfer from a hospital"]
ADMIT_HEALTHCARE_CONTACT = [
    "transfer from a snf inpatient",
    "hospital transfer",
    "transfer from hospital",
    "transfer from a hospital",
    "transfer from hospice",
    "transfer from another health care facility",
]
ADMIT_UNKNOWN = ["information not available"]
ADMIT_NURSING = ["transfer from a snf inpatient"]

# Present-on-admission codes; U, W and 1 mean unknown.
PRESENT_YES = ("Y", "E")
PRESENT_NO = ("N",)

# Race texts folded into "other", and the ethnicity texts that stand in for a missing race.
RACE_TO_OTHER = ["native american", "pacific islander"]
ETHNICITY_AS_RACE = {"asian/oriental": "asian", "african american/black": "black", "white/caucasian": "white"}


def first_rule(rules: Sequence[tuple[Column, object]], default: object = None) -> Column:
    """Value of the first rule that holds."""
    (test, value), *rest = rules
    out = F.when(test, value)
    for test, value in rest:
        out = out.when(test, value)
    return out.otherwise(default)


def grouped(col: Column, groups: Mapping[str, Sequence[str]], contains: Mapping[str, str] | None = None, default=None) -> Column:
    """Name of the group whose list holds the lower-cased text, then substring rules, then `default`."""
    text = F.lower(col)
    rules = [(text.isin(list(members)), F.lit(name)) for name, members in groups.items()]
    rules += [(text.contains(part), F.lit(name)) for name, part in (contains or {}).items()]
    return first_rule(rules, default)


def marital_status(col: Column) -> Column:
    return grouped(col, MARITAL_GROUPS, MARITAL_CONTAINS)


def admit_source(col: Column) -> Column:
    """Transfers between hospitals under one name, everything else lower-cased."""
    return first_rule(
        [(F.lower(col).isin(ADMIT_HOSPITAL_TRANSFER), F.lit("hospital transfer")), (F.lower(col).isin(ADMIT_UNKNOWN), F.lit(None))],
        F.lower(col),
    )


def admit_source_group(col: Column) -> Column:
    """All transfers from care settings under one name."""
    return first_rule(
        [(F.lower(col).isin(ADMIT_HEALTHCARE_CONTACT), F.lit("healthcare contacts")), (F.lower(col).isin(ADMIT_UNKNOWN), F.lit(None))],
        F.lower(col),
    )


def from_nursing(col: Column) -> Column:
    return F.coalesce(F.lower(col).isin(ADMIT_NURSING), F.lit(False)).cast("int")


def filled(col: Column) -> Column:
    """1 if the value is there, else 0."""
    return col.isNotNull().cast("int")


def entry_route(ip: Column, ed: Column) -> Column:
    """How a visit came in, from its inpatient and emergency flags; null if it is neither."""
    return first_rule([
        ((ip == 1) & (ed == 0), "ip_not_through_ed"),
        ((ip == 1) & (ed == 1), "ed_admitted"),
        ((ip == 0) & (ed == 1), "ed_not_admitted"),
    ])


def carried_in(stretcher: Column, ambulatory: Column, fire: Column, ambulance: Column, unknown: int = -9999) -> Column:
    """Came on a stretcher, or by fire service or ambulance without walking; `unknown` if that cannot be told."""
    test = (stretcher == 1) | ((ambulatory == 0) & ((fire == 1) | (ambulance == 1)))
    return F.coalesce(test.cast("int"), F.lit(unknown))


def any_of(*flags: Column) -> Column:
    """1 if any flag is 1, 0 if all are 0; with three-valued logic for missing flags."""
    test = flags[0] == 1
    for f in flags[1:]:
        test = test | (f == 1)
    return test.cast("int")


def yes_no(flag: Column) -> Column:
    return first_rule([(flag == 1, "yes"), (flag == 0, "no")])


def coded(col: Column, labels: Mapping[object, str]) -> Column:
    """Label of a code; null for any other code."""
    return first_rule([(col == code, F.lit(label)) for code, label in labels.items()])


def merged_race(race: Column, ethnicity: Column) -> Column:
    """One category from race and ethnicity; a hispanic ethnicity wins over no race, "other", "unknown" and "white"."""
    base = F.when(race.isin(RACE_TO_OTHER), F.lit("other")).otherwise(race)
    stand_in = coded(ethnicity, ETHNICITY_AS_RACE)
    filled_race = F.coalesce(base, stand_in)
    open_race = base.isNull() | filled_race.isin("other", "unknown", "white")
    return F.when(open_race & (ethnicity == "hispanic"), F.lit("hispanic")).otherwise(filled_race)


def nonwhite(race: Column) -> Column:
    return first_rule([(race == "white", "White"), (race != "white", "Non-white")])


def present_on_admission(code: Column) -> Column:
    """1 for yes, 0 for no, null for the unknown codes."""
    return first_rule([(code.isin(*PRESENT_YES), 1), (code.isin(*PRESENT_NO), 0)])
