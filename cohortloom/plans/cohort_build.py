"""From warehouse tables to one row per encounter with labels and features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.numeric import NOT_MEASURED, never_happened
from ..functions.recode import (
    admit_source, admit_source_group, any_of, carried_in, coded, entry_route, filled, from_nursing, marital_status, merged_race, nonwhite, yes_no,
)
from ..functions.text import joined_key, null_if_lower, null_tokens, tidy
from ..functions.time import age_years, closed_time, from_date_and_time, presentation_time, stay_so_far
from ..operators.codes import (
    CENTRAL_LINE, URINARY_CATHETER, URINARY_CATHETER_EXACT, code_pivot, first_order_times, flags_per_key, with_flags,
)
from ..operators.cohort import CohortRule
from ..operators.dedupe import earliest_event, first_row_per_key
from ..operators.history import history_features
from ..operators.lookup import add_columns, grouped_category, lookup_first
from ..operators.pointintime import first_state, state_at, ward_flags
from ..session import written_once
from ..sources import schemas
from ..sources.readers import read_delimited

KEYS = ["facility_cd", "patient_account_nbr"]

# Label codes, the ones that make the outcome, and history codes (patterns).
LABEL_CODES = {
    "dx_sepsis": ["A4102"],
    "dx_pneumonia": ["J15212"],
    "dx_unspecified": ["A4902"],
    "dx_cause_elsewhere": ["B9562"],
    "dx_carrier": ["Z22322"],
}
OUTCOME = ["dx_sepsis", "dx_pneumonia", "dx_unspecified", "dx_cause_elsewhere"]
HISTORY_PATTERNS = {"hiv": "^B20$", "transplant": "^Z94", "dialysis": "^Z992"}
CODE_TYPE = "ICD10"
RESUSCITATE_LABELS = {"1": "Yes", "2": "No"}


@dataclass(frozen=True)
class Warehouse:
    """The input tables; columns as in `sources.schemas`. The two mappings also have `source_row`, the order of their rows: the first match wins."""

    encounter: DataFrame
    clinical_encounter: DataFrame
    diagnosis: DataFrame
    diagnosis_dim: DataFrame
    patient: DataFrame
    facility: DataFrame
    encounter_type: DataFrame
    admit_source: DataFrame
    revenue_group: DataFrame
    emergency: DataFrame
    emergency_facility: DataFrame
    order: DataFrame
    location: DataFrame
    financial_map: DataFrame
    arrival_map: DataFrame


# Folder name and schema of each table; the two mappings are delimited text.
TABLES = {
    "encounter": ("fact_encounter", schemas.FACT_ENCOUNTER),
    "clinical_encounter": ("fact_clinical_encounter", schemas.FACT_CLINICAL_ENCOUNTER),
    "diagnosis": ("fact_diagnosis", schemas.FACT_DIAGNOSIS),
    "diagnosis_dim": ("dim_diag", schemas.DIM_DIAG),
    "patient": ("dim_patient", schemas.DIM_PATIENT),
    "facility": ("dim_facility", schemas.DIM_FACILITY),
    "encounter_type": ("dim_encounter_type", schemas.DIM_ENCOUNTER_TYPE),
    "admit_source": ("ref_admit_source", schemas.REF_ADMIT_SOURCE),
    "revenue_group": ("dim_std_rev_grp", schemas.DIM_STD_REV_GRP),
    "emergency": ("emrgncy_dept", schemas.EMERGENCY_ARRIVAL),
    "emergency_facility": ("dim_fac", schemas.DIM_FAC),
    "order": ("fact_clinical_order", schemas.FACT_CLINICAL_ORDER),
    "location": ("fact_clinical_location", schemas.FACT_CLINICAL_LOCATION),
}


def open_warehouse(spark: SparkSession, root: str, financial_map: str, arrival_map: str) -> Warehouse:
    """Parquet tables under `root`, by the names above, and two mapping files."""
    tables = {field_: spark.read.schema(schema).parquet(f"{root}/{name}") for field_, (name, schema) in TABLES.items()}
    return Warehouse(
        **tables,
        financial_map=read_delimited(spark, financial_map, schemas.FINANCIAL_CLASS_MAP, row="source_row"),
        arrival_map=read_delimited(spark, arrival_map, schemas.ARRIVAL_MAP, row="source_row"),
    )


@dataclass(frozen=True)
class BuildOptions:
    rule: CohortRule
    as_of: str
    seed: int = 124800
    state_hours: int = 3
    label_codes: Mapping[str, Sequence[str]] = field(default_factory=lambda: dict(LABEL_CODES))
    outcome: Sequence[str] = tuple(OUTCOME)
    history_patterns: Mapping[str, str] = field(default_factory=lambda: dict(HISTORY_PATTERNS))


def coded_diagnoses(w: Warehouse) -> DataFrame:
    """Diagnosis facts with their code; only codes of the wanted type."""
    dim = w.diagnosis_dim.filter(F.col("diag_typ_cd") == CODE_TYPE).select("dim_diag_sk", "diag_cd")
    return w.diagnosis.join(dim, "dim_diag_sk").select(*KEYS, "diag_cd", "present_on_admit")


def first_arrivals(w: Warehouse) -> DataFrame:
    """First emergency arrival per encounter; built once and used wherever it is needed."""
    rows = w.emergency.join(w.emergency_facility, "dim_fac_key").withColumnRenamed("lvl1_hosp_cd", "facility_cd")
    return earliest_event(rows, KEYS, "arr_dt", ["arr_method"], {"ed_arrival_ts": "arr_dt", "ed_arrival_method": "arr_method"})


def base_encounters(w: Warehouse) -> DataFrame:
    """Encounters with ids, patient, times and age."""
    e = w.encounter.withColumns({
        "encounter_id": joined_key(*KEYS),
        "admit_ts": from_date_and_time(F.col("admission_dt"), F.col("admission_tm")),
        "discharge_ts": closed_time(F.col("discharge_dt"), F.col("discharge_tm")),
    })
    return e.join(w.patient, "dim_patient_sk", "left").withColumns({
        "patient_id": joined_key("facility_cd", "medical_record_nbr"),
        "age": age_years(F.col("admit_ts"), F.col("date_of_birth")),
    })


def cohort_encounters(w: Warehouse, o: BuildOptions) -> DataFrame:
    """The index encounters, one row each, with presentation time."""
    in_period = o.rule.visits(ed="emergency_room_flg", ip="ip_encounters", age="age", discharge="discharge_dt", source="source_system")
    places = w.facility.filter(o.rule.facilities(kind="facility_type_cd_desc", group="group_nm", code="facility_cd"))
    rows = base_encounters(w).filter(in_period).join(places, "facility_cd")
    # Keyed like the fact tables, so the joins that follow share this partitioning.
    one = first_row_per_key(rows, KEYS, ["admit_ts", "discharge_ts", "dim_patient_sk"])
    timed = one.join(first_arrivals(w), KEYS, "left")
    return timed.withColumns({
        "presentation_ts": presentation_time(F.col("admit_ts"), F.col("ed_arrival_ts")),
        "stay_so_far": stay_so_far(F.col("admission_dt"), F.col("discharge_ts"), F.lit(o.as_of).cast("date")),
    })


def describe_encounters(w: Warehouse, o: BuildOptions, cohort: DataFrame) -> DataFrame:
    """Add clinical texts, cleaned categories, labels and the outcome."""
    primary = w.diagnosis_dim.select(
        F.col("dim_diag_sk").alias("dim_primary_icd10_diag_sk"), F.col("diag_cd").alias("primary_dx_cd"), F.col("diag_desc").alias("primary_dx_desc")
    )
    clinical = first_row_per_key(w.clinical_encounter, KEYS, [c for c in w.clinical_encounter.columns if c not in KEYS])
    rows = (
        cohort.join(clinical, KEYS, "left")
        .join(primary, "dim_primary_icd10_diag_sk", "left")
        .join(w.encounter_type, "dim_encounter_type_sk", "left")
        .join(w.admit_source.withColumnRenamed("ub_admit_source_cd", "admit_source_cd"), "admit_source_cd", "left")
        .join(w.revenue_group, "dim_std_rev_grp_sk", "left")
    )
    source = F.col("ub_admit_source_desc")
    rows = rows.withColumns({
        "ed_arrival_method": F.lower("ed_arrival_method"),
        "primary_visit_reason": tidy(F.col("derived_primary_visit_reason"), "left"),
        "reason_for_visit": tidy(F.col("reason_for_visit"), "left"),
        "race_desc": tidy(F.col("race_desc"), "right"),
        "ethnicity_desc": tidy(F.col("ethnicity_desc"), "right"),
        "marital_status": marital_status(F.col("marital_status_desc")),
        "financial_class": F.lower("financial_class"),
        "vip": filled(F.col("vip")),
        "admit_source": admit_source(source),
        "admit_source_group": admit_source_group(source),
        "from_nursing": from_nursing(source),
    }).drop("derived_primary_visit_reason", "marital_status_desc", "ub_admit_source_desc")
    rows = null_tokens(rows)
    rows = rows.withColumns({
        "sex_cd": null_if_lower(F.col("sex_cd"), "u"),
        "entry_route": entry_route(F.col("ip_encounters"), F.col("emergency_room_flg")),
        "race": merged_race(F.col("race_desc"), F.col("ethnicity_desc")),
        "do_not_resuscitate": coded(F.col("do_not_resuscitate_ind"), RESUSCITATE_LABELS),
    })
    rows = rows.withColumn("nonwhite", nonwhite(F.col("race")))
    rows = grouped_category(
        rows, w.financial_map, on="financial_class", key="fin_class", base="srg9_desc", override="grouping", out="financial_class_cat",
        order=["source_row"],
    )
    modes = ["ambulatory", "fire", "ambulance", "assisted", "air", "stretcher"]
    rows = lookup_first(
        rows, w.arrival_map, on="ed_arrival_method", key="method", take={f"arrival_{m}": m for m in modes}, order=["source_row"]
    )
    rows = rows.withColumn(
        "carried_in", carried_in(*[F.col(f"arrival_{m}") for m in ("stretcher", "ambulatory", "fire", "ambulance")], unknown=NOT_MEASURED)
    )
    labels = code_pivot(coded_diagnoses(w), KEYS, "diag_cd", o.label_codes, present="present_on_admit")
    rows = with_flags(rows, labels, KEYS, list(o.label_codes))
    rows = rows.withColumn("outcome", any_of(*[F.col(c) for c in o.outcome]))
    return rows.withColumn("outcome_yn", yes_no(F.col("outcome")))


def order_features(w: Warehouse) -> DataFrame:
    """Per encounter: catheter and central line orders as 0/1, and the first time of each."""
    rules = {"urinary_cath": (URINARY_CATHETER, URINARY_CATHETER_EXACT), "central_line": (CENTRAL_LINE, ())}
    return first_order_times(
        w.order, KEYS, text="order_name", status="status", written="order_written_ts", rules=rules, system_flag="powerchart_flg"
    )


def prior_encounters(w: Warehouse, o: BuildOptions) -> DataFrame:
    """All finished emergency or inpatient encounters with history code flags, one row each."""
    e = base_encounters(w).filter(
        F.col("discharge_ts").isNotNull() & F.col("medical_record_nbr").isNotNull() & ((F.col("ip_encounters") == 1) | (F.col("emergency_room_flg") == 1))
    )
    flags = flags_per_key(coded_diagnoses(w), KEYS, {n: F.col("diag_cd").rlike(p) for n, p in o.history_patterns.items()})
    one = first_row_per_key(e, KEYS, ["discharge_ts", "dim_patient_sk"])
    return with_flags(one, flags, KEYS, list(o.history_patterns))


def encounter_history(w: Warehouse, o: BuildOptions, cohort: DataFrame) -> DataFrame:
    return history_features(
        cohort.select("encounter_id", "facility_cd", "medical_record_nbr", "presentation_ts"),
        prior_encounters(w, o),
        keys=["facility_cd", "medical_record_nbr"], index_id="encounter_id", index_ts="presentation_ts",
        prior_id="encounter_id", prior_ts="discharge_ts", count_as="num_encounters_past_year",
        since={"time_since_last_ed": "emergency_room_flg", "time_since_last_ip": "ip_encounters", "time_since_last_ic": "icu_flg"},
        ever={f"any_prev_{n}": n for n in o.history_patterns}, latest={"last_ip_los": ("ip_encounters", "length_of_stay")},
        size_from=w.encounter.join(w.patient, "dim_patient_sk").select("facility_cd", "medical_record_nbr"),
    )


def with_history(rows: DataFrame, history: DataFrame, o: BuildOptions) -> DataFrame:
    """Add the history; without any, counts are 0 and "days since" is a large number drawn from the encounter."""
    out = rows.join(history, "encounter_id", "left")
    out = out.fillna(0, subset=["num_encounters_past_year", "last_ip_los", *[f"any_prev_{n}" for n in o.history_patterns]])
    since = ["time_since_last_ed", "time_since_last_ip", "time_since_last_ic"]
    return out.withColumns({c: never_happened(F.col(c), f"{o.seed}:{c}", F.col("encounter_id")) for c in since})


def location_features(w: Warehouse, o: BuildOptions, cohort: DataFrame) -> DataFrame:
    """First ward with its start and critical-care flag, ward at presentation + n hours, and kind of ward by then; only
    encounters with a ward at that time."""
    known = w.location.filter(F.col("powerchart_flg") == 1)
    anchors = cohort.select(*KEYS, "presentation_ts")
    now = state_at(anchors, known, KEYS, anchor="presentation_ts", hours=o.state_hours, start="start_ts", end="end_ts", tie=["end_ts", "medical_service"])
    keep = {"first_location": "medical_service", "first_location_start_ts": "start_ts", "first_location_critical_care": "critical_care_flg"}
    first = first_state(w.location, KEYS, start="start_ts", tie=["end_ts", "medical_service"], keep=keep)
    rows = now.join(first, KEYS, "left").select(
        *KEYS, F.lower("first_location").alias("first_location"), "first_location_start_ts", "first_location_critical_care",
        F.lower("medical_service").alias("location_now"),
        F.col("critical_care_flg").alias("in_critical_care"),
    )
    return rows.withColumns(ward_flags(F.col("first_location"), F.col("location_now")))


def build_main_table(w: Warehouse, o: BuildOptions) -> DataFrame:
    """One row per index encounter: description, labels, orders, history and location.

    The cohort is read three times, so it is written once.
    """
    cohort = written_once(cohort_encounters(w, o))
    rows = describe_encounters(w, o, cohort)
    rows = add_columns(rows, order_features(w), KEYS).fillna(0, subset=["urinary_cath", "central_line"])
    where = location_features(w, o, cohort)
    flags = [c for c in where.columns if c not in (*KEYS, "first_location", "first_location_start_ts", "location_now")]
    rows = add_columns(rows, where, KEYS).fillna(NOT_MEASURED, subset=flags)
    return with_history(rows, encounter_history(w, o, cohort), o)
