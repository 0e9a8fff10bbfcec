"""Schemas of the clinical input tables. Declared, never inferred."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "date": T.DateType(), "timestamp": T.TimestampType(),
}


def _schema(text: str) -> T.StructType:
    """`name type, name type, ...`; needs no running session."""
    pairs = (column.split() for column in text.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


FACT_ENCOUNTER = _schema("""
    facility_cd string, patient_account_nbr string, admission_dt date, admission_tm string, discharge_dt date, discharge_tm string,
    dim_primary_icd10_diag_sk long, dim_encounter_type_sk long, dim_patient_sk long, admit_source_cd string, dim_std_rev_grp_sk long,
    source_system string, emergency_room_flg int, ip_encounters int, icu_flg int, length_of_stay double, encounter_cd_desc string""")
FACT_CLINICAL_ENCOUNTER = _schema("""
    facility_cd string, patient_account_nbr string, encntr_class string, encntr_type string, derived_primary_visit_reason string,
    reason_for_visit string, financial_class string, vip string, do_not_resuscitate_ind string, med_service string""")
FACT_DIAGNOSIS = _schema("dim_diag_sk long, facility_cd string, patient_account_nbr string, present_on_admit string")
DIM_DIAG = _schema("dim_diag_sk long, diag_cd string, diag_typ_cd string, diag_desc string")
DIM_PATIENT = _schema("""
    dim_patient_sk long, medical_record_nbr string, date_of_birth date, sex_cd string, race_desc string, ethnicity_desc string,
    marital_status_desc string""")
DIM_FACILITY = _schema("""
    facility_cd string, facility_type_cd_desc string, group_nm string, regn_nm string, sub_mrkt_nm string, licensed_bed_count double,
    longitude double, latitude double""")
DIM_ENCOUNTER_TYPE = _schema("dim_encounter_type_sk long, admit_type string")
REF_ADMIT_SOURCE = _schema("ub_admit_source_cd string, ub_admit_source_desc string")
DIM_STD_REV_GRP = _schema("dim_std_rev_grp_sk long, srg9_desc string")
EMERGENCY_ARRIVAL = _schema("dim_fac_key long, patient_account_nbr string, arr_dt timestamp, arr_method string")
DIM_FAC = _schema("dim_fac_key long, lvl1_hosp_cd string")
FACT_CLINICAL_ORDER = _schema("""
    facility_cd string, patient_account_nbr string, order_name string, status string, order_written_ts timestamp, powerchart_flg int""")
FACT_CLINICAL_LOCATION = _schema("""
    facility_cd string, patient_account_nbr string, start_ts timestamp, end_ts timestamp, medical_service string, critical_care_flg int,
    powerchart_flg int""")
FINANCIAL_CLASS_MAP = _schema("fin_class string, srg9_desc string, grouping string, count long")
ARRIVAL_MAP = _schema("""
    method string, ed_arrival_cat string, ambulatory int, fire int, ambulance int, assisted int, air int, stretcher int, count long""")
PREDICTIONS = _schema("encounter_id string, hour int, pred double, outcome int")
