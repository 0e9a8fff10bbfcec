from __future__ import annotations

from datetime import date, datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from cohortloom.operators.cohort import CohortRule
from cohortloom.operators.model import Boosting
from cohortloom.plans.cohort_build import TABLES, BuildOptions, Warehouse, build_main_table, open_warehouse
from cohortloom.plans.panel_build import clean_panel, extract_panel
from cohortloom.plans.risk import RiskOptions, merge_panel, train_and_evaluate
from cohortloom.sources import schemas as s

RULE = CohortRule("2016-01-01 00:00:00", "2017-12-01 00:00:00", 18, "MAIN", ["GONE"], ["KID"], "Acute")


def encounter(account, day, out_day, patient, ed=1, ip=0, icu=0, los=1.0, place="H1", source="1", system="MAIN", dx=None, out_time=None):
    return (place, account, day, "10:00:00", out_day, out_time or ("00:00:00" if out_day == date(1, 1, 1) else "09:30:00"), dx, 1, patient, source, 1, system, ed, ip, icu, los, "x")


@pytest.fixture(scope="module")
def main(spark, tmp_path_factory):
    """Built from files: the frames are written out and opened again."""
    make = spark.createDataFrame
    w = Warehouse(
        encounter=make([
            encounter("1", date(2017, 3, 1), date(2017, 3, 4), 10, ed=1, ip=1, dx=5),
            encounter("1", date(2017, 3, 1), date(2017, 3, 4), 10, ed=1, ip=1, dx=5),                 # listed twice
            encounter("2", date(2017, 2, 1), date(2017, 2, 3), 10, ed=0, ip=1, los=2.0),
            encounter("3", date(2015, 6, 1), date(2015, 6, 2), 10, ed=1, ip=0),                       # before the period: history only
            encounter("4", date(2017, 4, 1), date(1, 1, 1), 11),                                      # still in house
            encounter("5", date(2017, 4, 1), date(2017, 4, 2), 12),                                   # a child
            encounter("6", date(2017, 4, 1), date(2017, 4, 2), 11, place="KID"),
            encounter("7", date(2017, 4, 1), date(2017, 4, 2), 11, system="OTHER"),
            encounter("8", date(2017, 5, 1), date(2017, 5, 2), 11, ed=1, ip=0, source="9"),
            encounter("9", date(2017, 5, 1), date(2017, 5, 2), 11, ed=0, ip=0),
            encounter("10", date(2017, 2, 20), date(1, 1, 1), 10, ed=1, ip=1, los=99.0, out_time="09:30:00"),  # still in house: no history, whatever the time
        ], s.FACT_ENCOUNTER),
        clinical_encounter=make([
            ("H1", "1", "c", "t", "  Fever ", " Wound", "SELF", "yes", "1", "MED"), ("H1", "8", "c", "t", None, None, "QQQ", None, "7", "unknown"),
        ], s.FACT_CLINICAL_ENCOUNTER),
        diagnosis=make([
            (1, "H1", "1", "N"), (1, "H1", "1", "Y"), (2, "H1", "1", "U"), (3, "H1", "2", "Y"), (4, "H1", "8", "Y"), (6, "H1", "3", "Y"),
        ], s.FACT_DIAGNOSIS),
        diagnosis_dim=make([
            (1, "A4102", "ICD10", "d"), (2, "Z22322", "ICD10", "d"), (3, "B20", "ICD10", "d"), (4, "A4902", "ICD9", "d"), (5, "L03", "ICD10", "skin"),
            (6, "Z9481", "ICD10", "d"),
        ], s.DIM_DIAG),
        patient=make([
            (10, "m10", date(1960, 1, 1), "F", None, "hispanic", "Widowed"), (11, "m11", date(1980, 1, 1), "U", "white  ", "unknown", "Single"),
            (12, "m12", date(2010, 1, 1), "M", "black", None, None),
        ], s.DIM_PATIENT),
        facility=make([("H1", "Acute", "North", "r", "m", 200.0, 1.0, 2.0), ("KID", "Acute", "North", "r", "m", 50.0, 1.0, 2.0)], s.DIM_FACILITY),
        encounter_type=make([(1, "Emergency")], s.DIM_ENCOUNTER_TYPE),
        admit_source=make([("1", "Transfer from hospital"), ("9", "Information Not Available")], s.REF_ADMIT_SOURCE),
        revenue_group=make([(1, "MEDICARE")], s.DIM_STD_REV_GRP),
        emergency=make([
            (7, "1", datetime(2017, 3, 1, 8), "Ambulance"), (7, "1", datetime(2017, 3, 1, 7), "Car"), (7, "1", None, "Car"),
            (7, "8", datetime(2017, 5, 1, 11), "Fire"),
        ], s.EMERGENCY_ARRIVAL),
        emergency_facility=make([(7, "H1")], s.DIM_FAC),
        order=make([
            ("H1", "1", "PICC line insertion", "Comp", datetime(2017, 3, 2), 1), ("H1", "1", "CVC insert", "completed", datetime(2017, 3, 1, 12), None),
            ("H1", "1", "foley catheterization", "Completed", datetime(2017, 3, 1, 13), 0), ("H1", "8", "foley catheterization", "ordered", datetime(2017, 5, 1), 1),
        ], s.FACT_CLINICAL_ORDER),
        location=make([
            ("H1", "1", datetime(2017, 3, 1, 7), datetime(2017, 3, 1, 9), "Trauma Bay", 0, 1),
            ("H1", "1", datetime(2017, 3, 1, 9), datetime(2017, 3, 3), "Surgical ICU", 1, 1),
            ("H1", "8", datetime(2017, 5, 1, 13), datetime(2017, 5, 1, 20), "Rehab", 0, 0),
        ], s.FACT_CLINICAL_LOCATION),
        financial_map=make([("self", "ZED", "uninsured", 3), ("self", "ALPHA", "alpha", 3), ("medicaid", "MEDICAID", None, 3)], s.FINANCIAL_CLASS_MAP),
        arrival_map=make([("car", "walk", 1, 0, 0, 0, 0, 0, 5), ("car", "a car", 0, 0, 1, 0, 0, 1, 5), ("fire", "fire", 0, 1, 0, 0, 0, 0, 5)], s.ARRIVAL_MAP),
    )
    root = tmp_path_factory.mktemp("warehouse")
    for name, (folder, _) in TABLES.items():
        getattr(w, name).write.parquet(f"{root}/{folder}")
    w.financial_map.coalesce(1).write.csv(f"{root}/financial.csv", header=True)  # the first match in the file wins
    w.arrival_map.coalesce(1).write.csv(f"{root}/arrival.csv", header=True)
    w = open_warehouse(spark, str(root), f"{root}/financial.csv", f"{root}/arrival.csv")
    return {r["encounter_id"]: r for r in build_main_table(w, BuildOptions(RULE, as_of="2018-01-01")).collect()}


def test_cohort_is_one_row_per_encounter(main):
    assert sorted(main) == ["H1:1", "H1:2", "H1:8"]


def test_times_and_description(main):
    r = main["H1:1"]
    assert r["presentation_ts"] == datetime(2017, 3, 1, 7) and r["admit_ts"] == datetime(2017, 3, 1, 10) and r["stay_so_far"] == 3
    assert r["age"] == 57.2 and r["patient_id"] == "H1:m10" and r["entry_route"] == "ed_admitted"
    assert (r["primary_visit_reason"], r["reason_for_visit"], r["primary_dx_cd"]) == ("fever ", "wound", "L03")
    assert (r["marital_status"], r["race"], r["nonwhite"]) == ("widow", "hispanic", "Non-white")
    assert r["admit_type"] == "Emergency"
    assert (r["admit_source"], r["admit_source_group"], r["from_nursing"]) == ("hospital transfer", "healthcare contacts", 0)
    assert (r["financial_class_cat"], r["vip"], r["do_not_resuscitate"], r["carried_in"]) == ("uninsured", 1, "Yes", 0)
    q = main["H1:8"]
    assert q["presentation_ts"] == datetime(2017, 5, 1, 10) and q["sex_cd"] is None and q["race"] == "white" and q["med_service"] is None
    assert (q["admit_source"], q["financial_class_cat"], q["vip"], q["do_not_resuscitate"], q["carried_in"]) == (None, "other", 0, None, 1)
    assert main["H1:2"]["carried_in"] == -9999 and main["H1:2"]["financial_class_cat"] is None


def test_labels(main):
    r = main["H1:1"]
    assert (r["dx_sepsis"], r["dx_sepsis_poa"], r["dx_carrier"], r["dx_carrier_poa"], r["outcome"], r["outcome_yn"]) == (1, 1, 1, None, 1, "yes")
    # The code of another code system does not count, nor does the carrier code alone.
    assert main["H1:8"]["dx_unspecified"] == 0 and main["H1:8"]["outcome"] == 0


def test_orders_history_and_location(main):
    r, q = main["H1:1"], main["H1:8"]
    assert (r["central_line"], r["central_line_ts"], r["urinary_cath"]) == (1, datetime(2017, 3, 1, 12), 0)
    assert (q["central_line"], q["urinary_cath"]) == (0, 0)
    assert (r["num_encounters_past_year"], r["last_ip_los"], r["time_since_last_ip"]) == (1, 2.0, 25)
    assert (r["any_prev_hiv"], r["any_prev_transplant"], r["any_prev_dialysis"]) == (1, 1, 0)
    assert r["time_since_last_ed"] == (datetime(2017, 3, 1, 7) - datetime(2015, 6, 2, 9, 30)).days
    assert 2000 <= r["time_since_last_ic"] < 4000
    assert (r["first_location"], r["location_now"], r["in_critical_care"], r["trauma_ward"], r["surg_location"]) == ("trauma bay", "surgical icu", 1, 1, 1)
    assert (r["first_location_start_ts"], r["first_location_critical_care"]) == (datetime(2017, 3, 1, 7), 0)
    assert (q["first_location_start_ts"], q["first_location_critical_care"]) == (None, -9999)
    # History of patient 11: encounters 6 and 7 are out of the cohort but only 7 is at this site.
    assert (q["num_encounters_past_year"], q["last_ip_los"]) == (1, 0.0)
    assert (q["location_now"], q["rehab_location"], q["in_critical_care"]) == (None, -9999, -9999)


def test_panel_extract_and_cleaning(spark):
    wide = spark.createDataFrame([
        ("a", 1, 40.0, datetime(2016, 1, 5), datetime(2016, 1, 1), 7.5, None, "n"), ("a", 1, 40.0, datetime(2016, 1, 5), datetime(2016, 1, 1), 7.5, None, "n"),
        ("a", 2, 40.0, datetime(2016, 1, 5), None, 7.5, 1.0, "n"), ("b", 6, 17.0, datetime(2016, 1, 5), None, 7.5, 1.0, "n"),
        ("c", 6, 70.0, datetime(2015, 12, 30), None, None, 1.0, None),
    ], "ENCOUNTERID string, HOUR int, AGE_AT_ADMIT double, DISCHARGE_TS timestamp, BIRTH_DT_TM timestamp, WBC_LAST double, TEMP_MAX double, NOTE string")
    out = clean_panel(extract_panel(wide, "2016-01-01 00:00:00", "2017-11-01 00:00:00"))
    assert rows(out, "encounter_id") == [("a", 1, 40.0, 7.5, -9999.0, "n"), ("c", 6, 70.0, -9999.0, 1.0, None)]
    assert out.columns == ["encounter_id", "hour", "age_at_admit", "wbc_last", "temp_max", "note"]


def test_train_and_evaluate(spark):
    hours = [1, 3, 6]
    main = spark.createDataFrame([(f"e{i}", None if i == 0 else int(i % 5 == 0), "xyz"[i % 3] if i % 7 else None, float(i % 11)) for i in range(300)],
                                 "encounter_id string, outcome int, unit string, prior double")
    panel = spark.createDataFrame([(f"e{i}", h, None if i % 50 == 3 else float((i % 5 == 0) * 3 + (i * 31 + h) % 4), -1.0) for i in range(310) for h in hours],
                                  "encounter_id string, hour int, lab double, prior double")
    o = RiskOptions(folds=2, params=Boosting(rounds=2, depth=2, subsample=1.0), alert_rates=(0.1, 0.3))
    merged = merge_panel(main, panel, ["unit", "prior"], o)
    assert merged.count() == 299 * 3 and merged.filter("prior = -1").count() == 0
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(key):
        read.add(1)
        return key

    report = train_and_evaluate(merged.withColumn("encounter_id", seen.asNondeterministic()("encounter_id")), ["unit", "prior", "lab"], o)
    test_ids = {r[0] for r in report.predictions.select("encounter_id").distinct().collect()}
    assert report.predictions.count() == 3 * len(test_ids) and 80 <= len(test_ids) <= 95
    by_hour = {r["hour"]: r for r in report.by_hour.collect()}
    assert set(by_hour) == set(hours) and all(r["c"] > 0.7 and r["n"] == len(test_ids) for r in by_hour.values())
    assert report.alerts.count() == 6 and 1 <= report.rounds <= 2
    assert report.importance.orderBy("rank").first()["feature"] == "lab"
    assert read.value == 299 * 3  # the input was computed once
