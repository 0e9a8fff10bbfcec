from __future__ import annotations

from datetime import date, datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from cohortloom.functions import numeric, recode, text, time


def test_null_tokens_are_exact_and_only_touch_text(spark):
    df = spark.createDataFrame(
        [("", 1), ("unknown", 2), ("Unknown", 3), ("declined to specify", 4), (None, 5), ("kept", 6)], "a string, n int"
    )
    assert rows(text.null_tokens(df), "n") == [(None, 1), (None, 2), ("Unknown", 3), (None, 4), (None, 5), ("kept", 6)]


def test_sentinel_time_becomes_null(one):
    ts = "timestamp"
    assert one([time.close_stay(F.col("a")), time.close_stay(F.col("b")), time.close_stay(F.col("c"))],
               a=(datetime(1, 1, 1), ts), b=(datetime(2017, 5, 1, 3), ts), c=(None, ts)) == (None, datetime(2017, 5, 1, 3), None)


@pytest.mark.parametrize("admit, arrival, expected", [
    (datetime(2017, 1, 2), None, datetime(2017, 1, 2)),
    (datetime(2017, 1, 2), datetime(2017, 1, 1), datetime(2017, 1, 1)),
    (datetime(2017, 1, 2), datetime(2017, 1, 2), datetime(2017, 1, 2)),
    (datetime(2017, 1, 2), datetime(2017, 1, 3), datetime(2017, 1, 2)),
    (None, datetime(2017, 1, 3), datetime(2017, 1, 3)),
    (None, None, None),
])
def test_presentation_time(one, admit, arrival, expected):
    assert one([time.presentation_time(F.col("a"), F.col("b"))], a=(admit, "timestamp"), b=(arrival, "timestamp")) == (expected,)


def test_age_uses_31_day_fraction_and_rounds_half_up(one):
    got = one(
        [time.age_years(F.col("a"), F.col("x")), time.age_years(F.col("b"), F.col("x")), time.age_years(F.col("c"), F.col("x"))],
        x=(date(1990, 1, 31), "date"), a=(datetime(2020, 3, 15), "timestamp"), b=(datetime(2020, 1, 31), "timestamp"),
        c=(datetime(2020, 4, 30), "timestamp"),
    )
    # Month ends count as whole months: Jan 31 to Apr 30 is 3 months = 0.25 years, rounded up.
    assert got == (30.1, 30.0, 30.3)


def test_whole_days_counts_24_hours(one):
    start = datetime(2017, 1, 1, 23)
    ends = [datetime(2017, 1, 3, 1), datetime(2018, 1, 1, 23), datetime(2018, 1, 2, 22, 59, 59), datetime(2018, 1, 2, 23)]
    got = one([time.whole_days(F.col("s"), F.col(f"e{i}")) for i in range(4)], s=(start, "timestamp"), **{f"e{i}": (e, "timestamp") for i, e in enumerate(ends)})
    assert got == (1, 365, 365, 366)


def test_date_and_time_and_stay(one):
    t = time.from_date_and_time(F.col("d"), F.col("t"))
    stay = [time.stay_so_far(F.col("d"), F.col("out"), F.col("as_of")), time.stay_so_far(F.col("d"), F.col("open"), F.col("as_of"))]
    got = one([t, *stay], d=(date(2017, 3, 1), "date"), t=("14:05:09", "string"), out=(datetime(2017, 3, 4, 1), "timestamp"),
              open=(None, "timestamp"), as_of=(date(2017, 3, 11), "date"))
    assert got == (datetime(2017, 3, 1, 14, 5, 9), 3, 10)


def test_date_window_includes_its_moved_ends(spark):
    df = spark.createDataFrame([(datetime(2015, 12, 30),), (datetime(2015, 12, 29, 23, 59),), (datetime(2017, 11, 3),), (datetime(2017, 11, 3, 0, 0, 1),)], "t timestamp")
    kept = df.filter(time.within_dates(F.col("t"), "2016-01-01 00:00:00", "2017-11-01 00:00:00", 2))
    assert kept.count() == 2


def test_joined_key_is_null_with_any_null_part(one):
    assert one([text.joined_key("a", "b"), text.joined_key("a", "c")], a=("x", "string"), b=("y", "string"), c=(None, "string")) == ("x:y", None)


@pytest.mark.parametrize("name, urinary, central", [
    ("PICC line insertion", False, True),
    ("CV cath insert", False, True),
    ("portacath", False, False),
    ("Port-a-cath insertion", False, True),
    ("foley catheterization", True, False),
    ("Foley catheter insert", True, False),
    ("foley catheter", False, False),
    ("insert urinary cath", True, False),
    ("Insert central line", False, True),
])
def test_order_text_rules(one, name, urinary, central):
    from cohortloom.operators.codes import CENTRAL_LINE, URINARY_CATHETER, URINARY_CATHETER_EXACT

    got = one([text.any_phrase(F.col("n"), URINARY_CATHETER, URINARY_CATHETER_EXACT), text.any_phrase(F.col("n"), CENTRAL_LINE)], n=(name, "string"))
    assert got == (urinary, central)


def test_flags_from_text(one):
    from cohortloom.operators.pointintime import ward_flags

    flags = ward_flags(F.col("a"), F.col("b"))
    got = one([*flags.values(), *text.keyword_flags(F.col("c"), ["sepsis"]).values()], a=("SURG/inv diag", "string"), b=(None, "string"), c=(None, "string"))
    assert dict(zip([*flags, "sepsis"], got)) == {"trauma_ward": 0, "ob_location": 0, "surg_location": 1, "rehab_location": 0, "sepsis": 0}


def test_flag_or_null(one):
    assert one([text.flag_or_null(F.col(c)) for c in "abc"], a=(1, "int"), b=(0, "int"), c=(None, "int")) == (True, False, True)


def test_bins_are_left_closed(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 9.99, 10, 109.9, 110, -1)], "a double")
    got = [r[0] for r in df.select(numeric.left_closed_bin(F.col("a"), 0, 110, 10)).collect()]
    assert got == ["[0,10)", "[0,10)", "[10,20)", "[100,110)", None, None]


def test_bins_of_fractional_width(one):
    assert one([numeric.left_closed_bin(F.col("a"), 0, 2, 0.5), numeric.left_closed_bin(F.col("a"), 0.5, 2, 1)], a=(0.75, "double")) == ("[0.5,1.0)", "[0.5,1.5)")


def test_fill_leaves_text_alone(spark):
    df = spark.createDataFrame([(None, None, 1.5)], "a int, t string, d double")
    assert rows(numeric.fill_not_measured(df)) == [(-9999, None, 1.5)]


def test_hash_number_is_stable(one):
    # md5("124800:7") starts with the hex digits of this number.
    import hashlib

    expected = int(hashlib.md5(b"124800:7").hexdigest()[:8], 16)
    assert one([numeric.hash_number(124800, F.col("k")), numeric.hash_number(124800, F.col("s"))], k=(7, "bigint"), s=("7", "string")) == (expected, expected)


def test_never_happened_keeps_known_values_and_stays_in_range(spark):
    df = spark.range(500).select("id", F.when(F.col("id") < 10, F.col("id")).alias("d"))
    got = rows(df.select("id", numeric.never_happened(F.col("d"), 1, F.col("id"))), "id")
    assert got[:10] == [(i, i) for i in range(10)]
    assert all(2000 <= v < 4000 for _, v in got[10:]) and len({v for _, v in got[10:]}) > 300


def test_shock_index_without_pressure_is_null(one):
    got = one([numeric.shock_index(F.col("h"), F.col("s")), numeric.shock_index_by_age(F.col("h"), F.col("s"), F.col("a")), numeric.shock_index(F.col("h"), F.col("z"))],
              h=(90.0, "double"), s=(120.0, "double"), a=(40.0, "double"), z=(0.0, "double"))
    assert got == (0.75, 30.0, None)


@pytest.mark.parametrize("value, expected", [
    ("Single", "single"), ("LIFE PARTNER", "married"), ("Widowed", "widow"), ("legally separated", "separated"), ("other", None), (None, None),
])
def test_marital_status(one, value, expected):
    assert one([recode.marital_status(F.col("m"))], m=(value, "string")) == (expected,)


@pytest.mark.parametrize("value, source, group, nursing", [
    ("Transfer from a hospital", "hospital transfer", "healthcare contacts", 0),
    ("TRANSFER FROM A SNF INPATIENT", "transfer from a snf inpatient", "healthcare contacts", 1),
    ("Information not available", None, None, 0),
    ("Clinic", "clinic", "clinic", 0),
    (None, None, None, 0),
])
def test_admit_source(one, value, source, group, nursing):
    c = F.col("a")
    assert one([recode.admit_source(c), recode.admit_source_group(c), recode.from_nursing(c)], a=(value, "string")) == (source, group, nursing)


@pytest.mark.parametrize("race, ethnicity, expected", [
    (None, "asian/oriental", "asian"), (None, "african american/black", "black"), (None, "hispanic", "hispanic"), ("white", "hispanic", "hispanic"),
    ("black", "hispanic", "black"), ("pacific islander", "hispanic", "hispanic"), ("native american", None, "other"), (None, None, None),
])
def test_merged_race(one, race, ethnicity, expected):
    assert one([recode.merged_race(F.col("r"), F.col("e"))], r=(race, "string"), e=(ethnicity, "string")) == (expected,)


def test_flags_follow_three_valued_logic(one):
    i = "int"
    got = one(
        [recode.any_of(F.col("y"), F.col("u")), recode.any_of(F.col("n"), F.col("u")), recode.any_of(F.col("n"), F.col("n")),
         recode.carried_in(F.col("u"), F.col("n"), F.col("u"), F.col("y")), recode.carried_in(F.col("u"), F.col("y"), F.col("y"), F.col("y")),
         recode.carried_in(F.col("n"), F.col("y"), F.col("y"), F.col("y"))],
        y=(1, i), n=(0, i), u=(None, i),
    )
    assert got == (1, None, 0, 1, -9999, 0)


def test_present_on_admission(spark):
    df = spark.createDataFrame([(c,) for c in ["Y", "E", "N", "U", "W", "1", None]], "c string")
    assert [r[0] for r in df.select(recode.present_on_admission(F.col("c"))).collect()] == [1, 1, 0, None, None, None, None]


def test_entry_route(spark):
    df = spark.createDataFrame([(1, 0), (1, 1), (0, 1), (0, 0), (None, 1)], "ip int, ed int")
    got = [r[0] for r in df.select(recode.entry_route(F.col("ip"), F.col("ed"))).collect()]
    assert got == ["ip_not_through_ed", "ed_admitted", "ed_not_admitted", None, None]


def test_cost_ratio():
    assert numeric.cost_ratio(0.5, 1) == 1
    assert numeric.cost_ratio(0.003, 1) == pytest.approx(332.3333333)
