"""Cohort, cleaning, recodes, lookups and code flags on the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.numeric import never_happened, shock_index, shock_index_by_age
from ..functions.recode import any_of, carried_in, coded, entry_route, filled, grouped, merged_race, nonwhite, present_on_admission, yes_no
from ..functions.text import joined_key, keyword_flags, null_if_lower, null_tokens, tidy
from ..functions.time import age_years, close_stay, from_date_and_time, presentation_time, stay_so_far
from ..operators.codes import code_pivot, exposures, first_order_times, flags_per_key, with_flags
from ..operators.cohort import CohortRule, star_join
from ..operators.dedupe import earliest_event, first_row_per_key
from ..operators.lookup import grouped_category, lookup_first, rows_per_key
from ..operators.summary import percent_present
from .registry import query
from .star import table, visits

PERIOD = CohortRule(
    first_discharge="1996-01-01 00:00:00", last_discharge="1999-12-31 00:00:00", min_age=18,
    excluded_groups=["AFRICA"], excluded_facilities=["NATION_7", "NATION_13"], facility_type="BUILDING",
)


def birth_day(key) -> F.Column:
    """A birth date per customer, from the key."""
    return F.date_add(F.lit("1930-01-01").cast("date"), (key * 97 % 20000).cast("int"))


def people(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with nation and region: the dimension side of a visit."""
    customers = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("patient_id"), "c_nationkey", "c_mktsegment", birth_day(F.col("c_custkey")).alias("born")
    )
    return star_join(customers, [
        (table(spark, sf, "nation"), "c_nationkey", "n_nationkey"),
        (table(spark, sf, "region"), "n_regionkey", "r_regionkey"),
    ])


def cohort(spark: SparkSession, sf: str) -> DataFrame:
    rows = visits(spark, sf).join(people(spark, sf), "patient_id", "left").withColumn("age", age_years(F.col("admit_ts"), F.col("born")))
    return rows.filter(
        PERIOD.visits(ed="ed", ip="ip", age="age", discharge="discharge_ts")
        & PERIOD.facilities(kind="c_mktsegment", group="r_name", code="n_name")
    )


@query
def cohort_filter(spark: SparkSession, sf: str) -> DataFrame:
    return cohort(spark, sf).select("encounter_id", "patient_id", "age", "n_name", "r_name")


@query
def star_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return people(spark, sf).select("patient_id", F.lower("n_name").alias("nation"), F.lower("r_name").alias("region"))


@query
def null_token_cleaning(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    clean = null_tokens(orders, ["4-NOT SPECIFIED"], ["o_orderpriority"]).withColumn("status", null_if_lower(F.col("o_orderstatus"), "p"))
    return clean.select(
        F.col("o_orderkey").alias("encounter_id"), F.col("o_orderpriority").alias("priority"), "status",
        F.coalesce("o_orderpriority", F.lit("0")).alias("priority_filled"), filled(F.col("o_orderpriority")).alias("has_priority"),
    )


@query
def recode_ladder(spark: SparkSession, sf: str) -> DataFrame:
    v = visits(spark, sf)
    group = grouped(F.col("priority"), {"high": ["1-urgent", "2-high"], "normal": ["3-medium"]}, {"low": "low"})
    ip, ed = F.greatest("ip", "icu"), F.greatest("ed", "icu")
    return v.select(
        "encounter_id", group.alias("priority_group"), entry_route(ip, ed).alias("route"),
        any_of(F.col("ed"), F.col("icu")).alias("any_acute"), yes_no(any_of(F.col("ed"), F.col("icu"))).alias("any_acute_yn"),
        coded(F.col("stay"), {1: "Yes", 2: "No"}).alias("answer"), tidy(F.col("priority"), "right").alias("priority_text"),
    )


@query
def race_merge(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    race = coded(F.col("c_mktsegment"), {"BUILDING": "native american", "MACHINERY": "white", "FURNITURE": "black", "HOUSEHOLD": "unknown"})
    ethnicity = coded(key % 5, {0: "hispanic", 1: "asian/oriental", 2: "african american/black", 3: "white/caucasian"})
    merged = merged_race(race, ethnicity)
    return table(spark, sf, "customer").select(key.alias("patient_id"), merged.alias("race"), nonwhite(merged).alias("nonwhite"))


@query
def arrival_mode(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")

    def flag(n: int) -> F.Column:
        return F.when(key % 7 != n, (key % (n + 2) == 0).cast("int"))

    return table(spark, sf, "orders").select(
        key.alias("encounter_id"), carried_in(flag(1), flag(2), flag(3), flag(4)).alias("carried_in")
    )


def brand_code() -> F.Column:
    return F.when(F.col("o_custkey") % 11 != 0, F.concat(F.lit("Brand#"), (F.col("o_custkey") % 40).cast("string")))


@query
def lookup_first_match(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("encounter_id"), brand_code().alias("code"))
    return lookup_first(rows, table(spark, sf, "part"), on="code", key="p_brand", take={"first_type": "p_type", "first_size": "p_size"}, order=["p_partkey"])


@query
def grouped_lookup(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("encounter_id"), brand_code().alias("code"))
    mapping = table(spark, sf, "part").withColumn("override", F.when(F.col("p_size") > 25, F.col("p_name")))
    return grouped_category(rows, mapping, on="code", key="p_brand", base="p_type", override="override", out="category", order=["p_partkey"])


@query
def dedupe_first(spark: SparkSession, sf: str) -> DataFrame:
    v = visits(spark, sf).select("patient_id", "encounter_id", "admit_ts", "priority")
    return first_row_per_key(v, ["patient_id"], ["admit_ts", F.desc("encounter_id")])


def first_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("encounter_id"), F.col("l_shipdate").cast("timestamp").alias("ts"), "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"
    )
    return earliest_event(lines, ["encounter_id"], "ts", ["l_linenumber", "l_partkey", "l_suppkey"], {"arrival_ts": "ts", "arrival_method": "l_returnflag"})


@query
def first_event_per_entity(spark: SparkSession, sf: str) -> DataFrame:
    return visits(spark, sf).select("encounter_id").join(first_lines(spark, sf), "encounter_id", "left")


@query
def presentation(spark: SparkSession, sf: str) -> DataFrame:
    both = visits(spark, sf).join(first_lines(spark, sf), "encounter_id", "left")
    return both.select("encounter_id", presentation_time(F.col("admit_ts"), F.col("arrival_ts")).alias("presentation_ts"))


@query
def age_in_years(spark: SparkSession, sf: str) -> DataFrame:
    v = visits(spark, sf)
    return v.select("encounter_id", age_years(F.col("admit_ts"), birth_day(F.col("patient_id"))).alias("age"))


@query
def discharge_cleaning(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    clock = F.format_string("%02d:%02d:%02d", key % 24, key % 60, (key * 7) % 60)
    admit = from_date_and_time(F.col("o_orderdate").cast("date"), clock)
    raw = F.when(F.col("o_orderstatus") == "O", F.lit("0001-01-01 00:00:00").cast("timestamp")).otherwise(
        admit + F.make_dt_interval(days=F.pmod(key, F.lit(14)).cast("int"))
    )
    closed = close_stay(raw)
    return table(spark, sf, "orders").select(
        key.alias("encounter_id"), admit.alias("admit_ts"), closed.alias("discharge_ts"),
        stay_so_far(F.col("o_orderdate").cast("date"), closed, F.lit("2001-12-31").cast("date")).alias("stay_days"),
    )


@query
def keyword_flag_text(spark: SparkSession, sf: str) -> DataFrame:
    words = keyword_flags(F.col("text"), ["license", "the", "avec"])
    return table(spark, sf, "documents").select("doc_id", *[c.alias(f"has_{w}") for w, c in words.items()])


@query
def shock_index_ratio(spark: SparkSession, sf: str) -> DataFrame:
    rate, pressure = F.col("p_retailprice"), (F.col("p_size") % 5).cast("double")
    return table(spark, sf, "part").select(
        "p_partkey", F.round(shock_index(rate, pressure), 6).alias("si"),
        F.round(shock_index_by_age(rate, pressure, F.col("p_size")), 6).alias("sia"),
    )


def diagnoses(spark: SparkSession, sf: str) -> DataFrame:
    """encounter_id, code, present: lines joined to the code dimension."""
    dim = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("code"))
    facts = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("encounter_id"), "l_partkey", F.col("l_returnflag").alias("mark"))
    present = F.when(F.col("mark") == "A", "Y").when(F.col("mark") == "N", "N").otherwise("U")
    return facts.join(dim, "l_partkey").select("encounter_id", "code", present.alias("present"))


CODES = {"dx_promo": ["PROMO"], "dx_economy": ["ECONOMY"], "dx_sized": ["SMALL", "LARGE"]}


@query
def code_flags_pivot(spark: SparkSession, sf: str) -> DataFrame:
    flags = code_pivot(diagnoses(spark, sf), ["encounter_id"], "code", CODES, present="present")
    out = with_flags(visits(spark, sf).select("encounter_id"), flags, ["encounter_id"], list(CODES))
    return out.withColumn("any_dx", any_of(F.col("dx_promo"), F.col("dx_economy")))


@query
def code_flags_regex(spark: SparkSession, sf: str) -> DataFrame:
    rules = {"starts_s": F.col("code").rlike("^S"), "ends_o": F.col("code").rlike("O$")}
    return flags_per_key(diagnoses(spark, sf), ["encounter_id"], rules)


@query
def present_percent(spark: SparkSession, sf: str) -> DataFrame:
    return percent_present(diagnoses(spark, sf), ["code"], present_on_admission(F.col("present")))


@query
def text_order_first(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    system = F.when(F.col("l_linenumber") % 3 == 1, 1).when(F.col("l_linenumber") % 3 == 2, 0)
    orders = table(spark, sf, "lineitem").join(names, "l_partkey").select(
        F.col("l_orderkey").alias("encounter_id"), "p_name", "l_linestatus", F.col("l_shipdate").cast("timestamp").alias("written"), system.alias("system_flag")
    )
    rules = {"ring": ([["ring", "cold"], ["ring", "hot"], ["gi", "old"]], ["new plate"]), "rod": ([["rod"]], [])}
    return first_order_times(
        orders, ["encounter_id"], text="p_name", status="l_linestatus", written="written", rules=rules, done=["f"], system_flag="system_flag"
    )


@query
def exposure_chain(spark: SparkSession, sf: str) -> DataFrame:
    given = table(spark, sf, "lineitem").select(
        joined_key(F.lit("STAR"), F.col("l_orderkey").cast("string"), sep="~").alias("unique_id"), F.col("l_linestatus").alias("status"),
        F.col("l_shipdate").alias("discharge_dt"), "l_linenumber", "l_partkey", "l_suppkey",
    )
    orders = table(spark, sf, "orders").select(F.lit("STAR").alias("source_id"), F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("catalog_cd"))
    key = F.concat(F.lit("STAR~"), F.col("c_custkey").cast("string")).alias("medication_cd")
    drugs = table(spark, sf, "customer").select(key, F.col("c_name").alias("medication_name"))
    classes = table(spark, sf, "customer").select(key, F.lower("c_mktsegment").alias("class_name"))
    found = exposures(
        given, orders, drugs, classes, therapeutic_class="BUILDING", first_day="1998-01-01 00:00:00", last_day="1998-12-31 00:00:00", statuses=["F"],
    )
    return found.select("order_id", "medication_cd", "medication_name", "l_linenumber", "l_partkey", "l_suppkey", "discharge_dt")


@query
def fan_out_check(spark: SparkSession, sf: str) -> DataFrame:
    return rows_per_key(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query
def never_happened_fill(spark: SparkSession, sf: str) -> DataFrame:
    days = F.when(F.col("ed") == 1, F.col("stay").cast("long"))
    return visits(spark, sf).select("encounter_id", never_happened(days, 124800, F.col("encounter_id")).alias("days_since_ed"))
