"""History, point-in-time and panel queries on the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.time import within_dates
from ..operators.codes import code_pivot, with_flags
from ..operators.cohort import drop_matching
from ..operators.history import history_features as build_history, visits_in_period
from ..operators.lookup import add_columns
from ..operators.panel import one_row_per_entity, snapshot_panel as build_panel, union_panels
from ..operators.timeline import band_pairs as build_pairs, states_at
from ..operators.pointintime import band_join, first_state, match_audit as audit, near_any_anchor, state_at, ward_flags
from .cohort_queries import CODES, cohort, diagnoses
from .registry import query
from .risk import RiskOptions, merge_panel
from .star import table, visits


def prior_visits(spark: SparkSession, sf: str) -> DataFrame:
    """All visits with their code flags, one row per visit."""
    flags = code_pivot(diagnoses(spark, sf), ["encounter_id"], "code", {"promo": CODES["dx_promo"]})
    return with_flags(visits(spark, sf), flags, ["encounter_id"], ["promo"])


def history(spark: SparkSession, sf: str, index: DataFrame, **more) -> DataFrame:
    return build_history(
        index, prior_visits(spark, sf), keys=["patient_id"], index_id="encounter_id", index_ts="admit_ts",
        prior_id="encounter_id", prior_ts="discharge_ts",
        since={"days_since_ed": "ed", "days_since_ip": "ip", "days_since_icu": "icu"},
        ever={"any_prev_promo": "promo"}, latest={"last_ip_stay": ("ip", "stay")}, size_from=visits(spark, sf), **more,
    )


@query
def history_features(spark: SparkSession, sf: str) -> DataFrame:
    return history(spark, sf, visits(spark, sf))


@query
def history_features_segmented(spark: SparkSession, sf: str) -> DataFrame:
    """The same result with every busy patient cut into time segments."""
    return history(spark, sf, visits(spark, sf), hot_rows=54)


@query
def cohort_history(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: history of the cohort's visits, visits without history kept with defaults."""
    index = cohort(spark, sf).select("encounter_id", "patient_id", "admit_ts", "age")
    found = history(spark, sf, index)
    joined = add_columns(index, found, ["encounter_id"])
    return joined.fillna({"n_past_year": 0, "any_prev_promo": 0, "last_ip_stay": 0}).drop("admit_ts")


@query
def year_count_expiry(spark: SparkSession, sf: str) -> DataFrame:
    v = visits(spark, sf)
    return visits_in_period(v, v, keys=["patient_id"], index_id="encounter_id", index_ts="admit_ts", prior_id="encounter_id", prior_ts="discharge_ts", size_from=v)


def intervals(spark: SparkSession, sf: str) -> DataFrame:
    """user_id, ward, start_ts, end_ts: an event lasts ten times its value in minutes."""
    start = F.col("ts").cast("timestamp")
    return table(spark, sf, "events").select(
        "user_id", "event_id", F.col("event_type").alias("ward"), start.alias("start_ts"),
        (start + F.make_dt_interval(mins=F.floor(F.col("value") * 10).cast("int"))).alias("end_ts"),
    )


def first_seen(spark: SparkSession, sf: str) -> DataFrame:
    """One anchor per user: the first event."""
    return table(spark, sf, "events").groupBy("user_id").agg(F.min(F.col("ts").cast("timestamp")).alias("first_ts"))


def state_3h(spark: SparkSession, sf: str, **more) -> DataFrame:
    at = state_at(first_seen(spark, sf), intervals(spark, sf), ["user_id"], anchor="first_ts", hours=3, start="start_ts", end="end_ts", tie=["event_id"], **more)
    return at.select("user_id", "ward", "start_ts", "end_ts")


@query
def state_at_offset(spark: SparkSession, sf: str) -> DataFrame:
    return state_3h(spark, sf)


@query
def state_at_hot(spark: SparkSession, sf: str) -> DataFrame:
    """The same rows with every busy user spread over tasks."""
    return state_3h(spark, sf, hot_rows=8)


@query
def location_flags(spark: SparkSession, sf: str) -> DataFrame:
    rows, anchors = intervals(spark, sf), first_seen(spark, sf)
    at = state_at(anchors, rows, ["user_id"], anchor="first_ts", hours=3, start="start_ts", end="end_ts", tie=["event_id"])
    first = first_state(rows, ["user_id"], start="start_ts", tie=["event_id"], keep={"first_ward": "ward"})
    both = anchors.select("user_id").join(first, "user_id", "left").join(at.select("user_id", F.col("ward").alias("ward_3h")), "user_id", "left")
    flags = ward_flags(F.col("first_ward"), F.col("ward_3h"), patterns={"bought": "purchase", "trouble": "error|sign", "looked": "^(view|click)$"})
    return both.select("user_id", "first_ward", "ward_3h", *[c.alias(n) for n, c in flags.items()])


def readings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "value")


@query
def band_join_24h(spark: SparkSession, sf: str) -> DataFrame:
    """Events around the one anchor of each user."""
    big = first_state(
        readings(spark, sf).filter(F.col("value") > 200), ["user_id"], start="ts", tie=["event_id"], keep={"anchor_id": "event_id", "anchor_ts": "ts"}
    )
    return band_join(readings(spark, sf), big, ["user_id"], ts="ts", anchor="anchor_ts", tie="event_id").select("user_id", "event_id", "anchor_id")


def near_any(spark: SparkSession, sf: str, **more) -> DataFrame:
    anchors = readings(spark, sf).filter(F.col("value") > 200).select("user_id", F.col("ts").alias("anchor_ts"))
    return near_any_anchor(readings(spark, sf), anchors, ["user_id"], ts="ts", anchor="anchor_ts", tie="event_id", **more).select("user_id", "event_id")


@query
def near_any_anchor_24h(spark: SparkSession, sf: str) -> DataFrame:
    """Events around any of the many anchors of each user."""
    return near_any(spark, sf)


@query
def near_any_hot(spark: SparkSession, sf: str) -> DataFrame:
    """The same rows with every busy slot spread over tasks."""
    return near_any(spark, sf, hot_rows=1)


def hourly_states(spark: SparkSession, sf: str, **more) -> DataFrame:
    """For each visit and each of the 24 hours after it began, the visit of the same patient that was open then."""
    v = visits(spark, sf)
    hours = v.select("patient_id", F.col("encounter_id").alias("asked_id"), "admit_ts", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    probes = hours.select("patient_id", "asked_id", "hour", (F.col("admit_ts") + F.make_dt_interval(hours=F.col("hour"))).alias("probe_ts"))
    return states_at(probes, v, ["patient_id"], at="probe_ts", start="admit_ts", end="discharge_ts", tie="encounter_id", **more).drop("probe_ts")


@query
def state_at_every_hour(spark: SparkSession, sf: str) -> DataFrame:
    return hourly_states(spark, sf)


@query
def state_at_every_hour_segmented(spark: SparkSession, sf: str) -> DataFrame:
    """The same rows with every patient's timeline cut into segments."""
    return hourly_states(spark, sf, hot_rows=100)


@query
def band_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Events and all of the many anchors of their user within a day."""
    anchors = readings(spark, sf).filter(F.col("value") > 200).select("user_id", F.col("event_id").alias("anchor_id"), F.col("ts").alias("anchor_ts"))
    found = build_pairs(readings(spark, sf), anchors, ["user_id"], ts="ts", anchor="anchor_ts", tie="event_id")
    return found.select("user_id", "event_id", "anchor_id")


MEASURES = {
    "reading": lambda: F.col("value"),
    "click": lambda: F.when(F.col("event_type") == "click", F.col("value")),
}


def panel(spark: SparkSession, sf: str, hours=(1, 3, 6, 12, 24), **more) -> DataFrame:
    events = table(spark, sf, "events").select("user_id", "event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    rows = build_panel(
        events, first_seen(spark, sf), ["user_id"], ts="ts", anchor="first_ts", tie="event_id",
        measures={n: make() for n, make in MEASURES.items()}, hours=hours, **more,
    )
    return rows.withColumns({c: F.round(c, 6) for c in rows.columns if c.endswith(("_mean", "_change"))})


@query
def snapshot_panel(spark: SparkSession, sf: str) -> DataFrame:
    return panel(spark, sf)


@query
def snapshot_panel_hot(spark: SparkSession, sf: str) -> DataFrame:
    """The same rows with every busy user spread over tasks."""
    return panel(spark, sf, hot_rows=8)


@query
def panel_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Panel rows of the entities that have an outcome, with columns of the main table."""
    people = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("encounter_id"), "c_mktsegment", F.when(F.col("c_custkey") % 3 < 2, F.col("c_custkey") % 3).alias("outcome")
    )
    hours = panel(spark, sf, (1, 6)).select(F.col("user_id").alias("encounter_id"), "hour", "n_events")
    return merge_panel(people, hours, ["c_mktsegment"], RiskOptions())


@query
def panel_union(spark: SparkSession, sf: str) -> DataFrame:
    """Two panels built apart and put under each other, columns matched by name."""
    one, six = panel(spark, sf, (1,)), panel(spark, sf, (6,))
    return union_panels([one, six.select(*reversed(six.columns))]).select("user_id", "hour", "n_events", "reading_last")


@query
def panel_column_drop(spark: SparkSession, sf: str) -> DataFrame:
    return drop_matching(panel(spark, sf), ["^click_", "_change$"], ["n_events"])


@query
def random_hour_row(spark: SparkSession, sf: str) -> DataFrame:
    return one_row_per_entity(panel(spark, sf).select("user_id", "hour", "n_events"), ["user_id"], "hour", 124800)


@query
def match_audit(spark: SparkSession, sf: str) -> DataFrame:
    left = visits(spark, sf).select("encounter_id", "discharge_ts")
    right = table(spark, sf, "lineitem").filter(F.col("l_quantity") > 25).groupBy(F.col("l_orderkey").alias("encounter_id")).agg(
        F.min(F.col("l_shipdate").cast("timestamp")).alias("other_ts")
    )
    return audit(left, right, ["encounter_id"], left_ts="discharge_ts", right_ts="other_ts")


@query
def date_window_slop(spark: SparkSession, sf: str) -> DataFrame:
    v = visits(spark, sf).filter(within_dates(F.col("discharge_ts"), "1996-01-01 00:00:00", "1997-11-01 00:00:00", slop_days=2))
    return v.select("encounter_id", "discharge_ts")
