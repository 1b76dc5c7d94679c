"""Event filters, ordering and per-trace event aggregates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tracegraph.functions import fixed, ordered
from tracegraph.functions.text import any_word
from tracegraph.sources.adapter import time_slice


def is_interaction() -> Column:
    """Not a screenshot and not a page-level event; nulls count as interactions."""
    return ~F.col("event_type").eqNullSafe("screenshot") & ~F.col("element_tag").eqNullSafe("page")


def interaction_filter(ev: DataFrame) -> DataFrame:
    return ev.filter(is_interaction())


def content_event_filter(ev: DataFrame) -> DataFrame:
    return ev.filter(~F.coalesce("event_type", F.lit("")).isin("screenshot", "page"))


def navigates() -> Column:
    return (F.col("url_after") != "") & (F.col("url_before") != "") & (F.col("url_after") != F.col("url_before"))


def event_sequence(ev: DataFrame, order: Callable[..., DataFrame] = ordered.sequence) -> DataFrame:
    """Interaction events with idx, node name, nav flag and the node they follow; ``order`` numbers the rows as ``ordered.sequence`` does."""
    e = interaction_filter(ev).withColumn("nav", navigates())
    e = e.withColumn("_leave", F.when(F.col("nav"), F.col("url_after")))
    e = order(e, ["trace_id"], ["tus", "event_id"], time_slice(), index="idx", previous={"_ptype": "event_type", "_pleave": "_leave"})
    node = F.concat_ws("_", "event_type", F.col("idx").cast("string"))
    prev = F.when(F.col("idx") == 0, F.col("root_url")).otherwise(
        F.coalesce("_pleave", F.concat_ws("_", "_ptype", (F.col("idx") - 1).cast("string"))))
    return e.select("*", node.alias("node"), prev.alias("prev_node")).drop("_leave", "_ptype", "_pleave")


def truncate_events(ev: DataFrame, max_events: int) -> DataFrame:
    """Keep the first interaction events of each trace."""
    return event_sequence(ev).filter(F.col("idx") < max_events)


def one_of(*types: str) -> Column:
    return F.col("event_type").isin(*types)


def type_counts(submit_any: bool = False) -> list[Column]:
    submits = F.contains(F.col("event_type"), F.lit("submit")) if submit_any else one_of("submit", "js_form_submit")
    return [
        F.count_if(one_of("link_detected", "login_link_follow")).alias("n_links"),
        F.count_if(one_of("button_detected", "button_click")).alias("n_buttons"),
        F.count_if(one_of("input", "form_input")).alias("n_inputs"),
        F.count_if(submits).alias("n_submits"),
        F.count_if(one_of("check", "select")).alias("n_checks"),
        F.count_if(one_of("dual_submit_error", "dual_submit_resubmit")).alias("n_dual_submit"),
        F.count_if(one_of("page_transition")).alias("n_page_transitions"),
        F.count(F.lit(1)).alias("total_events"),
    ]


def event_type_counts(ev: DataFrame) -> DataFrame:
    return interaction_filter(ev).groupBy("trace_id").agg(*type_counts())


def field_text() -> Column:
    return F.lower(F.concat("element_class", "element_id", "form_field"))


def field_flags() -> list[Column]:
    return [F.max(F.contains(field_text(), F.lit("password")).cast("int")).alias("has_password_field"),
            F.max(any_word(field_text(), ["email", "mail", "user"]).cast("int")).alias("has_email_field")]


def span_seconds(col: str = "ts_us") -> Column:
    """Seconds between the first and last positive timestamp, 0 for fewer than two."""
    t = F.when(F.col(col) > 0, F.col(col))
    return F.when(F.count(t) >= 2, (F.max(t) - F.min(t)) / 1e6).otherwise(F.lit(0.0))


def time_aggs(ev: DataFrame) -> DataFrame:
    t = F.when(F.col("ts_us") > 0, F.col("ts_us"))
    a = interaction_filter(ev).groupBy("trace_id").agg(F.count(t).alias("n"), span_seconds().alias("duration"))
    return a.select("trace_id", "n", "duration",
                    F.when(F.col("n") > 1, F.col("duration") / (F.col("n") - 1)).otherwise(0.0).alias("avg_gap"),
                    F.when(F.col("duration") > 0, F.col("n") / F.col("duration")).otherwise(0.0).alias("frequency"))


def sensitive_fields(field: str = "form_field") -> Column:
    return any_word(F.lower(F.col(field)), fixed.SENSITIVE_FIELD_WORDS)


def request_response_match(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """The n-th response of a URL answers the n-th request of the same URL in its trace."""
    order = ["tus", "event_id"]
    a = ordered.sequence(requests, ["trace_id", "url"], order, time_slice(), "nth")
    b = ordered.sequence(responses, ["trace_id", "url"], order, time_slice(), "nth")
    return a.join(b.select("trace_id", "url", "nth", F.col("status").alias("response_status"),
                           F.col("tus").alias("response_tus")), ["trace_id", "url", "nth"], "left")


def dual_submission_detect(ev: DataFrame, gap_micros: int = 86_400_000_000) -> DataFrame:
    """Submit, error, submit again, then leave: ordered steps per trace within the gap."""
    step = (F.when(one_of("submit", "js_form_submit"), "S")
            .when(one_of("dual_submit_error", "screenshot"), "E")
            .when(navigates(), "A").otherwise("-"))
    e = ev.withColumn("step", step).filter("step <> '-'")
    e = ordered.sequence(e, ["trace_id"], ["tus", "event_id"], time_slice(), "i", {"p1": "step", "t1": "tus"})
    e = ordered.sequence(e, ["trace_id"], ["tus", "event_id"], time_slice(), "i",
                         {"p2": "p1", "t2": "t1"})
    resubmit = (F.col("step") == "S") & (F.col("p1") == "E") & (F.col("p2") == "S") & (
        F.col("tus") - F.col("t2") <= gap_micros)
    accept = (F.col("step") == "A") & (F.col("p1") == "S") & (F.col("p2") == "E")
    return e.groupBy("trace_id").agg(F.count_if(resubmit).alias("n_resubmits"), F.count_if(accept).alias("n_accepts"),
                                     F.count_if(F.col("step") == "S").alias("n_submits")).withColumn(
        "dual_submission", (F.col("n_resubmits") > 0) & (F.col("n_accepts") > 0))
