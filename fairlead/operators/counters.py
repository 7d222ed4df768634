"""Operational counters over event rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fairlead.functions.timeline import MICROS

# Counter name and its labels.
COUNTERS = {
    "http_requests_total": ["route", "status"],
    "http_request_errors_total": ["route"],
    "metric_computations_total": ["result"],
    "evidence_bundles_total": ["result"],
    "claims_accepted_total": [],
    "claims_rejected_total": ["category"],
    "agent_requests_total": ["outcome"],
}

# Routes with a label of their own; pass the routes of the served application.
API_ROUTES = ["/api/health", "/api/ready", "/api/profiles", "/api/attribution", "/metrics"]


def status_class(status: Column) -> Column:
    return F.when(status < 400, "2xx").when(status < 500, "4xx").otherwise("5xx")


def route_label(path: Column, routes: list[str] = API_ROUTES) -> Column:
    static = (
        path.startswith("/assets/") | path.startswith("/cesium/") | path.startswith("/icons/")
        | path.isin("/", "/index.html")
    )
    return F.when(path.isin(routes), path).when(static, "static").otherwise("other")


def label_counters(rows: DataFrame, name: str, amount: str | None = None) -> DataFrame:
    """Sum of one registered counter by its labels."""
    labels = COUNTERS[name]
    total = F.count("*") if amount is None else F.sum(amount)
    return rows.groupBy(*labels).agg(total.alias("value")).withColumn("counter", F.lit(name))


def rates(rows: DataFrame, at: str, labels: list[str], window: str = "5 minutes", seconds: int = 300) -> DataFrame:
    """Events per second in tumbling windows, by labels."""
    return (
        rows.groupBy(F.window(at, window).alias("_w"), *labels)
        .agg(F.count("*").alias("events"))
        .select(F.col("_w.start").alias("window_start"), *labels, "events", (F.col("events") / F.lit(float(seconds))).alias("per_second"))
    )


def sliding_rates(panes: DataFrame, labels: list[str], slide_seconds: int, window_seconds: int) -> DataFrame:
    """Rates of overlapping windows from tumbling panes: (window_start, labels, events, per_second).

    ``panes``: window_start, labels, events of panes as long as the slide.  A row was counted
    in one pane; only panes are handed to the windows that cover them.  Windows start at
    multiples of the slide; those without an event have no row.
    """
    if window_seconds % slide_seconds:
        raise ValueError("the window must be a multiple of the slide")
    slide = slide_seconds * MICROS
    back = F.sequence(F.lit(0), F.lit(window_seconds // slide_seconds - 1))
    covering = panes.select(*labels, "events", F.unix_micros("window_start").alias("_us"), F.explode(back).alias("_k"))
    start = F.timestamp_micros(F.col("_us") - F.col("_k") * F.lit(slide))
    return covering.groupBy(start.alias("window_start"), *labels).agg(F.sum("events").alias("events")).withColumn(
        "per_second", F.col("events") / F.lit(float(window_seconds))
    )
