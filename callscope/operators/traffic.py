"""Traffic analytics: tenant summaries, panels, dashboard rows and scoped reports.

Every operator works for all tenants at once; a tenant id narrows it. Facts are first
reduced to counts by id and only those few rows meet the dimension tables.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callscope.functions import columns as C
from callscope.operators.scan import last_hours, newest_moment, scoped, tenant_scope

UNKNOWN = "Unknown"


def _named(counts: DataFrame, dim: DataFrame, id_column: str) -> DataFrame:
    """Attach ``name`` of the tenant's dimension row; NULL where there is none."""
    names = dim.select("tenant_id", F.col("id").alias(id_column), "name")
    return counts.join(names, ["tenant_id", id_column], "left")


def _most_frequent(counts: DataFrame, name: str, count: str, alias: str) -> DataFrame:
    """Per tenant the name with the highest count; ties go to the smallest name."""
    order = Window.partitionBy("tenant_id").orderBy(F.col(count).desc(), F.col(name).asc_nulls_first())
    return (
        counts.withColumn("_r", F.row_number().over(order))
        .where(F.col("_r") == 1)
        .select("tenant_id", F.col(name).alias(alias))
    )


def tenant_summary(logs: DataFrame, routes: DataFrame, tenant_id: str | None = None) -> DataFrame:
    """Totals, successes, blocks, mean latency, active clients and most used route.

    The log is read and shuffled once, reduced to one row per (client, route); distinct
    clients and the top route come from that small table.
    """
    cells = (
        tenant_scope(logs, tenant_id)
        .groupBy("tenant_id", "client_id", "route_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(C.is_success()).alias("ok"),
            F.count_if("blocked").alias("blocked"),
            F.sum("latency_ms").alias("latency"),
            F.count("latency_ms").alias("timed"),
        )
    )
    totals = cells.groupBy("tenant_id").agg(
        F.sum("n").alias("total_requests"),
        F.sum("ok").alias("successful_requests"),
        F.sum("blocked").alias("blocked_requests"),
        F.coalesce(F.sum("latency") / F.sum("timed"), F.lit(0.0)).alias("average_response_ms"),
        F.count_distinct("client_id").alias("active_clients"),
    )
    by_route = cells.groupBy("tenant_id", "route_id").agg(F.sum("n").alias("n"))
    by_name = _named(by_route, routes, "route_id").groupBy("tenant_id", "name").agg(F.sum("n").alias("n"))
    top = _most_frequent(by_name, "name", "n", "most_used_route")
    return totals.join(top, "tenant_id", "left").withColumn(
        "most_used_route", F.coalesce("most_used_route", F.lit(""))
    )


def traffic_hourly(logs: DataFrame, tenant_id: str | None = None) -> DataFrame:
    """Requests and rounded mean latency per UTC hour."""
    return (
        tenant_scope(logs, tenant_id)
        .groupBy("tenant_id", C.iso_hour("created_at").alias("bucket"))
        .agg(
            F.count(F.lit(1)).alias("request_count"),
            F.round(F.avg("latency_ms")).cast("bigint").alias("average_latency_ms"),
        )
    )


def status_distribution(logs: DataFrame, tenant_id: str | None = None) -> DataFrame:
    return tenant_scope(logs, tenant_id).groupBy("tenant_id", "status_code").agg(F.count(F.lit(1)).alias("request_count"))


def requests_by_client(logs: DataFrame, clients: DataFrame, tenant_id: str | None = None, *, grain: str = "name") -> DataFrame:
    """Requests per client name (same names merge, none is 'Unknown') or per client id."""
    counts = tenant_scope(logs, tenant_id).groupBy("tenant_id", "client_id").agg(F.count(F.lit(1)).alias("n"))
    if grain == "id":
        return _named(counts, clients, "client_id").select(
            "tenant_id", "client_id", F.coalesce("name", "client_id").alias("name"), F.col("n").alias("request_count")
        )
    return _sum_by_name(_named(counts, clients, "client_id"), "request_count")


def blocked_by_route(logs: DataFrame, routes: DataFrame, tenant_id: str | None = None) -> DataFrame:
    counts = (
        tenant_scope(logs, tenant_id)
        .where(F.col("blocked"))
        .groupBy("tenant_id", "route_id")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return _sum_by_name(_named(counts, routes, "route_id"), "blocked_count")


def _sum_by_name(named: DataFrame, alias: str) -> DataFrame:
    return named.groupBy("tenant_id", F.coalesce("name", F.lit(UNKNOWN)).alias("name")).agg(F.sum("n").alias(alias))


def traffic_panels(
    logs: DataFrame, clients: DataFrame, routes: DataFrame, tenant_id: str | None = None
) -> DataFrame:
    """All dashboard panels from one scan: (tenant, panel, label, value).

    The log is reduced once to its (hour, status, client, route, blocked) cells; the
    grouping sets then run over the cells.
    """
    cells = (
        tenant_scope(logs, tenant_id)
        .groupBy("tenant_id", C.iso_hour("created_at").alias("hour"), "status_code", "client_id", "route_id", "blocked")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("latency_ms").alias("latency"), F.count("latency_ms").alias("timed"))
    )
    t, dims = F.col("tenant_id"), [F.col(c) for c in ("hour", "status_code", "client_id", "route_id", "blocked")]
    hour, status, client, route, blocked = dims
    rolled = cells.groupingSets(
        [(t, hour), (t, status), (t, client), (t, route, blocked)], t, *dims
    ).agg(
        F.sum("n").alias("n"),
        F.round(F.sum("latency") / F.sum("timed")).cast("bigint").alias("mean"),
        F.grouping("hour").alias("g_hour"),
        F.grouping("status_code").alias("g_status"),
        F.grouping("client_id").alias("g_client"),
        F.grouping("route_id").alias("g_route"),
    )
    named = rolled.join(
        clients.select("tenant_id", F.col("id").alias("client_id"), F.col("name").alias("client_name")),
        ["tenant_id", "client_id"],
        "left",
    ).join(
        routes.select("tenant_id", F.col("id").alias("route_id"), F.col("name").alias("route_name")),
        ["tenant_id", "route_id"],
        "left",
    )
    entry = lambda panel, label, value: F.struct(
        F.lit(panel).alias("panel"), label.cast("string").alias("label"), value.alias("value")
    )
    entries = (
        F.when(F.col("g_hour") == 0, F.array(entry("requests_over_time", F.col("hour"), F.col("n")), entry("latency_trend", F.col("hour"), F.col("mean"))))
        .when(F.col("g_status") == 0, F.array(entry("status_distribution", F.col("status_code"), F.col("n"))))
        .when(F.col("g_client") == 0, F.array(entry("by_client", F.coalesce("client_name", F.lit(UNKNOWN)), F.col("n"))))
        .when(F.col("blocked"), F.array(entry("blocked_by_route", F.coalesce("route_name", F.lit(UNKNOWN)), F.col("n"))))
    )
    return (
        named.select("tenant_id", F.explode(entries).alias("e"))
        .groupBy("tenant_id", "e.panel", "e.label")
        .agg(F.sum("e.value").alias("value"))
    )


def panel_order(panels: DataFrame) -> DataFrame:
    """Each panel's rows with their ``position``: time and codes ascending, names by count descending then name."""
    named = F.col("panel").isin("by_client", "blocked_by_route")
    order = Window.partitionBy("tenant_id", "panel").orderBy(F.when(named, -F.col("value")), "label")
    return panels.withColumn("position", F.row_number().over(order))


# --- dashboard ------------------------------------------------------------------


def dashboard_summary(logs: DataFrame, tenant_id: str | None = None) -> DataFrame:
    """Counts, mean latency, top client and route, and the status map of each tenant.

    Missing ids count as 'unknown'. Ties for the top name go to the smallest name.
    """
    cells = (
        tenant_scope(logs, tenant_id)
        .groupBy(
            "tenant_id",
            F.coalesce(C.blank_to_null("client_id"), F.lit("unknown")).alias("client"),
            F.coalesce(C.blank_to_null("route_id"), F.lit("unknown")).alias("route"),
            F.coalesce("status_code", F.lit(0)).alias("code"),
        )
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if("blocked").alias("blocked"),
            F.sum("latency_ms").alias("latency"),
            F.count("latency_ms").alias("timed"),
        )
    )
    totals = cells.groupBy("tenant_id").agg(
        F.sum("n").alias("requests"),
        F.sum("blocked").alias("blocked_requests"),
        F.coalesce(F.sum(F.when(F.col("code") >= 400, F.col("n"))), F.lit(0)).alias("error_requests"),
        F.coalesce(F.sum(F.when(F.col("code") >= 500, F.col("n"))), F.lit(0)).alias("server_error_requests"),
        F.round(F.sum("latency") / F.sum("timed"), 2).alias("average_latency_ms"),
    )
    per = lambda c: cells.groupBy("tenant_id", c).agg(F.sum("n").alias("n"))
    codes = per("code").groupBy("tenant_id").agg(
        F.map_from_entries(
            F.array_sort(F.collect_list(F.struct(F.col("code").cast("string").alias("code"), "n")))
        ).alias("status_counts")
    )
    return (
        totals.join(_most_frequent(per("client"), "client", "n", "top_client"), "tenant_id")
        .join(_most_frequent(per("route"), "route", "n", "most_used_route"), "tenant_id")
        .join(codes, "tenant_id")
    )


def complete_summary(tenants: DataFrame, summary: DataFrame) -> DataFrame:
    """One summary row for every tenant; those without logs get zeros and 'n/a'."""
    rows = tenants.select(F.col("id").alias("tenant_id")).join(summary, "tenant_id", "left")
    return rows.fillna(
        0, ["requests", "blocked_requests", "error_requests", "server_error_requests"]
    ).fillna("n/a", ["top_client", "most_used_route"])


def incident_report(tenants: DataFrame, logs: DataFrame, *, hours: int = 2, as_of: datetime | None = None) -> DataFrame:
    """Findings of every tenant over the hours up to ``as_of`` (default: the newest row), with a sentence on the window."""
    as_of = as_of or newest_moment(logs)
    summary = complete_summary(tenants, dashboard_summary(last_hours(logs, hours, as_of)))
    shown = lambda at: F.date_format(F.lit(at), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    start = as_of - timedelta(hours=hours) if as_of else None
    sentence = F.format_string("Observed %d requests from %s through %s.", "requests", shown(start), shown(as_of))
    return incident_findings(summary, hours=hours).join(summary.select("tenant_id", sentence.alias("summary")), "tenant_id")


def incident_findings(summary: DataFrame, *, hours: int = 2) -> DataFrame:
    """Observations, interpretations and actions, as fixed sentences over the summary."""
    blocked, failing = F.col("blocked_requests") > 0, F.col("server_error_requests") > 0
    calm = ~blocked & ~failing
    pick = lambda *pairs: F.array_compact(F.array(*[F.when(c, F.lit(s)) for c, s in pairs]))
    observed = F.array_compact(
        F.array(
            F.format_string("Requests observed: %d", "requests"),
            F.format_string("Blocked requests: %d", "blocked_requests"),
            F.format_string("HTTP 4xx/5xx responses: %d", "error_requests"),
            F.format_string("HTTP 5xx responses: %d", "server_error_requests"),
            F.when(F.col("most_used_route") != "n/a", F.format_string("Most used route: %s", "most_used_route")),
        )
    )
    # The sentences of an incident report.
    interpretations = pick(
        (blocked, "Blocked traffic was observed; logs alone do not establish whether it was expected or abusive."),
        (failing, "HTTP 5xx responses were observed; the request log does not establish their upstream cause."),
        (calm, "No blocked requests or HTTP 5xx responses were present in the selected request-log window."),
    )
    actions = pick(
        (blocked, "Compare the observed blocked requests with the tenant's configured rate-limit policy."),
        (failing, "Inspect upstream health and route-level logs for the observed 5xx interval."),
        (calm, "Continue monitoring; no incident cause can be inferred from the available request logs."),
    )
    return summary.select(
        "tenant_id",
        observed.alias("observed"),
        interpretations.alias("interpretations"),
        actions.alias("recommended_actions"),
        F.array(F.lit(f"request_logs: tenant-scoped, last {hours} hours")).alias("evidence_sources"),
    )


def overview(
    tenants: DataFrame,
    logs: DataFrame,
    anomalies: DataFrame | None = None,
    *,
    rows_shown: int = 10,
    as_of: datetime | None = None,
) -> DataFrame:
    """Overview per tenant: sentence, newest rows, top names, anomaly count, model status.

    Everything covers the hour up to ``as_of`` (default: the newest row).

    ``anomalies`` is the scored anomaly view; without one the count stays NULL.
    """
    logs = last_hours(logs, 1, as_of)
    summary = complete_summary(tenants, dashboard_summary(logs))
    newest = C.top_n_per_group(
        logs, ["tenant_id"], [F.col("created_at").desc(), F.col("id").desc()], rows_shown, salt_by=["id"], rank="position"
    )
    shown = newest.groupBy("tenant_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("position", "id", "method", "status_code", "latency_ms", "blocked"))),
            lambda r: F.concat_ws(" ", r["id"], r["method"], r["status_code"].cast("string")),
        ).alias("observed")
    )
    sentence = F.when(
        F.col("requests") > 0,
        F.format_string(
            "%d requests observed in the last hour; %d blocked and %d returned 4xx/5xx.",
            "requests",
            "blocked_requests",
            "error_requests",
        ),
    ).otherwise(F.lit("No request logs were observed for this tenant in the last hour."))
    out = summary.join(shown, "tenant_id", "left")
    if anomalies is None:
        out = out.withColumn("anomaly_count", F.lit(None).cast("bigint")).withColumn("model_status", F.lit("unavailable"))
    else:
        counts = anomalies.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("anomaly_count"))
        out = (
            out.join(counts, "tenant_id", "left")
            .fillna(0, ["anomaly_count"])
            .withColumn("model_status", F.lit("available"))
        )
    return out.select(
        "tenant_id",
        sentence.alias("summary"),
        F.coalesce("observed", F.array().cast("array<string>")).alias("observed"),
        # No forecaster serves the overview, so its list is empty.
        F.array().cast("array<string>").alias("forecast"),
        "top_client",
        "most_used_route",
        "blocked_requests",
        "anomaly_count",
        "model_status",
    )


# --- tenant-scoped read-only reports ---------------------------------------------


def _metrics(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("request_count"),
        F.count_if(C.is_success()).alias("success_count"),
        F.count_if(C.is_error()).alias("error_count"),
        F.count_if("blocked").alias("blocked_count"),
        F.avg("latency_ms").alias("average_latency_ms"),
        F.max("latency_ms").alias("max_latency_ms"),
    )


def route_metrics(logs: DataFrame, tenant_id: str | None = None, **filters) -> DataFrame:
    """``filters``: start, end, client_id and route_id, as in :func:`scan.scoped`."""
    return _metrics(scoped(logs, tenant_id, **filters), "tenant_id", "route_id")


def client_metrics(logs: DataFrame, tenant_id: str | None = None, **filters) -> DataFrame:
    return _metrics(scoped(logs, tenant_id, **filters), "tenant_id", "client_id")


def _recent(logs: DataFrame, condition, tenant_id: str | None, limit: int, filters: dict) -> DataFrame:
    if limit < 1:
        raise ValueError("limit must be positive")
    rows = scoped(logs, tenant_id, **filters).where(condition)
    order = [F.col("created_at").desc(), F.col("id").desc()]
    return C.top_n_per_group(rows, ["tenant_id"], order, limit, salt_by=["id"], rank="position")


def recent_errors(logs: DataFrame, tenant_id: str | None = None, limit: int = 100, **filters) -> DataFrame:
    """Newest requests whose status is not 2xx."""
    return _recent(logs, ~F.col("status_code").between(200, 299), tenant_id, limit, filters)


def rate_limit_events(logs: DataFrame, tenant_id: str | None = None, limit: int = 100, **filters) -> DataFrame:
    """Newest requests answered 429 or blocked by a limit."""
    return _recent(logs, (F.col("status_code") == 429) | F.col("blocked"), tenant_id, limit, filters)


def route_configuration(routes: DataFrame, tenant_id: str | None = None, route_id: str | None = None) -> DataFrame:
    rows = tenant_scope(routes, tenant_id)
    rows = rows.where(F.col("id") == route_id) if route_id else rows
    return rows.select(
        "tenant_id",
        F.col("id").alias("route_id"),
        "name",
        "gateway_path",
        "allowed_methods",
        "timeout_ms",
        "authentication_required",
        "active",
    )
