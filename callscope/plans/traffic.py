"""Registered queries: traffic analytics and log scans."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from callscope.functions.columns import time_text
from callscope.operators import scan, traffic
from callscope.sources import adapters as A

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register


LOGS = A.sql_logs()


@query(
    A.with_ctes(
        LOGS,
        A.SQL_ROUTES,
        """named AS (SELECT l.tenant_id, r.name, count(*) AS n FROM request_logs l
  LEFT JOIN gateway_routes r ON r.id = l.route_id AND r.tenant_id = l.tenant_id GROUP BY 1, 2)
SELECT tenant_id, count(*) AS total_requests,
  count(*) FILTER (WHERE status_code BETWEEN 200 AND 399 AND NOT blocked) AS successful_requests,
  count(*) FILTER (WHERE blocked) AS blocked_requests,
  round(coalesce(avg(latency_ms), 0), 6) AS average_response_ms,
  count(DISTINCT client_id) AS active_clients,
  coalesce((SELECT name FROM named WHERE named.tenant_id = l.tenant_id
            ORDER BY n DESC, name NULLS FIRST LIMIT 1), '') AS most_used_route
FROM request_logs l GROUP BY tenant_id""",
    )
)
def tenant_summary(spark, sf_dir):
    out = traffic.tenant_summary(A.request_logs(spark, sf_dir), A.gateway_routes(spark, sf_dir))
    return out.withColumn("average_response_ms", F.round("average_response_ms", 6))


@query(
    A.with_ctes(
        A.sql_logs(60),
        """SELECT tenant_id, strftime(date_trunc('hour', created_at), '%Y-%m-%dT%H:00:00Z') AS bucket,
  count(*) AS request_count, CAST(round(avg(latency_ms)) AS BIGINT) AS average_latency_ms
FROM request_logs GROUP BY 1, 2""",
    )
)
def traffic_hourly(spark, sf_dir):
    return traffic.traffic_hourly(A.request_logs(spark, sf_dir, 60))


@query(A.with_ctes(LOGS, "SELECT tenant_id, status_code, count(*) AS request_count FROM request_logs GROUP BY 1, 2"))
def status_distribution(spark, sf_dir):
    return traffic.status_distribution(A.request_logs(spark, sf_dir))


@query(
    A.with_ctes(
        LOGS,
        A.SQL_CLIENTS,
        """SELECT l.tenant_id, coalesce(c.name, 'Unknown') AS name, count(*) AS request_count FROM request_logs l
LEFT JOIN api_clients c ON c.id = l.client_id AND c.tenant_id = l.tenant_id GROUP BY 1, 2""",
    )
)
def requests_by_client(spark, sf_dir):
    return traffic.requests_by_client(A.request_logs(spark, sf_dir), A.api_clients(spark, sf_dir))


@query(
    A.with_ctes(
        LOGS,
        A.SQL_ROUTES,
        """SELECT l.tenant_id, coalesce(r.name, 'Unknown') AS name, count(*) AS blocked_count FROM request_logs l
LEFT JOIN gateway_routes r ON r.id = l.route_id AND r.tenant_id = l.tenant_id WHERE l.blocked GROUP BY 1, 2""",
    )
)
def blocked_by_route(spark, sf_dir):
    return traffic.blocked_by_route(A.request_logs(spark, sf_dir), A.gateway_routes(spark, sf_dir))


@query(
    A.with_ctes(
        A.sql_logs(60),
        A.SQL_CLIENTS,
        A.SQL_ROUTES,
        """hours AS (SELECT tenant_id, strftime(date_trunc('hour', created_at), '%Y-%m-%dT%H:00:00Z') AS label,
  count(*) AS n, CAST(round(avg(latency_ms)) AS BIGINT) AS mean FROM request_logs GROUP BY 1, 2)
SELECT tenant_id, 'requests_over_time' AS panel, label, n AS value FROM hours
UNION ALL SELECT tenant_id, 'latency_trend', label, mean FROM hours
UNION ALL SELECT tenant_id, 'status_distribution', CAST(status_code AS VARCHAR), count(*) FROM request_logs GROUP BY 1, 3
UNION ALL SELECT l.tenant_id, 'by_client', coalesce(c.name, 'Unknown'), count(*) FROM request_logs l
  LEFT JOIN api_clients c ON c.id = l.client_id AND c.tenant_id = l.tenant_id GROUP BY 1, 3
UNION ALL SELECT l.tenant_id, 'blocked_by_route', coalesce(r.name, 'Unknown'), count(*) FROM request_logs l
  LEFT JOIN gateway_routes r ON r.id = l.route_id AND r.tenant_id = l.tenant_id WHERE l.blocked GROUP BY 1, 3""",
    )
)
def traffic_panels(spark, sf_dir):
    return traffic.traffic_panels(
        A.request_logs(spark, sf_dir, 60), A.api_clients(spark, sf_dir), A.gateway_routes(spark, sf_dir)
    )


_LOG_OUT = "id, tenant_id, client_id, route_id, method, status_code, latency_ms, blocked, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at"


def _log_out(df, *extra):
    cols = ("id", "tenant_id", "client_id", "route_id", "method", "status_code", "latency_ms", "blocked")
    return df.select(*cols, time_text("created_at").alias("created_at"), *extra)


def _newest_sql(condition: str, n: int) -> str:
    return f"""SELECT {_LOG_OUT}, CAST(position AS INTEGER) AS position FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY created_at DESC, id DESC) AS position
FROM request_logs WHERE {condition}) WHERE position <= {n}"""


@query(A.with_ctes(LOGS, _newest_sql("true", 500)))
def recent_logs(spark, sf_dir):
    return _log_out(scan.recent_logs(A.request_logs(spark, sf_dir)), "position")


@query(A.with_ctes(LOGS, _newest_sql("status_code NOT BETWEEN 200 AND 299", 100)))
def recent_errors(spark, sf_dir):
    return _log_out(traffic.recent_errors(A.request_logs(spark, sf_dir)), "position")


@query(A.with_ctes(LOGS, _newest_sql("status_code = 429 OR blocked", 100)))
def rate_limit_events(spark, sf_dir):
    return _log_out(traffic.rate_limit_events(A.request_logs(spark, sf_dir)), "position")


@query(A.with_ctes(LOGS, f"SELECT {_LOG_OUT} FROM request_logs ORDER BY request_logs.created_at DESC, id DESC LIMIT 10000"))
def log_retention(spark, sf_dir):
    return _log_out(scan.retain_newest(A.request_logs(spark, sf_dir)))


@query(
    A.with_ctes(
        LOGS,
        f"""SELECT {_LOG_OUT} FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY created_at DESC, id DESC) AS r
FROM request_logs) WHERE r <= 1000""",
    )
)
def log_retention_per_tenant(spark, sf_dir):
    return _log_out(scan.retain_newest(A.request_logs(spark, sf_dir), 1000, per_tenant=True))


@query(
    A.with_ctes(
        LOGS,
        """SELECT tenant_id, client_id, route_id, method, status_code, latency_ms, blocked,
  strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM request_logs
WHERE tenant_id = 'tenant-1' AND client_id = 'client-1' AND request_logs.created_at >= TIMESTAMP '2024-01-01 00:10:00'
  AND request_logs.created_at < TIMESTAMP '2024-01-01 01:00:00'
ORDER BY request_logs.created_at DESC, id DESC LIMIT 1000""",
    )
)
def bounded_scan(spark, sf_dir):
    at = lambda h, m: datetime(2024, 1, 1, h, m, tzinfo=timezone.utc)
    out = scan.bounded_scan(
        A.request_logs(spark, sf_dir), "tenant-1", at(0, 10), at(1, 0), client_id="client-1", limit=1000
    )
    return out.withColumn("created_at", time_text("created_at"))


def _metrics_sql(key: str) -> str:
    return f"""SELECT tenant_id, {key}, count(*) AS request_count,
  count(*) FILTER (WHERE status_code BETWEEN 200 AND 399 AND NOT blocked) AS success_count,
  count(*) FILTER (WHERE status_code >= 400) AS error_count, count(*) FILTER (WHERE blocked) AS blocked_count,
  round(avg(latency_ms), 6) AS average_latency_ms, max(latency_ms) AS max_latency_ms
FROM request_logs GROUP BY 1, 2"""


@query(A.with_ctes(LOGS, _metrics_sql("route_id")))
def route_metrics(spark, sf_dir):
    out = traffic.route_metrics(A.request_logs(spark, sf_dir))
    return out.withColumn("average_latency_ms", F.round("average_latency_ms", 6))


@query(A.with_ctes(LOGS, _metrics_sql("client_id")))
def client_metrics(spark, sf_dir):
    out = traffic.client_metrics(A.request_logs(spark, sf_dir))
    return out.withColumn("average_latency_ms", F.round("average_latency_ms", 6))


@query(
    A.with_ctes(
        LOGS,
        A.SQL_ROUTES,
        """SELECT tenant_id, id AS route_id, name, gateway_path, array_to_string(allowed_methods, ',') AS allowed_methods,
  timeout_ms, authentication_required, active FROM gateway_routes""",
    )
)
def route_configuration(spark, sf_dir):
    out = traffic.route_configuration(A.gateway_routes(spark, sf_dir))
    return out.withColumn("allowed_methods", F.array_join("allowed_methods", ","))


@query(
    A.with_ctes(
        LOGS,
        A.SQL_CLIENTS,
        """SELECT tenant_id, id, name, api_key_prefix, status FROM api_clients""",
    )
)
def client_listing(spark, sf_dir):
    rows = scan.dimension_scan(A.api_clients(spark, sf_dir))
    return rows.select("tenant_id", "id", "name", "api_key_prefix", "status")


SUMMARY_SQL = """per_client AS (SELECT tenant_id, client_id AS v, count(*) AS n FROM request_logs GROUP BY 1, 2),
per_route AS (SELECT tenant_id, route_id AS v, count(*) AS n FROM request_logs GROUP BY 1, 2),
per_code AS (SELECT tenant_id, CAST(status_code AS VARCHAR) AS v, count(*) AS n FROM request_logs GROUP BY 1, 2),
summary AS (SELECT tenant_id, count(*) AS requests, count(*) FILTER (WHERE blocked) AS blocked_requests,
  count(*) FILTER (WHERE status_code >= 400) AS error_requests,
  count(*) FILTER (WHERE status_code >= 500) AS server_error_requests,
  round(avg(latency_ms), 2) AS average_latency_ms,
  (SELECT v FROM per_client p WHERE p.tenant_id = l.tenant_id ORDER BY n DESC, v LIMIT 1) AS top_client,
  (SELECT v FROM per_route p WHERE p.tenant_id = l.tenant_id ORDER BY n DESC, v LIMIT 1) AS most_used_route,
  (SELECT string_agg(v || '=' || CAST(n AS VARCHAR), ',' ORDER BY v) FROM per_code p WHERE p.tenant_id = l.tenant_id) AS status_counts
  FROM request_logs l GROUP BY tenant_id)"""


@query(A.with_ctes(LOGS, SUMMARY_SQL, "SELECT * FROM summary"))
def dashboard_summary(spark, sf_dir):
    out = traffic.dashboard_summary(A.request_logs(spark, sf_dir))
    entries = F.transform(F.map_entries("status_counts"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return out.withColumn("status_counts", F.array_join(entries, ","))


@query(
    A.with_ctes(
        A.sql_last_hours(2),
        SUMMARY_SQL,
        """SELECT tenant_id,
  'Observed ' || requests || ' requests from ' || (SELECT strftime(max(created_at) - INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00 through '
    || strftime(max(created_at), '%Y-%m-%dT%H:%M:%S.%f') || '+00:00.' FROM all_logs) AS summary,
  'Requests observed: ' || requests || '|Blocked requests: ' || blocked_requests || '|HTTP 4xx/5xx responses: ' || error_requests
    || '|HTTP 5xx responses: ' || server_error_requests || '|Most used route: ' || most_used_route AS observed,
  concat_ws('|',
    CASE WHEN blocked_requests > 0 THEN 'Blocked traffic was observed; logs alone do not establish whether it was expected or abusive.' END,
    CASE WHEN server_error_requests > 0 THEN 'HTTP 5xx responses were observed; the request log does not establish their upstream cause.' END,
    CASE WHEN blocked_requests = 0 AND server_error_requests = 0 THEN 'No blocked requests or HTTP 5xx responses were present in the selected request-log window.' END) AS interpretations,
  concat_ws('|',
    CASE WHEN blocked_requests > 0 THEN 'Compare the observed blocked requests with the tenant''s configured rate-limit policy.' END,
    CASE WHEN server_error_requests > 0 THEN 'Inspect upstream health and route-level logs for the observed 5xx interval.' END,
    CASE WHEN blocked_requests = 0 AND server_error_requests = 0 THEN 'Continue monitoring; no incident cause can be inferred from the available request logs.' END) AS recommended_actions
FROM summary""",
    )
)
def incident_findings(spark, sf_dir):
    """The last two hours of the log."""
    return traffic.incident_report(A.tenants(spark, sf_dir), A.request_logs(spark, sf_dir)).select(
        "tenant_id",
        "summary",
        *[F.array_join(c, "|").alias(c) for c in ("observed", "interpretations", "recommended_actions")],
    )


@query(
    A.with_ctes(
        A.sql_last_hours(1),
        SUMMARY_SQL,
        """newest AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY created_at DESC, id DESC) AS position FROM request_logs)
SELECT s.tenant_id, requests || ' requests observed in the last hour; ' || blocked_requests || ' blocked and ' || error_requests || ' returned 4xx/5xx.' AS summary,
  (SELECT string_agg(id || ' ' || method || ' ' || status_code, '|' ORDER BY position) FROM newest n WHERE n.tenant_id = s.tenant_id AND position <= 10) AS observed, '' AS forecast,
  top_client, most_used_route, blocked_requests, CAST(NULL AS BIGINT) AS anomaly_count, 'unavailable' AS model_status
FROM summary s""",
    )
)
def overview_without_model(spark, sf_dir):
    out = traffic.overview(A.tenants(spark, sf_dir), A.request_logs(spark, sf_dir))
    return out.withColumns({c: F.array_join(c, "|") for c in ("observed", "forecast")})


RANGE = dict(start=datetime(2024, 1, 1, 0, 30, tzinfo=timezone.utc), end=datetime(2024, 1, 1, 0, 50, tzinfo=timezone.utc))
SQL_RANGE = A.sql_logs(name="all_logs") + """,
request_logs AS (SELECT * FROM all_logs WHERE created_at >= TIMESTAMP '2024-01-01 00:30:00' AND created_at < TIMESTAMP '2024-01-01 00:50:00')"""


@query(A.with_ctes(SQL_RANGE, _metrics_sql("route_id").replace("FROM request_logs", "FROM request_logs WHERE client_id = 'client-1'")))
def route_metrics_range(spark, sf_dir):
    """One client within twenty minutes."""
    out = traffic.route_metrics(A.request_logs(spark, sf_dir), client_id="client-1", **RANGE)
    return out.withColumn("average_latency_ms", F.round("average_latency_ms", 6))


@query(A.with_ctes(SQL_RANGE, _metrics_sql("client_id").replace("FROM request_logs", "FROM request_logs WHERE route_id = 'route-view'")))
def client_metrics_range(spark, sf_dir):
    """One route within twenty minutes."""
    out = traffic.client_metrics(A.request_logs(spark, sf_dir), route_id="route-view", **RANGE)
    return out.withColumn("average_latency_ms", F.round("average_latency_ms", 6))


@query(
    f"""SELECT tenant_id, panel, label, value, CAST(row_number() OVER (PARTITION BY tenant_id, panel
  ORDER BY CASE WHEN panel IN ('by_client', 'blocked_by_route') THEN -value END, label) AS INTEGER) AS position FROM ({ORACLES['traffic_panels']})"""
)
def panel_positions(spark, sf_dir):
    return traffic.panel_order(QUERIES["traffic_panels"](spark, sf_dir))
