"""Rule-based answers to questions, and strict reading of structured response text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callscope.functions.text import redact, route_question


def route_questions(questions: DataFrame) -> DataFrame:
    """Add ``route``; blank questions are dropped (the router takes none)."""
    return questions.where(F.trim("question") != "").withColumn("route", route_question("question"))


def answer_questions(questions: DataFrame, summary: DataFrame) -> DataFrame:
    """Templated answers over the tenant's dashboard summary.

    A tenant without a summary row has no telemetry, and its answers say so.
    """
    metrics = summary.select(
        "tenant_id", "requests", "blocked_requests", "error_requests", "server_error_requests", "most_used_route", F.lit(True).alias("_has")
    )
    rows = route_questions(questions).join(metrics, "tenant_id", "left")
    has, route = F.col("_has").isNotNull(), F.col("route")
    say = F.format_string
    one = lambda s: F.array(F.lit(s))
    none = F.array().cast("array<string>")
    # The sentences of the answers.
    observed = F.when(
        has,
        F.array(
            say("Requests in the last hour: %d", "requests"),
            say("Blocked requests: %d", "blocked_requests"),
            say("HTTP 4xx/5xx responses: %d", "error_requests"),
            say("HTTP 5xx responses: %d", "server_error_requests"),
        ),
    ).otherwise(one("Tenant request telemetry is unavailable."))
    answer = (
        F.when(
            (route == "traffic") & ~has,
            "Tenant request telemetry is currently unavailable, so I cannot summarize live traffic.",
        )
        .when((route == "traffic") & (F.col("requests") == 0), "No tenant request logs were observed in the last-hour window.")
        .when(
            route == "traffic",
            say(
                "The last-hour request logs contain %d requests, %d blocked requests, and %d HTTP 4xx/5xx responses. "
                "The most-used route in those logs is %s.",
                "requests",
                "blocked_requests",
                "error_requests",
                "most_used_route",
            ),
        )
        .when(
            route == "anomaly",
            "This assistant request does not run anomaly inference. Check the Recent anomalies panel for model-scored results and the model version.",
        )
        .when((route == "incident") & ~has, "Tenant request telemetry is unavailable; incident observations cannot be produced.")
        .when(
            route == "incident",
            say(
                "The last-hour request logs contain %d blocked requests and %d HTTP 5xx responses. "
                "The logs do not establish an incident cause.",
                "blocked_requests",
                "server_error_requests",
            ),
        )
        .when(
            route == "forecast",
            "Forecasting is implemented and evaluated offline, but no live forecast model is activated for this tenant. "
            "No future request counts are available.",
        )
        .otherwise(
            "For rate-limit behavior, inspect the route policy and the response's retry-after information. "
            "This rule-based assistant is not an external LLM and does not change gateway configuration."
        )
    )
    logs = F.when(has, one("request_logs: tenant-scoped, last hour")).otherwise(none)
    sources = (
        F.when(route.isin("traffic", "incident"), logs)
        .when(route == "anomaly", one("dashboard:recent-anomalies"))
        .when(route == "forecast", one("docs/ai-architecture.md"))
        .otherwise(F.array(F.lit("docs/rate-limits.md"), F.lit("docs/ai-security.md")))
    )
    blocked, failing = F.col("blocked_requests") > 0, F.col("server_error_requests") > 0
    actions = F.when(
        (route == "incident") & has,
        F.array_compact(
            F.array(
                F.when(blocked, "Compare blocked requests with the configured tenant rate-limit policy."),
                F.when(failing, "Inspect upstream health and route-level logs for the observed HTTP 5xx responses."),
                F.when(
                    ~blocked & ~failing,
                    "No blocked requests or HTTP 5xx responses were observed in the queried window; continue monitoring.",
                ),
            )
        ),
    ).otherwise(none)
    interpretation = F.when(route == "forecast", one("Offline evaluation is not a live forecast.")).otherwise(none)
    return rows.select(
        "question_id",
        "tenant_id",
        "route",
        answer.alias("answer"),
        sources.alias("sources"),
        observed.alias("observed"),
        interpretation.alias("interpretation"),
        actions.alias("recommended_actions"),
    )


def parse_responses(responses: DataFrame, schema: T.StructType, *, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(typed rows, rejected rows with ``problem``) from JSON response text.

    Text is redacted first. A row must be one JSON object with exactly the fields of
    ``schema``: text that is no such JSON, missing fields and extra fields are rejected.
    """
    keep = [c for c in responses.columns if c != text]
    corrupt = "_corrupt"
    names = F.array(*[F.lit(f.name) for f in schema])
    full = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])
    parsed = responses.withColumn("_text", redact(text)).withColumn(
        "_row", F.from_json("_text", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt})
    )
    keys = F.json_object_keys("_text")
    problem = (
        F.when(keys.isNull() | F.col("_row").isNull() | F.col(f"_row.{corrupt}").isNotNull(), "malformed JSON")
        .when(F.size(F.array_except(keys, names)) > 0, "extra field")
        .when(F.size(F.array_except(names, keys)) > 0, "missing field")
    )
    marked = parsed.withColumn("problem", problem)
    good = marked.where(F.col("problem").isNull()).select(*keep, *[F.col(f"_row.{f.name}").alias(f.name) for f in schema])
    return good, marked.where(F.col("problem").isNotNull()).select(*keep, F.col("_text").alias(text), "problem")
