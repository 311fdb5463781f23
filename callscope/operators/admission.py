"""Admission audit: what the gateway decides for each request of a log."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.operators.bucket import replay
from callscope.operators.resolve import resolve_keys, resolve_policies, resolve_routes
from callscope.session import materialise

PASS = 200


def admission_audit(
    requests: DataFrame,
    clients: DataFrame,
    routes: DataFrame,
    policies: DataFrame,
    *,
    variant: str = "local",
) -> DataFrame:
    """Key, route, method and limit checks in that order, each request with its status.

    Input: ``id, tenant_id, path, method, api_key, created_at``. No route is 404, a missing
    client where one is required 401, a method outside the list 405, an empty bucket 429;
    requests without client or policy are not limited.
    """
    keyed = resolve_keys(requests, clients)
    routed = resolve_routes(keyed, routes)
    early = (
        F.when(F.col("route").isNull(), 404)
        .when(F.col("route.authentication_required") & F.col("client_id").isNull(), 401)
        .when(~F.array_contains("route.allowed_methods", F.col("method")), 405)
    )
    checked = routed.select(
        "id", "tenant_id", "client_id", F.col("route.id").alias("route_id"), "created_at", early.alias("status")
    )
    # Written once, because the limiter reads its requests several times.
    # Policies are looked up for the distinct scopes, not for every request.
    scope = ["tenant_id", "client_id", "route_id"]
    limits = materialise(resolve_policies(checked.select(*scope).distinct(), policies).select(*scope, "policy"), "limits")
    same = reduce(lambda a, b: a & b, [checked[c].eqNullSafe(limits[c]) for c in scope])
    limited = materialise(
        checked.join(limits, same).select(
            *[checked[c] for c in checked.columns],
            F.col("policy.bucket_capacity").alias("bucket_capacity"),
            F.col("policy.refill_rate").alias("refill_rate"),
            (checked["status"].isNull() & checked["client_id"].isNotNull() & F.col("policy").isNotNull()).alias("metered"),
        ),
        "admission",
    )
    metered = limited.where("metered")
    unmetered = limited.where("not metered").select(
        "id", "tenant_id", "client_id", "route_id", F.coalesce("status", F.lit(PASS)).alias("status")
    )
    decided = replay(metered, variant=variant, carry=["bucket_capacity"]).select(
        "id",
        "tenant_id",
        "client_id",
        "route_id",
        F.when(F.col("allowed"), PASS).otherwise(429).alias("status"),
        F.col("bucket_capacity").alias("rate_limit"),
        F.col("remaining").alias("rate_remaining"),
        F.when(F.col("allowed"), F.lit(0))
        .otherwise(F.greatest(F.floor(F.col("retry_after_ns") / 1_000_000_000), F.lit(1)))
        .cast("bigint")
        .alias("rate_reset_seconds"),
    )
    return decided.unionByName(unmetered, allowMissingColumns=True)
