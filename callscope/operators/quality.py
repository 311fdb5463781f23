"""Audits of the gateway tables: constraints, routes, references, uniqueness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.functions import addresses
from callscope.schemas import DEFAULT_METHODS, VALID_METHODS


def _violations(df: DataFrame, table: str, id_column: str, rules: dict[str, Column]) -> DataFrame:
    """One row per (row, broken rule). A rule is the condition that breaks it."""
    broken = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]))
    return df.select(F.lit(table).alias("table_name"), F.col(id_column).alias("row_id"), F.explode(broken).alias("violation"))


# Allowed states and limits of the gateway tables.
TENANT_STATES, CLIENT_STATES = ("active", "suspended"), ("active", "revoked")
TIMEOUT_MS = (100, 120_000)
DEFAULT_TIMEOUT_MS = 5000


def constraint_audit(tenants: DataFrame, clients: DataFrame, routes: DataFrame, policies: DataFrame) -> DataFrame:
    return reduce(
        DataFrame.unionByName,
        [
            _violations(tenants, "tenants", "id", {"status": ~F.col("status").isin(*TENANT_STATES)}),
            _violations(clients, "api_clients", "id", {"status": ~F.col("status").isin(*CLIENT_STATES)}),
            _violations(routes, "gateway_routes", "id", {"timeout_ms": ~F.col("timeout_ms").between(*TIMEOUT_MS)}),
            _violations(
                policies,
                "rate_limit_policies",
                "id",
                {"bucket_capacity": ~(F.col("bucket_capacity") > 0), "refill_rate": ~(F.col("refill_rate") >= 0)},
            ),
        ],
    )


def with_route_defaults(routes: DataFrame) -> DataFrame:
    """Missing timeout and methods filled in, names trimmed, methods in upper case."""
    methods = F.transform("allowed_methods", lambda m: F.upper(m))
    none = F.col("allowed_methods").isNull() | (F.size("allowed_methods") == 0)
    return routes.withColumns(
        {
            "name": F.trim("name"),
            "timeout_ms": F.when(F.coalesce("timeout_ms", F.lit(0)) == 0, DEFAULT_TIMEOUT_MS).otherwise(F.col("timeout_ms")),
            "allowed_methods": F.when(none, F.array(*[F.lit(m) for m in DEFAULT_METHODS])).otherwise(methods),
        }
    )


def route_audit(routes: DataFrame, *, production: bool = False) -> DataFrame:
    """The first reason each route definition is refused, NULL where it is fine."""
    url = F.col("upstream_url")
    scheme, host = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)), upstream_authority(url)
    rules = (
        F.when(
            (F.coalesce("name", F.lit("")) == "")
            | ~F.startswith(F.coalesce("gateway_path", F.lit("")), F.lit("/"))
            | F.col("gateway_path").rlike("[?#]"),
            "INVALID_ROUTE_PATH",
        )
        .when(
            ~scheme.isin("http", "https") | (host == "") | host.contains("@") | F.col("gateway_path").contains(".."),
            "INVALID_UPSTREAM_URL",
        )
    )
    if production:
        rules = rules.when(unsafe_upstream(url).isNotNull(), "INVALID_UPSTREAM_URL")
    rules = rules.when(~F.col("timeout_ms").between(*TIMEOUT_MS), "INVALID_TIMEOUT").when(
        F.size(F.array_except("allowed_methods", F.array(*[F.lit(m) for m in VALID_METHODS]))) > 0, "INVALID_METHOD"
    )
    return with_route_defaults(routes).withColumn("problem", rules)


def upstream_authority(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def upstream_host(url: Column) -> Column:
    """Host without user, port and IPv6 brackets, in lower case."""
    host = F.regexp_replace(upstream_authority(url), r"^.*@", "")
    bracketed = F.regexp_extract(host, r"^\[([^\]]*)\]", 1)
    return F.lower(F.when(bracketed != "", bracketed).otherwise(F.regexp_replace(host, r":[0-9]*$", "")))


# Hosts and address ranges that must not be reached.
BLOCKED_HOSTS = {"localhost": "loopback", "metadata.google.internal": "metadata"}
BLOCKED_RANGES = {
    "127.0.0.0/8": "loopback",
    "10.0.0.0/8": "private",
    "172.16.0.0/12": "private",
    "192.168.0.0/16": "private",
    "169.254.0.0/16": "link-local",
    "169.254.169.254/32": "metadata",
    "::1/128": "loopback",
    "fc00::/7": "private",
    "fe80::/10": "link-local",
}


def unsafe_upstream(url: Column) -> Column:
    """Why an upstream literal is unsafe ('loopback', 'private', ...), NULL if it is not.

    Works on host names and address literals only; nothing is resolved.
    """
    host = upstream_host(url)
    named = F.lit(None).cast("string")
    for name, why in BLOCKED_HOSTS.items():
        named = F.when(host == name, why).otherwise(named)
    return F.coalesce(named, addresses.longest_prefix(addresses.address_bits(host), BLOCKED_RANGES))


def referential_audit(
    tenants: DataFrame, clients: DataFrame, routes: DataFrame, policies: DataFrame, logs: DataFrame
) -> DataFrame:
    """Rows that point to nothing: (table, reference, missing id, rows)."""
    owners = tenants.select(F.col("id").alias("tenant_id"))
    dims = {
        "client_id": clients.select("tenant_id", F.col("id").alias("client_id")).distinct(),
        "route_id": routes.select("tenant_id", F.col("id").alias("route_id")).distinct(),
    }

    def orphans(df: DataFrame, table: str, column: str, target: DataFrame, keys) -> DataFrame:
        # Counting first leaves one row per reference for the anti-join.
        counts = df.where(F.col(column).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"))
        return counts.join(target, list(keys), "left_anti").select(
            F.lit(table).alias("table_name"), F.lit(column).alias("reference"), F.col(column).alias("missing_id"), "row_count"
        )

    checks = [
        orphans(df, table, "tenant_id", owners, ["tenant_id"])
        for table, df in (("api_clients", clients), ("gateway_routes", routes), ("rate_limit_policies", policies), ("request_logs", logs))
    ]
    scoped = policies.withColumnRenamed("api_client_id", "client_id")
    for table, df in (("request_logs", logs), ("rate_limit_policies", scoped)):
        checks += [orphans(df, table, c, dim, ["tenant_id", c]) for c, dim in dims.items()]
    return reduce(DataFrame.unionByName, checks).groupBy("table_name", "reference", "missing_id").agg(
        F.sum("row_count").alias("row_count")
    )


def uniqueness_audit(tenants: DataFrame, clients: DataFrame, routes: DataFrame, policies: DataFrame) -> DataFrame:
    """Keys that occur more than once: (constraint, key, rows)."""

    def repeated(df: DataFrame, name: str, *columns) -> DataFrame:
        key = F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in columns])
        return (
            df.groupBy(key.alias("key_value"))
            .agg(F.count(F.lit(1)).alias("row_count"))
            .where(F.col("row_count") > 1)
            .select(F.lit(name).alias("constraint_name"), "key_value", "row_count")
        )

    return reduce(
        DataFrame.unionByName,
        [
            repeated(tenants, "tenant_id", "id"),
            repeated(clients, "api_key_prefix", "api_key_prefix"),
            repeated(routes, "tenant_path", "tenant_id", "gateway_path"),
            repeated(policies, "policy_scope", "tenant_id", "api_client_id", "route_id"),
        ],
    )


def conflicts(incoming: DataFrame, stored: DataFrame, key) -> DataFrame:
    """Incoming rows whose key is taken already."""
    return incoming.join(stored.select(*key).distinct(), list(key), "left_semi")
