"""Key, route and policy resolution for many requests at once, by equi-joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.functions.columns import blank_to_null

KEY_PREFIX_CHARS = 16  # fixed value: characters of a key stored in clear


def resolve_keys(requests: DataFrame, clients: DataFrame) -> DataFrame:
    """Add ``client_id`` and the client's tenant for requests whose ``api_key`` is valid.

    Unknown, revoked and wrong keys all leave ``client_id`` NULL and the tenant as it was.
    """
    known = clients.where(F.col("status") == "active").select(
        F.col("api_key_prefix").alias("_prefix"),
        F.col("api_key_hash").alias("_hash"),
        F.col("id").alias("client_id"),
        F.col("tenant_id").alias("_tenant"),
    )
    key = blank_to_null("api_key")
    return (
        requests.withColumn("_prefix", F.substring(key, 1, KEY_PREFIX_CHARS))
        .withColumn("_hash", F.sha2(key, 256))
        .join(known, ["_prefix", "_hash"], "left")
        .withColumn("tenant_id", F.coalesce("_tenant", "tenant_id"))
        .drop("_prefix", "_hash", "_tenant")
    )


def resolve_routes(requests: DataFrame, routes: DataFrame) -> DataFrame:
    """Add ``route`` (a struct, NULL if none): the longest active path that leads the request path.

    A stored path matches itself and everything below it. Each distinct request path is
    cut into its leading parts, which meet the stored paths in an equi-join.
    """
    table = routes.where(F.col("active")).select(
        "tenant_id",
        F.regexp_replace("gateway_path", "/+$", "").alias("_lead"),
        F.struct(
            F.length("gateway_path").alias("path_length"),
            "id",
            "gateway_path",
            "allowed_methods",
            "authentication_required",
        ).alias("route"),
    )
    parts = F.split("path", "/")
    leads = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/")
    )
    paths = requests.select("tenant_id", "path").distinct()
    found = (
        paths.withColumn("_lead", F.explode(F.array_distinct(F.array_append(leads, F.col("path")))))
        .join(table, ["tenant_id", "_lead"])
        .where((F.col("route.gateway_path") == F.col("path")) | F.startswith(F.col("path"), F.concat("_lead", F.lit("/"))))
        .groupBy("tenant_id", "path")
        .agg(F.min_by("route", F.struct(-F.col("route.path_length"), F.col("route.id"))).alias("route"))
    )
    return requests.join(found, ["tenant_id", "path"], "left")


# Scopes from most to least specific; ties of one NULL go to the client.
_SCOPES = (("client", "route"), ("client",), ("route",), ())


def resolve_policies(keys: DataFrame, policies: DataFrame) -> DataFrame:
    """Add ``policy`` (a struct, NULL if none) to rows with tenant, client and route ids.

    The enabled policy with the fewest open scopes wins: both ids, client only, route
    only, tenant-wide. Each level is one left equi-join.
    """
    enabled = policies.where(F.col("enabled")).select(
        "tenant_id",
        blank_to_null("api_client_id").alias("_c"),
        blank_to_null("route_id").alias("_r"),
        F.struct("id", "bucket_capacity", "refill_rate").alias("_p"),
    )
    column = {"client": ("_c", "client_id"), "route": ("_r", "route_id")}
    out = keys
    for level, scope in enumerate(_SCOPES):
        level_rows = enabled
        for part, (stored, _) in column.items():
            level_rows = level_rows.where(F.col(stored).isNotNull() if part in scope else F.col(stored).isNull())
        names = [F.col(column[p][0]).alias(column[p][1]) for p in scope]
        one = level_rows.select("tenant_id", *names, "_p").groupBy("tenant_id", *[column[p][1] for p in scope]).agg(
            F.min_by("_p", "_p.id").alias(f"_p{level}")
        )
        out = out.join(one, ["tenant_id", *[column[p][1] for p in scope]], "left")
    picks = [f"_p{level}" for level in range(len(_SCOPES))]
    return out.withColumn("policy", F.coalesce(*picks)).drop(*picks)


def clients_with_policy(clients: DataFrame, policies: DataFrame) -> DataFrame:
    """Client listing without key hashes, with the policy that applies regardless of route."""
    keys = clients.drop("api_key_hash").withColumnRenamed("id", "client_id").withColumn("route_id", F.lit(None).cast("string"))
    return resolve_policies(keys, policies).drop("route_id")
