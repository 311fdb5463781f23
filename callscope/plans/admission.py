"""Registered queries: resolution, token-bucket replay and the admission audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from callscope.operators import admission, bucket, resolve
from callscope.sources import adapters as A

QUERIES, ORACLES = {}, {}

BASE = (A.sql_logs(), A.SQL_CLIENTS, A.SQL_ROUTES, A.SQL_POLICIES, A.SQL_REQUESTS)

KEYED_SQL = """keyed AS (SELECT r.id, coalesce(c.tenant_id, r.tenant_id) AS tenant_id, c.id AS client_id, r.path, r.method, r.created_at
  FROM gateway_requests r LEFT JOIN api_clients c ON c.api_key_prefix = substr(r.api_key, 1, 16)
    AND c.api_key_hash = sha256(r.api_key) AND c.status = 'active' AND r.api_key <> '')"""

ROUTED_SQL = """routed AS (SELECT k.*, r.id AS route_id, r.allowed_methods, r.authentication_required FROM keyed k
  LEFT JOIN gateway_routes r ON r.tenant_id = k.tenant_id AND r.active
    AND (k.path = r.gateway_path OR starts_with(k.path, rtrim(r.gateway_path, '/') || '/'))
  QUALIFY row_number() OVER (PARTITION BY k.id ORDER BY length(r.gateway_path) DESC NULLS LAST, r.id) = 1)"""

POLICY_SQL = """policed AS (SELECT k.tenant_id, k.client_id, k.route_id, p.id AS policy_id, p.bucket_capacity, p.refill_rate
  FROM (SELECT DISTINCT tenant_id, client_id, route_id FROM {keys}) k
  LEFT JOIN rate_limit_policies p ON p.tenant_id = k.tenant_id AND p.enabled
    AND (p.api_client_id = k.client_id OR p.api_client_id IS NULL) AND (p.route_id = k.route_id OR p.route_id IS NULL)
  QUALIFY row_number() OVER (PARTITION BY k.tenant_id, k.client_id, k.route_id
    ORDER BY CAST(p.api_client_id IS NULL AS INTEGER) + CAST(p.route_id IS NULL AS INTEGER), p.api_client_id NULLS LAST, p.id) = 1)"""

# The fold as a recursion over the request number of a bucket, in whole numbers of 1e-12 tokens.
FOLD_SQL = """numbered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tenant_id, client_id, route_id ORDER BY created_at, id) AS rn,
    CAST(round(bucket_capacity * 1000000) AS HUGEINT) * 1000000 AS cap, CAST(round(refill_rate * 1000000) AS HUGEINT) AS rate,
    CAST(epoch_us(created_at) AS HUGEINT) AS us FROM metered),
fold AS (
  SELECT tenant_id, client_id, route_id, id, rn, us, cap >= 1000000000000 AS allowed,
    CASE WHEN cap >= 1000000000000 THEN cap - 1000000000000 ELSE cap END AS tokens FROM numbered WHERE rn = 1
  UNION ALL
  SELECT n.tenant_id, n.client_id, n.route_id, n.id, n.rn, n.us, least(n.cap, f.tokens + (n.us - f.us) * n.rate) >= 1000000000000,
    CASE WHEN least(n.cap, f.tokens + (n.us - f.us) * n.rate) >= 1000000000000
      THEN least(n.cap, f.tokens + (n.us - f.us) * n.rate) - 1000000000000 ELSE least(n.cap, f.tokens + (n.us - f.us) * n.rate) END
  FROM fold f JOIN numbered n ON n.tenant_id = f.tenant_id AND n.client_id = f.client_id AND n.route_id = f.route_id AND n.rn = f.rn + 1),
decided AS (SELECT f.*, n.bucket_capacity, CASE WHEN f.allowed THEN f.tokens / 1000000000000 ELSE 0.0 END AS remaining,
    CAST(CASE WHEN f.allowed THEN 0 WHEN n.rate = 0 THEN 1000000000
      ELSE ((1000000000000 - f.tokens) * 1000 + n.rate - 1) // n.rate END AS BIGINT) AS retry_after_ns
  FROM fold f JOIN numbered n ON n.id = f.id)"""


def _recursive(*parts: str) -> str:
    return A.with_ctes(*parts).replace("WITH ", "WITH RECURSIVE ", 1)


def key_lookup(spark, sf_dir):
    out = resolve.resolve_keys(A.gateway_requests(spark, sf_dir), A.api_clients(spark, sf_dir))
    return out.select("id", "tenant_id", "client_id")


QUERIES["key_lookup"] = key_lookup
ORACLES["key_lookup"] = A.with_ctes(*BASE, KEYED_SQL, "SELECT id, tenant_id, client_id FROM keyed")


def route_resolution(spark, sf_dir):
    out = resolve.resolve_routes(A.gateway_requests(spark, sf_dir), A.gateway_routes(spark, sf_dir))
    return out.select("id", "path", F.col("route.id").alias("route_id"))


QUERIES["route_resolution"] = route_resolution
ORACLES["route_resolution"] = A.with_ctes(
    *BASE,
    "keyed AS (SELECT * FROM gateway_requests)",
    ROUTED_SQL,
    "SELECT id, path, route_id FROM routed",
)


def _log_policies(spark, sf_dir):
    keys = A.request_logs(spark, sf_dir).select("tenant_id", "client_id", "route_id").distinct()
    return resolve.resolve_policies(keys, A.rate_limit_policies(spark, sf_dir))


def policy_resolution(spark, sf_dir):
    return _log_policies(spark, sf_dir).select("tenant_id", "client_id", "route_id", F.col("policy.id").alias("policy_id"))


QUERIES["policy_resolution"] = policy_resolution
ORACLES["policy_resolution"] = A.with_ctes(
    *BASE, POLICY_SQL.format(keys="request_logs"), "SELECT tenant_id, client_id, route_id, policy_id FROM policed"
)


def clients_with_policy(spark, sf_dir):
    out = resolve.clients_with_policy(A.api_clients(spark, sf_dir), A.rate_limit_policies(spark, sf_dir))
    return out.select("tenant_id", "client_id", "name", F.col("policy.id").alias("policy_id"))


QUERIES["clients_with_policy"] = clients_with_policy
ORACLES["clients_with_policy"] = A.with_ctes(
    *BASE,
    """SELECT c.tenant_id, c.id AS client_id, c.name, p.id AS policy_id FROM api_clients c
LEFT JOIN rate_limit_policies p ON p.tenant_id = c.tenant_id AND p.enabled AND p.route_id IS NULL
  AND (p.api_client_id = c.id OR p.api_client_id IS NULL)
QUALIFY row_number() OVER (PARTITION BY c.id ORDER BY p.api_client_id NULLS LAST, p.id) = 1""",
)


def _metered(spark, sf_dir):
    limits = _log_policies(spark, sf_dir).select(
        "tenant_id",
        "client_id",
        "route_id",
        F.col("policy.bucket_capacity").alias("bucket_capacity"),
        F.col("policy.refill_rate").alias("refill_rate"),
    )
    return A.request_logs(spark, sf_dir).join(limits, ["tenant_id", "client_id", "route_id"])


METERED_SQL = """metered AS (SELECT l.*, p.bucket_capacity, p.refill_rate FROM request_logs l
  JOIN policed p ON p.tenant_id = l.tenant_id AND p.client_id = l.client_id AND p.route_id = l.route_id)"""


def _replay_out(df):
    return df.select(
        "id", "tenant_id", "client_id", "route_id", "allowed", F.round("remaining", 9).alias("remaining"), "retry_after_ns"
    )


def token_bucket_replay(spark, sf_dir):
    return _replay_out(bucket.replay(_metered(spark, sf_dir)))


def token_bucket_replay_hot(spark, sf_dir):
    """The same replay in other time chunks."""
    return _replay_out(bucket.replay(_metered(spark, sf_dir), chunk_seconds=300))


REPLAY_SQL = _recursive(
    *BASE,
    POLICY_SQL.format(keys="request_logs"),
    METERED_SQL,
    FOLD_SQL,
    "SELECT id, tenant_id, client_id, route_id, allowed, round(remaining, 9) AS remaining, retry_after_ns FROM decided",
)
for fn in (token_bucket_replay, token_bucket_replay_hot):
    QUERIES[fn.__name__] = fn
    ORACLES[fn.__name__] = REPLAY_SQL


def token_bucket_replay_shared(spark, sf_dir):
    return _replay_out(bucket.replay(_metered(spark, sf_dir), variant="shared"))


QUERIES["token_bucket_replay_shared"] = token_bucket_replay_shared
ORACLES["token_bucket_replay_shared"] = _recursive(
    *BASE,
    POLICY_SQL.format(keys="request_logs"),
    METERED_SQL,
    FOLD_SQL,
    """SELECT f.id, f.tenant_id, f.client_id, f.route_id, f.allowed, round(f.tokens / 1000000000000, 9) AS remaining,
  CAST(CASE WHEN f.allowed THEN 0 WHEN n.rate = 0 THEN 1000000000
    ELSE (1000000000000 - f.tokens + n.rate * 1000000 - 1) // (n.rate * 1000000) * 1000000000 END AS BIGINT) AS retry_after_ns
FROM fold f JOIN numbered n ON n.id = f.id""",
)


def bucket_segments(spark, sf_dir):
    out = bucket.bucket_segments(_metered(spark, sf_dir))
    return out.select("id", "tenant_id", "client_id", "route_id", "segment")


QUERIES["bucket_segments"] = bucket_segments
ORACLES["bucket_segments"] = A.with_ctes(
    *BASE,
    POLICY_SQL.format(keys="request_logs"),
    METERED_SQL,
    """flagged AS (SELECT *, CASE WHEN lag(created_at) OVER w IS NULL
    OR (epoch_us(created_at) - epoch_us(lag(created_at) OVER w)) * refill_rate >= bucket_capacity * 1000000 THEN 1 ELSE 0 END AS s
  FROM metered WINDOW w AS (PARTITION BY tenant_id, client_id, route_id ORDER BY created_at, id))
SELECT id, tenant_id, client_id, route_id, CAST(sum(s) OVER (PARTITION BY tenant_id, client_id, route_id ORDER BY created_at, id) - 1 AS BIGINT) AS segment FROM flagged""",
)


def admission_audit(spark, sf_dir):
    out = admission.admission_audit(
        A.gateway_requests(spark, sf_dir),
        A.api_clients(spark, sf_dir),
        A.gateway_routes(spark, sf_dir),
        A.rate_limit_policies(spark, sf_dir),
    )
    return out.withColumn("rate_remaining", F.round("rate_remaining", 9))


QUERIES["admission_audit"] = admission_audit
ORACLES["admission_audit"] = _recursive(
    *BASE,
    KEYED_SQL,
    ROUTED_SQL,
    """checked AS (SELECT id, tenant_id, client_id, route_id, created_at, CASE WHEN route_id IS NULL THEN 404
    WHEN authentication_required AND client_id IS NULL THEN 401 WHEN NOT list_contains(allowed_methods, method) THEN 405 END AS status FROM routed)""",
    POLICY_SQL.format(keys="checked WHERE status IS NULL AND client_id IS NOT NULL"),
    """metered AS (SELECT c.*, p.bucket_capacity, p.refill_rate FROM checked c JOIN policed p
  ON p.tenant_id = c.tenant_id AND p.client_id = c.client_id AND p.route_id = c.route_id
  WHERE c.status IS NULL AND p.policy_id IS NOT NULL)""",
    FOLD_SQL,
    """SELECT c.id, c.tenant_id, c.client_id, c.route_id,
  CAST(coalesce(c.status, CASE WHEN d.allowed IS NULL OR d.allowed THEN 200 ELSE 429 END) AS INTEGER) AS status,
  d.bucket_capacity AS rate_limit, round(d.remaining, 9) AS rate_remaining,
  CASE WHEN d.allowed THEN 0 WHEN NOT d.allowed THEN greatest(d.retry_after_ns // 1000000000, 1) END AS rate_reset_seconds
FROM checked c LEFT JOIN decided d ON d.id = c.id""",
)
