"""Registered queries: audits, merges and change feeds on the gateway tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from callscope.functions import addresses
from callscope.functions.columns import time_text
from callscope.operators import quality, upsert
from callscope.sources import adapters as A

QUERIES, ORACLES = {}, {}

BASE = (A.sql_logs(), A.SQL_CLIENTS, A.SQL_ROUTES, A.SQL_POLICIES)


def _number(df, column="id"):
    """A number fixed by the text of an id, equal in both engines: its length and last character."""
    return F.length(column) * 7 + F.ascii(F.substring(column, -1, 1))


NUM = "(length({0}) * 7 + ascii(substr({0}, length({0}), 1)))"


def _damaged(spark, sf_dir):
    """The gateway tables with some cells broken by a rule on the id."""
    tenants = A.tenants(spark, sf_dir).withColumn("status", F.when(_number(None) % 2 == 0, "paused").otherwise(F.col("status")))
    clients = A.api_clients(spark, sf_dir).withColumn("status", F.when(_number(None) % 3 == 0, "lost").otherwise(F.col("status")))
    routes = A.gateway_routes(spark, sf_dir).withColumn("timeout_ms", F.when(_number(None) % 3 == 0, 50).otherwise(F.col("timeout_ms")))
    policies = A.rate_limit_policies(spark, sf_dir)
    policies = policies.withColumn("bucket_capacity", F.when(_number(None) % 4 == 0, 0.0).otherwise(F.col("bucket_capacity"))).withColumn(
        "refill_rate", F.when(_number(None) % 5 == 0, -1.0).otherwise(F.col("refill_rate"))
    )
    return tenants, clients, routes, policies


def constraint_audit(spark, sf_dir):
    return quality.constraint_audit(*_damaged(spark, sf_dir))


_N = NUM.format("id")
QUERIES["constraint_audit"] = constraint_audit
ORACLES["constraint_audit"] = A.with_ctes(
    *BASE,
    f"""SELECT 'tenants' AS table_name, id AS row_id, 'status' AS violation FROM (SELECT DISTINCT tenant_id AS id FROM request_logs) WHERE {_N} % 2 = 0
UNION ALL SELECT 'api_clients', id, 'status' FROM api_clients WHERE {_N} % 3 = 0
UNION ALL SELECT 'gateway_routes', id, 'timeout_ms' FROM gateway_routes WHERE {_N} % 3 = 0
UNION ALL SELECT 'rate_limit_policies', id, 'bucket_capacity' FROM rate_limit_policies WHERE {_N} % 4 = 0
UNION ALL SELECT 'rate_limit_policies', id, 'refill_rate' FROM rate_limit_policies WHERE {_N} % 5 = 0""",
)


def referential_audit(spark, sf_dir):
    """Orphans after one client and all ``error`` routes are gone."""
    clients = A.api_clients(spark, sf_dir).where(F.col("id") != "client-2")
    routes = A.gateway_routes(spark, sf_dir).where(F.col("id") != "route-error")
    return quality.referential_audit(
        A.tenants(spark, sf_dir), clients, routes, A.rate_limit_policies(spark, sf_dir), A.request_logs(spark, sf_dir)
    )


QUERIES["referential_audit"] = referential_audit
ORACLES["referential_audit"] = A.with_ctes(
    *BASE,
    """known_clients AS (SELECT * FROM api_clients WHERE id <> 'client-2'), known_routes AS (SELECT * FROM gateway_routes WHERE id <> 'route-error'),
refs AS (SELECT 'request_logs' AS table_name, tenant_id, client_id, route_id FROM request_logs
  UNION ALL SELECT 'rate_limit_policies', tenant_id, api_client_id, route_id FROM rate_limit_policies)
SELECT table_name, 'client_id' AS reference, client_id AS missing_id, count(*) AS row_count FROM refs r
WHERE client_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM known_clients c WHERE c.id = r.client_id AND c.tenant_id = r.tenant_id) GROUP BY 1, 3
UNION ALL SELECT table_name, 'route_id', route_id, count(*) FROM refs r
WHERE route_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM known_routes c WHERE c.id = r.route_id AND c.tenant_id = r.tenant_id) GROUP BY 1, 3""",
)


def set_null_on_delete(spark, sf_dir):
    clients = A.api_clients(spark, sf_dir).where(F.col("id") != "client-2")
    routes = A.gateway_routes(spark, sf_dir).where(F.col("id") != "route-error")
    out = upsert.set_null_on_delete(A.request_logs(spark, sf_dir), clients, routes)
    return out.select("id", "tenant_id", "client_id", "route_id")


QUERIES["set_null_on_delete"] = set_null_on_delete
ORACLES["set_null_on_delete"] = A.with_ctes(
    *BASE,
    """SELECT l.id, l.tenant_id, c.id AS client_id, r.id AS route_id FROM request_logs l
LEFT JOIN api_clients c ON c.id = l.client_id AND c.tenant_id = l.tenant_id AND c.id <> 'client-2'
LEFT JOIN gateway_routes r ON r.id = l.route_id AND r.tenant_id = l.tenant_id AND r.id <> 'route-error'""",
)


def uniqueness_audit(spark, sf_dir):
    """Duplicates once every client and route has been written twice for some ids."""
    twice = lambda df: df.unionByName(df.where(_number(None) % 2 == 0))
    return quality.uniqueness_audit(
        A.tenants(spark, sf_dir),
        twice(A.api_clients(spark, sf_dir)),
        twice(A.gateway_routes(spark, sf_dir)),
        twice(A.rate_limit_policies(spark, sf_dir)),
    )


QUERIES["uniqueness_audit"] = uniqueness_audit
ORACLES["uniqueness_audit"] = A.with_ctes(
    *BASE,
    f"""SELECT 'api_key_prefix' AS constraint_name, api_key_prefix AS key_value, count(*) AS row_count
FROM (SELECT * FROM api_clients UNION ALL SELECT * FROM api_clients WHERE {_N} % 2 = 0) GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'tenant_path', tenant_id || '|' || gateway_path, count(*)
FROM (SELECT * FROM gateway_routes UNION ALL SELECT * FROM gateway_routes WHERE {_N} % 2 = 0) GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'policy_scope', tenant_id || '|' || coalesce(api_client_id, '') || '|' || coalesce(route_id, ''), count(*)
FROM (SELECT * FROM rate_limit_policies UNION ALL SELECT * FROM rate_limit_policies WHERE {_N} % 2 = 0) GROUP BY 2 HAVING count(*) > 1""",
)


def page_urls(spark, sf_dir):
    """Host and safety class of the upstreams named by the page table, some made internal."""
    pages = A.table(spark, sf_dir, "pages")
    host = F.element_at(F.array(*[F.lit(h) for h in INTERNAL]), (F.col("page_id") % len(INTERNAL) + 1).cast("int"))
    url = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("http://"), host, F.lit(":8080/x"))).otherwise(F.col("url"))
    return pages.select("page_id", quality.upstream_host(url).alias("host"), quality.unsafe_upstream(url).alias("unsafe"))


INTERNAL = (
    "localhost",
    "127.3.0.1",
    "10.1.2.3",
    "172.20.0.9",
    "172.40.0.9",
    "192.168.7.7",
    "169.254.1.1",
    "169.254.169.254",
    "metadata.google.internal",
    "8.8.8.8",
    "192.169.1.1",
)
_HOSTS = ", ".join(f"'{h}'" for h in INTERNAL)
QUERIES["page_urls"] = page_urls
ORACLES["page_urls"] = f"""WITH urls AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN ([{_HOSTS}])[CAST(page_id % {len(INTERNAL)} AS INTEGER) + 1]
    ELSE lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)) END AS host FROM pages)
SELECT page_id, host, CASE WHEN host IN ('metadata.google.internal', '169.254.169.254') THEN 'metadata'
  WHEN host = 'localhost' OR regexp_matches(host, '^127[.]') THEN 'loopback'
  WHEN regexp_matches(host, '^(10[.]|192[.]168[.]|172[.](1[6-9]|2[0-9]|3[01])[.])[0-9.]+$') THEN 'private'
  WHEN regexp_matches(host, '^169[.]254[.][0-9.]+$') THEN 'link-local' END AS unsafe FROM urls"""


#: Address literals made of a number %s (hexadecimal) or %d, and their class.
LITERALS = (
    ("::ffff:7f00:%s", "loopback"),
    ("0:0:0:0:0:ffff:10.0.3.%d", "private"),
    ("::ffff:a9fe:a9fe", "metadata"),
    ("FD00::%s", "private"),
    ("fe80::1:%s", "link-local"),
    ("febf:0:0::%s:1", "link-local"),
    ("fec0::%s", None),
    ("0000:0000:0000:0000:0000:0000:0000:0001", "loopback"),
    ("::", None),
    ("2001:db8::%s", None),
    ("::ffff:8.8.8.%d", None),
    ("::192.168.0.%d", None),
    ("fc00:1:2:3:4:5:6:%s", "private"),
    ("::ffff:169.254.7.%d", "link-local"),
    ("1:2:3:4:5:6:7::", None),
    ("fd00:1:2:3:4:5:6:7:8", None),
    ("fd00::1::%s", None),
    ("172.31.0.%d", "private"),
)


def upstream_addresses(spark, sf_dir):
    """The class of upstreams given by address, by prefixes in an expression and by a table of networks."""
    n = F.col("page_id") % 251
    shapes = F.element_at(F.array(*[F.lit(text) for text, _ in LITERALS]), (F.col("page_id") % len(LITERALS) + 1).cast("int"))
    host = F.replace(F.replace(shapes, F.lit("%s"), F.lower(F.hex(n))), F.lit("%d"), n.cast("string"))
    rows = A.table(spark, sf_dir, "pages").select("page_id", host.alias("host"))
    url = F.concat(F.lit("https://"), F.when(F.contains(F.col("host"), F.lit(":")), F.concat(F.lit("["), "host", F.lit("]"))).otherwise(F.col("host")), F.lit("/v1"))
    rows = rows.withColumns({"unsafe": quality.unsafe_upstream(url), "bits": addresses.address_bits("host")})
    networks = spark.createDataFrame([(addresses.prefix_bits(c), label) for c, label in quality.BLOCKED_RANGES.items()], "prefix string, label string")
    found = addresses.match_networks(rows, "bits", networks, "by_table")
    return found.select("page_id", "host", "unsafe", "by_table", F.col("bits").isNotNull().alias("literal"))


QUERIES["upstream_addresses"] = upstream_addresses
_SHAPES = ", ".join(f"('{text}', {f"'{why}'" if why else 'CAST(NULL AS VARCHAR)'}, {'false' if text.startswith(('fd00:1:', 'fd00::1::')) else 'true'})" for text, why in LITERALS)
ORACLES["upstream_addresses"] = f"""WITH shapes AS (SELECT *, row_number() OVER () - 1 AS k FROM (VALUES {_SHAPES}) v(shape, why, literal))
SELECT page_id, replace(replace(shape, '%s', lower(printf('%X', page_id % 251))), '%d', CAST(page_id % 251 AS VARCHAR)) AS host,
  why AS unsafe, why AS by_table, literal FROM pages JOIN shapes ON page_id % {len(LITERALS)} = k"""


def route_audit(spark, sf_dir):
    """Route definitions, damaged in turn by a rule on the id."""
    n = F.pmod(F.col("page_id"), F.lit(9))
    routes = A.table(spark, sf_dir, "pages").select(
        F.col("page_id").cast("string").alias("id"),
        F.when(n == 0, "  ").otherwise("page").alias("name"),
        F.when(n == 1, "page").when(n == 2, "/page?x").when(n == 3, "/a/../b").otherwise("/page").alias("gateway_path"),
        F.when(n == 4, "ftp://x.example.com").when(n == 5, "https://u@x.example.com/").otherwise(F.col("url")).alias("upstream_url"),
        F.when(n == 6, F.array(F.lit("get"), F.lit("fetch"))).when(n == 7, F.array().cast("array<string>")).otherwise(F.array(F.lit("get"))).alias("allowed_methods"),
        F.when(n == 8, 99).otherwise(0).alias("timeout_ms"),
    )
    out = quality.route_audit(routes)
    return out.select("id", "problem", "timeout_ms", F.array_join("allowed_methods", ",").alias("allowed_methods"))


QUERIES["route_audit"] = route_audit
ORACLES["route_audit"] = """SELECT CAST(page_id AS VARCHAR) AS id,
  CASE page_id % 9 WHEN 0 THEN 'INVALID_ROUTE_PATH' WHEN 1 THEN 'INVALID_ROUTE_PATH' WHEN 2 THEN 'INVALID_ROUTE_PATH'
    WHEN 3 THEN 'INVALID_UPSTREAM_URL' WHEN 4 THEN 'INVALID_UPSTREAM_URL' WHEN 5 THEN 'INVALID_UPSTREAM_URL'
    WHEN 6 THEN 'INVALID_METHOD' WHEN 8 THEN 'INVALID_TIMEOUT' END AS problem,
  CAST(CASE WHEN page_id % 9 = 8 THEN 99 ELSE 5000 END AS INTEGER) AS timeout_ms,
  CASE page_id % 9 WHEN 6 THEN 'GET,FETCH' WHEN 7 THEN 'GET,POST,PUT,PATCH,DELETE' ELSE 'GET' END AS allowed_methods FROM pages"""


def policy_upsert(spark, sf_dir):
    """New limits for some scopes of the policy table and for two scopes it does not have."""
    stored = A.rate_limit_policies(spark, sf_dir)
    later = F.timestamp_micros(F.lit(A.BASE_MICROS + 10**6))
    changed = stored.where(_number(None) % 2 == 0).withColumns(
        {"id": F.concat(F.lit("new/"), "id"), "bucket_capacity": F.col("bucket_capacity") * 10, "updated_at": later, "created_at": later,
         "api_client_id": F.coalesce("api_client_id", F.lit("")), "route_id": F.coalesce("route_id", F.lit(""))}
    )
    fresh = changed.withColumns({"api_client_id": F.lit("client-9"), "id": F.concat(F.lit("more/"), "id")})
    out = upsert.upsert_policies(stored, changed.unionByName(fresh))
    return out.select("id", "tenant_id", "api_client_id", "route_id", "bucket_capacity", "refill_rate", time_text("created_at").alias("created_at"))


QUERIES["policy_upsert"] = policy_upsert
ORACLES["policy_upsert"] = A.with_ctes(
    *BASE,
    f"""fresh AS (SELECT *, 'more/new/' || id AS nid FROM rate_limit_policies WHERE {_N} % 2 = 0)
SELECT id, tenant_id, api_client_id, route_id, CASE WHEN {_N} % 2 = 0 THEN bucket_capacity * 10 ELSE bucket_capacity END AS bucket_capacity,
  refill_rate, '2024-01-01 00:00:00' AS created_at FROM rate_limit_policies
UNION ALL SELECT nid, tenant_id, 'client-9', route_id, bucket_capacity * 10, refill_rate, '2024-01-01 00:00:01' FROM fresh
QUALIFY row_number() OVER (PARTITION BY tenant_id, route_id ORDER BY nid DESC) = 1""",
)


def client_feed_apply(spark, sf_dir):
    """A change feed over the clients: some revoked and renamed, one deleted, one created."""
    stored = A.api_clients(spark, sf_dir).select("id", "tenant_id", "name", "status")
    empty = {"name": F.lit(None).cast("string"), "status": F.lit(None).cast("string")}
    at = lambda s: F.timestamp_micros(F.lit(A.BASE_MICROS + s * 10**6))
    op = lambda df, kind, s, **values: df.withColumns({**empty, **values}).withColumns({"op": F.lit(kind), "changed_at": at(s)})
    feed = (
        op(stored.where(F.col("id").isin("client-0", "client-1")), "revoke", 1, status=F.lit("revoked"))
        .unionByName(op(stored.where(F.col("id") == "client-1"), "update", 2, name=F.concat("id", F.lit(" renamed"))))
        .unionByName(op(stored.where(F.col("id") == "client-0"), "activate", 3, status=F.lit("active")))
        .unionByName(op(stored.where(F.col("id") == "client-2"), "delete", 4))
        .unionByName(op(stored.withColumn("id", F.concat(F.lit("copy-of-"), "id")), "create", 5, name=F.lit("copy"), status=F.lit("active")))
    )
    return upsert.apply_changes(stored, feed)


QUERIES["client_feed_apply"] = client_feed_apply
ORACLES["client_feed_apply"] = A.with_ctes(
    *BASE,
    """SELECT id, tenant_id, CASE WHEN id = 'client-1' THEN 'client-1 renamed' ELSE name END AS name,
  CASE WHEN id = 'client-1' THEN 'revoked' WHEN id = 'client-0' THEN 'active' ELSE status END AS status FROM api_clients WHERE id <> 'client-2'
UNION ALL SELECT 'copy-of-' || id, tenant_id, 'copy', 'active' FROM api_clients""",
)


def last_used(spark, sf_dir):
    out = upsert.touch_clients(A.api_clients(spark, sf_dir), A.request_logs(spark, sf_dir))
    return out.select("tenant_id", "id", time_text("last_used_at").alias("last_used_at"))


QUERIES["last_used"] = last_used
ORACLES["last_used"] = A.with_ctes(
    *BASE,
    """SELECT c.tenant_id, c.id, strftime(max(l.created_at), '%Y-%m-%d %H:%M:%S') AS last_used_at FROM api_clients c
LEFT JOIN request_logs l ON l.client_id = c.id AND l.tenant_id = c.tenant_id GROUP BY 1, 2""",
)
