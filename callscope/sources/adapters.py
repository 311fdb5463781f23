"""Deterministic views of the test tables as gateway tables.

Every adapter exists twice: as a DataFrame and, with the same integer arithmetic, as a
SQL common table expression (``CTE``) for checking results in another engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


BASE_MICROS = 1704067200000000  # 2024-01-01T00:00:00Z


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows of fewer files than there are cores, dealt out once, for work that is heavy per row; others as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def logs_from_events(events: DataFrame, compress: int = 600, carry: tuple[str, ...] = ()) -> DataFrame:
    """Request logs derived from the event table; time runs ``compress`` times faster.

    ``carry`` names event columns to keep beside them.
    """
    eid, uid = F.col("event_id"), F.col("user_id")
    error = F.col("event_type") == "error"
    status = (
        F.when(error & (eid % 5 == 0), 500)
        .when(error & (eid % 5 == 1), 502)
        .when(error & (eid % 5 == 2), 503)
        .when(error & (eid % 5 == 3), 401)
        .when(error, 403)
        .when(eid % 10 == 0, 429)
        .when(eid % 3 == 0, 201)
        .otherwise(200)
    )
    return events.select(
        eid.cast("string").alias("id"),
        F.concat(F.lit("req-"), eid.cast("string")).alias("request_id"),
        F.concat(F.lit("tenant-"), (uid % 2).cast("string")).alias("tenant_id"),
        F.concat(F.lit("client-"), (uid % 4).cast("string")).alias("client_id"),
        F.concat(F.lit("route-"), F.col("event_type")).alias("route_id"),
        F.when(eid % 4 == 2, "POST").when(eid % 4 == 3, "PUT").otherwise("GET").alias("method"),
        status.cast("int").alias("status_code"),
        F.floor("value").cast("bigint").alias("latency_ms"),
        (status == 429).alias("blocked"),
        F.expr(
            f"timestamp_micros({BASE_MICROS} + (unix_micros(cast(ts as timestamp)) - {BASE_MICROS}) div {compress})"
        ).alias("created_at"),
        *carry,
    )


def request_logs(spark: SparkSession, sf_dir: str, compress: int = 600) -> DataFrame:
    return logs_from_events(table(spark, sf_dir, "events"), compress)


def tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = request_logs(spark, sf_dir).groupBy("tenant_id").agg(F.min("created_at").alias("created_at"))
    return first.select(
        F.col("tenant_id").alias("id"),
        F.concat(F.lit("Tenant "), F.substring("tenant_id", 8, 20)).alias("name"),
        F.lit("active").alias("status"),
        "created_at",
        F.col("created_at").alias("updated_at"),
    )


def api_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer as a client; the few that the log names were made with their first call."""
    users = (
        table(spark, sf_dir, "events")
        .select((F.col("user_id") % 4).alias("k"), "ts")
        .groupBy("k")
        .agg(F.min("ts").cast("timestamp").alias("first"))
    )
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_name")
    made = F.coalesce("first", F.timestamp_micros(F.lit(BASE_MICROS)))
    clients = customers.join(users, "k", "left").withColumn("created_at", made)
    key = F.concat(F.lit("key_test_"), F.lpad(F.col("k").cast("string"), 7, "0"), F.lit("-secret-"), F.col("k").cast("string"))
    return clients.select(
        F.concat(F.lit("client-"), F.col("k").cast("string")).alias("id"),
        F.concat(F.lit("tenant-"), (F.col("k") % 2).cast("string")).alias("tenant_id"),
        F.col("c_name").alias("name"),
        F.substring(key, 1, 16).alias("api_key_prefix"),
        F.sha2(key, 256).alias("api_key_hash"),
        F.when(F.col("k") == 3, "revoked").otherwise("active").alias("status"),
        "created_at",
        F.col("created_at").alias("updated_at"),
        F.lit(None).cast("timestamp").alias("last_used_at"),
    )


def gateway_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The routes of the log per tenant; ``signup`` stays unregistered."""
    log = request_logs(spark, sf_dir).where(F.col("route_id") != "route-signup")
    part = F.substring(F.col("route_id"), 7, 40)
    return (
        log.groupBy("tenant_id", "route_id")
        .agg(F.min("created_at").alias("created_at"))
        .select(
            F.col("route_id").alias("id"),
            "tenant_id",
            F.initcap(part).alias("name"),
            F.concat(F.lit("/api/"), F.when(part == "click", F.lit("view/click")).otherwise(part)).alias("gateway_path"),
            F.concat(F.lit("https://"), part, F.lit(".example.com/v1")).alias("upstream_url"),
            F.when(part == "purchase", F.array(F.lit("POST"), F.lit("PUT")))
            .otherwise(F.array(F.lit("GET"), F.lit("POST"), F.lit("PUT")))
            .alias("allowed_methods"),
            F.lit(5000).alias("timeout_ms"),
            (part != "view").alias("authentication_required"),
            (part != "error").alias("active"),
            "created_at",
            F.col("created_at").alias("updated_at"),
        )
    )


def rate_limit_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policies at all four levels, derived from the (tenant, client, route) keys of the log."""
    keys = (
        request_logs(spark, sf_dir)
        .select("tenant_id", "client_id", "route_id")
        .distinct()
        .withColumn("c", F.substring(F.col("client_id"), 8, 20).cast("int"))
    )
    both = keys.where((F.col("c") == 0) & (F.col("route_id") != "route-view")).select(
        "tenant_id", "client_id", "route_id", F.lit(2.0).alias("cap"), F.lit(0.25).alias("refill"), (F.col("route_id") != "route-error").alias("enabled")
    )
    client = keys.where(F.col("c") <= 1).select(
        "tenant_id", "client_id", F.lit(None).cast("string").alias("route_id"), F.lit(3.0).alias("cap"), F.lit(0.125).alias("refill"), F.lit(True).alias("enabled")
    ).distinct()
    route = keys.where(F.col("route_id") == "route-view").select(
        "tenant_id", F.lit(None).cast("string").alias("client_id"), "route_id", F.lit(4.0).alias("cap"), F.lit(0.0).alias("refill"), F.lit(True).alias("enabled")
    ).distinct()
    tenant = keys.select(
        "tenant_id", F.lit(None).cast("string").alias("client_id"), F.lit(None).cast("string").alias("route_id"), F.lit(5.0).alias("cap"), F.lit(0.05).alias("refill"), F.lit(True).alias("enabled")
    ).distinct()
    rows = both.unionByName(client).unionByName(route).unionByName(tenant)
    start = F.timestamp_micros(F.lit(BASE_MICROS))
    return rows.select(
        F.concat_ws("/", F.lit("policy"), "tenant_id", F.coalesce("client_id", F.lit("*")), F.coalesce("route_id", F.lit("*"))).alias("id"),
        "tenant_id",
        F.col("client_id").alias("api_client_id"),
        "route_id",
        F.col("cap").alias("bucket_capacity"),
        F.col("refill").alias("refill_rate"),
        "enabled",
        start.alias("created_at"),
        start.alias("updated_at"),
    )


def source_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as ingest input: tenant by document id, source id unique per document."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select(
        "doc_id",
        F.concat(F.lit("tenant-"), (F.col("doc_id") % 2).cast("string")).alias("tenant_id"),
        F.lit("document").alias("source_type"),
        F.concat_ws("/", F.lit("docs"), "source", F.col("doc_id").cast("string")).alias("source_id"),
        F.col("source").alias("source_name"),
        F.col("text").alias("content"),
    )


def vector_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as stored chunks."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.concat(F.lit("tenant-"), (F.col("vec_id") % 2).cast("string")).alias("tenant_id"),
        F.lit("document").alias("source_type"),
        F.concat(F.lit("source-"), F.col("label").cast("string")).alias("source_id"),
        F.concat(F.lit("Source "), F.col("label").cast("string")).alias("source_name"),
        F.concat(F.lit("Section "), (F.col("vec_id") % 3).cast("string")).alias("section"),
        F.concat(F.lit("chunk text "), F.repeat(F.lit("word "), (F.col("vec_id") % 97).cast("int"))).alias("content"),
        F.col("vec_id").cast("int").alias("chunk_index"),
        "embedding",
        "label",
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as questions. Every third one is led in by a phrase about the gateway."""
    return (
        table(spark, sf_dir, "conversations")
        .where(F.col("role") == "user")
        .select(
            F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("question_id"),
            F.concat(F.lit("tenant-"), (F.col("conv_id") % 2).cast("string")).alias("tenant_id"),
            F.concat(
                F.element_at(F.array(*[F.lit(p) for p in QUESTION_LEADS]), (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(QUESTION_LEADS))) + 1).cast("int")),
                F.col("text"),
            ).alias("question"),
        )
    )


QUESTION_LEADS = (
    "",
    "Why am I getting rate limited? ",
    "Show my 429 events. ",
    "What anomaly is trending right now? ",
    "What should I do about this incident? ",
    "Forecast next hour. ",
    "How does the token bucket refill? ",
)


# --- the same adapters as SQL ---------------------------------------------------


def sql_logs(compress: int = 600, name: str = "request_logs") -> str:
    status = (
        "CASE WHEN event_type = 'error' THEN CASE event_id % 5 WHEN 0 THEN 500 WHEN 1 THEN 502"
        " WHEN 2 THEN 503 WHEN 3 THEN 401 ELSE 403 END"
        " WHEN event_id % 10 = 0 THEN 429 WHEN event_id % 3 = 0 THEN 201 ELSE 200 END"
    )
    return f"""{name} AS (
  SELECT CAST(event_id AS VARCHAR) AS id, 'req-' || CAST(event_id AS VARCHAR) AS request_id,
         'tenant-' || CAST(user_id % 2 AS VARCHAR) AS tenant_id,
         'client-' || CAST(user_id % 4 AS VARCHAR) AS client_id,
         'route-' || event_type AS route_id,
         CASE event_id % 4 WHEN 2 THEN 'POST' WHEN 3 THEN 'PUT' ELSE 'GET' END AS method,
         CAST({status} AS INTEGER) AS status_code,
         CAST(floor(value) AS BIGINT) AS latency_ms,
         ({status}) = 429 AS blocked,
         make_timestamp({BASE_MICROS} + (epoch_us(ts) - {BASE_MICROS}) // {compress}) AS created_at
  FROM events)"""


SQL_CLIENTS = f"""api_clients AS (
  SELECT 'client-' || CAST(k AS VARCHAR) AS id, 'tenant-' || CAST(k % 2 AS VARCHAR) AS tenant_id,
         c_name AS name,
         substr('key_test_' || lpad(CAST(k AS VARCHAR), 7, '0') || '-secret-' || CAST(k AS VARCHAR), 1, 16) AS api_key_prefix,
         sha256('key_test_' || lpad(CAST(k AS VARCHAR), 7, '0') || '-secret-' || CAST(k AS VARCHAR)) AS api_key_hash,
         CASE WHEN k = 3 THEN 'revoked' ELSE 'active' END AS status, created_at,
         created_at AS updated_at
  FROM (SELECT c_custkey AS k, c_name, coalesce(first, make_timestamp({BASE_MICROS})) AS created_at FROM customer
        LEFT JOIN (SELECT user_id % 4 AS caller, min(ts) AS first FROM events GROUP BY 1) u ON caller = c_custkey))"""

SQL_ROUTES = """gateway_routes AS (
  SELECT route_id AS id, tenant_id,
         upper(substr(part, 1, 1)) || lower(substr(part, 2)) AS name,
         '/api/' || CASE WHEN part = 'click' THEN 'view/click' ELSE part END AS gateway_path,
         'https://' || part || '.example.com/v1' AS upstream_url,
         CASE WHEN part = 'purchase' THEN ['POST', 'PUT'] ELSE ['GET', 'POST', 'PUT'] END AS allowed_methods,
         CAST(5000 AS INTEGER) AS timeout_ms, part <> 'view' AS authentication_required,
         part <> 'error' AS active, created_at
  FROM (SELECT tenant_id, route_id, substr(route_id, 7) AS part, min(created_at) AS created_at
        FROM request_logs WHERE route_id <> 'route-signup' GROUP BY 1, 2, 3))"""

SQL_POLICIES = """policy_keys AS (
  SELECT DISTINCT tenant_id, client_id, route_id, CAST(substr(client_id, 8) AS INTEGER) AS c FROM request_logs),
policy_rows AS (
  SELECT tenant_id, client_id, route_id, 2.0::DOUBLE AS cap, 0.25::DOUBLE AS refill, route_id <> 'route-error' AS enabled
  FROM policy_keys WHERE c = 0 AND route_id <> 'route-view'
  UNION ALL SELECT DISTINCT tenant_id, client_id, NULL, 3.0::DOUBLE, 0.125::DOUBLE, true FROM policy_keys WHERE c <= 1
  UNION ALL SELECT DISTINCT tenant_id, NULL, route_id, 4.0::DOUBLE, 0.0::DOUBLE, true FROM policy_keys WHERE route_id = 'route-view'
  UNION ALL SELECT DISTINCT tenant_id, NULL, NULL, 5.0::DOUBLE, 0.05::DOUBLE, true FROM policy_keys),
rate_limit_policies AS (
  SELECT 'policy/' || tenant_id || '/' || coalesce(client_id, '*') || '/' || coalesce(route_id, '*') AS id,
         tenant_id, client_id AS api_client_id, route_id, cap AS bucket_capacity, refill AS refill_rate, enabled
  FROM policy_rows)"""

SQL_DOCUMENTS = """source_documents AS (
  SELECT doc_id, 'tenant-' || CAST(doc_id % 2 AS VARCHAR) AS tenant_id, 'document' AS source_type,
         'docs/' || source || '/' || CAST(doc_id AS VARCHAR) AS source_id, source AS source_name,
         text AS content FROM documents)"""

SQL_CHUNKS = """vector_chunks AS (
  SELECT vec_id AS id, 'tenant-' || CAST(vec_id % 2 AS VARCHAR) AS tenant_id, 'document' AS source_type,
         'source-' || CAST(label AS VARCHAR) AS source_id, 'Source ' || CAST(label AS VARCHAR) AS source_name,
         'Section ' || CAST(vec_id % 3 AS VARCHAR) AS section,
         'chunk text ' || repeat('word ', vec_id % 97) AS content,
         CAST(vec_id AS INTEGER) AS chunk_index, CAST(embedding AS DOUBLE[]) AS embedding, label
  FROM embeddings)"""


def sql_questions() -> str:
    leads = ", ".join("'" + lead.replace("'", "''") + "'" for lead in QUESTION_LEADS)
    return f"""questions AS (
  SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS question_id,
         'tenant-' || CAST(conv_id % 2 AS VARCHAR) AS tenant_id,
         ([{leads}])[CAST((conv_id + turn) % {len(QUESTION_LEADS)} AS INTEGER) + 1] || text AS question
  FROM conversations WHERE role = 'user')"""


def sql_last_hours(hours: int) -> str:
    """``request_logs`` cut to the hours up to the newest row."""
    return sql_logs(name="all_logs") + f""",
request_logs AS (SELECT * FROM all_logs WHERE created_at > (SELECT max(created_at) FROM all_logs) - INTERVAL {hours} HOUR)"""


def with_ctes(*parts: str) -> str:
    """``WITH`` query text: common table expressions, the last part holding the final SELECT."""
    body = parts[-1]
    glue = "\n" if body.lstrip().upper().startswith("SELECT") else ",\n"
    return "WITH " + ",\n".join(parts[:-1]) + glue + body


def gateway_requests(spark: SparkSession, sf_dir: str, compress: int = 600) -> DataFrame:
    """Incoming requests behind the log: path, method and presented key.

    Some requests carry no key, a wrong key or an unregistered path, by a rule on the id.
    """
    events = table(spark, sf_dir, "events")
    k = F.col("user_id") % 4
    good = F.concat(F.lit("key_test_"), F.lpad(k.cast("string"), 7, "0"), F.lit("-secret-"), k.cast("string"))
    log = logs_from_events(events, compress, ("event_id", "user_id", "event_type"))
    return log.select(
        "id",
        "tenant_id",
        F.when(F.col("event_id") % 17 == 0, "/missing")
        .otherwise(
            F.concat(
                F.lit("/api/"),
                F.when(F.col("event_type") == "click", "view/click").otherwise(F.col("event_type")),
                F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit("/"), (F.col("event_id") % 5).cast("string"))),
            )
        )
        .alias("path"),
        "method",
        F.when(F.col("event_id") % 11 == 0, "").when(F.col("event_id") % 13 == 0, F.concat(good, F.lit("x"))).otherwise(good).alias("api_key"),
        "created_at",
    )


SQL_REQUESTS = """gateway_requests AS (
  SELECT l.id, l.tenant_id,
    CASE WHEN event_id % 17 = 0 THEN '/missing' ELSE '/api/' || CASE WHEN event_type = 'click' THEN 'view/click' ELSE event_type END
      || CASE WHEN event_id % 3 = 0 THEN '' ELSE '/' || CAST(event_id % 5 AS VARCHAR) END END AS path,
    l.method, CASE WHEN event_id % 11 = 0 THEN '' ELSE 'key_test_' || lpad(CAST(user_id % 4 AS VARCHAR), 7, '0') || '-secret-' || CAST(user_id % 4 AS VARCHAR)
      || CASE WHEN event_id % 13 = 0 THEN 'x' ELSE '' END END AS api_key, l.created_at
  FROM request_logs l JOIN events e ON CAST(e.event_id AS VARCHAR) = l.id)"""
