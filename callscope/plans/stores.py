"""Registered queries: sources and sinks read back, point lookups, slices and deletions."""

from __future__ import annotations

from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import functions as F

from callscope.functions.columns import cosine, dot, time_text
from callscope.operators import features, quality, scan, series, upsert
from callscope.plans.features import FEATURE_SQL, ROUNDED, _rounded_sql
from callscope.schemas import REQUEST_LOGS
from callscope.session import scratch_dir
from callscope.sources import adapters as A
from callscope.sources import tables

QUERIES, ORACLES = {}, {}
LOGS = A.sql_logs()


def query(sql: str):
    def register(fn):
        QUERIES[fn.__name__] = fn
        ORACLES[fn.__name__] = sql
        return fn

    return register


@query(A.with_ctes(LOGS, A.SQL_CLIENTS, "SELECT tenant_id, id, name FROM api_clients c WHERE EXISTS (SELECT 1 FROM request_logs l WHERE l.tenant_id = c.tenant_id AND l.client_id = c.id)"))
def point_lookup(spark, sf_dir):
    """The clients that the log names, by many keys at once."""
    keys = A.request_logs(spark, sf_dir).select("tenant_id", F.col("client_id").alias("id"))
    return scan.lookup(A.api_clients(spark, sf_dir), keys).select("tenant_id", "id", "name")


@query(A.with_ctes(LOGS, A.SQL_ROUTES, "SELECT tenant_id, id, name, gateway_path, timeout_ms, active FROM gateway_routes"))
def route_listing(spark, sf_dir):
    return scan.dimension_scan(A.gateway_routes(spark, sf_dir)).select("tenant_id", "id", "name", "gateway_path", "timeout_ms", "active")


def _apart(left, right):
    """Rows that only one of two tables has, by counts of whole rows."""
    # Rows of both sides are counted in one aggregation, so a task holds one table of them.
    one = lambda df, sign: df.withColumn("_n", F.lit(sign).cast("bigint"))
    both = one(left, 1).unionByName(one(right, -1)).groupBy(*left.columns).agg(F.sum("_n").alias("_n"))
    return both.agg(F.coalesce(F.sum(F.abs("_n")), F.lit(0)).alias("different"))


@query(A.with_ctes(LOGS, "SELECT source, count(*) AS n, CAST(0 AS BIGINT) AS different FROM request_logs, (VALUES ('parquet'), ('json'), ('csv'), ('orc')) v(source) GROUP BY 1"))
def table_round_trip(spark, sf_dir):
    """The log written as Parquet, JSON, CSV and ORC and read back with its schema."""
    # Text formats keep milliseconds.
    logs = A.request_logs(spark, sf_dir).withColumn("created_at", F.date_trunc("millisecond", "created_at"))
    logs = logs.select(*[f.name for f in REQUEST_LOGS])
    out = []
    for source in ("parquet", "json", "csv", "orc"):
        path = scratch_dir(spark, f"log-{source}")
        (logs.write.option("header", True) if source == "csv" else logs.write).format(source).save(path)
        back = tables.read_table(spark, path, REQUEST_LOGS, source).select(*logs.columns)
        facts = back.agg(F.count(F.lit(1)).alias("n")).join(_apart(back, logs), F.lit(True))
        out.append(facts.select(F.lit(source).alias("source"), "n", "different"))
    return reduce(lambda a, b: a.unionByName(b), out)


@query(A.with_ctes(LOGS, """SELECT tenant_id, strftime(created_at, '%Y-%m-%d') AS log_date, count(*) AS n, count(*) FILTER (WHERE CAST(id AS BIGINT) % 3 <> 0) AS with_client
FROM request_logs GROUP BY 1, 2"""))
def log_append(spark, sf_dir):
    """The log appended in two batches; every third row has a blank client id, stored as NULL."""
    number = F.col("id").cast("bigint")
    logs = A.request_logs(spark, sf_dir).withColumn("client_id", F.when(number % 3 == 0, "").otherwise(F.col("client_id")))
    path = scratch_dir(spark, "log-append")
    upsert.append_logs(logs.where(number % 2 == 0), path)
    upsert.append_logs(logs.where(number % 2 == 1), path)
    return spark.read.parquet(path).groupBy("tenant_id", F.date_format("log_date", "yyyy-MM-dd").alias("log_date")).agg(
        F.count(F.lit(1)).alias("n"), F.count("client_id").alias("with_client")
    )


@query(A.with_ctes(LOGS, """SELECT source, tenant_id, count(*) AS minutes, CAST(sum(n) AS BIGINT) AS requests
FROM (SELECT tenant_id, date_trunc('minute', created_at) AS m, count(*) AS n FROM request_logs GROUP BY 1, 2), (VALUES ('parquet'), ('csv')) v(source) GROUP BY 1, 2"""))
def series_round_trip(spark, sf_dir):
    """The minute series written and read back; minutes without requests are not counted."""
    rows = series.minute_series(A.request_logs(spark, sf_dir))
    out = []
    for source in ("parquet", "csv"):
        path = scratch_dir(spark, f"series-{source}")
        tables.write_series(rows, path, source)
        back = tables.read_series(spark, path, source).where("request_count > 0")
        counts = back.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("minutes"), F.sum("request_count").cast("bigint").alias("requests"))
        out.append(counts.withColumn("source", F.lit(source)))
    return out[0].unionByName(out[1])


@query("""SELECT doc_id, 'document' AS source_type, sha256(coalesce(text, '') || chr(10)) AS content_hash FROM documents""")
def corpus_source(spark, sf_dir):
    """Every document as a file of its own, read back as a corpus."""
    path = scratch_dir(spark, "corpus")
    rows = A.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("value"))
    tables.write_corpus(rows, path, "doc_id", "value")
    found = tables.markdown_corpus(spark, path, "tenant-0", pattern="*.txt")
    # The id names a file or, where Spark writes, its folder.
    number = F.nullif(F.regexp_extract("source_id", r"doc_id=(-?\d+)[./]", 1), F.lit("")).cast("bigint").alias("doc_id")
    return found.select(number, "source_type", F.sha2("content", 256).alias("content_hash"))


SLICE = A.sql_logs(name="all_logs") + """,
request_logs AS (SELECT * FROM all_logs WHERE tenant_id = 'tenant-1' AND created_at >= TIMESTAMP '2024-01-01 00:20:00' AND created_at < TIMESTAMP '2024-01-01 00:40:00')"""


@query(A.with_ctes(SLICE, FEATURE_SQL, f"SELECT * REPLACE (strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start, {_rounded_sql()}) FROM features"))
def slice_features(spark, sf_dir):
    """Features of one tenant's slice of the log."""
    at = lambda minute: datetime(2024, 1, 1, 0, minute, tzinfo=timezone.utc)
    out = features.minute_features(scan.range_scan(A.request_logs(spark, sf_dir), "tenant-1", at(20), at(40)))
    return out.withColumns({c: F.round(F.col(f"`{c}`"), 6) for c in ROUNDED}).withColumn("window_start", time_text("window_start"))


@query("""SELECT vec_id, round(array_inner_product(v, w), 6) + 0.0 AS dot, round(array_cosine_similarity(v, w), 6) + 0.0 AS cosine
FROM (SELECT vec_id, CAST(embedding AS DOUBLE[64]) AS v, CAST(list_reverse(embedding) AS DOUBLE[64]) AS w FROM embeddings)""")
def vector_similarity(spark, sf_dir):
    """Every vector against itself reversed."""
    turned = F.reverse("embedding")
    rows = A.table(spark, sf_dir, "embeddings").withColumn("turned", turned)
    return rows.select(
        "vec_id", (F.round(dot("embedding", "turned"), 6) + 0.0).alias("dot"), (F.round(cosine("embedding", "turned"), 6) + 0.0).alias("cosine")
    )


@query(A.with_ctes(LOGS, A.SQL_CLIENTS, """SELECT 'clients' AS table_name, count(*) AS n FROM api_clients WHERE tenant_id = 'tenant-0'
UNION ALL SELECT 'logs', count(*) FROM request_logs WHERE tenant_id = 'tenant-0'"""))
def tenant_cascade(spark, sf_dir):
    """What is left of clients and logs when only tenant-0 remains."""
    left = A.tenants(spark, sf_dir).where("id = 'tenant-0'")
    kept = upsert.cascade_tenants({"clients": A.api_clients(spark, sf_dir), "logs": A.request_logs(spark, sf_dir)}, left)
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in kept.items()]
    return counts[0].unionByName(counts[1])


@query(A.with_ctes(LOGS, A.SQL_ROUTES, "SELECT tenant_id, id FROM gateway_routes WHERE length(id) % 2 = 0"))
def route_conflicts(spark, sf_dir):
    """Routes that come in again, some of them under a new path."""
    routes = A.gateway_routes(spark, sf_dir)
    path = F.when(F.length("id") % 2 == 0, F.col("gateway_path")).otherwise(F.concat("gateway_path", F.lit("/new")))
    return quality.conflicts(routes.withColumn("gateway_path", path), routes, ("tenant_id", "gateway_path")).select("tenant_id", "id")
