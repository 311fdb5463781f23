"""Merges on plain tables: the new state is a DataFrame, written as a new version.

A merge is one union and one aggregation by key (no read-modify-write), so a hot key
pre-aggregates before the shuffle; stored chunks that no incoming row touches stay out of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from callscope.functions.columns import blank_to_null

CHUNK_KEY = ("tenant_id", "source_type", "source_id", "content_hash", "chunk_index")
SOURCE_KEY = ("tenant_id", "source_type", "source_id")
POLICY_KEY = ("tenant_id", "api_client_id", "route_id")


def append_logs(logs: DataFrame, path: str) -> None:
    """Append log rows ('' ids become NULL) by tenant and day."""
    rows = logs.withColumns({c: blank_to_null(c) for c in ("client_id", "route_id")})
    rows.withColumn("log_date", F.to_date("created_at")).write.mode("append").partitionBy("tenant_id", "log_date").parquet(path)


def merge_latest(stored: DataFrame, incoming: DataFrame, key, *, order, keep=("created_at",)) -> DataFrame:
    """Last write wins per key (NULL keys match); ``keep`` columns stay as first stored.

    ``order`` names the columns of ``incoming`` that decide between its own rows.
    """
    names = stored.columns
    plain = [f.name for f in stored.schema.fields if not isinstance(f.dataType, MapType)]
    # A hash of the row settles what the order leaves open, so the answer never depends on the order of rows.
    rank = lambda source: F.struct(F.lit(source).alias("source"), *[F.col(c) for c in order], F.xxhash64(*plain).alias("tie"))
    rows = stored.withColumn("_rank", rank(0)).unionByName(incoming.select(*names).withColumn("_rank", rank(1)))
    merged = rows.groupBy(*key).agg(
        F.max_by(F.struct(*names), "_rank").alias("_new"), F.min_by(F.struct(*names), "_rank").alias("_old")
    )
    return merged.select(*[F.col(f"_old.{c}" if c in keep else f"_new.{c}").alias(c) for c in names])


def delete_by_source(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """Chunks whose (tenant, type, source) is not listed."""
    return chunks.join(sources.select(*SOURCE_KEY).distinct(), list(SOURCE_KEY), "left_anti")


def upsert_chunks(chunks: DataFrame, incoming: DataFrame) -> DataFrame:
    """Insert or replace chunks by their key; creation time and id stay, the rest is new.

    Only stored chunks whose key comes in again are merged; the others pass by as they are.
    """
    keys = incoming.select(*CHUNK_KEY).distinct()
    touched = chunks.join(keys, list(CHUNK_KEY), "left_semi").select(*chunks.columns)
    others = chunks.join(keys, list(CHUNK_KEY), "left_anti").select(*chunks.columns)
    return others.unionByName(merge_latest(touched, incoming, CHUNK_KEY, order=("updated_at",), keep=("created_at", "id")))


def replace_sources(chunks: DataFrame, incoming: DataFrame) -> DataFrame:
    """Replace all chunks of every source that comes in: one new version of the table.

    What is left of the stored table shares no key with the batch, so only the batch is merged.
    """
    fresh = merge_latest(chunks.limit(0), incoming, CHUNK_KEY, order=("updated_at",), keep=("created_at", "id"))
    return delete_by_source(chunks, incoming).select(*chunks.columns).unionByName(fresh)


def upsert_policies(policies: DataFrame, incoming: DataFrame) -> DataFrame:
    """Set limits per scope; blank ids mean 'all'. Id and creation time of a scope stay."""
    clean = {c: blank_to_null(c) for c in ("api_client_id", "route_id")}
    return merge_latest(
        policies.withColumns(clean), incoming.withColumns(clean), POLICY_KEY, order=("updated_at", "id"), keep=("id", "created_at")
    )


def apply_changes(stored: DataFrame, changes: DataFrame, *, key=("tenant_id", "id")) -> DataFrame:
    """Apply a change feed: the latest change of a row decides; 'delete' removes it.

    ``changes`` has the stored columns plus ``op`` and ``changed_at``; a column that is
    NULL in a change keeps its stored value, so 'revoke' need only carry the status. An array
    ``nulled`` may name columns that a change sets to NULL. All changes of a row are folded in order of
    time, then of ``sequence`` if the feed has one, then of a hash of the change, so the
    result never depends on the order of rows.
    """
    values = [c for c in stored.columns if c not in key]
    sequence = F.col("sequence").cast("bigint") if "sequence" in changes.columns else F.lit(None).cast("bigint")
    nulled = F.col("nulled") if "nulled" in changes.columns else F.lit(None).cast("array<string>")
    feed = changes.select(*stored.columns, "op", "changed_at", sequence.alias("_sequence"), nulled.alias("_nulled"))
    base = stored.withColumns(
        {
            "op": F.lit("stored"),
            "changed_at": F.lit(None).cast("timestamp"),
            "_sequence": F.lit(None).cast("bigint"),
            "_nulled": F.lit(None).cast("array<string>"),
        }
    )
    rows = base.unionByName(feed)
    # After its last delete a row starts anew, so values are taken from later changes only.
    plain = [f.name for f in stored.schema.fields if not isinstance(f.dataType, MapType)]
    first = lambda c: F.coalesce(c, F.lit(-1).cast("bigint"))
    moment = F.struct(first(F.unix_micros("changed_at")).alias("at"), first(F.col("_sequence")).alias("n"), F.xxhash64(*plain, "op").alias("tie"))
    rows = rows.withColumn("_at", moment)
    gone = rows.where(F.col("op") == "delete").groupBy(*key).agg(F.max("_at").alias("_gone"))
    live = rows.join(gone, list(key), "left").where(F.col("_gone").isNull() | (F.col("_at") > F.col("_gone")))
    said = lambda c: F.col(c).isNotNull() | F.coalesce(F.array_contains("_nulled", c), F.lit(False))
    newest = lambda c: F.max_by(F.col(c), F.when(said(c), F.col("_at"))).alias(c)
    return live.groupBy(*key).agg(*[newest(c) for c in values]).select(*stored.columns)


def touch_clients(clients: DataFrame, logs: DataFrame) -> DataFrame:
    """Advance ``last_used_at`` to the client's newest request; it never goes back."""
    used = logs.groupBy("tenant_id", F.col("client_id").alias("id")).agg(F.max("created_at").alias("_used"))
    return (
        clients.join(used, ["tenant_id", "id"], "left")
        .withColumn("last_used_at", F.greatest("last_used_at", "_used"))
        .select(*clients.columns)
    )


def set_null_on_delete(logs: DataFrame, clients: DataFrame, routes: DataFrame) -> DataFrame:
    """Log rows keep no reference to clients or routes that no longer exist."""
    out = logs
    for dim, column in ((clients, "client_id"), (routes, "route_id")):
        known = dim.select("tenant_id", F.col("id").alias(column)).distinct().withColumn("_known", F.lit(True))
        out = out.join(known, ["tenant_id", column], "left").withColumn(column, F.when(F.col("_known"), F.col(column))).drop("_known")
    return out.select(*logs.columns)


def cascade_tenants(tables: dict[str, DataFrame], tenants: DataFrame) -> dict[str, DataFrame]:
    """Every tenant-owned table without the rows of tenants that no longer exist."""
    known = tenants.select(F.col("id").alias("tenant_id"))
    return {name: df.join(known, "tenant_id", "left_semi") for name, df in tables.items()}
