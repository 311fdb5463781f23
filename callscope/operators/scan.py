"""Bounded, tenant-scoped reads of the request log and the dimension tables."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callscope.functions.columns import null_to_blank, top_n_per_group
from callscope.schemas import require_columns

# The safe columns of a log read, and its default bounds.
LOG_COLUMNS = (
    "tenant_id",
    "client_id",
    "route_id",
    "method",
    "status_code",
    "latency_ms",
    "blocked",
    "created_at",
)
MAX_ROWS = 10_000
MAX_RANGE_DAYS = 90
LISTING_ROWS = 500


def _newest_first():
    return [F.col("created_at").desc(), F.col("id").desc()]


def check_range(start: datetime, end: datetime, max_days: int | None = None) -> None:
    for name, value in (("start", start), ("end", end)):
        if value.tzinfo is None or value.utcoffset() is None:
            raise ValueError(f"{name} must carry a timezone")
    if start >= end:
        raise ValueError("start must be before end")
    if max_days is not None and end - start > timedelta(days=max_days):
        raise ValueError(f"the range may not exceed {max_days} days")


def tenant_scope(df: DataFrame, tenant_id: str | None) -> DataFrame:
    """Keep one tenant, before anything is derived. ``None`` keeps every tenant."""
    if tenant_id is None:
        return df
    tenant = tenant_id.strip()
    if not tenant:
        raise ValueError("tenant_id is required")
    return df.where(F.col("tenant_id") == tenant)


def optional_filter(df: DataFrame, column: str, value: str | None) -> DataFrame:
    value = (value or "").strip()
    return df.where(F.col(column) == value) if value else df


def bounded_scan(
    logs: DataFrame,
    tenant_id: str,
    start: datetime,
    end: datetime,
    *,
    client_id: str | None = None,
    route_id: str | None = None,
    limit: int = MAX_ROWS,
    max_days: int | None = MAX_RANGE_DAYS,
) -> DataFrame:
    """One tenant, ``start <= created_at < end``, newest first, at most ``limit`` rows.

    The limit is the reader's contract and is taken as given; ``max_days`` of None lifts the
    bound of the range. Analyses of whole tables use :func:`range_scan`, which has neither.
    """
    if limit < 1:
        raise ValueError("limit must be positive")
    rows = range_scan(logs, tenant_id, start, end, client_id=client_id, route_id=route_id, max_days=max_days)
    return rows.orderBy(*_newest_first()).limit(limit).select(*LOG_COLUMNS)


def range_scan(
    logs: DataFrame,
    tenant_id: str | None,
    start: datetime,
    end: datetime,
    *,
    client_id: str | None = None,
    route_id: str | None = None,
    max_days: int | None = None,
) -> DataFrame:
    """Tenant, time and optional client/route filters; all reach the file scan."""
    require_columns(logs, LOG_COLUMNS)
    rows = tenant_scope(logs, tenant_id)
    check_range(start, end, max_days)
    rows = rows.where((F.col("created_at") >= F.lit(start)) & (F.col("created_at") < F.lit(end)))
    rows = optional_filter(rows, "client_id", client_id)
    return optional_filter(rows, "route_id", route_id)


def newest_moment(logs: DataFrame) -> datetime | None:
    """The time of the newest row; the default end of the windows below."""
    return logs.agg(F.max("created_at")).first()[0]


def last_hours(logs: DataFrame, hours: float, as_of: datetime | None = None) -> DataFrame:
    """Rows of the ``hours`` up to ``as_of`` (default: the newest row), that moment included."""
    as_of = as_of or newest_moment(logs)
    if as_of is None:
        return logs
    start = as_of - timedelta(hours=hours)
    return logs.where((F.col("created_at") > F.lit(start)) & (F.col("created_at") <= F.lit(as_of)))


def scoped(
    logs: DataFrame,
    tenant_id: str | None = None,
    *,
    start: datetime | None = None,
    end: datetime | None = None,
    client_id: str | None = None,
    route_id: str | None = None,
) -> DataFrame:
    """Rows of a tenant, of ``start <= created_at < end``, a client and a route, each if given."""
    rows = tenant_scope(logs, tenant_id)
    if start is not None:
        rows = rows.where(F.col("created_at") >= F.lit(start))
    if end is not None:
        rows = rows.where(F.col("created_at") < F.lit(end))
    return optional_filter(optional_filter(rows, "client_id", client_id), "route_id", route_id)


def recent_logs(logs: DataFrame, tenant_id: str | None = None, n: int = LISTING_ROWS) -> DataFrame:
    """The newest ``n`` log rows of every tenant (or of one), missing ids as ''."""
    rows = tenant_scope(logs, tenant_id)
    return (
        top_n_per_group(rows, ["tenant_id"], _newest_first(), n, salt_by=["id"], rank="position")
        .withColumn("client_id", null_to_blank("client_id"))
        .withColumn("route_id", null_to_blank("route_id"))
    )


def retain_newest(logs: DataFrame, n: int = MAX_ROWS, *, per_tenant: bool = False) -> DataFrame:
    """Keep the newest ``n`` rows, of the whole table or of each tenant.

    Counts per minute find the minute the cut falls into, counts per millisecond the
    millisecond inside it; newer ones are kept whole and only the rows of that one
    millisecond are ranked, so no task ever sorts the table.
    """
    rows = logs.withColumn("_scope", F.col("tenant_id") if per_tenant else F.lit("all")).withColumn("_room", F.lit(n).cast("bigint"))
    kept = None
    for unit in ("minute", "millisecond"):
        rows = rows.withColumn("_at", F.date_trunc(unit, "created_at"))
        newer = Window.partitionBy("_scope").orderBy(F.col("_at").desc())
        upto = F.sum("_n").over(newer.rowsBetween(Window.unboundedPreceding, 0))
        cut = (
            rows.groupBy("_scope", "_at")
            .agg(F.count(F.lit(1)).alias("_n"), F.first("_room").alias("_had"))
            .withColumn("_upto", upto)
            .where((F.col("_upto") >= F.col("_had")) & (F.col("_upto") - F.col("_n") < F.col("_had")))
            .select("_scope", F.col("_at").alias("_cut"), (F.col("_had") - F.col("_upto") + F.col("_n")).alias("_left"))
        )
        marked = rows.join(cut, "_scope", "left")
        whole = marked.where(F.col("_cut").isNull() | (F.col("_at") > F.col("_cut"))).select(*logs.columns)
        kept = whole if kept is None else kept.unionByName(whole)
        rows = marked.where(F.col("_at") == F.col("_cut")).drop("_room", "_cut", "_at").withColumnRenamed("_left", "_room")
    order = Window.partitionBy("_scope").orderBy(*_newest_first())
    edge = rows.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= F.col("_room"))
    return kept.unionByName(edge.select(*logs.columns))


def dimension_scan(dim: DataFrame, tenant_id: str | None = None, *, hide=("api_key_hash",)) -> DataFrame:
    """A client or route table in creation order, without secrets."""
    rows = tenant_scope(dim, tenant_id).drop(*hide)
    return rows.orderBy("created_at", "id")


def lookup(dim: DataFrame, keys: DataFrame) -> DataFrame:
    """Point reads for many (tenant_id, id) keys at once."""
    return dim.join(keys.select("tenant_id", "id").distinct(), ["tenant_id", "id"], "left_semi")
