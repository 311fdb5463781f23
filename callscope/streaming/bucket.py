"""Token buckets on a stream of requests."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from callscope.functions import bucket as B
from callscope.operators.bucket import KEYS, STATE, _prepared, replay_from
from callscope.sources.versions import ConflictError, VersionedTable
from callscope.streaming.ingest import for_each
from callscope.streaming.runs import use_rocksdb

_UNITS = T.DecimalType(38, 0)
_STATE = T.StructType(
    [T.StructField(n, T.LongType() if n == "seen" else _UNITS) for n in ("tokens", "seen", "capacity", "refill")]
)

DECISIONS = T.StructType(
    [
        *[T.StructField(k, T.StringType()) for k in KEYS],
        T.StructField("id", T.StringType()),
        T.StructField("created_us", T.LongType()),
        T.StructField("status", T.StringType()),
        T.StructField("allowed", T.BooleanType()),
        T.StructField("remaining", T.DoubleType()),
        T.StructField("retry_after_ns", T.LongType()),
    ]
)


#: Requests of a bucket that are Python objects at once; the others of a micro-batch wait as Arrow columns.
SLICE_ROWS = 10_000


def _in_time(frames: Iterator[pd.DataFrame]) -> tuple[pa.Table, list[tuple]]:
    """The requests (id, us, number of limits) of one bucket in order of time, and its distinct limits."""
    numbers: dict[tuple, int] = {}
    parts = []
    for frame in frames:
        own = zip(frame["capacity"], frame["refill"], frame["initial"])
        limits = [numbers.setdefault((int(c), int(r), None if pd.isna(i) else int(i)), len(numbers)) for c, r, i in own]
        columns = [pa.array(frame["id"], pa.large_string()), pa.array(frame["us"], pa.int64()), pa.array(limits, pa.int32())]
        parts.append(pa.table(columns, ["id", "us", "limit"]))
    whole = pa.concat_tables(parts)
    return whole.take(pc.sort_indices(whole, [("us", "ascending"), ("id", "ascending")])), list(numbers)


class _Bucket(StatefulProcessor):
    def __init__(self, shared: bool, expire: bool) -> None:
        self.shared, self.expire = shared, expire

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("bucket", _STATE, B.DAY_US // 1000 if self.expire else None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ordered, limits = _in_time(rows)
        held = tuple(self.state.get()) if self.state.exists() else None
        for at in range(0, len(ordered), SLICE_ROWS):
            out = []
            for row_id, us, limit in zip(*(c.to_pylist() for c in ordered.slice(at, SLICE_ROWS).itercolumns())):
                cap, rate, first = limits[limit]
                if held is None:
                    start = cap if first is None else min(max(first, 0), cap)
                    held = (start, us, cap, rate)
                tokens, seen, capacity, refill = map(int, held)
                if self.shared:
                    capacity, refill = cap, rate
                tokens = tokens + B.gain(us - seen, refill, self.shared)
                tokens, ok, left, wait = B.take(tokens, capacity, refill, self.shared)
                # A request from before the newest one seen gains nothing and is decided all the same.
                held = (tokens, max(us, seen), capacity, refill)
                out.append((*key, row_id, us, "allowed" if ok else "refused", ok, left, wait))
            yield pd.DataFrame(out, columns=[f.name for f in DECISIONS])
        tokens, seen, capacity, refill = held
        self.state.update((Decimal(tokens), seen, Decimal(capacity), Decimal(refill)))

    def close(self) -> None:
        pass


def stream_token_buckets(requests: DataFrame, *, variant: str = "local", expire_state: bool = False) -> DataFrame:
    """Decide requests as they arrive; state is two numbers and the limits per bucket.

    Rows of one micro-batch are taken in order of time. A row older than what its bucket
    has already seen is decided with what the bucket holds, without any gain. An idle 'shared' bucket is full
    again after a day of event time in any case; ``expire_state`` also frees its state after
    a day of processing time. Use it with continuous triggers only: state with a processing
    time keeps a run over the available data from ending.
    """
    if variant not in ("local", "shared"):
        raise ValueError("variant must be 'local' or 'shared'")
    shared = variant == "shared"
    if expire_state and not shared:
        raise ValueError("only shared buckets expire")
    use_rocksdb(requests.sparkSession)
    rows = _prepared(requests, ()).withColumnsRenamed({f"_{c}": c for c in ("us", "capacity", "refill", "initial")})
    decided = rows.groupBy(*KEYS).transformWithStateInPandas(
        statefulProcessor=_Bucket(shared, expire_state),
        outputStructType=DECISIONS,
        outputMode="Append",
        timeMode="ProcessingTime" if expire_state else "None",
    )
    return decided.withColumn("created_at", F.timestamp_micros("created_us")).drop("created_us")


def replay_stream(
    requests: DataFrame, path: str, checkpoint: str, *, variant: str = "local", chunk_seconds: int = 60, buckets: int = 64
) -> StreamingQuery:
    """Decide requests as they arrive, hot buckets by many tasks; decisions go to ``path``/decisions.

    Every micro-batch is replayed in time chunks from the versioned table of bucket states in ``path``/states, of which
    it rewrites the parts it touches. No task holds more than a chunk of a bucket. Batch n turns version n
    into n + 1, so a batch that is run again starts from the same state and writes the same decisions.
    """
    spark = requests.sparkSession

    def work(batch: DataFrame, number: int) -> None:
        table = VersionedTable(spark, f"{path}/states")
        if number == 0 and not table.versions():
            table = VersionedTable.create(spark.createDataFrame([], STATE), table.path, KEYS, buckets)
        decided, left = replay_from(table.read(number), batch, variant=variant, chunk_seconds=chunk_seconds)
        decided.write.mode("overwrite").parquet(f"{path}/decisions/batch={number}")
        try:
            table.merge(left, _newest, base=number)
        except ConflictError:  # this batch was committed before it was run again
            pass

    return for_each(requests, work, checkpoint)


def _newest(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """States with those of the buckets that come in replaced."""
    same = F.struct(*[F.coalesce(F.col(k), F.lit("")).alias(k) for k in KEYS])
    rows = stored.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    newest = rows.groupBy(same.alias("_key")).agg(F.max_by(F.struct(*STATE.names), "_new").alias("_row"))
    return newest.select("_row.*")
