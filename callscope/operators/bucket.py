"""Token-bucket replay over request logs.

A bucket is one (tenant, client, route). Its state is a running fold, so a plain window
cannot give it; a bucket may also hold a large part of the log, so it must not be folded
in one task. Every bucket is cut into time chunks:

1. every chunk is reduced, in parallel, to what it does to any number of start tokens;
2. these few numbers are chained per bucket, which gives each chunk its real start;
3. all chunks are replayed in parallel from their starts.

Rows meet their chunk by one hash partitioning with a sort inside the partition and are
read as a stream of Arrow batches, so no group is ever held in memory. What a chunk must know of its
bucket (limits, start) comes as a row at its head; the log is never joined with its buckets.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callscope.functions import bucket as B
from callscope.session import materialise

KEYS = ("tenant_id", "client_id", "route_id")
_MICRO = 1_000_000
_UNITS = "decimal(38,0)"


def _prepared(requests: DataFrame, carry) -> DataFrame:
    """Numeric columns of the fold. Invalid limits are clamped: capacity 1, refill 0."""
    capacity = F.when(F.col("bucket_capacity") <= 0, 1.0).otherwise(F.col("bucket_capacity"))
    refill = F.greatest(F.col("refill_rate"), F.lit(0.0))
    start = F.col("initial_tokens") if "initial_tokens" in requests.columns else F.lit(None).cast("double")
    # Token counts are read to a millionth, refill to a millionth of a millionth per second.
    tokens = lambda c: (F.round(c * _MICRO).cast(_UNITS) * F.lit(B.TOKEN // _MICRO).cast("decimal(13,0)")).cast(_UNITS)
    return requests.select(
        *KEYS,
        "id",
        F.unix_micros(F.col("created_at").cast("timestamp")).alias("_us"),
        tokens(capacity).alias("_capacity"),
        F.round(refill * (B.TOKEN // _MICRO)).cast(_UNITS).alias("_refill"),
        tokens(start).alias("_initial"),
        *carry,
    )


def _batches(frames: Iterator[pd.DataFrame], keys) -> Iterator[tuple[pd.DataFrame, list[bool]]]:
    """Batches with a flag per row: does a new group start here?"""
    last: tuple | None = None
    for frame in frames:
        if not len(frame):
            continue
        names = list(zip(*(frame[k] for k in keys)))
        flags = [a != b for a, b in zip(names, [last, *names])]
        last = names[-1]
        yield frame, flags


def _replay_batches(shared: bool, columns: list[str]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = seen = capacity = refill = 0
        for frame, _ in _batches(frames, (*KEYS, "_chunk")):
            keep, allowed, remaining, retry = [], [], [], []
            rows = zip(frame["_us"], frame["_capacity"], frame["_refill"], frame["_initial"], frame["_seed"])
            for us, cap, rate, first, seed in rows:
                us, cap, rate = int(us), int(cap), int(rate)
                if seed:
                    tokens, seen, capacity, refill = int(first), us, cap, rate
                    keep.append(False)
                    continue
                if shared:
                    capacity, refill = cap, rate
                tokens += B.gain(us - seen, refill, shared)
                seen = max(us, seen)
                tokens, ok, left, wait = B.take(tokens, capacity, refill, shared)
                keep.append(True)
                allowed.append(ok)
                remaining.append(left)
                retry.append(wait)
            out = frame.loc[keep, columns].copy()
            out["allowed"], out["remaining"], out["retry_after_ns"] = allowed, remaining, retry
            yield out

    return run


_TRANSFER = T.StructType(
    [
        *[T.StructField(k, T.StringType()) for k in KEYS],
        T.StructField("_chunk", T.LongType()),
        T.StructField("_from", T.LongType()),
        T.StructField("_to", T.LongType()),
        T.StructField("_capacity", T.DecimalType(38, 0)),
        T.StructField("_refill", T.DecimalType(38, 0)),
        T.StructField("_initial", T.DecimalType(38, 0)),
        T.StructField("_floor", T.LongType()),
        T.StructField("_starts", T.ArrayType(T.DecimalType(38, 0))),
        T.StructField("_slopes", T.ArrayType(T.IntegerType())),
        T.StructField("_offsets", T.ArrayType(T.DecimalType(38, 0))),
    ]
)


def _transfer_batches(shared: bool):
    names = [f.name for f in _TRANSFER]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head: list | None = None
        state = B.Transfer()
        seen = floor = 0
        done: list[tuple] = []

        def close() -> None:
            starts, slopes, offsets = map(list, zip(*state.pieces))
            done.append((*head, [Decimal(x) for x in starts], slopes, [Decimal(x) for x in offsets]))
            done[-1] = (*done[-1][:5], seen, *done[-1][6:])

        for frame, _ in _batches(frames, (*KEYS, "_chunk")):
            rows = zip(*(frame[c] for c in ("_seed", "_us", "_capacity", "_refill", "_initial", "_floor", *KEYS, "_chunk")))
            for seed, us, cap, rate, initial, least, *key in rows:
                us, cap, rate = int(us), int(cap), int(rate)
                if seed:
                    if head is not None:
                        close()
                    limits = cap, rate
                    floor = None if pd.isna(least) else int(least)
                    seen = us if floor is None else max(us, floor)
                    none = lambda x: None if pd.isna(x) else x
                    head = [*key, seen, seen, Decimal(cap), Decimal(rate), none(initial), floor]
                    state = B.Transfer()
                    continue
                if not shared:
                    cap, rate = limits
                if floor is not None:
                    us = max(us, floor)
                state.request(B.gain(us - seen, rate, shared), cap)
                seen = max(us, seen)
            if done:
                yield pd.DataFrame(done, columns=names)
                done = []
        if head is not None:
            close()
            yield pd.DataFrame(done, columns=names)

    return run


_SEED = T.StructType(
    [
        *[T.StructField(k, T.StringType()) for k in KEYS],
        T.StructField("_chunk", T.LongType()),
        T.StructField("_us", T.LongType()),
        T.StructField("_capacity", T.DecimalType(38, 0)),
        T.StructField("_refill", T.DecimalType(38, 0)),
        T.StructField("_initial", T.DecimalType(38, 0)),
    ]
)

#: What a bucket holds after its last request; the table that carries buckets from one log to the next.
STATE = T.StructType(
    [
        *[T.StructField(k, T.StringType()) for k in KEYS],
        T.StructField("tokens", T.DecimalType(38, 0)),
        T.StructField("seen_us", T.LongType()),
        T.StructField("capacity", T.DecimalType(38, 0)),
        T.StructField("refill", T.DecimalType(38, 0)),
    ]
)


def _chain(shared: bool):
    def run(chunks: pd.DataFrame) -> pd.DataFrame:
        """Start tokens of each chunk of one bucket, one short row per time chunk; a row without chunk is what is left at the end."""
        chunks = chunks.sort_values("_chunk")
        out, tokens, seen = [], 0, None
        for row in chunks.itertuples(index=False, name=None):
            r = dict(zip(chunks.columns, row))
            if seen is None:
                full = int(r["_capacity"])
                if not pd.isna(r["_floor"]):
                    # The bucket comes from an earlier log: ``_initial`` is what it held at ``_floor``.
                    tokens, seen = int(r["_initial"]), int(r["_floor"])
                else:
                    tokens = full if pd.isna(r["_initial"]) else min(max(int(r["_initial"]), 0), full)
            if seen is not None:
                tokens += B.gain(int(r["_from"]) - seen, int(r["_refill"]), shared)
            tokens = min(tokens, int(r["_capacity"]))
            out.append((*(r[k] for k in KEYS), r["_chunk"], r["_from"], r["_capacity"], r["_refill"], Decimal(tokens)))
            tokens = B.apply_pieces([int(x) for x in r["_starts"]], r["_slopes"], r["_offsets"], tokens)
            seen = max(int(r["_to"]), seen or 0)
        out.append((*(r[k] for k in KEYS), None, seen, r["_capacity"], r["_refill"], Decimal(tokens)))
        made = pd.DataFrame(out, columns=[f.name for f in _SEED])
        return made.astype({"_chunk": "Int64"})

    return run


def replay(
    requests: DataFrame,
    *,
    variant: str = "local",
    carry=(),
    chunk_seconds: int = 60,
) -> DataFrame:
    """Decide every request: ``allowed``, ``remaining`` tokens and ``retry_after_ns``.

    Input: the bucket keys, ``id``, ``created_at``, ``bucket_capacity``, ``refill_rate`` and
    optionally ``initial_tokens``; ``carry`` names further columns to keep. 'local' keeps
    the limits a bucket was made with and reports 0 when refused; 'shared' uses each
    request's own limits, keeps fractions, waits whole seconds and forgets idle buckets.
    """
    return replay_from(None, requests, variant=variant, carry=carry, chunk_seconds=chunk_seconds)[0]


def replay_from(
    state: DataFrame | None, requests: DataFrame, *, variant: str = "local", carry=(), chunk_seconds: int = 60
) -> tuple[DataFrame, DataFrame]:
    """:func:`replay` from what buckets hold (``STATE``), and what those in the log hold afterwards.

    A request from before the newest one its bucket has seen gains nothing and is decided all the same.
    """
    if variant not in ("local", "shared"):
        raise ValueError("variant must be 'local' or 'shared'")
    shared = variant == "shared"
    # Written once: the heads of the chunks, both passes and the output read it.
    rows = _prepared(requests, carry).withColumn("_chunk", F.floor(F.col("_us") / (chunk_seconds * _MICRO)).cast("bigint"))
    rows = materialise(rows, "bucket-rows")
    in_bucket = Window.partitionBy(*KEYS).orderBy("_chunk")
    heads = rows.groupBy(*KEYS, "_chunk").agg(
        F.min_by(F.struct("_us", "_capacity", "_refill", "_initial"), F.struct("_us", "id")).alias("_head")
    )
    made = F.first("_head").over(in_bucket.rowsBetween(Window.unboundedPreceding, 0))
    heads = heads.select(*KEYS, "_chunk", F.col("_head._us").alias("_us"), F.col("_head").alias("_own"), made.alias("_made"))
    # 'local' buckets keep the limits they were made with; 'shared' ones take those of the request.
    limits = "_own" if shared else "_made"
    heads = heads.select(
        *KEYS, "_chunk", "_us", F.col(f"{limits}._capacity").alias("_capacity"), F.col(f"{limits}._refill").alias("_refill"),
        F.col("_made._initial").alias("_initial"), F.lit(None).cast("bigint").alias("_floor"),
    )
    if state is not None:
        held = state.select(*[F.col(k).alias(f"_{k}") for k in KEYS], "tokens", "seen_us", "capacity", "refill")
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEYS])
        kept = lambda column, own: F.col(own) if shared else F.coalesce(column, own)
        heads = heads.join(held, same, "left").select(
            *KEYS, "_chunk", "_us", kept("capacity", "_capacity").alias("_capacity"), kept("refill", "_refill").alias("_refill"),
            F.coalesce("tokens", "_initial").alias("_initial"), F.col("seen_us").alias("_floor"),
        )
    asked = rows.select(*KEYS, "_chunk", "id", "_us", "_capacity", "_refill").withColumn("_seed", F.lit(False))
    asked = asked.unionByName(heads.withColumn("_seed", F.lit(True)), allowMissingColumns=True)
    chained = _in_order(asked, seeded=True).mapInPandas(_transfer_batches(shared), _TRANSFER).groupBy(*KEYS).applyInPandas(_chain(shared), _SEED)
    chained = materialise(chained, "bucket-chunks")
    seeds = chained.where("_chunk is not null").withColumn("_seed", F.lit(True))
    kept = [*KEYS, "id", "_us", *carry]
    stream = rows.withColumn("_seed", F.lit(False)).unionByName(seeds, allowMissingColumns=True)
    schema = T.StructType(
        [stream.schema[c] for c in kept]
        + [
            T.StructField("allowed", T.BooleanType()),
            T.StructField("remaining", T.DoubleType()),
            T.StructField("retry_after_ns", T.LongType()),
        ]
    )
    out = _in_order(stream, seeded=True).mapInPandas(_replay_batches(shared, kept), schema)
    left = chained.where("_chunk is null").select(
        *KEYS, F.col("_initial").alias("tokens"), F.col("_us").alias("seen_us"), F.col("_capacity").alias("capacity"), F.col("_refill").alias("refill")
    )
    return out.withColumn("created_at", F.timestamp_micros("_us")).drop("_us"), left


def _in_order(rows: DataFrame, *, seeded: bool = False) -> DataFrame:
    first = [F.col("_seed").desc()] if seeded else []
    return rows.repartition(*KEYS, "_chunk").sortWithinPartitions(*KEYS, "_chunk", *first, "_us", "id")


def bucket_segments(requests: DataFrame) -> DataFrame:
    """Number the stretches of each bucket that start full: ``gap * refill >= capacity``.

    Stretches that begin inside a (bucket, minute) are counted there; how a minute begins and what it counts from follow from
    one row per minute, so a hot bucket is never sorted as a whole. The log is read once and dealt out by minute.
    """
    slices = [*KEYS, "_minute"]
    rows = requests.withColumn("_minute", F.date_trunc("minute", "created_at"))
    inside = Window.partitionBy(*slices).orderBy("created_at", "id")
    full = lambda last, at, refill, capacity: (F.unix_micros(at) - F.unix_micros(last)) * refill >= capacity * _MICRO
    rows = rows.withColumn("_last", F.lag("created_at").over(inside))
    inner = full(F.col("_last"), F.col("created_at"), F.col("refill_rate"), F.col("bucket_capacity"))
    rows = rows.withColumn("_starts", F.coalesce(inner, F.lit(False)).cast("bigint"))
    rows = rows.withColumn("_nth", F.sum("_starts").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    rows = materialise(rows.drop("_last", "_starts"), "bucket-minutes")
    head = F.min_by(F.struct("created_at", "refill_rate", "bucket_capacity"), F.struct("created_at", "id")).alias("_head")
    minutes = rows.groupBy(*slices).agg(F.max("_nth").alias("_n"), head, F.max("created_at").alias("_end"))
    per_bucket = Window.partitionBy(*KEYS).orderBy("_minute")
    before = F.lag("_end").over(per_bucket)
    opens = F.coalesce(full(before, F.col("_head.created_at"), F.col("_head.refill_rate"), F.col("_head.bucket_capacity")), F.lit(True))
    minutes = minutes.withColumn("_opens", opens.cast("bigint"))
    ahead = F.sum(F.col("_n") + F.col("_opens")).over(per_bucket.rowsBetween(Window.unboundedPreceding, -1))
    base = minutes.select(*slices, (F.coalesce(ahead, F.lit(0)) + F.col("_opens") - 1).alias("_base"))
    return rows.join(base, slices).withColumn("segment", F.col("_base") + F.col("_nth")).select(*requests.columns, "segment")
