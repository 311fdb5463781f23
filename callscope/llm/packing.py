"""Packing documents into sequences of a fixed number of tokens by best two fit.

A document is its ids and an end id. Only documents longer than a sequence are cut, into
whole sequences, with the remainder first. How pieces are packed depends on their lengths
alone, so the packing is planned on the number of pieces of each length (``capacity``
counters, whatever the size of the table): fill a bin greedily with the longest pieces
that fit; then take its shortest piece out if two unpacked ones fill the gap better; repeat
that bin as often as the counters allow. Pieces are numbered within their length by
counts per task and length, and the number says which bin and offset a piece gets.

Defined cases: null and empty texts are the end id alone; rows with equal ids are packed one
by one; an empty table gives an empty one; other columns are left out.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callscope.llm.common import ready, slices, stored
from callscope.llm.encoding import Encoder

CAPACITY = 1024
END = 2


def _pieces(path: str, capacity: int, end: int, with_ids: bool):
    """The function that cuts the documents of a task into pieces and numbers them by length."""

    def run(batches):
        task = TaskContext.get().partitionId()
        used = np.zeros(capacity + 1, np.int64)
        for batch in slices(batches, "text"):
            ids, bounds = Encoder.of(path).encode(batch.column("text"))
            ids = np.insert(ids, bounds[1:], end)
            bounds = bounds + np.arange(len(bounds))
            n = np.diff(bounds)
            count = -(-n // capacity)
            row = np.repeat(np.arange(len(n)), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            head = (n - (count - 1) * capacity)[row]
            start = np.where(piece == 0, 0, head + (piece - 1) * capacity)
            length = np.where(piece == 0, head, capacity)
            order = np.argsort(length, kind="stable")
            ordered = length[order]
            runs = np.r_[True, np.diff(ordered) != 0] if len(ordered) else np.zeros(0, bool)
            since = np.arange(len(ordered)) - np.maximum.accumulate(np.where(runs, np.arange(len(ordered)), 0))
            number = np.empty(len(length), np.int64)
            number[order] = used[ordered] + since
            used += np.bincount(length, minlength=capacity + 1)
            words = ids.astype("<u4")
            view = memoryview(words).cast("B")
            at = bounds[row] + start
            crc = [zlib.crc32(view[4 * a : 4 * (a + k)]) for a, k in zip(at.tolist(), length.tolist(), strict=True)]
            columns = [
                batch.column("doc_id").take(pa.array(row)),
                pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()),
                pa.array(length, pa.int64()),
                pa.array(crc, pa.int64()),
                pa.array(np.full(len(row), task), pa.int32()),
                pa.array(number, pa.int64()),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "number"]
            if with_ids:
                starts = np.r_[0, np.cumsum(length)].astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(starts), pa.array(words.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """Bins as (how often, lengths) for ``counts[length]`` pieces."""
    left = counts.astype(np.int64).copy()
    bins = []
    index = np.arange(capacity + 1)
    while left.any():
        took: list[int] = []
        gap = capacity
        free = left.copy()
        while gap:
            fitting = np.flatnonzero(free[: gap + 1])
            if not len(fitting):
                break
            took.append(int(fitting[-1]))
            free[took[-1]] -= 1
            gap -= took[-1]
        if gap and len(took) > 1:
            shortest = took[-1]
            room = gap + shortest
            free[shortest] += 1
            fits = np.maximum.accumulate(np.where(free > 0, index, 0))
            first = np.flatnonzero(free[: room + 1])
            # The second piece is the longest that fits beside the first; the same length needs two.
            second = fits[room - first]
            alone = (second == first) & (free[first] < 2)
            second[alone] = fits[np.maximum(first[alone] - 1, 0)]
            total = np.where(second > 0, first + second, 0)
            best = int(np.argmax(total)) if len(total) else 0
            if len(total) and total[best] > shortest:
                took[-1:] = sorted((int(first[best]), int(second[best])), reverse=True)
        lengths, uses = np.unique(took, return_counts=True)
        times = int((left[lengths] // uses).min())
        left[lengths] -= times * uses
        bins.append((times, took))
    return bins


def _places(bins: list[tuple[int, list[int]]], capacity: int) -> tuple[np.ndarray, ...]:
    """Where the pieces of a length go: by length and number, the first bin and the offset of each run."""
    used = [0] * (capacity + 1)
    runs, sequence = [], 0
    for times, lengths in bins:
        offset = 0
        for length in lengths:
            runs.append((length, used[length], sequence, offset))
            used[length] += times
            offset += length
        sequence += times
    table = np.array(sorted(runs), np.int64).reshape(-1, 4)
    base = np.r_[0, np.cumsum(used)]
    return base, base[table[:, 0]] + table[:, 1], table[:, 2], table[:, 3]


def packed(
    docs: DataFrame,
    tokenizer: str,
    key: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    end: int = END,
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece: its place in its document, its sequence and offset, and its ids if wanted."""
    spark = docs.sparkSession
    ready(spark)
    schema = "doc_id {}, piece int, start long, length long, ids_crc32 long, task int, number long".format(
        docs.schema[key].dataType.simpleString()
    )
    pieces = stored(
        docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
            _pieces(tokenizer, capacity, end, with_ids), schema + (", ids array<int>" if with_ids else "")
        ),
        "pieces",
    )
    counts = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    # At most `capacity` rows, whatever the table holds.
    by_length = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    base, first, sequence, offset = _places(
        plan(np.array([by_length.get(i, 0) for i in range(capacity + 1)]), capacity), capacity
    )
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))

    def place(batches):
        for batch in batches:
            place_of = base[batch.column("length").to_numpy()] + batch.column("number").to_numpy()
            run = np.searchsorted(first, place_of, side="right") - 1
            keep = [i for i, n in enumerate(batch.schema.names) if n not in ("number", "task")]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i) for i in keep),
                    pa.array(sequence[run] + place_of - first[run], pa.int64()),
                    pa.array(offset[run], pa.int64()),
                ],
                [*(batch.schema.names[i] for i in keep), "sequence_id", "offset"],
            )

    numbered = pieces.join(shifts, ["task", "length"]).select(
        *[c for c in pieces.columns if c not in ("number", "task")], (F.col("number") + F.col("before")).alias("number")
    )
    out = [f for f in numbered.schema.fields if f.name != "number"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out)
    return numbered.mapInArrow(place, f"{schema}, sequence_id long, offset long")
