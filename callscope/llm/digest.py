"""Quartile bucket digests: fingerprints of whole texts that can be compared.

Byte triplets within windows of eight bytes are hashed into ``BUCKETS`` counters. Each
counter is written as its quartile among the text's counters (two bits), after a byte for the
length on a logarithmic scale. Two digests differ by the sum of their quartile distances (a
jump over all quartiles counts double) and of their length distance; likeness is one minus
the share of the greatest possible difference, so it lies between 0 and 1.

``chained`` also compares every document with its neighbour in the order of ids. The table is
dealt out by ranges of ids and sorted once; a task walks its range, and only the last
document of each range meets the first of the next in a small join.

Defined cases: null and empty texts count as empty (all counters equal); equal texts have
equal digests; rows with equal ids follow one another by text, null ids come first; a
single document is its own neighbour; an empty table gives an empty one; other columns are
left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.llm.common import raw, ready, slices, stored

BUCKETS = 512
#: Offsets of the bytes of a triplet. Wide ones tell texts of one language apart better than neighbours do.
TRIPLETS = ((0, 3, 6), (0, 4, 7), (0, 3, 7))
#: Weight of a step of the length byte against a quartile step, and steps that count.
LENGTH_STEPS = 16
#: Spread a byte over the buckets, one table for each place in each triplet; any fixed numbers do.
_SPREAD = np.random.default_rng(7).integers(0, BUCKETS, (len(TRIPLETS), 3, 256), dtype=np.uint16)


def counters(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The bucket counts of each text, (texts, BUCKETS)."""
    n = len(offsets) - 1
    row = np.repeat(np.arange(n, dtype=np.int64) * BUCKETS, np.diff(offsets))
    made = np.zeros(n * BUCKETS, np.int64)
    for spread, places in zip(_SPREAD, TRIPLETS, strict=True):
        width = places[-1]
        if len(data) <= width:
            continue
        end = len(data) - width
        bucket = spread[0][data[places[0] : places[0] + end]].copy()
        for table, at in zip(spread[1:], places[1:], strict=True):
            bucket ^= table[data[at : at + end]]
        same = row[:end] == row[width:]
        made += np.bincount((row[:end] + bucket)[same], minlength=n * BUCKETS)
    return made.reshape(n, BUCKETS)


def digests(texts: list[bytes]) -> np.ndarray:
    """One row of bytes per text: the length byte, then a quartile (0 to 3) for each bucket."""
    sizes = np.array([len(t) for t in texts], np.int64)
    counts = counters(np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum(sizes)])
    cuts = np.partition(counts, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1], axis=1)
    made = np.zeros((len(texts), BUCKETS + 1), np.uint8)
    made[:, 0] = np.minimum(np.log1p(sizes) / np.log(1.1), 255)
    for cut in (BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1):
        made[:, 1:] += counts > cuts[:, cut : cut + 1]
    return made


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    step = np.abs(a[:, 1:].astype(np.int16) - b[:, 1:])
    apart = np.where(step == 3, 6, step).sum(axis=1)
    longer = np.minimum(np.abs(a[:, 0].astype(np.int16) - b[:, 0]), LENGTH_STEPS)
    return 1 - (apart + longer) / (6 * BUCKETS + LENGTH_STEPS)


def written(digest: np.ndarray) -> list[str]:
    """Hexadecimal: the length, then four quartiles a byte."""
    q = digest[:, 1:].reshape(len(digest), -1, 4)
    packed = (q << np.array([6, 4, 2, 0], np.uint8)).sum(axis=2, dtype=np.uint8)
    return [row.tobytes().hex() for row in np.c_[digest[:, :1], packed]]


def _edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_COLUMNS = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
_KINDS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(texts: list[str], following: list[str]) -> list[pa.Array]:
    edited = [_edited(a, b).encode() for a, b in zip(texts, following, strict=True)]
    n = len(texts)
    found = digests([*(t.encode() for t in texts), *edited, *(t.encode() for t in following)])
    own, changed, after = found[:n], found[n : 2 * n], found[2 * n :]
    return [
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t).hexdigest() for t in edited]),
        pa.array(written(own)),
        pa.array(written(changed)),
        pa.array(likeness(own, changed)),
        pa.array(likeness(own, after)),
    ]


def _walk(batches):
    """Compares each document of a sorted range with the next; the range's ends go out with their texts."""
    part = TaskContext.get().partitionId()
    names = ["end", "part", "doc_id", "text", *_COLUMNS]
    held = None

    def ends(kind: int, column: pa.Array, text: str) -> pa.RecordBatch:
        made = [pa.array([None], t) for t in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]
        return pa.RecordBatch.from_arrays(
            [pa.array([kind], pa.int32()), pa.array([part], pa.int32()), column, pa.array([text], pa.string()), *made], names
        )

    for batch in slices(batches, "text", 1 << 20):
        ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
        if held is None:
            yield ends(1, ids.slice(0, 1), texts[0])
        else:
            ids = pa.concat_arrays([held[0], ids])
            texts = [held[1], *texts]
        held = ids.slice(len(ids) - 1, 1), texts[-1]
        n = len(texts) - 1
        if n:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.zeros(n, np.int32)),
                    pa.array(np.full(n, part, np.int32)),
                    ids.slice(0, n),
                    pa.nulls(n, pa.string()),
                    *_compared(texts[:-1], texts[1:]),
                ],
                names,
            )
    if held is not None:
        yield ends(2, *held)


def _last(batches):
    for batch in batches:
        made = _compared(batch.column("text").to_pylist(), batch.column("following").to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], ["doc_id", *_COLUMNS])


def chained(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: digests of it and of its edited text, and likeness to that and to the next document."""
    spark = docs.sparkSession
    ready(spark)
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    walked = stored(
        rows.repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(_walk, f"end int, part int, doc_id {kind}, text string, {_KINDS}"),
        "digests",
    )
    # The numbers of the ranges that hold rows; there are as many as tasks.
    parts = sorted(r["part"] for r in walked.where("end = 1").select("part").collect())
    after = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, next int")
    heads = walked.where("end = 1").select(F.col("part").alias("next"), F.col("text").alias("following"))
    tails = walked.where("end = 2").select("doc_id", "text", "part").join(after, "part").join(heads, "next")
    last = tails.select("doc_id", "text", "following").mapInArrow(_last, f"doc_id {kind}, {_KINDS}")
    return walked.where("end = 0").select("doc_id", *_COLUMNS).union(last)
