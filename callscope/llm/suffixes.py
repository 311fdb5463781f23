"""Removing long repeated passages by longest previous factors.

A byte is removed if a string of ``length`` bytes that covers it also starts elsewhere
(``keep_first``: starts earlier, by document id and place). A suffix has a previous factor of that
length if, in suffix order, its previous or next smaller position shares as many bytes, that is, if it is not
the first position of its run of suffixes with equal first ``length`` bytes; it has a
match of any direction if its run holds another suffix. A suffix array of a whole corpus would
shuffle every suffix; suffixes that can be equal are brought together first:

1. Content-chosen segments (see ``windows``): equal strings of ``length`` bytes lie around equal
   anchors. Segments whose anchor occurs once hold no repeat. Equal segments are one unit with its places.
2. The distinct units around one anchor are put in suffix order from the anchor on, and in order of what
   stands before it, read backwards, on their bytes. The longest common prefixes of neighbours tell, for
   every start of a string in a unit, its run; its first position stays or nothing does.

Units around one anchor are bounded by ``GROUP`` in a task. An anchor with more (a phrase in very many
settings) is split by its strings instead: their hashes are counted with map-side combine.
Equal segments are told by 64-bit hashes, strings in groups by their bytes. No step collects
places of strings per document but as runs; a task holds one slice of documents, or one document if longer.

``passage``, a shorter length, also reports the spans of strings of that length that start elsewhere; they stay in
place. It is searched first, in all documents. All parts of a repeated string of ``length`` bytes are repeated too, so documents with
fewer repeated starts than such a string has parts of ``passage`` bytes hold none, and the rest are searched for ``length``.

Defined cases: null and empty texts have no bytes and lose none; texts shorter than
``length`` stay whole; rows with equal id and text are one document (they are removed from
as repeats of each other unless ``keep_first``); an empty table gives an empty one; other columns
neither matter nor clash. Ties in place cannot occur: id, a hash of the text and the offset are one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from callscope.llm.common import raw, ready, slices, stored
from callscope.llm.windows import hashes, segments

LENGTH = 400
#: Bytes of a passage that is worth telling though it stays: some fifty short words.
PASSAGE = 200
#: Bytes that must be equal around segments for it; a shorter anchor makes fewer and longer segments.
PASSAGE_ANCHOR = 64
#: Bytes that must be equal around which segments are built, as a share of the length.
ANCHOR_SHARE = 0.64
#: Distinct units around one anchor that are put in order together.
GROUP = 4096
#: Text that is hashed at once; arrays of this many numbers stay near the processor.
HASH_BYTES = 1 << 19


def _segments(length: int, anchor: int):
    def run(batches):
        for batch in slices(batches, "text", HASH_BYTES):
            row, at, n, ahead, anchors, units = segments(*raw(batch.column("text")), length, anchor)
            taken = pa.array(row)
            columns = {
                "doc_id": batch.column("doc_id").take(taken),
                "row": batch.column("row").take(taken),
                "at": pa.array(at, pa.int64()),
                "n": pa.array(n, pa.int32()),
                "ahead": pa.array(ahead, pa.int32()),
                "anchor": pa.array(anchors.view(np.int64)),
                "unit": pa.array(units.view(np.int64)),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def _packed(batches):
    """Texts on their way through a shuffle, compressed."""
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        texts = [press.compress((t or "").encode()) for t in batch.column("text").to_pylist()]
        others = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in others), pa.array(texts, pa.binary())], [*others, "packed"]
        )


def _unpacked(column: pa.Array) -> list[bytes]:
    press = zstandard.ZstdDecompressor()
    return [press.decompress(x) if x else b"" for x in column.to_pylist()]


def _opened(batches):
    """(doc_id, row, text) from packed texts."""
    for batch in slices(batches, "packed", HASH_BYTES):
        texts = pa.array(_unpacked(batch.column("packed")), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), texts], ["doc_id", "row", "text"])


def _unit_bytes(length: int):
    """The bytes of the units that are asked for: (anchor, doc_id, row, at, n, ahead, group, many, bytes)."""

    def run(batches):
        for batch in slices(batches, "packed", HASH_BYTES // 4):
            taken, parts, made = [], [], []
            for i, (text, asked) in enumerate(zip(_unpacked(batch.column("packed")), batch.column("asked").to_pylist(), strict=True)):
                for part in asked or ():
                    taken.append(i)
                    parts.append(part)
                    made.append(text[part["at"] : part["at"] + part["n"] + length - 1])
            rows = pa.array(taken, pa.int64())
            kinds = {"anchor": pa.int64(), "at": pa.int64(), "n": pa.int32(), "ahead": pa.int32(), "group": pa.int64(), "many": pa.bool_()}
            columns = {name: pa.array([p[name] for p in parts], kind) for name, kind in kinds.items()}
            columns |= {"doc_id": batch.column("doc_id").take(rows), "row": batch.column("row").take(rows), "bytes": pa.array(made, pa.binary())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def _prefix_order(texts: np.ndarray, lengths: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of byte rows inside their groups, and the common prefix of each with the one before (-1: other group)."""
    width = texts.shape[1]
    keys = np.ascontiguousarray(texts).view(f"S{width}")[:, 0] if width else np.zeros(len(texts), "S1")
    order = np.lexsort((lengths, keys, groups))
    ordered, size = texts[order], lengths[order]
    common = np.full(len(order), -1, np.int64)
    differs = ordered[1:] != ordered[:-1]
    same = np.where(differs.any(axis=1), differs.argmax(axis=1), width) if width else np.zeros(max(0, len(order) - 1), np.int64)
    common[1:] = np.minimum(same, np.minimum(size[1:], size[:-1]))
    common[1:][groups[order[1:]] != groups[order[:-1]]] = -1
    return order, common


def repeated_starts(
    texts: list[bytes], n: np.ndarray, ahead: np.ndarray, groups: np.ndarray, rank: np.ndarray, length: int, anchor: int, keep_first: bool
) -> np.ndarray:
    """For units of some groups, which of their strings are repeats: a matrix of units by strings (``n`` of each count).

    ``ahead`` bytes stand before a unit's anchor; ``rank`` is the order of the units' places.
    """
    reach = length - anchor
    count = len(texts)
    before = np.zeros((count, reach), np.uint8)
    after = np.zeros((count, length), np.uint8)
    for i, (text, at) in enumerate(zip(texts, ahead.tolist(), strict=True)):
        data = np.frombuffer(text, np.uint8)
        before[i, :at] = data[:at][::-1]
        after[i, : len(data) - at] = data[at:]
    least = ahead - n + 1  # bytes before the anchor in a unit's last string
    order, common = _prefix_order(after, length - least, groups)
    common = np.where(common < anchor, -1, common - anchor)  # other anchor bytes: nothing in common
    back, common_back = _prefix_order(before, ahead, groups)
    found = np.zeros((count, int(n.max(initial=0))), bool)
    left, right = np.empty(count, np.int64), np.empty(count, np.int64)
    for d in range(reach + 1):
        units = np.flatnonzero((least <= d) & (d <= ahead))
        if len(units) < 2:
            continue
        left[back] = np.cumsum(common_back < d)
        right[order] = np.cumsum(common < reach - d)
        key = left[units] * (count + 1) + right[units]
        by = np.lexsort((rank[units], key))
        key = key[by]
        again = np.r_[False, key[1:] == key[:-1]]
        if not keep_first:
            again |= np.r_[again[1:], False]
        hit = units[by[again]]
        found[hit, ahead[hit] - d] = True
    return found


def _ordered(length: int, anchor: int, keep_first: bool):
    """Runs of repeated strings (row, at, n) of the groups of a partition that is sorted by anchor."""

    def runs(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = lambda name: batch.column(name).to_numpy(zero_copy_only=False)
        # Rows equal in id and text are one document; each of its units is needed once.
        once = np.sort(np.unique(np.stack([column("row"), column("at")]), axis=1, return_index=True)[1])
        batch = batch.take(pa.array(once))
        places = pa.table([batch.column(c) for c in ("doc_id", "row", "at")], ["doc_id", "row", "at"])
        order = pc.sort_indices(places, [(c, "ascending") for c in places.column_names], null_placement="at_start").to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        n, ahead = column("n").astype(np.int64), column("ahead").astype(np.int64)
        found = repeated_starts(batch.column("bytes").to_pylist(), n, ahead, column("anchor"), rank, length, anchor, keep_first)
        edges = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        unit, start = np.nonzero(edges == 1)
        _, end = np.nonzero(edges == -1)
        made = [batch.column("row").take(pa.array(unit)), pa.array(column("at")[unit] + start), pa.array(end - start, pa.int32())]
        return pa.RecordBatch.from_arrays(made, ["row", "at", "n"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        many = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            many += batch.num_rows
            if many >= 2 * GROUP:
                whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                anchors = whole.column("anchor").to_numpy()
                cut = int(np.searchsorted(anchors == anchors[-1], True))
                if cut:
                    yield runs(whole.slice(0, cut))
                held, many = [whole.slice(cut)], whole.num_rows - cut
        if many:
            yield runs(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return run


def _windows(length: int):
    """The hashes of all strings of some units: (window, doc_id, row, at, many)."""

    def run(batches):
        for batch in slices(batches, "bytes", HASH_BYTES // 4):
            found = [hashes(np.frombuffer(t, np.uint8), (length,))[0] for t in batch.column("bytes").to_pylist()]
            if not found:
                continue
            sizes = np.array([len(f) for f in found])
            unit = np.repeat(np.arange(len(found)), sizes)
            start = np.arange(len(unit)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            taken = pa.array(unit)
            made = [pa.array(np.concatenate(found).view(np.int64)), batch.column("doc_id").take(taken), batch.column("row").take(taken)]
            made += [pc.add(batch.column("at").take(taken), pa.array(start)), batch.column("many").take(taken)]
            yield pa.RecordBatch.from_arrays(made, ["window", "doc_id", "row", "at", "many"])

    return run


def _spans(runs: list[dict] | None, length: int) -> list[list[int]]:
    """The maximal spans that runs of window starts cover."""
    merged: list[list[int]] = []
    for start, n in sorted((r["at"], r["n"]) for r in runs or ()):
        end = start + n - 1 + length
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    return merged


def _cut(length: int, as_text: bool, passage: int | None):
    """Sizes, removed spans and what is left, from packed texts and runs of window starts; spans of passages."""

    def run(batches):
        for batch in slices(batches, "packed"):
            sizes, removed, spans, kept = [], [], [], []
            for text, runs in zip(_unpacked(batch.column("packed")), batch.column("runs").to_pylist(), strict=True):
                merged = _spans(runs, length)
                edges = [0, *(x for span in merged for x in span), len(text)]
                left = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                sizes.append(len(text))
                removed.append(len(text) - len(left))
                spans.append(merged)
                kept.append(left)
            others = [n for n in batch.schema.names if n not in ("packed", "runs", "passages")]
            if as_text:
                left_over = pa.array([x.decode(errors="ignore") for x in kept], pa.string())
            else:
                left_over = pa.array(kept, pa.binary())
            made = [pa.array(sizes, pa.int64()), pa.array(removed, pa.int64())]
            made += [pa.array(spans, pa.list_(pa.list_(pa.int64()))), left_over]
            names = [*others, "n_bytes", "n_removed", "spans", "kept"]
            if passage is not None:
                found = [_spans(runs, passage) for runs in batch.column("passages").to_pylist()]
                made.append(pa.array(found, pa.list_(pa.list_(pa.int64()))))
                names.append("passages")
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in others), *made], names)

    return run


def _repeats(rows: DataFrame, texts: DataFrame, length: int, anchor: int | None, group: int, keep_first: bool) -> DataFrame:
    """Runs (row, at, n) of starts of repeated strings in ``rows`` (doc_id, row, text); ``texts`` has them packed."""
    anchor = int(length * ANCHOR_SHARE) if anchor is None else anchor
    kind = rows.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, row long, at long, n int, ahead int, anchor long, unit long"
    found = stored(rows.mapInArrow(_segments(length, anchor), shape), "found")
    shared = stored(found.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1").select("anchor"), "anchors")
    shown = stored(found.join(shared, "anchor"), "segments")
    place = F.struct("doc_id", "row", "at")
    units = stored(
        shown.groupBy("unit").agg(
            F.count("*").alias("copies"), F.min(place).alias("first"), F.min("n").alias("n"), F.min("ahead").alias("ahead"), F.min("anchor").alias("anchor")
        ),
        "units",
    )
    varied = stored(units.groupBy("anchor").agg(F.count("*").alias("group")).where("group > 1"), "varied")
    part = F.struct("first.at", "n", "ahead", "anchor", "group", (F.col("copies") > 1).alias("many"))
    asked = units.join(varied, "anchor").select("first.row", part.alias("part")).groupBy("row").agg(F.collect_list("part").alias("asked"))
    shape = f"anchor long, at long, n int, ahead int, group long, many boolean, doc_id {kind}, row long, bytes binary"
    cut_out = stored(texts.join(asked, "row").mapInArrow(_unit_bytes(length), shape), "units")
    small = cut_out.where(F.col("group") <= group).repartition("anchor").sortWithinPartitions("anchor")
    ordered = small.mapInArrow(_ordered(length, anchor, keep_first), "row long, at long, n int")
    crowded = cut_out.where(F.col("group") > group).dropDuplicates(["row", "at"])
    windows = crowded.mapInArrow(_windows(length), f"window long, doc_id {kind}, row long, at long, many boolean")
    if keep_first:
        ahead = windows.groupBy("window").agg(F.count("*").alias("k"), F.min(place).alias("ahead")).where("k > 1")
        parts = windows.join(ahead, "window").where(place > F.col("ahead")).select("row", "at", F.lit(1).alias("n"))
        later = place != F.col("first")
    else:
        again = windows.groupBy("window").agg(F.count("*").alias("k")).where("k > 1").select("window")
        parts = windows.where("not many").join(again, "window").select("row", "at", F.lit(1).alias("n"))
        later = F.lit(True)
    copied = units.where("copies > 1").select("unit", "first")
    copies = shown.join(copied, "unit").where(later).select("row", "at", "n")
    return ordered.union(parts).union(copies)


def cut(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    anchor: int | None = None,
    group: int = GROUP,
    keep_first: bool = True,
    carry: bool = False,
    as_text: bool = False,
    passage: int | None = None,
    passage_anchor: int | None = None,
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, spans (removed), kept (bytes, or text).

    ``keep_first`` leaves the first copy of a passage in place; otherwise every copy goes.
    ``carry`` adds all columns of the input in a struct ``rest``, without the text. As text, bytes of characters that a cut
    splits are dropped. ``passage``, at most ``length``, adds ``passages``: the spans of strings of that many bytes that start
    elsewhere, the first copy's too.
    """
    ready(docs.sparkSession)
    if passage is not None and passage > length:
        raise ValueError("a passage is at most as long as what is cut")
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("doc_id"), F.xxhash64(F.col(key), whole).alias("row"), whole.alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    full = rows
    if carry:
        rest = F.struct(*[F.col(c) for c in docs.columns if c != text]).alias("rest")
        full = docs.select(F.col(key).alias("doc_id"), F.xxhash64(F.col(key), whole).alias("row"), rest, whole.alias("text"))
    columns = StructType([f for f in full.schema.fields if f.name != "text"])
    # The filter is also what the inner joins ask for, so that all joins read one exchange.
    texts = full.mapInArrow(_packed, StructType([*columns.fields]).add("packed", "binary")).where("row is not null")
    schema = StructType([*columns.fields]).add("n_bytes", "long").add("n_removed", "long")
    schema = schema.add("spans", ArrayType(ArrayType(LongType()))).add("kept", "string" if as_text else "binary")
    listed = F.collect_list(F.struct("at", "n"))
    if passage is None:
        runs = _repeats(rows, texts, length, anchor, group, keep_first).groupBy("row").agg(listed.alias("runs"))
        joined = texts.join(runs, "row", "left")
    else:
        found = _repeats(rows, texts, passage, passage_anchor, group, keep_first=False)
        found = stored(found.groupBy("row").agg(listed.alias("passages"), F.sum("n").alias("starts")), "passages")
        enough = found.where(F.col("starts") > length - passage).select("row")
        picked = stored(texts.select("doc_id", "row", "packed").join(enough, "row"), "picked")
        opened = picked.mapInArrow(_opened, f"doc_id {kind}, row long, text string")
        runs = _repeats(opened, picked, length, anchor, group, keep_first).groupBy("row").agg(listed.alias("runs"))
        joined = texts.join(runs, "row", "left").join(found.drop("starts"), "row", "left")
        schema = schema.add("passages", ArrayType(ArrayType(LongType())))
    return joined.select(*texts.columns, *joined.columns[len(texts.columns) :]).mapInArrow(_cut(length, as_text, passage), schema).drop("row")


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs`` with later copies of long passages cut out of the text, and ``n_chars`` to match.

    A null text becomes an empty one; other columns stay as they are.
    """
    slim = cut(docs, key, text, length, carry=True, as_text=True)
    columns = []
    for c in docs.columns:
        if c == text:
            columns.append(F.col("kept").alias(c))
        elif c == "n_chars":
            columns.append(F.length("kept").cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(F.col("rest")[c].alias(c))
    return slim.select(*columns)
