"""SimHash near-duplicates: pigeonhole blocks, then Hamming distance.

A fingerprint's 64 bits are cut into ``blocks`` blocks. Two fingerprints that differ in at
most ``distance`` bits agree in at least ``blocks - distance`` blocks, so they meet under
one of the keys made of that many blocks (6 and 3: 20 keys of about 32 bits, so chance
meetings stay rare at billions of fingerprints). Only distinct fingerprints are compared.
Those under one key are dealt into tiles of at most ``2 * TILE`` by a hash of the
fingerprint, whatever the size of the group; every two members meet in a tile, and a
tile returns one link per member, to the least it is connected with, not its pairs. No link
is lost: the components are those of all links.

Defined cases: null and empty texts, and texts of white space, have fingerprint zero and
link like others; equal texts always share a component; a component without any non-null
id has a null one; an empty table gives an empty one; other columns are left out.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callscope.llm.common import keyed, new_name, rows_bytes, stored, with_column
from callscope.llm.components import CHUNK, components, least_nodes

SHINGLE = 3
DISTANCE = 3
BLOCKS = 6
SEED = 42
#: Sets of connected members that a task holds before it contracts their links.
STARS = 1 << 14
#: Fingerprints of a group that a task compares with as many others.
TILE = 2048


def _hashes(text: bytes, size: int) -> list[int]:
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # of bytes: only A-Z, and only the white space of the contract
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= size:
        return [xxh64_intdigest(joined, SEED)]
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 0x20)
    starts = [0, *(gaps[: len(words) - size] + 1).tolist()]
    ends = [*gaps[size - 1 :].tolist(), len(joined)]
    return [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)]


def fingerprints(texts: pa.Array, size: int = SHINGLE) -> pa.Array:
    """The fingerprint of each text, as a signed 64-bit number."""
    hashes = [_hashes(text, size) for text in rows_bytes(texts)]
    counts = np.array([len(h) for h in hashes], np.int64)
    made = np.zeros(len(hashes), np.uint64)
    rows = np.flatnonzero(counts)
    if len(rows):
        all_hashes = np.array([h for row in hashes for h in row], np.uint64)
        bits = np.unpackbits(all_hashes.view(np.uint8).reshape(-1, 8), axis=1)
        starts = (np.cumsum(counts) - counts)[rows]
        sums = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        set_bits = 2 * sums > counts[rows, None]
        made[rows] = np.packbits(set_bits, axis=1).view(np.uint64)[:, 0]
    return pa.array(made.view(np.int64), pa.int64())


def _masks(blocks: int, distance: int) -> list[int]:
    """Bit masks of all keys, as signed 64-bit numbers."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    block = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:], strict=False)]
    masks = [sum(chosen) for chosen in combinations(block, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _stars(prints: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each set of members that links of at most ``distance`` bits connect: its least, linked to all others."""
    links, open_ = [], prints
    while len(open_):
        group, queue, open_ = [open_[:1]], [open_[0]], open_[1:]
        while queue and len(open_):
            near = np.bitwise_count(open_ ^ queue.pop()) <= distance
            if near.any():
                group.append(open_[near])
                queue.extend(group[-1])
                open_ = open_[~near]
        if len(group) > 1:
            members = np.sort(np.concatenate(group).view(np.int64))
            links.append((members[1:], np.full(len(members) - 1, members[0])))
    return links


def _tile_links(distance: int):
    """Links within the tiles of a partition that is sorted by tile, contracted over tiles."""

    def groups(columns: list[np.ndarray], prints: np.ndarray):
        if not len(prints):
            return
        new = np.zeros(len(prints), bool)
        new[0] = True
        for column in columns:
            new[1:] |= np.diff(column) != 0
        starts = np.flatnonzero(new)
        sizes = np.diff(np.r_[starts, len(prints)])
        pairs = starts[sizes == 2]
        near = pairs[np.bitwise_count(prints[pairs] ^ prints[pairs + 1]) <= distance]
        yield prints[near].view(np.int64), prints[near + 1].view(np.int64)
        for at, size in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
            yield from _stars(prints[at : at + size], distance)

    def whole_tiles(batches):
        held = None
        for batch in batches:
            table = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            if held is not None:
                table = [np.r_[a, b] for a, b in zip(held, table, strict=True)]
            last = np.ones(len(table[0]), bool)
            for column in table[:4]:
                last &= column == column[-1]
            cut = int(np.argmax(last)) if len(last) else 0
            held = [c[cut:] for c in table]
            yield from groups([c[:cut] for c in table[:4]], table[4][:cut].view(np.uint64))
        if held is not None:
            yield from groups(held[:4], held[4].view(np.uint64))

    def run(batches):
        found, many = [], 0
        for link in whole_tiles(batches):
            found.append(link)
            many += len(link[0])
            if many >= CHUNK or len(found) >= STARS:
                yield contracted_links(found)
                found, many = [], 0
        if many:
            yield contracted_links(found)

    def contracted_links(found):
        a, b, _ = least_nodes(*(np.concatenate([x[i] for x in found]) for i in (0, 1)))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def links(prints: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, tile: int = TILE) -> DataFrame:
    """Links (a, b) that connect the distinct numbers in ``fingerprint`` as all close pairs would."""
    keys = [F.struct(F.lit(i).alias("block"), F.col("fingerprint").bitwiseAND(F.lit(m)).alias("value")) for i, m in enumerate(_masks(blocks, distance))]
    rows = prints.select("fingerprint", F.explode(F.array(*keys)).alias("k")).select("fingerprint", "k.*")
    shared = stored(rows.groupBy("block", "value").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    tiles = F.ceil(F.col("n") / tile).cast("int")
    # Not the hash by which Spark deals rows, so that a part is not one partition's.
    part = F.pmod(F.xxhash64("fingerprint"), tiles.cast("long")).cast("int")
    met = (
        rows.join(shared, ["block", "value"])
        .withColumn("part", part)
        .withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1)))
        .select("block", "value", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "fingerprint")
    )
    dealt = met.repartition("block", "value", "x", "y").sortWithinPartitions("block", "value", "x", "y")
    return dealt.mapInArrow(_tile_links(distance), "a long, b long")


def classes(docs: DataFrame, size: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, text_hash, fingerprint, root, component_id) of every row of a ``keyed`` table, without texts.

    The root is a fingerprint of the component; ids that repeat could not tell components apart.
    """
    found = with_column(docs, "fingerprint", T.LongType(), lambda column: fingerprints(column, size))
    found = stored(found.drop("text"), "simhash")
    firsts = stored(found.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "prints")
    roots = components(links(firsts, distance))
    named = stored(firsts.join(roots, firsts["fingerprint"] == roots["node"]).select("fingerprint", "first", "root"), "named")
    least = stored(named.groupBy("root").agg(F.min("first").alias("least")), "least")
    linked = named.join(least, "root").select("fingerprint", "root", "least")
    # A component alone keeps its own id; one whose ids are all null keeps null.
    label = F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("least")).alias("component_id")
    root = F.coalesce("root", "fingerprint").alias("root")
    labels = stored(firsts.join(linked, "fingerprint", "left").select("fingerprint", root, label), "labels")
    return found.join(labels, "fingerprint")


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, distance: int = DISTANCE
) -> DataFrame:
    """One row per document: id, fingerprint (hexadecimal) and the least id of its component."""
    digits = F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint")
    return classes(keyed(docs, key, text), size, distance).select("doc_id", digits, "component_id")


def keep_first(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, distance: int = DISTANCE
) -> DataFrame:
    """One document of each component, the one with the least id, with the columns it came with.

    A null id counts as the greatest. Of rows of a component that share the id, the one whose
    text has the least hash stays, once.
    """
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    chosen = classes(keyed(docs, key, text), size, distance).groupBy("root").agg(F.min(order).alias("kept"))
    # Two hashes without nulls as the join keys: copies of a row then lie in one partition already.
    names = [new_name(docs, "id_hash"), new_name(docs, "text_hash")]
    chosen = stored(chosen.select(F.xxhash64("kept.doc_id").alias(names[0]), F.col("kept.text_hash").alias(names[1])), "chosen")
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.withColumns({names[0]: F.xxhash64(key), names[1]: F.xxhash64(whole)})
    return rows.join(chosen, names, "left_semi").dropDuplicates(names).select(*docs.columns)
