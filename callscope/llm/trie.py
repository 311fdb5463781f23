"""Prefix trie of conversations by whole-sequence collapse.

Identical conversations are grouped into one weighted sequence with the list of its ends; all that
follows works on distinct sequences. A sequence that is a proper prefix of another is
no leaf (anti-join). The prefixes of the sequences, with their weights added up, are the nodes.

A node is known by its depth and 128 bits: the exclusive or, over its turns, of hashes of place,
role and text. Every prefix's bits are thus a running value, which ``operators.running`` takes
in slices, so a conversation of any length is spread over tasks, as are the turns of a hot
conversation when they are put in order. Only narrow rows (ids, hashes, sizes) are shuffled after that;
what a node says is found again through its witness, the smallest member at its depth.

Defined cases: rows without conversation id are left out (they belong to no conversation); null role
or text is empty; turns are ordered by turn (null first), ties by role, then text; repeated rows are
turns like others; an empty table gives an empty one; other columns neither matter nor clash.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.llm.common import stored
from callscope.operators.running import numbered, running

#: Conversations share the head of the first of their hundred, of fewer than this many turns.
FAMILY = 100
HEADS = 6
#: Turns of a conversation that are one slice.
SLICE = 4096
#: Ends of a node are kept in lists of at most this many ids (a power of two).
LIST_BITS = 12

NODE = ["depth", "x", "y"]


def ordered(turns: DataFrame, *keep) -> DataFrame:
    """(conv_id, what to keep, pos) of all turns in order, from 0."""
    rows = turns.where("conv_id is not null").select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    return numbered(rows, ["conv_id"], order, list(keep))


def rebuilt(turns: DataFrame, family: int = FAMILY, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, pos, from_conv, from_pos, p, q, chars) and conversations (conv_id, n) after rebuilding.

    Conversation c begins with the first h turns of conversation c - c % family, h = crc32(c) % heads, and goes
    on with its own after its first h. p and q are hashes of a turn's words, chars its code points.
    """
    p = F.xxhash64("role", "text").alias("p")
    q = F.xxhash64(F.lit("second"), "text", "role").alias("q")
    slim = stored(ordered(turns, p, q, F.length("text").cast("long").alias("chars")), "turns")
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    sizes = slim.groupBy("conv_id").agg(F.count("*").alias("size"))
    convs = sizes.select("conv_id", "size", head.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("base"))
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("size").alias("base_size"))
    convs = convs.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_size", F.lit(0))))
    convs = stored(
        convs.withColumn("n", F.col("taken") + F.greatest(F.col("size") - F.col("h"), F.lit(0))), "conversations"
    )
    first = slim.where(F.col("pos") < heads).withColumnRenamed("conv_id", "base")
    heads_ = convs.join(first, "base").where("pos < taken")
    heads_ = heads_.select("conv_id", "pos", F.col("base").alias("from_conv"), F.col("pos").alias("from_pos"), "p", "q", "chars")
    tails = slim.join(convs.select("conv_id", "h", "taken"), "conv_id").where("pos >= h")
    place = (F.col("pos") - F.col("h") + F.col("taken")).alias("pos")
    tails = tails.select("conv_id", place, F.col("conv_id").alias("from_conv"), F.col("pos").alias("from_pos"), "p", "q", "chars")
    return heads_.union(tails), convs.select("conv_id", "n")


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, x, y, px, py, chars): every prefix of one turn and more, and its parent's bits."""
    rows = stored(turns.select("conv_id", "pos", F.xxhash64("p", "pos").alias("p"), F.xxhash64("pos", "q").alias("q"), "chars"), "rebuilt")
    values = {"x": ("xor", F.col("p")), "y": ("xor", F.col("q"))}
    rows = running(rows, ["conv_id"], F.shiftright("pos", SLICE.bit_length() - 1), [F.col("pos")], values)
    parent = [F.col("x").bitwiseXOR(F.col("p")).alias("px"), F.col("y").bitwiseXOR(F.col("q")).alias("py")]
    return rows.select("conv_id", (F.col("pos") + 1).alias("depth"), "x", "y", *parent, "chars")


def trie(turns: DataFrame, family: int = FAMILY, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """The nodes of all rebuilt conversations, and where they end.

    Nodes: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    n_ends, x, y. Ends: (depth, x, y, list_no, ids): a node's ending conversations, in rising lists of bounded size.
    """
    rows, convs = rebuilt(turns, family, heads)
    steps = stored(prefixes(rows), "prefixes")
    bits = convs.alias("c").join(
        steps.select(F.col("conv_id").alias("conv"), "depth", "x", "y"),
        (F.col("c.conv_id") == F.col("conv")) & (F.col("c.n") == F.col("depth")), "left",
    )
    # A conversation without turns is the root.
    whole = stored(
        bits.select("conv_id", F.col("n").alias("depth"), F.coalesce("x", F.lit(0)).alias("x"), F.coalesce("y", F.lit(0)).alias("y")),
        "whole",
    )
    sequences = stored(
        whole.groupBy(*NODE).agg(F.count("*").alias("weight"), F.min("conv_id").alias("conv_id")), "sequences"
    )
    # The prefixes of each distinct sequence, once, with its weight; the root is a prefix of all.
    chosen = sequences.select("conv_id", "weight", F.col("depth").alias("size"))
    deep = steps.join(chosen, "conv_id").select("conv_id", "weight", "size", *NODE, "px", "py", "chars")
    none = F.lit(None).cast("long")
    root = chosen.select("conv_id", "weight", "size", F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long"), none, none, none)
    weighted = stored(deep.union(root), "weighted")
    inner = weighted.where("depth < size").select(*NODE).distinct()
    leaves = sequences.join(inner, NODE, "left_anti").select("conv_id", F.lit(1).alias("leaf"))
    added = weighted.join(leaves, "conv_id", "left").groupBy(*NODE).agg(
        F.sum("weight").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves"),
        F.min("px").alias("px"), F.min("py").alias("py"), F.min("chars").alias("chars"),
    )
    nodes = stored(added, "nodes")

    # Each node's own saving is told on its witness, whose suffix sums are then added up node by node.
    saving = ((F.col("n_convs") - 1) * F.coalesce("chars", F.lit(0))).alias("saving")
    told = weighted.select("conv_id", *NODE).join(nodes.select("conv_id", "depth", saving), ["conv_id", "depth"], "left")
    told = stored(told.withColumn("saving", F.coalesce("saving", F.lit(0))), "savings")
    back = running(
        told, ["conv_id"], -F.shiftright("depth", SLICE.bit_length() - 1), [F.desc("depth")], {"below": ("sum", F.col("saving"))}
    )
    saved = back.groupBy(*NODE).agg(F.sum("below").alias("saved_tokens"))

    born = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("px").alias("x"), F.col("py").alias("y"))
    born = born.agg(F.count("*").alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv_id").alias("parent_conv_id"))
    ends = sequences.select(*NODE, F.col("weight").alias("n_ends"))
    out = nodes.join(parents, ["depth", "px", "py"], "left")
    # One row a node from here on: no key of these joins is hot.
    out = out.join(saved, NODE).join(born, NODE, "left").join(ends, NODE, "left")
    lists = whole.groupBy(*NODE, F.shiftright("conv_id", LIST_BITS).alias("list_no"))
    lists = lists.agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    zero = F.lit(0).cast("long")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves",
        "saved_tokens", F.coalesce("n_ends", zero).alias("n_ends"), "x", "y",
    ), lists


def texts(nodes: DataFrame, turns: DataFrame, family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """``nodes`` with the role and text of their last turn, read from the witness (root: null)."""
    rows, _ = rebuilt(turns, family, heads)
    where = rows.select("conv_id", (F.col("pos") + 1).alias("depth"), "from_conv", "from_pos")
    said = ordered(turns, "role", "text").select(F.col("conv_id").alias("from_conv"), F.col("pos").alias("from_pos"), "role", "text")
    found = nodes.select("conv_id", "depth").join(where, ["conv_id", "depth"]).join(said, ["from_conv", "from_pos"])
    return nodes.join(found.select("conv_id", "depth", "role", "text"), ["conv_id", "depth"], "left")


def list_digests(lists: DataFrame) -> DataFrame:
    """(depth, x, y, ends_sha256): the SHA-256 of a node's ends, in decimal, comma-joined.

    SHA-256 reads its input in order, so one task reads a node's lists, one after
    another; it holds one list (at most ``2 ** LIST_BITS`` ids), whatever the node's size.
    """
    rows = lists.select(*NODE, "list_no", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
    rows = rows.repartition(*NODE).sortWithinPartitions(*NODE, "list_no")

    def run(batches):
        held, digest = None, None

        def row():
            return [pa.array([v], pa.int64()) for v in held] + [pa.array([digest.hexdigest()])]

        for batch in batches:
            done = []
            for *node, ids in zip(*[batch.column(c).to_pylist() for c in (*NODE, "ids")], strict=True):
                if node == held:
                    digest.update(b"," + ids.encode())
                else:
                    if held is not None:
                        done.append(row())
                    held, digest = node, hashlib.sha256(ids.encode())
            if done:
                columns = [pa.concat_arrays(c) for c in zip(*done, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, [*NODE, "ends_sha256"])
        if held is not None:
            yield pa.RecordBatch.from_arrays(row(), [*NODE, "ends_sha256"])

    return rows.mapInArrow(run, "depth long, x long, y long, ends_sha256 string")
