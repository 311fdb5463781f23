"""Connected components of links, by contraction and pointer jumping.

Links point from a node to a smaller one. They should come contracted task by task (``least_nodes``) if
there are many. A round replaces each link's end by what that end points to, contracts the links of each
task (every node of a connected part gets one link, to the part's least node), deals them out by
their node, and contracts again. A round writes the least end of every node, and at most one link per node and
task. When a round changes nothing, every node points to the least node it reaches; chains halve each round.

No node gathers its neighbours: links are dealt out by their larger end, and a node
with very many links arrives with one link per task. Ends that very many nodes
point to only occur as a join key of rows that Spark can split, against a written table.

Defined cases: links of a node with itself, repeated links and both directions are fine; an
empty table gives an empty one; nodes are long integers, not null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from callscope.llm.common import stored

#: Links that a task contracts at once before they are dealt out.
CHUNK = 1 << 18
LINKS = "a long, b long, changed long"


def least_nodes(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """The nodes of some links but the least of each connected part, those least nodes, and whether that is news."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        x, y = label[left], label[right]
        if (x == y).all():
            break
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            further = label[label]
            if (further == label).all():
                break
            label = further
    inner = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[inner], nodes[label[inner]], bool((label[left] != right)[left != right].any())


def contracted(chunk: int | None):
    """Links (a, b, changed) of a partition, contracted ``chunk`` at a time (None: all together)."""

    def out(parts):
        a, b = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        nodes, least, news = least_nodes(a, b)
        before = max(int(p[2]) for p in parts)
        rows = [pa.array(nodes), pa.array(least), pa.array(np.full(len(nodes), max(before, news), np.int64))]
        return pa.RecordBatch.from_arrays(rows, ["a", "b", "changed"])

    def run(batches):
        held, many = [], 0
        for batch in batches:
            if batch.num_rows:
                a, b, changed = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b", "changed"))
                held.append((a, b, changed.max()))
                many += batch.num_rows
            if chunk and many >= chunk:
                yield out(held)
                held, many = [], 0
        if held:
            yield out(held)

    return run


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b) with a link to another; the root is the least node reachable."""
    up, down = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    links = links.where("a <> b").select(up, down, F.lit(0).cast("long").alias("changed"))
    first = True
    while True:
        if not first:
            ends = stored(links.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("end")), "ends")
            moved = F.when(F.col("end").isNull(), 0).otherwise(1).cast("long").alias("changed")
            links = links.join(ends, "b", "left").select("a", F.coalesce("end", "b").alias("b"), moved)
            links = links.mapInArrow(contracted(CHUNK), LINKS)
        dealt = links.repartition("a").mapInArrow(contracted(None), LINKS)
        seen = Observation()
        links = stored(dealt.observe(seen, F.max("changed").alias("changed")), "links").select("a", "b")
        if not first and not seen.get["changed"]:
            break
        first = False
    return links.toDF("node", "root").union(links.select("b", "b").distinct())
