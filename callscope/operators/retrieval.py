"""Vector search, context building, prompts and retrieval quality, many queries at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callscope.functions import columns as C

#: Queries and chunks that are scored at a time, and the most chunks of such a tile whatever the block.
BLOCK_QUERIES, BLOCK_CHUNKS, TILE = 1024, 50_000, 4096
#: Queries that a task holds while chunks stream past them, and the most streams that the chunks of a group are dealt out to.
HELD_QUERIES, STREAMS = 16_384, 4
_HITS = "query_id string, id bigint, similarity double"
_DIGITS = 12


class _Best:
    """The k best chunks of each of a block of queries, from tiles of chunks so that few scores exist at once.

    With buckets, a pair meets in each table in which it shares a bucket, and each table has k best of its own.
    """

    def __init__(self, queries: np.ndarray, buckets: np.ndarray | None, k: int) -> None:
        self.queries, self.buckets, self.k = queries, buckets, k
        self.tables = 1 if buckets is None else buckets.shape[1]
        self.slot, self.at, self.score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        self.bound = np.full((len(queries), self.tables), -np.inf)

    def add(self, ids: np.ndarray, chunks: np.ndarray, buckets: np.ndarray | None) -> None:
        raw = self.queries @ chunks.T
        if np.isnan(raw.sum()):
            compared = np.where(np.isnan(raw), -np.inf, raw)  # what is no number comes last
        else:
            compared = raw
        flat = np.flatnonzero(compared >= self.bound.min(axis=1)[:, None])
        row, column = np.divmod(flat, len(chunks))
        if buckets is None:
            slot = row
        else:
            given, slots, columns = compared.reshape(-1)[flat], [], []
            for table in range(self.tables):
                good = (given >= self.bound[row, table]) & (self.buckets[row, table] == buckets[column, table])
                slots.append(row[good] * self.tables + table)
                columns.append(column[good])
            slot, column = np.concatenate(slots), np.concatenate(columns)
        if not len(slot):
            return
        score = np.round(raw[slot // self.tables, column], _DIGITS) + 0.0
        slot, at, score = np.r_[self.slot, slot], np.r_[self.at, ids[column]], np.r_[self.score, score]
        order = np.lexsort((at, -score, slot))
        slot, at, score = slot[order], at[order], score[order]
        place = np.arange(len(slot)) - np.searchsorted(slot, slot)
        first = place < self.k
        self.slot, self.at, self.score = slot[first], at[first], score[first]
        worst = place == self.k - 1
        least = np.where(np.isnan(score[worst]), -np.inf, score[worst])
        # Scores are compared before they are rounded; equal ones must come through.
        slack = np.where(np.isfinite(least), 1e-11 * (1 + np.abs(least)), 0.0)
        self.bound.reshape(-1)[slot[worst]] = least - slack

    def hits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score): k per query; what several tables found counts once."""
        row, at, score = self.slot // self.tables, self.at, self.score
        if self.tables > 1:
            order = np.lexsort((at, -score, row))
            row, at, score = row[order], at[order], score[order]
            same = (row[1:] == row[:-1]) & (at[1:] == at[:-1]) & (score[1:] == score[:-1])
            new = np.r_[True, ~same] if len(row) else np.empty(0, bool)
            row, at, score = row[new], at[new], score[new]
            first = np.arange(len(row)) - np.searchsorted(row, row) < self.k
            row, at, score = row[first], at[first], score[first]
        return row, at, score


def _numbers(column: pa.Array) -> np.ndarray:
    """The rows of a column of equally long arrays as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _met(keys: list[str], k: int, metric: str, block_queries: int, block_chunks: int):
    """Hits of a partition that is sorted by cell, the queries of a cell before its chunks."""
    # Chunks without an id come first among equals, as Spark sorts them.
    none = np.iinfo(np.int64).min
    most = max(1, min(block_chunks, TILE))

    def unit(v: np.ndarray) -> np.ndarray:
        return v / np.linalg.norm(v, axis=1, keepdims=True) if metric == "cosine" else v

    def found(blocks: list[_Best], names: list[pa.Array]):
        if blocks:
            every = pa.concat_arrays(names)
            for n, block in enumerate(blocks):
                row, at, score = block.hits()
                hits = [every.take(pa.array(row + n * block_queries)), pa.array(at, mask=at == none), pa.array(score)]
                yield pa.RecordBatch.from_arrays(hits, ["query_id", "id", "similarity"])

    def run(batches):
        last, names, asked, blocks, seen = None, [], [], [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            changes = [pc.not_equal(batch.column(c).slice(1), batch.column(c).slice(0, batch.num_rows - 1)) for c in [*keys, "side"]]
            edge = np.zeros(batch.num_rows - 1, bool)
            for change in changes:
                edge |= change.to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(edge) + 1).tolist(), batch.num_rows]
            for start, end in zip(edges[:-1], edges[1:], strict=True):
                part = batch.slice(start, end - start)
                cell = tuple(part.column(c)[0].as_py() for c in keys)
                if cell != last:
                    yield from found(blocks, names)
                    last, names, asked, blocks, seen = cell, [], [], [], 0
                vectors = unit(_numbers(part.column("v")))
                buckets = _numbers(part.column("buckets")) if "buckets" in part.schema.names else None
                if part.column("side")[0].as_py() == 0:
                    names.append(part.column("query_id"))
                    asked.append((vectors, buckets))
                    continue
                if not names:
                    continue
                if not blocks:
                    queries = np.vstack([v for v, _ in asked])
                    own = None if buckets is None else np.vstack([b for _, b in asked])
                    cuts = range(0, len(queries), block_queries)
                    blocks = [_Best(queries[i : i + block_queries], None if own is None else own[i : i + block_queries], k) for i in cuts]
                    asked = []
                ids = pc.fill_null(part.column("chunk_id"), none).to_numpy()
                at = 0
                while at < len(ids):
                    # Small tiles first: once k chunks are known, few others come through.
                    tile = slice(at, at + min(most, max(16, 3 * seen)))
                    for block in blocks:
                        block.add(ids[tile], vectors[tile], None if buckets is None else buckets[tile])
                    seen += len(ids[tile])
                    at = tile.stop
        yield from found(blocks, names)

    return run


def _prepared(df: DataFrame, id_column: str, vector: str, metric: str, dimension: int) -> DataFrame:
    rows = df.select(F.col(id_column).alias("_id"), "tenant_id", C.as_doubles(vector).alias("_v"))
    if metric == "cosine":
        return rows.where(C.vector_problem("_v", dimension).isNull())
    # dot product: a missing vector counts as zeros
    zeros = F.array_repeat(F.lit(0.0), dimension)
    fitted = F.slice(F.concat(F.coalesce("_v", zeros), zeros), 1, dimension)
    return rows.withColumn("_v", F.transform(fitted, lambda x: F.coalesce(x, F.lit(0.0))))


def top_k(
    chunks: DataFrame,
    queries: DataFrame,
    k: int,
    *,
    dimension: int,
    metric: str = "cosine",
    vector: str = "embedding",
    block_queries: int = BLOCK_QUERIES,
    block_chunks: int = BLOCK_CHUNKS,
) -> DataFrame:
    """Exact top k: (query_id, id, similarity, rank), each query within its own tenant.

    Blocks of queries meet blocks of chunks of the same tenant, at most ``block_queries`` and
    ``block_chunks`` at a time; only the k best per query go on, so pairs are never emitted.
    """
    if metric not in ("cosine", "dot"):
        raise ValueError("metric must be 'cosine' or 'dot'")
    k = max(1, int(k))
    held = _prepared(chunks, "id", vector, metric, dimension)
    asked = _prepared(queries.withColumn("query_id", F.col("query_id").cast("string")), "query_id", vector, metric, dimension)
    return _ranked(_blocked(held, asked, ["tenant_id"], k, metric, block_queries, block_chunks), k)


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = [F.col("similarity").desc(), F.col("id")]
    return C.top_n_per_group(hits, ["query_id"], order, k, salt_by=["id"], salts=8)


def _blocked(held: DataFrame, asked: DataFrame, group: list[str], k: int, metric: str, block_queries: int, block_chunks: int) -> DataFrame:
    """The k best of each query among the chunks that have the same values in ``group``.

    A task holds a bounded part of a group's queries and lets one of a few streams of its chunks pass, so a query is
    sent as often as there are streams, and a chunk once for each part. Rows may have ``_buckets``: see ``_Best``.
    """
    # Counts per group size the parts, so a group with most of the rows is spread out.
    part = lambda df, rows, name: df.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / rows).alias(name))
    sizes = part(held, TILE, "streams").withColumn("streams", F.least("streams", F.lit(STREAMS).cast("bigint"))).join(
        part(asked, HELD_QUERIES, "parts"), group
    )
    zero = F.lit(0).cast("bigint")
    more = [F.col("_buckets").alias("buckets")] if "_buckets" in held.columns else []
    left = (
        asked.select(F.lit(0).alias("side"), F.col("_id").alias("query_id"), F.lit(None).cast("bigint").alias("chunk_id"), F.col("_v").alias("v"), *more, *group)
        .join(sizes, group)
        .withColumn("qb", F.pmod(F.xxhash64("query_id"), "parts"))
        .withColumn("cb", F.explode(F.sequence(zero, F.col("streams") - 1)))
    )
    right = (
        held.select(F.lit(1).alias("side"), F.lit(None).cast("string").alias("query_id"), F.col("_id").cast("bigint").alias("chunk_id"), F.col("_v").alias("v"), *more, *group)
        .join(sizes, group)
        .withColumn("cb", F.pmod(F.xxhash64("chunk_id"), "streams"))
        .withColumn("qb", F.explode(F.sequence(zero, F.col("parts") - 1)))
    )
    keys = [*group, "qb", "cb"]
    # Cells are heavy for their size, so they are dealt out to more tasks than there are cores.
    spark = held.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
    rows = left.unionByName(right).drop("streams", "parts").repartition(tasks, *keys).sortWithinPartitions(*keys, "side")
    return rows.mapInArrow(_met(keys, k, metric, max(1, int(block_queries)), max(1, int(block_chunks))), _HITS)


def approximate_top_k(
    chunks: DataFrame,
    queries: DataFrame,
    k: int,
    *,
    dimension: int,
    vector: str = "embedding",
    tables: int = 12,
    bucket_length: float = 0.7,
    seed: int = 42,
    block_queries: int = BLOCK_QUERIES,
    block_chunks: int = BLOCK_CHUNKS,
) -> DataFrame:
    """Top k among the chunks that share a random-projection bucket with the query.

    Vectors are brought to unit length and hashed in the JVM. Queries meet only the chunks of
    their tenant's buckets, by (tenant, table, bucket) in blocks, so a hot bucket is spread out; if
    the buckets of all tables hold more pairs than the tenants, tenants are searched and buckets
    compared pair by pair. Scores are exact cosines.
    """
    unit = lambda df: df.withColumn("_u", array_to_vector(F.transform("_v", lambda x: x / C.norm("_v"))))
    held = unit(_prepared(chunks, "id", vector, "cosine", dimension))
    asked = unit(_prepared(queries.withColumn("query_id", F.col("query_id").cast("string")), "query_id", vector, "cosine", dimension))
    model = BucketedRandomProjectionLSH(
        inputCol="_u", outputCol="_hashes", numHashTables=tables, bucketLength=bucket_length, seed=seed
    ).fit(held.limit(1))  # fitting only reads the dimension
    numbers = F.transform("_hashes", vector_to_long)
    hashed = lambda df: model.transform(df).select("_id", "tenant_id", "_v", numbers.alias("_buckets"))
    # Not from the column of hashes: Spark would filter by it before it has left out vectors that cannot be hashed.
    bucketed = lambda df: model.transform(df).select("_id", "tenant_id", "_v", F.posexplode(numbers).alias("_table", "_bucket"))
    group = ["tenant_id", "_table", "_bucket"]
    if _meetings(bucketed(held), bucketed(asked), group) < _meetings(held, asked, ["tenant_id"]):
        hits = _blocked(bucketed(held), bucketed(asked), group, max(1, int(k)), "cosine", block_queries, block_chunks)
    else:
        # Buckets this wide hold the same pairs in many tables: every pair is scored once, and counts in the tables it shares a bucket in.
        hits = _blocked(hashed(held), hashed(asked), ["tenant_id"], max(1, int(k)), "cosine", block_queries, block_chunks)
    return _ranked(hits.distinct(), k)


def _meetings(held: DataFrame, asked: DataFrame, group: list[str]) -> float:
    """How many pairs have the same values in ``group``."""
    count = lambda df, name: df.groupBy(*group).agg(F.count(F.lit(1)).cast("double").alias(name))
    both = count(held, "chunks").join(count(asked, "queries"), group)
    return both.agg(F.coalesce(F.sum(F.col("chunks") * F.col("queries")), F.lit(0.0))).first()[0]


def vector_to_long(h: Column) -> Column:
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(h)[0].cast("bigint")


def normalise_hits(hits: DataFrame) -> DataFrame:
    """Fill what a stored hit may lack: source, section, numbers and metadata."""
    names = hits.columns
    has = lambda c: F.nullif(F.col(c), F.lit("")) if c in names else F.lit(None).cast("string")
    section = F.coalesce(has("section"), F.col("metadata")["section"] if "metadata" in names else F.lit(None), F.lit("Document"))
    return hits.withColumns(
        {
            "source": F.coalesce(has("source_id"), has("source_name"), has("source"), F.lit("unknown")),
            "section": section,
            "similarity": F.coalesce("similarity", F.lit(0.0)),
        }
    )


def metadata_map(c) -> Column:
    """JSON text to a string map; anything that is no JSON object gives an empty map."""
    return F.coalesce(F.from_json(C.as_col(c), "map<string,string>"), F.create_map().cast("map<string,string>"))


def format_entry() -> Column:
    chunk = F.coalesce(F.col("id").cast("string"), F.col("chunk_index").cast("string"), F.lit("unknown"))
    return F.concat(
        F.lit("src="), F.col("source"), F.lit("; sec="), F.col("section"), F.lit("; chunk="), chunk, F.lit("; text="), F.trim("content")
    )


def build_context(hits: DataFrame, *, max_chars: int = 4000, max_chunks: int = 5) -> DataFrame:
    """The entries that go into each query's context, in order.

    ``hits`` are normalised hits with ``query_id`` and ``rank``. Equal entries are kept
    once, then the best ``max_chunks`` are taken while they fit ``max_chars``; an entry that
    does not fit is still taken while less than nine tenths are used, else the rest is cut.
    """
    marker = ["query_id", "source", "section", F.trim("content"), F.coalesce(F.col("id").cast("string"), F.col("chunk_index").cast("string")), "tenant_id"]
    once = hits.withColumn("_n", F.row_number().over(Window.partitionBy(*marker).orderBy("rank"))).where(F.col("_n") == 1)
    by_query = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "rank")
    ordered = once.withColumn("position", F.row_number().over(by_query)).where(F.col("position") <= max_chunks)
    ordered = ordered.withColumn("entry", format_entry())
    upto = Window.partitionBy("query_id").orderBy("position")
    size = F.length("entry")
    used = F.coalesce(F.sum(size).over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fits = (F.col("position") == 1) | (used + size <= max_chars) | (used < max_chars * 0.9)
    sized = ordered.withColumn("_fits", fits)
    kept = F.min(F.col("_fits").cast("int")).over(upto.rowsBetween(Window.unboundedPreceding, 0))
    return sized.withColumn("_kept", kept).where(F.col("_kept") == 1).drop("_n", "_fits", "_kept")


def prompts(questions: DataFrame, context: DataFrame, *, product: str = "gateway") -> DataFrame:
    """Prompt, evidence and ``grounded`` per question; a fixed answer where nothing was found."""
    entries = context.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("position", "entry", "source", "section", "id"))).alias("e")
    )
    lacking = f"I don't have sufficient {product} evidence to answer that."
    # The wording of the prompt.
    head = (
        f"You are a {product} assistant. Use only the provided {product} evidence.\n"
        f"- Do not invent {product} configuration or operational claims.\n"
        "- Distinguish evidence from interpretation.\n"
        "- State when evidence is insufficient.\n"
        "- Preserve tenant boundaries and never reveal secrets.\n"
        f"- If the evidence is insufficient, answer with: '{lacking}'\n\n"
        "Tenant: "
    )
    evidence = F.array_join(F.transform("e", lambda x: x["entry"]), "\n\n")
    prompt = F.concat(
        F.lit(head), F.col("tenant_id"), F.lit("\n\nQuestion: "), F.col("question"), F.lit("\n\nEvidence:\n"), evidence,
        F.lit("\n\nReturn a concise grounded answer in plain text."),
    )
    found = F.col("e").isNotNull()
    return questions.join(entries, questions["question_id"] == entries["query_id"], "left").select(
        "question_id",
        "tenant_id",
        F.when(found, prompt).alias("prompt"),
        F.when(~found, lacking).alias("answer"),
        F.coalesce(
            F.transform("e", lambda x: F.struct(x["source"].alias("source"), x["section"].alias("section"), x["id"].alias("chunk_id"))),
            F.array().cast("array<struct<source:string,section:string,chunk_id:bigint>>"),
        ).alias("sources"),
        found.alias("grounded"),
    )


def evaluate_retrieval(examples: DataFrame, ranked: DataFrame, *, ks=(1, 3, 5)) -> DataFrame:
    """One row of hit@1/3/5 and recall@k over all examples, those without results included.

    ``examples``: query_id, expected (array of sources); ``ranked``: query_id, rank, source.
    Recall is counted per query as found or not; ``*_at_2`` repeats ``*_at_3``.
    """
    pairs = examples.select("query_id", F.explode("expected").alias("source")).distinct()
    first = ranked.join(pairs, ["query_id", "source"]).groupBy("query_id").agg(F.min("rank").alias("first"))
    rows = examples.select("query_id").join(first, "query_id", "left")
    share = lambda k: F.coalesce(F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0)), F.lit(0.0))
    report = [share(k).alias(f"hit_at_{k}") for k in (1, 3, 5)] + [share(k).alias(f"recall_at_{k}") for k in ks]
    report += [share(3).alias("hit_at_2"), (share(3) if 3 in ks else F.lit(0.0)).alias("recall_at_2")]
    return rows.agg(F.count(F.lit(1)).alias("queries"), *report)
