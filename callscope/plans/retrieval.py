"""Registered queries: vectors, search, contexts, prompts and retrieval quality."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from callscope.functions.columns import vector_problem
from callscope.operators import retrieval as R
from callscope.session import materialise
from callscope.sources import adapters as A

QUERIES, ORACLES = {}, {}

DIM = 64


def _chunks(spark, sf_dir):
    return A.vector_chunks(spark, sf_dir)


def _queries(spark, sf_dir):
    """Every vector asks the other tenant's chunks."""
    return A.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("query_id"),
        F.concat(F.lit("tenant-"), ((F.col("vec_id") + 1) % 2).cast("string")).alias("tenant_id"),
        "embedding",
        "label",
    )


TOPK_SQL = f"""queries AS (SELECT CAST(vec_id AS VARCHAR) AS query_id, 'tenant-' || CAST((vec_id + 1) % 2 AS VARCHAR) AS tenant_id,
  CAST(embedding AS DOUBLE[{DIM}]) AS q, label FROM embeddings),
held AS (SELECT * REPLACE (CAST(embedding AS DOUBLE[{DIM}]) AS embedding) FROM vector_chunks),
hits AS MATERIALIZED (SELECT query_id, id, similarity, CAST(rank AS INTEGER) AS rank FROM (SELECT q.query_id, c.id, round(array_cosine_similarity(q.q, c.embedding), 12) AS similarity,
    row_number() OVER (PARTITION BY q.query_id ORDER BY round(array_cosine_similarity(q.q, c.embedding), 12) DESC, c.id) AS rank
  FROM queries q JOIN held c ON c.tenant_id = q.tenant_id) WHERE rank <= 5)"""
BASE = (A.SQL_CHUNKS, TOPK_SQL)


def _hits(spark, sf_dir, **options):
    return R.top_k(_chunks(spark, sf_dir), _queries(spark, sf_dir), 5, dimension=DIM, **options)


def _shown(hits):
    return hits.withColumn("similarity", F.round("similarity", 6))


def vector_topk(spark, sf_dir):
    return _shown(_hits(spark, sf_dir))


def vector_topk_blocked(spark, sf_dir):
    """The same search cut into many small blocks."""
    return _shown(_hits(spark, sf_dir, block_queries=100, block_chunks=300))


for fn in (vector_topk, vector_topk_blocked):
    QUERIES[fn.__name__] = fn
    ORACLES[fn.__name__] = A.with_ctes(*BASE, "SELECT query_id, id, round(similarity, 6) AS similarity, rank FROM hits")


def _missing(df, id_column):
    return df.withColumn("embedding", F.when(F.col(id_column).cast("bigint") % 13 != 0, F.col("embedding")))


def dot_topk(spark, sf_dir):
    """Dot-product search where every thirteenth vector is missing and counts as zeros."""
    hits = R.top_k(
        _missing(_chunks(spark, sf_dir), "id"), _missing(_queries(spark, sf_dir), "query_id"), 3, dimension=DIM, metric="dot"
    )
    return _shown(hits)


QUERIES["dot_topk"] = dot_topk
ORACLES["dot_topk"] = A.with_ctes(
    A.SQL_CHUNKS,
    f"""scored AS (SELECT CAST(a.vec_id AS VARCHAR) AS query_id, b.vec_id AS id,
  CASE WHEN a.vec_id % 13 = 0 OR b.vec_id % 13 = 0 THEN 0.0
    ELSE round(array_inner_product(CAST(a.embedding AS DOUBLE[{DIM}]), CAST(b.embedding AS DOUBLE[{DIM}])), 12) + 0.0 END AS similarity
  FROM embeddings a JOIN embeddings b ON a.vec_id % 2 <> b.vec_id % 2)
SELECT query_id, id, round(similarity, 6) AS similarity, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM scored) WHERE rank <= 3""",
)


def lsh_topk(spark, sf_dir):
    return _shown(R.approximate_top_k(_chunks(spark, sf_dir), _queries(spark, sf_dir), 5, dimension=DIM))


QUERIES["lsh_topk"] = lsh_topk


def lsh_recall(spark, sf_dir):
    """Approximate against exact search: wrong scores, wrong order, too many hits, recall of 0.9."""
    near, exact = lsh_topk(spark, sf_dir), materialise(vector_topk(spark, sf_dir), "exact-hits")
    both = near.join(exact.select("query_id", "id", F.col("similarity").alias("exact")), ["query_id", "id"], "left")
    order = F.lag("similarity").over(Window.partitionBy("query_id").orderBy("rank"))
    facts = both.withColumn("before", order).agg(
        F.count_if(F.col("similarity") != F.col("exact")).alias("wrong_scores"),
        F.count_if(F.col("similarity") > F.col("before")).alias("wrong_order"),
        F.count_if(F.col("rank") > 5).alias("too_many"),
        F.count("exact").alias("found"),
    )
    wanted = exact.agg(F.count(F.lit(1)).alias("wanted"))
    good = (F.col("found") >= 0.9 * F.col("wanted")).alias("recall_ok")
    return facts.join(wanted, F.lit(True)).select("wanted", "wrong_scores", "wrong_order", "too_many", good)


QUERIES["lsh_recall"] = lsh_recall
ORACLES["lsh_recall"] = A.with_ctes(
    *BASE,
    "SELECT count(*) AS wanted, CAST(0 AS BIGINT) AS wrong_scores, CAST(0 AS BIGINT) AS wrong_order, CAST(0 AS BIGINT) AS too_many, true AS recall_ok FROM hits",
)


def vector_validity(spark, sf_dir):
    """Vectors damaged by a rule on the id, and what is found wrong with them."""
    v, i = F.col("embedding").cast("array<double>"), F.col("id")
    damaged = (
        F.when(i % 7 == 1, F.slice(v, 1, 10))
        .when(i % 7 == 2, F.array_repeat(F.lit(0.0), DIM))
        .when(i % 7 == 3, F.array_append(F.slice(v, 1, DIM - 1), F.lit(float("nan"))))
        .when(i % 7 == 4, F.array().cast("array<double>"))
        .otherwise(v)
    )
    rows = _chunks(spark, sf_dir).withColumn("embedding", damaged)
    return rows.select("id", vector_problem("embedding", DIM).alias("problem"))


QUERIES["vector_validity"] = vector_validity
ORACLES["vector_validity"] = """SELECT vec_id AS id, CASE vec_id % 7 WHEN 1 THEN 'dimension' WHEN 2 THEN 'zero norm' WHEN 3 THEN 'not finite' WHEN 4 THEN 'empty' END AS problem FROM embeddings"""


def _stored(spark, sf_dir):
    """Chunk text with some names left out, as a store may return them."""
    i = F.col("id")
    return _chunks(spark, sf_dir).select(
        "id",
        "tenant_id",
        F.when(i % 5 != 0, F.col("source_id")).alias("source_id"),
        F.when(i % 10 != 0, F.col("source_name")).alias("source_name"),
        F.when(i % 4 != 0, F.col("section")).alias("section"),
        "content",
        "chunk_index",
    )


NAMED_SQL = """named AS (SELECT h.*, c.tenant_id, CASE WHEN c.id % 5 <> 0 THEN c.source_id WHEN c.id % 10 <> 0 THEN c.source_name ELSE 'unknown' END AS source,
    CASE WHEN c.id % 4 <> 0 THEN c.section ELSE 'Document' END AS section, c.content FROM hits h JOIN vector_chunks c ON c.id = h.id)"""

CONTEXT_SQL = """entries AS (SELECT *, 'src=' || source || '; sec=' || section || '; chunk=' || id || '; text=' || trim(content) AS entry,
    row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, rank) AS position FROM named),
used AS (SELECT *, coalesce(sum(length(entry)) OVER (PARTITION BY query_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM entries),
context AS (SELECT *, CAST(min(CASE WHEN position = 1 OR used + length(entry) <= 900 OR used < 900 * 0.9 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY position) AS INTEGER) AS kept FROM used)"""


def _named_hits(spark, sf_dir):
    return R.normalise_hits(_hits(spark, sf_dir).join(_stored(spark, sf_dir), "id"))


def hit_sources(spark, sf_dir):
    return _named_hits(spark, sf_dir).select("query_id", "id", "source", "section")


QUERIES["hit_sources"] = hit_sources
ORACLES["hit_sources"] = A.with_ctes(*BASE, NAMED_SQL, "SELECT query_id, id, source, section FROM named")


def _context(spark, sf_dir):
    # Every hit comes in twice, as from two searches; the second copy must not count.
    hits = _named_hits(spark, sf_dir)
    twice = hits.unionByName(hits.withColumn("rank", F.col("rank") + 100))
    return R.build_context(twice, max_chars=900, max_chunks=5)


def context_budget(spark, sf_dir):
    return _context(spark, sf_dir).select("query_id", "position", "id", "entry")


QUERIES["context_budget"] = context_budget
ORACLES["context_budget"] = A.with_ctes(
    *BASE, NAMED_SQL, CONTEXT_SQL, "SELECT query_id, CAST(position AS INTEGER) AS position, id, entry FROM context WHERE kept = 1"
)


def prompt_table(spark, sf_dir):
    """Prompts for every vector as a question; every ninth question has lost its hits."""
    asked = _queries(spark, sf_dir).select(
        F.col("query_id").alias("question_id"), "tenant_id", F.concat(F.lit("What about topic "), F.col("label").cast("string"), F.lit("?")).alias("question")
    )
    context = _context(spark, sf_dir).where(F.col("query_id").cast("bigint") % 9 != 0)
    out = R.prompts(asked, context)
    sources = F.array_join(F.transform("sources", lambda s: F.concat_ws("/", s["source"], s["section"], s["chunk_id"].cast("string"))), "|")
    return out.withColumn("sources", sources)


QUERIES["prompt_table"] = prompt_table
ORACLES["prompt_table"] = A.with_ctes(
    *BASE,
    NAMED_SQL,
    CONTEXT_SQL,
    r"""packed AS (SELECT query_id, string_agg(entry, chr(10) || chr(10) ORDER BY position) AS evidence,
    string_agg(source || '/' || section || '/' || id, '|' ORDER BY position) AS sources FROM context WHERE kept = 1 AND CAST(query_id AS BIGINT) % 9 <> 0 GROUP BY 1)
SELECT q.query_id AS question_id, q.tenant_id, CASE WHEN evidence IS NOT NULL THEN
  replace('You are a gateway assistant. Use only the provided gateway evidence.@- Do not invent gateway configuration or operational claims.@- Distinguish evidence from interpretation.@- State when evidence is insufficient.@- Preserve tenant boundaries and never reveal secrets.@- If the evidence is insufficient, answer with: ''I don''t have sufficient gateway evidence to answer that.''@@Tenant: '
    || q.tenant_id || '@@Question: What about topic ' || q.label || '?@@Evidence:@' || evidence || '@@Return a concise grounded answer in plain text.', '@', chr(10)) END AS prompt,
  CASE WHEN evidence IS NULL THEN 'I don''t have sufficient gateway evidence to answer that.' END AS answer,
  coalesce(p.sources, '') AS sources, evidence IS NOT NULL AS grounded
FROM queries q LEFT JOIN packed p ON p.query_id = q.query_id""",
)


def retrieval_eval(spark, sf_dir):
    """Hit and recall where a chunk is relevant if it bears the label of the question."""
    asked = _queries(spark, sf_dir)
    examples = asked.select("query_id", F.array(F.concat(F.lit("source-"), F.col("label").cast("string"))).alias("expected"))
    ranked = _hits(spark, sf_dir).join(_chunks(spark, sf_dir).select("id", F.col("source_id").alias("source")), "id")
    out = R.evaluate_retrieval(examples, ranked)
    return out.select("queries", *[F.round(c, 6).alias(c) for c in out.columns if c != "queries"])


QUERIES["retrieval_eval"] = retrieval_eval
ORACLES["retrieval_eval"] = A.with_ctes(
    *BASE,
    """found AS (SELECT q.query_id, min(h.rank) FILTER (WHERE c.label = q.label) AS first FROM queries q
  LEFT JOIN hits h ON h.query_id = q.query_id LEFT JOIN vector_chunks c ON c.id = h.id GROUP BY 1),
shares AS (SELECT count(*) AS queries, round(avg(CASE WHEN first <= 1 THEN 1.0 ELSE 0.0 END), 6) AS a,
  round(avg(CASE WHEN first <= 3 THEN 1.0 ELSE 0.0 END), 6) AS b, round(avg(CASE WHEN first <= 5 THEN 1.0 ELSE 0.0 END), 6) AS c FROM found)
SELECT queries, a AS hit_at_1, b AS hit_at_3, c AS hit_at_5, a AS recall_at_1, b AS recall_at_3, c AS recall_at_5, b AS hit_at_2, b AS recall_at_2 FROM shares""",
)
