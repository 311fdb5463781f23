"""Document ingest: checks, cleaning, chunking, chunk rows and embeddings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.functions import chunking
from callscope.functions.columns import as_col, vector_problem
from callscope.operators.upsert import replace_sources
from callscope.schemas import require_columns

LINE_BREAK = chunking.LINE_BREAK
EDGE_SPACE = f"^{chunking.SPACE}|{chunking.SPACE}$"

# Fixed value: put in front of a question before a neural model embeds it.
QUERY_INSTRUCTION = "Represent this sentence for searching relevant passages: "


def strip(c) -> Column:
    return F.regexp_replace(as_col(c), EDGE_SPACE, "")


def clean_text(c) -> Column:
    """Lines without outer white space and blank lines, joined by a blank line."""
    lines = F.transform(F.split(as_col(c), LINE_BREAK), strip)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n\n")


def document_problem() -> Column:
    """Why a document may not be ingested, or NULL."""
    source, name = strip("source_id"), strip(F.coalesce(F.nullif("source_name", F.lit("")), F.col("source_id")))
    blank = lambda c: F.coalesce(strip(c), F.lit("")) == ""
    return (
        F.when(blank("tenant_id"), "tenant_id is required")
        .when(blank("source_id"), "source_id is required")
        .when(source.contains("..") | source.contains("\\"), "unsafe source_id")
        .when(F.coalesce(name, F.lit("")) == "", "source_name is required")
        .when(blank("content"), "document content is empty")
    )


def split_documents(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted with trimmed ids, rejected with ``problem``)."""
    require_columns(documents, ("tenant_id", "source_type", "source_id", "source_name", "content"))
    marked = documents.withColumn("problem", document_problem())
    good = marked.where(F.col("problem").isNull()).drop("problem")
    named = F.coalesce(F.nullif("source_name", F.lit("")), F.col("source_id"))
    good = good.withColumns({"source_name": strip(named), "source_id": strip("source_id")})
    return good, marked.where(F.col("problem").isNotNull())


def chunk_documents(
    documents: DataFrame, keys, *, content: str = "content", max_chars: int = chunking.MAX_CHARS, overlap: int = chunking.OVERLAP_CHARS
) -> DataFrame:
    """One row per chunk: ``keys``, chunk_index, section, content. No shuffle."""
    cut = chunking.chunks(F.coalesce(F.col(content), F.lit("")), max_chars, overlap)
    # The outer form: for the plain one the optimizer adds a filter that computes all chunks again.
    placed = documents.select(*keys, F.posexplode_outer(cut).alias("chunk_index", "_chunk")).where("_chunk is not null")
    return placed.select(*keys, "chunk_index", "_chunk.section", "_chunk.content")


def chunk_rows(documents: DataFrame, **sizes) -> DataFrame:
    """Clean and chunk accepted documents into rows of the chunk table (without vectors)."""
    keys = ["tenant_id", "source_type", "source_id", "source_name"]
    cleaned = documents.withColumn("content", clean_text("content"))
    chunks = chunk_documents(cleaned, keys, **sizes)
    return with_hash(chunks).withColumn(
        "metadata", F.create_map(F.lit("section"), F.col("section"), F.lit("source_name"), F.col("source_name"))
    )


def with_hash(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("content_hash", F.sha2("content", 256))


def embed(
    df: DataFrame,
    text: str,
    *,
    dimension: int = 384,
    embedder: Callable[[list[str]], list] | None = None,
    instruction: str = "",
    alias: str = "embedding",
) -> DataFrame:
    """Add a vector per text.

    ``embedder`` is any function from texts to vectors; it runs on Arrow batches inside
    the tasks. Without one, hashed term frequencies of unit length are used, which are
    deterministic and stay in the JVM.
    """
    if embedder is None:
        words = RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"[^\p{L}\p{N}]+").transform(df)
        counted = HashingTF(inputCol="_words", outputCol="_counts", numFeatures=dimension).transform(words)
        unit = Normalizer(inputCol="_counts", outputCol="_unit").transform(counted)
        return unit.withColumn(alias, vector_to_array("_unit", "float32")).drop("_words", "_counts", "_unit")

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(list(embedder(batch.tolist())))

    return df.withColumn(alias, vectors(F.concat(F.lit(instruction), F.col(text))))


def split_vectors(df: DataFrame, *, vector: str = "embedding", dimension: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with a usable vector, rows with ``problem``)."""
    marked = df.withColumn("problem", vector_problem(vector, dimension))
    return marked.where(F.col("problem").isNull()).drop("problem"), marked.where(F.col("problem").isNotNull())


def ingest(documents: DataFrame, stored: DataFrame, *, embedder=None, dimension: int = 384) -> DataFrame:
    """The chunk table after (re-)ingesting documents: their sources are replaced whole."""
    good, _ = split_documents(documents)
    rows = embed(chunk_rows(good), "content", embedder=embedder, dimension=dimension)
    now = F.current_timestamp()
    rows = rows.withColumns({"created_at": now, "updated_at": now, "id": F.xxhash64("tenant_id", "source_type", "source_id", "content_hash", "chunk_index")})
    return replace_sources(stored, rows.select(*stored.columns))
