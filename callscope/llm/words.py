"""BPE encoding and decoding by a table of distinct words.

Texts are split at ``[\\x20\\x09-\\x0D]+``, which no piece of a tokenizer that drops white
space can cross, so a text's ids are its words' ids one after another. Words are counted
over all documents; the most frequent ones, at most ``TABLE_WORDS``, make up the table. Each
is encoded once, and decoded by a join of its ids with the vocabulary. The table, whose
size is bounded by that parameter, goes to every task, where each position of a text gets
its word's ids. Rarer words are encoded in the task that meets them, once per slice: a join
of all positions by shuffle would move several times the corpus.

Defined cases: null and empty texts have no ids and decode to the empty string; rows with equal
ids are encoded one by one; an empty table gives an empty one; other columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.llm.common import ready, rows_bytes, slices, stored

TABLE_WORDS = 100_000
SPLIT = r"[\x20\x09-\x0D]+"
#: Counts are grouped by this many steps per doubling to find the least count in the table.
STEPS = 8

_tokenizers: dict = {}
_pieces: dict = {}


def _tokenizer(path: str):
    if path not in _tokenizers:
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        made.no_truncation()
        made.no_padding()
        _tokenizers[path] = made
    return _tokenizers[path]


def _vocabulary(path: str) -> dict[int, str]:
    if path not in _pieces:
        _pieces[path] = {i: piece for piece, i in _tokenizer(path).get_vocab(True).items()}
    return _pieces[path]


def _encode_words(path: str):
    def run(batches):
        for batch in batches:
            found = _tokenizer(path).encode_batch_fast(batch.column("word").to_pylist(), add_special_tokens=False)
            ids = pa.array([e.ids for e in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("word"), ids], ["word", "ids"])

    return run


def word_table(docs: DataFrame, path: str, text: str = "text", limit: int = TABLE_WORDS) -> DataFrame:
    """(word, ids, decoded) of the most frequent words, at most ``limit``."""
    spark = docs.sparkSession
    word = F.explode(F.split(F.coalesce(F.col(text), F.lit("")), SPLIT)).alias("word")
    step = F.floor(F.log2("n") * STEPS).cast("int")
    counts = stored(docs.select(word).where("word <> ''").groupBy("word").agg(F.count("*").alias("n")), "words")
    # At most STEPS rows for each bit of a count.
    sizes = counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect()
    least, total = None, 0
    for row in sorted(sizes, reverse=True):
        total += row["words"]
        if total > limit:
            break
        least = row["step"]
    frequent = counts.where(step >= least) if least is not None else counts.limit(0)
    encoded = frequent.select("word").mapInArrow(_encode_words(path), "word string, ids array<int>")
    vocabulary = spark.createDataFrame(list(_vocabulary(path).items()), "id int, piece string")
    placed = encoded.select("word", "ids", F.posexplode("ids").alias("at", "id")).join(vocabulary, "id")
    listed = placed.groupBy("word").agg(F.first("ids").alias("ids"), F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("p"))
    return listed.select("word", "ids", F.array_join(F.transform("p", lambda x: x["piece"]), " ").alias("decoded"))


def encoded(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = TABLE_WORDS) -> DataFrame:
    """One row per document: id, ids (unsigned 32-bit little-endian) and the text that they decode to."""
    spark = docs.sparkSession
    ready(spark)
    table = {
        row["word"].encode(): (np.array(row["ids"], "<u4").tobytes(), row["decoded"].encode())
        for row in word_table(docs, path, text, limit).toLocalIterator()
    }
    shared = spark.sparkContext.broadcast(table)

    def run(batches):
        tokenizer, named = _tokenizer(path), _vocabulary(path)
        for batch in slices(batches, "text"):
            words = [t.split() for t in rows_bytes(batch.column("text"))]
            table = shared.value
            rare = list({w for row in words for w in row if w not in table})
            found = tokenizer.encode_batch_fast([w.decode() for w in rare], add_special_tokens=False)
            ids = {w: np.array(e.ids, "<u4").tobytes() for w, e in zip(rare, found, strict=True)}
            pieces = {w: " ".join([named[i] for i in e.ids]).encode() for w, e in zip(rare, found, strict=True)}
            all_ids, decoded = [], []
            for row in words:
                got = [table.get(w) or (ids[w], pieces[w]) for w in row]
                all_ids.append(b"".join([g[0] for g in got]))
                decoded.append(b" ".join([g[1] for g in got if g[0]]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(all_ids, pa.binary()), pa.array(decoded, pa.binary()).cast(pa.string())],
                ["doc_id", "ids", "decoded"],
            )

    kind = docs.schema[key].dataType.simpleString()
    slim = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return slim.mapInArrow(run, f"doc_id {kind}, ids binary, decoded string")
