"""Language identification, words first, then shorter and shorter character n-grams.

A word that the model knows is scored by its log frequency in each language. An unseen word
is scored by the mean log frequency of its character n-grams of the longest length of
which any is known. A text's language is the one with the greatest sum over its words.

The model is fitted on at most about ``SAMPLE`` documents of each language, drawn by a hash of
the row, and keeps ``WORDS`` words and ``GRAMS`` n-grams of each length per language, so its size
follows the number of languages and not the table. Everything else covers all rows and
whole texts.

Defined cases: ``und`` with score 0 for null texts, texts without a letter, and where nothing
could be learned; ties go to the language that comes first in the alphabet; rows with
equal ids are judged one by one; an empty table gives an empty one; other columns are
left out.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callscope.llm.common import ready, slices

SAMPLE = 4000
WORDS = 20_000
GRAMS = 5_000
ORDERS = (4, 3, 2, 1)
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")


def _most_frequent(counts: DataFrame, limit: int, *group: str) -> DataFrame:
    by = Window.partitionBy(*group).orderBy(F.desc("n"), "item")
    ranked = counts.withColumn("place", F.row_number().over(by)).where(F.col("place") <= limit)
    return ranked.select("lang", "order", "item", "n")


def fit(labelled: DataFrame, sample: int = SAMPLE, words: int = WORDS, grams: int = GRAMS) -> Model:
    """A model of the languages in (text, lang, row_hash); rows without either are left out."""
    rows = labelled.where("text is not null and lang is not null")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()
    if not sizes:
        return Model([], {}, {})
    share = F.coalesce(*[F.when(F.col("lang") == r["lang"], F.lit(min(1.0, sample / r["n"]))) for r in sizes])
    drawn = rows.where(F.pmod("row_hash", F.lit(1 << 20)) < share * (1 << 20))
    split = F.split(F.lower("text"), r"[^\p{L}]+")
    word = drawn.select("lang", F.explode(split).alias("item")).where("item <> ''")
    counts = word.groupBy("lang", "item").agg(F.count("*").alias("n"))
    padded = F.concat(F.lit("^"), F.col("item"), F.lit("$"))
    pieces = [
        F.transform(
            F.sequence(F.lit(1), F.length(padded) - (order - 1)),
            lambda at, order=order: F.struct(F.lit(order).alias("order"), F.substring(padded, at, F.lit(order)).alias("item")),
        )
        for order in ORDERS
    ]
    gram = counts.select("lang", "n", F.explode(F.concat(*pieces)).alias("g")).select("lang", "g.*", "n")
    gram = gram.groupBy("lang", "order", "item").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    kept = _most_frequent(counts.withColumn("order", F.lit(0)).where("n > 1"), words, "lang").union(
        _most_frequent(gram, grams, "lang", "order")
    )
    table = kept.union(totals.select("lang", F.lit(-1).alias("order"), F.lit("").alias("item"), "n"))
    return Model.of(sorted(r["lang"] for r in sizes), table.collect())


class Model:
    """Log frequencies by item, one number per language."""

    def __init__(self, langs: list[str], words: dict, grams: dict):
        self.langs, self.words, self.grams = langs, words, grams

    @classmethod
    def of(cls, langs: list[str], rows: list) -> Model:
        place = {lang: i for i, lang in enumerate(langs)}
        total = np.ones(len(langs))
        raw: dict[int, dict[str, np.ndarray]] = {}
        for row in rows:
            if row["order"] < 0:
                total[place[row["lang"]]] = row["n"]
            else:
                found = raw.setdefault(row["order"], {}).setdefault(row["item"], np.zeros(len(langs)))
                found[place[row["lang"]]] = row["n"]
        # Half a count where a language lacks an item that another has.
        logs = {
            order: {item: np.log((n + 0.5) / (total + 1)).astype(np.float32) for item, n in items.items()}
            for order, items in raw.items()
        }
        return cls(langs, logs.pop(0, {}), logs)

    def word(self, word: str) -> np.ndarray | None:
        known = self.words.get(word)
        if known is not None:
            return known
        padded = f"^{word}$"
        for order in ORDERS:
            grams = self.grams.get(order, {})
            found = [g for at in range(len(padded) - order + 1) if (g := grams.get(padded[at : at + order])) is not None]
            if found:
                return np.mean(found, axis=0)
        return None

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        numbers: dict[str, int] = {}
        codes, ends = [], [0]
        for text in texts:
            codes.extend([numbers.setdefault(w, len(numbers)) for w in _WORD.findall((text or "").lower())])
            ends.append(len(codes))
        n = len(self.langs)
        table = np.zeros((len(numbers) + 1, n + 1))
        for word, at in numbers.items():
            if any(map(str.isalpha, word)):
                table[at, n] = 1
                scored = self.word(word)
                if scored is not None:
                    table[at, :n] = scored
        ends = np.array(ends)
        rows = np.repeat(np.arange(len(texts)), np.diff(ends))
        codes = np.array(codes, np.int64)
        sums = np.stack([np.bincount(rows, table[codes, i], len(texts)) for i in range(n + 1)], axis=1)
        langs, scores = [], []
        for total, letters in zip(sums[:, :n], sums[:, n], strict=True):
            if not letters or not n:
                langs.append(UNKNOWN)
                scores.append(0.0)
            else:
                best = int(np.argmax(total))
                langs.append(self.langs[best])
                scores.append(float(1 / np.exp(np.minimum(total - total[best], 0)).sum()))
        return langs, scores


def predicted(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The columns of ``docs`` without the text, and ``lang_pred`` and ``score``."""
    ready(docs.sparkSession)
    others = [c for c in docs.columns if c != text]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != text)

    def run(batches):
        for batch in slices(batches, text):
            langs, scores = model.predict(batch.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in others), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                [*others, "lang_pred", "score"],
            )

    return docs.mapInArrow(run, f"{kinds}, lang_pred string, score double")
