"""Collocations by Toivonen's method: a sample proposes phrases, full passes count them exactly.

A phrase is a run of 2 to ``longest`` words inside a piece of text; it is frequent with at least
``min_count`` occurrences in its language. No frequent phrase has an infrequent part, so:

1. In a sample of the rows (chosen by hash) all phrases over a lowered threshold are found.
2. One pass over all rows counts exactly what the sample proposes and its negative border: the
   words, and the longer phrases whose two parts of one word less are both proposed.
3. Frequent border phrases were missed by the sample. They are proposed too, and an expansion pass counts
   every phrase that holds a new one and whose words, or pairs of neighbouring words, are all proposed. It
   is repeated while it finds new pairs; longer phrases it finds are already expanded, so two expansions close.

Whether a phrase is proposed is asked in a bit table of fixed size, which goes to every task.
It can say yes too often, never no: a phrase is then counted for nothing, and a full table only
makes the passes shuffle more. Counts are added up by the phrases themselves, inside the slice,
inside the task, then by shuffle, so a very common word arrives as one number per task.

Defined cases: a null text is empty, a null language is ``und``; repeated rows count each time; ids
play no part but for the sample; words are never cut; an empty table gives an empty table; other
columns neither matter nor clash. Ties in score are settled by count, then by phrase.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.functions.columns import top_n_per_group
from callscope.llm.common import raw, ready, slices, stored
from callscope.llm.windows import mixed

LONGEST = 5
MIN_COUNT = 100
TOP = 2000
#: One row of so many is in the sample; a phrase is proposed at this share of its expected count there.
SAMPLE = 8
SLACK = 0.7
#: Bits of the table of proposed phrases (8 MB); it holds some ten million phrases well.
TABLE_BITS = 1 << 26
SLICE = 8 << 20
#: A phrase on its way through a shuffle: language, tab, words (no word holds a tab); no words stand for all words.
COUNTS = "key string, f long"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORD = ~_BREAK
_WORD[[0x20, 0x09]] = False


def _hash(word: bytes, seed: int = 0) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(word, seed)


class Proposed:
    """The bit table of proposed phrases, by two parts of their hash."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for at in places(hashes, len(self.bits) * 64):
            found &= (self.bits[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
        return found


def places(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    """The two bits of each hash in a table of ``bits`` (a power of two)."""
    return [(part & np.uint64(bits - 1)).astype(np.int64) for part in (hashes, hashes >> np.uint64(33))]


def phrase_hashes(langs: pa.Array, phrases: pa.Array) -> np.ndarray:
    """The hashes by which the passes know these phrases."""
    made = np.zeros(len(phrases), np.uint64)
    for i, (lang, phrase) in enumerate(zip(langs.to_pylist(), phrases.to_pylist(), strict=True)):
        seed, total = _hash(lang.encode()), None
        for word in phrase.encode().split(b" "):
            one = np.array([_hash(word, seed)], np.uint64)
            total = one if total is None else mixed(total, one)
        made[i] = total[0]
    return made


def split_words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of a slice of texts, and the number of the piece each lies in."""
    new_row = np.zeros(len(data) + 1, bool)
    new_row[offsets[:-1]] = True
    new_row = new_row[:-1]
    data = _LOWER[data]
    word = _WORD[data]
    goes_on = np.r_[False, word[:-1]] & word & ~new_row
    starts = np.flatnonzero(word & ~goes_on)
    lengths = np.flatnonzero(word & ~np.r_[goes_on[1:], False]) + 1 - starts
    piece = np.cumsum(_BREAK[data] | new_row, dtype=np.int64)[starts]
    ends = np.r_[0, np.cumsum(lengths)].astype(np.int64)
    buffers = [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data[word]))]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), buffers), piece


def distinct(columns: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The first place and the number of each distinct row of numbers below ``size``; nothing is hashed."""
    packed, room = columns[0], size
    for column in columns[1:]:
        if room > (1 << 62) // size:
            kinds, packed = np.unique(packed, return_inverse=True)
            room = len(kinds)
        packed = packed * size + column
        room *= size
    _, first, count = np.unique(packed, return_index=True, return_counts=True)
    return first, count


def counted(texts: pa.Array, lang: str, longest: int, levels: range, asked) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """(k, phrases, counts) of a slice in one language, for the levels k at which ``asked(k, parts)`` says so.

    ``asked`` is given the hashes of all phrases of k - 1 words, and says which windows of k words to count.
    """
    words, piece = split_words(*raw(texts))
    if not len(words):
        return
    coded = words.dictionary_encode()
    ids = coded.indices.to_numpy().astype(np.int64)
    seed = _hash(lang.encode())
    one = np.array([_hash(w, seed) for w in coded.dictionary.to_pylist()], np.uint64)[ids]
    hashes = one
    for k in range(1, longest + 1):
        n = len(ids) - k + 1
        if n <= 0:
            return
        if k > 1:
            shorter, hashes = hashes, mixed(hashes[:n], one[k - 1 :])
        if k not in levels:
            continue
        wanted = piece[:n] == piece[k - 1 :]
        if k > 1:
            wanted &= asked(k, shorter)
        at = np.flatnonzero(wanted)
        if not len(at):
            continue
        first, count = distinct([ids[at + j] for j in range(k)], len(coded.dictionary))
        parts = [coded.dictionary.take(pa.array(ids[at[first] + j])).cast(pa.string()) for j in range(k)]
        yield k, pc.binary_join_element_wise(*parts, " ") if k > 1 else parts[0], count


def _gathered(batches, limit: int):
    """Batches put together up to ``limit`` bytes of text, so that more is added up before it leaves the task."""
    held, size = [], 0
    for batch in slices(batches, "text", limit):
        n = pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0
        if held and size + n > limit:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        if batch.num_rows:
            held.append(batch)
            size += n
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _pass(longest: int, levels: range, rule):
    """Counts of a partition's rows (lang, text), as rows of ``COUNTS``."""

    def run(batches):
        asked = rule()
        for batch in _gathered(batches, SLICE):
            for lang in pc.unique(batch.column("lang")).to_pylist():
                texts = batch.filter(pc.equal(batch.column("lang"), lang)).column("text")
                for k, phrases, count in counted(texts, lang, longest, levels, asked):
                    keys = pc.binary_join_element_wise(pa.scalar(lang), phrases, "\t")
                    yield pa.RecordBatch.from_arrays([keys, pa.array(count, pa.int64())], ["key", "f"])
                    if k == 1:
                        yield pa.RecordBatch.from_arrays([pa.array([lang + "\t"]), pa.array([count.sum()], pa.int64())], ["key", "f"])

    return run


def _every():
    return lambda k, parts: np.ones(len(parts) - 1, bool)


def _chained(pairs: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which windows of ``k`` words have all their pairs among the proposed ones."""
    found = np.ones(n, bool)
    for j in range(k - 1):
        found &= pairs[j : j + n]
    return found


def _sampled(pairs):
    """For the sample: windows of three words and more, all of whose pairs are proposed."""

    def rule():
        table, known = Proposed(pairs.value), {}

        def asked(k, parts):
            # Called for k = 3, 4, 5 in turn; at k = 3 the parts are the pairs.
            if k == 3:
                known["pairs"] = table(parts)
            return _chained(known["pairs"], k, len(parts) - 1)

        return asked

    return rule


def _bordered(proposed):
    """For the full pass: windows whose two parts are proposed."""

    def rule():
        table = Proposed(proposed.value)

        def asked(k, parts):
            found = table(parts)
            return found[:-1] & found[1:]

        return asked

    return rule


def _expanded(proposed, new):
    """For an expansion: windows that hold a new phrase, and whose words (k = 2) or pairs are all proposed."""

    def rule():
        table, fresh, known = Proposed(proposed.value), Proposed(new.value), {}

        def asked(k, parts):
            holds = fresh(parts)
            if k > 2:
                holds |= known["holds"][:-1] | known["holds"][1:]
            known["holds"] = holds
            if k == 2:
                words = table(parts)
                return (holds[:-1] | holds[1:]) & words[:-1] & words[1:]
            if k == 3:
                known["pairs"] = table(parts)
            return (holds[:-1] | holds[1:]) & _chained(known["pairs"], k, len(parts) - 1)

        return asked

    return rule


def _bits(phrases: DataFrame, size: int) -> np.ndarray:
    """The bit table of some phrases (lang, phrase), put together by Spark; at most size / 64 rows arrive here."""

    def run(batches):
        for batch in batches:
            at = np.concatenate(places(phrase_hashes(batch.column("lang"), batch.column("phrase")), size))
            bit = (np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(bit)], ["at", "bits"])

    rows = phrases.select("lang", "phrase").mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits"))
    made = rows.toArrow()
    table = np.zeros(size // 64, np.uint64)
    table[made.column("at").to_numpy()] = made.column("bits").to_numpy().view(np.uint64)
    return table


def _missing(now):
    """The rows of a batch of phrases that the bit table does not hold."""

    def run(batches):
        table = Proposed(now.value)
        for batch in batches:
            yield batch.filter(pa.array(~table(phrase_hashes(batch.column("lang"), batch.column("phrase")))))

    return run


def _summed(rows: DataFrame, least: int) -> DataFrame:
    """(lang, k, phrase, f) of what is counted ``least`` times; k = 0 for all words of a language."""
    some = rows.groupBy("key").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | F.col("key").endswith("\t"))
    phrase = F.substring_index("key", "\t", -1)
    named = some.withColumn("phrase", phrase)
    lang = F.expr("substring(key, 1, length(key) - length(phrase) - 1)").alias("lang")
    k = F.expr("if(phrase = '', 0, length(phrase) - length(replace(phrase, ' ', '')) + 1)").alias("k")
    return named.select(lang, k, "phrase", "f")


def frequent(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    key: str = "doc_id",
    min_count: int = MIN_COUNT,
    longest: int = LONGEST,
    sample: int = SAMPLE,
    slack: float = SLACK,
    table_bits: int = TABLE_BITS,
) -> DataFrame:
    """(lang, k, phrase, f): all words and phrases of up to ``longest`` words with f >= ``min_count``.

    The rows with k = 0 hold the number of all words of a language.
    """
    spark = docs.sparkSession
    ready(spark)
    rows = docs.select(
        F.coalesce(lang, F.lit("und")).alias("lang"), F.coalesce(text, F.lit("")).alias("text"), F.xxhash64(key, text).alias("row")
    )
    chosen = stored(rows.where(F.pmod("row", F.lit(sample)) == 0).select("lang", "text"), "sample")
    rows = rows.select("lang", "text")
    least = max(2, int(min_count / sample * slack))
    short = stored(_summed(chosen.mapInArrow(_pass(2, range(1, 3), _every), COUNTS), least).where("k > 0"), "proposed")
    share = spark.sparkContext.broadcast
    pairs = share(_bits(short.where("k = 2"), table_bits))
    long_ = _summed(chosen.mapInArrow(_pass(longest, range(3, longest + 1), _sampled(pairs)), COUNTS), least)
    bits = _bits(short.union(long_).where((F.col("k") > 0) & (F.col("k") < longest)), table_bits)
    proposed = share(bits)
    rule, levels, found = _bordered(proposed), range(1, longest + 1), None
    while True:
        passed = stored(_summed(rows.mapInArrow(_pass(longest, levels, rule), COUNTS), min_count), "counted")
        open_ = passed.where(F.col("k").between(1, longest - 1 if found is None else 2))
        # A phrase may be counted by two passes; both counts are of all its places.
        found = passed if found is None else found.union(passed).dropDuplicates(["lang", "k", "phrase"])
        border = stored(open_.mapInArrow(_missing(proposed), open_.schema), "border")
        if border.isEmpty():
            return found
        new = _bits(border, table_bits)
        bits = bits | new
        proposed = share(bits)
        rule, levels = _expanded(proposed, share(new)), range(2, longest + 1)


def collocations(docs: DataFrame, top: int | None = TOP, **settings) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the phrases that hold together best, per language.

    The score is a * n * 1000 / (l * r), rounded down, at the weakest cut of the phrase into two parts with
    counts l and r. Phrases that never occur outside a longer frequent one are left out.
    Without ``top`` all phrases are returned, unranked.
    """
    found = frequent(docs, **settings)
    words = found.where("k = 0").select("lang", F.col("f").alias("n"))
    parts = found.where("k > 0").select("lang", F.col("phrase").alias("part"), F.col("f"))
    phrases = found.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"))
    halves = F.array(F.expr("substring_index(phrase, ' ', k - 1)"), F.expr("substring_index(phrase, ' ', 1 - k)"))
    inside = phrases.where("k > 2").select("lang", F.explode(halves).alias("phrase"), "a").distinct()
    open_ = phrases.join(inside, ["lang", "phrase", "a"], "left_anti")
    cuts = open_.join(words, "lang").withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.withColumns(
        {"left": F.expr("substring_index(phrase, ' ', cut)"), "right": F.expr("substring_index(phrase, ' ', cut - k)")}
    )
    cuts = cuts.join(parts.select("lang", F.col("part").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(parts.select("lang", F.col("part").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    # Up to 38 digits: 1000 * a * n stays exact far beyond 64 bits.
    score = F.expr("(1000 * cast(a as decimal(16,0)) * cast(n as decimal(16,0))) div (cast(l as decimal(16,0)) * cast(r as decimal(16,0)))")
    weakest = F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("w")
    scored = cuts.groupBy("lang", "phrase", "a", "n").agg(weakest).select("lang", "phrase", "a", "w.l", "w.r", "n", "w.score")
    if top is None:
        return scored
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    ranked = top_n_per_group(scored, ["lang"], order, top, salt_by=["phrase"])
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
