"""Quality rules: plain counts per document and repetition found with suffix arrays.

Words are ``[^\\x20\\x09-\\x0D]+``. Every task builds one suffix array over the words of a
slice of documents; words of different documents never compare equal, so it holds the
suffix array of each document. Neighbours' longest common prefixes (LCP) give all
LCP intervals: the longest repeat that starts at a word is the larger LCP of its two
neighbours in suffix order, and the union of these spans is the union of the spans of
all maximal repeated substrings. A document is rejected if the base rules fail, if
repeats of at least ``min_words`` words cover too much of it, or if one is too long.

Defined cases: null and empty texts have no words and fail the base rules; rows with
the same id are judged one by one; an empty table gives an empty table; other columns of
the input neither matter nor clash. Memory follows the longest document, not the table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callscope.llm.common import SPACE, new_name, raw, with_column

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Repeats shorter than this many words are ordinary language.
MIN_REPEAT = 8
MAX_COVERED = 0.5
MAX_LONGEST = 200
SYMBOLS = b"#*$%&|<>"

COUNTS = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "covered_words",
    "longest_repeat",
    "n_repeats",
)
KIND = T.StructType([T.StructField(name, T.LongType()) for name in COUNTS])


def suffix_array(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and LCP array (with the suffix before) of a sequence of numbers.

    Prefix doubling: only suffixes that still share their place with others are sorted
    again, by the rank of what follows. The ranks of each round are kept; they give the
    LCP of neighbours by binary descent.
    """
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    if n == 0:
        return order, np.zeros(0, np.int64)
    starts = np.r_[True, np.diff(codes[order]) != 0]
    slot_rank = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = slot_rank
    levels = [rank.astype(np.int32)]
    span = 1
    single = starts & np.r_[starts[1:], True]
    open_slots = np.flatnonzero(~single)
    while len(open_slots):
        at = order[open_slots]
        after = at + span
        follow = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
        combined = slot_rank[open_slots] * (n + 1) + follow + 1
        by = np.argsort(combined, kind="stable")
        combined = combined[by]
        order[open_slots] = at[by]
        first = np.r_[True, np.diff(combined) != 0]
        slot_rank[open_slots] = np.maximum.accumulate(np.where(first, open_slots, 0))
        rank[order[open_slots]] = slot_rank[open_slots]
        span *= 2
        levels.append(rank.astype(np.int32))
        open_slots = open_slots[~(first & np.r_[first[1:], True])]
    lcp = np.zeros(n, np.int64)
    near = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]]) + 1
    left, right = order[near - 1].copy(), order[near].copy()
    found = np.zeros(len(near), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        ranks = levels[level]
        inside = (left < n) & (right < n)
        equal = inside.copy()
        equal[inside] = ranks[left[inside]] == ranks[right[inside]]
        step = equal * (1 << level)
        found += step
        left += step
        right += step
    lcp[near] = found
    return order, lcp


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in one of the spans."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:-1]) > 0


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(flags, dtype=np.int64)]
    return total[offsets[1:]] - total[offsets[:-1]]


def measure(texts: pa.Array, min_repeat: int = MIN_REPEAT) -> pa.Array:
    """The counts of each text of a slice."""
    data, offsets = raw(texts)
    whole = data.tobytes()
    space = SPACE[data]
    is_symbol = np.zeros(256, bool)
    is_symbol[list(SYMBOLS)] = True
    word_chars = _per_row(~space & ((data & 0xC0) != 0x80), offsets)
    n_symbols = _per_row(is_symbol[data], offsets)
    codes, ends, dup_lines = [], [0], []
    numbers: dict[bytes, int] = {}
    for at, to in zip(offsets[:-1], offsets[1:], strict=True):
        text = whole[at:to]
        lines = [line for line in text.split(b"\n") if line.strip()]
        dup_lines.append(len(lines) - len(set(lines)))
        codes.extend([numbers.setdefault(word, len(numbers)) for word in text.split()])
        ends.append(len(codes))
    words = np.array(ends)
    n = len(codes)
    row = np.repeat(np.arange(len(texts)), np.diff(words))
    order, lcp = suffix_array(np.array(codes, np.int64) + row * len(numbers))
    reach = np.zeros(n, np.int64)
    reach[order] = np.maximum(lcp, np.r_[lcp[1:], 0]) if n else lcp
    windows = np.flatnonzero(reach >= 3)
    repeated = covered(windows, np.full(len(windows), 3), n)
    long_starts = np.flatnonzero(reach >= min_repeat)
    spans = covered(long_starts, reach[long_starts], n)
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, row[long_starts], reach[long_starts])
    # An LCP interval of at least min_repeat opens where the LCP rises to it in suffix order.
    opens = order[np.flatnonzero((lcp >= min_repeat) & (np.r_[0, lcp[:-1]] < min_repeat))] if n else order
    intervals = np.bincount(row[opens], minlength=len(texts)) if n else np.zeros(len(texts), np.int64)
    made = (
        np.diff(words),
        word_chars,
        n_symbols,
        dup_lines,
        _per_row(repeated, words),
        _per_row(spans, words),
        longest,
        intervals,
    )
    return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in made], list(COUNTS))


def judged(
    docs: DataFrame,
    text: str = "text",
    min_repeat: int = MIN_REPEAT,
    max_covered: float = MAX_COVERED,
    max_longest: int = MAX_LONGEST,
) -> tuple[DataFrame, str]:
    """``docs`` with one more struct column of counts and verdicts, and that column's name."""
    name = new_name(docs, "quality")
    df = with_column(docs, name, KIND, lambda column: measure(column, min_repeat), text)
    q = F.col(name)
    failed = (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > MAX_REPEAT_PERCENT * q["n_words"])
    repetitive = (q["covered_words"] > max_covered * q["n_words"]) | (q["longest_repeat"] > max_longest)
    verdicts = q.withField("base_failed", failed).withField("kept", ~failed & ~repetitive)
    return df.withColumn(name, verdicts), name


def quality(docs: DataFrame, key: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """One row per document: id, counts, ``base_failed`` and ``kept``."""
    df, name = judged(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), **limits)
    return df.select("doc_id", f"{name}.*")


def keep_good(docs: DataFrame, text: str = "text", **limits) -> DataFrame:
    """The documents that pass, with the columns they came with."""
    df, name = judged(docs, text, **limits)
    return df.where(F.col(name)["kept"]).select(*docs.columns)
