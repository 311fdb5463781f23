"""License scans by template markup.

A template is a license's wording with two kinds of region:

* ``[[words]]``: optional, there whole or not at all; regions may hold others;
* ``{{name:lo-hi}}``: replaceable, any lo to hi words (a name, a year, a product), and
  ``{{name=this wording|that wording}}``: one of the wordings given.

A template is compiled to an automaton over words whose states are the places of its words, with the
states that can follow each (Glushkov's construction), so optional regions cost no empty steps. All
wording outside regions must be there, word by word. The automaton starts at each word that can begin its
template and follows all readings at once as bits of one number; the longest accepted span counts, spans of
one template do not overlap. A span is reported with its label; a text may have several.

Words are runs of digits, letters A-Z (read as a-z) and characters beyond ASCII, so punctuation, line
breaks and comment signs do not matter. Texts are read in slices of bounded size, or one text if it is
longer; word places are kept as numbers, words are only cut out where an automaton runs.

Defined cases: null and empty texts have no words, no labels and score 0; rows with equal id are scanned one
by one; an empty table gives an empty table; other columns neither matter nor clash. If spans of several templates with
one label overlap, all are reported.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callscope.llm.common import raw, with_column

#: Phrases that give a label by standing in the text.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Fixed values: (label, template) of common licenses, their notices and reference lines.
TEMPLATES = [
    ("mit", "{{verb=released|licensed|distributed|available|published|provided}} under [[the terms of]] the mit license"),
    ("mit", "spdx license identifier mit"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of {{what:1-12}} to deal in the software without"
        " restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of"
        " the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above"
        " copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions"
        " of the software [[the software is provided as is without warranty of any kind express or implied including but not limited to the"
        " warranties of merchantability fitness for a particular purpose and noninfringement in no event shall {{holder:1-8}} be liable for any"
        " claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the"
        " software or the use or other dealings in the software]]",
    ),
    (
        "apache-2",
        "{{verb=released|licensed|distributed|available|published|provided}} under [[the terms of]] the apache license version 2 [[0]]"
        " [[the license you may not use this file except in compliance with the license you may obtain a copy of the license at"
        " {{where:0-8}} unless required by applicable law or agreed to in writing software distributed under the license is distributed on an"
        " as is basis without warranties or conditions of any kind either express or implied see the license for the specific language"
        " governing permissions and limitations under the license]]",
    ),
    ("apache-2", "spdx license identifier apache 2 0"),
    ("cc-by", "{{verb=released|licensed|distributed|available|published|provided}} under [[the terms of]] [[a|the]] cc by [[{{version=4 0|3 0|2 5|2 0}}]] [[international|unported]] license"),
    ("cc-by-nc", "{{verb=released|licensed|distributed|available|published|provided}} under [[the terms of]] [[a]] [[the]] cc by nc [[{{version=4 0|3 0|2 5|2 0}}]]"),
    ("cc-by-nc", "creative commons attribution {{nc=noncommercial|non commercial}} [[{{version=4 0|3 0|2 5|2 0}}]] [[international]] [[unported]] [[public]] license"),
    ("cc-by-sa", "creative commons attribution {{sa=sharealike|share alike}} [[{{version=4 0|3 0|2 5|2 0}}]] [[international]] [[unported]] [[public]] license"),
    ("cc-by", "creative commons attribution [[{{version=4 0|3 0|2 5|2 0}}]] [[international]] [[unported]] [[public]] license"),
    (
        "bsd-2",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions"
        " are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following"
        " disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following"
        " disclaimer in the documentation and or other materials provided with the distribution this software is provided by",
    ),
    (
        "bsd-3",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions"
        " are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following"
        " disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following"
        " disclaimer in the documentation and or other materials provided with the distribution [[3]] neither the name of {{holder:1-12}} nor the"
        " names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the"
        " above copyright notice and this permission notice appear in all copies",
    ),
    (
        "gpl",
        "free software you can redistribute it and or modify it under the terms of the gnu general public license as published by"
        " the free software foundation either version {{version=1|2|3}} of the license or [[at your option]] any later version",
    ),
    ("gpl", "{{verb=released|licensed|distributed|available|published|provided}} under [[the terms of]] the gnu general public license [[version {{version=2|3}}]]"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "free and unencumbered software released into the public domain"),
    ("cc0", "cc0 1 0 [[universal]]"),
]

_KIND = np.zeros(256, bool)
_KIND[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_TOKEN = re.compile(r"\[\[|\]\]|\{\{.*?\}\}|\||[^\s\[\]{}|]+")
SPAN = T.StructType(
    [
        T.StructField("label", T.StringType()),
        T.StructField("template", T.IntegerType()),
        T.StructField("first_word", T.LongType()),
        T.StructField("end_word", T.LongType()),
    ]
)
FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("phrases", T.ArrayType(SPAN)),
        T.StructField("templates", T.ArrayType(SPAN)),
    ]
)


class Automaton:
    """States of a template as bits: ``begin`` and ``accept`` sets, what follows a state, which states a word reaches."""

    def __init__(self, template: str):
        self.words: list[bytes | None] = []
        self.follow: list[int] = []
        tokens = _TOKEN.findall(template)
        first, last, skip, used = self._choice(tokens, 0)
        if used != len(tokens):
            raise ValueError(f"unbalanced region in template: {template[:60]}")
        if skip:
            raise ValueError(f"template without mandatory wording: {template[:60]}")
        self.begin, self.accept = first, last
        self.any = sum(1 << i for i, w in enumerate(self.words) if w is None)
        self.reached: dict[bytes, int] = {}
        for i, word in enumerate(self.words):
            if word is not None:
                self.reached[word] = self.reached.get(word, 0) | 1 << i

    def _state(self, word: bytes | None) -> int:
        self.words.append(word)
        self.follow.append(0)
        return 1 << len(self.words) - 1

    def _link(self, last: int, first: int) -> None:
        for state in bits(last):
            self.follow[state] |= first

    def _joined(self, left: tuple[int, int, bool], right: tuple[int, int, bool]) -> tuple[int, int, bool]:
        """First states, last states and whether it may be empty, of one part after another."""
        self._link(left[1], right[0])
        return (left[0] | (right[0] if left[2] else 0), right[1] | (left[1] if right[2] else 0), left[2] and right[2])

    def _choice(self, tokens: list[str], at: int) -> tuple[int, int, bool, int]:
        """Wordings parted by ``|`` up to the end of the region."""
        made = None
        while True:
            first, last, skip, at = self._sequence(tokens, at)
            made = (first, last, skip) if made is None else (made[0] | first, made[1] | last, made[2] or skip)
            if at < len(tokens) and tokens[at] == "|":
                at += 1
                continue
            return *made, at

    def _sequence(self, tokens: list[str], at: int) -> tuple[int, int, bool, int]:
        made = (0, 0, True)
        while at < len(tokens) and tokens[at] not in ("]]", "|"):
            token = tokens[at]
            at += 1
            if token == "[[":
                first, last, _, at = self._choice(tokens, at)
                if at >= len(tokens) or tokens[at] != "]]":
                    raise ValueError("optional region without end")
                at += 1
                part = (first, last, True)
            elif token.startswith("{{"):
                part = self._replaceable(token[2:-2])
            else:
                state = self._state(token.lower().encode())
                part = (state, state, False)
            made = self._joined(made, part)
        return *made, at

    def _replaceable(self, rule: str) -> tuple[int, int, bool]:
        if "=" in rule:
            first, last, skip, _ = self._choice(_TOKEN.findall(rule.split("=", 1)[1]), 0)
            return first, last, skip
        least, most = map(int, rule.split(":", 1)[1].split("-"))
        made = (0, 0, True)
        for i in range(most):
            state = self._state(None)
            if i < least:
                made = self._joined(made, (state, state, False))
            else:
                # One more word may follow only where the one before it was taken.
                self._link(made[1] if i == least else 1 << len(self.words) - 2, state)
                made = (made[0] | (state if made[2] and i == least else 0), made[1] | state, made[2])
        return made

    def longest(self, word_at, start: int, end: int) -> int:
        """Where the longest accepted span from the word ``start`` ends, or ``start`` if there is none."""
        states, found, at = self.begin, start, start
        while states and at < end:
            states &= self.any | self.reached.get(word_at(at), 0)
            at += 1
            if states & self.accept:
                found = at
            states = self._after(states)
        return found

    def _after(self, states: int) -> int:
        reached = 0
        for state in bits(states):
            reached |= self.follow[state]
        return reached


def bits(states: int):
    while states:
        low = states & -states
        yield low.bit_length() - 1
        states ^= low


class Scanner:
    """Phrases and templates, and where in a text each can begin."""

    def __init__(self, phrases: dict[str, str], templates: list[tuple[str, str]]):
        self.phrases = [(label, Automaton(" ".join(phrase.split()))) for phrase, label in phrases.items()]
        self.templates = [(label, Automaton(template)) for label, template in templates]
        self.starts: dict[bytes, list[tuple[bool, int]]] = {}
        for which, rules in ((True, self.phrases), (False, self.templates)):
            for i, (_, rule) in enumerate(rules):
                free, at = 0, rule.begin
                # A template that begins with any words is found by its first word that is given.
                while at & rule.any:
                    free, at = free + 1, rule._after(at)
                    for state in bits(at & ~rule.any):
                        self._start(rule.words[state], which, i, free)
                for state in bits(rule.begin & ~rule.any):
                    self._start(rule.words[state], which, i, 0)
        words = b"|".join(re.escape(w) for w in sorted(self.starts, key=lambda w: (-len(w), w)))
        self.pattern = re.compile(rb"(?<![0-9a-z\x80-\xff])(?:" + words + rb")(?![0-9a-z\x80-\xff])")

    def _start(self, word: bytes, which: bool, rule: int, ahead: int) -> None:
        rules = self.starts.setdefault(word, [])
        if (which, rule, ahead) not in rules:
            rules.append((which, rule, ahead))

    def scan(self, low: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[list, list]:
        """Spans of phrases (all) and of templates (longest, not overlapping) in one lower-cased text."""

        def word_at(i: int) -> bytes:
            return low[starts[i] : ends[i]]

        tried: dict[tuple[bool, int], set[int]] = {}
        for match in self.pattern.finditer(low):
            word = int(np.searchsorted(starts, match.start()))
            for which, rule, ahead in self.starts[match.group()]:
                if word >= ahead:
                    tried.setdefault((which, rule), set()).add(word - ahead)
        found: tuple[list, list] = ([], [])
        for (which, rule), places in sorted(tried.items()):
            label, automaton = (self.phrases if which else self.templates)[rule]
            free = 0
            for at in sorted(places):
                if which or at >= free:
                    end = automaton.longest(word_at, at, len(starts))
                    if end > at:
                        found[0 if which else 1].append((label, rule, at, end))
                        free = end
        return found


def measure(texts: pa.Array, scanner: Scanner) -> pa.Array:
    """Words and spans of each text of a slice."""
    data, offsets = raw(texts)
    low = data.tobytes().lower()
    made = []
    for at, to in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        word = np.r_[False, _KIND[data[at:to]], False]
        edges = np.flatnonzero(word[1:] != word[:-1])
        starts, ends = edges[::2], edges[1::2]
        phrases, templates = scanner.scan(low[at:to], starts, ends)
        names = SPAN.names
        made.append(
            {"n_words": len(starts), "phrases": [dict(zip(names, s, strict=True)) for s in phrases], "templates": [dict(zip(names, s, strict=True)) for s in templates]}
        )
    span = pa.struct([("label", pa.string()), ("template", pa.int32()), ("first_word", pa.int64()), ("end_word", pa.int64())])
    return pa.array(made, pa.struct([("n_words", pa.int64()), ("phrases", pa.list_(span)), ("templates", pa.list_(span))]))


def _covered(spans):
    """Words that lie in at least one span, by going through the spans in order of their start."""
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("reach"))

    def step(seen, span):
        reach = F.greatest(seen["reach"], span["end_word"])
        fresh = F.greatest(span["end_word"] - F.greatest(span["first_word"], seen["reach"]), F.lit(0))
        return F.struct((seen["total"] + fresh).alias("total"), reach.alias("reach"))

    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["first_word"].alias("first_word"), s["end_word"].alias("end_word"))))
    return F.aggregate(ordered, start, step, lambda seen: seen["total"])


def licenses(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    phrases: dict[str, str] | None = None,
    templates: list[tuple[str, str]] | None = None,
) -> DataFrame:
    """(doc_id, n_words, phrases, templates, base_labels, labels, score), one row per document.

    ``phrases`` and ``templates`` are the spans found, in words from 0 with the end exclusive. ``base_labels`` are those
    of the phrases, ``labels`` those of both, each a sorted array. The score is the
    share of the text's words that lie in one of the spans.
    """
    scanner = Scanner(PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates)
    slim = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    found = with_column(slim, "found", FOUND, lambda column: measure(column, scanner))
    labels = lambda *spans: F.array_sort(F.array_distinct(F.concat(*[F.transform(s, lambda x: x["label"]) for s in spans])))
    p, t, n = F.col("found.phrases"), F.col("found.templates"), F.col("found.n_words")
    return found.select(
        "doc_id", "found.*", labels(p).alias("base_labels"), labels(p, t).alias("labels"),
        F.when(n > 0, _covered(F.concat(p, t)) / n).otherwise(F.lit(0.0)).alias("score"),
    )
