import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from fixtures import CLASHING, awkward_texts, documents
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callscope.llm import licenses, phrases, queries, trie


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


# --- conversations ---------------------------------------------------------------


def conversations(spark, rows):
    kind = T.StructType(
        [T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]
        + [T.StructField(name, T.StringType()) for name in ("pos", "depth", "x", "weight", "_row", "_slice", *CLASHING)]
    )
    return spark.createDataFrame([(*r, *["?"] * (len(kind) - 4)) for r in rows], kind).repartition(5)


def awkward_turns():
    rng = random.Random(11)
    rows = [(None, 0, "user", "lost"), (7, None, None, None), (7, None, "user", None), (7, 3, None, "é\n" * 4000), (7, 3, None, "tie"), (7, 3, None, "tie")]
    for c in [*range(0, 60), *range(130, 160), -5, 4096, 4100, 10**12]:
        for t in range(rng.randint(1, 7)):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "b", "", None])))
    # A hundred whose first conversation is short, and copies of one conversation.
    rows += [(200, 0, "user", "short")] + [(c, t, "user", "same") for c in range(300, 340) for t in range(8)]
    # One conversation with a third of all turns.
    rows += [(77, t // 3, "user", str(t % 5)) for t in range(400)]
    return rows


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, x) for *_, r, x in sorted(seq)] for c, seq in own.items()}
    built = {}
    for c, seq in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(c / 100 if abs(c) < 2**40 else c // 100) * 0 - (abs(c) % 100) * (1 if c >= 0 else -1)
        built[c] = tuple(own.get(base, [])[:h] + seq[h:])
    members = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    children = Counter(p[:-1] for p in members if p)
    below, leaves = Counter(), Counter()
    for p, who in members.items():
        for d in range(len(p) + 1):
            below[p[:d]] += (len(who) - 1) * (len(p[-1][1]) if p else 0)
            leaves[p[:d]] += p not in children
    out = Counter()
    for p, who in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in who if len(built[c]) == len(p)))
        up = min(members[p[:-1]]) if p else None
        out[(min(who), len(p), up, len(who), children[p], leaves[p], below[p], hashlib.sha256(ends.encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("size", [4096, 16])
def test_trie_equals_brute_force(spark, monkeypatch, size):
    """Also with slices and lists far shorter than a conversation and a node's ends."""
    monkeypatch.setattr(trie, "SLICE", size)
    monkeypatch.setattr(trie, "LIST_BITS", 3 if size == 16 else 12)
    turns = conversations(spark, awkward_turns())
    nodes, lists = trie.trie(turns)
    found = nodes.join(trie.list_digests(lists), trie.NODE, "left")
    found = found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())),
    )
    assert Counter(map(tuple, found.collect())) == brute_trie(awkward_turns())
    ends = [r["ids"] for r in lists.collect()]
    assert max(map(len, ends)) <= (8 if size == 16 else 4096)


def test_trie_texts_and_empty_table(spark):
    rows = [(100, 0, "user", "hello"), (100, 1, "assistant", "there"), (101, 0, "user", "x")]
    turns = conversations(spark, rows)
    nodes, _ = trie.trie(turns)
    said = {(r["conv_id"], r["depth"]): (r["role"], r["text"]) for r in trie.texts(nodes, turns).collect()}
    assert said[(100, 0)] == (None, None) and said[(100, 1)] == ("user", "hello") and said[(100, 2)] == ("assistant", "there")
    none, lists = trie.trie(conversations(spark, []))
    assert none.count() == 0 and trie.list_digests(lists).count() == 0


# --- licenses --------------------------------------------------------------------


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def expanded(template):
    """All wordings of a template as word tuples; None stands for any word."""
    tokens = re.findall(r"\[\[|\]\]|\{\{.*?\}\}|\||[^\s\[\]{}|]+", template)

    def choice(at):
        made, at = sequence(at)
        while at < len(tokens) and tokens[at] == "|":
            more, at = sequence(at + 1)
            made |= more
        return made, at

    def sequence(at):
        made = {()}
        while at < len(tokens) and tokens[at] not in ("]]", "|"):
            token = tokens[at]
            at += 1
            if token == "[[":
                part, at = choice(at)
                at += 1
                part = part | {()}
            elif token.startswith("{{") and "=" in token:
                part = {tuple(x.split()) for x in token[2:-2].split("=")[1].split("|")}
            elif token.startswith("{{"):
                lo, hi = map(int, token[2:-2].split(":")[1].split("-"))
                part = {(None,) * n for n in range(lo, hi + 1)}
            else:
                part = {(token,)}
            made = {a + b for a in made for b in part}
        return made, at

    return choice(0)[0]


def brute_spans(words, template):
    found, free = [], 0
    wordings = sorted(expanded(template), key=len, reverse=True)
    for at in range(len(words)):
        if at >= free:
            for wording in wordings:
                part = words[at : at + len(wording)]
                if len(part) == len(wording) and all(w is None or w == p for w, p in zip(wording, part, strict=True)):
                    found.append((at, at + len(wording)))
                    free = at + len(wording)
                    break
    return found


SMALL = [
    ("x", "a [[b [[c|d e]]]] {{n:1-3}} f"),
    ("y", "{{n:0-2}} b c"),
    ("y", "a {{v=b|c c|d}} [[a]]"),
    ("z", "[[a]] [[b]] e [[a [[b]]|f]]"),
    ("w", "f {{n:2-2}} f"),
]


def license_texts():
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 60))) for _ in range(120)]
    texts += [None, "", "--- ", "A-b_C\x00d", "é1 a b é1", "a b c　d a", " ".join(rng.choice("abcdef") for _ in range(20000))]
    return texts


def test_licenses_equal_brute_force(spark):
    base = {"b c": "bc", "a a": "aa", "e": "e"}
    rows = [(i, t, "en") for i, t in enumerate(license_texts())] + [(None, "a a a", None), (3, "a a a", None), (3, "a a a", None)]
    found = licenses.licenses(documents(spark, rows), phrases=base, templates=SMALL)
    seen = Counter()
    for r in found.collect():
        spans = tuple(sorted((s["label"], s["template"], s["first_word"], s["end_word"]) for s in r["templates"]))
        places = tuple(sorted((s["label"], s["first_word"]) for s in r["phrases"]))
        seen[(r["doc_id"], r["n_words"], places, spans, tuple(r["base_labels"]), tuple(r["labels"]), round(r["score"], 12))] += 1
    want = Counter()
    for i, text, _ in rows:
        words = words_of(text)
        spans = tuple(sorted((label, n, a, b) for n, (label, t) in enumerate(SMALL) for a, b in brute_spans(words, t)))
        places = [(label, a, a + len(p.split())) for p, label in base.items() for a in range(len(words)) if words[a : a + len(p.split())] == p.split()]
        covered = {w for _, a, b in places for w in range(a, b)} | {w for *_, a, b in spans for w in range(a, b)}
        names = sorted({p for p, *_ in places})
        both = sorted({*names, *(s[0] for s in spans)})
        want[(i, len(words), tuple(sorted((p, a) for p, a, _ in places)), spans, tuple(names), tuple(both), round(len(covered) / max(1, len(words)), 12))] += 1
    assert seen == want


def test_templates_match_real_wording(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    texts = {
        1: mit, 2: mit.replace("sublicense", "sell"), 3: "# Licensed under the Apache License, Version 2.0 (the \"License\")", 4: "Licensed under CC BY-NC 4.0.",
        5: "This work is licensed under the GNU General Public License, version 3.", 6: "SPDX-License-Identifier: MIT", 7: "No license here; permission is not granted.",
        8: "Released under the terms of the MIT License.", 9: "/* This is free and unencumbered software released into the public domain. */",
    }
    found = {r["doc_id"]: r["labels"] for r in licenses.licenses(documents(spark, [(i, t, "en") for i, t in texts.items()])).collect()}
    assert found == {1: ["mit"], 2: [], 3: ["apache-2"], 4: ["cc-by-nc"], 5: ["gpl"], 6: ["mit"], 7: [], 8: ["mit"], 9: ["unlicense"]}


def test_license_query_on_awkward_rows(spark, docs, no_docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.op12_license_templates(spark, str(tmp_path)).collect()
    want = Counter((i, len(words_of(t))) for i, t, _ in awkward_texts())
    assert Counter((r["doc_id"], r["n_words"]) for r in rows) == want
    assert licenses.licenses(no_docs).count() == 0


@pytest.mark.parametrize("wrong", ["[[a]]", "a [[b", "a ]] b", "{{n:0-3}}"])
def test_wrong_templates_are_refused(wrong):
    with pytest.raises(ValueError):
        licenses.Automaton(wrong)


# --- phrases ---------------------------------------------------------------------


def brute_phrases(rows, least):
    counts, sizes = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    counts[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, found in counts.items():
        some = {p: a for p, a in found.items() if len(p) > 1 and a >= least}
        inside = {y[i : i + n] for y, b in some.items() for n in range(2, len(y)) for i in range(len(y) - n + 1) if 100 * b >= 100 * found[y[i : i + n]]}
        rows = []
        for p, a in some.items():
            if p not in inside:
                score, _, left, right = min((1000 * a * sizes[lang] // (found[p[:k]] * found[p[k:]]), k, found[p[:k]], found[p[k:]]) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(rows)[:2000], 1):
            out.append((lang, rank, p.decode(), -a, left, right, sizes[lang], -score))
    return Counter(out)


def phrase_rows():
    rng = random.Random(8)
    words = ["the", "The", "of", "é", "naïve", "a", "b", "\x00", "x y", "zz"]
    rows = [(i, "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", " ", ". ", ",", "\n", "\r"]) for _ in range(rng.randint(0, 80))), rng.choice(["en", "de", None, "und"])) for i in range(150)]
    return rows + awkward_texts() + [(1, "one two three four five six " * 30, "en")]


@pytest.mark.parametrize("settings", [{}, {"sample": 40, "slack": 2.0}, {"sample": 2, "slack": 0.1, "table_bits": 64}])
def test_phrases_equal_brute_force(spark, settings):
    """With a good sample, one that misses most phrases (so the border fails), and a bit table that is full."""
    found = phrases.collocations(documents(spark, phrase_rows()).repartition(4), min_count=12, **settings).collect()
    assert Counter(map(tuple, found)) == brute_phrases(phrase_rows(), 12)


def test_phrase_edges(spark, no_docs):
    assert phrases.collocations(no_docs).count() == 0
    few = documents(spark, [(1, None, "en"), (2, "", "en"), (3, "a b", None)])
    assert phrases.collocations(few, min_count=2).count() == 0
    many = phrases.collocations(documents(spark, [(i, "ab cd. ef gh", "en") for i in range(30)]), top=1, min_count=10).collect()
    assert [(r["rank"], r["phrase"], r["score"]) for r in many] == [(1, "ab cd", 4000)]


def test_scores_are_exact_beyond_64_bits(spark):
    rows = [("en", 0, "", 9 * 10**15), ("en", 1, "a", 10**6 + 3), ("en", 1, "b", 10**6 + 7), ("en", 2, "a b", 10**6 + 1)]
    expression = "(1000 * cast(a as decimal(16,0)) * cast(n as decimal(16,0))) div (cast(l as decimal(16,0)) * cast(r as decimal(16,0)))"
    a, n, left, right = rows[3][3], rows[0][3], rows[1][3], rows[2][3]
    df = spark.createDataFrame([(a, n, left, right)], "a long, n long, l long, r long")
    assert df.select(F.expr(expression)).first()[0] == 1000 * a * n // (left * right)
