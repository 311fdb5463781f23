import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from fixtures import awkward_texts, documents, prose
from pyspark.sql import functions as F

from callscope.llm import components, digest, queries, simhash, suffixes, windows


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_equals_brute_force(docs, no_docs):
    rows = simhash.near_duplicates(docs).collect()
    prints = [(i, fingerprint(t)) for i, t, _ in awkward_texts()]
    group = list(range(len(prints)))
    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 3:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {}
    for (i, _), g in zip(prints, group, strict=True):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    want = Counter((i, f"{p:016x}", least.get(g)) for (i, p), g in zip(prints, group, strict=True))
    assert want == Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows)
    assert simhash.near_duplicates(no_docs).count() == 0


def test_simhash_keeps_one_of_each_group(docs, no_docs):
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    ids = Counter(r["doc_id"] for r in kept.select("doc_id").collect())
    assert ids[8] == 1 and ids[9] == ids[11] == 0 and ids[15] == 1 and ids[14] == 2
    assert simhash.keep_first(no_docs).count() == 0


@pytest.mark.parametrize("tile", [3, 2048])
def test_links_connect_all_close_pairs(spark, tile):
    rng = np.random.default_rng(5)
    centers = rng.integers(0, 2**63, 20, dtype=np.uint64)
    prints = {int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for c in centers for _ in range(25)}
    signed = sorted(np.array(sorted(prints), np.uint64).view(np.int64).tolist())
    df = spark.createDataFrame([(p,) for p in signed], "fingerprint long")
    roots = dict(components.components(simhash.links(df, tile=tile)).collect())
    parent = {p: p for p in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in signed:
        for b in signed:
            if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    linked = {p: find(p) for p in signed if any(find(p) == find(q) for q in signed if q != p)}
    assert roots == linked


def removed(rows, length, keep_first):
    order = sorted(range(len(rows)), key=lambda r: (rows[r][0] is not None, rows[r][0] or 0))
    seen, first = Counter(), {}
    for r in order:
        data = (rows[r][1] or "").encode()
        for s in range(len(data) - length + 1):
            seen[data[s : s + length]] += 1
            first.setdefault(data[s : s + length], (r, s))
    out = []
    for r, (i, text, _) in enumerate(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1):
            w = data[s : s + length]
            if first[w] != (r, s) if keep_first else seen[w] > 1:
                gone[s : s + length] = b"\1" * length
        out.append((i, len(data), sum(gone), bytes(b for b, g in zip(data, gone, strict=True) if not g)))
    return out


# Rows with equal id and text are one document for the keep_first order, so they stay out here.
ROWS = [r for n, r in enumerate(awkward_texts()) if len(r[1] or "") < 40_000 and n != 16]


@pytest.mark.parametrize(("length", "anchor", "group"), [(400, 128, 4096), (60, 16, 4096), (60, 16, 1)])
@pytest.mark.parametrize("keep_first", [False, True])
def test_cut_equals_brute_force(spark, length, anchor, group, keep_first):
    """Also with every group too large for one task, so that it is split by its strings."""
    df = documents(spark, ROWS).repartition(4)
    got = suffixes.cut(df, length=length, anchor=anchor, group=group, keep_first=keep_first)
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], bytes(r["kept"])) for r in got.collect())
    assert got == Counter(removed(ROWS, length, keep_first))


@pytest.mark.parametrize(("length", "passage", "group"), [(400, 200, 4096), (60, 30, 1), (60, 60, 4096)])
@pytest.mark.parametrize("keep_first", [False, True])
def test_passages_are_told_and_stay(spark, length, passage, group, keep_first):
    """Shorter passages are reported, first copies too; what is cut is what would be cut without them."""
    shared = prose(41, 60)[:300]
    rows = [*ROWS, (901, f"{prose(42, 80)} {shared} {prose(43, 90)}", "en"), (902, f"{prose(44, 70)} {shared} {prose(45, 20)}", "en")]
    got = suffixes.cut(documents(spark, rows).repartition(4), length=length, group=group, keep_first=keep_first, passage=passage).collect()
    cut_out = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], bytes(r["kept"])) for r in got)
    assert cut_out == Counter(removed(rows, length, keep_first))
    told = Counter((r["doc_id"], r["n_bytes"], sum(b - a for a, b in r["passages"])) for r in got)
    assert told == Counter((i, n, gone) for i, n, gone, _ in removed(rows, passage, False))
    (spans,) = (r["passages"] for r in got if r["doc_id"] == 901)
    text = rows[-2][1].encode()
    assert any(shared.encode() in text[a:b] for a, b in spans)


def test_query_tells_passages_under_its_length(spark, tmp_path):
    shared = prose(41, 60)[:300]
    rows = [(1, f"{prose(42, 80)} {shared} {prose(43, 90)}", "en"), (2, f"{prose(44, 70)} {shared}", "en"), (3, prose(46, 200), "en"), (4, None, "en")]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op10_suffix_dedup(spark, str(tmp_path)).collect()}
    assert {i: (r["n_removed"], r["n_spans"]) for i, r in got.items()} == {i: (0, 0) for i in (1, 2, 3, 4)}
    assert all(got[i]["kept_sha256"] == hashlib.sha256((t or "").encode()).hexdigest() for i, t, _ in rows)
    assert {i: r["n_passages"] for i, r in got.items()} == {1: 1, 2: 1, 3: 0, 4: 0}
    assert got[1]["n_passage_bytes"] >= 300 and got[2]["n_passage_bytes"] >= 300 and got[3]["n_passage_bytes"] == 0


def brute_starts(texts, n, groups, rank, length, keep_first):
    """Which strings of units occur in another unit of the group (before it, by rank)."""
    out = set()
    for i, text in enumerate(texts):
        for s in range(n[i]):
            others = [j for j in range(len(texts)) if j != i and groups[j] == groups[i] and any(texts[j][k : k + length] == text[s : s + length] for k in range(n[j]))]
            if any(rank[j] < rank[i] for j in others) if keep_first else others:
                out.add((i, s))
    return out


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("seed", range(4))
def test_suffix_order_of_groups_equals_brute_force(seed, keep_first):
    """Units of four anchors under three group numbers: equal hashes of unlike bytes are kept apart."""
    rng = np.random.default_rng(seed)
    length, anchor = 20, 8
    anchors = [bytes(rng.integers(1, 4, anchor).astype(np.uint8)) for _ in range(4)]
    texts, n, ahead, groups = [], [], [], []
    for _ in range(60):
        which = int(rng.integers(4))
        before = int(rng.integers(0, length - anchor + 1))
        count = int(rng.integers(1, before + 2))
        behind = length - anchor - (before - count + 1)
        make = lambda m: bytes(rng.choice([0] * 9 + [1], m).astype(np.uint8))  # noqa: B023,E731
        texts.append(make(before) + anchors[which] + make(behind))
        n.append(count)
        ahead.append(before)
        groups.append(min(which, 2))
    rank = rng.permutation(60)
    found = suffixes.repeated_starts(texts, np.array(n), np.array(ahead), np.array(groups), rank, length, anchor, keep_first)
    # Only strings at equal distance from the anchor are compared; others cannot share an anchor place.
    want = set()
    for i, s in brute_starts(texts, n, groups, rank, length, keep_first):
        same = [j for j in range(60) if j != i and groups[j] == groups[i] and 0 <= ahead[j] - ahead[i] + s < n[j]
                and texts[j][ahead[j] - ahead[i] + s :][:length] == texts[i][s : s + length]]
        if any(rank[j] < rank[i] for j in same) if keep_first else same:
            want.add((i, s))
    assert {tuple(x) for x in np.argwhere(found).tolist()} == want and want


def test_dedup_keeps_columns_and_first_copy(spark, docs, no_docs):
    done = suffixes.deduplicated(docs)
    assert done.columns == docs.columns and done.count() == docs.count()
    texts = {r["doc_id"]: r["text"] for r in done.where("doc_id in (5, 6, 8, 9)").select("doc_id", "text").collect()}
    shared = prose(1, 140)
    assert shared in texts[5] and shared not in texts[6] and texts[8] == prose(2, 300) and texts[9] == ""
    assert done.where(F.length("text") != F.col("n_chars")).count() == 0
    assert suffixes.deduplicated(no_docs).count() == 0 and suffixes.cut(no_docs).count() == 0


def test_window_hashes_follow_content():
    data = np.frombuffer(b"xyz" + b"abcdefghij" * 3, np.uint8)
    (h,) = windows.hashes(data, (7,))
    assert h[3] == h[13] == h[23] and len(set(h.tolist())) == len(data) - 6 - 14


def test_least_places():
    values = np.array([5, 3, 3, 9, 1, 1], np.uint64) << np.uint64(40)
    assert windows.least_places(values, 3).tolist() == [1, 1, 4, 4]


def test_digests_of_neighbours(docs, no_docs):
    rows = digest.chained(docs).collect()
    order = sorted(((i, t or "") for i, t, _ in awkward_texts()), key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode()))
    want = Counter()
    for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        half = len(t) // 2
        want[(i, len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest())] += 1
    assert want == Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows)
    for r in rows:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    same = [r["fingerprint"] for r in rows if r["doc_id"] in (8, 9, 11)]
    assert len(set(same)) == 1 and len({r["fingerprint"] for r in rows if r["doc_id"] in (8, 13)}) == 2
    assert digest.chained(no_docs).count() == 0


def brute_digest(data):
    """Length byte and quartiles of one text, byte by byte."""
    counts = [0] * digest.BUCKETS
    for spread, places in zip(digest._SPREAD, digest.TRIPLETS, strict=True):
        for at in range(len(data) - places[-1]):
            bucket = 0
            for table, place in zip(spread, places, strict=True):
                bucket ^= int(table[data[at + place]])
            counts[bucket] += 1
    order = sorted(counts)
    cuts = [order[digest.BUCKETS * q // 4 - 1] for q in (1, 2, 3)]
    length, size = 0, len(data) + 1
    while 1.1 ** (length + 1) <= size * (1 + 1e-12) and length < 255:
        length += 1
    return [length, *(sum(c > cut for cut in cuts) for c in counts)]


def test_digests_and_likeness_equal_brute_force():
    texts = [b"", b"abc", "é".encode() * 40, prose(30, 200).encode(), prose(31, 50).encode(), b"x" * 3000]
    made = digest.digests(texts)
    want = [brute_digest(t) for t in texts]
    assert made.tolist() == want
    for i, a in enumerate(want):
        for j, b in enumerate(want):
            apart = sum({0: 0, 1: 1, 2: 2, 3: 6}[abs(x - y)] for x, y in zip(a[1:], b[1:], strict=True))
            longer = min(abs(a[0] - b[0]), digest.LENGTH_STEPS)
            like = 1 - (apart + longer) / (6 * digest.BUCKETS + digest.LENGTH_STEPS)
            assert digest.likeness(made[i : i + 1], made[j : j + 1])[0] == pytest.approx(like, abs=1e-12)
    for row, hexed in zip(want, digest.written(made), strict=True):
        packed = bytes(row[1 + 4 * i] << 6 | row[2 + 4 * i] << 4 | row[3 + 4 * i] << 2 | row[4 + 4 * i] for i in range(digest.BUCKETS // 4))
        assert hexed == (bytes([row[0]]) + packed).hex()


def test_edited_half_is_nearer_than_another_text():
    a, b = prose(20, 400), prose(21, 400)
    one, half, other = (digest.digests([t.encode()]) for t in (a, a[: len(a) // 2] + b[: len(a) // 2], b))
    assert digest.likeness(one, one)[0] == 1 and digest.likeness(one, half)[0] > digest.likeness(one, other)[0]
