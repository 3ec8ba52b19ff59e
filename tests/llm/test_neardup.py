from __future__ import annotations

import random

import numpy as np
import pytest

from tidelens.llm import neardup, queries
from tidelens.sources.folders import Scratch


def naive_sets(text, words):
    w = (text or "").encode()
    found = bytes(b + 32 if 65 <= b <= 90 else b for b in w).split()
    if not found:
        return frozenset()
    return frozenset(tuple(found[i : i + words]) for i in range(len(found) - words + 1)) or frozenset([tuple(found)])


def brute(rows, words):
    sets = {d: naive_sets(t, words) for d, t in rows}
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize("words", [2, 5])
def test_against_all_pairs(spark, words):
    rng = random.Random(words)
    rows, vocabulary = [], [f"w{i}" for i in range(3000)]
    for k in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 6, 40, 200]))]
        for _ in range(rng.choice([1, 1, 2, 5, 40 if k < 2 else 3])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 4, 8])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append(" ".join(copy))
    rng.shuffle(rows)
    rows = [*enumerate(rows), (5000, None), (5001, ""), (5002, " \n"), (5003, "A b"), (5004, "a B"), (5005, "a")]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, component_id string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, words).collect()}
    want = brute(rows, words)
    assert found == want
    assert found[5003] == found[5004] and found[5001] == (0, 5001)


def test_documents(spark, documents):
    sf = "/root/testdata/sf0.001"
    found = queries.op2_chosen_path_near_duplicates(spark, sf).collect()
    want = brute([(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()], 2)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want and all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_edges(edges, nothing):
    found = neardup.near_duplicates(edges, 2).collect()
    assert len(found) == edges.count()
    by = {r.doc_id: r for r in found}
    assert (by[None].component_id, by[None].kept) == (None, True)
    assert by[900009].component_id == 900005 and not by[900009].kept and by[900005].kept
    assert (by[900001].n_shingles, by[900001].component_id, by[900001].kept) == (0, 900001, True)
    assert neardup.near_duplicates(nothing).count() == 0


def test_components(spark):
    scratch, rng = Scratch(spark, "test"), random.Random(3)
    edges = sorted({tuple(sorted(rng.sample(range(120), 2))) for _ in range(90)} | {(k, k + 1) for k in range(200, 260)})
    up = list(range(300))
    for _ in range(300):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    found = {r.node: r.root for r in neardup.components(scratch.keep(spark.createDataFrame(edges, "a long, b long")), scratch).collect()}
    assert found == {k: x for k, x in enumerate(up) if x != k}


def test_similarity_below_the_search(documents):
    with pytest.raises(ValueError):
        neardup.near_duplicates(documents, percent=50)


def test_word_hashes(monkeypatch):
    monkeypatch.setattr(neardup, "PIECE", 50)
    monkeypatch.setattr(neardup, "LONG_WORD", 12)
    neardup._letters.cache_clear()
    rng, seen = random.Random(1), {}
    for _ in range(2000):
        text = "".join(rng.choice("aAbB \n\té\x1cxyzQ") for _ in range(rng.randrange(200))).encode()
        words, found = text.lower().split(), neardup.word_hashes(text).tolist()
        assert len(words) == len(found) and all(seen.setdefault(w, h) == h for w, h in zip(words, found, strict=True))
    assert len(set(seen.values())) == len(seen)
    neardup._letters.cache_clear()


@pytest.mark.parametrize("n", [1, 2, 5, 40, 300, 5000])
def test_minwise_tells_similarity(n):
    rng = np.random.default_rng(n)
    agree = []
    for _ in range(40):
        x = rng.integers(0, 2**63, n + n // 4, np.uint64)
        a, b = np.unique(x[:n]), np.unique(x[n // 8 :])
        agree.append(np.mean(neardup.minwise(a) == neardup.minwise(b)) - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
    assert abs(np.mean(agree)) < 0.02 and len(set(neardup.minwise(np.arange(1, 2, dtype=np.uint64)).tolist())) == neardup.TOKENS


def test_recall_near_the_bar(spark):
    """2,000 pairs of similarity 0.8 to 0.85 among documents of one vocabulary: 0.99 are found, and nothing is made up."""
    rng, rows = random.Random(8), []
    for k in range(2000):
        base = [f"v{rng.randrange(30000)}" for _ in range(120)]
        copy = list(base)
        for i in rng.sample(range(60), 6):
            copy[2 * i] = f"u{rng.randrange(30000)}"
        rows += [" ".join(base), " ".join(copy)]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    by = {}
    for d, t in rows:
        for x in naive_sets(t, 2):
            by.setdefault(x, []).append(d)
    sets, links = {d: naive_sets(t, 2) for d, t in rows}, 0
    found = roots_of(spark, rows, most=8)
    for d, s in sets.items():
        near = {e for x in s for e in by[x] if e < d}
        for e in near:
            n = len(s & sets[e])
            if 100 * n >= 80 * (len(s) + len(sets[e]) - n):
                links += 1
                by[d, "found"] = found.get(d) == found.get(e, e)
    hit = sum(v for k, v in by.items() if isinstance(k, tuple) and k[1] == "found")
    assert links >= 1500 and hit >= 0.99 * links and len(found) == hit


def templated(rng, pages, pairs, shared=50, own=50):
    """Pages of one template, of different words besides it, some with one near copy."""
    template, rows = [f"t{i}" for i in range(shared)], []
    for k in range(pages):
        page = template + [f"p{k}w{i}" for i in range(own)]
        rows.append(page)
        if k < pairs:
            rows.append(page[:-6] + [f"p{k}x{i}" for i in range(6)])
    rows = [" ".join(x) for x in rows]
    rng.shuffle(rows)
    return rows


def roots_of(spark, rows, **limits):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    scratch = Scratch(spark, "test")
    profiles = neardup.map_slices(df, lambda part: neardup._profiles(part, 2), neardup._PROFILE)
    sets = scratch.keep(profiles.selectExpr("doc_id as rep", "cast(n_shingles as int) as size", "tokens", "s0", "s1", "s2", "s3"))
    roots = neardup.search(sets, lambda ids: neardup.full_sets(ids, df, 2), scratch, **limits)
    return {} if roots is None else {r.node: r.root for r in roots.collect()}


@pytest.mark.parametrize("levels", [1, 4])
def test_templated_source(spark, monkeypatch, levels):
    """Nodes stay large at every level, and only documents of one page are similar enough."""
    monkeypatch.setattr(neardup, "BLOCK", 7)
    rows = list(enumerate(templated(random.Random(5), 60, 20, shared=80, own=20)))
    want = brute(rows, 2)
    assert sum(want[d][1] != d for d in want) == 20
    assert roots_of(spark, rows, most=3, levels=levels) == {d: c for d, (_, c) in want.items() if c != d}


def test_large_group_of_near_copies(spark):
    rng = random.Random(6)
    base, rows = [f"b{i}" for i in range(100)], []
    for k in range(150):
        copy = list(base)
        for i in rng.sample(range(100), rng.choice([2, 4])):
            copy[i] = f"c{k}w{i}"
        rows.append(" ".join(copy))
    rows = list(enumerate(rows))
    assert roots_of(spark, rows) == {d: c for d, (_, c) in brute(rows, 2).items() if c != d}


@pytest.mark.parametrize("shared", [0, 70])
def test_recall_at_the_bar(spark, shared):
    """Pairs of similarity 0.803, plain and on pages of one template that share 70 of 120 words: 0.99 are found, and no others."""
    rng, rows = random.Random(9), []
    template = [f"t{i}" for i in range(shared)]
    for _ in range(600):
        base = template + [f"v{rng.randrange(10**6)}" for _ in range(120 - shared)]
        copy = list(base)
        for i in [*rng.sample(range(shared // 2 + 1, 59), 6), 59.5]:  # six words inside take two shingles each, the last one takes one
            copy[int(2 * i)] = f"u{rng.randrange(10**6)}"
        rows += [" ".join(base), " ".join(copy)]
    if shared:
        rows += [" ".join(template + [f"w{rng.randrange(10**6)}" for _ in range(50)]) for _ in range(1900)]
    a, b = naive_sets(rows[0], 2), naive_sets(rows[1], 2)
    assert 0.8 < len(a & b) / len(a | b) < 0.804
    found = neardup.near_duplicates(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), 2)
    root = {r.doc_id: r.component_id for r in found.collect()}
    linked = sum(root[2 * k + 1] == 2 * k for k in range(600))
    assert linked >= 594 and sum(d != c for d, c in root.items()) == linked
