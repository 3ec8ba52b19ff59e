from __future__ import annotations

import itertools
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidelens.llm import lines, quality, queries


def field(seed: int) -> lines.Crf:
    rng = np.random.default_rng(seed)
    return lines.Crf(rng.normal(size=lines.WIDTH).astype(np.float32), 0.1, rng.normal(size=(2, 2)), rng.normal(size=2))


@pytest.mark.parametrize("seed", range(5))
def test_field_against_all_labellings(seed):
    f = field(seed)
    rows = np.random.default_rng(seed + 50).normal(size=(7, lines.WIDTH)).astype(np.float32)
    u = f.local(rows)
    all_ = {y: f.first[y[0]] + sum(a * b for a, b in zip(u, y, strict=True)) + sum(f.step[a, b] for a, b in itertools.pairwise(y)) for y in itertools.product((0, 1), repeat=7)}
    top = max(all_.values())
    weights = {y: np.exp(v - top) for y, v in all_.items()}
    total = sum(weights.values())
    assert f.marginals(rows) == pytest.approx([sum(w for y, w in weights.items() if y[k]) / total for k in range(7)], abs=1e-6)
    assert all_[tuple(f.best(rows))] == pytest.approx(top, abs=1e-5)


def test_extreme_scores_do_not_overflow():
    f = lines.Crf(np.full(lines.WIDTH, 1e4, np.float32), 0.0, np.full((2, 2), 300.0), np.zeros(2))
    assert all(0 <= x <= 1 for x in f.marginals(np.ones((4, lines.WIDTH), np.float32)) + f.marginals(-np.ones((4, lines.WIDTH), np.float32)))


def test_unlearned():
    assert lines.fit([], []).weights.any() == np.False_ and lines.fit(["a", "b"], [1, 1]).bias == 0
    assert lines.unlearned().best(np.zeros((2, lines.WIDTH), np.float32)) == [1, 1]


def naive_base(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    n, twice = len(words), len(covered)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, twice, n < 50 or 100 * twice > 50 * n


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="ab \n\t#é|\x1c\xa0", max_size=120)))
def test_base(text):
    assert quality.base(text.encode("utf-8", "replace")) == naive_base(text.encode("utf-8", "replace").decode())


def test_quality_on_held_out(spark):
    sf = "/root/testdata/sf0.01"
    found = {r.doc_id: r for r in queries.op8_line_field_quality(spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(found) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for d, r in found.items())
    held = [(found[d].predicted, y) for d, y in labels.items() if found[d].held_out]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)


def test_content_keeps_good_documents(spark):
    sf = "/root/testdata/sf0.01"
    found = {r.doc_id: r for r in queries.op1_content_lines(spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(40).collect()}
    for d, t in texts.items():
        r = found[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == naive_base(t)
    good = [found[d].kept for d, y in labels.items() if y == 1 and not found[d].base_failed]
    bad = [found[d].kept for d, y in labels.items() if y == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_edges(edges, nothing):
    f = field(1)
    found = {r.doc_id: r for r in quality.keep_content(edges, f, keep=("doc_id", "text")).collect()}
    for i in (900001, 900002, 900003):
        assert (found[i].n_words, found[i].base_failed, found[i].kept, found[i].content_share) == (0, True, False, 0)
    assert found[900006].n_words == 60000 and found[900006].base_failed and found[900007].word_chars == 60000
    scores = {r.doc_id: r.score for r in quality.score(edges, quality.Classifier(f, 1.0, 0.0)).collect()}
    assert scores[900001] == scores[900002] == scores[900003] == 0 and scores[900005] == scores[900009] > 0
    assert quality.score(nothing, quality.Classifier(f, 1.0, 0.0)).count() == quality.keep_content(nothing, f).count() == 0


def test_learning_from_one_label():
    c = quality.learn(["a b", "c d"], [1, 1], {1: 2})
    assert c.score("anything") == 0.5 and c.score("") == 0
    assert quality.learn([], [], {}).score("x") == 0.5
