from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import functions as F

from tidelens.llm import language, queries
from tidelens.llm.common import crc32_of_id


def brute(text: str, dimensions: int = 1024, seed: int = 1) -> np.ndarray:
    """Letter by letter, without kept vectors."""
    s = language.Space(dimensions, seed)
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    line = [language._EDGE]
    for w in words:
        line += [*map(ord, w), language._EDGE]
    total = np.zeros(dimensions)
    for a, b, c in zip(line, line[1:], line[2:], strict=False):
        total += np.roll(s.letter(a), 2) * np.roll(s.letter(b), 1) * s.letter(c)
    return total


def test_bundle_is_the_sum_of_bound_trigrams():
    for text in ("Die Straße, aber 12 schön", "a", "ÀB c", "été 🎉x"):
        s = language.Space(1024, 1)
        assert np.array_equal(s.bundle(*np.unique(language.trigrams(text), return_counts=True)), brute(text))


def test_more_trigrams_than_are_kept(monkeypatch):
    monkeypatch.setattr(language, "KEPT_TRIGRAMS", 3)
    s = language.Space(256, 1)
    assert np.array_equal(s.bundle(*np.unique(language.trigrams("several words here"), return_counts=True)), brute("several words here", 256))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    found = queries.op6_hyperdimensional_language(spark, sf).collect()
    true = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in found) and len(found) == len(true)
    held = [r for r in found if r.held_out]
    assert sum(r.lang_pred == true[r.doc_id] for r in held) >= 0.98 * len(held)


def test_edges(edges, documents, nothing):
    prototypes = language.profiles(documents, crc32_of_id() % 3 != 1)
    found = language.identify(edges, prototypes, keep=("doc_id", "text")).collect()
    for r in found:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and (letters or r.score == 0)
    assert len(found) == edges.count()
    assert language.identify(nothing, prototypes).count() == 0
    assert {r.lang_pred for r in language.identify(edges, language.profiles(nothing, F.lit(True))).collect()} == {"und"}
    assert language.profiles(edges.withColumn("lang", F.lit(None).cast("string")), F.lit(True)) == {}
