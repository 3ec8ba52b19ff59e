from __future__ import annotations

from collections import defaultdict

import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidelens.llm import packing

PATH = P.path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=50), st.text(alphabet="AbÉßüthe 'slre.,!|%\n\x1c1", max_size=60), st.just("a<|endoftext|>b")))
def test_ids_are_the_tokenizers(text):
    got = packing.ids_of(PATH)(text)
    assert got == packing.array("I", WHOLE.encode(text, add_special_tokens=False).ids).tobytes()


@given(st.integers(1, 100000))
def test_cuts(n):
    found = packing.cuts(n, 4096)
    assert sum(found) == n and all(x & (x - 1) == 0 and x <= 4096 for x in found) and found == sorted(found, reverse=True)
    assert len(found) == n // 4096 + bin(n % 4096).count("1")


def test_every_id_in_one_piece(edges, documents, nothing):
    rows = edges.select("doc_id", "text").unionByName(documents.select("doc_id", "text"))
    found = packing.pack(rows, PATH).collect()
    assert len({r.sequence_id for r in found}) == len(found) and all(r.offset == 0 and r.sequence_id % 64 == r.bucket and r.length == 1 << r.bucket for r in found)
    by = defaultdict(list)
    for r in found:
        by[r.doc_id].append(r)
    for doc, text in ((r.doc_id, r.text) for r in rows.collect() if r.doc_id != 900005):
        pieces = sorted(by[doc], key=lambda r: r.start)
        ids = b"".join(bytes(p.ids) for p in pieces)
        want = [*WHOLE.encode(text or "", add_special_tokens=False).ids, 2]
        assert ids == packing.array("I", want).tobytes() and {p.doc_tokens for p in pieces} == {len(want)}
        assert [p.start for p in pieces] == [sum(q.length for q in pieces[:k]) for k in range(len(pieces))]
    assert sum(r.length for r in by[900005]) == 2 * by[900005][0].doc_tokens
    assert packing.pack(nothing, PATH).count() == 0


def test_longest_must_be_a_power_of_two(documents):
    with pytest.raises(ValueError):
        packing.pack(documents, PATH, longest=1000)


def test_buckets_are_written(spark, documents, tmp_path):
    packing.write_buckets(packing.pack(documents.limit(5), PATH), str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "b")).filter("length(ids) / 4 <> pow(2, bucket)").count() == 0
