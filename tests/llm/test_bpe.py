from __future__ import annotations

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tidelens.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def plain():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.encoder(PATH, P.PATTERN).ranks, special_tokens={})


def ids(data: bytes) -> list[int]:
    return [int.from_bytes(data[i : i + 4], "little") for i in range(0, len(data), 4)]


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="ab thein'sretlldm.,\n 1éß", max_size=60)))
def test_as_the_library(text):
    e = bpe.encoder(PATH, P.PATTERN)
    want = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=e.ranks, special_tokens={}).encode_ordinary(text)
    got = e.encode(text)
    assert ids(got) == want and e.decode(got) == text.encode("utf-8", "replace")


def test_very_long_pretoken(plain):
    text = "".join("thereonaaaab"[(i * 7) % 12] for i in range(100000))
    assert ids(bpe.encoder(PATH, P.PATTERN).encode(text)) == plain.encode_ordinary(text)


def test_queue_takes_lowest_rank_then_leftmost():
    q = bpe.RankQueue(50000)
    entries = [(49999, 1), (5, 9), (5, 2), (64, 0), (4096, 7), (5, 4), (0, 3)]
    for e in entries:
        q.push(*e)
    assert [q.pop() for _ in entries] == sorted(entries) and not q.top


def test_other_pattern(plain):
    e = bpe.Encoder(bpe.encoder(PATH, P.PATTERN).ranks, r"\S+|\s+")
    other = tiktoken.Encoding("o", pat_str=r"\S+|\s+", mergeable_ranks=e.ranks, special_tokens={})
    assert ids(e.encode("a b. c  d\n")) == other.encode_ordinary("a b. c  d\n")


def test_table(edges, nothing, plain):
    found = bpe.decode(bpe.encode(edges, PATH, P.PATTERN), PATH, P.PATTERN).collect()
    texts = sorted((x or "" for x in (r.text for r in edges.select("text").collect())))
    assert sorted(bytes(r.decoded).decode() for r in found) == texts
    assert sorted(map(tuple, (ids(r.ids) for r in found))) == sorted(tuple(plain.encode_ordinary(t)) for t in texts)
    assert bpe.encode(nothing, PATH, P.PATTERN).count() == 0
