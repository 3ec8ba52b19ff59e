from __future__ import annotations

import random
import re
import zlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from tidelens.llm import queries, variants


def apart(a: str, b: str) -> bool:
    """Exactly one letter put in, left out or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counted(rows) -> Counter:
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return Counter({w: k for w, k in n.items() if len(w) >= 5 and k >= 3})


def plain(n: Counter) -> dict:
    """Words are held against words that have a letter less or replaced in common."""
    by: dict[str, set] = {}
    for w in n:
        for i in range(len(w)):
            by.setdefault(w[:i] + w[i + 1 :], set()).add(w)
        by.setdefault(w, set()).add(w)
    near = {w: set() for w in n}
    for some in by.values():
        for a in some:
            near[a] |= {b for b in some if apart(a, b)}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), None if form[w] is None else n[form[w]])
    return out


def got(df) -> dict:
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def test_query_against_a_plain_version(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = plain(counted(rows))
    assert got(queries.op12_automaton_variants(spark, sf)) == want and sum(x[0] is not None for x in want.values()) > 20


def test_forms_and_roots_in_small_parts(spark):
    """Many words near each other, chains of forms, a half that a third of all words share, whatever the sizes of parts are."""
    rng, rows = random.Random(4), []
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(5, 8))) for _ in range(300)} | {"aaaab" + "".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200)}
    for k, w in enumerate(sorted(words)):
        rows += [(k, " ".join([w] * (3 * 2 ** rng.randint(0, 5))))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = plain(counted(rows))
    assert max(sum(1 for _ in _chain(want, w)) for w in want) >= 3
    for cell, bucket in ((20_000, 30_000), (7, 50), (40, 10_000)):
        assert got(variants.variants(df, cell_words=cell, bucket_rows=bucket)) == want


def _chain(found, w):
    while found[w][0] is not None:
        w = found[w][0]
        yield w


def test_edges(spark, edges, nothing):
    rows = [(r.doc_id, r.text) for r in edges.collect()]
    more = [(5, "x" * 60000)] * 3 + [(6, "x" * 59999 + " ÀÀÀÀÀ×")] * 4 + [(7, "")]
    df = edges.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    n = counted(rows + more)
    found = got(variants.variants(df))
    assert {w: x[2] for w, x in found.items()} == n
    assert {len(w) for w, x in found.items() if x[3] == 1} == {59999, 60000}
    assert got(variants.variants(edges)) == plain(counted(rows)) and got(variants.variants(nothing)) == {}


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text(alphabet="abc", min_size=3, max_size=7), max_size=40))
def test_automaton(words):
    words = sorted(words)
    a = variants.Automaton(words)
    assert [a.number(w, 0, a.start, 0) for w in words] == list(range(len(words)))
    assert a.number("abcabcabc", 0, a.start, 0) is None
    for w in words:
        for exact in range(len(w)):
            got = {words[i] for i in a.near(w, exact, True)} | {words[i] for i in a.near(w, exact, False)}
            assert got == {x for x in words if apart(w, x) and x[:exact] == w[:exact]}


def test_minimal():
    """States that the same endings follow are one."""
    a = variants.Automaton(sorted(x + y for x in ("ab", "cb", "db") for y in ("ing", "ed", "er")))
    assert len(a.edges) == 7
