from __future__ import annotations

import re

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelens.llm import private, queries

KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits: str) -> bool:
    return sum(int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(reversed(digits))) % 10 == 0


def naive(text: str) -> list[tuple[str, int, int]]:
    out = []
    for kind, pattern in KINDS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255 or kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def found(df, models=None, column="base"):
    rows = private.find(df, models or {}, keep=("doc_id", "text")).collect()
    return [(r.text, [(private.KINDS[s.kind], s.start, s.end) for s in r[column]]) for r in rows]


CASES = [
    "é🎉 a@b.c_d@e.f x@y 1.2.3.4.5.6.7.8 256.1.1.1 0255.1.1.1 +1 (017) 555-7713, 4111 1111 1111 1111; 4111111111111112 +12345678 9+1234567.",
    "a.b@c.d@e.f.g@h.i @x.y %@a.b- a@b..c", "1.2.3 4.5.6.7", "+1+23456789 +123-", "4111-1111-1111-1111-", "5 5 5 5 5 5 5 5 5 5 5 5 5 5 5 5 5 5 5", "x" * 40000 + "@y.zz", "7 " * 4000, "+" + "1" * 9 + "\n2", "",
]


def test_base_spans(spark, edges):
    df = spark.createDataFrame(list(enumerate(CASES)), "doc_id long, text string").unionByName(edges.select("doc_id", "text"))
    for text, spans in found(df):
        assert spans == naive(text or ""), text


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="0123459+-. ()@ab%é", max_size=50), min_size=30, max_size=60))
def test_base_spans_of_anything(spark, texts):
    for text, spans in found(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")):
        assert spans == naive(text), text


@pytest.fixture(scope="module")
def models(spark):
    return private.learn(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_query(spark):
    import hashlib

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op4_boosted_private_spans(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = naive(texts[r.doc_id])
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest() and set(filter(None, said.split(","))) <= set(r.spans.split(","))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in base) for x in private.KINDS]


def test_added_spans_keep_apart(spark, models, documents):
    rows = [(1, "write to john [at] site [dot] org or anna.b @ mail.example.com now"), (2, "only 12 words and 3.14")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = dict(found(df, models, "spans"))
    assert {k for k, _, _ in spans[rows[0][1]]} <= {"email"} and spans[rows[1][1]] == []
    clean = documents.filter(~F.col("text").rlike(r"[0-9]{2}|@"))
    assert all(not s for _, s in found(clean, models, "spans"))
    for _, s in found(documents, models, "spans"):
        assert s == sorted(s, key=lambda x: (private.KINDS.index(x[0]), x[1]))


def test_redaction(spark, models, edges):
    df = spark.createDataFrame([(1, "é🎉 to a@b.cd, +1 (017) 555-7713!", 7), (2, None, 7), (3, "10.0.0.1", 7)], "doc_id long, text string, kept int")
    assert [(r.text, r.kept) for r in private.redact(df, {}).orderBy("doc_id").collect()] == [("é🎉 to [EMAIL], [PHONE]!", 7), (None, 7), ("[IP]", 7)]
    assert private.redact(edges, models).columns == edges.columns
    same = edges.filter("doc_id in (900006, 900007)")
    assert sorted(r.text for r in private.redact(same, models).collect()) == sorted(r.text for r in same.collect())


def test_native(models, documents):
    for df in (private.find(documents, models), private.redact(documents, models)):
        assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().executedPlan().toString())


def test_nothing_to_learn(spark, nothing):
    assert private.learn(nothing) == {} and private.find(nothing, {}).count() == 0


def test_boosting_separates():
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 5, (400, 3))
    label = ((rows[:, 0] > 2) & (rows[:, 1] < 3)).astype(float)
    trees, score = private.boost(rows, label, np.ones(400), ["a", "b", "c"])
    assert ((score > 0) == (label > 0)).all()

    def walk(t, r):
        return t if not isinstance(t, tuple) else walk(t[2] if r["abc".index(t[0])] <= t[1] else t[3], r)

    assert np.allclose([sum(walk(t, r) for t in trees) for r in rows], score)


def test_disguised_as_common_as_plain(spark):
    rng = np.random.default_rng(3)
    rows, planted, harmless = [], [], []
    for i in range(300):
        a, b, c = rng.integers(100, 1000, 3)
        planted.append(f"name{a} [at] site{b} [dot] org")
        harmless.append(f"2021-{1 + i % 12:02d}-{1 + i % 28:02d}")
        rows.append(f"contact name{b}@site{c}.org today. phone +1 ({a}) 555-{1000 + i}. build {a}.{b}.{c}1 of {harmless[-1]}, total {a}{b}{c}")
        rows.append(f"contact {planted[-1]} today. phone ({a}) 555-{1000 + i}. meet @ noon")
        planted.append(f"({a}) 555-{1000 + i}")
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    chosen = [text[a:b] for text, spans in found(df, private.learn(df), "spans") for _, a, b in spans]
    assert sum(x in set(chosen) for x in planted) >= 0.95 * len(planted)
    assert not set(chosen) & set(harmless) and not any("noon" in x for x in chosen)


def planted(n=40):
    """Texts with what is to be found in each, kind and writing: forms that the base rules miss, and forms of no kind."""
    rng = np.random.default_rng(11)

    def card(way, good=True):
        body = "4" + "".join(map(str, rng.integers(0, 10, 14)))
        digits = next(body + c for c in "0123456789" if luhn(body + c) == good)
        return way.join(digits[i : i + 4] for i in range(0, 16, 4))

    digits = lambda k: str(rng.integers(10 ** (k - 1), 10**k))
    name = lambda: rng.choice(["john", "anna", "li.wei", "maria"]) + str(rng.integers(1, 99))
    site = lambda: rng.choice(["example", "mail", "site"]) + str(rng.integers(1, 99))
    octets = lambda dot: dot.join(str(x) for x in rng.integers(1, 255, 4))
    forms = {
        "email": [lambda: f"john dot smith at {site()} dot com", lambda: f"{name()} [at] {site()} [dot] org", lambda: f"{name()}(at){site()}.net", lambda: f"{name()} @ {site()}.com", lambda: f"{name()} at {site()} dot org"],
        "ip": [lambda: octets("[.]"), lambda: octets(" . "), lambda: octets(" dot "), lambda: octets("(dot)")],
        "card": [lambda: card("."), lambda: card(" - "), lambda: card("/")],
        "phone": [lambda: f"({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"(030) {digits(7)}", lambda: f"0049 30 {digits(7)}", lambda: f"030/{digits(7)}", lambda: f"{digits(3)}-{digits(3)}-{digits(4)}"],
        None: [lambda: f"20{digits(2)}-0{digits(1)}-1{digits(1)}", lambda: f"1{digits(1)}/0{digits(1)}/20{digits(2)}", lambda: f"{digits(1)}.{digits(2)}.{digits(4)}", lambda: f"{name()}@{site()}", lambda: f"{name()} @ {site()}", lambda: f"{digits(3)}-{digits(2)}-{digits(4)}", lambda: card(".", good=False)],
    }
    said = {"email": ["write to", "contact:", "then came"], "ip": ["server", "seen from", "log in at"], "card": ["card", "paid by", "with visa"], "phone": ["phone:", "call", "reach us on"], None: ["phone:", "on", "SSN", "mail", "card no", "release"]}
    return [(f"{before} {x} today", kind, x) for kind, makes in forms.items() for make in makes for before in said[kind] for x in (make() for _ in range(n))]


def test_other_writings_by_kind(spark, models):
    """Of each kind, 95 of 100 other writings are found, and 95 of 100 spans that are added are of the kind; forms of no kind are left alone."""
    assert set(models) == set(private.KINDS)
    rows = planted()
    df = spark.createDataFrame([(i, x[0]) for i, x in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: {(private.KINDS[s.kind], r.text[s.start : s.end]) for s in r.spans} for r in private.find(df, models, keep=("doc_id", "text")).collect()}
    for kind in private.KINDS:
        there = [i for i, x in enumerate(rows) if x[1] == kind]
        right = sum((kind, rows[i][2]) in got[i] for i in there)
        added = sum(k == kind for found in got.values() for k, _ in found)
        assert right >= 0.95 * len(there) and right >= 0.95 * added, (kind, right, len(there), added)
    assert not any(got[i] for i, x in enumerate(rows) if x[2].startswith("20") and x[1] is None)


def test_one_row_does_not_drop_a_kind():
    """An odd row in one part leaves a threshold; a kind that cannot be told has none."""
    rows = np.array([[1], [0]] * 5 + [[1]])
    part, label = np.array([i // 2 for i in range(10)] + [2]), np.array([1.0, 0.0] * 5 + [0.0])
    assert private._calibrated(rows, label, np.array([10.0] * 10 + [1.0]), part, ["x"], 0.95) is not None
    assert private._calibrated(rows, label, np.array([10.0] * 10 + [50.0]), part, ["x"], 0.95) is None


def test_many_in_one_text(spark, models):
    """More matches than a block of a walk has, some of them in other writings, all where a plain walk puts them."""
    said = [f"name{i}@site{i % 7}.org" if i % 3 else f"n{i} [at] site{i} [dot] org" for i in range(700)]
    text = "é " + ", ".join(said)
    want, at = [], 2
    for x in said:
        want.append((at, at + len(x)))
        at += len(x) + 2
    ((_, spans),) = found(spark.createDataFrame([(1, text)], "doc_id long, text string"), models, "spans")
    assert [(a, b) for _, a, b in spans] == want and {k for k, _, _ in spans} == {"email"}
    redacted = private.redact(spark.createDataFrame([(1, text)], "doc_id long, text string"), models).first().text
    assert redacted == "é " + ", ".join(["[EMAIL]"] * 700)


def test_added_against_a_plain_version(spark, models, documents):
    """What is added is the free candidates that the trees choose, first come first, by hand from their features."""
    names = list(private.FEATURES)
    t = F.col("text")
    extra = spark.createDataFrame([(10**6, "cards 4111111111111111 5555555555554444, tel (030) 555-123-4567 or a.b @ c.org; 2021-03-04 1.2.3.4")], "doc_id long, text string")
    docs = documents.select("doc_id", "text").filter("text is not null").unionByName(extra)
    wide = docs.select("doc_id", F.transform(private.wide_spans(t), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.struct(*(c.alias(k) for k, c in private._feature_values(s).items())).alias("x"))).alias("wide"))
    wide = {r.doc_id: r.wide for r in wide.collect()}
    total = 0
    for r in private.find(docs, models).collect():
        got = {(private.KINDS[s.kind], s.start, s.end) for s in r.spans} - (base := {(private.KINDS[s.kind], s.start, s.end) for s in r.base})
        chosen = []
        for s in wide[r.doc_id]:
            if all(b <= s.start or s.end <= a for _, a, b in base):
                over, kind = max((private._walked(m.trees, np.array([s.x[n] for n in names]), names) - m.least, -private.KINDS.index(k)) for k, m in models.items())
                if over >= 0:
                    chosen.append((s.start, s.end, -kind))
        end, want = 0, set()
        for a, b, kind in sorted(chosen):
            if a >= end:
                want.add((private.KINDS[kind], a, b))
                end = b
        assert got == want
        total += len(got)
    assert total >= 3
