from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidelens.llm import queries, tokencount


def plain(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]


@pytest.fixture(scope="module")
def path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def test_query_against_the_library(spark, documents):
    texts = {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
    rows = queries.op11_digest_cache_counts(spark, "/root/testdata/sf0.001").collect()
    want = dict(zip(texts, plain(texts.values()), strict=True))
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((texts[r.doc_id] or "").encode()), want[r.doc_id], want[r.doc_id] > 1024)


def test_edges(spark, edges, path, tmp_path):
    more = spark.createDataFrame([(1, "a<|endoftext|>b", "en", 0.5, True, "x", "y")], edges.schema)
    df = edges.unionByName(more)
    want = df.select("doc_id", "text").collect()
    got = tokencount.count_tokens(df, path, tokencount.Cache(spark, str(tmp_path / "c")), keep=("doc_id", "text")).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1] is None, x[1] or "")
    assert sorted(((r.doc_id, r.text, r.n_bytes, r.n_tokens) for r in got), key=key) == sorted(((r.doc_id, r.text, len((r.text or "").encode()), n) for r, n in zip(want, plain([r.text for r in want]), strict=True)), key=key)
    assert [r.n_tokens for r in got if r.doc_id == 1] == [3]


def test_cache_is_used_and_appended(spark, path, tmp_path, monkeypatch):
    """Copies are encoded once, known texts never, another version's counts are not taken; a full bitmap changes nothing."""
    cache, version = tokencount.Cache(spark, str(tmp_path / "c")), tokencount.version_of(path)
    first = spark.createDataFrame([(i, f"text {i % 3}") for i in range(30)] + [(100, None), (100, None)], "doc_id long, text string").repartition(5)
    tokencount.count_tokens(first, path, cache).collect()
    stored = spark.read.option("recursiveFileLookup", True).parquet(f"{cache.folder}/{version}")
    assert stored.count() == stored.select("digest").distinct().count() == 4
    wrong = stored.withColumn("n_tokens", F.col("n_tokens") + 1000)
    odd = tokencount.Cache(spark, str(tmp_path / "odd"))
    odd.append(version, wrong)
    odd.append("another version", wrong.withColumn("n_tokens", F.lit(7).cast("long")))
    monkeypatch.setattr(tokencount, "BITMAP_CELLS", 1)
    second = first.unionByName(spark.createDataFrame([(i, f"new {i}") for i in range(200, 500)], "doc_id long, text string"))
    got = {r.doc_id: r.n_tokens for r in tokencount.count_tokens(second, path, odd).collect()}
    assert len(got) == 331 and all((n > 1000) == (i < 30) for i, n in got.items() if i != 100) and got[100] == 1000
    assert odd.counts(version).count() == 304 and got[200] == plain(["new 200"])[0]


def test_nothing(spark, nothing, path, tmp_path):
    assert tokencount.count_tokens(nothing, path, tokencount.Cache(spark, str(tmp_path / "c"))).count() == 0


def test_pieces(spark, tmp_path):
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    model = public_tokenizers.path("piece_bpe_32k.model")
    df = spark.createDataFrame([(1, "Hello  world é"), (2, "")], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in tokencount.count_tokens(df, model, tokencount.Cache(spark, str(tmp_path / "c"))).collect()}
    assert got == {1: len(SentencePieceProcessor(model_file=model).encode("Hello  world é")), 2: 0}
