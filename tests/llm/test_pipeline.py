"""The stages against plain versions of what they keep, and the queries that have SQL against it."""

from __future__ import annotations

import duckdb
import public_tokenizers as P
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_neardup import brute
from tidelens.llm import language, private, quality, queries
from tidelens.llm.common import crc32_of_id

SF = "/root/testdata/sf0.001"


def test_stages(spark, documents, tmp_path):
    docs, columns = documents, documents.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        rows, kept = {r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in out.collect()}
        if name != "packing":
            assert out.columns == columns
        if name == "language":
            s = language.space(1024, 1)
            prototypes = language.profiles(docs, crc32_of_id() % 3 != 1)
            assert set(kept) == {d for d, r in rows.items() if max(float(s.bundle(*language.np.unique(language.trigrams(r.text), return_counts=True)) @ v) / float(language.np.linalg.norm(s.bundle(*language.np.unique(language.trigrams(r.text), return_counts=True)))) for v in prototypes.values()) >= corpus_pipeline.LEAST_LANGUAGE}
        elif name == "quality":
            c = queries.quality_classifier(spark, docs, SF)
            assert set(kept) == {d for d, r in rows.items() if c.score(r.text) >= 0.3}
        elif name == "near-duplicates":
            assert set(kept) == {d for d, (_, root) in brute([(d, r.text) for d, r in rows.items()], 5).items() if d == root}
        elif name == "private data":
            assert set(kept) == set(rows) and all(r.n_chars == len(r.text) for r in kept.values())
            assert all(not r.base for r in private.find(out, {}).collect())
        elif name == "packing":
            t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
            tokens = {d: len(t.encode(r.text, add_special_tokens=False).ids) + 1 for d, r in rows.items()}
            assert {r.doc_id: r.doc_tokens for r in kept.values()} == tokens and sum(r.length for r in out.collect()) == sum(tokens.values())
        docs = out


def test_stages_take_edges(spark, edges, nothing, tmp_path):
    """Tables with columns of the names that operators add, with repeated rows, and without rows."""
    more = {"n_chars": F.lit(0).cast("long"), "source": F.lit("s"), "lang_pred": F.lit(1), "n_words": F.lit("n"), "__text": F.lit("t"), "component_id": F.lit(7)}
    rows = edges.withColumns(more)
    for k, docs in enumerate((rows, rows.limit(0))):
        columns, count = docs.columns, None
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, docs, SF).write.parquet(str(tmp_path / f"{k}-{name}"))
            docs = spark.read.parquet(str(tmp_path / f"{k}-{name}"))
            assert name == "packing" or docs.columns == columns
            count = docs.count() if name == "near-duplicates" else count
        assert not k or (docs.count(), count) == (0, 0)


def test_repeated_rows(spark):
    words = " ".join(f"w{i}" for i in range(30))
    rows = [(1, words), (1, words), (2, words), (3, "other words of some text"), (3, "again other words, not alike"), (4, None), (4, None), (5, ""), (None, words), (6, words + " x")]
    kept = corpus_pipeline.one_of_each(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    assert sorted(map(tuple, kept), key=repr) == sorted([(1, words), (3, rows[3][1]), (3, rows[4][1]), (4, None), (5, ""), (None, words)], key=repr)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_sql(spark):
    con = duckdb.connect()
    for t in ("pages", "labels", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        got = queries.queries()[name](spark, SF)
        found = con.execute(sql)
        names = [c[0] for c in found.description]
        assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, found.fetchall()))


def test_content_rule_is_learned_from_all_labels(spark, documents):
    assert queries.content_field(spark, documents, SF).weights.any()
    assert isinstance(queries.quality_classifier(spark, documents, SF), quality.Classifier)
