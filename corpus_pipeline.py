"""From raw documents to packed sequences: language, quality, near-duplicates, personal data, packing."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelens.llm import language, neardup, packing, private, quality, queries
from tidelens.llm.common import crc32_of_id
from tidelens.sources.folders import Scratch

#: Rows of an Arrow batch. The executor and its Python workers hold some batches at once, next to what workers keep from
#: one stage to the next, and texts may be long.
BATCH_ROWS = 1000
#: Documents whose best language has a smaller cosine are in none of the learned ones.
LEAST_LANGUAGE = 0.1


def _in_small_batches(stage):
    """The stage, with smaller Arrow batches in its session from then on."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        return stage(spark, docs, sf_dir)

    return run


def _numbered(docs: DataFrame) -> tuple[DataFrame, tuple[str, ...], str]:
    """The rows with columns by number, which clash with no name that an operator adds; these names; that of the text."""
    names = tuple(f"c{i}" for i in range(len(docs.columns)))
    return docs.toDF(*names), names, names[docs.columns.index("text")]


def _named(found: DataFrame, docs: DataFrame) -> DataFrame:
    return found.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))


@_in_small_batches
def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that have no letter (null, empty and blank texts among them), or whose letters are those of no
    learned language. Where no language can be learned, nothing is known against a document, and all stay. Repeated rows
    share their fate; further columns of any name stay as they are."""
    prototypes = language.profiles(docs, crc32_of_id() % 3 != 1)
    if not prototypes:
        return docs
    rows, names, text = _numbered(docs)
    found = language.identify(rows, prototypes, text=text, keep=names)
    return _named(found.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE)), docs)


@_in_small_batches
def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that the line field's classifier gives label 0. Null and empty texts have the score of a text
    without lines, by which they stay or go; repeated rows share their fate; further columns of any name stay as they are."""
    rows, names, text = _numbered(docs)
    found = quality.score(rows, queries.quality_classifier(spark, docs, sf_dir), text=text, keep=names)
    return _named(found.filter(F.col("score") >= queries.LEAST_QUALITY), docs)


@_in_small_batches
def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the document with the smallest id: five-word shingles, similarity 0.8.

    Of rows with equal id and text one stays. An id that rows of different texts have stays, with all of these, if it is
    the smallest of the component of one of them. Null, empty and blank texts are like no other and stay, and so do rows without an id.
    """
    found = neardup.near_duplicates(docs.select("doc_id", "text")).filter("doc_id is not null")
    ids = found.groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    once = docs.join(ids.filter("not kept or n > 1").select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    again = docs.join(ids.filter("kept and n > 1").select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
    return once.unionByName(again.dropDuplicates(["doc_id", "text"]))


@_in_small_batches
def without_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with its personal data replaced; n_chars follows the text. A null text stays null, and so does its
    n_chars; repeated rows and further columns stay as they are."""
    return private.redact(docs, private.learn(docs)).withColumn("n_chars", F.length("text").cast("long"))


@_in_small_batches
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document that is left, cut into sequences. A null or empty text has the end's id alone; repeated rows are
    packed each; further columns are left out."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", known_language),
    ("quality", good_quality),
    ("near-duplicates", one_of_each),
    ("private data", without_private_data),
    ("packing", packed),
]

#: Learned models, near-duplicate components and token ids are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage on what the one before has written, in the folder that the cluster shares; a stage's rows go when the next are written."""
    scratch, docs = Scratch(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, scratch.keep(stage(spark, docs, sf_dir))
        if k:
            scratch.drop(before)
    return docs
