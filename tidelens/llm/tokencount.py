"""Token counts by a digest cache: what was counted once is never encoded again."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelens.llm.common import map_slices, text_rows
from tidelens.sources.folders import Scratch

#: Cells of the bitmap of digests that need a look-up; each has 64 bits, so it takes some 4 MB at most.
BITMAP_CELLS = 1 << 18
#: Texts longer than this, in characters, are encoded one by one.
LONG_TEXT = 100_000


@lru_cache(maxsize=2)
def counter_of(path: str) -> Callable[[list[str]], list[int]]:
    """Counts of tokens as the library gives them for the file: tokenizers for .json, sentencepiece for .model."""
    if path.endswith(".model"):
        from sentencepiece import SentencePieceProcessor

        pieces = SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)]
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    encode = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
    return lambda texts: [len(x) for x in encode(texts, add_special_tokens=False)]


def version_of(path: str) -> str:
    """A digest of all that a count depends on besides the text: the tokenizer's file, the library and its version."""
    import importlib.metadata

    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    with open(path, "rb") as f:
        said = hashlib.sha256(f.read())
    said.update(f"{library} {importlib.metadata.version(library)} plain".encode())
    return said.hexdigest()


class Cache:
    """Counts by digest in a folder that all machines share, one sub-folder for each tokenizer version and batch.

    A batch appears whole or not at all. Two writers may both append a digest; they then say the same, so readers take
    any of the two.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def counts(self, version: str) -> DataFrame:
        """digest and n_tokens."""
        there = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{version}")
        schema = "digest binary, n_tokens long"
        if not there.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(there):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{self.folder}/{version}")
        return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    def append(self, version: str, counts: DataFrame) -> None:
        counts.select("digest", "n_tokens").write.parquet(f"{self.folder}/{version}/{uuid.uuid4().hex}")


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _cell(digest: Column) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(BITMAP_CELLS))


def _bit(digest: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(digest, F.lit(1)), F.lit(64)).cast("int"))


def _marks(of: Column, name: str, df: DataFrame) -> DataFrame:
    """Which bits of the bitmap a column's values set: cell and, as `name`, its bits."""
    return F.broadcast(df.groupBy(_cell(of).alias("cell")).agg(F.bit_or(_bit(of)).alias(name)))


def _marked(df: DataFrame, of: Column, bits: DataFrame, name: str) -> DataFrame:
    """Adds `name`, whether a value's bit is set: always for values that set it, by chance for some others."""
    found = df.withColumn("cell", _cell(of)).join(bits, "cell", "left").drop("cell")
    return found.withColumn(name, F.coalesce(F.col(name).bitwiseAND(_bit(of)) != 0, F.lit(False)))


def _encoded(rows: DataFrame, path: str) -> DataFrame:
    """The rows (digest, n_bytes, row, t) with n_tokens in the place of t, encoded in a Python worker, without a shuffle."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        count, texts = counter_of(path), text_rows(part.column(3))
        short = [i for i, x in enumerate(texts) if len(x) <= LONG_TEXT]
        found = dict(zip(short, count([texts[i] for i in short]), strict=True))
        for i in set(range(len(texts))) - found.keys():
            found[i] = count([texts[i]])[0]
        counts = pa.array([found[i] for i in range(len(texts))], pa.int64())
        return pa.RecordBatch.from_arrays([*part.columns[:3], counts], schema=pa.schema([*list(part.schema)[:3], pa.field("n_tokens", pa.int64())]))

    schema = rows.drop("t").schema.add("n_tokens", "long")
    return map_slices(rows.select("digest", "n_bytes", "row", "t"), run, schema, rows=64)


def count_tokens(df: DataFrame, path: str, cache: Cache, limit: int = 1024, text: str = "text", keep: tuple[str, ...] = ("doc_id",), normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """Adds n_bytes (of UTF-8), n_tokens and over_limit (more than `limit` tokens) to the columns of keep.

    path: the tokenizer's file. The library's defaults hold for strings of special tokens inside texts; none are added,
    nothing is cut or padded. normalise: what the tokenizer does not tell apart may be made equal here before the digest
    is taken (as F.lower for one that lower-cases); by default a text is taken as it is, as any change can change a
    count of a tokenizer that keeps case and white space. The cache's key is the SHA-256 of the content and the version
    of the tokenizer.

    Digests are counted first, without texts being moved. A text whose digest is neither in the cache nor found twice
    is encoded where it is read. Of the others, those that the cache lacks are encoded once: one row stands for
    each, the one whose kept columns have the least hash. Which of the two a digest is, a bitmap of fixed size tells where texts are
    read; digests that share a bit with one of the others are looked up like them, so a full bitmap costs a shuffle of
    more texts and no count. New counts are appended to the cache. At last digests, not texts, are joined with counts;
    the digests of more than a 1024th of all rows, which are fewer than 1024, are broadcast, so no task has all their rows.

    A null text is empty: 0 bytes, 0 tokens. Bytes that are no UTF-8 count as U+FFFD for the tokenizer. Repeated rows
    are answered each; other columns are left out, whatever their names; those of keep may have any name besides
    n_bytes, n_tokens and over_limit. An empty table gives an empty one.
    """
    spark, version, scratch = df.sparkSession, version_of(path), Scratch(df.sparkSession, "tokencount")
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    t = t if normalise is None else normalise(t)
    row = F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(keep)))
    texts = df.select(digest_of(t).alias("digest"), F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_bytes"), row.alias("row"), t.alias("t"))
    digest, who = F.col("digest"), F.xxhash64("row")

    rows = scratch.keep(texts.drop("t"))
    often_from = scratch.rows(rows) / 1024
    seen = rows.groupBy("digest").agg(F.count("*").alias("n"), F.min(who).alias("who"))
    known = cache.counts(version).withColumnRenamed("n_tokens", "cached")
    seen = scratch.keep(seen.join(known, "digest", "left"))
    again = _marks(digest, "again", seen.filter("n > 1 or cached is not null"))
    alone = scratch.keep(_encoded(_marked(texts, digest, again, "again").filter("not again").drop("again"), path))

    misses = scratch.keep(_marked(seen.filter("cached is null"), digest, again, "again").filter("again").select("digest", "who"))
    likely = _marked(texts.withColumn("who", who), F.col("who"), _marks(F.col("who"), "stands", misses), "stands").filter("stands").drop("stands")
    chosen = likely.join(misses, ["digest", "who"]).drop("who")
    several = scratch.keep(_encoded(chosen, path).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")))
    cache.append(version, alone.select("digest", "n_tokens").unionByName(several))

    counts = several.unionByName(seen.filter("cached is not null").select("digest", F.col("cached").alias("n_tokens")))
    often = F.broadcast(seen.filter(F.col("n") > often_from).select("digest"))
    rest = _marked(rows, digest, again, "again").filter("again").drop("again")
    found = rest.join(F.broadcast(counts.join(often, "digest")), "digest").unionByName(rest.join(often, "digest", "left_anti").join(counts, "digest"))
    out = alone.unionByName(found)
    return out.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(keep)), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
