"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidelens.sources.folders import shared_folder

#: Rows of one Arrow slice: it bounds what a Python worker holds besides its input batch.
SLICE_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, by a path that only Spark has to understand."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """The rows, written to the shared checkpoint folder and read from there, so that a lost executor costs no rerun."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def byte_rows(column: pa.Array) -> list[bytes | None]:
    """A string column's rows as UTF-8."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def text_rows(column: pa.Array) -> list[str | None]:
    """A string column's rows; bytes that are no UTF-8 become U+FFFD."""
    return [None if x is None else x.decode("utf-8", "replace") for x in byte_rows(column)]


def map_slices(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType, rows: int = SLICE_ROWS) -> DataFrame:
    """f on small slices of the rows, in a Python worker, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, rows):
            yield f(part)

    return df.mapInArrow(run, schema)


def with_text(df: DataFrame, text: str, keep: tuple[str, ...]) -> tuple[DataFrame, int, str]:
    """The columns of keep, and the text unless it is among them; the text's place; the schema of keep."""
    kept = df.select(*keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return (kept, keep.index(text), schema) if text in keep else (df.select(*keep, F.col(text).alias("__text")), len(keep), schema)


def crc32_of_id(doc_id: str = "doc_id"):
    """crc32 of an id as text; an id that is null counts as 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(0))
