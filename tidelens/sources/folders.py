"""The folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names in spark.checkpoint.dir. Where none is named, as in tests, a
    temporary one, which only a master on this machine alone can do with."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="shared-"))
    return context.getCheckpointDir()


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder of any file system that Spark knows; one that is not there is as good as deleted."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def _file_system(spark: SparkSession, path: str):
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()), there


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """The names of what a folder holds, in order; none if it is not there."""
    files, there = _file_system(spark, folder)
    return sorted(x.getPath().getName() for x in files.listStatus(there)) if files.exists(there) else []


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file, which appears whole or not at all."""
    files, there = _file_system(spark, path)
    _, part = _file_system(spark, f"{there.getParent()}/_{uuid.uuid4().hex}")
    out = files.create(part)
    out.write(bytearray(text.encode()))
    out.close()
    if files.exists(there):
        files.delete(there, False)
    if not files.rename(part, there):
        raise OSError(f"could not write {path}")


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None if it is not there."""
    files, there = _file_system(spark, path)
    if not files.exists(there):
        return None
    found = files.open(there)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(found)).decode()
    finally:
        found.close()


class Scratch:
    """Tables of a computation in a folder of their own below the shared one: a step's rows are written once and read
    from there, so that a lost executor costs no rerun and no plan grows with the number of steps."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.folder, self._tables = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", {}

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self._tables[id(table)] = [table, path, None]
        return table

    def rows(self, table: DataFrame) -> int:
        """How many rows a kept table has; the files' footers tell."""
        kept = self._tables[id(table)]
        if kept[2] is None:
            kept[2] = table.count()
        return kept[2]

    def gathered(self, table: DataFrame, most: int) -> DataFrame:
        """A kept table, to be read by one task if it is that small: grouping and joining it then needs no shuffle, whose
        hundreds of tasks would have next to no rows each."""
        return table.coalesce(1) if self.rows(table) <= most else table

    def collect_garbage(self) -> None:
        """Spark frees shuffle files, broadcasts and plans of steps that are done when the driver's garbage is collected,
        which a loop of many small jobs may not see for long."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            delete(self.spark, self._tables.pop(id(table))[1])

    def clear(self) -> None:
        self._tables.clear()
        delete(self.spark, self.folder)
