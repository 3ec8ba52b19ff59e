"""Where live messages come from: a feed with numbered messages, and frames that are put together."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.window import Window

from tidelens.sources.http import ask

FORMAT = "ais_feed"
# The boxes (south-west and north-east corner, latitude first) and message types that are subscribed to.
BOXES = (((30.0, -6.5), (46.0, 36.5)), ((40.5, 26.5), (47.5, 42.0)))
TYPES = ("PositionReport", "ShipStaticData")


@dataclass
class Range(InputPartition):
    """Messages from `after` on, before `upto`."""

    after: int
    upto: int


class FeedReader(DataSourceStreamReader):
    """Offsets are the feed's own numbers, so a batch that is done again has the same messages; the feed keeps them at
    least as long as a stream may be down."""

    def __init__(self, options: dict) -> None:
        self.url, self.headers = options["url"], json.loads(options.get("headers", "{}"))
        self.asked = {"boxes": options.get("boxes", json.dumps(BOXES)), "types": options.get("types", json.dumps(TYPES))}
        self.first = options.get("start", "0")
        self.per_task, self.per_batch = int(options.get("per_task", 10_000)), int(options.get("per_batch", 1_000_000))
        self.at: int | None = None

    def _last(self) -> int:
        found = ask(self.url, {"resource": "last"}, self.headers)
        if found is None or not found.get("ok"):
            raise ValueError(f"{self.url} does not tell its last message: {found}")
        return int(found["last"])

    def initialOffset(self) -> dict:
        return {"at": self._last() if self.first == "latest" else int(self.first)}

    def latestOffset(self) -> dict:
        last = self._last()
        if self.at is not None:  # else a stream comes up; its checkpoint tells how far it was
            last = min(last, self.at + self.per_batch)
        return {"at": last}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        self.at = end["at"]
        return [Range(a, min(a + self.per_task, end["at"])) for a in range(start["at"], end["at"], self.per_task)]

    def commit(self, end: dict) -> None:
        self.at = end["at"]

    def read(self, partition: Range) -> Iterator[tuple]:
        at = partition.after
        while at < partition.upto:
            found = ask(self.url, {"resource": "messages", "after": at, "upto": partition.upto, **self.asked}, self.headers)
            if found is None or not found.get("ok"):
                raise ValueError(f"no messages from {self.url}: {found}")
            yield from ((text, number) for number, text in found["data"])
            upto = int(found.get("upto", partition.upto))  # a feed may answer in parts
            if upto <= at:
                raise ValueError(f"{self.url} does not go on after message {at}")
            at = upto


class Feed(DataSource):
    """Options: url, headers, boxes and types (JSON; what is subscribed to), start (a message's number, or latest), per_task, per_batch."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "value string, seq bigint"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FeedReader(dict(self.options))


def from_feed(spark: SparkSession, url: str, boxes=BOXES, types=TYPES, **options) -> DataFrame:
    """A stream of messages (value, and seq, their number) for a collector."""
    spark.dataSource.register(Feed)
    asked = {"url": url, "boxes": json.dumps(boxes), "types": json.dumps(types)} | {k: str(v) for k, v in options.items()}
    return spark.readStream.format(FORMAT).options(**asked).load()


_PUT_TOGETHER = "connection string, number bigint, value string"


def put_together(frames: DataFrame) -> DataFrame:
    """connection, number (from 0) and value of each message that frames bring: connection, seq, data (bytes), ends (the
    last frame of a message), closes (the connection ends; what was begun is lost).

    A message may be cut anywhere, inside a character too, so bytes are put together before they are read as UTF-8; bytes
    that are none become U+FFFD. In a stream, the begun message of each connection is kept as state from one batch to the
    next, and forgotten when the connection closes; frames of a connection come in the order of seq, at least from batch to
    batch. A null data is empty; null flags are false.
    """
    rows = frames.select(F.col("connection").cast("string").alias("connection"), "seq", F.coalesce(F.col("data").cast("binary"), F.lit(b"")).alias("data"), *(F.coalesce(c, F.lit(False)).alias(c) for c in ("ends", "closes")))
    if frames.isStreaming:
        return rows.groupBy("connection").applyInPandasWithState(_go_on, _PUT_TOGETHER, "begun binary, number long", "append", "NoTimeout")
    order = Window.partitionBy("connection").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(F.col(c).cast("long")).over(order), F.lit(0).cast("long"))
    numbered = rows.withColumn("closed", before("closes")).withColumn("number", before("ends"))
    own = F.array_sort(F.collect_list(F.struct("seq", "data", "ends", "closes")))
    whole = numbered.groupBy("connection", "closed", "number").agg(own.alias("own"), F.max("ends").alias("ended"))
    data = F.aggregate(F.filter("own", lambda x: ~x["closes"]), F.lit(b""), lambda a, x: F.concat(a, x["data"]))
    return whole.filter("ended").select("connection", "number", F.make_valid_utf8(data.cast("string")).alias("value"))


def _go_on(key, parts, state):
    import pandas as pd

    begun, number = state.get if state.exists else (b"", 0)
    frames = pd.concat(list(parts)).sort_values("seq", kind="stable")
    values, pieces, closed = [], [bytes(begun)], False
    for data, ends, closes in zip(frames["data"], frames["ends"], frames["closes"], strict=True):
        closed = bool(closes)
        if closes:
            pieces = []
            continue
        pieces.append(bytes(data))
        if ends:
            values.append(b"".join(pieces).decode("utf-8", "replace"))
            pieces = []
    first, number = number, number + len(values)
    if closed:
        state.remove()
    else:
        state.update((b"".join(pieces), number))
    yield pd.DataFrame({"connection": key[0], "number": range(first, number), "value": values})
