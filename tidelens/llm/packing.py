"""Packing by power-of-two decomposition: every piece of a document is a sequence of its own."""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelens.llm.common import map_slices, text_rows

_LETTERS = "a-zß-öø-ÿ"
#: Texts whose lower case has these characters alone are split here: white space is dropped, and each part that
#: _PLAIN_SPLIT finds is a token or more of its own, whatever stands near it.
_PLAIN = re.compile(f"[\n -@\\[-~{_LETTERS}]*")
_PLAIN_SPLIT = re.compile(f"[{_LETTERS}]+|[0-9]|'s|'t|'re|'ve|'m|'ll|'d|[^ \n0-9{_LETTERS}]+").findall
#: Entries of each of the cache's two generations.
CACHE_ENTRIES = 300_000


class Ids:
    """Ids of a text as its tokenizer gives them, with what it gave for a word kept."""

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.parts: tuple[dict, dict] = ({}, {})
        probe = "Été, thaner. The| of!! ß%%% it's 12 A-B Ünd; '' .'s\nx 's"
        self.by_part = self._ask(probe) == b"".join(map(self._ask, _PLAIN_SPLIT(probe.lower())))
        self.special = {x.content for x in self.tokenizer.get_added_tokens_decoder().values()}

    def _ask(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _part(self, part: str) -> bytes:
        fresh, old = self.parts
        if (found := old.get(part)) is None:
            found = self._ask(part)
        if len(part) <= 64:
            fresh[part] = found
            if len(fresh) >= CACHE_ENTRIES:
                self.parts = ({}, fresh)
        return found

    def __call__(self, text: str) -> bytes:
        """Little-endian 32-bit ids. A tokenizer that does not split as _PLAIN_SPLIT does gets every text as a whole,
        and so do texts with other characters, or with the strings of special tokens."""
        low = text.lower()
        if not self.by_part or not _PLAIN.fullmatch(low) or any(x in text for x in self.special):
            return self._ask(text)
        out: list[bytes] = []
        add, get = out.append, self.parts[0].get
        for x in _PLAIN_SPLIT(low):
            if (found := get(x)) is None:
                found = self._part(x)
                get = self.parts[0].get
            add(found)
        return b"".join(out)


@lru_cache(maxsize=2)
def ids_of(path: str) -> Ids:
    return Ids(path)


def cuts(tokens: int, longest: int) -> list[int]:
    """Lengths of a document's pieces, in order: as many of the longest as fit, then the binary digits of the rest."""
    rest = tokens % longest
    return [longest] * (tokens // longest) + [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]


def pack(df: DataFrame, path: str, end_id: int = 2, longest: int = 4096, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Cuts each row's token ids, with end_id last, into pieces whose lengths are powers of two.

    A piece is a whole sequence of its bucket: the buckets hold sequences of 1, 2, 4, ... longest ids, so a batch drawn
    from one bucket needs no padding, and no sequence holds ids of two documents. longest must be a power of two.

    Columns: doc_id, start (ids before the piece in its row), length, ids (binary, little-endian unsigned 32-bit),
    doc_tokens, bucket (log2 of the length), sequence_id, offset (0). sequence_id is unique, and sequence_id modulo
    64 is the bucket. It follows from the order of the input's partitions and rows; no shuffle is needed.

    A null or empty text has the end id alone. A row with a null id, or an id that others have, is packed like any
    other, with sequences of its own. Other columns are left out; an empty table gives an empty one.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, bucket int"
    last = np.array([end_id], "<u4").tobytes()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = ids_of(path)
        out: list[tuple] = []
        for doc, x in zip(batch.column(0).to_pylist(), text_rows(batch.column(1)), strict=True):
            packed = (ids(x) if x else b"") + last
            n, start = len(packed) // 4, 0
            for length in cuts(n, longest):
                out.append((doc, start, length, packed[4 * start : 4 * (start + length)], n, length.bit_length() - 1))
                start += length
        columns = list(zip(*out, strict=True)) or [()] * 6
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32())
        names = ("doc_id", "start", "length", "ids", "doc_tokens", "bucket")
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], list(names))

    pieces = map_slices(rows, run, schema)
    return pieces.withColumns({"sequence_id": F.monotonically_increasing_id() * 64 + F.col("bucket"), "offset": F.lit(0).cast("long")})


def write_buckets(packed: DataFrame, path: str) -> None:
    """One folder for each bucket, as a loader that draws whole batches from a bucket wants it."""
    packed.select("sequence_id", "ids", "bucket").write.partitionBy("bucket").parquet(path)
