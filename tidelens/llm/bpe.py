"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue."""

from __future__ import annotations

import base64
import re
from array import array
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidelens.llm.common import byte_rows, map_slices, text_rows, with_text

#: The pattern that splits text before the merges of many public rank files.
_KNOWN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Texts of these characters alone are split by the standard library: among them, _LETTERS are the letters, 0-9 the
#: numbers, space and line feed the white space, and _PLAIN_SPLIT finds what _KNOWN finds.
_PLAIN = re.compile(f"[\n -~{_LETTERS}]*")
_PLAIN_SPLIT = re.compile(f" ?[{_LETTERS}]+| ?[0-9]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^ \n0-9{_LETTERS}]+|[ \n]+(?![^ \n])|[ \n]+").findall
#: Entries of each of the cache's two generations.
CACHE_ENTRIES = 300_000


class RankQueue:
    """Positions by merge rank, lowest rank first, then leftmost position.

    A bucket for each rank holds the positions; three levels of 64-bit words say which buckets have any, so the next
    rank is found by three find-first-set steps, whatever the number of entries. Entries are never removed when a
    neighbour's merge makes them stale: the caller skips those as they come up.
    """

    def __init__(self, ranks: int) -> None:
        self.low = [0] * ((ranks >> 6) + 1)
        self.mid = [0] * ((ranks >> 12) + 1)
        self.top = 0
        self.buckets: dict[int, int | list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = position  # most buckets never hold a second one
            a = rank >> 6
            b = rank >> 12
            self.low[a] |= 1 << (rank & 63)
            self.mid[b] |= 1 << (a & 63)
            self.top |= 1 << b
        elif bucket.__class__ is int:
            self.buckets[rank] = [bucket, position] if bucket < position else [position, bucket]
        else:
            heappush(bucket, position)

    def pop(self) -> tuple[int, int]:
        """The lowest rank and its leftmost position, taken away. The queue must not be empty."""
        top = self.top
        b = (top & -top).bit_length() - 1
        word = self.mid[b]
        a = (b << 6) + (word & -word).bit_length() - 1
        word = self.low[a]
        rank = (a << 6) + (word & -word).bit_length() - 1
        bucket = self.buckets[rank]
        if bucket.__class__ is not int:
            position = heappop(bucket)
            if bucket:
                return rank, position
        else:
            position = bucket
        del self.buckets[rank]
        word &= word - 1
        self.low[a] = word
        if not word:
            self.mid[b] = word = self.mid[b] & (self.mid[b] - 1)
            if not word:
                self.top = top & (top - 1)
        return rank, position


class Encoder:
    """ranks: bytes to id. pattern: what splits a text before the merges."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        self.ranks, self.split, self.known = ranks, regex.compile(pattern).findall, pattern == _KNOWN
        self.queue = RankQueue(max(ranks.values()) + 1)
        self.vocabulary: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.vocabulary[rank] = token
        self.pieces: tuple[dict, dict] = ({}, {})

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        ranks, n = self.ranks, len(piece)
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        get, queue = ranks.get, self.queue
        push, pop = queue.push, queue.pop
        ids = [ranks[piece[i : i + 1]] for i in range(n)]
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        pair = [-1] * n  # the rank of a position with its successor; -1: none, or the position is gone
        for i in range(n - 1):
            if (rank := get(piece[i : i + 2])) is not None:
                pair[i] = rank
                push(rank, i)
        while queue.top:
            rank, i = pop()
            if pair[i] != rank:
                continue  # stale
            j = after[i]
            end = after[j]
            ids[i], after[i], pair[i], pair[j] = rank, end, -1, -1
            if end < n:
                before[end] = i
                if (new := get(piece[i : after[end]])) is not None:
                    pair[i] = new
                    push(new, i)
            if (h := before[i]) >= 0:
                if (new := get(piece[h:end])) is not None:
                    pair[h] = new
                    push(new, h)
                else:
                    pair[h] = -1
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def _piece(self, piece: str) -> bytes:
        fresh, old = self.pieces
        if (found := old.get(piece)) is None:
            found = array("I", self.merge(piece.encode("utf-8", "replace"))).tobytes()
        if len(piece) <= 64:
            fresh[piece] = found
            if len(fresh) >= CACHE_ENTRIES:
                self.pieces = ({}, fresh)
        return found

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit integers."""
        out: list[bytes] = []
        add, slow, get = out.append, self._piece, self.pieces[0].get
        for x in (_PLAIN_SPLIT if self.known and _PLAIN.fullmatch(text) else self.split)(text):
            if (found := get(x)) is None:
                found = slow(x)
                get = self.pieces[0].get
            add(found)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """The encoder of a rank file, once for each worker process."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return Encoder(ranks, pattern)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ids of each row's whole text in column ids: binary, little-endian unsigned 32-bit integers.

    path and pattern: a rank file and the pre-token pattern; the file is read on the executors, where the package that
    brings it is installed. A null or empty text has no ids. Each row is encoded by itself, so repeated rows are
    repeated; columns other than text and those in keep are left out, whatever their names. An empty table gives an
    empty one.
    """
    rows, at, kept = with_text(df, text, keep)
    schema = f"{kept}, `{ids}` binary"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        e = encoder(path, pattern)
        found = [b"" if x is None else e.encode(x) for x in text_rows(batch.column(at))]
        return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(found, pa.binary())], [*keep, ids])

    return map_slices(rows, run, schema)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Adds the bytes that each row's ids stand for; null ids stand for no bytes. An unknown id is an error."""
    names = [c for c in df.columns if c != into]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*names).schema) + f", `{into}` binary"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        e = encoder(path, pattern)
        found = [b"" if x is None else e.decode(x) for x in byte_rows(batch.column(names.index(ids)))]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], [*names, into])

    return map_slices(df.select(*names), run, schema)
