"""Near-duplicates by a chosen-path set similarity join."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelens.llm.common import byte_rows, map_slices
from tidelens.sources.folders import Scratch

#: Minwise tokens of a document, and bytes of each. Each tree branches by TREE_TOKENS of its own. Documents that have
#: nothing in common meet by chance where a token has as few values as there are documents.
TOKENS = 256
TOKEN_BYTES = 3
TREE_TOKENS = 21
#: Documents of one block of a node that stays large.
BLOCK = 1536
#: Rows of a table that is broadcast, or worked on by one task, at most (some 2 MB, 12 MB with sketches); larger ones are shuffled.
BROADCAST_ROWS = 100_000
_SKETCH = ("s0", "s1", "s2", "s3")


@lru_cache(maxsize=1)
def _seeds() -> np.ndarray:
    return np.random.default_rng(20260101).integers(0, 2**63, 2 * TOKENS, np.uint64)


#: Words longer than this, in bytes, are hashed one by one; a text is read in pieces of about PIECE bytes, cut between words.
LONG_WORD, PIECE = 4096, 1 << 20
_BLANK = re.compile(rb"[ \t-\r]")


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By byte, whether it is white space, and its number (capitals have that of their small letter, white space 0); the weights of places in a word."""
    rng = np.random.default_rng(20260202)
    numbers = rng.integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
    numbers[65:91] = numbers[97:123]
    blank = np.zeros(256, bool)
    blank[[*range(9, 14), 32]] = True
    numbers[blank] = 0
    weights = np.cumprod(np.full(LONG_WORD, rng.integers(1, 2**62), np.uint64) * np.uint64(2) + np.uint64(1))
    return blank, numbers, weights


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of a text's words, in order: what ASCII white space separates, lower-cased in A-Z."""
    blank, numbers, weights = _letters()
    out, at = [np.empty(0, np.uint64)], 0
    while at < len(text):
        cut_ = _BLANK.search(text, at + PIECE)
        piece = text[at : cut_.start() if cut_ else len(text)]
        at += len(piece) + 1
        b = np.frombuffer(piece, np.uint8)
        inside = np.zeros(len(b) + 2, bool)
        np.logical_not(blank[b], out=inside[1:-1])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, lengths = edges[::2], edges[1::2] - edges[::2]
        if not len(starts):
            continue
        b = b[starts[0] :]
        starts = starts - starts[0]
        place = np.arange(len(b)) - np.repeat(starts, np.diff(starts, append=len(b)))
        h = _mixed(np.add.reduceat(numbers[b] * weights[np.minimum(place, LONG_WORD - 1)], starts))
        for i in np.flatnonzero(lengths > LONG_WORD):
            h[i] = xxhash.xxh64_intdigest(piece[edges[2 * i] : edges[2 * i + 1]].lower())
        out.append(h)
    return np.concatenate(out)


def shingles(text: bytes | None, words: int) -> np.ndarray:
    """The set of a text's shingles, as sorted 64-bit hashes.

    The text is lower-cased in A-Z; its words are what ASCII white space separates. With fewer words than a shingle
    has, the whole sequence is one; without words the set is empty.
    """
    h = word_hashes(text or b"")
    if not len(h):
        return h
    n = min(words, len(h))
    total = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        total = (total ^ h[k : len(h) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
    total.sort()
    return total[np.append(True, total[1:] != total[:-1])]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def minwise(found: np.ndarray) -> np.ndarray:
    """TOKENS values, each equal in two sets with a chance of their similarity.

    In every round each member falls into one of TOKENS bins; a bin keeps the least value of the first round that
    reaches it. A large set fills all bins in one round. After TOKENS rounds, bins that are still empty take the least
    value of a round of their own.
    """
    out, filled = np.zeros(TOKENS, np.uint64), np.zeros(TOKENS, bool)
    seeds, at = _seeds(), 0
    while at < TOKENS and not filled.all():
        rounds = min(TOKENS - at, -(-2048 // len(found)))
        v = _mixed(found[None, :] ^ seeds[at : at + rounds, None])
        order = np.arange(rounds, dtype=np.uint64)[:, None] << np.uint64(48)
        v = np.sort(((v & np.uint64(0xFF << 56)) | order | (v & np.uint64((1 << 48) - 1))).ravel())
        bins = (v >> np.uint64(56)).astype(np.intp)
        first = np.flatnonzero(np.append(True, bins[1:] != bins[:-1]))
        new = first[~filled[bins[first]]]
        out[bins[new]] = v[new] & np.uint64((1 << 48) - 1)
        filled[bins[new]] = True
        at += rounds
    for i in np.flatnonzero(~filled):
        out[i] = _mixed(found ^ seeds[TOKENS + i]).min() & np.uint64((1 << 48) - 1)
    return out


def _profiles(part: pa.RecordBatch, words: int) -> pa.RecordBatch:
    ids, sizes, prints, tokens, sketches = [], [], [], [], []
    for doc, text in zip(part.column(0).to_pylist(), byte_rows(part.column(1)), strict=True):
        found = shingles(text, words)
        ids.append(doc)
        sizes.append(len(found))
        if not len(found):
            prints.append(None)
            tokens.append(None)
            sketches.append((None,) * len(_SKETCH))
            continue
        prints.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
        least = minwise(found)
        tokens.append(least.astype("<u8").view(np.uint8).reshape(TOKENS, 8)[:, :TOKEN_BYTES].tobytes())
        sketches.append(np.packbits(((least >> np.uint64(26)) & np.uint64(1)).astype(np.uint8)).view("<i8").tolist())
    arrays = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(tokens, pa.binary())]
    arrays += [pa.array(list(x), pa.int64()) for x in zip(*sketches, strict=True)] if sketches else [pa.array([], pa.int64())] * len(_SKETCH)
    return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_shingles", "print", "tokens", *_SKETCH])


_PROFILE = "doc_id long, n_shingles long, print binary, tokens binary, " + ", ".join(f"{s} long" for s in _SKETCH)


def _bits(a: str, b: str) -> Column:
    """In how many of the TOKENS two documents' 1-bit sketches differ."""
    return sum((F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))) for s in _SKETCH), F.lit(0))


def _near(a: str, b: str, most_bits: int) -> Column:
    """Whether two sets can be similar enough: neither is less than 0.8 of the other, and the sketches are close."""
    x, y = F.col(f"{a}.size"), F.col(f"{b}.size")
    return (5 * F.least(x, y) >= 4 * F.greatest(x, y)) & (_bits(a, b) <= most_bits)


def _children(at: DataFrame, extra_in_1000: int) -> DataFrame:
    """The documents at the children of their nodes. A node chooses one token of its tree, and with a chance that the
    node decides a second; a document goes to the children that its values of these name. The choice is the node's, so
    documents at one node branch by the same tokens."""
    node, t = F.col("node"), F.col("t")
    one = F.pmod(F.xxhash64(node, F.lit(1)), F.lit(TREE_TOKENS)).cast("int")
    two = ((one + 1 + F.pmod(F.xxhash64(node, F.lit(2)), F.lit(TREE_TOKENS - 1)).cast("int")) % TREE_TOKENS).cast("int")
    child = lambda i: F.xxhash64(node, i, F.substring(t, TOKEN_BYTES * i + 1, F.lit(TOKEN_BYTES)))
    both = F.pmod(F.xxhash64(node, F.lit(3)), F.lit(1000)) < extra_in_1000
    return at.withColumn("node", F.explode(F.when(both, F.array(child(one), child(two))).otherwise(F.array(child(one)))))


def _looked_up(df: DataFrame, table: DataFrame | None, column: str, name: str, scratch: Scratch) -> DataFrame:
    """Adds the root of a column's documents as `name`; where the table (node, root) has none, it is the document itself."""
    if table is None:
        return df.withColumn(name, F.col(column))
    ups = table.select(F.col("node").alias(column), F.col("root").alias("__up"))
    ups = _small(ups, scratch.rows(table))
    return df.join(ups, column, "left").withColumn(name, F.coalesce("__up", column)).drop("__up")


def search(sets: DataFrame, full: Callable[[DataFrame], DataFrame], scratch: Scratch, percent: int = 80, trees: int = 12, most: int = 256, levels: int = 12, most_bits: int = 45, extra: int = 250) -> DataFrame | None:
    """node and root of the sets that links bring together with a smaller one; None if there is no link.

    sets: rep, tokens, size and the sketch, one row for each different set; full(ids) gives rep and set, the whole set, of
    the documents in ids (rep). Links are pairs whose whole sets have percent / 100 of their union in common, or more. In
    each of `trees` trees, documents branch by minwise tokens that the node chooses, 1 + extra / 1000 of them on average,
    which is the inverse of the similarity sought: a pair of that similarity meets in as many nodes at every depth.

    At every level, documents are first compared with the first of their node; the closest such pair of each document
    is confirmed and contracted. A node whose documents are of one component is done. If up to `most` (twice as many with
    every level, up to eight times) are outside its largest component, these are compared with all documents of other
    components there. At other nodes the documents branch again, and what is still large after `levels` levels is
    compared in full as well, in blocks. Comparing is left to the end, when few nodes still have two components.
    """
    forest = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(F.xxhash64(t).alias("node"), F.substring("tokens", TOKEN_BYTES * TREE_TOKENS * t + 1, F.lit(TOKEN_BYTES * TREE_TOKENS)).alias("t")))
    at = sets.select("rep", "size", *_SKETCH, F.explode(forest).alias("f")).select("rep", "size", *_SKETCH, "f.node", "f.t")
    roots, leaves, kept = None, [], []
    for depth in range(1, levels + 1):
        rows = _children(at, extra)
        nodes = scratch.keep(rows.groupBy("node").agg(F.count("*").alias("n"), F.min(F.struct("rep", "size", *_SKETCH)).alias("p")).filter("n > 1").drop("n"))
        met = scratch.keep(rows.alias("r").join(nodes, "node").select("node", "r.rep", "r.size", *(f"r.{s}" for s in _SKETCH), "t", F.col("p.rep").alias("pivot"), F.when((F.col("p.rep") != F.col("r.rep")) & _near("p", "r", most_bits), _bits("p", "r")).alias("bits")))
        here = scratch.gathered(met, BROADCAST_ROWS)
        closest = here.filter("bits is not null").groupBy("rep").agg(F.min(F.struct("bits", "pivot"))["pivot"].alias("a")).select("a", F.col("rep").alias("b"))
        pairs = scratch.keep(_looked_up(_looked_up(closest, roots, "a", "a_root", scratch), roots, "b", "b_root", scratch).filter("a_root <> b_root"))
        if scratch.rows(pairs):
            whole = scratch.keep(full(_small(_ends(pairs), 2 * scratch.rows(pairs))))
            found = _confirmed(_small(pairs, scratch.rows(pairs)), whole, percent)
            roots = _contracted(found.select(F.col("a_root").alias("a"), F.col("b_root").alias("b")), roots, scratch)
            scratch.drop(whole)
        parts = _looked_up(here.select("node", "rep"), roots, "rep", "root", scratch).groupBy("node", "root").agg(F.count("*").alias("n"))
        open_ = scratch.keep(parts.groupBy("node").agg((F.sum("n") - F.max("n")).alias("others")).filter("others > 0"))
        large = (F.col("others") > most * min(2 ** (depth - 1), 8)) & F.lit(depth < levels)
        left = scratch.keep(here.drop("pivot", "bits").join(open_.withColumn("large", large).drop("others"), "node"))
        scratch.drop(nodes, met, pairs, open_)
        scratch.collect_garbage()
        kept.append(left)
        leaves.append(left.filter("not large").drop("t", "large"))
        at = left.filter("large").drop("large")
        n = at.count()
        if not n:
            break
        if n <= BROADCAST_ROWS:
            at = at.coalesce(1)
    rows = leaves[0]
    for more in leaves[1:]:
        rows = rows.unionByName(more)
    rows = scratch.keep(_looked_up(rows, roots, "rep", "root", scratch))
    scratch.drop(*kept)
    return _contracted(_compared(rows, full, scratch, percent, most_bits), roots, scratch)


def _compared(rows: DataFrame, full: Callable[[DataFrame], DataFrame], scratch: Scratch, percent: int, most_bits: int) -> DataFrame:
    """a and b, the roots of linked documents, among those that are at one node and of different components.

    First only documents stay that the sketch lets pass with some other document of their node, then, of the nodes of a
    document, those where it is compared with such another: a pair is compared at one of its common nodes, which its ids
    choose, so that the pairs of a group spread over the group's nodes. What is left is compared on whole sets; that takes
    place in the join's condition, so what comes out of it are links, not pairs. This join is an outer one, since adaptive
    execution splits a crowded partition of such a join on the side of all documents alone; of an inner one it splits both,
    and makes a task of each piece with each other. A block of the others, which is bounded, stays whole.
    """
    sizes = rows.groupBy("node", "root").agg(F.count("*").alias("n")).groupBy("node").agg((F.sum("n") - F.max("n")).alias("others"), F.max_by("root", F.struct("n", "root")).alias("top"))
    tops = scratch.keep(sizes.filter("others > 0").select("node", "top", F.ceil(F.col("others") / BLOCK).cast("int").alias("blocks")))
    met = rows.join(tops, "node")
    others = met.filter("root <> top").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    here = met.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    together = (F.col("a.node") == F.col("b.node")) & (F.col("a.block") == F.col("b.block")) & (F.col("a.root") != F.col("b.root"))
    together = together & ((F.col("b.root") == F.col("b.top")) | (F.col("a.rep") < F.col("b.rep"))) & _near("a", "b", most_bits)

    def both(others: DataFrame, here: DataFrame, together: Column) -> tuple[DataFrame, DataFrame]:
        here = scratch.keep(here.alias("b").join(others.alias("a"), together, "left_semi"))
        return scratch.keep(others.alias("a").join(here.alias("b"), together, "left_semi")), here

    others, here = both(others.drop("blocks"), here.drop("blocks"), together)
    scratch.drop(rows, tops)
    at = scratch.keep(here.select("rep", "node").unionByName(others.select("rep", "node")).groupBy("rep").agg(F.array_sort(F.collect_set("node")).alias("nodes")))
    common = F.array_intersect("a.nodes", "b.nodes")
    place = F.pmod(F.xxhash64(F.least("a.rep", "b.rep"), F.greatest("a.rep", "b.rep")), F.size(common).cast("long")).cast("int") + 1
    together = together & (F.element_at(common, place) == F.col("a.node"))
    others, here = both(*(side.join(at, "rep") for side in (others, here)), together)
    whole = scratch.keep(full(_small(at.select("rep"), scratch.rows(at))))
    a, b = (side.join(whole, "rep").alias(name) for side, name in ((others, "a"), (here, "b")))
    found = b.join(a, together & _alike("a", "b", percent), "left_outer")
    return found.select(F.coalesce("a.root", "b.root").alias("a"), F.col("b.root").alias("b")).filter("a <> b")


def _small(df: DataFrame, rows: int) -> DataFrame:
    """To be broadcast if it has few enough rows (of some numbers each)."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _alike(a: str, b: str, percent: int) -> Column:
    """Whether percent / 100 of the union of two whole sets, or more, is in both."""
    return (100 + percent) * F.size(F.array_intersect(f"{a}.set", f"{b}.set")) >= percent * (F.size(f"{a}.set") + F.size(f"{b}.set"))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (columns a and b, and others) that are links."""
    one, other = sets.select(F.col("rep").alias("b"), F.struct("set").alias("y")), sets.select(F.col("rep").alias("a"), F.struct("set").alias("x"))
    return pairs.join(one, "b").join(other, "a").filter(_alike("x", "y", percent)).drop("x", "y")


def _contracted(links: DataFrame, roots: DataFrame | None, scratch: Scratch) -> DataFrame | None:
    """The roots after links among them."""
    links = scratch.keep(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    more = components(links, scratch)
    if roots is None or more is None:
        return roots if more is None else more
    moved = _looked_up(roots.select("node", F.col("root").alias("was")), more, "was", "root", scratch)
    return scratch.keep(moved.select("node", "root").unionByName(more.select("node", "root")))


def _among(df: DataFrame, ids: DataFrame, doc_id: str, cells: int = 1 << 18) -> DataFrame:
    """The rows of df whose id is in ids (column rep, each once). Ahead of the join, a bitmap of 64 * cells bits drops most
    others where they are read, so that only few texts are shuffled; it is broadcast, and has `cells` rows at most. (A
    semi-join would be planned ahead of the bitmap.)"""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(64 * cells))
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), (place(c) % 64).cast("int"))
    bits = ids.groupBy(F.floor(place(F.col("rep")) / 64).alias("cell")).agg(F.bit_or(bit(F.col("rep"))).alias("bits"))
    likely = df.withColumn("cell", F.floor(place(F.col(doc_id)) / 64)).join(F.broadcast(bits), "cell")
    likely = likely.filter(F.col("bits").bitwiseAND(bit(F.col(doc_id))) != 0).drop("cell", "bits")
    return likely.join(ids.withColumnRenamed("rep", doc_id), doc_id)


def full_sets(ids: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """rep and set, the whole shingle set, of the documents in ids (rep). texts: doc_id, text."""

    def full(part: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingles(x, words).view(np.int64) for x in byte_rows(part.column(1))]
        ends = np.cumsum([0, *map(len, found)])
        values = pa.array(np.concatenate(found) if found else [], pa.int64())
        return pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], ["rep", "set"])

    return map_slices(_among(texts, ids, "doc_id"), full, "rep long, set array<long>")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame | None:
    """node and root for every node of edges (a < b) that can reach a smaller one; root is the smallest. None without edges.

    Each node is hooked to its smallest neighbour below it, chains are halved until they end at roots, edges are
    carried over to the roots, and so on until none is left.
    """
    known = None
    while scratch.rows(edges):
        near = scratch.gathered(edges, BROADCAST_ROWS)
        hooks = scratch.keep(near.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")))
        while True:
            jumped = _looked_up(scratch.gathered(hooks, BROADCAST_ROWS).select("node", F.col("root").alias("was")), hooks, "was", "root", scratch)
            hooks = scratch.keep(jumped)
            if hooks.filter("root <> was").isEmpty():
                break
        if known is None:
            known = hooks
        else:
            moved = _looked_up(known.select("node", F.col("root").alias("was")), hooks, "was", "root", scratch)
            known = scratch.keep(moved.select("node", "root").unionByName(hooks.select("node", "root")))
        if scratch.rows(hooks) == scratch.rows(edges):  # every edge is a hook, and so within a component now
            return known
        ends = _looked_up(_looked_up(near, hooks, "a", "x", scratch), hooks, "b", "y", scratch).filter("x <> y")
        edges = scratch.keep(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    return known


def near_duplicates(df: DataFrame, words: int = 5, percent: int = 80, trees: int = 12, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row: the components of documents linked by a Jaccard
    similarity of percent / 100 or more between their shingle sets, named by their smallest id; kept is true for that.

    Documents with equal sets are first brought down to the one with the smallest id. Links between different sets are
    searched by search() and confirmed on full sets. The search is aimed at similarities of 0.8 or more; it is by
    chance, so single pairs near 0.8 can be missed, but no document is left out for the size of its group or source.

    A null or empty text, or one of white space, has no shingles and is linked with nothing: its component is itself.
    A row with a null id takes no part: its component_id is null, and it is kept. Rows that repeat an id are judged
    each by its own text. Other columns are left out; an empty table gives an empty one.
    """
    if percent < 80:
        raise ValueError("the search is made for similarities of 0.8 or more")
    scratch = Scratch(df.sparkSession, "neardup")
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    profiles = scratch.keep(map_slices(rows, lambda part: _profiles(part, words), _PROFILE))
    known = profiles.filter("doc_id is not null and print is not null")
    sets = scratch.keep(known.groupBy("print", F.col("n_shingles").cast("int").alias("size"), "tokens", *_SKETCH).agg(F.min("doc_id").alias("rep")))
    work = Scratch(df.sparkSession, "neardup")
    roots = search(sets.drop("print"), lambda ids: full_sets(ids, rows, words), work, percent, trees)
    classes = scratch.keep(_looked_up(sets.select("print", "rep"), roots, "rep", "component_id", work).drop("rep"))
    work.clear()
    scratch.drop(sets)
    shown = profiles.select("doc_id", "n_shingles", "print")
    alone = shown.filter("print is null").withColumn("component_id", F.lit(None).cast("long"))
    found = shown.filter("print is not null").join(classes, "print", "left").unionByName(alone)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
