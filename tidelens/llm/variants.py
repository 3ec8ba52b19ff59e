"""Spelling variants: words one edit apart, found in forward and backward minimal acyclic automata."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelens.llm.common import byte_rows
from tidelens.sources.folders import Scratch

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Different words of a task that are counted before they are passed on.
COUNTED = 500_000
#: Words of a half that are matched in one automaton; what more words share is cut into parts of about as many.
CELL_WORDS = 20_000
#: Rows of one task's automaton, about.
BUCKET_ROWS = 30_000
#: Rows of a table that is broadcast at most.
BROADCAST_ROWS = 100_000


def runs(df: DataFrame, text: str = "text", doc_id: str = "doc_id", every: int = 97) -> DataFrame:
    """word and n: how often each run of letters is found, lower-cased in A-Z, with the spelling errors that ids tell: of
    a run whose crc32 with its document's id is divisible by `every`, one letter is left out.

    A word is on several rows, as tasks and their parts count alone; the sum is the count. A null text has no runs; a
    null id reads as empty. An empty word, where the only letter of a run is left out, is counted like the others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()

        def passed() -> pa.RecordBatch:
            words, ns = [x.decode("latin-1") for x in total], list(total.values())
            total.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(ns, pa.int64())], ["word", "n"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), byte_rows(batch.column(1)), strict=True):
                if text is None:
                    continue
                own: Counter[bytes] = Counter()
                for raw, n in Counter(_RUN.findall(text.decode("utf-8", "replace"))).items():
                    own[raw.encode("latin-1").lower()] += n
                start = crc32(f"{'' if doc is None else doc}:".encode())
                for word, n in own.items():
                    h = crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
                    if h % every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    total[word] += n
                if len(total) >= COUNTED:
                    yield passed()
        if total:
            yield passed()

    return df.select(F.col(doc_id), F.col(text)).mapInArrow(run, "word string, n long")


class Automaton:
    """The minimal acyclic automaton of sorted, different words. A word's number is how many words sort before it.

    Of each state it is known how many words go on from it and, for each letter, the next state and how many of these
    words come before those that take this letter; the sum along a word's path is its number.
    """

    def __init__(self, words: list[str]) -> None:
        self.edges: list[dict[str, tuple[int, int]]] = []
        self.ends: list[bool] = []
        self.sizes: list[int] = []
        self.shortest: list[int] = []
        self.longest: list[int] = []
        known: dict[tuple, int] = {}
        path: list[tuple[list[tuple[str, int]], bool]] = [([], False)]

        def closed(state: tuple[list[tuple[str, int]], bool]) -> int:
            found, end = state
            signature = (end, *found)
            if (at := known.get(signature)) is None:
                at = known[signature] = len(self.edges)
                size, out = int(end), {}
                for letter, to in found:
                    out[letter] = (to, size)
                    size += self.sizes[to]
                self.edges.append(out)
                self.ends.append(end)
                self.sizes.append(size)
                self.shortest.append(0 if end else min((1 + self.shortest[to] for _, to in found), default=0))
                self.longest.append(max((1 + self.longest[to] for _, to in found), default=0))
            return at

        before = ""
        for word in [*words, ""]:
            same = 0
            while same < len(word) and same < len(before) and word[same] == before[same]:
                same += 1
            while len(path) > same + 1:
                state = path.pop()
                path[-1][0].append((before[len(path) - 1], closed(state)))
            if word:
                path += [([], False) for _ in range(len(word) - same)]
                path[-1] = (path[-1][0], True)
            before = word
        self.start = closed(path[0])

    def number(self, word: str, start: int, state: int, at: int) -> int | None:
        """`at` plus the number of word[start:] among what goes on from a state; None if it is none of that."""
        if not self.shortest[state] <= len(word) - start <= self.longest[state]:
            return None
        edges = self.edges
        for i in range(start, len(word)):
            if (step := edges[state].get(word[i])) is None:
                return None
            state, at = step[0], at + step[1]
        return at if self.ends[state] else None

    def near(self, word: str, exact: int, longer: bool) -> set[int]:
        """Numbers of words that begin with the first `exact` letters of word and go on with exactly one error: one
        letter replaced or put in (longer), or one left out. In a run of one letter, putting it in or leaving it out
        is the same at every place, and is tried at the first alone."""
        state, at, out = self.start, 0, set()
        for letter in word[:exact]:
            if (step := self.edges[state].get(letter)) is None:
                return out
            state, at = step[0], at + step[1]
        for i in range(exact, len(word) + longer):
            before, own = word[i - 1] if i > exact else None, word[i] if i < len(word) else None
            if longer:
                for letter, (to, more) in self.edges[state].items():
                    if letter != before:
                        out.add(self.number(word, i, to, at + more))
                    if own is not None and letter != own:
                        out.add(self.number(word, i + 1, to, at + more))
            elif own != before:
                out.add(self.number(word, i + 1, state, at))
            if own is None or (step := self.edges[state].get(own)) is None:
                break
            state, at = step[0], at + step[1]
        out.discard(None)
        return out


_FOUND = "word string, n_near long, best struct<n: long, word: string>"


def _matched(rows: pa.Table) -> pa.Table:
    """For each word asked that has near words: how many, and the most frequent, the smallest of several.

    Rows are of one bucket: back (words are read backwards), least (the shorter length of a pair), cell (null, or what
    has an automaton of its own), indexed and asked, word and n.
    """
    cells: dict[tuple, list[tuple]] = {}
    for back, cell, least, indexed, asked, word, n in zip(*(rows[c].to_pylist() for c in ("back", "cell", "least", "indexed", "asked", "word", "n")), strict=True):
        cells.setdefault((back, cell), []).append((word[::-1] if back else word, n, least, indexed, asked))
    out: tuple[list, list, list] = ([], [], [])
    for (back, _), own in cells.items():
        counts = {word: n for word, n, _, indexed, _ in own if indexed}
        words = sorted(counts)
        automaton = Automaton(words)
        for word, _, least, _, asked in own:
            if not asked:
                continue
            first = least // 2
            exact = least - first if back else first
            found = [words[i] for i in automaton.near(word, exact, longer=len(word) == least)]
            if back:  # those that also begin alike are found forwards
                word = word[::-1]
                found = [x for x in (x[::-1] for x in found) if x[:first] != word[:first]]
            if found:
                named = [(-counts[x[::-1] if back else x], x) for x in found]
                n, best = min(named)
                out[0].append(word)
                out[1].append(len(found))
                out[2].append({"n": -n, "word": best})
    best = pa.struct([("n", pa.int64()), ("word", pa.string())])
    return pa.table({"word": pa.array(out[0], pa.string()), "n_near": pa.array(out[1], pa.int64()), "best": pa.array(out[2], best)})


def near_words(words: DataFrame, scratch: Scratch, cell_words: int = CELL_WORDS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """word, n_near and best (n, word) for each of words (word, n; each once) that has words exactly one letter put in, left out or
    replaced away: how many, and the most frequent of them, the smallest of several.

    Of two such words the shorter one's letters are cut in the middle: either what comes before the cut is the beginning
    of both, or what comes after it is the end of both. Each word is therefore sent by its first and by its last half,
    as the shorter or equal one of a pair and as the longer one, so four times. All that share a half meet in one task:
    an automaton of the words (backward for last halves) follows the half exactly and completes it with one error.
    What both directions would find, the backward one leaves out. A task has many halves, up to about bucket_rows rows.
    A half that more than cell_words words share is cut: its words are dealt into parts by hash, and each part is asked by each,
    so that no task has more than two parts; only counts and the best word leave a task, never pairs.
    """
    length = F.length("word")
    ways = [F.struct(F.lit(back).alias("back"), (length - less).alias("least")) for back in (False, True) for less in (0, 1)]
    sent = words.select("word", "n", F.explode(F.array(*ways)).alias("way")).select("word", "n", "way.back", "way.least").filter("least > 1")
    first = F.floor(F.col("least") / 2).cast("int")
    half = F.when(F.col("back"), F.right("word", F.col("least") - first)).otherwise(F.left("word", first))
    sent = scratch.keep(sent.withColumn("half", half))
    key = ["back", "least", "half"]
    large = scratch.keep(sent.groupBy(*key).count().filter(F.col("count") > cell_words).select(*key, F.ceil(F.col("count") / cell_words).cast("int").alias("parts")))
    by_size = F.broadcast(large) if scratch.rows(large) <= BROADCAST_ROWS else large
    cut = sent.join(by_size, key)
    whole = sent.join(by_size, key, "left_anti").select("back", F.lit(None).cast("string").alias("cell"), "least", F.lit(True).alias("indexed"), F.lit(True).alias("asked"), "word", "n", F.xxhash64(*key).alias("place"))
    own = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    there = lambda i, j: F.concat_ws(":", F.col("least").cast("string"), "half", i.cast("string"), j.cast("string"))
    # within its own part a word is both
    role = lambda cell, indexed, asked: F.struct(cell.alias("cell"), indexed.alias("indexed"), asked.alias("asked"))
    both = F.transform(every, lambda k: role(there(own, k), F.lit(True), k == own))
    roles = F.concat(both, F.transform(F.filter(every, lambda k: k != own), lambda k: role(there(k, own), F.lit(False), F.lit(True))))
    split = cut.select("back", "least", "word", "n", F.explode(roles).alias("r")).select("back", "r.cell", "least", "r.indexed", "r.asked", "word", "n", F.xxhash64("back", "r.cell").alias("place"))
    buckets = max(1, -(-scratch.rows(sent) // bucket_rows))
    dealt = whole.unionByName(split).withColumn("bucket", F.pmod("place", F.lit(buckets))).drop("place")
    found = dealt.groupBy("bucket").applyInArrow(_matched, _FOUND)
    best = F.min_by("best", F.struct(-F.col("best.n"), F.col("best.word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame | None:
    """word and root for forms (word, form): where following forms ends, None without forms. Forms must go in no circle;
    each round doubles the steps that are followed at once."""
    known = scratch.keep(forms.select("word", F.col("form").alias("root")))
    while scratch.rows(known):
        on = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        on = F.broadcast(on) if scratch.rows(known) <= BROADCAST_ROWS else on
        moved = scratch.keep(known.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if moved.filter("moved").isEmpty():
            return known
        known = scratch.keep(moved.drop("moved"))
    return None


def variants(df: DataFrame, text: str = "text", doc_id: str = "doc_id", least_length: int = 5, least_count: int = 3, times: int = 2, cell_words: int = CELL_WORDS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row for each word of at least least_length letters that is found at least least_count times: word, form, root, n, n_near, form_n.

    A word's form is its near word that is found most often (ties: the smallest), if that is at least `times` times as
    often as the word itself; root is where following forms ends, the word itself without a form. As each step at least
    doubles the count, forms go in no circle, and a chain has no more steps than a count has binary digits.

    A null or empty text has no words, a null id reads as empty; repeated rows count each; one very long word is a word.
    Other columns are left out. An empty table gives an empty one.
    """
    if times < 2 or least_length < 3:
        raise ValueError("forms need to be at least twice as frequent, and words three letters or more")
    scratch = Scratch(df.sparkSession, "variants")
    counted = runs(df, text, doc_id).groupBy("word").agg(F.sum("n").alias("n"))
    words = scratch.keep(counted.filter((F.col("n") >= least_count) & (F.length("word") >= least_length)))
    near = near_words(words, scratch, cell_words, bucket_rows)
    form = F.when(F.col("best.n") >= times * F.col("n"), F.col("best"))
    found = scratch.keep(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), form.alias("form")))
    ends = roots(found.filter("form is not null").select("word", F.col("form.word").alias("form")), scratch)
    rooted = found.withColumn("root", F.col("word")) if ends is None else found.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
    return rooted.select("word", F.col("form.word").alias("form"), "root", "n", "n_near", F.col("form.n").alias("form_n"))
