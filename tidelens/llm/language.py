"""Language identification by hyperdimensional n-gram profiles."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelens.llm.common import SLICE_ROWS, slices, text_rows, with_text

#: The answer for texts without letters, and where nothing was learned.
UNKNOWN = "und"
#: Trigram vectors that a worker keeps at most; more are made anew.
KEPT_TRIGRAMS = 30_000
_EDGE = 0x110000  # stands for the edge of a word; no code point has it


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """By code point: whether it is a letter."""
    return np.fromiter((chr(x).isalpha() for x in range(0x110000)), bool, 0x110000)


class Space:
    """Hypervectors of +1 and -1 for letters and trigrams."""

    def __init__(self, dimensions: int, seed: int) -> None:
        self.dimensions, self.seed = dimensions, seed
        self.letters: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.kept = np.empty((KEPT_TRIGRAMS, dimensions), np.int8)

    def letter(self, x: int) -> np.ndarray:
        if (v := self.letters.get(x)) is None:
            v = self.letters[x] = np.random.default_rng((self.seed, x)).integers(0, 2, self.dimensions, np.int8) * 2 - 1
        return v

    def bound(self, trigram: int) -> np.ndarray:
        """The letters' vectors, each shifted by its place from the end, multiplied."""
        a, b, c = trigram >> 42, trigram >> 21 & 0x1FFFFF, trigram & 0x1FFFFF
        return np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)

    def bundle(self, trigrams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The sum of the trigrams' vectors, each as often as it was counted."""
        total = np.zeros(self.dimensions)
        at, weights, rest = [], [], []
        for x, n in zip(trigrams.tolist(), counts.tolist(), strict=True):
            row = self.rows.get(x)
            if row is None:
                if len(self.rows) == KEPT_TRIGRAMS:
                    rest.append((x, n))
                    continue
                row = self.rows[x] = len(self.rows)
                self.kept[row] = self.bound(x)
            at.append(row)
            weights.append(n)
        for i in range(0, len(at), 2048):
            total += np.asarray(weights[i : i + 2048], np.float32) @ self.kept[at[i : i + 2048]].astype(np.float32)
        for x, n in rest:
            total += n * self.bound(x)
        return total


@lru_cache(maxsize=2)
def space(dimensions: int, seed: int) -> Space:
    return Space(dimensions, seed)


def trigrams(text: str) -> np.ndarray:
    """The trigrams of a text's words in lower case, edges of words included, as three code points in one integer.
    Empty if the text has no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    seen = _letters()[points]
    if not seen.any():
        return np.empty(0, np.int64)
    line = np.full(len(points) + 2, _EDGE, np.int64)
    line[1:-1][seen] = points[seen]
    between = line == _EDGE
    line = line[~(between & np.concatenate(([False], between[:-1])))]  # one edge for each run of other characters
    if len(line) < 3:
        return np.empty(0, np.int64)
    return (line[:-2] << 42) | (line[1:-1] << 21) | line[2:]


def profiles(df: DataFrame, learn: Column, dimensions: int = 1024, seed: int = 1, text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """Language prototypes: the bundle of all trigrams of all rows that `learn` is true for and that have a language.

    Every partition bundles its rows by language, and the bundles are added up; they are whole numbers, so in any
    order. The driver gets one vector for each language, whatever the number or length of documents.
    """
    rows = df.filter(learn & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string"), F.col(text))

    def run(batches):
        s, held = space(dimensions, seed), {}
        for part in slices(batches, 4 * SLICE_ROWS):
            by: dict[str, list[np.ndarray]] = {}
            for language, x in zip(part.column(0).to_pylist(), text_rows(part.column(1)), strict=True):
                by.setdefault(language, []).append(trigrams(x))
            for language, found in by.items():
                held[language] = held.get(language, 0) + s.bundle(*np.unique(np.concatenate(found), return_counts=True))
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([v.tolist() for v in held.values()], pa.list_(pa.float64()))], ["lang", "vector"])

    parts = rows.mapInArrow(run, "lang string, vector array<double>")
    summed = parts.select("lang", F.posexplode("vector").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x"))
    found: dict[str, np.ndarray] = {}
    for r in summed.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("v")).collect():
        v = np.array([y["x"] for y in r["v"]])
        if (n := np.linalg.norm(v)) > 0:
            found[r["lang"]] = v / n
    return dict(sorted(found.items()))


def identify(df: DataFrame, prototypes: dict[str, np.ndarray], dimensions: int = 1024, seed: int = 1, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds lang_pred, the language whose prototype has the largest cosine with the text's bundle, and score, that
    cosine (0 if negative).

    A null text, or one without a letter, gets `und` and 0; so does every text if no language was learned. Ties go to
    the name that sorts first. Whole texts count, whatever their length. Rows are judged one by one, so repeated rows
    get the same answer; only the columns of keep are returned. An empty table gives an empty one.
    """
    names = list(prototypes)
    matrix = np.array([prototypes[x] for x in names]) if names else np.zeros((0, dimensions))
    rows, at, kept = with_text(df, text, keep)
    schema = f"{kept}, lang_pred string, score double"

    def run(batches):
        s = space(dimensions, seed)
        for part in slices(batches):
            langs, scores = [], []
            for x in text_rows(part.column(at)):
                found = trigrams(x) if x and names else ()
                lang, score = UNKNOWN, 0.0
                if len(found):
                    v = s.bundle(*np.unique(found, return_counts=True))
                    if (n := np.linalg.norm(v)) > 0:
                        cosines = matrix @ (v / n)
                        best = int(np.argmax(cosines))
                        lang, score = names[best], float(min(1.0, max(0.0, cosines[best])))
                langs.append(lang)
                scores.append(score)
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*keep, "lang_pred", "score"])

    return rows.mapInArrow(run, schema)
