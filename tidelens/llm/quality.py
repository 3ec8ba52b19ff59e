"""Two uses of the line field: a rule that keeps documents made of content, and a score of a document's quality."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelens.llm import lines
from tidelens.llm.common import byte_rows, map_slices, with_text

_SPACES = b" \t\n\x0b\x0c\r"
_NOT_COUNTED = _SPACES + bytes(range(0x80, 0xC0))  # of a character's UTF-8 bytes, all but the first
_SYMBOLS = b"#*$%&|<>"


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a window of three that the text has twice or more."""
    if len(words) < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    n = len(known)
    pairs = ids[:-1] * n + ids[1:]
    if n >= 1 << 20:
        pairs = np.unique(pairs, return_inverse=True)[1]
    keys = pairs[:-1] * n + ids[2:]
    _, place, counts = np.unique(keys, return_inverse=True, return_counts=True)
    twice = counts[place] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : len(words) - 2 + k] |= twice
    return int(covered.sum())


def base(text: bytes) -> tuple[int, int, int, int, int, bool]:
    """Words, code points in words, symbols, repeated lines, repeated words, and whether these fail the text."""
    words = text.split()
    seen: set[bytes] = set()
    repeated = 0
    for line in text.split(b"\n"):
        if line in seen:
            repeated += 1
        elif line and line.strip(_SPACES):
            seen.add(line)
    twice = repeated_words(words)
    n = len(words)
    return n, len(text.translate(None, _NOT_COUNTED)), len(text) - len(text.translate(None, _SYMBOLS)), repeated, twice, n < 50 or 100 * twice > 50 * n


def learn_content(texts: list[str], labels: list[int], counts: dict[int, int]) -> lines.Crf:
    """The line field of a sample of texts of either label; counts: of all labels, as the sample need not have them in
    proportion."""
    ones = sum(labels)
    if not ones or ones == len(labels):
        return lines.unlearned()
    return lines.fit(texts, labels).with_odds((counts[1] / counts[0]) / (ones / (len(labels) - ones)))


def content_share(field: lines.Crf, text: str) -> float:
    """The share of visible characters on lines that the field's best labelling calls content; 0 if there are none."""
    rows, lengths = lines.features(text)
    if not len(rows):
        return 0.0
    return float(np.dot(field.best(rows), lengths) / lengths.sum())


def keep_content(df: DataFrame, field: lines.Crf, least: float = 0.3, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The counts of base() for each row's whole text, its content share, and kept: base did not fail it, and the
    share is `least` or more.

    A null text has no words, so it fails. Rows are judged one by one: repeated rows get the same answer, and only the
    columns of keep are returned beside the new ones. An empty table gives an empty one.
    """
    rows, at, kept = with_text(df, text, keep)
    names = [*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share"]
    schema = f"{kept}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"
    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.bool_(), pa.float64()]

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for x in byte_rows(part.column(at)):
            found = base(x or b"")
            share = content_share(field, (x or b"").decode("utf-8", "replace"))
            out.append((*found, not found[-1] and share >= least, share))
        columns = list(zip(*out, strict=True)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    return map_slices(rows, run, schema)


def goodness(field: lines.Crf, text: str) -> float | None:
    """The mean of the lines' marginals, by visible characters; None for a text without any."""
    rows, lengths = lines.features(text)
    return float(np.dot(field.marginals(rows), lengths) / lengths.sum()) if len(rows) else None


def _logit(x: float) -> float:
    x = min(1 - 1e-4, max(1e-4, x))
    return math.log(x / (1 - x))


class Classifier:
    """A line field and the logistic curve that turns a text's goodness into the likelihood of label 1."""

    def __init__(self, field: lines.Crf, slope: float, offset: float) -> None:
        self.field, self.slope, self.offset = field, slope, offset

    def score(self, text: str | None) -> float:
        """0 for a null text or one without visible characters."""
        x = goodness(self.field, text) if text else None
        return 0.0 if x is None else 1 / (1 + math.exp(-max(-50.0, min(50.0, self.slope * _logit(x) + self.offset))))


def learn(texts: list[str], labels: list[int], counts: dict[int, int]) -> Classifier:
    """From a sample of texts of either label; counts: of all labels, as the sample need not have them in proportion.
    Every second text is for the field, the others for the curve, so that it sees texts the field has not. With one
    label or none to learn from, every text with visible characters scores 0.5."""
    field = lines.fit(texts[::2], labels[::2])
    found = [(x, y) for t, y in zip(texts[1::2], labels[1::2], strict=False) if (x := goodness(field, t)) is not None]
    if len({y for _, y in found}) < 2 or not field.weights.any():
        return Classifier(field, 0.0, 0.0)
    x, y = np.array([_logit(a) for a, _ in found]), np.array([b for _, b in found], float)
    theta, rows = np.array([1.0, 0.0]), np.stack((x, np.ones_like(x)), 1)
    for _ in range(30):  # Newton steps, with a little decay against labels that can be told apart without error
        p = 1 / (1 + np.exp(-np.clip(rows @ theta, -30, 30)))
        hessian = (rows * (p * (1 - p))[:, None]).T @ rows + 0.5 * np.eye(2)
        theta = theta + np.linalg.solve(hessian, rows.T @ (y - p) - 0.5 * theta)
    shift = math.log((counts.get(1, 0) or 1) / (counts.get(0, 0) or 1)) - math.log(y.sum() / (len(y) - y.sum()))
    return Classifier(field, float(theta[0]), float(theta[1] + shift))


def score(df: DataFrame, classifier: Classifier, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds score, from 0 to 1: the likelihood of label 1, from the whole text alone.

    A null or blank text scores 0. Rows are scored one by one: repeated rows get the same score, and only the columns
    of keep are returned beside it. An empty table gives an empty one.
    """
    rows, at, kept = with_text(df, text, keep)
    schema = f"{kept}, score double"

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        found = [classifier.score(None if x is None else x.decode("utf-8", "replace")) for x in byte_rows(part.column(at))]
        return pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.array(found, pa.float64())], [*keep, "score"])

    return map_slices(rows, run, schema)
