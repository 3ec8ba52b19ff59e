"""A linear-chain conditional random field over the lines of a text, with two labels: 0 bad or boilerplate, 1 good."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LETTER, _UPPER, _DIGIT, _SPACE, _SYMBOL = 1, 2, 4, 8, 16
#: Own features of a line; those of the line before and the line after follow.
OWN = ("symbols", "pipes", "exclamations", "upper", "digits", "letters", "word_length", "repeats", "distinct", "seen", "ends", "log_length")
WIDTH = 3 * len(OWN)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """By code point: its classes as bits."""
    found = np.zeros(0x110000, np.uint8)
    for x in range(0x110000):
        c = chr(x)
        if c.isalpha():
            found[x] = _LETTER | _UPPER * c.isupper()
        elif c.isdigit():
            found[x] = _DIGIT
        elif c.isspace():
            found[x] = _SPACE
    for c in "#*$%&|<>@^~=_{}[]\\/+!":
        found[ord(c)] |= _SYMBOL
    return found


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A row for each line that has a visible character, and the lines' lengths in visible characters."""
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    if not lines:
        return np.zeros((0, WIDTH), np.float32), np.zeros(0)
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    points = np.frombuffer("".join(lines).encode("utf-32-le", "replace"), "<u4")
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    kinds = _classes()[points]
    count = lambda mask: np.add.reduceat(mask, starts, dtype=np.int64)
    letters, spaces = count(kinds & _LETTER > 0), count(kinds & _SPACE > 0)
    visible = lengths - spaces
    own = np.empty((len(lines), len(OWN)), np.float32)
    own[:, 0] = count(kinds & _SYMBOL > 0) / visible
    own[:, 1] = count(points == 0x7C) / visible
    own[:, 2] = count(points == 0x21) / visible
    own[:, 3] = count(kinds & _UPPER > 0) / np.maximum(letters, 1)
    own[:, 4] = count(kinds & _DIGIT > 0) / visible
    own[:, 5] = letters / visible
    seen: set[str] = set()
    for k, line in enumerate(lines):
        words = line.split()
        n = len(words)
        own[k, 6] = min(3.0, visible[k] / n / 10)
        own[k, 7] = sum(map(eq, words, words[1:])) / n
        own[k, 8] = len(set(words)) / n
        own[k, 9] = line in seen
        own[k, 10] = line.rstrip()[-1] in ".!?…:;\"'"
        seen.add(line)
    own[:, 11] = np.log1p(visible) / 5
    rows = np.zeros((len(lines), WIDTH), np.float32)
    w = len(OWN)
    rows[:, :w] = own
    rows[1:, w : 2 * w] = own[:-1]
    rows[:-1, 2 * w :] = own[1:]
    return rows, visible.astype(float)


@dataclass(frozen=True)
class Crf:
    """weights and bias: the score of label 1 over label 0 from a line's features; step: of one label after another;
    first: of the first line's label. A field of zeros holds every line to be as likely good as bad."""

    weights: np.ndarray
    bias: float
    step: np.ndarray
    first: np.ndarray

    def with_odds(self, odds: float) -> Crf:
        """The field for lines of which those of label 1 are so many times as common as where it was learned."""
        shift = math.log(odds)
        return Crf(self.weights, self.bias, self.step, self.first + np.array([-shift / 2, shift / 2]))

    def local(self, rows: np.ndarray) -> list[float]:
        return (rows @ self.weights + self.bias).tolist()

    def best(self, rows: np.ndarray) -> list[int]:
        """Viterbi: the most likely labels of the lines together. Ties go to label 1."""
        u = self.local(rows)
        if not u:
            return []
        (s00, s01), (s10, s11) = self.step.tolist()
        a, b = float(self.first[0]), float(self.first[1]) + u[0]
        came: list[tuple[int, int]] = []
        for x in u[1:]:
            from0, from1 = int(b + s10 >= a + s00), int(b + s11 >= a + s01)
            a, b = (b + s10 if from0 else a + s00), (b + s11 if from1 else a + s01) + x
            came.append((from0, from1))
        label = int(b >= a)
        out = [label]
        for back in reversed(came):
            label = back[label]
            out.append(label)
        return out[::-1]

    def marginals(self, rows: np.ndarray) -> list[float]:
        """Forward and backward: how likely each line is good."""
        u = self.local(rows)
        if not u:
            return []
        e00, e01, e10, e11 = np.exp(self.step - self.step.max()).ravel().tolist()
        top = float(self.first.max())
        f0, f1 = math.exp(self.first[0] - top), math.exp(self.first[1] - top)
        g = [(1.0, math.exp(x)) if x <= 0 else (math.exp(-x), 1.0) for x in u]
        forward: list[tuple[float, float]] = []
        a, b = f0 * g[0][0], f1 * g[0][1]
        for k in range(len(u)):
            if k:
                a, b = (a * e00 + b * e10) * g[k][0], (a * e01 + b * e11) * g[k][1]
            n = a + b or 1.0
            a, b = a / n, b / n
            forward.append((a, b))
        out = [0.0] * len(u)
        p, q = 1.0, 1.0
        for k in range(len(u) - 1, -1, -1):
            x, y = forward[k][0] * p, forward[k][1] * q
            out[k] = y / (x + y) if x + y > 0 else 0.5
            p, q = e00 * g[k][0] * p + e01 * g[k][1] * q, e10 * g[k][0] * p + e11 * g[k][1] * q
            n = p + q or 1.0
            p, q = p / n, q / n
        return out


def unlearned() -> Crf:
    return Crf(np.zeros(WIDTH, np.float32), 0.0, np.zeros((2, 2)), np.zeros(2))


def fit(texts: list[str], labels: list[int], rounds: int = 150, decay: float = 1e-3, rate: float = 0.1, stickiness: float = 2.0) -> Crf:
    """Most likely parameters for lines that all have their text's label, by full gradient steps (Adam).

    stickiness bounds how much a label may gain from the one before, either way: labels here never change within a
    text, so without a bound a field would judge whole texts only. Texts without visible characters are left out; with
    fewer than two labels among the rest, the field is unlearned().
    """
    found = [(rows, y) for rows, y in ((features(x)[0], y) for x, y in zip(texts, labels, strict=True)) if len(rows)]
    if len({y for _, y in found}) < 2:
        return unlearned()
    found.sort(key=lambda x: -len(x[0]))
    sizes = np.array([len(x) for x, _ in found])
    x = np.concatenate([rows for rows, _ in found]).astype(np.float64)
    y = np.repeat([label for _, label in found], sizes)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    at = [starts[: np.searchsorted(-sizes, -t)] + t for t in range(sizes[0])]  # the t-th lines of texts that have one
    mean, std = x.mean(0), x.std(0) + 1e-6
    x = (x - mean) / std
    per_text = 1.0 / len(found)
    theta = np.zeros(WIDTH + 1 + 4 + 2)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    first_labels, same = y[starts], np.ones(len(y), bool)
    same[starts] = False
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[np.flatnonzero(same) - 1], y[same]), 1)
    for k in range(1, rounds + 1):
        w, bias, step, first = theta[:WIDTH], theta[WIDTH], theta[WIDTH + 1 : WIDTH + 5].reshape(2, 2), theta[WIDTH + 5 :]
        u = x @ w + bias
        g = np.stack((np.exp(-np.maximum(u, 0)), np.exp(np.minimum(u, 0))), 1)
        e = np.exp(step)
        forward, expected = np.empty((len(y), 2)), np.zeros((2, 2))
        a = np.exp(first) * g[at[0]]
        for t, now in enumerate(at):
            if t:
                a = (a[: len(now)] @ e) * g[now]
            a = a / a.sum(1, keepdims=True)
            forward[now] = a
        back, p = np.ones((len(y), 2)), None
        for t in range(len(at) - 1, 0, -1):
            now, prior = at[t], at[t - 1][: len(at[t])]
            after = g[now] * back[now]
            joint = forward[prior][:, :, None] * e[None] * after[:, None, :]
            expected += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
            p = after @ e.T
            back[prior] = p / p.sum(1, keepdims=True)
        gamma = forward * back
        good = gamma[:, 1] / gamma.sum(1)
        gap = y - good
        gradient = np.concatenate((x.T @ gap, [gap.sum()], (seen - expected).ravel(), [-(first_labels - good[starts]).sum(), (first_labels - good[starts]).sum()]))
        gradient = gradient * per_text - decay * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        theta = theta + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        theta[WIDTH + 1 : WIDTH + 5] = np.clip(theta[WIDTH + 1 : WIDTH + 5], -stickiness / 4, stickiness / 4)
    w = theta[:WIDTH] / std
    return Crf(w.astype(np.float32), float(theta[WIDTH] - w @ mean), theta[WIDTH + 1 : WIDTH + 5].reshape(2, 2).copy(), theta[WIDTH + 5 :].copy())


def labelled_sample(documents: DataFrame, labels: DataFrame, each: int, text: str = "text", doc_id: str = "doc_id", label: str = "quality") -> tuple[list[str], list[int], dict[int, int]]:
    """Texts and labels of `each` labelled documents at most of either label, and how many labels of each there are.

    Those with the smallest hash of their id are taken, so the same on every run. The labels' rows are cut down first:
    what is broadcast, and what comes to the driver, is 2 * each rows.
    """
    rows = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)")
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    order = (F.xxhash64("doc_id"), F.col("doc_id"), F.col("label"))
    taken = None
    for y in (0, 1):
        part = rows.filter(F.col("label") == y).dropDuplicates(["doc_id"]).orderBy(*order).limit(each)
        taken = part if taken is None else taken.unionByName(part)
    texts = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter("doc_id is not null and text is not null")
    found = texts.join(F.broadcast(taken), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).collect()
    found.sort(key=lambda r: (r["doc_id"], r["label"]))
    return [r["text"] for r in found], [r["label"] for r in found], counts
