"""Personal data: wide generators propose spans, boosted trees judge them, calibrated thresholds choose.

What runs over the documents is DataFrame expressions only. The trees are fitted on the driver, on counts of feature
vectors, whose number the features' ranges bound.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "A-Za-z0-9._%+-"
#: A match can only begin where the last one ended or where a run of its first characters begins: from any other place
#: in such a run, the same things follow. This keeps long runs from being read once for each of their characters.
_EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_IP_FITS = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})){3}$"
#: The wide generators: addresses written out or spaced, addresses in words, any run of digits with separators, and four
#: small numbers with dots of any writing between them.
_WIDE_EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++ ?(?:@|\[at\]|\(at\)) ?[A-Za-z0-9-]++(?: ?(?:\.|\[dot\]|\(dot\)) ?[A-Za-z0-9-]++)*+"
_WORD_EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++(?: dot [{_LOCAL}]++){{0,6}}+ at [A-Za-z0-9-]++(?: dot [A-Za-z0-9-]++){{1,6}}+"
_WIDE_NUMBER = r"[+(]{0,2}[0-9](?:(?: - |[\x20()./-]{0,2})[0-9])++"
_DOT = r" ?(?:\[\.\]|\(\.\)|\[dot\]|\(dot\)) ?| dot | \. "
_WIDE_IP = rf"(?<![0-9.])[0-9]{{1,3}}(?:(?:{_DOT}|\.)[0-9]{{1,3}}){{3}}(?![0-9])"
#: One group of many digits in a longer number, as where two cards stand side by side.
_GROUP = r"(?<![0-9])[0-9]{13,19}(?=[\x20()./-]{1,2}[0-9])|(?<=[0-9][\x20()./-]|[0-9][\x20()./-][\x20()./-])[0-9]{13,19}(?![0-9])"
_CONTEXT = {
    "email": "(?i)(?:e-?mail|contact|write|reach)[^\n]*$",
    "ip": r"(?i)\b(?:ip|server|login|logged|addr(?:ess)?)\b[^\n]*$",
    "card": "(?i)(?:card|visa|master|amex|payment|credit|debit)[^\n]*$",
    "phone": r"(?i)(?:phone|\btel\b|\bcall\b|\bfax\b|mobile|\bcell\b|whatsapp)[^\n]*$",
}
#: An address with a domain: a dot of any writing, and letters, after the at.
_DOMAIN = r"(?:@|\[at\]|\(at\)| at ) ?[A-Za-z0-9-]+(?:\.| \. | ?[\[(]dot[\])] ?| dot )[A-Za-z0-9-]*[A-Za-z]"
#: Numbers that are none of the kinds: dates, numbers of three, two and four digits, and bare, decimal and version numbers.
_SOCIAL = r"^[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}$"
_DATE = r"^(?:(?:19|20)[0-9]{2}[-./ ][01]?[0-9][-./ ][0-3]?[0-9]|[0-3]?[0-9][-./ ][0-3]?[0-9][-./ ](?:19|20)[0-9]{2})(?: [0-9]{1,2})?$"
_VERSION = r"^[0-9]+(?:\.[0-9]+)*$"
_DOTTED_PHONE = r"^(?:[0-9]{1,3}\.)?[0-9]{3}\.[0-9]{3}\.[0-9]{4}$"
#: Of each feature the largest value; larger ones count as it.
FEATURES = {"at": 1, "domain": 1, "digits": 24, "groups": 6, "first": 6, "last": 6, "dots": 4, "dashes": 3, "slashes": 3, "brackets": 1, "plus": 1, "zero": 2, "luhn": 1, "bytes": 1, "date": 1, "social": 1, "spelled": 1, "spaced": 1, "said_email": 1, "said_ip": 1, "said_card": 1, "said_phone": 1}
#: Parts of the documents that trees are calibrated on, each by trees that are fitted on the others.
FOLDS = 5
_CONTEXT_CHARS = 32


def _is(kind: int) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


#: By kind, what a span is asked for.
IS_KIND = {k: _is(i) for i, k in enumerate(KINDS)}


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


#: Items of one block of a walk.
_BLOCK = 128


def _walk(items: Column, kind: str, state: Column, step: Callable[[Column, Column], Column]) -> Column:
    """`out` of step(state, item), a struct of state and out, for every item in order, as an array of `kind`. The results
    are gathered by blocks, as an array that grows one by one is copied for each."""
    none = F.expr(f"cast(array() as array<{kind}>)")

    def one(acc: Column, x: Column) -> Column:
        return _let(step(acc["state"], x), lambda r: F.struct(r["state"].alias("state"), F.array_append(acc["out"], r["out"]).alias("out")))

    def walked(items: Column) -> Column:
        def block(acc: Column, j: Column) -> Column:
            found = F.aggregate(F.slice(items, j * _BLOCK + 1, _BLOCK), F.struct(acc["state"].alias("state"), none.alias("out")), one)
            return _let(found, lambda r: F.struct(r["state"].alias("state"), F.array_append(acc["blocks"], r["out"]).alias("blocks")))

        blocks = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / _BLOCK).cast("int"))
        start = F.struct(state.alias("state"), F.expr(f"cast(array() as array<array<{kind}>>)").alias("blocks"))
        return F.when(F.size(items) > 0, F.aggregate(blocks, start, block, lambda acc: F.flatten(acc["blocks"]))).otherwise(none)

    return _let(items, walked)


_SPAN = "struct<start: bigint, end: bigint, m: string, before: string, after: string>"


def _no_spans() -> Column:
    return F.expr(f"cast(array() as array<{_SPAN}>)")


def matches(text: Column, pattern: str) -> Column:
    """The pattern's matches from left to right: start, end (code points), the match, and what stands around it."""

    def placed(m: Column) -> Column:
        def add(gaps: Column) -> Callable[[Column, Column], Column]:
            def step(at: Column, i: Column) -> Column:
                found, gap = F.element_at(m, i), F.element_at(gaps, i)
                start = at + F.length(gap)
                end = start + F.length(found)
                span = F.struct(start.alias("start"), end.alias("end"), found.alias("m"), F.right(gap, F.lit(_CONTEXT_CHARS)).alias("before"), F.left(F.element_at(gaps, i + 1), F.lit(1)).alias("after"))
                return F.struct(end.alias("state"), span.alias("out"))

            return step

        walked = _let(F.split(text, pattern, -1), lambda gaps: _walk(F.sequence(F.lit(1), F.size(m)), _SPAN, F.lit(0).cast("long"), add(gaps)))
        return F.when(F.size(m) > 0, walked).otherwise(_no_spans())

    return _let(F.regexp_extract_all(text, F.lit(pattern), 0), placed)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, 1).cast("int")
        return total + F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """By kind, the spans that need no judgement."""
    empty = _no_spans()
    email = F.when(F.contains(text, F.lit("@")), matches(text, _EMAIL)).otherwise(empty)
    ip = F.filter(matches(text, _IP), lambda s: s["m"].rlike(_IP_FITS))
    card = F.filter(matches(text, _CARD), lambda s: _let(_digits(s["m"]), lambda d: F.when(F.length(d).between(16, 19), luhn(d)).otherwise(False)))
    phone = F.when(F.contains(text, F.lit("+")), F.filter(matches(text, _PHONE), lambda s: F.length(_digits(s["m"])).between(8, 15))).otherwise(empty)
    return {"email": email, "ip": ip, "card": card, "phone": phone}


def wide_spans(text: Column) -> Column:
    """All candidates, which may overlap: addresses of any writing, numbers of seven digits or more that do not touch a
    letter, long groups of digits inside such numbers, and four small numbers with dots of any writing."""
    maybe = F.contains(text, F.lit("@")) | F.contains(text, F.lit("at]")) | F.contains(text, F.lit("at)"))
    emails = F.when(maybe, matches(text, _WIDE_EMAIL)).otherwise(_no_spans())
    words = F.when(F.contains(text, F.lit(" dot ")), matches(text, _WORD_EMAIL)).otherwise(_no_spans())
    numbers = F.filter(matches(text, _WIDE_NUMBER), lambda s: (F.length(_digits(s["m"])) >= 7) & ~s["before"].rlike(r"[\p{L}_]$") & ~s["after"].rlike(r"^[\p{L}_@]"))
    spelled = text.rlike(r"[0-9](?: ?[\[(](?:\.|dot)[\])] ?| \. | dot )[0-9]")
    ips = F.when(spelled, F.filter(matches(text, _WIDE_IP), lambda s: ~s["m"].rlike(r"^[0-9.]+$") & ~s["before"].rlike(r"[\p{L}_]$") & ~s["after"].rlike(r"^[\p{L}_@]"))).otherwise(_no_spans())
    return F.concat(emails, words, numbers, matches(text, _GROUP), ips)


def _feature_values(s: Column) -> dict[str, Column]:
    m = s["m"]
    digits, dots = _digits(m), F.regexp_replace(m, "[^.]", "")
    flag = lambda c: c.cast("int")
    at = m.rlike(r"@|\[at\]|\(at\)| at ")
    first = F.regexp_extract(m, "[0-9]+", 0)
    values = {
        "at": flag(at),
        "domain": flag(m.rlike(_DOMAIN)),
        "digits": F.length(digits),
        "groups": F.size(F.regexp_extract_all(m, F.lit("[0-9]+"), 0)),
        "first": F.length(first),
        "last": F.length(F.regexp_extract(m, "([0-9]+)[^0-9]*$", 1)),
        "dots": F.length(dots),
        "dashes": F.length(F.regexp_replace(m, "[^-]", "")),
        "slashes": F.length(F.regexp_replace(m, "[^/]", "")),
        "brackets": flag(m.rlike("[()]")),
        "plus": flag(F.startswith(m, F.lit("+"))),
        "zero": flag(F.startswith(first, F.lit("0"))) + flag(F.startswith(first, F.lit("00"))),
        "luhn": flag(F.when(at | ~F.length(digits).between(16, 19), False).otherwise(luhn(digits))),
        "bytes": flag(F.regexp_replace(m, _DOT, ".").rlike(_IP_FITS)),
        "date": flag(m.rlike(_DATE)),
        "social": flag(m.rlike(_SOCIAL)),
        "spelled": flag(m.rlike(r"[\[(](?:at|dot|\.)[\])]| dot ")),
        "spaced": flag(m.rlike(r" ?@ | @")),
    }
    for k in ("digits", "groups", "first", "last", "dashes", "zero"):  # digits of a name say nothing about an address
        values[k] = F.when(at, 0).otherwise(values[k])
    values |= {f"said_{k}": flag(s["before"].rlike(_CONTEXT[k])) for k in KINDS}
    return {k: F.least(values[k], F.lit(FEATURES[k])) for k in FEATURES}


@dataclass(frozen=True)
class Trees:
    """Trees as (feature, limit, left, right) or a number; their sum over `least` chooses a span."""

    trees: tuple
    least: float

    def score(self, x: dict[str, Column]) -> Column:
        def walk(t) -> Column:
            return F.lit(float(t)) if not isinstance(t, tuple) else F.when(x[t[0]] <= t[1], walk(t[2])).otherwise(walk(t[3]))

        total = F.lit(0.0)
        for t in self.trees:
            total = total + walk(t)
        return total


def boost(rows: np.ndarray, label: np.ndarray, weight: np.ndarray, names: list[str], rounds: int = 12, depth: int = 3, rate: float = 0.6, decay: float = 0.3) -> tuple[tuple, np.ndarray]:
    """Gradient boosting for the logistic loss with second-order leaf values, on weighted rows of small whole numbers;
    also the rows' scores."""
    total = float(weight.sum())
    prior = float(np.log((weight @ label + 1) / (total - weight @ label + 1)))
    score, trees = np.full(len(rows), prior), [prior]

    def grow(at: np.ndarray, g: np.ndarray, h: np.ndarray, left: int):
        value = rate * g[at].sum() / (h[at].sum() + decay)
        best = None
        if left:
            gain0 = g[at].sum() ** 2 / (h[at].sum() + decay)
            for f in range(rows.shape[1]):
                x = rows[at, f]
                gs, hs = np.bincount(x, g[at]), np.bincount(x, h[at])
                gl, hl = np.cumsum(gs)[:-1], np.cumsum(hs)[:-1]
                gains = gl**2 / (hl + decay) + (gs.sum() - gl) ** 2 / (hs.sum() - hl + decay) - gain0
                if len(gains) and (best is None or gains.max() > best[0]) and gains.max() > 1e-6:
                    best = (gains.max(), f, int(np.argmax(gains)))
        if best is None:
            score[at] += value
            return value
        _, f, limit = best
        low = rows[at, f] <= limit
        return (names[f], limit, grow(at[low], g, h, left - 1), grow(at[~low], g, h, left - 1))

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        trees.append(grow(np.arange(len(rows)), weight * (label - p), weight * p * (1 - p), depth))
    return tuple(trees), score


def _harmless(s: Column, x: dict[str, Column]) -> Column:
    """Whether a candidate is known to be of no kind: an at without a domain; a date; a number of three, two and four
    digits; a bare, decimal or version number that is no address, card or phone number by its form. Of the last only
    those of which the text before does not speak; the others are so whatever it says."""
    said = sum((x[f"said_{k}"] for k in KINDS), F.lit(0)) > 0
    version = s["m"].rlike(_VERSION) & ~s["m"].rlike(_DOTTED_PHONE) & (x["bytes"] == 0) & (x["luhn"] == 0)
    return F.when(x["at"] == 1, x["domain"] == 0).otherwise((x["date"] == 1) | (x["social"] == 1) | (~said & version))


def _overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


_EVENT = "struct<start: bigint, wide: int, end: bigint, id: int, hit: boolean>"


def _free(wide: Column, found: Column) -> Column:
    """The candidates that overlap none of the found spans: one walk from left to right, which knows how far the spans
    begun so far reach, and one back, which knows where the next begins."""

    def event(s: Column, is_wide: int, i: Column) -> Column:
        return F.struct(s["start"].alias("start"), F.lit(is_wide).alias("wide"), s["end"].alias("end"), i.cast("int").alias("id"), F.lit(False).alias("hit"))

    def seen(state: Column, e: Column, new: Column, hit: Column) -> Column:
        out = F.struct(e["start"].alias("start"), e["wide"].alias("wide"), e["end"].alias("end"), e["id"].alias("id"), (e["hit"] | ((e["wide"] == 1) & hit)).alias("hit"))
        return F.struct(F.when(e["wide"] == 0, new).otherwise(state).alias("state"), out.alias("out"))

    def free(wide: Column) -> Column:
        events = F.sort_array(F.concat(F.transform(found, lambda s: event(s, 0, F.lit(-1))), F.transform(wide, lambda s, i: event(s, 1, i))))
        there = _walk(events, _EVENT, F.lit(0).cast("long"), lambda reach, e: seen(reach, e, F.greatest(reach, e["end"]), reach > e["start"]))
        back = _walk(F.reverse(there), _EVENT, F.lit(2**62), lambda next_, e: seen(next_, e, e["start"], next_ < e["end"]))
        return F.transform(F.filter(back, lambda e: (e["wide"] == 1) & ~e["hit"]), lambda e: F.element_at(wide, e["id"] + 1))

    return _let(wide, lambda w: F.when(F.size(w) > 0, F.when(F.size(found) > 0, free(w)).otherwise(w)).otherwise(w))


def _disguised(kind: int, m: Column) -> Column:
    """Other writings of a span: an address spelled out in brackets or words, or with spaces; numbers of an address with other dots; a card
    with dots or dashes; a phone number without its plus sign, with zeros for it, or without its country code."""
    if KINDS[kind] == "email":
        spelled = F.regexp_replace(F.regexp_replace(m, "@", " [at] "), r"\.", " [dot] ")
        worded = F.regexp_replace(F.regexp_replace(m, "@", " at "), r"\.", " dot ")
        return F.array(spelled, worded, F.regexp_replace(m, "@", "(at)"), F.regexp_replace(m, "@", " @ "))
    if KINDS[kind] == "ip":
        return F.array(*(F.regexp_replace(m, r"\.", dot) for dot in ("[.]", "(dot)", " . ", " dot ")))
    if KINDS[kind] == "card":
        return F.array(*(F.regexp_replace(_digits(m), "(.{4})(?=.)", way) for way in ("$1.", "$1 - ", "$1/")))
    bare, zeros = F.regexp_replace(m, r"^\+", ""), F.regexp_replace(m, r"^\+", "00")
    own = F.regexp_replace(m, r"^\+[0-9]{1,3}[\x20.-]*", "")
    digits = _digits(own)
    trunk = F.regexp_replace(digits, r"^(.{2,3})(.*)$", "0$1 $2")
    return F.array(bare, zeros, own, trunk, F.regexp_replace(trunk, " ", "/"), F.regexp_replace(trunk, r"^(\S+) ", "($1) "), F.regexp_replace(digits, r"^(.{3})(.{3})(.+)$", "$1-$2-$3"))


def _of_no_kind(kind: int, m: Column) -> Column:
    """What stands in a span's place and is none: an address without its domain; numbers too large for an address; a card whose check digit is
    wrong; a date, a number of three, two and four digits and a version, of a phone number's digits."""
    if KINDS[kind] == "email":
        return F.array(F.regexp_replace(m, r"@([A-Za-z0-9-]+).*$", "@$1"), F.regexp_replace(m, r"@([A-Za-z0-9-]+).*$", " @ $1"))
    if KINDS[kind] == "ip":
        return F.array(F.regexp_replace(m, "^[0-9]+", "345"), F.regexp_replace(F.regexp_replace(m, "^[0-9]+", "345"), r"\.", "[.]"))
    digits = _digits(m)
    if KINDS[kind] == "card":
        wrong = F.concat(F.substring(digits, F.lit(1), F.length(digits) - 1), ((F.right(digits, F.lit(1)).cast("int") + 1) % 10).cast("string"))
        return F.array(wrong, *(F.regexp_replace(wrong, "(.{4})(?=.)", way) for way in ("$1 ", "$1.")))
    last = F.right(F.concat(F.lit("000000000"), digits), F.lit(9))
    ways = {r"^..(..)(..).(.)(.)$": "20$1-0$3-1$4", "^(.)(.)(.)(.)(..)...$": "1$1/0$2/20$5", "^(...)(..)(....)$": "$1-$2-$3", "^..(.)(..)(....)$": "$1.$2.$3", "^(..)(..)(....).$": "2021$1$2 $3"}
    return F.array(*(F.regexp_replace(last, pattern, way) for pattern, way in ways.items()))


def _rewritten(found: DataFrame) -> DataFrame:
    """fold, s, is_ columns and none of the candidates in base spans (fold, base) that are written in other ways, or have something of
    no kind in their place. Each stands once in the text around the span, and once, unless it is digits alone, without that."""
    ways_of = lambda kind: lambda b: F.struct(F.lit(kind).alias("kind"), b["before"].alias("before"), b["after"].alias("after"), _disguised(kind, b["m"]).alias("ways"), _of_no_kind(kind, b["m"]).alias("others"))
    each = F.concat(*(F.transform(f"base.{k}", ways_of(i)) for i, k in enumerate(KINDS)))
    ways = found.select("fold", F.explode(each).alias("b"))
    way = lambda none: lambda m: F.struct(F.lit(none).alias("none"), m.alias("m"))
    said = F.concat(F.transform("b.ways", way(0)), F.transform("b.others", way(1)))
    ways = ways.select("fold", "b.kind", "b.before", "b.after", F.explode(said).alias("w")).select("fold", "kind", "before", "after", "w.none", "w.m")
    bare = ways.filter(~F.col("m").rlike("^[0-9]*$")).withColumn("before", F.lit(" ")).withColumn("after", F.lit(" "))
    ways = ways.unionByName(bare)
    spans = ways.withColumn("s", F.explode(wide_spans(F.concat("before", "m", "after")))).filter((F.col("s.start") < F.length("before") + F.length("m")) & (F.length("before") < F.col("s.end")))
    # the text before a span may run into it: what begins there is no writing of the span
    spans = spans.filter(F.col("s.start") >= F.length("before"))
    return spans.select("fold", "s", *(((F.col("kind") == i) & (F.col("none") == 0)).cast("int").alias(f"is_{k}") for i, k in enumerate(KINDS)), "none")


def learn(df: DataFrame, precision: float = 0.95, text: str = "text") -> dict[str, Trees]:
    """By kind, trees that tell the spans of that kind, and the threshold at which `precision` of what they choose is.

    Spans of a kind are what a base span of the kind overlaps. Each base span is also written in other ways, which the
    base does not know, and the generators run over that. Of no kind are candidates that are known
    to be harmless, those that are base spans of another kind, and things of no kind written in a base span's place. Any other candidate may be either: it takes no part,
    so the number of such candidates does not bound what is chosen. For the threshold, each of FOLDS parts of the documents
    is judged by trees fitted on the other parts, and all these scores count together, so no few documents decide; it lies in the middle between the
    least score that is chosen and the next one. A kind that has no such threshold is logged and has no trees. Candidates come to the driver as counts of equal feature vectors.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    fold = F.pmod(F.xxhash64(t), F.lit(FOLDS)).cast("int")
    found = df.select(fold.alias("fold"), F.struct(*(c.alias(k) for k, c in base_spans(t).items())).alias("base"), wide_spans(t).alias("wide")).filter(F.size("wide") > 0)
    names, is_ = list(FEATURES), [f"is_{k}" for k in KINDS]
    kinds = [F.exists(F.col(f"base.{k}"), lambda b: _overlaps(b, F.col("s"))).cast("int").alias(f"is_{k}") for k in KINDS]
    spans = found.select("fold", "base", F.explode("wide").alias("s")).select("fold", "s", *kinds, F.lit(0).alias("none")).unionByName(_rewritten(found))
    each = spans.select("fold", "s", "none", *is_, *(c.alias(k) for k, c in _feature_values(F.col("s")).items()))
    each = each.withColumn("harmless", _harmless(F.col("s"), {k: F.col(k) for k in names}).cast("int"))
    known = each.filter(F.greatest("harmless", "none", *is_) > 0)
    counts = known.groupBy("fold", *names, *is_).agg(F.count("*").alias("n")).collect()
    counts.sort(key=lambda r: tuple(r))
    rows = np.array([[r[x] for x in names] for r in counts], np.int64).reshape(len(counts), len(names))
    n, part = np.array([r["n"] for r in counts], float), np.array([r["fold"] for r in counts])
    out = {}
    for kind in KINDS:
        is_kind = np.array([r[f"is_{kind}"] for r in counts], float)
        least = _calibrated(rows, is_kind, n, part, names, precision) if is_kind.any() and not is_kind.all() else None
        if least is None:
            logging.getLogger(__name__).warning("no %s is added: %s", kind, "no threshold is precise enough" if is_kind.any() else "the documents have none to learn from")
            continue
        out[kind] = Trees(boost(rows, is_kind, n, names)[0], least)
    return out


def _calibrated(rows: np.ndarray, label: np.ndarray, weight: np.ndarray, part: np.ndarray, names: list[str], precision: float) -> float | None:
    """The least threshold at which that share of what is chosen has the label, or None. A part is scored by trees of the
    others, or, where these have one label alone, of all."""
    score = np.zeros(len(rows))
    for fold in np.unique(part):
        test = part == fold
        fit = ~test if len(np.unique(label[~test])) == 2 else np.ones(len(rows), bool)
        trees, _ = boost(rows[fit], label[fit], weight[fit], names)
        score[test] = [_walked(trees, r, names) for r in rows[test]]
    order = np.argsort(-score, kind="stable")
    right = np.cumsum((weight * label)[order]) / np.cumsum(weight[order])
    ranked = np.append(score[order], score.min() - 1)
    good = np.flatnonzero((right >= precision) & (ranked[1:] < ranked[:-1]))  # thresholds lie between different scores
    return max(float(ranked[good[-1]] + ranked[good[-1] + 1]) / 2, 0.0) if len(good) else None


def _walked(trees: tuple, row: np.ndarray, names: list[str]) -> float:
    """The score of one row, added up in the order of Trees.score."""
    total = 0.0
    for t in trees:
        while isinstance(t, tuple):
            t = t[2] if row[names.index(t[0])] <= t[1] else t[3]
        total += float(t)
    return total


def all_spans(text: Column, models: dict[str, Trees]) -> Column:
    """kind, start and end of all spans, by kind in the order of KINDS, then start."""
    return _let(_bases(text), lambda found: _with_added(text, found, models))


def _bases(text: Column) -> Column:
    def of(kind: str) -> Callable[[Column], Column]:
        return lambda s: F.struct(F.lit(KINDS.index(kind)).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))

    return F.concat(*(F.transform(c, of(k)) for k, c in base_spans(text).items()))


def _with_added(text: Column, found: Column, models: dict[str, Trees]) -> Column:
    """The spans found with those that the models add. Chosen candidates that overlap a base span of any kind are left
    out, and so are those that overlap an earlier chosen one."""
    if not models:
        return found

    def judged(s: Column) -> Column:
        def best(x: Column) -> Column:
            values = {k: x[k] for k in FEATURES}
            options = [F.struct((m.score(values) - m.least).alias("over"), F.lit(-KINDS.index(k)).alias("kind")) for k, m in models.items()]
            return F.array_max(F.array(*options))

        features = F.struct(*(c.alias(k) for k, c in _feature_values(s).items()))
        return _let(_let(features, best), lambda b: F.struct((-b["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), b["over"].alias("over")))

    kept = "struct<kind: int, start: bigint, end: bigint>"

    def apart(end: Column, s: Column) -> Column:
        free = s["start"] >= end
        return F.struct(F.when(free, s["end"]).otherwise(end).alias("state"), F.when(free, F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("out"))

    chosen = F.filter(F.transform(_free(wide_spans(text), found), judged), lambda s: s["over"] >= 0)
    ordered = F.sort_array(F.transform(chosen, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.sort_array(F.concat(found, F.filter(_walk(ordered, kept, F.lit(0).cast("long"), apart), lambda s: s.isNotNull())))


def find(df: DataFrame, models: dict[str, Trees], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds base and spans to the columns of keep: arrays of kind (its place in KINDS), start and end (code points, end
    exclusive), the second with what the models add.

    A null text is empty and has none. Rows are judged one by one, so repeated rows get the same answer; columns other
    than those of keep are left out. An empty table gives an empty one.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), t.alias("t"), _bases(t).alias("base"))
    return rows.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "base", _with_added(F.col("t"), F.col("base"), models).alias("spans"))


def redact(df: DataFrame, models: dict[str, Trees], text: str = "text") -> DataFrame:
    """The rows with every span of the text replaced by its kind in brackets; spans that overlap become one, with the
    kind of the first. A null text stays null; other columns are unchanged."""
    t = F.coalesce(F.col(text), F.lit(""))
    tags = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def cutout(spans: Column) -> Column:
        ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

        def step(at: Column, s: Column) -> Column:
            gap = F.struct(at.alias("start"), s["start"].alias("end"), s["kind"].alias("kind"))
            return F.struct(F.greatest(at, s["end"]).alias("state"), F.when(s["start"] >= at, gap).alias("out"))

        def block(gaps: Column) -> Callable[[Column], Column]:
            def joined(own: Column) -> Column:
                first, last = F.element_at(own, 1)["start"], F.element_at(own, -1)["end"]

                def cut(piece: Column) -> Column:
                    return F.array_join(F.transform(own, lambda g: F.concat(F.substring(piece, (g["start"] - first).cast("int") + 1, (g["end"] - g["start"]).cast("int")), F.element_at(tags, g["kind"] + 1))), "")

                return _let(F.substring(t, first.cast("int") + 1, (last - first).cast("int")), cut)

            return lambda j: _let(F.slice(gaps, j * _BLOCK + 1, _BLOCK), joined)

        gaps = F.filter(_walk(ordered, "struct<start: bigint, end: bigint, kind: int>", F.lit(0).cast("long"), step), lambda g: g.isNotNull())
        pieces = _let(gaps, lambda g: F.transform(F.sequence(F.lit(0), F.floor((F.size(g) - 1) / _BLOCK).cast("int")), block(g)))
        last = F.array_max(F.transform(spans, lambda s: s["end"])).cast("int")
        return F.concat(F.array_join(pieces, ""), F.substring(t, last + 1, F.length(t)))

    return df.withColumn(text, _let(all_spans(t, models), lambda s: F.when(F.size(s) > 0, cutout(s)).otherwise(F.col(text))))


def listed(spans: Column) -> Column:
    """kind:start:end of the spans, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
