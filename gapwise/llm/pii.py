"""Personal data: generators of candidates, judged by gradient-boosted trees.

Patterns of high recall propose overlapping spans of each kind; boosted regression trees on features of the span's
format and its context give each a log-odds; for each kind a threshold, calibrated on samples held out, selects what is
redacted. Spans of the base patterns always stay, and the method adds others that don't overlap them.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import arrow_map, least_hashed

KINDS = ["email", "ip", "card", "phone"]
#: Base patterns (fixed values of the contract). A lookbehind marks where a run of digits begins: later starts in it fail alike.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Candidates of the method, each of bounded length.
_WIDE = [
    ("email", re.compile(r"\b[A-Za-z0-9._%+-]{1,64}(?: ?(?:\(at\)|\[at\]|\{at\}) ?| at |@)[A-Za-z0-9-]{1,63}(?:(?:\.| ?(?:\(dot\)|\[dot\]) ?| dot )[A-Za-z0-9-]{2,63}){1,4}")),
    ("ip", re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){2,7}:?[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")),
    ("ip", re.compile(r"(?<![0-9.])[0-9]{1,3}(?:(?:\.|\[\.\]|\(\.\)| ?\[dot\] ?| ?\(dot\) ?)[0-9]{1,3}){3}(?![0-9.])")),
    ("card", re.compile(r"(?<![0-9])[0-9]{4}(?:[\x20./_-]{1,2}[0-9]{4}){2}[\x20./_-]{1,2}[0-9]{1,7}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9])\+[0-9]{1,3}[\x20./-]?(?:\([0-9]{1,4}\)[\x20./-]?)?[0-9]{2,5}(?:[\x20./-][0-9]{2,5}){1,4}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9.+])(?:00[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[\x20./-])[0-9]{2,4}[\x20./-]?[0-9]{2,5}(?:[\x20./-][0-9]{2,5})?(?![0-9.])")),
]
_CONTEXT = [re.compile(p, re.I) for p in (r"mail|contact|write", r"\bip\b|host|server|address", r"card|visa|credit|payment", r"phone|tel|call|fax|mobile", r"version|page|isbn|year|figure|section|\$|€|£|%")]
_DIGIT_BEFORE, _DIGIT_AFTER = re.compile(r"[0-9][\x20()./_-]{1,2}\Z"), re.compile(r"[\x20()./_-]{1,2}[0-9]")
#: Training: documents read, in expectation, chosen by hash; candidates at most; made-up ones of each kind and label.
SAMPLE_DOCS, SAMPLE_CANDIDATES, MADE = 1000, 20_000, 400
#: Boosting: trees, depth, learning rate, share held out, and the precision that the threshold must reach on that.
TREES, DEPTH, RATE, HELD_OUT, PRECISION = 40, 3, 0.2, 0.3, 0.98


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As the base pattern's leftmost matches: before each @ the longest run of local characters not yet used."""
    used, last, at = 0, -1, text.find("@")
    while at >= 0:
        lo = max(used, last + 1)
        start = lo + len(text[lo:at].rstrip(_LOCAL))
        m = _HOST.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            used = m.end()
        last, at = at, text.find("@", max(at + 1, used))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, stop) of all base matches, in that order."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _starts(pattern: re.Pattern, text: str) -> Iterator[tuple[int, int]]:
    """A match from every place where one begins, so that matches overlap."""
    m = pattern.search(text)
    while m:
        yield m.start(), m.end()
        m = pattern.search(text, m.start() + 1)


def _cards(text: str) -> Iterator[tuple[int, int]]:
    """In runs of digits and single separators all spans of whole groups with 12 to 19 digits."""
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            groups = [(m.start() + g.start(), m.start() + g.end()) for g in re.finditer("[0-9]+", m.group())]
            for i, (a, _) in enumerate(groups):
                n = 0
                for c, e in groups[i : i + 19]:
                    n += e - c
                    if n > 19:
                        break
                    if n >= 12:
                        yield a, e


def candidates(text: str) -> list[tuple[int, int, int]]:
    """Overlapping spans proposed by all generators."""
    out = {(a, KINDS.index(k), e) for k, p in _WIDE for a, e in _starts(p, text)}
    out |= {(m.start(), 1, m.end()) for m in _IP.finditer(text)} | {(m.start(), 3, m.end()) for m in _PHONE.finditer(text)}
    return sorted(out | {(a, 2, e) for a, e in _cards(text)})


class Covered:
    """Spans of a text in order of start: whether another one overlaps any, by the furthest stop up to a place."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        self.own, self.starts = set(spans), [s[0] for s in spans]
        self.stops = list(accumulate((s[2] for s in spans), max))

    def meets(self, a: int, e: int) -> bool:
        k = bisect_left(self.starts, e)
        return k > 0 and self.stops[k - 1] > a


def label(text: str, span: tuple[int, int, int], held: Covered) -> float | None:
    """1: a base span; 0: a verified look-alike apart from those; None: not known.

    Look-alikes: a card without a right check digit, an address that can't be read as one, a phone of under 7 or over 15
    digits or that is a date, an email whose last part is no name of letters.
    """
    if span in held.own:
        return 1.0
    a, kind, b = span
    if held.meets(a, b):
        return None
    s = text[a:b]
    digits = "".join(c for c in s if c in "0123456789")
    if kind == 0:
        return None if re.search(r"[A-Za-z]{2,}$", s) else 0.0
    if kind == 1:
        try:
            ipaddress.ip_address(re.sub(r"\s?[\[(](?:\.|dot)[\])]\s?", ".", s))
        except ValueError:
            return 0.0
        return None
    if kind == 2:
        return None if luhn(digits) and 12 <= len(digits) <= 19 else 0.0
    dated = re.fullmatch(r"(?:(?:19|20)[0-9]{2}([./-])(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12][0-9]|3[01])|(?:0[1-9]|[12][0-9]|3[01])([./-])(?:0[1-9]|1[0-2])\2(?:19|20)[0-9]{2})", s)
    return 0.0 if dated or not 7 <= len(digits) <= 15 else None


def features(text: str, span: tuple[int, int, int]) -> list[float]:
    """Numbers on the span's format, then its context."""
    a, kind, b = span
    s, before, after = text[a:b], text[max(0, a - 40) : a], text[b : b + 20]
    digits = "".join(c for c in s if c in "0123456789")
    groups = [g for g in re.split(r"[^0-9]+", s) if g]
    seps = {c for c in s if not c.isalnum()}
    form = [kind, b - a, len(digits), len(digits) / (b - a), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0), len(seps), s.count("."), s.count(":"), s.count("-"), s.count(" "), "(" in s, "@" in s or "at" in s, "dot" in s or "." in s, luhn(digits) if digits else 0, len(set(map(len, groups))), int(digits[:1] or 0), s.startswith("00"), sum(c in "abcdefABCDEF" for c in s) / (b - a)]
    near = [before[-1:].isalnum(), after[:1].isalnum(), before[-1:] == " ", before[-1:] in "#/=_-.", *(bool(p.search(before)) for p in _CONTEXT), bool(_CONTEXT[4].search(after[:3])), bool(_DIGIT_BEFORE.search(before)), bool(_DIGIT_AFTER.match(after))]
    return [float(x) for x in form + near]


class BoostedTrees:
    """Gradient boosting of the logistic loss with small regression trees on binned features."""

    def fit(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> BoostedTrees:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, 17)[1:-1], method="lower")) for c in x.T]
        binned = np.column_stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T, strict=True)])
        p = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base, self.trees = float(np.log(p / (1 - p))), []
        f = np.full(len(y), self.base)
        for _ in range(trees):
            prob = 1 / (1 + np.exp(-f))
            tree = self._grow(binned, y - prob, prob * (1 - prob), np.arange(len(y)), depth, rate)
            self.trees.append(tree)
            f += self._follow(tree, x)
        return self

    def _grow(self, binned: np.ndarray, g: np.ndarray, h: np.ndarray, own: np.ndarray, depth: int, rate: float):
        leaf = rate * g[own].sum() / (h[own].sum() + 1.0)
        if depth == 0 or len(own) < 8:
            return float(leaf)
        best = (1e-6, None, None)
        whole = g[own].sum() ** 2 / (h[own].sum() + 1.0)
        for j, cuts in enumerate(self.cuts):
            n = len(cuts) + 1
            gs, hs = np.cumsum(np.bincount(binned[own, j], g[own], n))[:-1], np.cumsum(np.bincount(binned[own, j], h[own], n))[:-1]
            if not len(gs):
                continue
            gain = gs**2 / (hs + 1.0) + (g[own].sum() - gs) ** 2 / (h[own].sum() - hs + 1.0) - whole
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), j, k)
        if best[1] is None:
            return float(leaf)
        _, j, k = best
        left = binned[own, j] <= k
        return j, float(self.cuts[j][k]), self._grow(binned, g, h, own[left], depth - 1, rate), self._grow(binned, g, h, own[~left], depth - 1, rate)

    def _follow(self, tree, x: np.ndarray) -> np.ndarray:
        if isinstance(tree, float):
            return np.full(len(x), tree)
        j, cut, low, high = tree
        return np.where(x[:, j] <= cut, self._follow(low, x), self._follow(high, x))

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((self._follow(t, x) for t in self.trees), np.zeros(len(x)))


def made_up(n: int = MADE, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of made-up spans: personal data in other formats than the base ones, and look-alikes."""
    rng = np.random.default_rng(seed)
    num = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    word = lambda: "".join(rng.choice(list("abcdefghijklmnoprstuvw"), rng.integers(3, 9)))

    def card(sep: str) -> str:
        body = str(rng.integers(3, 7)) + num(14)
        return sep.join(re.findall("....", body + next(d for d in "0123456789" if luhn(body + d))))

    def wrong(sep: str) -> str:
        body = num(15)
        return sep.join(re.findall("....", body + next(d for d in "0123456789" if not luhn(body + d))))

    pick = lambda *a: a[rng.integers(len(a))]
    good = [
        lambda: f"{word()}.{word()}{pick(' (at) ', ' [at] ', '(at)', '[at]')}{word()}{pick('.', ' (dot) ', '[dot]')}{pick('com', 'org', 'net', 'de')}" if rng.random() < 0.8 else f"{word()} at {word()} dot {pick('com', 'org')}",
        lambda: pick(":".join(f"{rng.integers(0, 1 << 16):x}" for _ in range(8)), pick("[.]", "(.)", "[dot]", " (dot) ").join(str(rng.integers(0, 256)) for _ in range(4))),
        lambda: card(pick(".", "/", "_", "  ")),
        lambda: pick(f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}", f"0049 {num(3)} {num(4)} {num(3)}", f"+{rng.integers(1, 99)}/{num(3)}/{num(4)}/{num(3)}"),
    ]
    bad = [
        lambda: f"{word()} at {word()}.{pick(word().capitalize(), 'com', 'org')}",
        lambda: pick(f"{num(2)}:{num(2)}:{num(2)}", pick(".", "[.]").join(str(rng.integers(256, 999)) for _ in range(4))),
        lambda: wrong(pick(" ", "-", ".", "/")),
        lambda: pick(f"{num(4)}-{num(2)}-{num(2)}", f"{num(2)}/{num(2)}/{num(4)}", f"{num(3)} {num(3)}", f"{num(2)} {num(2)} {num(2)}", f"{num(4)} {num(4)}"),
    ]
    cue = [["mail me at", "contact:"], ["host", "server"], ["card", "visa"], ["phone", "call", "tel."]]
    x, y = [], []
    for good_one, makers in ((1, good), (0, bad)):
        for kind, make in enumerate(makers):
            for _ in range(n):
                s = make()
                lead = f"{word()} {pick(*cue[kind]) if rng.random() < (0.4 if good_one else 0.1) else word()} "
                text = f"{lead}{s} {word()}"
                found = [c for c in candidates(text) if c[1] == kind and c[0] < len(lead) + len(s) and c[2] > len(lead)]
                x += [features(text, c) for c in found]
                y += [good_one if c == (len(lead), kind, len(lead) + len(s)) else 0 for c in found]
    return np.array(x), np.array(y, float)


def corpus_samples(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, limit: int = SAMPLE_CANDIDATES) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of candidates in the sample_docs distinct texts of the least hashes, those of unknown label left out (see label).

    Of each kind and label the `limit` / 8 rows of the least hashes of text and place stay.
    """
    picked = least_hashed(docs.select("text"), "text", sample_docs).select("text")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        x, y, h = [], [], []
        for t in b.column(0).to_pylist():
            held, raw = Covered(base_spans(t)), t.encode("utf-8", "replace")
            for c in candidates(t):
                if (known := label(t, c, held)) is not None:
                    x.append(features(t, c))
                    y.append(known)
                    h.append(xxhash.xxh64_intdigest(raw, c[0] * 4 + c[1]) >> 1)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), pa.array(y, pa.float64()), pa.array(h, pa.int64())], names=["x", "y", "h"])

    found = arrow_map(picked, run, "x array<double>, y double, h long")
    rank = F.row_number().over(W.partitionBy(F.get("x", F.lit(0)), "y").orderBy("h", "x"))
    rows = found.withColumn("r", rank).where(F.col("r") <= max(1, limit // 8)).orderBy("h", "x", "y").select("x", "y").collect()
    if not rows:
        return np.zeros((0, 0)), np.zeros(0)
    return np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows])


Model = tuple[BoostedTrees, np.ndarray]


def train(docs: DataFrame) -> Model:
    """(trees, least log-odds of each kind): a kind's threshold is the lowest at which its samples held out reach PRECISION.

    The precision is counted with one miss more than there was, so that few samples don't make a threshold; a kind
    whose samples never reach it selects nothing.
    """
    x, y = made_up()
    own, labels = corpus_samples(docs)
    if len(own):
        x, y = np.concatenate([x, own]), np.concatenate([y, labels])
    order = np.random.default_rng(11).permutation(len(y))
    cut = int(len(y) * HELD_OUT)
    test, fit = order[:cut], order[cut:]
    trees = BoostedTrees().fit(x[fit], y[fit])
    least = np.full(len(KINDS), np.inf)
    for kind in range(len(KINDS)):
        rows = test[x[test, 0] == kind]
        odds = trees.log_odds(x[rows])
        by = np.argsort(-odds, kind="stable")
        precision = np.cumsum(y[rows][by]) / (np.arange(len(rows)) + 2)
        # Not within a run of equal odds: all of it is selected, or none.
        ends = np.append(odds[by][1:] < odds[by][:-1], True)[: len(rows)]
        fine = np.flatnonzero((precision >= PRECISION) & ends)
        if len(fine):
            least[kind] = odds[by][fine[-1]]
    return trees, least


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, counts and digest of base spans, spans) of every text: spans as "kind:start:end", by start, then kind.

    Positions are code points, end exclusive. Of overlapping spans that the trees select the likeliest stays.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        trees, least = held.value
        texts = [t or "" for t in b.column(1).to_pylist()]
        base, more, x = [base_spans(t) for t in texts], [], []
        for i, t in enumerate(texts):
            covered = Covered(base[i])
            for c in candidates(t):
                if not covered.meets(c[0], c[2]):
                    more.append((i, c))
                    x.append(features(t, c))
        spans = [list(s) for s in base]
        if more:
            x = np.array(x)
            odds = trees.log_odds(x)
            taken: dict[int, list[tuple[int, int]]] = {}
            for k in np.argsort(-odds, kind="stable"):
                i, (a, kind, e) = more[k]
                if odds[k] < least[kind]:
                    continue
                own = taken.setdefault(i, [])  # in order and apart: only the neighbours can meet
                j = bisect_left(own, (a, e))
                if (j == 0 or own[j - 1][1] <= a) and (j == len(own) or own[j][0] >= e):
                    insort(own, (a, e))
                    spans[i].append((a, kind, e))
        show = lambda s: ",".join(f"{KINDS[k]}:{a}:{e}" for a, k, e in sorted(s))
        counts = [pa.array([sum(s[1] == k for s in own) for own in base], pa.int64()) for k in range(len(KINDS))]
        digest = [hashlib.sha256(show(s).encode()).hexdigest() for s in base]
        return pa.RecordBatch.from_arrays([b.column(0), *counts, pa.array(digest), pa.array([show(s) for s in spans])], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), run, schema)


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans): counts and digest of base spans, and all spans.

    Null text: as empty, no span. Null doc_id and repeated rows are scanned like any row. An empty table gives an
    empty result. Extra columns are not read.
    """
    return scan(docs, train(docs))


def op5_pii(spark, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
