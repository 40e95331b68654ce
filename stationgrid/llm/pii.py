"""Personal data: overlapping candidates, boosted trees, calibrated thresholds.

Base spans follow fixed formats and always stay. Around them, generators of high recall
propose more: written-out and bracketed addresses, numbers grouped like telephone or card
numbers without the base format, colon-separated addresses. Boosted trees judge each by format and
context; a span is added if its calibrated probability reaches its kind's threshold, the
likelier one first where proposals overlap.

There are no labels of personal data, so the trees learn from the corpus itself: from a bounded
sample of documents (``sample_docs``) the base spans, also rewritten into the formats of the
generators, are right, and the other candidates and base spans with changed digits are wrong. A second part
of the sample calibrates the scores and sets the thresholds.
"""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationgrid.llm.common import bounded_sample, map_batches, texts

KINDS = ("email", "ip", "card", "phone")
SAMPLE_DOCS = 4000
PRECISION = 0.98
#: Letters of context on either side that features look at.
AROUND = 24

# Base formats, each linear in the text: runs are taken whole, never tried again from within.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_CHAIN = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}+")
_PART = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Generators.
_SPELT = re.compile(r"\b[A-Za-z0-9._%+-]{1,64} ?[\[({]? ?(?:at|@) ?[\])}]? ?[A-Za-z0-9-]{1,64}(?: ?[\[({]? ?(?:dot|\.) ?[\])}]? ?[A-Za-z0-9-]{1,24}){1,4}\b", re.I)
_SPELT_HINT = re.compile(r"[\[({ ]dot[\])} ]|[\[({] ?(?:at|@|\.) ?[\])}]", re.I)
_GROUPS = re.compile(r"(?<![0-9])\(?[0-9]{2,}\)?(?:[ ./-]{1,2}\(?[0-9]{2,}\)?){1,7}(?![0-9])|(?<![0-9A-Za-z])[0-9]{7,19}(?![0-9A-Za-z])")
_COLONS = re.compile(r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{0,4}(?::{1,2}[0-9A-Fa-f]{1,4}){2,7}(?![0-9A-Fa-f:])")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_HINTS = {
    "email": ("mail", "contact", "write", "kontakt", "correo", "courriel"),
    "ip": ("ip", "address", "host", "server", "adresse"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta"),
    "phone": ("tel", "phone", "call", "fax", "mobil", "ruf"),
}


class Span(NamedTuple):
    kind: str
    start: int
    end: int


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The fixed formats, leftmost and not overlapping within a kind, by start and kind."""
    found: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            found.append(Span("email", start, end := m.end()))
        else:
            end = max(end, 0)
        at = text.find("@", max(at + 1, end))
    if _DIGIT.search(text):
        for m in _CHAIN.finditer(text):
            parts = list(_PART.finditer(text, m.start(), m.end()))
            for k in range(0, len(parts) - 3, 4):
                four = parts[k: k + 4]
                if all(len(p[0].lstrip("0")) <= 3 and int(p[0][-3:]) <= 255 for p in four):
                    found.append(Span("ip", four[0].start(), four[3].end()))
        for m in _CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append(Span("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                    found.append(Span("phone", *m.span()))
    return ordered(found)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def candidates(text: str) -> list[Span]:
    """Proposals beyond the base formats; they may overlap each other."""
    found = []
    if _SPELT_HINT.search(text):
        found += [Span("email", *m.span()) for m in _SPELT.finditer(text) if "@" in m[0] or " at" in m[0].lower() or "at)" in m[0].lower() or "at]" in m[0].lower()]
    if _DIGIT.search(text):
        for m in _GROUPS.finditer(text):
            n = len(_NOT_DIGIT.sub("", m[0]))
            if 7 <= n <= 15:
                found.append(Span("phone", *m.span()))
            if 13 <= n <= 19:
                found.append(Span("card", *m.span()))
        if ":" in text:
            found += [Span("ip", *m.span()) for m in _COLONS.finditer(text)]
    return found


FEATURES = 22


def features(text: str, span: Span, rivals: int = 0) -> list[float]:
    """Format of the span and what stands around it."""
    s = text[span.start: span.end]
    before, after = text[max(0, span.start - AROUND): span.start], text[span.end: span.end + 2]
    digits = _NOT_DIGIT.sub("", s)
    groups = _PART.findall(s)
    low, left = s.lower(), before.lower()
    octets = [int(g[-4:]) for g in groups] or [999]
    return [
        KINDS.index(span.kind), len(s), len(digits), len(digits) / len(s), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
        float(luhn(digits)) if 12 <= len(digits) <= 19 else -1.0, float(s.startswith("+") or before.endswith("+")), float("(" in s), s.count("-"), s.count("."), s.count(":"), s.count(" "),
        float("@" in s or "at" in low), float("dot" in low or "." in s), max(octets), sum(c.isalpha() for c in s),
        float(before[-1:].isalnum()), float(after[:1].isalnum()), float(any(h in left for h in _HINTS[span.kind])), float(rivals),
    ]


class Boosted:
    """Boosted trees of depth 3 on binned features: squared-gradient splits of the logistic loss."""

    def __init__(self, rounds: int = 60, rate: float = 0.2, depth: int = 3, bins: int = 32):
        self.rounds, self.rate, self.depth, self.bins = rounds, rate, depth, bins
        self.trees: list[list] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        b = self._binned(x)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        z = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-z))
            tree = self._grow(b, y - p, p * (1 - p), np.arange(len(y)), self.depth)
            self.trees.append(tree)
            z += self._walk(tree, b)
        return self

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1).astype(np.int16)

    def _grow(self, b, g, h, rows, depth) -> list:
        value = [float(self.rate * g[rows].sum() / (h[rows].sum() + 1.0))]
        if depth == 0 or len(rows) < 8:
            return value
        best, split = 1e-6, None
        whole = g[rows].sum() ** 2 / (h[rows].sum() + 1.0)
        for j, e in enumerate(self.edges):
            if not len(e):
                continue
            gs, hs = (np.bincount(b[rows, j], w[rows], len(e) + 1).cumsum() for w in (g, h))
            gain = gs[:-1] ** 2 / (hs[:-1] + 1) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + 1) - whole
            if gain.max() > best:
                best, split = gain.max(), (j, int(gain.argmax()))
        if split is None:
            return value
        j, at = split
        low = b[rows, j] <= at
        return [j, at, self._grow(b, g, h, rows[low], depth - 1), self._grow(b, g, h, rows[~low], depth - 1)]

    def _walk(self, tree, b) -> np.ndarray:
        if len(tree) == 1:
            return np.full(len(b), tree[0])
        j, at, low, high = tree
        left = b[:, j] <= at
        out = np.empty(len(b))
        out[left], out[~left] = self._walk(low, b[left]), self._walk(high, b[~left])
        return out

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(x)
        return self.base + sum((self._walk(t, b) for t in self.trees), np.zeros(len(x)))


class Detector(NamedTuple):
    trees: Boosted
    slope: float
    shift: float
    thresholds: tuple[float, ...]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.trees.raw(x) + self.shift, -50, 50)))

    def select(self, docs: list[tuple[str, list[Span]]]) -> list[list[Span]]:
        """Added spans of each (text, base spans): judged together, so that trees run on whole arrays."""
        proposed = [[c for c in candidates(t) if not any(c.start < b.end and b.start < c.end for b in base)] for t, base in docs]
        flat = [(k, c, features(docs[k][0], c, len(cs) - 1)) for k, cs in enumerate(proposed) for c in cs]
        chosen: list[list[Span]] = [[] for _ in docs]
        if not flat:
            return chosen
        p = self.probability(np.array([f for *_, f in flat], dtype=np.float64))
        for i in np.argsort(-p, kind="stable"):
            k, c, _ = flat[i]
            if p[i] >= self.thresholds[KINDS.index(c.kind)] and not any(c.start < o.end and o.start < c.end for o in chosen[k]):
                chosen[k].append(c)
        return chosen


def examples(text: str, seed: int) -> list[tuple[list[float], int]]:
    """Features and class of what one document of the sample teaches."""
    rng = np.random.default_rng(seed)
    base, out = base_spans(text), []

    def shown(kind: str, s: Span, new: str, label: int) -> None:
        around = text[: s.start] + new + text[s.end:]
        out.append((features(around, Span(kind, s.start, s.start + len(new))), label))

    for s in base:
        old = text[s.start: s.end]
        digits = _NOT_DIGIT.sub("", old)
        other = "".join(str(d) for d in rng.integers(0, 10, max(len(digits), 1)))
        shown(s.kind, s, old, 1)
        if s.kind == "email":
            local, domain = old.split("@", 1)
            shown("email", s, f"{local} at {domain.replace('.', ' dot ')}", 1)
            shown("email", s, f"{local}[at]{domain.replace('.', '[dot]')}", 1)
        elif s.kind == "phone":
            shown("phone", s, re.sub(r"^\+[0-9]+[ -]?", "", old), 1)
            shown("phone", s, "-".join((digits[-10:-7], digits[-7:-4], digits[-4:])), 1)
            shown("phone", s, other[:7], 0)
            year, month, day, hour = 1950 + rng.integers(100), 1 + rng.integers(12), 1 + rng.integers(31), rng.integers(24)
            for date in (f"{year}-{month:02d}-{day:02d} {hour:02d}", f"{day:02d}.{month:02d}.{year}", f"{year}/{month:02d}/{day:02d}", f"{year}-{year + 1} {hour:02d}"):
                shown("phone", s, date, 0)
        elif s.kind == "card":
            shown("card", s, ".".join(digits[i: i + 4] for i in range(0, len(digits), 4)), 1)
            shown("card", s, digits[:4] + "  " + digits[4:], 1)
            shown("card", s, other, int(luhn(other)))
            shown("phone", s, other[: rng.integers(7, 15)], 0)
        else:
            shown("ip", s, ":".join(f"{int(x):x}" for x in rng.integers(4096, 65535, 8)), 1)
            shown("ip", s, ":".join(f"{x:02d}" for x in rng.integers(0, 60, 3)), 0)
            shown("phone", s, old.replace(".", "-"), 0)
    for c in candidates(text):
        if not any(c.start < b.end and b.start < c.end for b in base):
            out.append((features(text, c), 0))
    return out


def fit_detector(rows: list[tuple[int, list[float], int]], precision: float = PRECISION) -> Detector | None:
    """Trees on two thirds of the sampled documents, calibration on the rest; None without both classes."""
    if not rows:
        return None
    fold = np.array([r[0] % 3 == 0 for r in rows])
    x, y = np.array([r[1] for r in rows], dtype=np.float64), np.array([r[2] for r in rows], dtype=np.float64)
    if len(set(y[~fold])) < 2 or len(set(y[fold])) < 2:
        return None
    trees = Boosted().fit(x[~fold], y[~fold])
    raw = trees.raw(x[fold])
    slope, shift = 1.0, 0.0
    for _ in range(30):  # logistic calibration: Newton steps on two numbers
        p = 1 / (1 + np.exp(-np.clip(slope * raw + shift, -50, 50)))
        w = p * (1 - p) + 1e-6
        h = np.array([[(w * raw * raw).sum() + 1e-2, (w * raw).sum()], [(w * raw).sum(), w.sum() + 1e-2]])
        slope, shift = np.array([slope, shift]) + np.linalg.solve(h, np.array([((y[fold] - p) * raw).sum(), (y[fold] - p).sum()])) * 0.7
    p = 1 / (1 + np.exp(-np.clip(slope * raw + shift, -50, 50)))
    thresholds = []
    for k in range(len(KINDS)):
        own = x[fold][:, 0] == k
        order = np.argsort(-p[own])
        right = y[fold][own][order].cumsum() / np.arange(1, own.sum() + 1)
        good = np.flatnonzero(right >= precision)
        if not len(good):
            thresholds.append(2.0)  # never
            continue
        last, after = np.append(p[own][order], 0.0)[[good[-1], good[-1] + 1]]
        thresholds.append(max(0.5, float(last + after) / 2))
    return Detector(trees, float(slope), float(shift), tuple(thresholds))


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Detector | None:
    def teach(batch):
        out = [(d, f, y) for d, t in zip(batch.column("_hash").to_pylist(), batch.column("text").to_pylist()) for f, y in examples(t, d)]
        return dict(zip(("fold", "x", "y"), zip(*out), strict=True)) if out else None

    sample = bounded_sample(texts(docs), sample_docs).withColumn("_hash", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)).cast("int"))
    rows = map_batches(sample.select("_hash", "text"), teach, "fold int, x array<double>, y int").orderBy("fold", "x", "y").collect()  # bounded by the sample
    return fit_detector([(r["fold"], list(r["x"]), r["y"]) for r in rows])


def find_personal_data(docs: DataFrame, detector: Detector | None, redact: bool = False) -> DataFrame:
    """doc_id, counts and digest of the base spans, all spans; with ``redact`` also the text with [kind] in their place.

    Null and empty texts have no spans; repeated rows each give a row; without a detector (a sample
    without examples of both kinds) only base spans are found.
    """
    docs = texts(docs)
    key = docs.schema["doc_id"].dataType.simpleString()

    def find(batch):
        text = batch.column("text").to_pylist()
        base = [base_spans(t) for t in text]
        added = detector.select(list(zip(text, base))) if detector else [[] for _ in text]
        spans = [ordered([*b, *a]) for b, a in zip(base, added)]
        out = {"doc_id": batch.column("doc_id")}
        out |= {f"n_{k}": [sum(s.kind == k for s in b) for b in base] for k in KINDS}
        out |= {"base_sha256": [hashlib.sha256(joined(b).encode()).hexdigest() for b in base], "spans": [joined(s) for s in spans]}
        if redact:
            out["redacted"] = [redacted(t, s) for t, s in zip(text, spans)]
        return out

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return map_batches(docs, find, f"doc_id {key}, {counts}, base_sha256 string, spans string" + ", redacted string" * redact)


def redacted(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for s in spans:
        if s.end > at:
            out += [text[at: max(at, s.start)], f"[{s.kind}]"]
            at = s.end
    return "".join([*out, text[at:]])


def detect(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    return find_personal_data(docs, train(docs, sample_docs))
