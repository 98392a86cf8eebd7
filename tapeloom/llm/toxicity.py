"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned from labelled rows: words and beginnings of words that toxic texts hold far more
often. Features are densities of lexicon hits by strength, the nearest second-person word, capitals,
punctuation, and obfuscation (letters written as digits or signs, letters repeated or held apart). The
trees are fitted on one part of a bounded sample of labelled rows (``rows`` and bytes at most, see
``ordinal.sample``), the calibration on the other. Two parameters of the model bound the lexicon: ``entries``,
those with the largest odds, and the beginnings of words that it looks at (4 to 14 bytes, and whole words).

Defined results: null or empty texts have features of zero and the score that those get; repeated rows
give repeated results; in the fit an id that stands on several rows counts once, with its smallest text, null
labels and ids are no labels, and ids with conflicting labels are left out. Without labelled rows of both
classes every score is the smoothed share of toxic rows, (toxic + 1/2) / (rows + 1). Empty tables give empty
results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm import columns, hashing
from tapeloom.llm.common import bounded, tidy
from tapeloom.llm.ordinal import sample

ROWS, CALIBRATE = 12_000, 4  # rows of the fit at most; every fourth calibrates
TREES, DEPTH, RATE, BINS, LEAF, RIDGE = 80, 3, 0.15, 32, 12, 1.0
#: Bytes of a word's beginnings that the lexicon looks at (0: the whole word); texts a lexicon entry needs, its size at most.
BEGINNINGS, ENTRY_LEAST, ENTRIES = (0, *range(4, 15)), 4, 20_000
STRENGTHS = (1.0, 2.0, 3.0, 4.0)
#: Second-person words.
SECOND_PERSON = "you your yours yourself u ur tu te ton ta tes toi vous votre vos du dich dir dein deine euch ihr tú ti tuyo usted ustedes vosotros".split()
#: Signs that stand for letters.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}

_WORD = np.zeros(256, bool)
_WORD[[*range(65, 91), *range(97, 123), *range(128, 256), *map(ord, LEET)]] = True
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
for _a, _b in LEET.items():
    _PLAIN[ord(_a)] = ord(_b)
_UPPER, _DIGIT = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91], _DIGIT[48:58] = True, True
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


class _Words:
    def __init__(self, data: np.ndarray, offs: np.ndarray):
        edge = np.zeros(len(data) + 1, bool)
        edge[offs] = True
        word = _WORD[data]
        before = np.zeros(len(data), bool)
        before[1:] = word[:-1]
        after = np.zeros(len(data), bool)
        after[:-1] = word[1:]
        self.starts = np.flatnonzero(word & (~before | edge[:-1]))
        self.ends = np.flatnonzero(word & (~after | edge[1:])) + 1
        plain = _PLAIN[data]
        capital = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1 if len(data) else []
        plain[capital] += 0x20
        self.units = hashing.byte_units(False)[plain]
        self.first = np.searchsorted(self.starts, offs)
        self.size = self.ends - self.starts

    def hashes(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Words that are longer than ``length`` bytes, and hashes of so many bytes of them (0: the whole word)."""
        at = np.arange(len(self.starts)) if not length else np.flatnonzero(self.size > length)
        ends = self.ends[at] if not length else self.starts[at] + length
        return at, hashing.slices(self.units, self.starts[at], ends) ^ np.uint64(length > 0)


class Lexicon:
    def __init__(self, texts: pa.Array, toxic: np.ndarray, entries: int = ENTRIES):
        n1, n0 = int(toxic.sum()), int((1 - toxic).sum())
        # entries come from toxic texts alone; of the others only how many hold those is counted
        own = self._distinct(texts.filter(pa.array(toxic == 1)))
        h, c = np.unique(np.concatenate([np.zeros(0, np.uint64), *own]), return_counts=True)
        h, c = h[c >= ENTRY_LEAST], c[c >= ENTRY_LEAST]
        held, lookup = np.zeros(len(h), np.int64), columns.Lookup(h)
        for some in self._distinct(texts.filter(pa.array(toxic == 0))):
            at = lookup.find(some)
            held[at[at >= 0]] += 1
        odds = dict(zip(h.tolist(), (np.log((c + 0.5) / (n1 + 1)) - np.log((held + 0.5) / (n0 + 1))).tolist(), strict=True))
        best = sorted(((o, h) for h, o in odds.items() if o >= STRENGTHS[0]), reverse=True)[:entries]
        best.sort(key=lambda x: x[1])
        self.hashes = np.array([h for _, h in best], np.uint64)
        self.odds = np.array([o for o, _ in best] + [0.0])
        person = " ".join(SECOND_PERSON).encode()
        raw = np.frombuffer(person, np.uint8)
        self.person = np.unique(_Words(raw, np.array([0, len(raw)])).hashes(0)[1])

    @staticmethod
    def _distinct(texts: pa.Array) -> Iterator[np.ndarray]:
        """Distinct hashes of the words and beginnings of each text."""
        for raw in texts:
            data = np.frombuffer(raw.as_buffer(), np.uint8) if raw.is_valid and len(raw.as_buffer()) else np.zeros(0, np.uint8)
            w = _Words(data, np.array([0, len(data)]))
            yield np.unique(np.concatenate([w.hashes(k)[1] for k in BEGINNINGS]))


NAMES = [*(f"hits_{s:g}" for s in STRENGTHS), *(f"share_{s:g}" for s in STRENGTHS), "odds", "odds_share", "strongest", "person", "near_person", "capitals", "punctuation", "digits", "obfuscated", "obfuscated_hits", "words"]


def features(lexicon: Lexicon, lookup: columns.Lookup, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    n = len(offs) - 1
    w = _Words(data, offs)
    total = np.maximum(np.diff(w.first), 1)
    row = np.repeat(np.arange(n), np.diff(w.first))
    odds = np.zeros(len(w.starts))
    for k in BEGINNINGS:
        at, h = w.hashes(k)
        odds[at] = np.maximum(odds[at], lexicon.odds[lookup.find(h)])
    hits = np.stack([np.bincount(row, odds >= s, n) for s in STRENGTHS], 1)
    strongest = np.zeros(n)
    np.maximum.at(strongest, row[odds > 0], odds[odds > 0])
    you = np.flatnonzero(np.isin(w.hashes(0)[1], lexicon.person))
    strong = np.flatnonzero(odds >= STRENGTHS[2])
    near = np.zeros(n)
    if len(you) and len(strong):
        p = np.searchsorted(you, strong)
        gap = np.full(len(strong), 1 << 30)
        for q in (np.clip(p, 0, len(you) - 1), np.clip(p - 1, 0, len(you) - 1)):
            gap = np.minimum(gap, np.where(row[you[q]] == row[strong], np.abs(you[q] - strong), 1 << 30))
        np.add.at(near, row[strong], 1 / (1.0 + gap))
    sums = lambda flag: np.diff(np.concatenate([[0], np.cumsum(flag)])[offs])
    size = np.maximum(np.diff(offs), 1)
    odd = np.zeros(len(data) + 1, np.int64)
    signs = _DIGIT[data] | (data == ord("@")) | (data == ord("$"))
    np.cumsum(signs, out=odd[1:])
    letters = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_WORD[data] & ~signs, out=letters[1:])
    masked = (odd[w.ends] > odd[w.starts]) & (letters[w.ends] > letters[w.starts])
    return np.column_stack([
        hits, hits / total[:, None], np.bincount(row, odds, n), np.bincount(row, odds, n) / total, strongest, np.bincount(row[you], minlength=n) / total, near,
        sums(_UPPER[data]) / size, sums(_PUNCT[data]) / size, sums(_DIGIT[data]) / size, np.bincount(row[masked], minlength=n) / total, np.bincount(row[masked & (odds > 0)], minlength=n), np.log1p(np.diff(w.first)),
    ])


class Trees:
    """Boosted regression trees of fixed depth on the logistic loss, with histograms of BINS quantiles."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        codes = self._codes(x)
        n, d = x.shape
        self.base = float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        f = np.full(n, self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            where = np.zeros(n, np.int64)
            feature, cut = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, BINS, np.int64)
            for level in range(DEPTH):
                at, k = 2**level - 1, 2**level
                flat = ((where - at)[:, None] * d + np.arange(d)) * BINS + codes
                sg, sh, sn = (np.bincount(flat.ravel(), np.repeat(v, d), k * d * BINS).reshape(k, d, BINS).cumsum(2) for v in (g, h, np.ones(n)))
                tg, th, tn = sg[:, :, -1:], sh[:, :, -1:], sn[:, :, -1:]
                gain = sg**2 / (sh + RIDGE) + (tg - sg) ** 2 / (th - sh + RIDGE) - tg**2 / (th + RIDGE)
                gain[(sn < LEAF) | (tn - sn < LEAF)] = -1
                flat_gain = gain.reshape(k, -1)
                pick = flat_gain.argmax(1)
                feature[at : at + k], cut[at : at + k] = pick // BINS, np.where(flat_gain.max(1) > 1e-9, pick % BINS, BINS)
                where = 2 * where + 1 + (codes[np.arange(n), feature[where]] > cut[where])
            leaf = where - (2**DEPTH - 1)
            value = RATE * np.bincount(leaf, g, 2**DEPTH) / (np.bincount(leaf, h, 2**DEPTH) + RIDGE)
            self.trees.append((feature, cut, value))
            f += value[leaf]

    def _codes(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T, strict=True)])

    def raw(self, x: np.ndarray) -> np.ndarray:
        codes, f = self._codes(x), np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            where = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                where = 2 * where + 1 + (codes[rows, feature[where]] > cut[where])
            f += value[where - (2**DEPTH - 1)]
        return f


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of a rising curve through (raw, y) by pooling neighbours that fall; ties are pooled first."""
    x, which = np.unique(raw, return_inverse=True)
    blocks: list[list[float]] = []
    for s, n, at in zip(np.bincount(which, y), np.bincount(which), x, strict=True):
        blocks.append([s, n, at, at])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            b = blocks.pop()
            blocks[-1] = [blocks[-1][0] + b[0], blocks[-1][1] + b[1], blocks[-1][2], b[3]]
    means = [(s + 0.01) / (n + 0.02) for s, n, _, _ in blocks]
    at = np.array([v for b in blocks for v in b[2:]])
    return at, np.maximum.accumulate(np.repeat(means, 2))


class Model:
    def __init__(self, texts: pa.Array, labels: np.ndarray):
        y = (labels > 0).astype(np.int64)
        self.prior = (float(y.sum()) + 0.5) / (len(y) + 1)
        self.trees = self.curve = None
        self.lexicon = Lexicon(texts.slice(0, 0), y[:0])
        if not 0 < y.sum() < len(y):
            return
        part = np.arange(len(y)) % CALIBRATE == 0
        half = (np.arange(len(y)) // CALIBRATE) % 2 == 0
        pick = lambda rows: texts.filter(pa.array(rows))
        # a row's own label must not reach its features: each half of the fitting rows has the lexicon of the other
        x = np.zeros((len(y), len(NAMES)))
        for own in (~part & half, ~part & ~half):
            other = ~part & ~own
            if other.any() and 0 < y[other].sum() < other.sum():
                x[own] = self._all(Lexicon(pick(other), y[other]), pick(own))
        if not (~part).any() or not 0 < y[~part].sum() < (~part).sum():
            return
        self.trees = Trees(x[~part], y[~part])
        self.lexicon = Lexicon(pick(~part), y[~part])
        self.curve = isotonic(self.trees.raw(self._all(self.lexicon, pick(part))), y[part])

    @staticmethod
    def _all(lexicon: Lexicon, texts: pa.Array) -> np.ndarray:
        lookup = columns.Lookup(lexicon.hashes)
        return np.concatenate([np.zeros((0, len(NAMES))), *(features(lexicon, lookup, data, offs) for _, _, data, offs in columns.steps(texts))])

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.trees.raw(x), *self.curve) if self.trees else np.full(len(x), self.prior)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", rows: int = ROWS, where=None) -> Model:
    model = Model(*sample(docs, labels, label_col, rows, id_col, text_col, where))
    tidy()
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, score."""
    bounded(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        lookup = columns.Lookup(m.lexicon.hashes)
        for batch in batches:
            got = [m.score(features(m.lexicon, lookup, data, offs)) for _, _, data, offs in columns.steps(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate([np.zeros(0), *got]), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")
