"""Quality by ordinal cumulative-link regression: one weight vector over hashed text features, shared by all
grades, and ordered thresholds between them: P(grade <= k) = logistic(threshold_k - w x). The fit maximises the
likelihood of the graded rows, the product of P(grade <= y) - P(grade <= y - 1).

The fit takes a bounded sample of labelled rows: at most ``rows`` of them, those with the smallest hash of their
id, and of these as many as have ``size`` bytes of text together; scoring reads every document once, without a
shuffle. Features are hashed words, the words' shapes, and whether a word repeats the one or two words before
it, as shares of a text's words.

Defined results: null or empty texts have no features, so their score is the thresholds' alone; repeated
rows give repeated results; in the fit an id that stands on several rows counts once, with its smallest text,
null labels and null ids are no labels, and ids with conflicting labels are left out. Where all labelled rows
have one grade, every document has it; where there are none, scores are null and ``select_documents`` keeps
everything. Empty tables give empty results; other columns are carried by ``select_documents`` as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeloom.llm import columns, hashing
from tapeloom.llm.common import bounded, tidy

#: Rows of the fit at most; dimensions of the hashed features.
ROWS, BITS = 12_000, 17
#: Bytes of text of the fit at most.
SIZE = 64 << 20
EPOCHS, RATE, RIDGE = 60, 0.3, 1e-5
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[48:58], _SHAPE[128:] = ord("A"), ord("a"), ord("0"), ord("a")


def sample(docs: DataFrame, labels: DataFrame, label_col: str, rows: int, id_col: str, text_col: str, where=None, size: int = SIZE) -> tuple[pa.Array, np.ndarray]:
    """Texts and labels of at most ``rows`` labelled documents and ``size`` bytes, by the hash of their id. The
    labels that are joined are as many at most, so they are broadcast; what reaches the driver keeps both bounds."""
    few = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    few = few.filter(where) if where is not None else few
    few = few.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).groupBy("_id").agg(F.min("_y").alias("_y"), F.max("_y").alias("_top")).filter("_y = _top")
    few = few.select("_id", "_y", F.xxhash64("_id").alias("_hash")).orderBy("_hash", "_id").limit(rows)
    got = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).join(F.broadcast(few), "_id")
    one = got.groupBy("_id", "_hash", "_y").agg(F.min("_text").alias("_text"))
    # at most ``rows`` rows: the running size needs one order, and one task for so few
    upto = F.sum(F.octet_length("_text").cast("long")).over(W.orderBy("_hash", "_id").rowsBetween(W.unboundedPreceding, 0))
    own = one.withColumn("_upto", upto).filter(F.col("_upto") <= size).select("_hash", "_id", "_y", F.col("_text").cast("binary").alias("_text")).toArrow()
    order = pc.sort_indices(own.select(["_hash", "_id"]), [("_hash", "ascending"), ("_id", "ascending")])
    texts, y = own.column("_text").take(order), own.column("_y").take(order).to_numpy()
    del own
    return texts.combine_chunks().cast(pa.large_binary()).cast(pa.large_string()), y


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value) of texts that lie in ``data`` at ``offs``."""
    starts, ends, first = hashing.word_bounds(data, offs)
    size = np.diff(first)
    row = np.repeat(np.arange(len(size)), size)
    words = hashing.word_hashes(data, starts, ends)
    shape = _SHAPE[data]
    # runs of one shape count once: its hash sums what differs from the byte before
    turn = np.ones(len(data), bool)
    turn[1:] = shape[1:] != shape[:-1]
    turn[starts] = True
    kept = np.flatnonzero(turn)
    a, b = np.searchsorted(kept, starts), np.searchsorted(kept, ends)
    shapes = hashing.slices(hashing.byte_units(False)[shape[kept]], a, b) ^ np.uint64(0x5A5A)
    at = np.arange(len(words)) - np.repeat(first[:-1], size)
    parts = [(row, words), (row, shapes)]
    for k in (1, 2):
        same = np.flatnonzero((at >= k) & (words == np.roll(words, k)))
        parts.append((row[same], np.full(len(same), hashing.mix(np.array([k]))[0])))
    r = np.concatenate([p for p, _ in parts])
    f = (hashing.mix(np.concatenate([h for _, h in parts])) >> np.uint64(64 - BITS)).astype(np.int64)
    key = np.sort((r << BITS) | f)
    head = np.flatnonzero(np.diff(key, prepend=-1))
    n = np.diff(np.append(head, len(key)))
    r, f = key[head] >> BITS, key[head] & ((1 << BITS) - 1)
    return r, f, np.sqrt(n / np.maximum(size, 1)[r])


class Model:
    def __init__(self, weights: np.ndarray, thresholds: np.ndarray, grades: np.ndarray):
        self.weights, self.thresholds, self.grades = weights, thresholds, grades

    def tails(self, r, f, v, n: int) -> np.ndarray:
        """P(grade > k) of n texts, a column for each threshold."""
        s = np.bincount(r, self.weights[f] * v, n)
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - s[:, None], -60, 60)))


def likelihood(y: np.ndarray, s: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows with grade places ``y`` and linear scores ``s``: P(y), and the derivatives of -log P(y) by the score,
    and (a column for each) by the thresholds."""
    k = len(theta)
    below = 1 / (1 + np.exp(-np.clip(theta[None, :] - s[:, None], -30, 30)))  # P(grade <= j)
    padded = np.concatenate([np.zeros((len(s), 1)), below, np.ones((len(s), 1))], 1)
    row = np.arange(len(s))
    low, high = padded[row, y], padded[row, y + 1]
    p = np.maximum(high - low, 1e-12)
    by_theta = np.zeros((len(s), k))
    has = y < k
    by_theta[row[has], y[has]] = -(high * (1 - high) / p)[has]
    has = y > 0
    by_theta[row[has], y[has] - 1] += (low * (1 - low) / p)[has]
    return p, 1 - high - low, by_theta


def fit(texts: pa.Array, labels: np.ndarray, epochs: int = EPOCHS, ridge: float = RIDGE, balance: bool = True) -> Model:
    """``balance`` weighs a row by the root of its grade's frequency."""
    grades = np.unique(labels)
    if len(grades) < 2:
        return Model(np.zeros(1 << BITS), np.zeros(0), grades)
    y = np.searchsorted(grades, labels)
    parts = []  # of some texts each: what is worked on at once stays small
    for a, b, data, offs in columns.steps(texts):
        r, f, v = features(data, offs)
        parts.append((a, b, r.astype(np.int32), f.astype(np.int32), v.astype(np.float32)))
    n, k = len(texts), len(grades) - 1
    del texts
    tidy()
    share = np.clip(np.array([(y > j).mean() for j in range(k)]), 1e-3, 1 - 1e-3)
    theta = np.log((1 - share) / share)
    free = np.append(theta[:1], np.log(np.maximum(np.diff(theta), 1e-3)))  # thresholds stay ordered
    w = np.zeros(1 << BITS)
    gw, gf = np.full_like(w, 1e-8), np.full_like(free, 1e-8)
    weight = np.bincount(y, minlength=k + 1)[y] ** -0.5 if balance else np.ones(n)
    weight *= n / weight.sum()
    for _ in range(epochs):
        theta = np.cumsum(np.append(free[:1], np.exp(free[1:])))
        score = np.concatenate([np.bincount(r, w[f] * v, b - a) for a, b, r, f, v in parts])
        _, by_score, by_theta = likelihood(y, score, theta)
        by_score *= weight
        dw = ridge * w
        for a, b, r, f, v in parts:
            dw += np.bincount(f, by_score[a:b][r] * v, len(w)) / n
        dt = (by_theta * weight[:, None]).sum(0) / n
        df = np.append(dt.sum(), [dt[j:].sum() * np.exp(free[j]) for j in range(1, k)])
        gw += dw**2
        gf += df**2
        w -= RATE * dw / np.sqrt(gw)
        free -= RATE * df / np.sqrt(gf)
    return Model(w.astype(np.float32).astype(np.float64), np.cumsum(np.append(free[:1], np.exp(free[1:]))), grades)


def _rated(model, texts: pa.Array, least: int) -> tuple[pa.Array, pa.Array]:
    """Expected grade, and P(grade >= least); nulls where no grade is known."""
    m = model.value
    if not len(m.grades):
        return (pa.nulls(len(texts), pa.float64()),) * 2
    out = [np.zeros((0, len(m.thresholds)))]
    for a, b, data, offs in columns.steps(texts):
        out.append(m.tails(*features(data, offs), b - a))
    tails = np.concatenate(out)
    expected = m.grades[0] + tails @ np.diff(m.grades)
    k = int(np.searchsorted(m.grades, least))
    tail = tails[:, k - 1] if 0 < k <= tails.shape[1] else np.full(len(tails), float(k == 0))
    return pa.array(expected, pa.float64()), pa.array(tail, pa.float64())


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", rows: int = ROWS, where=None) -> Model:
    model = fit(*sample(docs, labels, label_col, rows, id_col, text_col, where))
    tidy()
    return model


def rate(docs: DataFrame, model: Model, least: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, expected_grade, tail (the probability of ``least`` or better)."""
    bounded(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *_rated(shared, batch.column("text"), least)], ["doc_id", "expected_grade", "tail"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, expected_grade double, tail double")


def select_documents(docs: DataFrame, model: Model, least: int = 1, tail: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, that reach grade ``least`` with probability ``tail``."""
    bounded(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            yield batch.filter(pc.fill_null(pc.greater_equal(_rated(shared, batch.column(text_col), least)[1], tail), True))

    return docs.mapInArrow(run, docs.schema)
