"""Stupid-backoff scores of every document under the n-gram counts of the whole corpus.

Count tables of words, pairs and triples are partitioned by hash; the n-grams of each block are joined to
them and summed per document. The score of a word is c(u v w) / c(u v) where the triple occurs
``least`` times in the corpus, else ``discount`` times the same for the pair (v w), else
``discount`` squared times c(w) / N. A text's first words have shorter contexts and no discount for that.

An n-gram is known by 64 bits of a hash, at every size of the corpus. Two n-grams that share them share a count:
of n different ones about n^2 / 2^65 pairs do, that is 1 pair at 6 x 10^9 n-grams.

Defined results: null or empty texts, and texts without words, have n_words 0 and score 0; repeated rows
count as often as they stand there; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tapeloom.llm import blocks as B
from tapeloom.llm import counts, hashing

ORDER, BITS = 3, 64
SCHEMA = "doc_id long, n_words long, score double"
#: Stands for all words: its total is N.
ALL = np.uint64(0)


class _Step:
    """Hashes of the n-grams that end at each word (0: the text is too short before it)."""

    def __init__(self, t: B.Texts):
        starts, ends, first = hashing.word_bounds(t.data, t.offs)
        words = hashing.mix(hashing.word_hashes(t.data, starts, ends))
        self.first, n = first, len(words)
        at = np.arange(n) - np.repeat(first[:-1], np.diff(first))
        self.grams = []
        for k in range(1, ORDER + 1):
            g = np.zeros(n, np.uint64)
            end = np.flatnonzero(at >= k - 1) + 1
            g[end - 1] = np.maximum(hashing.slices(words, end - k, end), np.uint64(1))
            self.grams.append(g)


def _distinct(steps: list[_Step]) -> tuple[np.ndarray, np.ndarray]:
    h, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *(g[g > 0] for s in steps for g in s.grams)]), return_counts=True)
    return np.append(ALL, h), np.append(sum(len(s.grams[0]) for s in steps), n)


def _ask(buckets: int):
    def f(block: pa.Table):
        yield from counts.requests(*_distinct([_Step(t) for t in B.texts(block)]), buckets, BITS)

    return f


def _answer(buckets: int, least: int, discount: float):
    def f(block: pa.Table, got: dict[int, bytes]) -> pa.Table:
        given = [(t, _Step(t)) for t in B.texts(block)]
        every, _ = _distinct([s for _, s in given])
        total = counts.answers(every, got, buckets)
        out = {"doc_id": [], "n_words": [], "score": []}
        for t, s in given:
            one, two, three = (total[np.searchsorted(every, g)].astype(np.float64) for g in s.grams)
            has2, has3 = s.grams[1] > 0, s.grams[2] > 0
            # contexts end one word before; position 0 is never used
            ctx1, ctx2 = np.roll(one, 1), np.roll(two, 1)
            p1 = one / total[0]
            p2 = np.where(has2 & (two >= least), two / np.maximum(ctx1, 1), np.where(has2, discount, 1) * p1)
            p3 = np.where(has3 & (three >= least), three / np.maximum(ctx2, 1), np.where(has3, discount, 1) * p2)
            out["doc_id"].append(t.id_array())
            out["n_words"].append(pa.array(np.diff(s.first), pa.int64()))
            out["score"].append(pa.array([float(np.log(p3[a:b]).sum()) for a, b in zip(s.first[:-1].tolist(), s.first[1:].tolist(), strict=True)], pa.float64()))
        kinds = {"doc_id": pa.int64(), "n_words": pa.int64(), "score": pa.float64()}
        return pa.table({k: pa.chunked_array(v, kinds[k]) for k, v in out.items()})

    return f


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 2, discount: float = 0.4) -> DataFrame:
    """One row per document: the number of words and the sum of the natural logarithms of their scores."""
    blocks = B.n_blocks(docs, text_col)
    buckets = B.n_buckets(blocks)
    packed = B.pack(docs, id_col, text_col, blocks)
    served = B.serve(B.ask(packed, _ask(buckets)), counts.serve)
    return B.answer(packed, served, _answer(buckets, least, discount), SCHEMA)
