"""Benchmark decontamination: BM25 over an inverted index of test items, searched by block-max WAND.

The items are the index, every passage of every training document is a query. A term's postings are its items
in order with their weights, in blocks that know their largest weight. All items that reach the threshold are
retrieved: the terms are put in order of their next items, the pivot is where the sum of their largest weights
reaches the threshold, and a pivot is only scored where the sum of its blocks' largest weights does, too. Most
passages are told without a search, many at once: the largest weights of their terms, over all items and then
over each of RANGES ranges of items, don't reach the threshold. What is retrieved is verified by the n-grams of
the item's question and of its answer (its last sentence) that the document holds.

Number, mean length and document frequencies are counted over all items, so weights, scores and results don't
depend on how the index is cut: it is built, broadcast and searched in shards of about SHARD_BYTES of items, and a
shard's postings are no more than its words, its table of ranges has RANGES numbers a distinct word. More items mean more shards, each asked by all documents.

Defined results: null or empty texts and items match nothing; an item with a null id is no item; repeated
items give a row each, repeated documents repeated results; a document that holds an item twice gives one row;
ties all count; empty tables give empty results; other columns are carried by ``clean`` as they are.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm import columns, hashing
from tapeloom.llm.common import bounded, cut, drop
from tapeloom.llm.hashing import gather

K1, B_LENGTH = 1.2, 0.75
WINDOW, STRIDE = 32, 16
#: A passage must hold so much of the BM25 mass of the item's best passage; a document so much of its n-grams, and of
#: those of question and answer each.
RETRIEVE, OVERLAP, PART, NGRAM = 0.3, 0.6, 0.5, 4
#: Postings of a block; ranges of items, and wider ones; bytes of items in a shard, about; passages that are looked at together.
BLOCK, RANGES, COARSE, SHARD_BYTES, TOGETHER = 32, 64, 16, 4 << 20, 5_000
FOUND = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, overlap double"
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _terms(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (letters and digits, Latin-1 capitals as small letters), and the first word of each text."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    data = data.copy()
    capital = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    data[capital] += 0x20
    word = np.zeros(len(data) + 2, np.int8)
    word[1:-1] = _WORD[data]
    step = np.diff(word)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    inner = offs[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    inner = np.unique(inner[(word[inner] == 1) & (word[inner + 1] == 1)])  # a word never crosses two texts
    starts, ends = np.sort(np.concatenate([starts, inner])), np.sort(np.concatenate([ends, inner]))
    return hashing.word_hashes(data, starts, ends), np.searchsorted(starts, offs)


def _of(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return _terms(raw, np.array([0, len(raw)]))[0]


def _grams(words: np.ndarray) -> np.ndarray:
    n = min(NGRAM, len(words))
    i = np.arange(len(words) - n + 1) if n else np.zeros(0, np.int64)
    return np.unique(hashing.slices(hashing.mix(words), i, i + n))


def split_answer(text: str) -> tuple[str, str]:
    """Question and answer: the last sentence is the answer; of a single sentence, the second half."""
    parts = [m.end() for m in re.finditer(r"[.!?]\s+(?=\S)", text)]
    cut = parts[-1] if parts else (text.rfind(" ", 0, len(text) // 2 + 1) + 1 or len(text))
    return text[:cut], text[cut:]


class Index:
    """The inverted index of a shard. df(terms) are the document frequencies of sorted distinct terms over all items;
    ``n`` and ``mean`` are the number and the mean number of words of all items."""

    def __init__(self, items: list[tuple[int, str]], df: Callable[[np.ndarray], np.ndarray], n: int, mean: float):
        words = [_of(t or "") for _, t in items]
        items, words = [x for x, w in zip(items, words, strict=True) if len(w)], [w for w in words if len(w)]
        self.ids = np.array([i for i, _ in items], np.int64)
        self.terms = np.unique(np.concatenate([np.zeros(0, np.uint64), *words]))
        held = df(self.terms).astype(np.float64)
        idf = np.log(1 + (n - held + 0.5) / (held + 0.5))
        term, item, weight = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for d, own in enumerate(words):
            place = np.searchsorted(self.terms, own)
            t, tf = np.unique(place, return_counts=True)
            size = len(own)
            w = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B_LENGTH + B_LENGTH * size / mean))
            most = max(float(w[np.searchsorted(t, np.unique(place[a : a + WINDOW]))].sum()) for a in range(max(1, size - WINDOW + 1)))
            term.append(t)
            item.append(np.full(len(t), d))
            weight.append(w / max(most, 1e-9))  # a passage can't hold more of a long item than the item's best passage
        term, item, weight = (np.concatenate(x) for x in (term, item, weight))
        order = np.lexsort((item, term))
        term, self.item, self.weight = term[order], item[order], weight[order]
        self.first = np.searchsorted(term, np.arange(len(self.terms) + 1))
        size = np.diff(self.first)
        blocks = -(-size // BLOCK)
        self.first_block = np.concatenate([[0], np.cumsum(blocks)])
        start = np.repeat(self.first[:-1] - BLOCK * self.first_block[:-1], blocks) + BLOCK * np.arange(self.first_block[-1])
        end = np.minimum(start + BLOCK, np.repeat(self.first[1:], blocks))
        self.block_max = np.maximum.reduceat(self.weight, start) if len(start) else np.zeros(0)
        self.block_last = self.item[end - 1] if len(start) else np.zeros(0, np.int64)
        self.most = np.maximum.reduceat(self.weight, self.first[:-1]) if len(self.terms) else np.zeros(0)
        at = self.item * RANGES // max(1, len(items))
        self.range_max = np.zeros((len(self.terms), RANGES), np.float32)
        np.maximum.at(self.range_max, (np.repeat(np.arange(len(self.terms)), size), at), self.weight.astype(np.float32))
        self.coarse_max = self.range_max.reshape(-1, COARSE, RANGES // COARSE).max(2)
        halves = [split_answer(t) for _, t in items]
        self.question, self.answer, self.grams = [_grams(_of(q)) for q, _ in halves], [_grams(_of(a)) for _, a in halves], [_grams(w) for w in words]

    @functools.cached_property
    def _lists(self) -> dict[int, list[list]]:
        """Of the terms that were asked for: items, weights, and the blocks' last items and largest weights."""
        return {}

    @functools.cached_property
    def lookup(self) -> columns.Lookup:
        return columns.Lookup(self.terms)

    def wand(self, terms: np.ndarray) -> list[tuple[int, float]]:
        """(item, score) of all items that distinct ``terms`` give the threshold, in order of items."""
        out, least = [], RETRIEVE - 1e-9
        # of each term: items, weights, largest weight, place in the list, item there; blocks' ends and largest weights, place
        cursors = []
        for t in terms.tolist():
            if t not in self._lists:
                (a, b), (c, d) = self.first[t : t + 2].tolist(), self.first_block[t : t + 2].tolist()
                self._lists[t] = [x.tolist() for x in (self.item[a:b], self.weight[a:b], self.block_last[c:d], self.block_max[c:d])]
            own = self._lists[t]
            cursors.append([own[0][0], float(self.most[t]), 0, *own])

        def advance(c: list, to: int) -> None:
            """Moves a list on to its first item at or past ``to``."""
            block = bisect_left(c[5], to)
            if block == len(c[5]):
                c[0] = _END
                return
            c[2] = bisect_left(c[3], to, max(c[2], block * BLOCK))
            c[0] = c[3][c[2]]

        while True:
            cursors = [c for c in cursors if c[0] < _END]
            cursors.sort(key=_next_item)
            total, pivot = 0.0, None
            for k, c in enumerate(cursors):
                total += c[1]
                if total >= least:
                    pivot = k
                    break
            if pivot is None:
                return out
            at = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == at:
                pivot += 1
            bound, end = 0.0, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else _END
            for c in cursors[: pivot + 1]:
                block = bisect_left(c[5], at)
                if block < len(c[5]):
                    bound += c[6][block]
                    end = min(end, c[5][block] + 1)
            if bound < least:  # no item before the first of these blocks ends can reach it
                for c in cursors[: pivot + 1]:
                    if c[0] < end:
                        advance(c, end)
            elif cursors[0][0] == at:
                score = 0.0
                for c in cursors[: pivot + 1]:
                    score += c[4][c[2]]
                    advance(c, at + 1)
                if score >= least:
                    out.append((at, score))
            else:
                for c in cursors[:pivot]:
                    if c[0] < at:
                        advance(c, at)

    def search(self, data: np.ndarray, offs: np.ndarray) -> list[tuple[int, int, float, float, float, float]]:
        """(text, item, score, overlaps of question, answer, all) of the verified pairs."""
        words, first = _terms(data, offs)
        term = self.lookup.find(words)
        at = np.flatnonzero(term >= 0)
        term = term[at]
        size = np.diff(first)
        count = np.where(size > 0, np.maximum(1, -(-(size - WINDOW) // STRIDE) + 1), 0)
        text = np.repeat(np.arange(len(size)), count)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        begin = first[:-1][text] + nth * STRIDE
        lo, hi = np.searchsorted(at, begin), np.searchsorted(at, np.minimum(begin + WINDOW, first[1:][text]))
        total = np.concatenate([[0.0], np.cumsum(self.most[term])])
        live = np.flatnonzero(total[hi] - total[lo] >= RETRIEVE - 1e-6)
        best: dict[tuple[int, int], float] = {}
        for live in np.array_split(live, -(-len(live) // TOGETHER)) if len(live) else []:
            # distinct terms of each passage
            pairs = np.sort(np.repeat(np.arange(len(live)), hi[live] - lo[live]) * len(self.terms) + gather(term, lo[live], hi[live] - lo[live]))
            pairs = pairs[np.diff(pairs, prepend=-1) > 0]
            win, own = np.divmod(pairs, len(self.terms))
            keep = np.bincount(win, self.most[own], len(live))[win] >= RETRIEVE - 1e-6
            win, own = win[keep], own[keep]
            if not len(win):
                continue
            starts = np.flatnonzero(np.diff(win, prepend=-1))
            counts = np.diff(np.append(starts, len(win)))
            for table in (self.coarse_max, self.range_max):  # the finer ranges only for what the wider ones leave
                reach = np.flatnonzero((np.add.reduceat(table[gather(own, starts, counts)], np.cumsum(counts) - counts, 0) >= RETRIEVE - 1e-4).any(1))
                starts, counts = starts[reach], counts[reach]
                if not len(reach):
                    break
            for a, n in zip(starts.tolist(), counts.tolist(), strict=True):
                for d, score in self.wand(own[a : a + n]):
                    key = int(text[live[win[a]]]), d
                    best[key] = max(best.get(key, 0.0), score)
        out, held = [], (-1, None)
        for (t, d), score in sorted(best.items()):
            if held[0] != t:
                own = words[first[t] : first[t + 1]]
                held = t, {n: np.sort(hashing.slices(hashing.mix(own), i := np.arange(max(0, len(own) - n + 1)), i + n)) for n in range(1, NGRAM + 1)}
            share = [self._share(g, held[1]) for g in (self.question[d], self.answer[d], self.grams[d])]
            if share[2] >= OVERLAP and min(share[:2]) >= PART:
                out.append((t, d, score, *share))
        return out

    @staticmethod
    def _share(grams: np.ndarray, held: dict[int, np.ndarray]) -> float:
        """Of an item's n-grams (shorter ones if it is shorter), the share that the text holds."""
        if not len(grams):
            return 1.0
        return float(max((h[np.minimum(np.searchsorted(h, grams), len(h) - 1)] == grams).mean() if len(h) else 0.0 for h in held.values()))


_END = 1 << 62


def _next_item(cursor: list) -> int:
    return cursor[0]


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, 1) of each item's distinct words; and of every item a row without a term, with its number of words."""
    for batch in batches:
        for _, _, data, offs in columns.steps(batch.column("t")):
            words, first = _terms(data, offs)
            own = [np.unique(words[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            terms = np.concatenate([np.zeros(0, np.uint64), *own]).view(np.int64)
            sizes = [n for n in np.diff(first).tolist() if n]
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(terms), pa.nulls(len(sizes), pa.int64())]), pa.array([1] * len(terms) + sizes, pa.int64())], ["term", "n"])


def indexes(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[Index]:
    """The shards of the index, one at a time. At the driver is one shard's texts and postings, and the frequencies of its terms."""
    spark = benchmark.sparkSession
    items = benchmark.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    if not size:
        return
    counted = cut(items.select("t").mapInArrow(_words_of, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"), F.count("*").alias("rows")))
    whole = counted.filter("term IS NULL").first()
    table = counted.filter("term IS NOT NULL").select("term", "n")

    def frequencies(terms: np.ndarray) -> np.ndarray:
        own = spark.createDataFrame(pa.table({"term": pa.array(terms.view(np.int64))}))
        got = table.join(F.broadcast(own), "term", "left_semi").toArrow()
        place = np.searchsorted(terms, got.column("term").to_numpy().view(np.uint64))
        out = np.zeros(len(terms), np.int64)
        out[place] = got.column("n").to_numpy()
        return out

    n = -(-size // SHARD_BYTES)
    for k in range(n if whole else 0):
        shard = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).toArrow()
        rows = sorted(zip(shard.column("i").to_pylist(), shard.column("t").to_pylist(), strict=True))
        if rows:
            yield Index(rows, frequencies, whole.rows, whole.n / whole.rows)
    drop(counted)


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and item of which it holds question and answer."""
    bounded(docs.sparkSession)
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = given.sparkSession.createDataFrame([], FOUND)
    for shard in indexes(benchmark, item_id, item_text):
        index = given.sparkSession.sparkContext.broadcast(shard)

        def run(batches, index=index):
            ix = index.value
            for batch in batches:
                rows = [(batch.column("doc_id")[a + t].as_py(), int(ix.ids[d]), *rest) for a, _, data, offs in columns.steps(batch.column("text")) for t, d, *rest in ix.search(data, offs)]
                cols = list(zip(*rows, strict=True)) or [[]] * 6
                kinds = [pa.int64(), pa.int64()] + [pa.float64()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in FOUND.split(", ")])

        out = out.union(given.mapInArrow(run, FOUND))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents, with all their columns, that hold no item."""
    bounded(docs.sparkSession)
    for shard in indexes(benchmark, item_id, item_text):
        index = docs.sparkSession.sparkContext.broadcast(shard)

        def run(batches, index=index):
            ix = index.value
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for a, _, data, offs in columns.steps(batch.column(text_col)):
                    keep[[a + t for t, *_ in ix.search(data, offs)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
