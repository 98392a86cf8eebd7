"""N-gram Jaccard self-join with prefix filters under several global token orders.

A document's set holds the hashes of its distinct word 5-grams. Two sets that link share a token in the
prefixes of both under every global order of the tokens, so a pair is a candidate only if it does under
all of several orders; the filters are intersected before the sets are compared.

1. Blocks ask how many documents hold each token. A token of one document links nothing, so a document
   whose other tokens are too few for the threshold is done: nothing of it goes further.
2. Sets that are equal become one node, known by 128 bits of a hash. Its prefixes under all orders are columns. The
   first order is by frequency (rare first); a token's bucket holds the nodes with it in that prefix.
3. Rounds by stars: in each bucket the nodes are compared with one centre. What then shares a component
   needs no comparison, so a large group of copies costs a pass and not its square.
4. A last round compares what shares a bucket and not a component; no component is lost. A large bucket is cut
   into blocks and every pair of blocks is a cell of its own, so no task holds a bucket.
5. In each round, a candidate pair must also meet in the prefixes of the other orders; only then do the sets travel.

Defined results: null or empty texts, and texts without words, have an empty set and link nothing; a
repeated row is a copy of the other; a null id is no smallest id; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm import blocks as B
from tapeloom.llm import counts, hashing
from tapeloom.llm.common import cut, drop, salted_join, sweep
from tapeloom.llm.graph import components

WORDS, PERCENT = 5, 75
#: Bits of a token's hash that a request carries; more than one token behind one count only makes it look more common.
ASKED_BITS = 48
#: Other orders than by frequency: the tokens that more documents hold, by these hashes.
ORDERS = (0x51ED270B0B4DD2A5, 0xC2B2AE3D27D4EB4F)
#: Rounds by stars; nodes of a block of a bucket, about.
STARS, CELL = 2, 256
SETS = "doc_id long, n_shingles long, node binary, rank double, tokens binary, prefix array<long>, second array<long>, third array<long>"
_COLUMNS = [c.split()[0] for c in SETS.split(", ")]


def doc_sets(t: B.Texts) -> list[np.ndarray]:
    """Sorted distinct token hashes of each text."""
    starts, ends, first = hashing.word_bounds(t.data, t.offs)
    words = hashing.mix(hashing.word_hashes(t.data, starts, ends))
    i = np.arange(max(0, len(words) - WORDS + 1))
    grams = hashing.slices(words, i, i + WORDS)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= WORDS:
            out.append(np.unique(grams[a : b - WORDS + 1]))
        elif b > a:
            out.append(hashing.slices(words, np.array([a]), np.array([b])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _ask(buckets: int):
    def f(block: pa.Table):
        sets = [s for t in B.texts(block) for s in doc_sets(t)]
        h, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_counts=True)
        yield from counts.requests(h, n, buckets, ASKED_BITS)

    return f


def least_overlap(n):
    """Tokens that a set of n must share with any set that it links."""
    return (PERCENT * n + 99) // 100


def _answer(buckets: int):
    def f(block: pa.Table, got: dict[int, bytes]) -> pa.Table:
        steps = [(t, doc_sets(t)) for t in B.texts(block)]
        every = np.unique(np.concatenate([np.zeros(0, np.uint64), *(s for _, sets in steps for s in sets)]))
        held = counts.answers(every, got, buckets)
        out: dict[str, list] = {k: [] for k in _COLUMNS}
        for t, sets in steps:
            out["doc_id"] += [None if x else i for i, x in zip(t.ids.tolist(), t.null.tolist(), strict=True)]
            for s in sets:
                df = held[np.searchsorted(every, s)]
                shared = df > 1
                n, m = len(s), int(shared.sum())
                row = (None,) * 6
                if n and m >= least_overlap(n):
                    node = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                    s, df = s[shared], df[shared]
                    s = s[np.lexsort((s, df))]
                    k = m - least_overlap(n) + 1
                    others = (s[np.argpartition(hashing.mix(s ^ np.uint64(o)), k - 1)[:k]] for o in ORDERS)
                    row = (node, float(np.log(df).sum() / n), s.astype("<u8").tobytes(), s[:k].view(np.int64), *(p.view(np.int64) for p in others))
                out["n_shingles"].append(n)
                for k, x in zip(_COLUMNS[2:], row, strict=True):
                    out[k].append(x)
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.float64(), pa.binary(), *[pa.list_(pa.int64())] * 3)
        return pa.table([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))

    return f


def _linked(batches):
    """Keeps the pairs that link."""
    for batch in batches:
        keep = []
        known: dict[bytes, np.ndarray] = {}

        def seen(node, raw):
            if node not in known:
                if len(known) > 5000:
                    known.clear()
                known[node] = np.sort(np.frombuffer(raw, "<u8"))
            return known[node]

        cols = [batch.column(c).to_pylist() for c in ("a", "n_a", "tokens_a", "b", "n_b", "tokens_b")]
        for a, na, ra, b, nb, rb in zip(*cols, strict=True):
            both = len(np.intersect1d(seen(a, ra), seen(b, rb), assume_unique=True))
            keep.append(100 * both >= PERCENT * (na + nb - both))
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep, pa.bool_())), batch.column("b").filter(pa.array(keep, pa.bool_()))], ["a", "b"])


def _meet(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The candidates of the first order that are candidates under every other order, too."""
    one = nodes.select(F.col("node").alias("a"), F.col("second").alias("second_a"), F.col("third").alias("third_a"))
    two = nodes.select(F.col("node").alias("b"), F.col("second").alias("second_b"), F.col("third").alias("third_b"))
    both = pairs.join(one, "a").join(two, "b")
    return both.filter(F.arrays_overlap("second_a", "second_b") & F.arrays_overlap("third_a", "third_b")).select("a", "b")


def _verify(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    one = nodes.select(F.col("node").alias("a"), F.col("n_shingles").alias("n_a"), F.col("tokens").alias("tokens_a"))
    two = nodes.select(F.col("node").alias("b"), F.col("n_shingles").alias("n_b"), F.col("tokens").alias("tokens_b"))
    return pairs.join(one, "a").join(two, "b").mapInArrow(_linked, "a binary, b binary")


def _cells(open_: DataFrame) -> DataFrame:
    """Pairs (a, b) of one token and two components. A bucket has blocks of about CELL nodes, and a row goes to the
    cells of its block with each block of the bucket."""
    size = open_.groupBy("token").agg(F.ceil(F.count("*") / CELL).cast("int").alias("blocks"))
    own = open_.join(size, "token").withColumn("k", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    own = own.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"lo": F.least("k", "j"), "hi": F.greatest("k", "j")})
    x, y = own.alias("x"), own.alias("y")
    on = (F.col("x.token") == F.col("y.token")) & (F.col("x.lo") == F.col("y.lo")) & (F.col("x.hi") == F.col("y.hi")) & (F.col("x.comp") != F.col("y.comp"))
    on &= (F.col("x.k") < F.col("y.k")) | ((F.col("x.lo") == F.col("x.hi")) & (F.col("x.node") < F.col("y.node")))
    on &= _may_link(F.col("x.n"), F.col("y.n"), F.col("x.left"), F.col("y.left"))
    return x.join(y, on).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))


def _may_link(na, nb, left_a, left_b):
    """Sizes and the tokens from the shared one on allow the threshold."""
    return (100 * F.least(na, nb) >= PERCENT * F.greatest(na, nb)) & ((100 + PERCENT) * F.least(left_a, left_b) >= PERCENT * (na + nb))


def similarity_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links)."""
    blocks = B.n_blocks(docs, text_col)
    buckets = B.n_buckets(blocks)
    packed = B.pack(docs, id_col, text_col, blocks)
    served = B.serve(B.ask(packed, _ask(buckets)), counts.serve)
    sets = cut(B.answer(packed, served, _answer(buckets), SETS))
    del packed, served
    sweep(docs.sparkSession)  # the blocks and their requests
    copies = sets.filter("node is not null")
    nodes = cut(copies.groupBy("node").agg(*(F.first(c).alias(c) for c in ("n_shingles", *_COLUMNS[3:]))))
    # a prefix token with the number of tokens from it on; those that no other node has stand before all others
    spread = nodes.select("node", F.col("n_shingles").alias("n"), "rank", F.posexplode("prefix").alias("at", "token"), (F.octet_length("tokens") / 8).cast("long").alias("m"))
    bucketed = spread.select("token", "node", "n", "rank", (F.col("m") - F.col("at")).alias("left"))
    labels = None
    for turn in range(STARS + 1):
        held = bucketed.withColumn("comp", F.col("node")) if labels is None else bucketed.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        by = F.col("rank") if turn == 0 else F.xxhash64("node", F.lit(turn))
        mid = held.groupBy("token").agg(F.max(F.struct(by.alias("by"), "node", "n", "left", "comp")).alias("c"), F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low != high")
        if turn < STARS:
            pairs = held.join(mid, "token").filter((F.col("comp") != F.col("c.comp")) & _may_link(F.col("n"), F.col("c.n"), F.col("left"), F.col("c.left")))
            pairs = pairs.select(F.least("c.node", "node").alias("a"), F.greatest("c.node", "node").alias("b"))
        else:
            pairs = _cells(held.join(mid.select("token"), "token"))
        edges = cut(_verify(_meet(pairs.distinct(), nodes), nodes))
        if edges.limit(1).count():
            linked = edges if labels is None else edges.union(labels.select(F.col("node").alias("a"), F.col("comp").alias("b")))
            was, labels = labels, components(linked.filter("a != b"))
            drop(was)
        drop(edges)
    slim = cut(sets.select("doc_id", "n_shingles", "node"))
    drop(sets)
    drop(nodes)
    sweep(docs.sparkSession)
    copies = slim.filter("node is not null")
    least = copies.groupBy("node").agg(F.min("doc_id").alias("d"))
    if labels is not None:
        least = least.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        least = salted_join(least.select("node", "comp"), least.groupBy("comp").agg(F.min("d").alias("d")), "comp", F.col("node")).select("node", "d")
    joined = salted_join(copies.select("doc_id", "n_shingles", "node"), least, "node", F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", F.col("d").alias("component_id")).union(slim.filter("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
