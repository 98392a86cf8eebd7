"""Byte-level BPE over a corpus: each distinct pre-token is encoded once.

Blocks of documents ask for the codes of their distinct pre-tokens; a bucket holds all requests for the
same pre-tokens, encodes each distinct one once and answers; a block puts the codes back by position. Ids
are turned back into bytes by the table of token bytes.

Defined results: a null or empty text has no ids and decodes to no bytes; repeated rows give repeated
results; other columns of the input are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame

from tapeloom.llm import blocks as B
from tapeloom.llm import hashing
from tapeloom.llm.hashing import gather

#: Unicode's White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: Bytes of stored input a block holds about: its ids, bytes and positions are all in memory.
BLOCK_BYTES = 1 << 20
SCHEMA = "doc_id long, n_tokens long, ids binary, decoded binary"


@functools.lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    at = np.concatenate([np.arange(0xD800, dtype="<u4"), np.arange(0xE000, 0x110000, dtype="<u4")])  # no surrogates
    every = at.tobytes().decode("utf-32-le")
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            out[at[m.start() : m.end()]] = kind
    out[WHITE_SPACE] = SPACE
    return out


def token_starts(cp: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens of texts of code points that begin at ``edges`` (the end included): what
    public_tokenizers.PATTERN matches one after another."""
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64)
    kind = char_classes()[cp]
    edge = np.zeros(n + 1, bool)
    edge[edges] = True
    edge[n] = True
    change = edge[:n].copy()
    change[1:] |= kind[1:] != kind[:-1]
    first = np.flatnonzero(change)
    end = np.append(first[1:], n)
    what = kind[first]
    start = np.zeros(n + 1, bool)
    start[first] = True
    # white space before something else of the same text: its last character stands alone or, a blank, joins what follows
    spaced = (what == SPACE) & ~edge[end]
    start[end[spaced] - 1] = True
    start[end[spaced & (cp[end - 1] == 32)]] = False
    # 's 't 'm 'd 're 've 'll where the apostrophe begins a match
    quote = np.flatnonzero((what[:-1] == OTHER) & (what[1:] == LETTER)) if len(first) > 1 else np.zeros(0, np.int64)
    quote = quote[(end[quote] - first[quote] == 1) & (cp[first[quote]] == 39) & start[first[quote]] & ~edge[end[quote]]]
    if len(quote):
        at, size = end[quote], end[quote + 1] - end[quote]
        one = cp[at]
        two = np.where(size > 1, cp[np.minimum(at + 1, n - 1)], 0)
        short = np.isin(one, [115, 116, 109, 100])
        long = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
        start[at[short | long]] = False
        start[(at + 1)[short & (size > 1)]] = True
        start[(at + 2)[long & (size > 2)]] = True
    start[n] = False
    return np.flatnonzero(start)


class Step:
    """Pre-tokens of some texts: their byte bounds, the first pre-token of each text, and hashes."""

    def __init__(self, t: B.Texts):
        lead = (t.data & 0xC0) != 0x80
        at = np.append(np.flatnonzero(lead), len(t.data))
        cp = np.frombuffer(t.data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        edges = np.searchsorted(at, t.offs)
        starts = token_starts(cp, edges)
        ends = np.append(starts[1:], len(cp)) if len(starts) else starts
        self.hash = hashing.slices(hashing.mix(cp.astype(np.uint64) + np.uint64(77)), starts, ends)
        self.begin, self.end, self.first = at[starts], at[ends], np.searchsorted(starts, edges)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def _ask(buckets: int):
    def f(block: pa.Table):
        hashes, words = [np.zeros(0, np.uint64)], []
        for t in B.texts(block):
            s = Step(t)
            h, first = np.unique(s.hash, return_index=True)
            raw = t.data.tobytes()
            hashes.append(h)
            words += [raw[a:b] for a, b in zip(s.begin[first].tolist(), s.end[first].tolist(), strict=True)]
        h, first = np.unique(np.concatenate(hashes), return_index=True)
        where = _bucket(h, buckets)
        for b in np.unique(where):
            own = [words[i] for i in first[where == b].tolist()]
            yield int(b), B.squeeze(np.uint32(len(own)).tobytes() + np.array([len(w) for w in own], "<u4").tobytes() + b"".join(own))

    return f


_ENCODERS: dict[int, tiktoken.Encoding] = {}


def _encoder(ranks: bytes) -> tiktoken.Encoding:
    if (k := hash(ranks)) not in _ENCODERS:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        _ENCODERS[k] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    return _ENCODERS[k]


def _serve(ranks):
    def f(bucket: int, payloads: list[bytes]) -> list[bytes]:
        enc = _encoder(ranks.value)
        known: dict[bytes, list[int]] = {}
        out = []
        for p in payloads:
            raw = B.expand(p)
            n = int(np.frombuffer(raw, "<u4", 1)[0])
            ends = np.cumsum(np.frombuffer(raw, "<u4", n, 4), dtype=np.int64) + 4 + 4 * n
            counts, ids, a = [], [], 4 + 4 * n
            for b in ends.tolist():
                w = raw[a:b]
                got = known.get(w)
                if got is None:
                    got = known[w] = enc._core_bpe.encode_single_piece(w)
                counts.append(len(got))
                ids += got
                a = b
            out.append(B.squeeze(np.uint32(n).tobytes() + np.array(counts, "<u4").tobytes() + np.array(ids, "<u4").tobytes()))
        return out

    return f


_BYTES: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def _byte_table(ranks: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each token id: where its bytes start, how many they are, and all bytes."""
    if (k := hash(ranks)) not in _BYTES:
        pairs = {int(b): base64.b64decode(a) for a, b in map(bytes.split, ranks.splitlines()) if a}
        tokens = [pairs.get(i, b"") for i in range(max(pairs) + 1)]
        size = np.array([len(x) for x in tokens], np.int64)
        _BYTES[k] = np.cumsum(size) - size, size, np.frombuffer(b"".join(tokens), np.uint8)
    return _BYTES[k]


def _answer(ranks, buckets: int):
    def f(block: pa.Table, got: dict[int, bytes]) -> pa.Table:
        begin, size, chars = _byte_table(ranks.value)
        steps, hashes = [], [np.zeros(0, np.uint64)]
        for t in B.texts(block):
            s = Step(t)
            h, which = np.unique(s.hash, return_inverse=True)
            hashes.append(h)
            steps.append((t, s, which.astype(np.uint32), len(h)))
        every, which = np.unique(np.concatenate(hashes), return_inverse=True)
        where = _bucket(every, buckets)
        start, count, flat, done = np.zeros(len(every), np.int64), np.zeros(len(every), np.int64), [np.zeros(0, "<u4")], 0
        for b in np.unique(where).tolist():
            raw = B.expand(got[b])
            n = int(np.frombuffer(raw, "<u4", 1)[0])
            c = np.frombuffer(raw, "<u4", n, 4).astype(np.int64)
            own = np.flatnonzero(where == b)
            count[own], start[own] = c, done + np.cumsum(c) - c
            flat.append(np.frombuffer(raw, "<u4", -1, 4 + 4 * n) if c.sum() else flat[0])
            done += int(c.sum())
        flat = np.concatenate(flat)
        out: dict[str, list] = {"doc_id": [], "n_tokens": [], "ids": [], "decoded": []}
        at = 0
        for t, s, local, k in steps:
            word = which[at : at + k][local]
            at += k
            c = count[word]
            ids = gather(flat, start[word], c).astype("<u4")
            cuts = np.concatenate([[0], np.cumsum(c)])[s.first]
            text = gather(chars, begin[ids], size[ids])
            ends = np.concatenate([[0], np.cumsum(size[ids])])[cuts]
            if len(text) != len(t.data) or not np.array_equal(text, t.data):  # two pre-tokens of the block share a hash
                enc, parts = _encoder(ranks.value), []
                for a, b in zip(t.offs[:-1], t.offs[1:], strict=True):
                    parts.append(np.array(enc.encode_ordinary(t.data[a:b].tobytes().decode()), "<u4"))
                ids = np.concatenate(parts)
                cuts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
                text, ends = gather(chars, begin[ids], size[ids]), np.concatenate([[0], np.cumsum(size[ids])])[cuts]
            raw, plain = ids.tobytes(), text.tobytes()
            out["doc_id"].append(t.id_array())
            out["n_tokens"].append(pa.array(np.diff(cuts), pa.int64()))
            out["ids"].append(pa.array([raw[4 * a : 4 * b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.binary()))
            out["decoded"].append(pa.array([plain[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary()))
        kinds = {"doc_id": pa.int64(), "n_tokens": pa.int64(), "ids": pa.binary(), "decoded": pa.binary()}
        return pa.table({k: pa.chunked_array(v, kinds[k]) for k, v in out.items()})

    return f


def encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its ids as little-endian unsigned 32-bit integers, and the bytes they decode to.
    ``vocabulary`` is the path of a file of token bytes (base64) and ranks, read on the driver; the ranks are
    broadcast (about 1 MB, as large as the vocabulary and not as the data)."""
    with open(vocabulary, "rb") as file:
        raw = file.read()
    ranks = docs.sparkSession.sparkContext.broadcast(raw)
    blocks = B.n_blocks(docs, text_col, BLOCK_BYTES)
    buckets = B.n_buckets(blocks)
    packed = B.pack(docs, id_col, text_col, blocks)
    served = B.serve(B.ask(packed, _ask(buckets)), _serve(ranks))
    return B.answer(packed, served, _answer(ranks, buckets), SCHEMA)
