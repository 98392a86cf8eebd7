"""Texts of Arrow batches as byte arrays, in steps of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tapeloom.llm.common import tidy

STEP_BYTES = 1 << 19


def steps(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, bytes, offsets) of whole texts, about STEP_BYTES at once; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    binary = texts.fill_null("").cast(pa.large_binary())
    n = len(binary)
    if not n:
        return
    offs = np.frombuffer(binary.buffers()[1], np.int64)[binary.offset : binary.offset + n + 1]
    data = np.frombuffer(binary.buffers()[2], np.uint8) if binary.buffers()[2] is not None and binary.buffers()[2].size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = min(n, max(a + 1, int(np.searchsorted(offs, offs[a] + STEP_BYTES, "right")) - 1))
        yield a, b, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b
    tidy()


class Lookup:
    """Positions in a sorted table of 64-bit hashes; most hashes that aren't there are told by one bit."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.may = np.zeros(1 << 20, bool)
        self.may[hashes >> np.uint64(44)] = True

    def find(self, h: np.ndarray) -> np.ndarray:
        """The position of each hash, or -1."""
        out = np.full(len(h), -1, np.int64)
        if len(self.hashes):
            at = np.flatnonzero(self.may[h >> np.uint64(44)])
            p = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
            hit = self.hashes[p] == h[at]
            out[at[hit]] = p[hit]
        return out
