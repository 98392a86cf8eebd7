"""Corpus-wide counts of hashed items: a block's requests carry its distinct hashes with its own counts, a
bucket (a range of the hash) adds them up over all blocks, and the block reads the totals back in order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from tapeloom.llm import blocks as B


def bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)


def planes(x: np.ndarray) -> bytes:
    """Bytes of the same rank together: what is mostly zero packs well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def unplanes(raw: bytes, kind: str, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size).reshape(size, n).T).reshape(-1).view(kind)


def _pack(h: np.ndarray, n: np.ndarray) -> bytes:
    return B.squeeze(np.uint32(len(h)).tobytes() + planes(np.diff(h, prepend=np.uint64(0)).astype("<u8")) + planes(n.astype("<u8")))


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = B.expand(raw)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    return np.cumsum(unplanes(raw[4:], "<u8", n), dtype=np.uint64), unplanes(raw[4 + 8 * n :], "<u8", n)


def requests(h: np.ndarray, n: np.ndarray, buckets: int, bits: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, payload) pairs of sorted distinct hashes, of which the first ``bits`` go, with counts."""
    cuts = np.searchsorted(bucket(h, buckets), np.arange(buckets + 1))
    short = h >> np.uint64(64 - bits)
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        yield b, _pack(short[cuts[b] : cuts[b + 1]], n[cuts[b] : cuts[b + 1]])


def serve(_: int, payloads: list[bytes]) -> list[bytes]:
    """Answers with the total of each requested hash, in the request's order."""
    got = [_unpack(p) for p in payloads]
    _, which = np.unique(np.concatenate([h for h, _ in got]), return_inverse=True)
    total = np.bincount(which, np.concatenate([n for _, n in got]))[which].astype("<u8")
    ends = np.cumsum([len(h) for h, _ in got])
    return [B.squeeze(planes(total[e - len(h) : e])) for e, (h, _) in zip(ends.tolist(), got, strict=True)]


def answers(h: np.ndarray, got: dict[int, bytes], buckets: int) -> np.ndarray:
    """The totals of the same sorted distinct hashes."""
    cuts = np.searchsorted(bucket(h, buckets), np.arange(buckets + 1))
    out = [np.zeros(0, "<u8")]
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        out.append(unplanes(B.expand(got[b]), "<u8", int(cuts[b + 1] - cuts[b])))
    return np.concatenate(out)
