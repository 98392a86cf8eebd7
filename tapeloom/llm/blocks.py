"""Blocks: documents travel once, compressed, dealt by a hash of their content; what a block needs from
the whole corpus (counts, codes) it asks for and gets back by a second, much smaller exchange.

    packed = pack(docs)                      block, chunk        texts, zstd
    asked  = ask(packed, ...)                bucket, block, payload
    served = serve(asked, ...)               block, bucket, payload
    result = answer(packed, served, ...)     one co-group of a block with its answers

A request holds each distinct item of a block once, so a very common item is one entry of each block,
and the task that serves a bucket sees as many copies of it as there are blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm import common

#: Bytes of stored input a block holds about, and blocks in a partition of the exchange.
BLOCK_BYTES, BLOCKS_EACH = 2 << 20, 4
#: Bytes of text that are worked on at once inside a block.
STEP_BYTES = 1 << 19
PACKED = "block int, chunk binary"
ASKED = "bucket int, block int, payload binary"
SERVED = "block int, bucket int, payload binary"


def n_blocks(docs: DataFrame, text_col: str, size: int = BLOCK_BYTES) -> int:
    return max(8, -(-common.input_bytes(docs.select(text_col), text_col) // size))


def n_buckets(blocks: int) -> int:
    """Buckets grow with the input, so that what one serves stays the same size."""
    return max(8, blocks // 2)


def squeeze(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(raw)


def expand(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def pack(docs: DataFrame, id_col: str, text_col: str, blocks: int) -> DataFrame:
    """Texts (null: empty) dealt over ``blocks`` by a hash of id and text."""
    common.bounded(docs.sparkSession)
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt = given.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    return dealt.mapInArrow(_pack, PACKED).repartition(max(8, blocks // BLOCKS_EACH), "block")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        block = batch.column("block").to_numpy(zero_copy_only=False)
        order = np.argsort(block, kind="stable")
        block = block[order]
        ids = batch.column("doc_id").take(pa.array(order))
        null = ids.is_null().to_numpy(zero_copy_only=False)
        ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
        text = batch.column("text").cast(pa.large_binary()).take(pa.array(order))
        offs = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        data = memoryview(text.buffers()[2] or b"")
        cuts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        out = [], []
        for a, b in zip(cuts, np.r_[cuts[1:], len(block)], strict=True):
            raw = b"".join((np.uint32(b - a).tobytes(), ids[a:b].astype("<i8").tobytes(), null[a:b].astype(np.uint8).tobytes(), np.diff(offs[a : b + 1]).astype("<u4").tobytes(), data[offs[a] : offs[b]]))
            out[0].append(int(block[a]))
            out[1].append(squeeze(raw))
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary())], ["block", "chunk"])


class Texts:
    """Some whole texts of a block: ids, null flags of the ids, byte offsets, and the bytes."""

    def __init__(self, ids, null, lens, data):
        self.ids, self.null, self.data = ids, null, data
        self.offs = np.concatenate([[0], np.cumsum(lens, dtype=np.int64)])

    def id_array(self) -> pa.Array:
        return pa.array(self.ids, pa.int64(), mask=self.null)


def texts(packed: pa.Table) -> Iterator[Texts]:
    """The texts of a block in steps of about STEP_BYTES, always in the same order."""
    chunks = sorted(packed.column("chunk").to_pylist())
    for chunk in chunks:
        raw = expand(chunk)
        n = int(np.frombuffer(raw, "<u4", 1)[0])
        ids = np.frombuffer(raw, "<i8", n, 4)
        null = np.frombuffer(raw, np.uint8, n, 4 + 8 * n).astype(bool)
        lens = np.frombuffer(raw, "<u4", n, 4 + 9 * n)
        data = np.frombuffer(raw, np.uint8, -1, 4 + 13 * n) if len(raw) > 4 + 13 * n else np.zeros(0, np.uint8)
        ends = np.cumsum(lens, dtype=np.int64)
        a = 0
        while a < n:
            base = ends[a] - lens[a]
            b = max(a + 1, int(np.searchsorted(ends, base + STEP_BYTES, "right")))
            yield Texts(ids[a:b], null[a:b], lens[a:b], data[base : ends[b - 1]])
            a = b


def ask(packed: DataFrame, f: Callable[[pa.Table], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """``f`` gives (bucket, payload) pairs of a block."""

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        got = list(f(t))
        common.tidy()
        block = int(key[0].as_py())
        return pa.table({"bucket": pa.array([k for k, _ in got], pa.int32()), "block": pa.array([block] * len(got), pa.int32()), "payload": pa.array([p for _, p in got], pa.binary())})

    return packed.groupBy("block").applyInArrow(run, ASKED)


def serve(asked: DataFrame, f: Callable[[int, list[bytes]], list[bytes]]) -> DataFrame:
    """``f`` gets a bucket's payloads of all blocks and gives one answer to each."""

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        bucket = int(key[0].as_py())
        t = t.sort_by("block")
        out = f(bucket, t.column("payload").to_pylist())
        common.tidy()
        return pa.table({"block": t.column("block"), "bucket": pa.array([bucket] * len(out), pa.int32()), "payload": pa.array(out, pa.binary())})

    return asked.groupBy("bucket").applyInArrow(run, SERVED)


def answer(packed: DataFrame, served: DataFrame, f: Callable[[pa.Table, dict[int, bytes]], pa.Table], schema: str) -> DataFrame:
    """``f`` gets a block and its answers by bucket."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        got = dict(zip(right.column("bucket").to_pylist(), right.column("payload").to_pylist(), strict=True))
        out = f(left, got)
        common.tidy()
        return out

    return packed.groupBy("block").cogroup(served.groupBy("block")).applyInArrow(run, schema)
