"""GIF as a column: bytes stored as timed frames, and GIF streams decoded with LZW, palettes, interlacing,
disposal and transparency, with colour histograms.

``store`` writes each text's bytes as 24 x 24 frames of 8-bit samples under a grey palette, compressed by LZW with
a table that grows over a frame; ``decode`` reads any GIF87a or GIF89a stream. LZW streams are encoded and
decoded many frames at a time: a step of all frames is a few array operations, and for the decoder a table entry is
a slice of what its frame has put out before.

Defined results: null or empty texts are one frame of padding; equal texts give equal files; a stream that
isn't a GIF, or a null one, has no frames and null columns; a stream that ends early keeps its whole frames,
and pixels that the codes don't reach are 0; other columns are not read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm import columns
from tapeloom.llm.common import bounded

SIDE = 24
FRAME = SIDE * SIDE
PAD = 255
DELAY = 4  # hundredths of a second
BINS = 8
#: Frames, and pixels of them, that are decoded in step.
TOGETHER, PIXELS = 4096, 4 << 20
#: Frames that are encoded in step.
ENCODED = 512
STORED = "doc_id long, n_bytes long, gif binary"
DECODED = "width int, height int, n_frames int, duration_ms long, histogram array<long>, samples binary"


HEAD = b"GIF89a" + struct.pack("<HHBBB", SIDE, SIDE, 0xF7, 0, 0) + bytes(v for v in range(256) for _ in range(3))
#: A frame's control block, its box and the bits of a sample.
FRAME_HEAD = b"\x21\xf9\x04" + struct.pack("<BHB", 1 << 2, DELAY, 0) + b"\x00" + b"\x2c" + struct.pack("<HHHHB", 0, 0, SIDE, SIDE, 0) + b"\x08"
CLEAR, STOP, FREE = 256, 257, 258
#: Codes of nine bits behind the clear: the table has 512 entries when the decoder reads the next one.
NINE = 512 - STOP


def lzw_codes(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """LZW codes of frames of 8-bit samples (n x size, at most 600 each) behind a clear, and how many each has. The
    tables of all frames are one array over (frame, code, next sample), with samples numbered among those in use."""
    n, size = samples.shape
    used = np.zeros(256, bool)
    used[samples.reshape(-1)] = True
    symbol = np.cumsum(used)[samples] - 1
    wide, many = int(used.sum()), FREE + size
    table = np.zeros(n * many * wide, np.int16)
    base = np.arange(n) * many
    out = np.zeros((n, size + 1), np.uint16)
    count, code = np.zeros(n, np.int64), samples[:, 0].astype(np.int64)
    for p in range(1, size):
        at = (base + code) * wide + symbol[:, p]
        child = table[at]
        new = np.flatnonzero(child == 0)
        out[new, count[new]] = code[new]
        table[at[new]] = FREE + count[new]
        count[new] += 1
        code = np.where(child > 0, child, samples[:, p])
    out[np.arange(n), count] = code
    return out, count + 1


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """Frames of samples (n x FRAME) as GIF frames."""
    done = []
    for a in range(0, len(samples), ENCODED):
        codes, count = lzw_codes(samples[a : a + ENCODED])
        n = len(codes)
        codes = np.concatenate([np.full((n, 1), CLEAR, np.uint16), codes, np.zeros((n, 1), np.uint16)], 1)
        codes[np.arange(n), count + 1] = STOP
        nine, ten = codes[:, : NINE + 1], codes[:, NINE + 1 :]
        bits = [(part[:, :, None] >> np.arange(w, dtype=np.uint16) & 1).astype(np.uint8).reshape(n, -1) for part, w in ((nine, 9), (ten, 10))]
        raw = np.packbits(np.concatenate(bits, 1), axis=1, bitorder="little")
        total = count + 2
        size = (9 * np.minimum(total, NINE + 1) + 10 * np.maximum(total - NINE - 1, 0) + 7) // 8
        flat, width = raw.tobytes(), raw.shape[1]
        for k, length in enumerate(size.tolist()):
            own, parts = flat[k * width : k * width + length], [FRAME_HEAD]
            for b in range(0, length, 255):
                parts += (bytes((min(255, length - b),)), own[b : b + 255])
            done.append(b"".join(parts) + b"\0")
    return done


def payload_frames(offs: np.ndarray) -> np.ndarray:
    """Frames of each text."""
    return np.maximum(1, -(-np.diff(offs) // FRAME))


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc_id")
        for a, b, data, offs in columns.steps(batch.column("text")):
            count = payload_frames(offs)
            ends = np.cumsum(count)
            padded = np.full(int(ends[-1]) * FRAME, PAD, np.uint8)
            size = np.diff(offs)
            padded[np.arange(len(data)) + np.repeat((ends - count) * FRAME - offs[:-1], size)] = data
            frames = encode_frames(padded.reshape(-1, FRAME))
            gifs = [HEAD + b"".join(frames[e - c : e]) + b"\x3b" for e, c in zip(ends.tolist(), count.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(size, pa.int64()), pa.array(gifs, pa.binary())], ["doc_id", "n_bytes", "gif"])


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its UTF-8 bytes, padded with 255 to whole frames, as an animated GIF."""
    bounded(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_store, STORED)


@dataclass
class Frame:
    box: tuple[int, int, int, int]
    palette: np.ndarray
    interlaced: bool
    least: int
    codes: bytes
    disposal: int = 0
    clear: int | None = None
    delay: int = 0
    pixels: np.ndarray | None = None


@dataclass
class Gif:
    width: int
    height: int
    frames: list[Frame] = field(default_factory=list)


def parse(raw: bytes | None) -> Gif | None:
    """Frames with their undecoded codes; None if it isn't a GIF."""
    if raw is None or raw[:6] not in (b"GIF87a", b"GIF89a") or len(raw) < 13:
        return None
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", raw, 6)
    at, common = 13, np.zeros((0, 3), np.uint8)

    def palette(at: int, flags: int) -> tuple[np.ndarray, int]:
        n = 3 << ((flags & 7) + 1)
        return np.frombuffer(raw[at : at + n].ljust(n, b"\0"), np.uint8).reshape(-1, 3), at + n

    if flags & 0x80:
        common, at = palette(at, flags)
    out, control = Gif(width, height), (0, None, 0)
    while at < len(raw):
        kind = raw[at]
        if kind == 0x21 and at + 1 < len(raw):
            label, at = raw[at + 1], at + 2
            if label == 0xF9 and at + 5 <= len(raw):
                f, delay, index = struct.unpack_from("<BHB", raw, at + 1)
                control = (f >> 2 & 7, index if f & 1 else None, delay)
            while at < len(raw) and raw[at]:
                at += raw[at] + 1
            at += 1
        elif kind == 0x2C and at + 11 <= len(raw):
            *box, flags = struct.unpack_from("<HHHHB", raw, at + 1)
            at += 10
            colours = common
            if flags & 0x80:
                colours, at = palette(at, flags)
            if at >= len(raw):
                break
            least, at, parts = raw[at], at + 1, []
            while at < len(raw) and (n := raw[at]):
                parts.append(raw[at + 1 : at + 1 + n])
                at += n + 1
            if at >= len(raw):  # the stream ends inside this frame
                break
            at += 1
            out.frames.append(Frame(tuple(box), colours, bool(flags & 0x40), least, b"".join(parts), *control))
            control = (0, None, 0)
        else:
            break
    return out


def lzw(least: int, streams: list[bytes], sizes: list[int]) -> list[np.ndarray]:
    """Indices that streams of codes hold, of as many pixels as ``sizes`` says, all decoded in step."""
    n = len(streams)
    size = np.array(sizes, np.int64)
    base = np.concatenate([[0], np.cumsum(size)])[:-1]
    out = np.zeros(int(size.sum()) + 1, np.uint8)
    limit = np.array([len(s) for s in streams], np.int64) * 8
    first = np.concatenate([[0], np.cumsum([len(s) for s in streams])])[:-1].astype(np.int64) * 8
    data = np.frombuffer(b"".join(streams) + bytes(4), np.uint8)
    wide = data[:-3].astype(np.uint32) | data[1:-2].astype(np.uint32) << 8 | data[2:-1].astype(np.uint32) << 16
    clear = 1 << least
    start, length = np.zeros((n, 4096), np.int32), np.zeros((n, 4096), np.int32)
    bit, width, free = np.zeros(n, np.int64), np.full(n, least + 1), np.full(n, clear + 2)
    was, was_len, at = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    act = np.flatnonzero(size > 0)
    while len(act):
        b, w = bit[act], width[act]
        pos = first[act] + b
        ok = b + w <= limit[act]
        code = wide[np.where(ok, pos >> 3, 0)].astype(np.int64) >> (pos & 7) & ((1 << w) - 1)
        bit[act] = b + w
        code[~ok] = clear + 1
        reset = code == clear
        if reset.any():
            r = act[reset]
            width[r], free[r], was_len[r] = least + 1, clear + 2, 0
        put = (code < clear) | (code > clear + 1)
        known = (code < clear) | (code < free[act]) | (code == free[act]) & (was_len[act] > 0)
        go = put & known
        f, c = act[go], code[go]
        add = (was_len[f] > 0) & (free[f] < 4096)
        g = f[add]
        start[g, free[g]], length[g, free[g]] = was[g], was_len[g] + 1
        free[g] += 1
        width[g] += (free[g] == 1 << width[g]) & (width[g] < 12)
        to = at[f]
        lone = c < clear
        l, h = f[lone], to[lone]
        room = h < size[l]
        out[(base[l] + h)[room]] = c[lone][room]
        span = np.ones(len(f), np.int64)
        if not lone.all():
            d = ~lone
            e, k = f[d], c[d]
            span[d] = length[e, k]
            source, target, left = base[e] + start[e, k], base[e] + to[d], np.minimum(span[d], size[e] - to[d])
            for j in range(int(left.max(initial=0))):
                m = left > j
                out[target[m] + j] = out[source[m] + j]
        was[f], was_len[f] = to, span
        at[f] = to + span
        stay = (reset | go) & (at[act] < size[act])
        if not stay.all():
            act = act[stay]
    return [out[a : a + s] for a, s in zip(base.tolist(), sizes, strict=True)]


def decode_pixels(gifs: list[Gif | None]) -> None:
    """Fills every frame's pixels (indices), frames of all files together."""
    groups: dict[int, list[Frame]] = {}
    for g in gifs:
        for f in g.frames if g else []:
            groups.setdefault(f.least, []).append(f)
    for least, frames in groups.items():
        if not 1 <= least <= 11:
            for f in frames:
                f.pixels = np.zeros((f.box[3], f.box[2]), np.uint8)
            continue
        a = 0
        while a < len(frames):
            b, total = a, 0
            while b < len(frames) and b - a < TOGETHER and (b == a or total + frames[b].box[2] * frames[b].box[3] <= PIXELS):
                total += frames[b].box[2] * frames[b].box[3]
                b += 1
            some = frames[a:b]
            for f, p in zip(some, lzw(least, [f.codes for f in some], [f.box[2] * f.box[3] for f in some]), strict=True):
                p = p.reshape(f.box[3], f.box[2])
                if f.interlaced:
                    rows = [y for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(first, f.box[3], step)]
                    lines = np.empty_like(p)
                    lines[rows] = p
                    p = lines
                f.pixels = p
            a = b


def _colours(f: Frame) -> np.ndarray:
    table = np.zeros((256, 3), np.uint8)
    table[: len(f.palette)] = f.palette
    return table[f.pixels]


def render(g: Gif) -> Iterator[tuple[np.ndarray, int]]:
    """(RGB canvas, delay in hundredths of a second) of each frame; what nothing has drawn is black."""
    canvas = np.zeros((g.height, g.width, 3), np.uint8)
    for f in g.frames:
        x, y, w, h = f.box
        w, h = max(0, min(w, g.width - x)), max(0, min(h, g.height - y))
        before = canvas.copy() if f.disposal == 3 else None
        area = canvas[y : y + h, x : x + w]
        seen = f.pixels[:h, :w] != f.clear if f.clear is not None else np.ones((h, w), bool)
        area[seen] = _colours(f)[:h, :w][seen]
        yield canvas.copy(), f.delay
        if f.disposal == 2:
            area[:] = 0
        elif f.disposal == 3:
            canvas = before


def _plain(g: Gif) -> bool:
    """Every frame covers the canvas, so frames don't depend on each other."""
    return all(f.box == (0, 0, g.width, g.height) and f.clear is None and f.palette is g.frames[0].palette for f in g.frames)


def columns_of(g: Gif) -> tuple[int, list[int], bytes]:
    """Duration, histogram (BINS of red, green and blue each, over all frames' pixels), and red samples of all frames."""
    if not g.frames:
        return 0, [0] * (3 * BINS), b""
    if _plain(g):
        index = np.concatenate([f.pixels.reshape(-1) for f in g.frames])
        table = np.zeros((256, 3), np.uint8)
        table[: len(g.frames[0].palette)] = g.frames[0].palette
        used = np.bincount(index, minlength=256)
        counts = [np.bincount(table[:, c].astype(np.int64) * BINS >> 8, used, BINS).astype(np.int64) for c in range(3)]
        return 10 * sum(f.delay for f in g.frames), np.concatenate(counts).tolist(), table[:, 0][index].tobytes()
    counts, red, time = np.zeros((3, BINS), np.int64), [], 0
    for image, delay in render(g):
        for c in range(3):
            counts[c] += np.bincount(image[:, :, c].reshape(-1).astype(np.int64) * BINS >> 8, minlength=BINS)
        red.append(image[:, :, 0].tobytes())
        time += 10 * delay
    return time, counts.reshape(-1).tolist(), b"".join(red)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary())
    names = ["carried", *(c.split()[0] for c in DECODED.split(", "))]
    for batch in batches:
        a, size = 0, np.diff(_offsets(batch.column("gif")))
        ends = np.cumsum(size)
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(ends, (ends[a] - size[a]) + 2 * columns.STEP_BYTES, "right")))
            gifs = [parse(x) for x in batch.column("gif").slice(a, b - a).to_pylist()]
            decode_pixels(gifs)
            rows = [(g.width, g.height, len(g.frames), *columns_of(g)) if g else (None,) * 6 for g in gifs]
            cols = [batch.column("carried").slice(a, b - a), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(cols, names)
            a = b


def _offsets(binary: pa.Array) -> np.ndarray:
    binary = binary.cast(pa.large_binary())
    return np.frombuffer(binary.buffers()[1], np.int64)[binary.offset : binary.offset + len(binary) + 1]


def decode(stored: DataFrame, carry: Column | None = None, id_col: str = "doc_id", gif_col: str = "gif") -> DataFrame:
    """One row per stream: carried (the id, or any column of ``stored``), canvas size, number of frames,
    duration, histogram, and the red samples of all frames."""
    given = stored.select((F.col(id_col) if carry is None else carry).alias("carried"), F.col(gif_col).alias("gif"))
    return given.mapInArrow(_decode, f"carried {given.schema['carried'].dataType.simpleString()}, {DECODED}")
