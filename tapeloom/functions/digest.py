"""Digests of message and trace streams: FNV-1a and a fast 128-bit one."""

from __future__ import annotations

MASK = (1 << 64) - 1
#: FNV-1a, 64 bits.
FNV_BASIS, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def fnv(raw: bytes, state: int = FNV_BASIS) -> int:
    for b in raw:
        state = (state ^ b) * FNV_PRIME & MASK
    return state


def _rot(x: int, k: int) -> int:
    return (x << k | x >> (64 - k)) & MASK


class FastDigest:
    """128 bits over 16-byte blocks; equal for any split of the same bytes."""

    _A, _B = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93

    def __init__(self):
        self.a, self.b, self.tail, self.length = self._A, self._B, b"", 0

    def update(self, raw: bytes) -> None:
        self.length += len(raw)
        data = self.tail + raw
        whole = len(data) // 16 * 16
        for i in range(0, whole, 16):
            self._block(data[i : i + 16])
        self.tail = data[whole:]

    def _block(self, block: bytes) -> None:
        x, y = int.from_bytes(block[:8], "little"), int.from_bytes(block[8:], "little")
        self.a = _rot(self.a ^ x * self._B & MASK, 29) * self._A & MASK
        self.b = (_rot(self.b ^ y * self._A & MASK, 31) + self.a) * self._B & MASK

    def digest(self) -> bytes:
        a, b = self.a, self.b
        if self.tail:
            c = FastDigest()
            c.a, c.b = a, b
            c._block(self.tail.ljust(16, b"\0"))
            a, b = c.a, c.b
        a ^= self.length
        for _ in range(3):
            a = (a ^ a >> 32) * self._A & MASK
            b = (_rot(b, 27) ^ a) * self._B & MASK
        return a.to_bytes(8, "little") + (b ^ b >> 29).to_bytes(8, "little")
