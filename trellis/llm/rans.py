"""Token ids in compressed binary blocks: a static range asymmetric numeral system.

One table of symbol frequencies, summing to 2 ** SCALE, serves all blocks. A block's symbols
are dealt round robin to lanes, each a coder of its own with a 64-bit state that sends and
takes 32-bit words; numpy steps all lanes at once. Blocks stand alone. Inside a block,
checkpoints (all lane states and the place in the words) let parts be decoded apart, and
every part has a CRC-32 of its symbols.

A block, little-endian: magic, uint32 n (symbols), uint32 lanes, uint32 steps a part, uint32
words; then for each part lanes uint64 states, uint32 place, uint32 CRC-32; then the words."""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"RNS1"
SCALE = 18
_LOW = np.uint64(1 << 32)
_HEAD = struct.Struct("<4sIIII")


def frequencies(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Integer frequencies in proportion to counts that sum to 2 ** scale, 1 at least where a
    count is not 0 (all counts 0: one for the first symbol)."""
    counts = np.asarray(counts, float)
    if not counts.any():
        counts = np.eye(1, len(counts))[0]
    used = counts > 0
    if used.sum() > 1 << scale:
        raise ValueError("more symbols than the scale has room for")
    freq = np.where(used, np.maximum(1, np.floor(counts / counts.sum() * (1 << scale))), 0).astype(np.int64)
    order = np.argsort(-freq, kind="stable")
    over = int(freq.sum()) - (1 << scale)
    while over > 0:  # take from the largest, in turn
        give = np.minimum(np.maximum(0, freq[order] // 2), np.maximum(1, -(-over * freq[order] // freq.sum())))
        give = np.where(freq[order] > 1, give, 0)
        give = np.clip(over - (np.cumsum(give) - give), 0, give)
        freq[order] -= give
        over = int(freq.sum()) - (1 << scale)
    freq[order[0]] -= over
    return freq


def _lanes(n: int) -> int:
    return 1 << min(10, max(0, (n // 64).bit_length() - 1)) if n >= 64 else 1


class Coder:
    def __init__(self, freq: np.ndarray, scale: int = SCALE):
        self.scale = np.uint64(scale)
        self.freq = np.asarray(freq, np.uint64)
        self.first = np.concatenate(([0], np.cumsum(freq)[:-1])).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)

    def encode(self, ids: np.ndarray, part: int = 128) -> bytes:
        """ids: uint32 symbols of positive frequency."""
        n, lanes = len(ids), _lanes(len(ids))
        steps = -(-n // lanes)
        state = np.full(lanes, _LOW, np.uint64)
        f, c = self.freq[ids], self.first[ids]
        if n and not f.all():
            raise ValueError("a symbol has no frequency")
        room = np.uint64(64) - self.scale
        out: list[np.ndarray] = []
        marks: list[tuple[np.ndarray, int]] = []
        words = 0
        for t in range(steps - 1, -1, -1):
            lo, hi = t * lanes, min(n, (t + 1) * lanes)
            x, ft = state[: hi - lo], f[lo:hi]
            full = (x >> room) >= ft
            if full.any():
                out.append((x[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
                words += len(out[-1])
                x = np.where(full, x >> np.uint64(32), x)
            q = x // ft
            state[: hi - lo] = (q << self.scale) + (x - q * ft) + c[lo:hi]
            if t % part == 0:
                marks.append((state.copy(), words))
        ids = np.ascontiguousarray(ids, "<u4")
        head = [_HEAD.pack(MAGIC, n, lanes, part, words)]
        for k, (s, w) in enumerate(reversed(marks)):
            crc = zlib.crc32(ids[k * part * lanes : (k + 1) * part * lanes].tobytes())
            head.append(s.astype("<u8").tobytes() + struct.pack("<II", words - w, crc))
        return b"".join(head) + b"".join(x.tobytes() for x in reversed(out))

    @staticmethod
    def parts(block: bytes) -> int:
        _, n, lanes, part, _ = _HEAD.unpack_from(block)
        return -(-n // (lanes * part))

    def decode_part(self, block: bytes, k: int) -> np.ndarray:
        """The symbols of the block's part k, from its checkpoint alone."""
        magic, n, lanes, part, words = _HEAD.unpack_from(block)
        if magic != MAGIC:
            raise ValueError("not a block")
        parts, width = self.parts(block), lanes * 8 + 8
        at = _HEAD.size + k * width
        state = np.frombuffer(block, "<u8", lanes, at).astype(np.uint64)
        place, crc = struct.unpack_from("<II", block, at + lanes * 8)
        stream = np.frombuffer(block, "<u4", words, _HEAD.size + parts * width)
        lo, hi = k * part * lanes, min(n, (k + 1) * part * lanes)
        out = np.empty(hi - lo, "<u4")
        mask = np.uint64((1 << int(self.scale)) - 1)
        for a in range(lo, hi, lanes):
            b = min(hi, a + lanes)
            x = state[: b - a]
            slot = x & mask
            s = self.symbol[slot]
            out[a - lo : b - lo] = s
            x = self.freq[s] * (x >> self.scale) + slot - self.first[s]
            low = x < _LOW
            m = int(low.sum())
            if m:
                x[low] = (x[low] << np.uint64(32)) | stream[place : place + m]
                place += m
            state[: b - a] = x
        # A part ends in the states of the next one's checkpoint, the last in those that every block begins with.
        end = np.frombuffer(block, "<u8", lanes, at + width) if k + 1 < parts else np.full(lanes, _LOW)
        if zlib.crc32(out.tobytes()) != crc or (state != end).any():
            raise ValueError("a block's checksum differs")
        return out

    def decode(self, block: bytes) -> np.ndarray:
        n = self.parts(block)
        return np.concatenate([self.decode_part(block, k) for k in range(n)]) if n else np.zeros(0, "<u4")
