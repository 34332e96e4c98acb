"""Token-id files: an adaptive context-mixing range coder in independently reset, checksummed blocks.

The next id's distribution mixes three predictions. Order 2 (the two ids before) and order 1 (the id before) each put
their share on the one id that their context expects; order 0 spreads the rest over all ids by their counts in the block
so far. How much each gets follows from how often contexts of the same confidences were right in this block. An id is
coded by its share of the highest order that expects it (0.02 bits an id more than by the sum of its shares). A 64-bit
range coder with 32-bit words codes the ids under that mixture.

A block is cut into lanes, runs of consecutive ids that are coded side by side in numpy, a word stream each; all lanes of
a block share one model, which learns a step's ids at once, so coder and decoder know the same before each step. All
state starts anew with each block, so a block decodes alone.

Block: ``LLID``, version (u8), ids (u32), lanes (u32), ids before the block in the whole output (u64), vocabulary size
(u32), crc32 of the ids as little-endian u32 (u32), crc32 of what follows (u32); words of each lane (u32 each), then
all lanes' words (u32 each).
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

HEAD = struct.Struct("<4sBIIQIII")
BLOCK, LANES = 1 << 21, 4096
_REFRESH = 32
_U = np.uint64
_LOW32, _TOP = _U(0xFFFFFFFF), _U(1 << 32)
_PART = 22  # the mixture's total is 256 parts of 2**22
_BITS = _PART + 8
_SLOTS = 1 << 18
#: Of a context's confidence (0 to 7): what a right and a wrong prediction add; below 3, a wrong one is replaced.
_UP = np.array([1, 1, 1, 1, 1, 1, 1, 0], dtype=np.int64)


class _Model:
    """What coder and decoder know of a block before each step.

    A context's entry is its expected id times 64, plus its confidence (order 2: times 8), so that the low six bits of
    both entries' sum are their joint state; state 64 and up: both expect the same id.
    """

    def __init__(self, lanes: int, vocabulary: int) -> None:
        self.vocabulary, self.steps = vocabulary, 0
        self.number = np.arange(vocabulary + 1)
        self.counts = 1 + 65536 // (self.number[:vocabulary] + 16)  # low ids of a BPE vocabulary are the common ones
        self.after1, self.after2 = np.zeros(vocabulary, dtype=np.int64), np.zeros(_SLOTS, dtype=np.int64)
        self.tried, self.right1, self.right2 = np.full(128, 4), np.ones(128, dtype=np.int64), np.ones(128, dtype=np.int64)
        self.p1, self.hash1 = np.zeros(lanes, dtype=np.int64), np.zeros(lanes, dtype=np.int64)
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.low, self.scaled, self.each = np.zeros(vocabulary + 1, dtype=np.int64), np.empty(vocabulary + 1), np.empty(vocabulary, dtype=np.int64)
        self.refresh()

    def refresh(self) -> None:
        """Order 0 and the masses anew from the counts."""
        if self.held:
            ids, states = map(np.concatenate, zip(*self.held, strict=True))
            self.counts += np.bincount(ids, minlength=self.vocabulary) << 6
            seen = np.bincount(states, minlength=512).reshape(4, 128)
            self.tried += seen.sum(axis=0)
            self.right2 += seen[2] + seen[3]
            self.right1 += seen[1]
            self.held = []
        np.cumsum(self.counts, out=self.low[1:])
        np.multiply(self.low, ((1 << _PART) - self.vocabulary) / int(self.low[-1]), out=self.scaled)  # one product of doubles each: the same everywhere
        np.add(self.number, self.scaled, out=self.low, casting="unsafe")
        self.low[-1] = 1 << _PART
        np.subtract(self.low[1:], self.low[:-1], out=self.each)
        m2, m1 = self.right2 * 252 // self.tried + 1, self.right1 * 252 // self.tried + 1
        m1[64:] = 0  # what both expect has order 2's share
        self.rest, self.mass2, self.mass12 = 256 - m1 - m2, m2 << _PART, m1 + m2 << _PART

    def mix(self) -> None:
        """Look both contexts up and weigh them: id i2 with mass m2 comes first, then i1 with m1, then order 0 times w0."""
        self.hash2 = self.p1 * 0x9E3779B1
        self.slot = (self.hash2 + (self.hash1 >> 5)) >> 14 & (_SLOTS - 1)
        self.e1, self.e2 = self.after1.take(self.p1), self.after2.take(self.slot)
        self.i1, self.i2 = self.e1 >> 6, self.e2 >> 6
        self.state = (self.e1 + self.e2 & 63) + ((self.i1 == self.i2) << 6)
        self.m2, self.both, self.w0 = self.mass2.take(self.state), self.mass12.take(self.state), self.rest.take(self.state)

    def spot(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in the mixture each lane's id begins, and its length: its share of the highest order that expects it."""
        hit1, hit2 = ids == self.i1, ids == self.i2
        begin = np.where(hit2, 0, np.where(hit1, self.m2, self.low.take(ids) * self.w0 + self.both))
        return begin, np.where(hit2, self.m2, np.where(hit1, self.both - self.m2, self.each.take(ids) * self.w0))

    def find(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The id that the value lies in, where it begins, and its length."""
        hit2, plain = value < self.m2, value - self.both
        ids = np.minimum(self.low.searchsorted(plain // self.w0, "right"), self.vocabulary) - 1
        hit1 = plain < 0  # or a hit of order 2
        begin = np.where(hit2, 0, np.where(hit1, self.m2, self.low.take(ids) * self.w0 + self.both))
        size = np.where(hit2, self.m2, np.where(hit1, self.both - self.m2, self.each.take(ids, mode="wrap") * self.w0))
        return np.where(hit2, self.i2, np.where(hit1, self.i1, ids)), begin, size

    def learn(self, ids: np.ndarray) -> None:
        """Of lanes with one context the last one's entry stays."""
        hit1, hit2 = ids == self.i1, ids == self.i2
        self.held.append((ids, self.state + (hit1 * 128 + hit2 * 256)))
        fresh = ids << 6
        c = self.e1 & 63
        self.after1[self.p1] = np.where(hit1, self.e1 + _UP.take(c), np.where(c >= 3, self.e1 - 2, fresh + 1))
        c = self.e2 & 63
        self.after2[self.slot] = np.where(hit2, self.e2 + _UP.take(c >> 3) * 8, np.where(c >= 24, self.e2 - 16, fresh + 8))
        self.p1, self.hash1 = ids, self.hash2
        self.steps += 1
        if self.steps % _REFRESH == 0 or self.steps in (1, 2, 4, 8, 16):
            self.refresh()


def _narrow(low: np.ndarray, span: np.ndarray, r: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Take the interval in place; the lanes that must give out a word, their spans cut at the word's edge."""
    low += r * begin.view(_U)
    np.multiply(r, size.view(_U), out=span)
    out = np.flatnonzero(span < _TOP)
    if len(out):
        lo, sp = low[out], span[out]
        cut = ((lo ^ (lo + (sp - _U(1)))) >> _U(32)) != 0
        span[out] = np.where(cut, (~lo + _U(1)) & _LOW32, sp)
    return out


def _code(ids: np.ndarray, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """From the ids (lanes by steps): words of each lane, and all words."""
    lanes, steps = ids.shape
    model, low, span = _Model(lanes, vocabulary), np.zeros(lanes, dtype=_U), np.full(lanes, 0xFFFFFFFFFFFFFFFF, dtype=_U)
    words, used = np.empty((lanes, steps + 2), dtype="<u4"), np.zeros(lanes, dtype=np.int64)
    flat, at = words.reshape(-1), np.arange(lanes) * (steps + 2)
    by_step = np.ascontiguousarray(ids.T, dtype=np.int64)
    for t in range(steps):
        model.mix()
        begin, size = model.spot(by_step[t])
        out = _narrow(low, span, span >> _U(_BITS), begin, size)
        if len(out):
            flat[at[out] + used[out]] = low[out] >> _U(32)
            used[out] += 1
            low[out] <<= _U(32)
            span[out] <<= _U(32)
        model.learn(by_step[t])
    flat[at + used] = low >> _U(32)
    flat[at + used + 1] = low & _LOW32
    used += 2
    return used.astype("<u4"), words[np.arange(steps + 2) < used[:, None]]


def _decode(used: np.ndarray, stream: np.ndarray, steps: int, vocabulary: int) -> np.ndarray:
    """The ids (lanes by steps)."""
    lanes = len(used)
    model, low, span = _Model(lanes, vocabulary), np.zeros(lanes, dtype=_U), np.full(lanes, 0xFFFFFFFFFFFFFFFF, dtype=_U)
    ends = np.cumsum(used, dtype=np.int64)
    at = ends - used
    words = np.concatenate([stream.astype(_U), np.zeros(1, dtype=_U)])
    code, at = words[at] << _U(32) | words[at + 1], at + 2
    ids = np.empty((steps, lanes), dtype=np.uint32)
    last = _U((1 << _BITS) - 1)
    for t in range(steps):
        model.mix()
        r = span >> _U(_BITS)
        got, begin, size = model.find(np.minimum((code - low) // r, last).view(np.int64))
        out = _narrow(low, span, r, begin, size)
        if len(out):
            low[out] <<= _U(32)
            span[out] <<= _U(32)
            code[out] = code[out] << _U(32) | words[np.minimum(at[out], len(stream))]
            at[out] += 1
        ids[t] = got
        model.learn(got)
    return ids.T


def encode_blocks(ids: np.ndarray, first: int, vocabulary: int, block: int = BLOCK, lanes: int = LANES) -> list[bytes]:
    """Blocks of ``block`` ids (the last one shorter); ``first``: ids before these in the whole output."""
    found = []
    for a in range(0, len(ids), block):
        part = ids[a : a + block]
        width = max(1, min(lanes, len(part) // 256))
        steps = -(-len(part) // width)
        rows = np.zeros(width * steps, dtype=np.int64)  # filled up with zeros, which the header doesn't count
        rows[: len(part)] = part
        used, words = _code(rows.reshape(width, steps), vocabulary)
        data = used.tobytes() + words.tobytes()
        found.append(HEAD.pack(b"LLID", 2, len(part), width, first + a, vocabulary, zlib.crc32(part.astype("<u4").tobytes()), zlib.crc32(data)) + data)
    return found


def decode_blocks(blocks: list[bytes]) -> list[np.ndarray]:
    """The ids of each block, checked against both checksums."""
    out = []
    for b in blocks:
        magic, version, n, lanes, _, vocabulary, ids_crc, data_crc = HEAD.unpack_from(b)
        data = memoryview(b)[HEAD.size :]
        if magic != b"LLID" or version != 2 or zlib.crc32(data) != data_crc:
            raise ValueError("a block is damaged")
        used = np.frombuffer(data[: 4 * lanes], dtype="<u4")
        ids = _decode(used, np.frombuffer(data[4 * lanes :], dtype="<u4"), -(-n // lanes), vocabulary).reshape(-1)[:n].astype("<u4", copy=False)
        if zlib.crc32(ids.tobytes()) != ids_crc:
            raise ValueError("a block's ids don't match their checksum")
        out.append(ids)
    return out
