"""Arithmetic coders side by side: what ``codecs.arith_encode`` and ``arith_decode`` do with the bytes of one text, to many
texts at once and with the same codes; no Spark.

A text is a lane, the longest first, so that lanes still at work are a slice from the left; all go on by one symbol in a
step.  Counts lie by groups of 15 symbols: ``below`` has the counts before each group, a row of ``upto`` those within one,
from 0 to its sum.  Of the register's ends, ``low`` and the complement of the high one are held, so that both move alike.
"""

from __future__ import annotations

import numpy as np

from . import codecs

GROUP, GROUPS, LIMIT = 15, 18, 1 << 16
#: So many lanes at once, at most.
LANES = 16_384
#: Microseconds of a step and of a symbol coded by the plain coders: a few very long texts are quicker by these.
STEP, PLAIN = 100, 8
U = np.uint64
S = np.arange(256)
PLACE = (S // GROUP * 16 + S % GROUP).astype(np.int64)
OVER = (np.arange(16) > (S % GROUP)[:, None]).astype(np.uint16)
WITHIN = np.concatenate([np.tile(np.arange(16), GROUPS - 1), np.minimum(np.arange(16), 256 - GROUP * (GROUPS - 1))]).astype(np.uint16)


class Lanes:
    """Counts and registers of m lanes."""

    def __init__(self, m: int, width: int):
        self.m, self.width, self.lane = m, width, np.arange(m)
        self.full, self.half = U((1 << width) - 1), U((1 << (width - 1)) - 1)
        self.upto = np.tile(WITHIN, m).reshape(-1, 16)
        self.below = np.repeat((np.arange(GROUPS, dtype=np.uint16) * GROUP)[:, None], m, axis=1)
        self.flat, self.heads = self.upto.reshape(-1), self.below.reshape(-1)
        self.base, self.first = self.lane * (16 * GROUPS), self.lane * GROUPS
        self.low, self.inv = np.zeros(m, np.uint64), np.zeros(m, np.uint64)
        self.total: np.ndarray | np.uint64 = U(256)  # the same for all up to the first halving

    def parts(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The span is part * total + rest."""
        span = self.full - (self.inv[:k] + self.low[:k])
        part = span // self.total
        return part, span - part * self.total + U(1)

    def narrow(self, k: int, part: np.ndarray, rest: np.ndarray, under: np.ndarray, over: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(what the low end rose by, the low end, bits that leave): these are those that both ends share, and one for each
        time that they straddle the middle closely."""
        lo = part * under + rest * under // self.total
        low = self.low[:k] + lo
        inv = self.full - (self.low[:k] + (part * over + rest * over // self.total)) + U(1)
        inv &= self.full
        first = ~((low ^ inv) | (low & inv) << U(1)) & self.full
        n = U(1046) - ((first >> U(self.width - 24)).astype(np.float64).view(np.uint64) >> U(52))
        np.bitwise_and(low << n, self.half, out=self.low[:k])
        np.bitwise_and(inv << n, self.half, out=self.inv[:k])
        return lo, low, n

    def counted(self, k: int) -> None:
        """One more symbol in each of the first k lanes; their counts are halved at the limit."""
        self.total = self.total + U(1) if np.ndim(self.total) == 0 else self.total[:k] + U(1)
        if np.ndim(self.total) == 0 and self.total < LIMIT:
            return
        full = np.flatnonzero(np.broadcast_to(self.total, k) >= LIMIT)
        if len(full):
            self.total = np.broadcast_to(self.total, k).copy()
            rows = self.upto.reshape(self.m, GROUPS, 16)[full].astype(np.int64)
            counts = np.diff(rows, axis=2)
            counts = np.where(counts > 0, np.maximum(1, counts >> 1), 0)
            rows[:, :, 1:] = np.cumsum(counts, axis=2)
            self.upto.reshape(self.m, GROUPS, 16)[full] = rows
            sums = np.cumsum(rows[:, :, 15], axis=1)
            self.below[1:, full] = sums[:, :-1].T
            self.total[full] = sums[:, -1]

    def fit(self, k: int) -> None:
        if np.ndim(self.total):
            self.total = self.total[:k]


class Bits:
    """Numbers added into each lane's string of bits, at rising places; sums that exceed a word are carried at the end."""

    def __init__(self, sizes: np.ndarray):
        self.most = np.minimum(18 * sizes, 10 * sizes + 4200) + 64
        words = self.most // 32 + 4
        self.start = np.cumsum(words) - words + 2
        self.words, self.at = np.zeros(int(words.sum()), np.uint64), np.zeros(len(sizes), np.int64)
        self.held: list[np.ndarray] = []

    def put(self, low: np.ndarray, n: np.ndarray, width: int) -> None:
        """The first n + 1 bits of low; the last of them has the place of the next number's first."""
        self.held.append((low >> (U(width - 1) - n) | n << U(24)).astype(np.uint32))
        if len(self.held) * len(self.held[0]) > 1_500_000:
            self.flush()

    def add(self, value: np.ndarray, last: np.ndarray, start: np.ndarray) -> None:
        """Numbers whose lowest bits have the places ``last``."""
        by, word, mask = U(31) - (last & 31).astype(np.uint64), start + (last >> 5), U(0xFFFFFFFF)
        for back, part in enumerate((value << by & mask, value >> (U(32) - by) & mask, value >> (U(64) - by))):
            np.add.at(self.words, word - back, part)

    def flush(self) -> None:
        if not self.held:
            return
        k = len(self.held[0])
        grid = np.zeros((-(-len(self.held) // 3) * 3, k), np.uint32)
        for row, held in zip(grid, self.held, strict=False):
            row[: len(held)] = held
        self.held = []
        n, value = (grid >> np.uint32(24)).reshape(-1, 3, k), (grid & np.uint32((1 << 24) - 1)).astype(np.uint64).reshape(-1, 3, k)
        value = ((value[:, 0] << n[:, 1]) + value[:, 1] << n[:, 2]) + value[:, 2]
        last = self.at[:k] + np.cumsum(n.sum(axis=1, dtype=np.int64), axis=0)
        self.at[:k] = last[-1]
        if (self.at[:k] > self.most[:k]).any():
            raise OverflowError("a code is longer than was foreseen")
        some = np.flatnonzero(value)
        self.add(value.ravel()[some], last.ravel()[some], np.broadcast_to(self.start[:k], last.shape).ravel()[some])

    def close(self, low: np.ndarray, quarter: int) -> list[bytes]:
        self.flush()
        self.add(np.where(low >= U(quarter), U(2), U(1)), self.at + 1, self.start)
        over = np.flatnonzero(self.words >> U(32))
        while len(over):
            carry = self.words[over] >> U(32)
            self.words[over] &= U(0xFFFFFFFF)
            self.words[over - 1] += carry
            over = over[self.words[over - 1] >> U(32) > 0] - 1
        data = self.words.astype(">u4").tobytes()
        return [data[4 * s : 4 * s + (a + 9) // 8] for s, a in zip(self.start.tolist(), self.at.tolist(), strict=True)]


def _encode(texts: list[bytes], width: int) -> list[bytes]:
    """Of texts from the longest on."""
    sizes = np.array([len(t) for t in texts], np.int64)
    x, begins = np.frombuffer(b"".join(texts), np.uint8), np.cumsum(sizes) - sizes
    s, bits, groups = Lanes(len(texts), width), Bits(sizes), np.arange(1, GROUPS, dtype=np.uint8)[:, None]
    for i, k in enumerate(np.searchsorted(-sizes, -np.arange(int(sizes.max(initial=0))), side="left").tolist()):
        s.fit(k)
        own = x.take(begins[:k] + i)
        at = PLACE.take(own)
        at += s.base[:k]
        g = own // np.uint8(GROUP)
        head = s.heads.take(g * np.int64(s.m) + s.lane[:k])
        under, over = (head + s.flat.take(at)).astype(np.uint64), (head + s.flat.take(at + 1)).astype(np.uint64)
        low, n = s.narrow(k, *s.parts(k), under, over)[1:]
        bits.put(low, n, width)
        s.below[1:, :k] += (groups > g).view(np.uint8)
        rows = at >> 4
        s.upto[rows] = s.upto.take(rows, axis=0) + OVER.take(own, axis=0)
        s.counted(k)
    return bits.close(s.low, 1 << (width - 2))


def _decode(codes: list[bytes], counts: list[int], width: int) -> list[bytes]:
    """Of codes of ``counts`` symbols, falling ones."""
    sizes, m = np.array(counts, np.int64), len(codes)
    padded = [c + bytes(16 + len(c) % 2) for c in codes]
    place = 8 * (np.cumsum([0, *(len(c) for c in padded)])[:-1])
    word = np.frombuffer(b"".join(padded) + bytes(8), ">u2")
    window = np.zeros(len(word) - 3, np.uint64)
    for j in range(4):
        window <<= U(16)
        window |= word[j : len(word) - 3 + j]
    s, begins = Lanes(m, width), np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    value = np.array([int.from_bytes(c[: width // 8], "big") for c in padded], np.uint64)
    place += width
    for i, k in enumerate(np.searchsorted(-sizes, -np.arange(int(sizes.max(initial=0))), side="left").tolist()):
        s.fit(k)
        part, rest = s.parts(k)
        v = value[:k]
        if width > 32:
            e = np.minimum(v // part, s.total - U(1))  # too large by one at most, for a part is larger than its number of rests
            e -= part * e + rest * e // s.total > v
        else:
            e = ((v + U(1)) * s.total - U(1)) // (part * s.total + rest)
        e = e.astype(np.uint16)
        below = s.below[1:, :k]
        above = below > e
        g = np.uint8(GROUPS - 1) - np.add.reduce(above.view(np.uint8), axis=0, dtype=np.uint8)
        head = s.heads.take(g * np.int64(s.m) + s.lane[:k])
        below += above.view(np.uint8)
        rows = s.first[:k] + g
        row = s.upto.take(rows, axis=0)
        above = row > (e - head)[:, None]
        many = np.bitwise_count(above.view(np.uint64))
        j = np.uint8(15) - many[:, 0] - many[:, 1]
        at = (rows << 4) + j
        under, over = (head + s.flat.take(at)).astype(np.uint64), (head + s.flat.take(at + 1)).astype(np.uint64)
        row += above.view(np.uint8)
        s.upto[rows] = row
        out[begins[:k] + i] = g * np.uint8(GROUP) + j
        lo, _, n = s.narrow(k, part, rest, under, over)
        p = place[:k]
        v -= lo
        v <<= n
        v |= window.take(p >> 4, mode="clip") << (p & 15).astype(np.uint64) >> (U(64) - n)
        p += n.view(np.int64)
        s.counted(k)
    data = out.tobytes()
    return [data[a : a + n] for a, n in zip(begins.tolist(), counts, strict=True)]


def _each(sizes: list[int], many, one) -> list[bytes]:
    """Results by place: ``many`` gets places side by side, the longest first; ``one`` those too long for that."""
    order = sorted(range(len(sizes)), key=lambda j: -sizes[j])
    length = np.array([sizes[j] for j in order] + [0], np.int64)
    alone = int(np.argmin(STEP * length + PLAIN * (np.cumsum(length) - length)))
    out: list = [None] * len(sizes)
    for j in order[:alone]:
        out[j] = one(j)
    for at in range(alone, len(order), LANES):
        own = order[at : at + LANES]
        for j, r in zip(own, many(own), strict=True):
            out[j] = r
    return out


def encode(texts: list[bytes], width: int = 64) -> list[bytes]:
    """codecs.arith_encode of each text's bytes."""
    return _each([len(t) for t in texts], lambda own: _encode([texts[j] for j in own], width), lambda j: codecs.arith_encode(list(texts[j]), 256, width))


def decode(codes: list[bytes], sizes: list[int], width: int = 64) -> list[bytes]:
    """codecs.arith_decode of each whole code, of a text of so many bytes."""
    return _each(sizes, lambda own: _decode([codes[j] for j in own], [sizes[j] for j in own], width), lambda j: bytes(codecs.arith_decode(codes[j], 256, sizes[j], width)))
