"""Lossless block codecs over arrays of small integers; no Spark.

``bw94``: move-to-front ranks, zero-run code, adaptive order-0 range coder of 64 bits.  ``bcm``: bits of each symbol by mixed
contexts and a binary arithmetic coder.  A block is its fused transform and aux codes, each coded by one of them.
"""

from __future__ import annotations

import struct

import numpy as np

from . import sequence as seq
from . import tunnels


class Frequencies:
    """Counts of symbols, all starting at one, with cumulated counts in a Fenwick tree.  When their sum reaches ``limit``
    they are halved, none below one, so coders divide by small totals whatever the length of a block."""

    def __init__(self, sigma: int, limit: int = 1 << 16):
        self.n, self.limit = sigma, max(limit, 4 * sigma)
        self.counts = [1] * sigma
        self._build()

    def _build(self) -> None:
        self.total, self.tree = sum(self.counts), [0, *self.counts]
        for i in range(1, self.n + 1):
            if (up := i + (i & -i)) <= self.n:
                self.tree[up] += self.tree[i]

    def below(self, s: int) -> int:
        out = 0
        while s:
            out += self.tree[s]
            s &= s - 1
        return out

    def find(self, value: int) -> tuple[int, int]:
        """(symbol, count below it) of the symbol that covers value."""
        at, low, step = 0, 0, 1 << self.n.bit_length()
        while step:
            if at + step <= self.n and low + self.tree[at + step] <= value:
                at += step
                low += self.tree[at]
            step >>= 1
        return at, low

    def add(self, s: int) -> None:
        self.counts[s] += 1
        if self.total + 1 >= self.limit:
            self.counts = [max(1, c >> 1) for c in self.counts]
            self._build()
            return
        i = s + 1
        while i <= self.n:
            self.tree[i] += 1
            i += i & -i
        self.total += 1


TOP, BOTTOM = 1 << 32, 1 << 24


class RangeEncoder:
    """Byte-wise range coder with a register of 32 or 64 bits; a carry runs back into bytes already written."""

    def __init__(self, width: int = 32):
        self.width, self.top, self.bottom = width, 1 << width, 1 << (width - 8)
        self.low, self.range, self.out = 0, self.top - 1, bytearray()

    def encode(self, start: int, size: int, total: int) -> None:
        part = self.range // total
        if not part:
            raise ValueError("counts are too large for the coder's register")
        self.low += part * start
        self.range = part * size
        while self.range < self.bottom:
            self._shift()
            self.range <<= 8

    def _shift(self) -> None:
        if self.low >= self.top:
            self.low -= self.top
            i = len(self.out) - 1
            while self.out[i] == 255:
                self.out[i] = 0
                i -= 1
            self.out[i] += 1
        self.out.append(self.low >> (self.width - 8))
        self.low = (self.low & (self.bottom - 1)) << 8

    def close(self) -> bytes:
        for _ in range(self.width // 8):
            self._shift()
        return bytes(self.out)


class RangeDecoder:
    def __init__(self, data: bytes, width: int = 32):
        self.data, self.at, self.bottom, self.range = data, width // 8, 1 << (width - 8), (1 << width) - 1
        self.code = int.from_bytes(data[: self.at].ljust(self.at, b"\0"), "big")

    def value(self, total: int) -> int:
        self.part = self.range // total
        if not self.part:
            raise ValueError("counts are too large for the coder's register")
        return min(total - 1, self.code // self.part)

    def remove(self, start: int, size: int) -> None:
        self.code -= self.part * start
        self.range = self.part * size
        while self.range < self.bottom:
            self.code = self.code << 8 | (self.data[self.at] if self.at < len(self.data) else 0)
            self.at += 1
            self.range <<= 8


def intervals_of(x: np.ndarray, sigma: int, limit: int = 1 << 16):
    """(below, count, total) for each symbol, those of Frequencies before it comes: counts of what is before its piece of
    64 symbols, and pairs within the piece."""
    counts, at, limit = np.ones(sigma, np.int64), 0, max(limit, 4 * sigma)
    while at < len(x):
        total = int(counts.sum())
        part = x[at : at + max(1, min(limit - total, 8192))]
        m = -(-len(part) // 64)
        grid = np.full(m * 64, sigma, np.int64)
        grid[: len(part)] = part
        piece = np.bincount(np.arange(m * 64) // 64 * (sigma + 1) + grid, minlength=m * (sigma + 1)).reshape(m, sigma + 1)
        had = np.cumsum(piece, axis=0) - piece
        had[:, :sigma] += counts
        first = np.concatenate([np.zeros((m, 1), np.int64), np.cumsum(had[:, :sigma], axis=1)], axis=1)
        rows, grid = np.arange(m)[:, None], grid.reshape(m, 64).astype(np.int32)
        before = np.tri(64, k=-1, dtype=bool)
        less = first[rows, grid] + ((grid[:, None, :] < grid[:, :, None]) & before).sum(axis=2)
        same = had[rows, grid] + ((grid[:, None, :] == grid[:, :, None]) & before).sum(axis=2)
        yield from zip(less.ravel()[: len(part)].tolist(), same.ravel()[: len(part)].tolist(), range(total, total + len(part)), strict=True)
        counts += np.bincount(part, minlength=sigma)
        if total + len(part) >= limit:
            counts = np.maximum(1, counts >> 1)
        at += len(part)


class Counts:
    """Frequencies for decoders: counts of symbols and of groups of 16, so that one is found in a few steps and counted
    in one."""

    def __init__(self, sigma: int, limit: int = 1 << 16):
        self.limit, self.counts = max(limit, 4 * sigma), [1] * sigma + [0] * (-sigma % 16)
        self.sigma = sigma
        self.group()

    def group(self) -> None:
        self.groups = [sum(self.counts[i : i + 16]) for i in range(0, len(self.counts), 16)]
        self.total = sum(self.groups)

    def halve(self) -> None:
        self.counts[: self.sigma] = [max(1, c >> 1) for c in self.counts[: self.sigma]]
        self.group()


def range_encode(symbols: list[int], sigma: int, width: int = 64, limit: int = 1 << 16) -> bytes:
    out = RangeEncoder(width)
    span, low, top, bottom, shift = out.range, 0, out.top, out.bottom, out._shift
    for below, count, total in intervals_of(np.asarray(symbols, np.int64), sigma, limit):
        span //= total
        if not span:
            raise ValueError("counts are too large for the coder's register")
        low += span * below
        span *= count
        while span < bottom:
            out.low = low
            shift()
            low = out.low
            span <<= 8
    out.low = low
    return out.close()


def range_decode(data: bytes, sigma: int, n: int, width: int = 64, limit: int = 1 << 16) -> list[int]:
    f, out, at, bottom, span = Counts(sigma, limit), [], width // 8, 1 << (width - 8), (1 << width) - 1
    counts, groups, total, limit = f.counts, f.groups, f.total, f.limit
    code = int.from_bytes(data[:at].ljust(at, b"\0"), "big")
    for _ in range(n):
        part = span // total
        if not part:
            raise ValueError("counts are too large for the coder's register")
        value = code // part
        if value >= total:
            value = total - 1
        low = g = 0
        while low + groups[g] <= value:
            low += groups[g]
            g += 1
        s = g << 4
        while low + counts[s] <= value:
            low += counts[s]
            s += 1
        code -= part * low
        span = part * counts[s]
        while span < bottom:
            code = code << 8 | (data[at] if at < len(data) else 0)
            at += 1
            span <<= 8
        out.append(s)
        counts[s] += 1
        groups[g] += 1
        total += 1
        if total >= limit:
            f.halve()
            groups, total = f.groups, f.total
    return out


def arith_encode(symbols: list[int], sigma: int, width: int = 32) -> bytes:
    """Bit-wise arithmetic coder with pending bits, of the given register width.  Equal leading bits of the register's
    ends leave at once, as one number."""
    low, high, pending, bits = 0, (1 << width) - 1, 0, []
    half, quarter, full = 1 << (width - 1), 1 << (width - 2), (1 << width) - 1
    for below, count, total in intervals_of(np.asarray(symbols, np.int64), sigma):
        span = high - low + 1
        low, high = low + span * below // total, low + span * (below + count) // total - 1
        if same := width - (low ^ high).bit_length():
            lead = bin((1 << same) | low >> (width - same))[3:]
            if pending:
                bits.append(lead[0] + ("0" if lead[0] == "1" else "1") * pending + lead[1:])
                pending = 0
            else:
                bits.append(lead)
            low, high = low << same & full, (high << same & full) | ((1 << same) - 1)
        while low >= quarter and high < half + quarter:
            pending += 1
            low, high = 2 * (low - quarter), 2 * (high - quarter) + 1
    bit = int(low >= quarter)
    bits.append(str(bit) + str(1 - bit) * (pending + 1))
    every = "".join(bits)
    return int(every + "0" * (-len(every) % 8), 2).to_bytes(-(-len(every) // 8), "big") if len(every) < 4096 else np.packbits(np.frombuffer(every.encode(), np.uint8) - 48).tobytes()


def arith_decode(data: bytes, sigma: int, n: int, width: int = 32) -> list[int]:
    """Takes as many bits at once as the register's ends have in common at their front."""
    f, out, low, high = Counts(sigma), [], 0, (1 << width) - 1
    counts, groups, total, limit = f.counts, f.groups, f.total, f.limit
    half, quarter, full = 1 << (width - 1), 1 << (width - 2), (1 << width) - 1
    at, held, have = 0, 0, 0  # the next bits and how many they are
    code = int.from_bytes(data[: width // 8].ljust(width // 8, b"\0"), "big")
    at = width // 8
    for _ in range(n):
        span = high - low + 1
        value = ((code - low + 1) * total - 1) // span
        under = g = 0
        while under + groups[g] <= value:
            under += groups[g]
            g += 1
        s = g << 4
        while under + counts[s] <= value:
            under += counts[s]
            s += 1
        low, high = low + span * under // total, low + span * (under + counts[s]) // total - 1
        out.append(s)
        counts[s] += 1
        groups[g] += 1
        total += 1
        if total >= limit:
            f.halve()
            groups, total = f.groups, f.total
        same = width - (low ^ high).bit_length()
        if have < same + 1:
            held = held << 64 | int.from_bytes(data[at : at + 8].ljust(8, b"\0"), "big")
            at, have = at + 8, have + 64
        if same:
            have -= same
            code = (code << same & full) | held >> have
            held &= (1 << have) - 1
            low, high = low << same & full, (high << same & full) | ((1 << same) - 1)
        while low >= quarter and high < half + quarter:
            if not have:
                held, at, have = int.from_bytes(data[at : at + 8].ljust(8, b"\0"), "big"), at + 8, 64
            have -= 1
            low, high, code = 2 * (low - quarter), 2 * (high - quarter) + 1, 2 * (code - quarter) + (held >> have)
            held &= (1 << have) - 1
    return out


class Mixer:
    """Probability of the next bit from counters of several contexts: quick and slow ones without, with one and with two
    symbols before, the longer contexts weighted more; a last stage corrects by run length."""

    def __init__(self, width: int):
        self.width, self.counters, self.fix = width, {}, {}
        self.before, self.run = (0, 0), 0

    def _slots(self, node: int) -> tuple:
        a, b = self.before
        return (("q", node), 4, 1), (("s", node), 6, 1), ((a, node), 4, 3), ((a, b, node), 3, 3)

    def chance(self, node: int) -> int:
        """Of a one, in 65,536 parts, never 0 nor all."""
        self.slots = self._slots(node)
        total = sum(self.counters.get(k, 32768) * w for k, _, w in self.slots) // 8
        self.key = (total >> 11, self.run > 2)
        return min(65_500, max(36, (total + self.fix.get(self.key, total)) // 2))

    def learn(self, bit: int) -> None:
        goal = 65_535 * bit
        for k, rate, _ in self.slots:
            p = self.counters.get(k, 32768)
            self.counters[k] = p + ((goal - p) >> rate)
        p = self.fix.get(self.key, 32768 if self.key[0] == 16 else (self.key[0] << 11) + 1024)
        self.fix[self.key] = p + ((goal - p) >> 6)

    def ended(self, symbol: int) -> None:
        self.run = self.run + 1 if symbol == self.before[0] else 0
        self.before = (symbol, self.before[0])


def mix_encode(symbols: list[int], width: int) -> bytes:
    return _encode_rest(Mixer(width), 0, TOP - 1, bytearray(), symbols, width)


def _encode_rest(m: Mixer, low: int, high: int, out: bytearray, symbols: list[int], width: int) -> bytes:
    for s in symbols:
        node = 1
        for shift in range(width - 1, -1, -1):
            bit = s >> shift & 1
            mid = low + (high - low) * m.chance(node) // 65_536
            low, high = (low, mid) if bit else (mid + 1, high)
            m.learn(bit)
            node = 2 * node + bit
            while (low ^ high) < BOTTOM:
                out.append(high >> 24)
                low, high = low << 8 & (TOP - 1), (high << 8 & (TOP - 1)) | 255
        m.ended(s)
    return bytes(out) + struct.pack(">I", low)


def mix_decode(data: bytes, width: int, n: int) -> list[int]:
    return _decode_rest(Mixer(width), 0, TOP - 1, int.from_bytes(data[:4].ljust(4, b"\0"), "big"), 4, data, [], n, width)


def _decode_rest(m: Mixer, low: int, high: int, code: int, at: int, data: bytes, out: list[int], n: int, width: int) -> list[int]:
    for _ in range(n - len(out)):
        node = 1
        for _ in range(width):
            mid = low + (high - low) * m.chance(node) // 65_536
            bit = int(code <= mid)
            low, high = (low, mid) if bit else (mid + 1, high)
            m.learn(bit)
            node = 2 * node + bit
            while (low ^ high) < BOTTOM:
                code = (code << 8 & (TOP - 1)) | (data[at] if at < len(data) else 0)
                at += 1
                low, high = low << 8 & (TOP - 1), (high << 8 & (TOP - 1)) | 255
        s = node - (1 << width)
        m.ended(s)
        out.append(s)
    return out


class Lanes:
    """Mixers of one width side by side, one lane of the arrays for each; the same numbers as Mixer's.  Counters of two
    symbols before are rows of ``far``, given to a lane's pairs as they come and taken back when its text ends."""

    def __init__(self, width: int, lanes: int):
        k = self.k = 1 << width
        self.width, self.starts = width, np.array([0, lanes * k, 2 * lanes * k, lanes * k * (k + 2)])
        self.table, self.fix = np.full(int(self.starts[3]), 32768, np.uint16), np.full((lanes, 64), -1, np.int32)
        self.pair, self.free, self.rows = np.full((lanes, k, k), -1, np.int32), np.empty(0, np.int32), 0

    def part(self, which: int, lane: int) -> np.ndarray:
        """A lane's counters without (0: quick, 1: slow) and with one symbol before (2)."""
        size = self.k * (self.k if which == 2 else 1)
        at = int(self.starts[which]) + lane * size
        return self.table[at : at + size]

    @property
    def far(self) -> np.ndarray:
        return self.table[self.starts[3] :].reshape(-1, self.k)

    def clear(self, lane: int) -> None:
        held = self.pair[lane][self.pair[lane] >= 0]
        self.far[held] = 32768
        self.free = np.concatenate([self.free, held])
        self.pair[lane], self.fix[lane] = -1, -1
        for which in range(3):
            self.part(which, lane)[:] = 32768

    def row(self, lane: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rows of ``far`` of the pairs."""
        out = self.pair[lane, a, b]
        new = np.flatnonzero(out < 0)
        if len(new):
            if len(self.free) < len(new):
                more = max(8192, self.rows // 2)
                self.table = np.concatenate([self.table, np.full(more * self.k, 32768, np.uint16)])
                self.free = np.concatenate([self.free, np.arange(self.rows, self.rows + more, dtype=np.int32)])
                self.rows += more
            out[new], self.free = self.free[: len(new)], self.free[len(new) :]
            self.pair[lane[new], a[new], b[new]] = out[new]
        return out

    def mixer(self, lane: int, before: tuple[int, int], run: int) -> Mixer:
        """A Mixer that goes on where the lane is."""
        m = Mixer(self.width)
        m.before, m.run = before, run
        for which, name in enumerate("qs"):
            m.counters |= {(name, i): p for i, p in enumerate(self.part(which, lane).tolist())}
        m.counters |= {divmod(int(i), self.k): int(self.part(2, lane)[i]) for i in np.flatnonzero(self.part(2, lane) != 32768)}
        for a, b in zip(*np.nonzero(self.pair[lane] >= 0), strict=True):
            m.counters |= {(int(a), int(b), i): p for i, p in enumerate(self.far[self.pair[lane, a, b]].tolist()) if p != 32768}
        m.fix = {(i >> 1, bool(i & 1)): p for i, p in enumerate(self.fix[lane].tolist()) if p >= 0}
        return m


#: How slowly the counters of Lanes learn, and where its corrections start.
RATES = np.array([[4], [6], [4], [3]], np.int32)
MIDDLES = np.array([32768 if i == 16 else (i << 11) + 1024 for i in range(32)], np.int32)
#: Fewer lanes than these are slower side by side than one after the other.
FEW = 20


def _mix(width: int, jobs: list, decode: bool) -> list:
    """Codes of jobs (symbols), or symbols of jobs (data, n): the longest first, each in a lane that is free.  When few
    lanes are left, they go on one by one."""
    length = [j[1] if decode else len(j) for j in jobs]
    order = sorted(range(len(jobs)), key=lambda j: -length[j])
    done: list = [None] * len(jobs)
    waiting = iter(order)
    lanes = min(len(jobs), 1536 if width < 7 else 768 if width == 7 else 128)
    if lanes < FEW:
        return [mix_decode(j[0], width, j[1]) if decode else mix_encode(list(map(int, j)), width) for j in jobs]
    s = Lanes(width, lanes)
    if decode:
        flat = np.frombuffer(b"".join(j[0] for j in jobs) + b"\0", np.uint8)
        begins = np.cumsum([0, *(len(j[0]) for j in jobs)])
        result = [np.empty(n, np.int64) for n in length]
    else:
        flat = np.concatenate([np.asarray(j, np.int64) for j in jobs] + [np.zeros(1, np.int64)])
        begins = np.cumsum([0, *length])
        codes = [bytearray() for _ in jobs]
    lane, job = np.arange(lanes), np.array([next(waiting) for _ in range(lanes)])
    size = np.array(length, np.int64)
    low, high, a, b, run, n = (np.full(lanes, v, np.int64) for v in (0, TOP - 1, 0, 0, 0, 0))
    code, at = np.zeros(lanes, np.int64), begins[job].copy()

    def head(j: int) -> int:
        return int.from_bytes(jobs[j][0][:4].ljust(4, b"\0"), "big")

    if decode:
        code[:] = [head(j) for j in job]
        at += 4
    told: list = []  # (jobs, bytes) or (jobs, places, symbols) of steps, dealt out now and then

    def deal() -> None:
        if not told:
            return
        who = np.concatenate([t[0] for t in told])
        by = np.argsort(who, kind="stable")
        who = who[by]
        cut = np.flatnonzero(np.diff(who, prepend=-1))
        parts = [np.concatenate([t[i] for t in told])[by] for i in range(1, len(told[0]))]
        for lo, up in zip(cut.tolist(), [*cut[1:].tolist(), len(who)], strict=True):
            j = int(who[lo])
            if decode:
                result[j][parts[0][lo:up]] = parts[1][lo:up]
            else:
                codes[j] += parts[0][lo:up].astype(np.uint8).tobytes()
        told.clear()

    while True:
        ended = np.flatnonzero(n >= size[job])
        if len(ended):
            deal()
            gone = np.zeros(len(lane), bool)
            for i in ended.tolist():
                while n[i] >= size[job[i]]:
                    j = int(job[i])
                    done[j] = result[j].tolist() if decode else bytes(codes[j]) + struct.pack(">I", int(low[i]))
                    j = next(waiting, -1)
                    if j < 0:
                        gone[i] = True
                        break
                    s.clear(int(lane[i]))
                    job[i], low[i], high[i], a[i], b[i], run[i], n[i], at[i] = j, 0, TOP - 1, 0, 0, 0, 0, begins[j]
                    if decode:
                        code[i] = head(j)
                        at[i] += 4
            if gone.any():
                lane, job, low, high, a, b, run, n, code, at = (v[~gone] for v in (lane, job, low, high, a, b, run, n, code, at))
                if len(lane) < FEW:
                    break
        row, node = s.row(lane, a, b), np.ones(len(lane), np.int64)
        base = np.stack([lane, lane, lane * s.k + a, row]) * s.k + s.starts[:, None]
        table, fix, long = s.table, s.fix.reshape(-1), lane * 64 + (run > 2)
        if not decode:
            own = flat[at]
            at += 1
        for shift in range(width - 1, -1, -1):
            where = base + node
            c = table[where].astype(np.int32)
            total = (c[0] + c[1] + 3 * (c[2] + c[3])) >> 3
            part = total >> 11
            key = long + (part << 1)
            p = fix[key]
            first = p < 0
            chance = np.minimum(np.maximum((total + np.where(first, total, p)) >> 1, 36), 65_500)
            mid = low + ((high - low) * chance >> 16)
            one = code <= mid if decode else (own >> shift & 1).astype(bool)
            low, high = np.where(one, low, mid + 1), np.where(one, mid, high)
            goal = one * np.int32(65_535)
            table[where] = c + ((goal - c) >> RATES)
            p = np.where(first, MIDDLES[part], p)
            fix[key] = p + ((goal - p) >> 6)
            node = node + node + one
            out = np.flatnonzero((low ^ high) < BOTTOM)
            while len(out):
                if decode:
                    there = at[out]
                    code[out] = (code[out] << 8 & (TOP - 1)) | np.where(there < begins[job[out] + 1], flat[np.minimum(there, len(flat) - 1)], 0)
                    at[out] = there + 1
                else:
                    told.append((job[out], high[out] >> 24))
                low[out], high[out] = low[out] << 8 & (TOP - 1), (high[out] << 8 & (TOP - 1)) | 255
                out = out[(low[out] ^ high[out]) < BOTTOM]
        got = node - s.k
        if decode:
            told.append((job.copy(), n.copy(), got))
        run = np.where(got == a, run + 1, 0)
        b, a = a, got
        n += 1
        if len(told) > 4000:
            deal()
    deal()
    for i in range(len(lane)):
        j, m = int(job[i]), s.mixer(int(lane[i]), (int(a[i]), int(b[i])), int(run[i]))
        if decode:
            done[j] = _decode_rest(m, int(low[i]), int(high[i]), int(code[i]), int(at[i] - begins[j]), jobs[j][0], result[j][: n[i]].tolist(), length[j], width)
        else:
            done[j] = _encode_rest(m, int(low[i]), int(high[i]), codes[j], np.asarray(jobs[j])[n[i] :].tolist(), width)
    return done


def mix_many(jobs: list, decode: bool = False) -> list:
    """mix_encode of jobs (symbols, width), or mix_decode of jobs (data, width, n), many side by side."""
    out: list = [None] * len(jobs)
    for width in {j[1] for j in jobs}:
        at = [i for i, j in enumerate(jobs) if j[1] == width]
        for i, r in zip(at, _mix(width, [(jobs[i][0], jobs[i][2]) if decode else jobs[i][0] for i in at], decode), strict=True):
            out[i] = r
    return out


def encode_symbols(x: np.ndarray, stage: str) -> bytes:
    """Length, alphabet by first appearance, and the code."""
    alphabet = seq.first_seen(x).tolist() if len(x) else []
    head = struct.pack(f"<II{len(alphabet)}I", len(x), len(alphabet), *alphabet)
    if stage == "bw94":
        code = seq.rle0(seq.mtf(x))
        return head + struct.pack("<I", len(code)) + range_encode(code.tolist(), len(alphabet) + 2)
    if stage == "bcm":
        place = {c: i for i, c in enumerate(alphabet)}
        return head + mix_encode([place[c] for c in x.tolist()], max(1, (len(alphabet) - 1).bit_length()))
    raise ValueError(f"no stage {stage}")


def decode_symbols(data: bytes, stage: str) -> np.ndarray:
    n, sigma = struct.unpack_from("<II", data)
    alphabet = list(struct.unpack_from(f"<{sigma}I", data, 8))
    at = 8 + 4 * sigma
    if stage == "bw94":
        (size,) = struct.unpack_from("<I", data, at)
        code = range_decode(data[at + 4 :], sigma + 2, size)
        x = seq.mtf_inverse(seq.rle0_inverse(np.array(code, np.int64)), alphabet)
    else:
        x = np.array([alphabet[i] for i in mix_decode(data[at:], max(1, (sigma - 1).bit_length()), n)], np.int64)
    if len(x) != n:
        raise ValueError("block is damaged: wrong length")
    return x


def _mixed(x: np.ndarray) -> tuple[bytes, np.ndarray, int]:
    """Head of encode_symbols for bcm, symbols by first appearance, and their width."""
    own, first, inverse = np.unique(x, return_index=True, return_inverse=True)
    order, place = np.argsort(first), np.empty(len(own), np.uint32)
    place[order] = np.arange(len(own))
    head = struct.pack(f"<II{len(own)}I", len(x), len(own), *own[order].tolist())
    return head, place[inverse], max(1, (len(own) - 1).bit_length())


def encode_mixed(fused: list[tunnels.Fused]) -> list[bytes]:
    """encode_fused(f, "bcm") of many at once."""
    parts = [_mixed(x) for f in fused for x in (f.symbols, 2 * f.outer.astype(np.int64) + f.inner)]
    coded = [head + c for (head, _, _), c in zip(parts, mix_many([(x, width) for _, x, width in parts]), strict=True)]
    return [struct.pack("<III", f.length, len(a), len(b)) + a + b for f, a, b in zip(fused, coded[::2], coded[1::2], strict=True)]


def decode_mixed(blocks: list[bytes]) -> list[tunnels.Fused]:
    """decode_fused(data, "bcm") of many at once."""
    heads, jobs = [], []
    for part in (p for data in blocks for p in _parts(data)[1:]):
        n, sigma = struct.unpack_from("<II", part)
        heads.append(np.array(struct.unpack_from(f"<{sigma}I", part, 8), np.int64))
        jobs.append((part[8 + 4 * sigma :], max(1, (sigma - 1).bit_length()), n))
    back = [alphabet[np.array(x, np.int64)] for alphabet, x in zip(heads, mix_many(jobs, decode=True), strict=True)]
    return [_fused(_parts(data)[0], x, aux) for data, x, aux in zip(blocks, back[::2], back[1::2], strict=True)]


def pack_two_bits(x: np.ndarray) -> bytes:
    """Four codes of two bits to a byte, lowest first."""
    x = np.concatenate([np.asarray(x, np.uint8), np.zeros(-len(x) % 4, np.uint8)]).reshape(-1, 4)
    return (x << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1).astype(np.uint8).tobytes()


def unpack_two_bits(data: bytes, n: int) -> np.ndarray:
    return (np.frombuffer(data, np.uint8)[:, None] >> np.array([0, 2, 4, 6], np.uint8) & 3).ravel()[:n]


def encode_fused(f: tunnels.Fused, stage: str) -> bytes:
    symbols, aux = encode_symbols(f.symbols, stage), encode_symbols(2 * f.outer.astype(np.int64) + f.inner, stage)
    return struct.pack("<III", f.length, len(symbols), len(aux)) + symbols + aux


def _parts(data: bytes) -> tuple[int, bytes, bytes]:
    if len(data) < 12:
        raise ValueError("block is damaged: no head")
    n, a, b = struct.unpack_from("<III", data)
    if len(data) != 12 + a + b:
        raise ValueError("block is damaged: wrong size")
    return n, data[12 : 12 + a], data[12 + a :]


def _fused(n: int, symbols: np.ndarray, aux: np.ndarray) -> tunnels.Fused:
    if len(aux) != len(symbols) or len(symbols) > n or aux.max(initial=0) > 3:
        raise ValueError("block is damaged: wrong aux codes")
    return tunnels.Fused(symbols, aux >> 1, aux & 1, n)


def decode_fused(data: bytes, stage: str) -> tunnels.Fused:
    n, symbols, aux = _parts(data)
    return _fused(n, decode_symbols(symbols, stage), decode_symbols(aux, stage))


def encode_block(data: bytes, strategy: str = "hirsch", stage: str = "bw94") -> bytes:
    return encode_fused(tunnels.fuse(data.decode("latin-1"), strategy)[0], stage)


def decode_block(data: bytes, stage: str = "bw94") -> bytes:
    return "".join(seq.letters(decode_fused(data, stage).invert())).encode("latin-1")


def container(blocks: list[bytes]) -> bytes:
    """Offsets of the head's end and of each block's end, then the blocks."""
    ends, at = [], 8 * (len(blocks) + 1)
    for b in [b"", *blocks]:
        at += len(b)
        ends.append(at)
    return struct.pack(f"<{len(ends)}q", *ends) + b"".join(blocks)


def blocks_of(data: bytes) -> list[bytes]:
    (first,) = struct.unpack_from("<q", data)
    ends = struct.unpack_from(f"<{first // 8}q", data)
    if any(a > b for a, b in zip(ends, ends[1:], strict=False)) or ends[-1] != len(data):
        raise ValueError("container is damaged: offsets don't rise to its end")
    return [data[a:b] for a, b in zip(ends, ends[1:], strict=False)]
