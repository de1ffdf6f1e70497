"""Short blocks side by side: what ``codecs.encode_block`` and ``decode_block`` do with their default plan (hirsch) and stage
(bw94), to many pieces of at most LONGEST bytes at once and with the same bytes; no Spark.

Arrays are flat, piece after piece, where a step looks at all rows at once, and grids (places, lanes) where it goes place by
place; then a piece is a lane, the longest first, so that lanes still at work are a slice from the left.
"""

from __future__ import annotations

import itertools
import math

import numpy as np

from . import codecs, tunnels

#: Counts of a piece's symbols and their sum fit a byte, and its range coder gives a byte at most for each symbol.
LONGEST = 120
#: So many pieces at once: their grids stay in a core's cache.
LANES = 4096
PLACE_BITS = 7
# Once a large array was freed, the C library keeps the memory of smaller ones for the next, which else takes a fifth of the
# time; this one is never touched.
np.empty(31 << 20, np.uint8)

HI = np.array([0, *(tunnels.hi(i) for i in range(1, 256))], np.int64)
BOTTOM, TOP_BYTE, BYTE = np.uint64(1 << 56), np.uint64(56), np.uint64(8)


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.cumsum(counts) - counts


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each count."""
    return np.arange(int(counts.sum())) - np.repeat(_starts(counts), counts)


class Grid:
    """How flat rows, ``counts`` of each piece, lie in a grid."""

    def __init__(self, counts: np.ndarray):
        self.counts, self.wide = counts, int(counts.max(initial=0))
        self.order = np.argsort(-counts, kind="stable")
        self.full = None if counts.min(initial=self.wide) == self.wide else np.arange(self.wide) < counts[:, None]
        self.live = np.searchsorted(-counts[self.order], -np.arange(self.wide), side="left").tolist()

    def lay(self, flat: np.ndarray) -> np.ndarray:
        """The grid, with zeros below a lane's end."""
        if self.full is None:
            return np.ascontiguousarray(flat.reshape(len(self.counts), -1).T)
        rows = np.zeros(self.full.shape, flat.dtype)
        rows[self.full] = flat
        return np.ascontiguousarray(rows[self.order].T)

    def take(self, grid: np.ndarray) -> np.ndarray:
        rows = np.empty((len(self.counts), self.wide), grid.dtype)
        rows[self.order] = grid.T
        return rows.ravel() if self.full is None else rows[self.full]


def transforms(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(last, lf) of pieces with their sentinels, flat; lf counts from the first row of all."""
    m, wide = len(sizes), int(sizes.max(initial=0)) + 1
    at = np.arange(wide)
    text = np.zeros((m, wide), np.uint16)
    text[at < sizes[:, None]] = data.astype(np.uint16) + 1
    own = np.flatnonzero(np.bincount(text.ravel(), minlength=2)[1:]) + 1
    dense = np.zeros(257, np.uint64)  # the sentinel stays 0
    dense[own] = np.arange(1, len(own) + 1)
    key, bits, width = dense[text], max(1, len(own).bit_length()), 1
    while 2 * width * bits + PLACE_BITS < 64 and width < wide:
        later = np.zeros_like(key)
        later[:, : wide - width] = key[:, width:]
        key = key << np.uint64(width * bits) | later
        width *= 2
    key = key << np.uint64(PLACE_BITS) | at.astype(np.uint64)
    inside = at <= sizes[:, None]
    key[~inside] |= np.uint64(1 << 63)  # behind the piece
    key.sort(axis=1)
    sa = (key & np.uint64(127)).astype(np.int64)
    key >>= np.uint64(PLACE_BITS)
    new = ~inside
    new[:, 0] = True
    new[:, 1:] |= key[:, 1:] != key[:, :-1]
    base = np.arange(m)[:, None] * wide
    order, new = (sa + base).ravel(), new.ravel()
    if not new.all():
        _untie(order, new, width)
    place = np.empty(m * wide, np.int64)
    place[order] = np.arange(m * wide)
    order = order.reshape(m, wide)
    before = np.where(order == base, base + sizes[:, None], order - 1)
    shift = _starts(sizes + 1)[:, None] - base  # from rows of the grid to flat ones
    return text.ravel()[before][inside], (place[before] + shift)[inside]


def _untie(order: np.ndarray, new: np.ndarray, width: int) -> None:
    """Suffixes that begin with ``width`` equal symbols are put in order by doubling the compared length, as in
    ``sequence.suffix_array``; ``new`` is true where one differs from that before."""
    n, at = len(order), np.arange(len(order))
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, at, 0))
    while True:
        tied = ~new
        tied[:-1] |= ~new[1:]
        kept = np.flatnonzero(tied)
        if not len(kept):
            return
        at = at[kept]
        own = order[at]
        key = rank[own] * n + rank[own + width]
        by = np.argsort(key)
        own, key = own[by], key[by]
        order[at] = own
        new = np.ones(len(at), bool)
        new[1:] = key[1:] != key[:-1]
        rank[own] = np.maximum.accumulate(np.where(new, at, 0))
        width *= 2


def _runs(last: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, heights, run of each row) of runs within pieces."""
    new = np.ones(len(last), bool)
    new[1:] = (last[1:] != last[:-1]) | (piece[1:] != piece[:-1])
    starts = np.flatnonzero(new)
    return starts, np.diff(np.append(starts, len(last))), np.cumsum(new) - 1


_WEIGHTS: dict[int, float] = {}


def _weights(runs: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Costs.weight of each piece, whose logarithm is Python's."""
    own, of = np.unique(runs * 1024 + np.maximum(rest, 0), return_inverse=True)
    for k in own.tolist():
        if k not in _WEIGHTS:
            _WEIGHTS[k] = 1 + math.log2(1 + (k >> 10) / (k & 1023)) if k & 1023 else 0.0
    return np.array([_WEIGHTS[k] for k in own.tolist()])[of]


def fused_bits(last: np.ndarray, lf: np.ndarray, piece: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(inner, outer) of the transforms fused by the plan hirsch, intervals that share a row with a better one left out."""
    n = len(last)
    inner, outer = np.ones(n, np.uint8), np.ones(n, np.uint8)
    starts, heights, run_of = _runs(last, piece)
    run = np.flatnonzero(heights > 1)
    h, length = heights[run], np.zeros(len(run), np.int64)
    who, x, high, found = np.arange(len(run)), lf[starts[run]], h, []
    for step in itertools.count(1):
        r, end = run_of[x], x + high
        whole = np.flatnonzero((end <= n) & (r == run_of[np.minimum(end, n) - 1]))
        if not len(whole):
            break
        who, x, high, r = who[whole], x[whole], high[whole], r[whole]
        length[who[heights[r] == high]] = step
        found.append((who, x, r, np.full(len(who), step)))
        x = lf[x]
    if not found:
        return inner, outer
    who, x, r, step = (np.concatenate(p) for p in zip(*found, strict=True))
    kept = np.flatnonzero(step <= length[who])
    who, x, r, step = who[kept], x[kept], r[kept], step[kept]
    across, high = heights[r], h[who]
    within = np.zeros(len(starts), bool)
    within[r[across == high]] = True
    kept = (length > 0) & ~within[run]
    if not kept.any():
        return inner, outer
    saved = HI[across] - HI[np.maximum(1, across - high + 1)]
    rating = np.bincount(who, saved, len(run)).astype(np.int64) - HI[h]

    whose, symbol = piece[starts], last[starts]
    tall, runs = np.bincount(whose[run], minlength=m), np.bincount(whose, minlength=m)
    rest = np.bincount(whose, HI[heights], m).astype(np.int64) - 1  # length characters, without the sentinel's run
    mid = np.flatnonzero(symbol == 0)
    mid = mid[(mid > 0) & (mid < len(starts) - 1)]
    mid = mid[(symbol[mid - 1] == symbol[mid + 1]) & (whose[mid - 1] == whose[mid + 1])]  # runs around it are one
    a, b = heights[mid - 1], heights[mid + 1]
    rest[whose[mid]] += HI[a + b] - HI[a] - HI[b] - 1
    weight = _weights(runs, rest)
    own = np.flatnonzero(kept)
    of = piece[starts[run[own]]]
    own, of = own[weight[of] > 0], of[weight[of] > 0]
    p = np.minimum(HI[np.maximum(1, tall[of])] + 1, np.maximum(0, ((rating[own] * weight[of] - 2) / 4).astype(np.int64)))
    most = np.maximum(0.0, (tall[of] + 1) / ((1 << p) + 2) - 0.5).astype(np.int64)
    by = np.lexsort((-most, of))
    top = np.bincount(of[by][most[by] > _within(np.bincount(of, minlength=m))], minlength=m)
    chosen = (top[of] > 0) & (most >= top[of])
    own, of = own[chosen], of[chosen]
    by = np.lexsort((run[own], -rating[own], of))
    own, of = own[by], of[by]
    if not len(own):
        return inner, outer

    turn = np.full(len(run), -1)
    turn[own] = _within(np.bincount(of, minlength=m))
    used = turn[who] >= 0
    who, x, step = (np.concatenate(p) for p in ((own, who[used]), (starts[run[own]], x[used]), (np.zeros(len(own), np.int64), step[used])))
    by = np.argsort(turn[who], kind="stable")
    who, x, step = who[by], x[by], step[by]
    cuts = np.searchsorted(turn[who], np.arange(int(turn.max()) + 2))
    taken = np.zeros(n, bool)
    for a, b in itertools.pairwise(cuts.tolist()):
        w, c, s = who[a:b], x[a:b], step[a:b]
        place = _within(h[w])
        column = np.repeat(np.arange(b - a), h[w])
        rows = c[column] + place
        apart = np.bincount(w[column][taken[rows]], minlength=len(run))[w[column]] == 0
        rows, column, place = rows[apart], column[apart], place[apart]
        taken[rows] = True
        inner[rows[(place > 0) & (s[column] < length[w[column]])]] = 0
        outer[rows[(place > 0) & (s[column] > 0)]] = 0
    return inner, outer


def ranks(x: np.ndarray, grid: Grid) -> tuple[np.ndarray, np.ndarray]:
    """(move-to-front ranks, whether a symbol is its piece's first of its kind), flat.

    With places from 1 and p the one where a row's symbol was last (0: nowhere), its rank is the number of rows between
    whose own p is not greater; all rows up to p have such."""
    own = np.flatnonzero(np.bincount(x))
    dense = np.zeros(int(own[-1]) + 1, np.uint16)
    dense[own] = np.arange(len(own))
    wide, m = grid.wide, len(grid.counts)
    s, lane = grid.lay(dense[x]), np.arange(m)
    latest, before, out = np.zeros(len(own) * m, np.uint8), np.empty((wide, m), np.uint8), np.zeros((wide, m), np.uint8)
    for i, k in enumerate(grid.live):
        at = s[i, :k] * np.int64(m)
        at += lane[:k]
        p = before[i, :k]
        p[:] = latest[at]
        latest[at] = i + 1
        out[i, :k] = np.add.reduce((before[:i, :k] <= p).view(np.uint8), axis=0, dtype=np.uint8) - p
    return grid.take(out), grid.take(before) == 0


def zero_runs(r: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, their number in each piece): ``sequence.rle0`` of each."""
    zero = r == 0
    begins = zero.copy()
    begins[1:] &= ~zero[:-1]
    first = _starts(counts)
    begins[first] = zero[first]
    heads = np.flatnonzero(begins | ~zero)  # runs, and other symbols by themselves
    run = zero[heads]
    value = np.where(run, np.diff(np.append(heads, len(r))), r[heads]).astype(np.uint8) + np.uint8(1)
    size = np.where(run, HI[value], 1)
    digit = np.repeat(value, size) >> _within(size).astype(np.uint8)
    return digit & np.repeat(np.where(run, 1, 255).astype(np.uint8), size), np.add.reduceat(size, np.searchsorted(heads, first))


def range_encode(codes: np.ndarray, counts: np.ndarray, sigma: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, their number in each piece): ``codecs.range_encode`` of each."""
    grid, m = Grid(counts), len(counts)
    c, sigma = grid.lay(codes), sigma[grid.order].astype(np.uint64)
    out, at, lane = np.zeros((grid.wide + 9) * m, np.uint16), np.zeros(m, np.int64), np.arange(m)
    low, span = np.zeros(m, np.uint64), np.full(m, (1 << 64) - 1, np.uint64)
    for i, k in enumerate(grid.live):
        s = c[i, :k]
        below = s + np.add.reduce((c[:i, :k] < s).view(np.uint8), axis=0, dtype=np.uint8)
        count = np.add.reduce((c[:i, :k] == s).view(np.uint8), axis=0, dtype=np.uint8) + np.uint8(1)
        part = span[:k] // (sigma[:k] + np.uint64(i))
        had = low[:k]
        now = had + part * below
        over = np.flatnonzero(now < had)
        if len(over):
            out[(at[over] - 1) * m + over] += 1  # a carry, spread at the end
        part *= count
        less = part < BOTTOM
        out[at[:k] * m + lane[:k]] = now >> TOP_BYTE  # counts only if the place moves on
        at[:k] += less
        by = less * BYTE
        low[:k], span[:k] = now << by, part << by
    for i in range(8):
        out[(at + i) * m + lane] = low >> np.uint64(56 - 8 * i) & np.uint64(255)
    out = out.reshape(-1, m)
    for i in range(len(out) - 1, 0, -1):
        out[i - 1] += out[i] >> 8
    size = np.empty(m, np.int64)
    size[grid.order] = at + 8
    rows = np.empty((m, len(out)), np.uint8)
    rows[grid.order] = out.astype(np.uint8).T
    return rows[np.arange(len(out)) < size[:, None]], size


def range_decode(data: np.ndarray, sizes: np.ndarray, counts: np.ndarray, sigma: np.ndarray) -> np.ndarray:
    """Codes of each piece, flat, from its bytes: ``codecs.range_decode`` of each."""
    grid, m, most = Grid(counts), len(counts), int(sizes.max(initial=0))
    rows, out = np.zeros((m, max(most, int(counts.max(initial=0)) + 9)), np.uint8), np.zeros((grid.wide, m), np.uint8)
    rows[np.arange(rows.shape[1]) < sizes[:, None]] = data
    given = np.ascontiguousarray(rows[grid.order].T)
    total, wide, lane = sigma[grid.order].astype(np.uint64), int(sigma.max(initial=1)), np.arange(m)
    upto = np.repeat(np.arange(1, wide + 1, dtype=np.uint8)[:, None], m, axis=1)  # counts of a symbol and those below it
    code, span, at = np.zeros(m, np.uint64), np.full(m, (1 << 64) - 1, np.uint64), np.full(m, 8, np.int64)
    for i in range(8):
        code = code << BYTE | given[i]
    given, flat = given.ravel(), upto.ravel()
    for i, k in enumerate(grid.live):
        part = span[:k] // total[:k]
        value = np.minimum(code[:k] // part, total[:k] - np.uint64(1)).astype(np.uint8)
        above = upto[:, :k] > value
        s = np.uint8(wide) - np.add.reduce(above.view(np.uint8), axis=0, dtype=np.uint8)
        out[i, :k] = s
        where = s * np.int64(m) + lane[:k]
        low = np.where(s > 0, flat[where - m], 0).astype(np.uint64)
        rest, now = code[:k] - part * low, part * (flat[where] - low)
        less = now < BOTTOM
        by = less * BYTE
        code[:k] = rest << by | given[at[:k] * m + lane[:k]] * less
        span[:k] = now << by
        at[:k] += less
        upto[:, :k] += above.view(np.uint8)
        total[:k] += np.uint64(1)
    return grid.take(out)


def zero_runs_inverse(codes: np.ndarray, counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Ranks of each piece, flat; each must have as many as ``sizes`` says."""
    digit, first = codes < 2, _starts(counts)
    begins = digit.copy()
    begins[1:] &= ~digit[:-1]
    begins[first] = digit[first]
    heads = np.flatnonzero(begins | ~digit)  # runs, and other symbols by themselves
    size = np.diff(np.append(heads, len(codes)))
    if size.max(initial=0) > 8:
        raise ValueError("block is damaged: wrong length")
    place = np.arange(len(codes)) - np.repeat(heads, size)
    many = np.add.reduceat(np.where(digit, (1 + codes.astype(np.int64)) << place, 1), heads)  # the sum of (1 + bit) 2^i is a run's length
    if (np.add.reduceat(many, np.searchsorted(heads, first)) != sizes).any():
        raise ValueError("block is damaged: wrong length")
    return np.repeat(np.where(digit[heads], 0, codes[heads] - np.uint8(1)).astype(np.uint8), many)


def ranks_inverse(r: np.ndarray, grid: Grid, sigma: np.ndarray) -> np.ndarray:
    """Symbols by first appearance, from move-to-front ranks."""
    if (r >= np.repeat(sigma, grid.counts)).any():
        raise ValueError("block is damaged: wrong symbol")
    wide, m = int(sigma.max(initial=1)), len(grid.counts)
    ranked, out, lane = grid.lay(r), np.zeros((grid.wide, m), np.uint8), np.arange(m)
    table = np.repeat(np.arange(wide, dtype=np.uint8)[:, None], m, axis=1)
    flat, below = table.ravel(), np.arange(1, wide, dtype=np.uint8)[:, None]
    for i, k in enumerate(grid.live):
        own = ranked[i, :k]
        s = out[i, :k]
        s[:] = flat[own * np.int64(m) + lane[:k]]
        most = int(own.max(initial=0))
        if most:
            moved = table[1 : most + 1, :k]
            change = moved ^ table[:most, :k]
            change *= below[:most] <= own
            moved ^= change
            table[0, :k] = s
    return grid.take(out)


def invert(symbols: np.ndarray, outer: np.ndarray, inner: np.ndarray, counts: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    """``tunnels.Fused.invert`` of each, as bytes."""
    wide, m, first = int(counts.max()), len(counts), _starts(counts)
    nodes, same = (np.add.reduceat(bits, first, dtype=np.int64) for bits in (inner, outer))
    if (nodes != same).any() or not (inner[first] & outer[first]).all():
        raise ValueError("block is damaged: wrong aux codes")
    key = np.full((m, wide), 65_535, np.uint16)
    inside = np.arange(wide) < counts[:, None]
    key[inside] = symbols.astype(np.uint16) << PLACE_BITS | _within(counts).astype(np.uint16)
    key.sort(axis=1)
    # By eights of bits: the place on entering, what is kept of the place before, what of it counts on leaving; then the
    # symbol, and the next row.
    node = np.flatnonzero(outer) << 36 | 255 << 8
    lower, narrow = np.flatnonzero(inner == 0), np.flatnonzero(outer == 0)  # rows of a node but its first one
    nth = np.arange(len(lower))
    of, out_of = lower - nth - 1, narrow - np.arange(len(narrow)) - 1
    node[of] &= ~(255 << 8)
    node[out_of] |= 255 << 16
    row = np.empty(len(symbols), np.int64)
    row[inner == 1] = node
    row[lower] = node[of] + nth + 1 - np.maximum.accumulate(np.where(np.diff(of, prepend=-1) != 0, nth, 0))
    step = np.zeros(len(symbols) + 256, np.int64)
    step[((key & 127) + first[:, None])[inside]] = row
    step[: len(symbols)] |= symbols.astype(np.int64) << 24
    grid = Grid(lengths)
    at, place, out = first[grid.order], np.zeros(m, np.int64), np.zeros((grid.wide, m), np.uint16)
    for i, k in enumerate(grid.live):
        now = step[at[:k]]
        out[i, :k] = now >> 24 & 4095
        held = now >> 8
        held &= place[:k]
        held |= now
        held &= 255
        goes = now >> 16
        goes &= held
        np.subtract(held, goes, out=place[:k])
        now >>= 36
        np.add(now, goes, out=at[:k])
    got = grid.take(out)
    ends = np.cumsum(lengths)
    if (got[ends - 1] != 0).any() or np.count_nonzero(got == 0) != m:
        raise ValueError("block is damaged: its walk does not end where its text begins")
    data = (got[::-1] - np.uint16(1)).astype(np.uint8).tobytes()
    ends = (len(got) - np.append(0, ends)).tolist()
    return [data[a + 1 : b] for b, a in itertools.pairwise(ends)]


def _coded(x: np.ndarray, counts: np.ndarray) -> tuple[bytes, np.ndarray, bytes, np.ndarray]:
    """``codecs.encode_symbols`` of each for bw94: heads, their lengths, codes and their lengths, in bytes."""
    r, new = ranks(x, Grid(counts))
    sigma = np.add.reduceat(new, _starts(counts), dtype=np.int64)
    codes, many = zero_runs(r, counts)
    data, size = range_encode(codes, many, sigma + 2)
    first = _starts(sigma + 3)
    head = np.empty(int((sigma + 3).sum()), "<u4")
    head[first], head[first + 1], head[first + sigma + 2] = counts, sigma, many
    head[np.repeat(first + 2, sigma) + _within(sigma)] = x[new]
    return head.tobytes(), 4 * (sigma + 3), data.tobytes(), size


def _encode(pieces: list[bytes]) -> list[bytes]:
    sizes = np.array([len(p) for p in pieces], np.int64)
    m, data = len(pieces), np.frombuffer(b"".join(pieces), np.uint8)
    last, lf = transforms(data, sizes)
    piece = np.repeat(np.arange(m), sizes + 1)
    inner, outer = fused_bits(last, lf, piece, m)
    counts, same = (np.add.reduceat(bits, _starts(sizes + 1), dtype=np.int64) for bits in (inner, outer))
    if (counts != same).any():
        raise ValueError("an interval shares rows with itself")
    left, right = np.flatnonzero(inner), np.flatnonzero(outer)
    parts = []
    for x in (last[left], 2 * outer[left] + inner[right]):
        head, a, code, b = _coded(x, counts)
        parts += [(head, [0, *np.cumsum(a).tolist()]), (code, [0, *np.cumsum(b).tolist()])]
        parts.append(a + b)
    (h, hs), (c, cs), a, (i, js), (d, ds), b = parts
    top = np.stack([sizes + 1, a, b], axis=1).astype("<u4").tobytes()
    return [b"".join((top[12 * k : 12 * k + 12], h[hs[k] : hs[k + 1]], c[cs[k] : cs[k + 1]], i[js[k] : js[k + 1]], d[ds[k] : ds[k + 1]])) for k in range(m)]


def _words(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Numbers of four bytes, lowest first."""
    return sum(data[at + i].astype(np.int64) << 8 * i for i in range(4))


def _symbols(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, their number in each piece): ``codecs.decode_symbols`` of each part, ``size`` bytes from ``at`` on."""
    if (size < 12).any():
        raise ValueError("block is damaged: no head")
    counts, sigma = _words(data, at), _words(data, at + 4)
    if (counts < 1).any() or (counts > LONGEST + 1).any() or (sigma < 1).any() or (sigma > counts).any() or (size < 12 + 4 * sigma).any():
        raise ValueError("block is damaged: wrong head")
    own = _words(data, np.repeat(at + 8, sigma) + 4 * _within(sigma))
    if own.max(initial=0) > 256:
        raise ValueError("block is damaged: wrong symbol")
    many = _words(data, at + 8 + 4 * sigma)
    if (many < 1).any() or (many > counts).any():
        raise ValueError("block is damaged: wrong length")
    begins, rest = at + 12 + 4 * sigma, size - 12 - 4 * sigma
    codes = range_decode(data[np.repeat(begins, rest) + _within(rest)], rest, many, sigma + 2)
    x = ranks_inverse(zero_runs_inverse(codes, many, counts), Grid(counts), sigma)
    return own[np.repeat(_starts(sigma), counts) + x], counts


def _decode(blocks: list[bytes]) -> list[bytes]:
    size = np.array([len(b) for b in blocks], np.int64)
    if (size < 12).any():
        raise ValueError("block is damaged: no head")
    data, at = np.frombuffer(b"".join(blocks), np.uint8), _starts(size)
    lengths, a, b = (_words(data, at + 4 * i) for i in range(3))
    if (size != 12 + a + b).any():
        raise ValueError("block is damaged: wrong size")
    if (lengths > LONGEST + 1).any():
        raise ValueError(f"block has more than {LONGEST} bytes")
    symbols, counts = _symbols(data, at + 12, a)
    aux, same = _symbols(data, at + 12 + a, b)
    if (counts != same).any() or (counts > lengths).any() or aux.max(initial=0) > 3:
        raise ValueError("block is damaged: wrong aux codes")
    return invert(symbols, aux >> 1, aux & 1, counts, lengths)


def encode(pieces: list[bytes]) -> list[bytes]:
    """codecs.encode_block of each piece."""
    if any(len(p) > LONGEST for p in pieces):
        raise ValueError(f"pieces have at most {LONGEST} bytes")
    return [b for i in range(0, len(pieces), LANES) for b in _encode(pieces[i : i + LANES])]


def decode(blocks: list[bytes]) -> list[bytes]:
    """codecs.decode_block of each block of a piece."""
    return [p for i in range(0, len(blocks), LANES) for p in _decode(blocks[i : i + LANES])]
