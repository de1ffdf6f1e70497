"""Algorithms over one text as an array of code points; no Spark in here.

Arrays hold the text and one least sentinel (0 here) at its end; rows and positions count from 0.
"""

from __future__ import annotations

import itertools

import numpy as np


def codes(text: str) -> np.ndarray:
    """Code points + 1, and the sentinel 0."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return np.concatenate([raw + 1, np.zeros(1, np.int64)])


def letters(x: np.ndarray) -> list[str]:
    """Symbols of ``codes`` as strings, the sentinel as chr(1)."""
    return [chr(c - 1) if c else chr(1) for c in x.tolist()]


def dense(x: np.ndarray) -> np.ndarray:
    """Symbols numbered from 0 in their order."""
    top = int(x.max(initial=0))
    if top > 4 * len(x) + 4096:
        return np.unique(x, return_inverse=True)[1].astype(np.int64)
    return (np.cumsum(np.bincount(x, minlength=top + 1) > 0) - 1)[x]


def _later(x: np.ndarray, by: int) -> np.ndarray:
    out = np.zeros_like(x)
    out[: max(0, len(x) - by)] = x[by:]
    return out


def suffix_array(x: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in order: first by as many symbols as a word holds, then by doubling the compared
    length, of those that are still equal.  Equal suffixes don't reach the sentinel, so what is compared next exists."""
    n, key, width = len(x), dense(x), 1
    bits = max(1, int(key.max(initial=0)).bit_length())
    while 2 * width * bits < 63 and width < n:
        key = key << (width * bits) | _later(key, width)
        width *= 2
    order = np.argsort(key)
    new = np.ones(n, bool)
    held = key[order]
    new[1:] = held[1:] != held[:-1]
    rank, at = np.empty(n, np.int64), np.arange(n)
    rank[order] = np.maximum.accumulate(np.where(new, at, 0))
    while True:
        tied = ~new
        tied[:-1] |= ~new[1:]
        kept = np.flatnonzero(tied)
        if not len(kept):
            return order
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


def bwt(x: np.ndarray, sa: np.ndarray) -> np.ndarray:
    return x[sa - 1]


def lf_mapping(last: np.ndarray) -> np.ndarray:
    """Row of the preceding position: the stable order of the symbols."""
    lf = np.empty(len(last), np.int64)
    lf[np.argsort(last, kind="stable")] = np.arange(len(last))
    return lf


def inverse_bwt(last: np.ndarray) -> np.ndarray:
    """The text without its sentinel.  Follows LF by pointer doubling: log n gathers instead of n steps."""
    n = len(last)
    lf = lf_mapping(last)
    at = np.zeros(1, np.int64)
    jump = lf
    while len(at) < n:
        at = np.concatenate([at, jump[at]])
        jump = jump[jump]
    return last[at[:n]][::-1][1:]


def run_table(last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and heights of maximal runs of equal symbols."""
    starts = np.concatenate([[0], np.flatnonzero(last[1:] != last[:-1]) + 1])
    return starts, np.diff(np.append(starts, len(last)))


def shared(x: np.ndarray, sa: np.ndarray):
    """(k, rows, common) for k from 1 on: rows that have k symbols or more in common with the row before, and what each
    row has in common so far; 0 for the first and behind the last.  The sentinel is unique, so rotations of the text are
    in the order of its suffixes, and none of them are equal."""
    n = len(x)
    common = np.zeros(n + 1, np.int64)
    rows, a, b, k = np.arange(1, n), sa[:-1], sa[1:], 0
    while True:
        k += 1
        if len(rows):
            same = np.flatnonzero(x[a] == x[b])
            rows, a, b = rows[same], a[same] + 1, b[same] + 1
            common[rows] = k
        yield k, rows, common


def orders(x: np.ndarray):
    """(k, nodes, edges) of the edge-reduced de Bruijn graph of the cyclic text for each order from 1 on.

    Edges of a (k+1)-mer count once if both its k-mers are as frequent as itself, else as often as it occurs.  Rows of a
    (k+1)-mer are neighbours; only those of one that occurs again are looked at.  Its first k-mer is as frequent if the
    rows around have fewer than k symbols in common with it; its last one, if the rows one place on lie side by side and
    the same holds around them."""
    n, sa = len(x), suffix_array(x)
    place = np.empty(n, np.int64)
    place[sa] = np.arange(n)
    on, nodes = place[(sa + 1) % n], 0
    for wide, rows, common in shared(x, sa):
        k, fused = wide - 1, 0
        if k and len(rows):
            new = np.flatnonzero(np.diff(rows, prepend=-1) > 1)
            first, last = rows[new] - 1, rows[np.append(new[1:], len(rows)) - 1]
            low, high = on[first], on[last]
            around = np.maximum(np.maximum(common[first], common[last + 1]), np.maximum(common[low], common[high + 1]))
            size = last - first
            fused = int(size[(high - low == size) & (around < k)].sum())
        if k:
            yield k, nodes, n - fused
        nodes = n - len(rows)


def edge_counts(x: np.ndarray, most: int) -> list[tuple[int, int, int]]:
    """(k, nodes, edges) of each order up to ``most`` and the text's length."""
    return list(itertools.islice(orders(x), min(most, len(x))))


def min_order(x: np.ndarray, most: int | None = None) -> tuple[int, int]:
    """(k, edges) with the fewest edges, the least k of equals; (1, n) if no order saves any.  Stops at an order with no
    fewer nodes than the best edge count, for no later one can have fewer edges."""
    best = (1, len(x))
    for k, nodes, edges in itertools.islice(orders(x), min(most or len(x), len(x))):
        if nodes >= best[1]:
            break
        if edges < best[1]:
            best = (k, edges)
    return best


def first_seen(x: np.ndarray) -> np.ndarray:
    """Distinct symbols in the order of their first appearance."""
    own, first = np.unique(x, return_index=True)
    return own[np.argsort(first)]


def mtf(x: np.ndarray) -> np.ndarray:
    """Move-to-front ranks, the list beginning with symbols by first appearance."""
    table, out = first_seen(x).tolist(), np.empty(len(x), np.int64)
    for i, c in enumerate(x.tolist()):
        r = table.index(c)
        out[i] = r
        if r:
            del table[r]
            table.insert(0, c)
    return out


def mtf_inverse(ranks: np.ndarray, alphabet: list[int]) -> np.ndarray:
    table, out = list(alphabet), np.empty(len(ranks), np.int64)
    for i, r in enumerate(ranks.tolist()):
        c = table.pop(r)
        table.insert(0, c)
        out[i] = c
    return out


def rle0(ranks: np.ndarray) -> np.ndarray:
    """Runs of z zeros as the digits of z + 1 below its leading one, lowest first; other symbols plus one."""
    out, z = [], 0
    for r in [*ranks.tolist(), -1]:
        if r == 0:
            z += 1
            continue
        if z:
            out += [int(b) for b in reversed(bin(z + 1)[3:])]
            z = 0
        if r > 0:
            out.append(r + 1)
    return np.array(out, np.int64)


def rle0_inverse(symbols: np.ndarray) -> np.ndarray:
    out, bits = [], []
    for s in [*symbols.tolist(), -1]:
        if s in (0, 1):
            bits.append(s)
            continue
        if bits:
            out += [0] * (int("1" + "".join(map(str, reversed(bits))), 2) - 1)
            bits = []
        if s > 1:
            out.append(s - 1)
    return np.array(out, np.int64)
