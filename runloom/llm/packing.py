"""Packing of token sequences by multiway differencing (Karmarkar and Karp).

Documents are cut where a window is full; what is left of each is cut into pieces of at most ``piece`` ids.  Pieces are
gathered, in the order of the input partition, until they fill ``windows`` windows but for a small slack, and are dealt
over them by differencing: the two partial partitions with the largest imbalance are merged, heavy slots with light
ones, until one is left.  If its heaviest window exceeds the capacity, one more window is used and it starts again.
Nothing is shuffled; a partition's memory holds one such group of pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import common, wordbpe

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Deals items over k slots of near-equal sums.  A partial partition is its list of (difference to the lightest
    slot, items), heaviest first; slots that are not listed are empty and the lightest."""
    if k == 1:
        return [list(range(len(sizes)))]
    heap = [(-n, i, [(n, [i])]) for i, n in enumerate(sizes)]
    heapify(heap)
    tie = len(sizes)
    while len(heap) > 1:
        _, _, a = heappop(heap)
        _, _, b = heappop(heap)
        if len(a) + len(b) < k:
            a += b
        else:
            free = k - len(a)
            # Heaviest of a with lightest of b: b's listed slots go to a's empty ones first, then to its lightest.
            rest = b[free:] if free < len(b) else []
            both = a[: len(a) - len(rest)] + b[: len(b) - len(rest)]
            for (x, own), (y, more) in zip(a[len(a) - len(rest) :], reversed(rest), strict=True):
                both.append((x + y, own + more))
            if len(both) == k:
                least = min(n for n, _ in both)
                both = [(n - least, own) for n, own in both]
            a = both
        a.sort(key=lambda s: -s[0])
        tie += 1
        heappush(heap, (-(a[0][0] - (a[-1][0] if len(a) == k else 0)), tie, a))
    slots = [own for _, own in heap[0][2]] if heap else []
    return slots + [[] for _ in range(k - len(slots))]


def pack_group(sizes: list[int], capacity: int) -> list[list[int]]:
    """Near-equal windows, none above the capacity, as few as differencing reaches."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        slots = difference(sizes, k)
        if all(sum(sizes[i] for i in s) <= capacity for s in slots):
            return [s for s in slots if s]
        k += 1


class Packer:
    """Takes documents' ids one by one; gives rows of placed pieces."""

    def __init__(self, capacity: int = 2048, piece: int = 512, windows: int = 256, slack: int = 4, first_sequence: int = 0):
        self.capacity, self.piece, self.windows, self.slack, self.sequence = capacity, piece, windows, slack, first_sequence
        self.held: list[tuple[int, int, int, int, int]] = []
        self.total = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple]:
        n, at, room = len(ids), 0, self.windows * (self.capacity - self.slack)
        while n - at >= self.capacity:
            yield (doc_id, at, self.capacity, self._crc(ids, at, self.capacity), n, self.sequence, 0)
            self.sequence += 1
            at += self.capacity
        while at < n:
            size = min(self.piece, n - at, room - self.total)
            self.held.append((doc_id, at, size, self._crc(ids, at, size), n))
            self.total += size
            at += size
            if self.total >= room:
                yield from self.close()

    @staticmethod
    def _crc(ids: np.ndarray, at: int, size: int) -> int:
        return zlib.crc32(ids[at : at + size].astype("<u4").tobytes())

    def close(self) -> Iterator[tuple]:
        for slot in pack_group([x[2] for x in self.held], self.capacity):
            offset = 0
            for i in slot:
                yield (*self.held[i], self.sequence, offset)
                offset += self.held[i][2]
            self.sequence += 1
        self.held, self.total = [], 0


def pack(docs: DataFrame, path: str | None = None, capacity: int = 2048, end_id: int = 1, piece: int = 512, windows: int = 256, slack: int = 4) -> DataFrame:
    """One row for each placed piece of each document; a document is its ids and ``end_id``.

    Null and empty texts are the end id alone.  Repeated rows are packed each for itself.  An empty table gives no
    rows.  sequence_id is the input partition's number times 2^32 and a count within it."""
    path = path or wordbpe.default_path()
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = wordbpe.loaded(path)
        packer = Packer(capacity, piece, windows, slack, TaskContext.get().partitionId() << 32)
        table = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)
        end = np.array([end_id], np.uint32)
        for batch in batches:
            for part in common.parts(batch, "text"):
                rows = []
                for doc_id, ids in zip(part.column(0).to_pylist(), coder.encode_all(part.column(1)), strict=True):
                    rows += packer.add(doc_id, np.concatenate([ids, end]))
                if rows:
                    yield table(rows)
        if rows := list(packer.close()):
            yield table(rows)

    return common.small_batches(common.documents(docs)).mapInArrow(run, SCHEMA)
