"""Near copies of the pipeline: documents whose five-word shingles have a Jaccard similarity of at least 0.8.

SimHash prints of such pairs lie up to some ten bits apart, too far for pigeonhole blocks (eleven bits take 705,432
tables), so pairs are retrieved by MinHash: ``bands`` keys of ``rows`` minima each.  With 16 bands of 2, a pair at 0.8
shares no key with a probability of 0.36^16 < 10^-7, and a closer pair with less.  Retrieved pairs are verified by the exact similarity of their
sets of shingles (64-bit hashes); within a key only a spanning forest of the links leaves the task, and a key with more
than ``most`` texts is dealt over chunk pairs (common.dealt), so no pair of a crowded key is passed over.

Words are what op6 takes: split at white space, ASCII letters in lower case.  A text of fewer than five words is one
shingle; null and empty texts are equal.  A vertex is a distinct text, so rows that repeat an id with another text are
judged each for itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

WIDTH, LEAST, BANDS, ROWS = 5, 0.8, 16, 2


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of all word shingles."""
    words = text.lower().split()
    if len(words) <= width:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*[words[k:] for k in range(width)], strict=False))
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.fromiter((digest(p) for p in parts), np.uint64))


def alike(a: np.ndarray, b: np.ndarray, least: float = LEAST) -> bool:
    """Whether the Jaccard similarity of two sorted sets is at least ``least``."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared >= least * (len(both) - shared)


class Bands:
    def __init__(self, bands: int = BANDS, rows: int = ROWS, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) | np.uint64(1)
        self.b = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        """One signed key for each band."""
        least = np.full(self.bands * self.rows, np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(hashes), 16_384):
            x = hashes[None, at : at + 16_384] * self.a[:, None] + self.b[:, None]
            x ^= x >> np.uint64(29)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(32)
            least = np.minimum(least, x.min(axis=1))
        return np.array([xxhash.xxh3_64_intdigest(r.tobytes()) for r in least.reshape(self.bands, self.rows)], np.uint64).view(np.int64)


def signatures(texts: DataFrame) -> DataFrame:
    """(v, t, k): of each text (v, text), a key in each band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands()
        for batch in batches:
            for part in common.parts(batch, "text"):
                keys = np.concatenate([bands.keys(shingles(t.as_buffer().to_pybytes())) for t in part.column(1)])
                arrays = [pa.array(np.repeat(part.column(0).to_numpy(), bands.bands)), pa.array(np.tile(np.arange(bands.bands, dtype=np.int32), part.num_rows)), pa.array(keys)]
                yield pa.RecordBatch.from_arrays(arrays, ["v", "t", "k"])

    return common.small_batches(texts).mapInArrow(run, "v long, t int, k long")


def forest(sets: list[np.ndarray], side: np.ndarray | None) -> Iterator[tuple[int, int]]:
    """Pairs of positions that connect all that pairs alike connect.  side: only pairs across it count."""
    left = list(range(len(sets)))
    while left:
        queue, left = [left[0]], left[1:]
        while queue and left:
            x, rest = queue.pop(), []
            for y in left:
                if (side is None or side[x] != side[y]) and alike(sets[x], sets[y]):
                    yield x, y
                    queue.append(y)
                else:
                    rest.append(y)
            left = rest


def links(keyed: DataFrame, texts: DataFrame, most: int = 1024) -> DataFrame:
    """(a, b) over v: enough links to connect all texts (v, text) alike that share a key (v, t, k)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, cuts in common.runs(batches, 4):
            a, b = [], []
            _, _, c, d, own, v, text = cols
            known: dict[int, np.ndarray] = {}
            for s, e in zip(cuts, cuts[1:], strict=False):
                ids = v[s:e].tolist()
                for i, t in zip(ids, text[s:e], strict=True):
                    if i not in known:
                        known[i] = shingles(t.encode())
                for x, y in forest([known[i] for i in ids], own[s:e] if c[s] != d[s] else None):
                    a.append(ids[x]), b.append(ids[y])
            del cols, text, known
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return common.dealt(keyed, ["t", "k"], "v", most, texts).mapInArrow(run, "a long, b long").distinct()


def shared(keyed: DataFrame) -> DataFrame:
    """(t, k, v) of keys that more than one text has (v, t, k distinct).  Keys with the same texts tell the same, so one
    of them stays: near copies share most bands, and their texts need to meet only once.  Sets are told apart by
    their number and two 64-bit hashes."""
    marks = [F.bit_xor(F.xxhash64("v", F.lit(i))).alias(f"x{i}") for i in range(2)]
    met = keyed.groupBy("t", "k").agg(F.count("*").alias("n"), *marks).where("n > 1")
    once = met.groupBy("n", "x0", "x1").agg(F.min(F.struct("t", "k")).alias("x")).select("x.t", "x.k")
    return keyed.join(once, ["t", "k"]).select("t", "k", "v")


def meeting(texts: DataFrame, met: DataFrame, most_sent: int = 4_000_000) -> DataFrame:
    """Of texts (v, text) one for each v of met.  Up to ``most_sent`` (counted) are sent to the texts, so that no other text is
    moved; more are joined by moving all texts."""
    wanted = common.staged(met.select("v").distinct(), "meeting")
    wanted = F.broadcast(wanted) if wanted.count() <= most_sent else wanted.hint("shuffle_hash")
    return texts.join(wanted, "v", "left_semi").dropDuplicates(["v"])


def keep(docs: DataFrame, most: int = 1024, among: DataFrame | None = None) -> DataFrame:
    """One row of docs for each component of near copies, with all its columns: that of the least id (a row without an
    id only where no row has one), then of the least text; equal repeats are one.  among: (keeper, v) of the only rows that
    count.  Until the end, texts are moved only to meet those that share a key."""
    texts = docs.select(common.text_hash("text").alias("v"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    keyed = common.staged(signatures(texts), "signatures")
    if among is None:
        among = docs.select(F.col("doc_id").cast("long").alias("keeper"), common.text_hash("text").alias("v"))
    else:
        keyed = keyed.join(among.select("v").distinct(), "v", "left_semi")
    met = common.staged(shared(keyed.select("t", "k", "v").distinct()), "met")
    held = common.staged(meeting(texts, met), "texts")
    found = components(links(met, held, most)).select(F.col("id").alias("v"), "component")
    ids = among.groupBy("v").agg(F.min("keeper").alias("id"))
    groups = ids.join(found, "v", "left").select("v", "id", F.coalesce("component", "v").alias("component"))
    first = groups.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "v")).alias("x"))
    return common.chosen(docs, common.staged(first.select(F.col("x.id").alias("keeper"), F.col("x.v").alias("v")), "keepers"))
