"""SimHash near-duplicates through pigeonhole blocks.

A fingerprint is cut into six blocks.  Two that differ in three bits at most agree in at least three whole blocks, so
they meet in one of the twenty tables keyed by three blocks.  Fingerprints are reduced to distinct ones before; within
a key, links are verified by Hamming distance and only a spanning forest of them leaves the task.  A key with more
than ``most`` fingerprints is dealt over chunks, and every pair of chunks is compared in a task of its own, so a
task's memory is bounded and no link is lost.

Null and empty texts have fingerprint zero and are linked like others; a vertex is a fingerprint, so rows without an id are
linked too, repeated rows are one, and rows that repeat an id with another text are judged each for itself; of rows of one
id and fingerprint the text of the least hash comes first.  A text's shingles are hashed one by one and counted in pieces.  An empty
table gives no rows; other columns, whatever their names, stay out of ``near_duplicates`` and pass through ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """Majority bits of the hashes of all word shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*[words[k:] for k in range(width)], strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, seed) for s in shingles), np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        counts += np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3, hashed: bool = False) -> DataFrame:
    """(doc_id, fp) with fp as a signed 64-bit integer; hashed: and v, the hash of the text."""
    texts = common.documents(docs)
    texts = texts.withColumn("v", common.text_hash("text")) if hashed else texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.parts(batch, "text"):
                fps = [fingerprint(t.as_buffer().to_pybytes(), width) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.array(fps, np.uint64).view(np.int64)), *part.columns[2:]], ["doc_id", "fp", *part.schema.names[2:]])

    return common.small_batches(texts).mapInArrow(run, "doc_id long, fp long" + ", v long" * hashed)


def masks(bits: int) -> list[int]:
    """Of each table, the bits that its key takes: all but ``bits`` of 2 * bits blocks."""
    blocks = 2 * bits
    edges = [64 * k // blocks for k in range(blocks + 1)]
    block = [((1 << edges[k + 1]) - 1) ^ ((1 << edges[k]) - 1) for k in range(blocks)]
    found = [sum(block[k] for k in c) for c in combinations(range(blocks), blocks - bits)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def forest(fps: np.ndarray, side: np.ndarray | None, bits: int) -> Iterator[tuple[int, int]]:
    """Pairs of positions that connect all that links within the given bits connect.  side: only pairs across it count."""
    left = np.arange(len(fps))
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(fps[left] ^ fps[x]) <= bits
            if side is not None:
                near &= side[left] != side[x]
            if near.any():
                for y in left[near].tolist():
                    yield x, y
                    queue.append(y)
                left = left[~near]


def links(reps: DataFrame, bits: int = 3, most: int = 1024) -> DataFrame:
    """(a, b) over ids of reps (fp, id), fp distinct: enough links to connect all that are within the given bits."""
    tables = F.array(*[F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("k")) for k, m in enumerate(masks(bits))])
    keyed = reps.where("id IS NOT NULL").select("fp", "id", F.explode(tables).alias("x")).select("x.t", "x.k", "fp", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, cuts in common.runs(batches, 4):
            yield table(cols, cuts)

    def table(cols: list[np.ndarray], cuts: list[int]) -> pa.RecordBatch:
        a, b = [], []
        _, _, c, d, own, fp, ident = cols
        fp = fp.view(np.uint64)
        for s, e in zip(cuts, cuts[1:], strict=False):
            ids = ident[s:e]
            if e - s == 2:
                if (int(fp[s]) ^ int(fp[s + 1])).bit_count() <= bits:
                    a.append(int(ids[0])), b.append(int(ids[1]))
                continue
            for x, y in forest(fp[s:e], own[s:e] if c[s] != d[s] else None, bits):
                a.append(int(ids[x])), b.append(int(ids[y]))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return common.dealt(keyed, ["t", "k"], "fp", most).mapInArrow(run, "a long, b long").distinct()


def _grouped(prints: DataFrame, bits: int) -> DataFrame:
    """(fp, id, component) of every distinct fingerprint; id is its least document, component the least fingerprint linked."""
    reps = common.staged(prints.groupBy("fp").agg(F.min("doc_id").alias("id")), "distinct")
    found = components(links(reps.select("fp", F.col("fp").alias("id")), bits)).select(F.col("id").alias("fp"), "component")
    return reps.join(found, "fp", "left").select("fp", "id", F.coalesce("component", "fp").alias("component"))


def near_duplicates(docs: DataFrame, bits: int = 3, width: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id, kept) of every row; component_id is the least id that links reach; kept is
    true on the row whose id that is."""
    prints = common.staged(fingerprints(docs, width), "fingerprints")
    groups = common.staged(_grouped(prints, bits), "groups")
    # Written, so that the join knows its sizes and can split a fingerprint with very many rows.
    least = groups.groupBy("component").agg(F.min("id").alias("component_id"))
    of_print = common.staged(groups.join(least, "component").select("fp", "component_id"), "of-print")
    out = prints.join(of_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def keepers(docs: DataFrame, bits: int = 3, width: int = 3) -> DataFrame:
    """(keeper, v), one row for each component, without its text: the least id (null only where no row has one), of its
    rows the least fingerprint, of these the least hash of a text.  Texts are read once and not moved."""
    prints = common.staged(fingerprints(docs, width, hashed=True), "fingerprints")
    first = _grouped(prints, bits).groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "fp")).alias("x"))
    of = first.select(F.col("x.id").alias("keeper"), F.col("x.fp").alias("kept_fp"))
    met = prints.join(of, (F.col("fp") == F.col("kept_fp")) & F.col("doc_id").eqNullSafe(F.col("keeper")))
    return common.staged(met.groupBy("kept_fp", "keeper").agg(F.min("v").alias("v")).select("keeper", "v"), "keepers")


def keep(docs: DataFrame, bits: int = 3, width: int = 3) -> DataFrame:
    """The rows of ``keepers`` with all their columns."""
    return common.chosen(docs, keepers(docs, bits, width))
