"""Near-duplicate vectors through a pivot-permutation index.

Reference points (pivots) are chosen, far apart from each other, from a bounded sample; their number grows with the root
of the number of vectors, so lists stay short.  A vector is described by the beginning of its permutation: its ``near``
nearest pivots in order of nearness.  The inverted lists are keyed by label and pivot and hold the descriptions.  Within
a list, the pivots that two vectors share are counted, then those of them whose places in the two orders differ by at
most ``slip``; pairs with ``shared`` such pivots are candidates, and are verified by cosine in double precision.  A pair
that meets in several lists counts in that of the least pivot so shared, so link counts are summed without listing pairs;
only a spanning forest of the links leaves a task.  Long lists are dealt in chunks, all pairs of chunks compared.

Two vectors in random directions at a cosine of 0.98 share three of eight pivots in that way with a probability of 0.98
at least (16 to 256 components, 128 to 8192 pivots; the lower dimension and more pivots have the least).

Equal vectors of a label are one class with a weight; they link with each other.  Vectors of different lengths are not
compared.  Null labels and vectors that are null, zero, or hold null or non-finite components link with nothing and are
their own component.  An empty table gives no rows; other columns stay out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .components import components


def choose(sample: np.ndarray, pivots: int) -> np.ndarray:
    """Unit vectors of a sample, each the one farthest from those chosen before; a small sample is filled up with random ones."""
    if len(sample) < pivots:
        sample = np.concatenate([sample, np.random.default_rng(sample.shape[1]).normal(size=(pivots - len(sample), sample.shape[1]))])
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    chosen, best = [0], unit @ unit[0]
    while len(chosen) < min(pivots, len(unit)):
        k = int(best.argmin())
        chosen.append(k)
        best = np.maximum(best, unit @ unit[k])
    return unit[chosen]


def component_kind(rows: DataFrame) -> str:
    """How components are kept: as 32-bit floats if that is what they are, else as 64-bit ones."""
    return "<f4" if isinstance(rows.schema["embedding"].dataType.elementType, T.FloatType) else "<f8"


def vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, label, vec): the components in a binary, null where the vector can't be compared."""
    kind = component_kind(rows)
    slim = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<float>" if kind == "<f4" else "array<double>").alias("e"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            starts, ends = (np.asarray(lists.offsets)[k : len(lists) + k] for k in (0, 1))
            values = np.asarray(lists.values.fill_null(float("nan")))
            out = []
            for ok, s, e in zip(np.asarray(lists.is_valid()), starts, ends, strict=True):
                v = values[s:e]
                out.append((v.astype(kind) + np.array(0, kind)).tobytes() if ok and np.isfinite(v).all() and v.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["vec_id", "label", "vec"])

    return slim.mapInArrow(run, "vec_id long, label long, vec binary")


def _unit(blobs, kind: str) -> np.ndarray:
    """Vectors of length one, in double precision."""
    x = np.frombuffer(b"".join(blobs), kind).reshape(len(blobs), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def number_of_pivots(classes: int, least: int, most: int) -> int:
    """Four times the root of the number of vectors, so that a list has about two times the root of it."""
    return min(most, max(least, 4 * math.isqrt(classes)))


def describe(unit: np.ndarray, base: np.ndarray, near: int) -> np.ndarray:
    """The ``near`` nearest of the pivots of each vector, the nearest first, equal ones by number; -1 where there are fewer."""
    n = min(near, len(base))
    out = np.full((len(unit), near), -1, np.int32)
    for at in range(0, len(unit), 1024):
        close = unit[at : at + 1024] @ base.T
        top = np.sort(np.argpartition(-close, n - 1, axis=1)[:, :n], axis=1)
        order = np.argsort(-np.take_along_axis(close, top, 1), axis=1, kind="stable")
        out[at : at + 1024, :n] = np.take_along_axis(top, order, 1)
    return out


def lists(classes: DataFrame, index, pivots: int, near: int, kind: str) -> DataFrame:
    """(label, dim, list, rep, weight, order): a class in the list of each of its nearest pivots; order: these, in order.
    index: a broadcast of the pivots for each number of components."""
    size = np.dtype(kind).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, rep, weight, vec = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            dims = np.array([len(v) // size for v in vec])
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                base = index.value.get(dim)
                if base is None:
                    base = choose(np.zeros((0, dim)), pivots)
                for at in range(0, len(rows), 4096):
                    own = rows[at : at + 4096]
                    order = describe(_unit(vec[own], kind), base, near)
                    i, place = np.nonzero(order >= 0)
                    prefix = np.array([r.tobytes() for r in order], object)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(label[own][i]), pa.array(np.full(len(i), dim)), pa.array(order[i, place].astype(np.int64)), pa.array(rep[own][i]), pa.array(weight[own][i]), pa.array(prefix[i], pa.binary())],
                        ["label", "dim", "list", "rep", "weight", "order"],
                    )

    return classes.select("label", "rep", "weight", "vec").mapInArrow(run, "label long, dim long, list long, rep long, weight long, order binary")


def candidates(left: np.ndarray, right: np.ndarray, pivot: int, shared: int, slip: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of pairs of the orders left and right with ``shared`` common pivots, at places that differ by
    ``slip`` at most, of which ``pivot`` is the least.  Common pivots are counted by one product of incidence matrices."""
    known, at = np.unique(right, return_inverse=True)
    at = at.reshape(right.shape)
    held = np.zeros((len(right), len(known)), np.float32)
    held[np.arange(len(right))[:, None], at] = right >= 0
    where = np.minimum(np.searchsorted(known, left), len(known) - 1)
    own = np.zeros((len(left), len(known)), np.float32)
    np.maximum.at(own, (np.arange(len(left))[:, None], where), ((known[where] == left) & (left >= 0)).astype(np.float32))
    i, j = np.nonzero(own @ held.T >= shared)
    place = np.arange(left.shape[1])
    close = np.abs(place[:, None] - place[None, :]) <= slip
    keep = np.zeros(len(i), bool)
    for k in range(0, len(i), 65_536):
        a, b = left[i[k : k + 65_536]], right[j[k : k + 65_536]]
        same = ((a[:, :, None] == b[:, None, :]) & close & (a >= 0)[:, :, None]).any(axis=2)
        least = np.where(same, a, np.iinfo(np.int32).max).min(axis=1)
        keep[k : k + 65_536] = (same.sum(axis=1) >= shared) & (least == pivot)
    return i[keep], j[keep]


def verified(rows: DataFrame, classes: DataFrame, least: float, shared: int, slip: int, near: int, most: int, kind: str) -> DataFrame:
    """(a, b, n): n is what b's and others' weights add to a's links where b is null; else a and b are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, cuts in common.runs(batches, 5):
            _, _, key, c, d, own, rep, weight, order, vec = cols
            for s, e in zip(cuts, cuts[1:], strict=False):
                unit, w, ids, cross = _unit(vec[s:e], kind), weight[s:e], rep[s:e], c[s] != d[s]
                prefix = np.frombuffer(b"".join(order[s:e]), np.int32).reshape(-1, near)
                add, a, b = np.zeros(e - s, np.int64), [], []
                root = np.arange(e - s)
                for at in range(0, e - s, 512):
                    i, j = candidates(prefix[at : at + 512], prefix, int(key[s]), shared, slip)
                    keep = (i + at < j) & ((own[s + i + at] != own[s + j]) if cross else True)
                    i, j = i[keep], j[keep]
                    if not len(i):
                        continue
                    keep = (unit[at : at + 512] @ unit.T)[i, j] >= least
                    i, j = i[keep] + at, j[keep]
                    np.add.at(add, i, w[j])
                    np.add.at(add, j, w[i])
                    fresh = root[i] != root[j]
                    for x, y in zip(i[fresh].tolist(), j[fresh].tolist(), strict=True):
                        if root[x] != root[y]:
                            a.append(int(ids[x])), b.append(int(ids[y]))
                            root[root == root[y]] = root[x]
                hit = np.flatnonzero(add)
                if len(hit):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([*ids[hit].tolist(), *a], pa.int64()), pa.array([None] * len(hit) + b, pa.int64()), pa.array([*add[hit].tolist(), *[0] * len(a)], pa.int64())], ["a", "b", "n"]
                    )

    return common.dealt(rows, ["label", "dim", "list"], "rep", most, classes.select("rep", "vec")).mapInArrow(run, "a long, b long, n long")


def near_duplicates(rows: DataFrame, least: float = 0.98, near: int = 8, shared: int = 3, slip: int = 5, least_pivots: int = 128, most_pivots: int = 16_384, sample: int = 4096, most: int = 512) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.  Pivots, ``number_of_pivots`` of them, are chosen from
    ``sample`` classes or twice as many as there are pivots, those with the least hash; every class is in the index.
    Beyond ``most_pivots``, which bounds what workers hold, lists only get longer."""
    table = common.staged(vectors(rows), "vectors")
    good = table.where("vec IS NOT NULL AND label IS NOT NULL")
    # Classes have numbers of their own: an id may come with several vectors, or be null.
    grouped = good.groupBy("label", "vec").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("weight"))
    classes = common.staged(grouped.withColumn("rep", F.monotonically_increasing_id()), "classes")
    pivots = number_of_pivots(classes.count(), least_pivots, most_pivots)
    drawn = [bytes(r.vec) for r in classes.orderBy(F.xxhash64("vec"), "rep").limit(max(sample, 2 * pivots)).select("vec").collect()]
    kind = component_kind(rows)
    size = np.dtype(kind).itemsize
    index = {n // size: choose(_unit([v for v in drawn if len(v) == n], kind), pivots) for n in {len(v) for v in drawn}}
    held = lists(classes, rows.sparkSession.sparkContext.broadcast(index), pivots, near, kind)
    found = common.staged(verified(held, classes, least, shared, slip, near, most, kind), "found")
    counts = found.where("b IS NULL").groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "rep")
    linked = components(found.where("b IS NOT NULL").select("a", "b")).withColumnRenamed("id", "rep")
    rooted = classes.join(counts, "rep", "left").join(linked, "rep", "left").withColumn("root", F.coalesce("component", "rep"))
    ids = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_class = rooted.join(ids, "root").select("label", "vec", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")
    joined = table.join(by_class, ["label", "vec"], "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
