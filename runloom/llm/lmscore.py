"""Cross-entropy difference by two matched bigram models, each document left out of the models that score it.

Target and background models have one vocabulary (the tokenizer's), one order and one smoothing: Witten-Bell bigrams
over unigrams with one added to every count.  Counts are taken over all documents of either corpus; a document's own
counts are taken off again (bigrams, contexts, kinds, unigrams and totals) before it is scored, from the target's too if
it is in that, so a score does not say which sample a document was in.  The score is the mean loss per token under the
target model less that under the background model, in nats: the lower, the more like the target.  A document that occurs
twice is known to the background by its copy.

Token ids are written once, compressed, with the mark of the target corpus, and read for counting and for scoring.  Up to
``most_broadcast`` bigrams the counts go to the workers as sorted arrays; beyond, each document's bigrams are joined with
them and gathered again by document.  Both ways give the same scores.

Null and empty texts have no tokens and score zero; repeated rows count and are scored each for itself, its copies staying
in the models; an empty target leaves its model with the added counts alone; empty tables give no rows; other columns,
whatever their names, stay out; equal scores are no ties to break.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, wordbpe

SHIFT = 20


def token_rows(docs: DataFrame, path: str) -> DataFrame:
    """(row, doc_id, n_tokens, ids) with ids as compressed 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, pack = wordbpe.loaded(path), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part in common.parts(batch, "text"):
                ids = list(coder.encode_all(part.column(1)))
                blobs = [pack.compress(x.astype("<u2" if not len(x) or x.max() < 1 << 16 else "<u4").tobytes()) for x in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(blobs, pa.binary())], ["doc_id", "n_tokens", "ids"])

    rows = common.small_batches(common.documents(docs)).mapInArrow(run, "doc_id long, n_tokens long, ids binary")
    return rows.withColumn("row", F.monotonically_increasing_id())


def _bigrams(unpack, blob: bytes, n: int, start: int) -> np.ndarray:
    """Keys of a document's bigrams, the first after the start mark."""
    raw = unpack.decompress(blob) if n else b""
    ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype(np.int64)
    return (np.concatenate([[start], ids[:-1]]).astype(np.int64) << SHIFT | ids) if n else ids


def _summed(keys: np.ndarray, background: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    own, at = np.unique(keys, return_inverse=True)
    return own, np.bincount(at, background, len(own)).astype(np.int64), np.bincount(at, target, len(own)).astype(np.int64)


def counts(rows: DataFrame, start: int, most: int = 2_000_000) -> DataFrame:
    """(key, background, target) counts of bigrams over rows (n_tokens, ids, target, background); summed in the tasks
    first, which hold ``most`` keys each at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, held, fresh, size = zstandard.ZstdDecompressor(), (np.zeros(0, np.int64),) * 3, [], 0

        def settle():
            nonlocal held, fresh, size
            if fresh:
                groups = [held]
                for flag in {f for _, f in fresh}:
                    own, n = np.unique(np.concatenate([k for k, f in fresh if f == flag]), return_counts=True)
                    groups.append((own, n * flag[0], n * flag[1]))
                held = _summed(*(np.concatenate(c) for c in zip(*groups, strict=True)))
                fresh, size = [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in held], ["key", "background", "target"])

        for batch in batches:
            for n, blob, t, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fresh.append((_bigrams(unpack, blob, n, start), (int(b), int(t))))
                size += n
                if size > 4_000_000:
                    settle()
            if len(held[0]) > most:
                yield out()
                held = (np.zeros(0, np.int64),) * 3
        settle()
        if len(held[0]):
            yield out()

    partial = rows.select("n_tokens", "ids", "target", "background").mapInArrow(run, "key long, background long, target long")
    return partial.groupBy("key").agg(F.sum("background").alias("background"), F.sum("target").alias("target"))


COUNTS = ("b", "t", "b_all", "b_kinds", "t_all", "t_kinds", "b_one", "t_one")


def model(counted: DataFrame) -> DataFrame:
    """(key, COUNTS): of every bigram that either corpus has, its counts, those of its context (and how many kinds follow
    it), and those of its second token; b: background, t: target."""
    c = counted.select("key", F.shiftright("key", SHIFT).alias("u"), F.col("key").bitwiseAND((1 << SHIFT) - 1).alias("v"), F.col("background").alias("b"), F.col("target").alias("t"))
    context = c.groupBy("u").agg(*[f(x).alias(f"{x}_{n}") for x in "bt" for n, f in (("all", F.sum), ("kinds", lambda x: F.count_if(F.col(x) > 0)))])
    single = c.groupBy("v").agg(F.sum("b").alias("b_one"), F.sum("t").alias("t_one"))
    return c.join(context, "u").join(single, "v").select("key", *COUNTS)


def losses(own: np.ndarray, times: np.ndarray, cells: dict[str, np.ndarray], whole: dict[str, int], vocabulary: int, target: bool) -> tuple[float, float]:
    """Sums of losses of a document's bigrams (own: distinct keys) under target and background without the document."""
    u, v = (np.unique(x, return_inverse=True)[1] for x in (own >> SHIFT, own & ((1 << SHIFT) - 1)))
    by_u, by_v, n = np.bincount(u, times)[u], np.bincount(v, times)[v], int(times.sum())
    out = []
    for x, held in (("t", int(target)), ("b", 1)):
        count = cells[x] - held * times
        kinds = cells[f"{x}_kinds"] - held * np.bincount(u, count == 0)[u]
        one = (cells[f"{x}_one"] - held * by_v + 1) / (whole[x] - held * n + vocabulary)
        context = cells[f"{x}_all"] - held * by_u
        p = np.where(kinds > 0, (count + kinds * one) / np.maximum(context + kinds, 1), one)
        out.append(float(-(np.log(p) * times).sum()))
    return out[0], out[1]


SCORED = "doc_id long, n_tokens long, t double, b double"


def _by_arrays(rows: DataFrame, counted: DataFrame, whole: dict[str, int], start: int, vocabulary: int) -> DataFrame:
    got = counted.orderBy("key").toPandas()
    keys, pairs = got["key"].to_numpy(), {"b": got["background"].to_numpy(), "t": got["target"].to_numpy()}
    u, v = keys >> SHIFT, keys & ((1 << SHIFT) - 1)
    ends = {}
    for x, c in pairs.items():
        ends |= {f"{x}_all": np.bincount(u, c, start + 1), f"{x}_kinds": np.bincount(u, c > 0, start + 1), f"{x}_one": np.bincount(v, c, start + 1)}
    shared = rows.sparkSession.sparkContext.broadcast((keys, pairs, ends))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (keys, pairs, ends), unpack = shared.value, zstandard.ZstdDecompressor()
        for batch in batches:
            t, b = [], []
            for n, blob, target in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                own, times = np.unique(_bigrams(unpack, blob, n, start), return_counts=True)
                at, u, v = np.searchsorted(keys, own), own >> SHIFT, own & ((1 << SHIFT) - 1)
                cells = {x: c[at] for x, c in pairs.items()} | {x: c[v if x.endswith("one") else u] for x, c in ends.items()}
                x, y = losses(own, times, cells, whole, vocabulary, target) if n else (0.0, 0.0)
                t.append(x), b.append(y)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(t, pa.float64()), pa.array(b, pa.float64())], ["doc_id", "n_tokens", "t", "b"])

    return rows.select("doc_id", "n_tokens", "ids", "target").mapInArrow(run, SCORED)


def _by_join(rows: DataFrame, counted: DataFrame, whole: dict[str, int], start: int, vocabulary: int) -> DataFrame:
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, held, size = zstandard.ZstdDecompressor(), [], 0
        table = lambda: pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], ["row", "key", "times"])
        for batch in batches:
            for row, n, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own, times = np.unique(_bigrams(unpack, blob, n, start), return_counts=True)
                if n:
                    held.append((np.full(len(own), row), own, times))
                    size += len(own)
                if size > 100_000:
                    yield table()
                    held, size = [], 0
        if held:
            yield table()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, n, target, cells in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if cells:
                    cols = {k: np.array([c[k] for c in cells]) for k in ("key", "times", *COUNTS)}
                    out.append((doc_id, n, *losses(cols["key"], cols["times"], cols, whole, vocabulary, target)))
                else:
                    out.append((doc_id, n, 0.0, 0.0))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)], ["doc_id", "n_tokens", "t", "b"])

    parts = rows.select("row", "n_tokens", "ids").mapInArrow(split, "row long, key long, times long").join(model(counted), "key")
    # A document's cells are no more than its tokens.
    gathered = parts.groupBy("row").agg(F.collect_list(F.struct("key", "times", *COUNTS)).alias("cells"))
    return rows.select("row", "doc_id", "n_tokens", "target").join(gathered, "row", "left").select("doc_id", "n_tokens", "target", "cells").mapInArrow(score, SCORED)


def score(docs: DataFrame, target_ids: DataFrame, path: str | None = None, vocabulary: int = 49408, most_broadcast: int = 1_000_000, most_ids: int = 4_000_000) -> DataFrame:
    """(doc_id, n_tokens, loss_target, loss_background, score) of every row of docs; losses are means per token.

    The target corpus is the documents whose ids are in target_ids (doc_id), the background all documents."""
    path = path or wordbpe.default_path()
    # Written, so that its size is known: up to ``most_ids`` ids are broadcast and no text's ids move; more are joined.
    target = common.staged(target_ids.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct().withColumn("target", F.lit(True)), "target")
    target = F.broadcast(target) if target.count() <= most_ids else target
    rows = common.staged(token_rows(docs, path).join(target, "doc_id", "left").withColumn("target", F.coalesce("target", F.lit(False))), "tokens")
    counted = common.staged(counts(rows.withColumn("background", F.lit(True)), vocabulary), "bigrams")
    sums = counted.agg(F.count("*").alias("n"), F.sum("background").alias("b"), F.sum("target").alias("t")).first()
    way = _by_arrays if sums.n <= most_broadcast else _by_join
    n = F.greatest(F.col("n_tokens"), F.lit(1))
    scored = way(rows, counted, {"b": sums.b or 0, "t": sums.t or 0}, vocabulary, vocabulary)
    return scored.select("doc_id", "n_tokens", (F.col("t") / n).alias("loss_target"), (F.col("b") / n).alias("loss_background"), ((F.col("t") - F.col("b")) / n).alias("score"))


def good_ids(labels: DataFrame) -> DataFrame:
    """Documents labelled good and not toxic: a target corpus."""
    return labels.where("quality = 1 AND toxic = 0").select("doc_id")
