"""Quality classifier: a sparse ensemble of rules over statistics, compiled to Spark columns.

Shallow trees are boosted on a bounded sample of labelled rows; every path from a root is a conjunctive rule.  A
logistic model with a lasso penalty weighs the rules, most of them with zero; what remains is one column expression.

Null and empty texts are scored by their (zero) statistics; rows without labels are scored like others; repeated rows
each get a score; without labels every score is 0.5, with labels of one kind alone it is their share after smoothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .textstats import statistics, with_statistics


def features() -> dict[str, Column]:
    words, chars, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    return {
        "log_words": F.log1p(F.col("n_words")),
        "word_length": F.col("word_chars") / words,
        "words_per_line": F.col("n_words") / lines,
        "symbols": F.col("n_symbols") / words,
        "repeated_lines": F.col("n_dup_lines") / lines,
        "repeated_words": F.col("n_repeat_words") / words,
        "distinct": F.col("n_distinct") / words,
        "top_word": F.col("n_top") / words,
        "stutter": F.col("n_adjacent") / words,
        "upper": F.col("n_upper") / F.greatest(F.col("n_upper") + F.col("n_lower"), F.lit(1)),
        "digits": F.col("n_digits") / chars,
        "bangs": F.col("n_bangs") / words,
        "commas": F.col("n_commas") / words,
        "stops": F.col("n_stops") / words,
        "bars": F.col("n_bars") / words,
        "long_words": F.col("n_long") / words,
        "bytes_per_char": F.col("n_bytes") / chars,
    }


@dataclass(frozen=True)
class Rule:
    """Conjunction of (feature, is greater than, threshold), and its weight."""

    terms: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0

    def column(self) -> Column:
        parts = [(F.col(f) > t) if above else (F.col(f) <= t) for f, above, t in self.terms]
        out = parts[0]
        for p in parts[1:]:
            out = out & p
        return F.when(out, F.lit(self.weight)).otherwise(F.lit(0.0))

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return np.logical_and.reduce([x[f] > t if above else x[f] <= t for f, above, t in self.terms])


@dataclass(frozen=True)
class Model:
    intercept: float
    rules: tuple[Rule, ...]

    def score(self) -> Column:
        """Between 0 and 1, higher where label 1 is likelier; over the columns of ``features``."""
        total = F.lit(self.intercept)
        for r in self.rules:
            total = total + r.column()
        return 1 / (1 + F.exp(-total))


def _cuts(x: np.ndarray, most: int) -> np.ndarray:
    q = np.unique(np.quantile(x, np.linspace(0, 1, most + 2)[1:-1]))
    above = np.sort(x)[np.minimum(np.searchsorted(np.sort(x), q, "right"), len(x) - 1)]
    return np.unique((q + above) / 2)


def _tree(codes: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, sizes: list[int], depth: int, least: float) -> tuple[list, np.ndarray]:
    """Paths [(feature, above, cut number), ...] of a tree of the given depth, and each row's step."""
    paths, step = [], np.zeros(len(gradient))
    stack = [((), np.arange(len(gradient)))]
    while stack:
        path, rows = stack.pop()
        g, h = gradient[rows], hessian[rows]
        best = (1e-6, None)
        if len(path) < depth:
            whole = g.sum() ** 2 / (h.sum() + 1)
            for f, n in enumerate(sizes):
                if n < 2:
                    continue
                gs = np.cumsum(np.bincount(codes[rows, f], g, n))[:-1]
                hs = np.cumsum(np.bincount(codes[rows, f], h, n))[:-1]
                gain = gs**2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - whole
                gain[(hs < least) | (h.sum() - hs < least)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], (f, k))
        if best[1] is None:
            step[rows] = g.sum() / (h.sum() + 1)
            continue
        f, k = best[1]
        above = codes[rows, f] > k
        for side in (False, True):
            longer = (*path, (f, side, k))
            paths.append(longer)
            stack.append((longer, rows[above == side]))
    return paths, step


def _lasso(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty, by accelerated proximal gradients; the intercept is free."""
    n, p = x.shape
    w, b = np.zeros(p, np.float32), float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    v, c, t = w.copy(), b, 1.0
    q = np.ones(p, np.float32)
    for _ in range(20):
        q = x.T @ (x @ q)
        q /= np.linalg.norm(q) + 1e-12
    rate = 1 / (0.25 * (float(np.linalg.norm(x @ q)) ** 2 / n + 1) + 1e-9)
    for _ in range(rounds):
        error = 1 / (1 + np.exp(-np.clip(x @ v + c, -30, 30))) - y
        moved = v - rate * (x.T @ error) / n
        new = np.sign(moved) * np.maximum(np.abs(moved) - rate * penalty, 0)
        b_new, t_new = c - rate * float(error.mean()), (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = (new + (t - 1) / t_new * (new - w)).astype(np.float32), b_new + (t - 1) / t_new * (b_new - b)
        w, b, t = new.astype(np.float32), b_new, t_new
    return b, w


def fit(x: dict[str, np.ndarray], y: np.ndarray, trees: int = 40, depth: int = 3, cuts: int = 32, rate: float = 0.2, penalty: float = 1e-3, least: float = 5.0, seed: int = 7) -> Model:
    names, n = list(x), len(y)
    if not n or y.min() == y.max():
        return Model(float(np.log((y.sum() + 1) / (n - y.sum() + 1))), ())
    edges = {f: _cuts(x[f], cuts) for f in names}
    codes = np.stack([np.searchsorted(edges[f], x[f], "left") for f in names], 1)
    sizes = [len(edges[f]) + 1 for f in names]
    rng, margin, found = np.random.default_rng(seed), np.full(n, np.log(y.mean() / (1 - y.mean()))), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        part = rng.random(n) < 0.5
        paths, _ = _tree(codes[part], (y - p)[part], (p * (1 - p))[part], sizes, depth, least)
        if not paths:
            break
        rules = [Rule(tuple((names[f], above, float(edges[names[f]][k])) for f, above, k in path)) for path in paths]
        longest = [r for r in rules if not any(o.terms[: len(r.terms)] == r.terms and o is not r for o in rules)]
        for r in longest:
            own = r.holds(x)
            margin = margin + rate * own * ((y - p)[own].sum() / ((p * (1 - p))[own].sum() + 1))
        found |= dict.fromkeys(rules)
    holds = {r: r.holds(x) for r in found}
    held = {h.tobytes(): r for r, h in reversed(holds.items()) if 0 < h.mean() < 1}
    rules = list(held.values())
    if not rules:
        return Model(float(np.log((y.sum() + 1) / (n - y.sum() + 1))), ())
    b, w = _lasso(np.stack([holds[r] for r in rules], 1).astype(np.float32), y.astype(np.float32), penalty)
    return Model(b, tuple(Rule(r.terms, float(k)) for r, k in zip(rules, w, strict=True) if abs(k) > 1e-6))


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, most: int = 20_000, label: str = "quality") -> Model:
    """Fits on at most ``most`` labelled rows that are not held out, those with the least hash of their id.  A document
    with several labels takes the lowest."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IS NOT NULL").where(~held_out())
    sample = known.groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # At most ``most`` pairs of numbers, whatever the tables' size.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample.select("doc_id")), "doc_id", "left_semi")
    of = features()
    rows = statistics(texts, more=True).select("doc_id", *[c.cast("double").alias(n) for n, c in of.items()]).join(F.broadcast(sample), "doc_id")
    got = rows.toPandas().sort_values(["doc_id", *of])
    return fit({n: got[n].to_numpy(float) for n in of}, (got["y"].to_numpy(int) > 0).astype(float))


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    rows = statistics(docs.select("doc_id", "text"), more=True).select("doc_id", *[c.alias(n) for n, c in features().items()])
    scored = rows.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, most: int = 20_000, threshold: float = 0.7) -> DataFrame:
    return score(docs, train(docs, labels, most), threshold)


def keep(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of docs that are scored at least the threshold, with all their columns."""
    rows = with_statistics(common.numbered(docs), common.place(docs, "text"), more=True, keep_text=True)
    return common.named(rows.select("*", *[c.alias(n) for n, c in features().items()]).where(model.score() >= threshold), docs)
