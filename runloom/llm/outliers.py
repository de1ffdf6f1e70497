"""Quality rules with robust multivariate outliers.

Every row has five transformed statistics.  Of the rows that pass the base rules, location and scatter are estimated by
the minimum covariance determinant for each language, then for each language and source.  A group has the estimate of its
language as a prior that counts as ``PRIOR`` rows, and a language the medians and quartile ranges of all rows, so that a
group of any size, of one row too, has an estimate of its own by one formula: with n rows the prior weighs PRIOR / (n + PRIOR).

With h = ceil(share * n) rows taken, the scatter is (c * sum (x - m)(x - m)' + PRIOR * (T + (m - m0)(m - m0)')) / (h + PRIOR)
plus the counting noise of a text of 50 words.  A concentration step takes the h rows nearest to an estimate; as prior
and noise are the same before and after, it never raises the determinant.  Every group has four starts (its prior, all
rows, two random eighths); after two steps the start of the lowest determinant goes on until no group's
falls by a thousandth any more.
The h nearest rows are found by sums over narrow bins of the squared distance; rows of the bin in which the h-th lies
count with the fraction that makes h of them, and so do ties.  Then rows within the 0.975 quantile are estimated once more.

A row is an outlier if it lies beyond five standard deviations, by the F distribution that the distance of a new row to
an estimate from so many rows has; a row exactly there stays.

Rows lie in ranges of language, source and id, so partial sums of a group leave few tasks; every step is one aggregation
by group, start and bin, no group's rows meet in one task, and a source with a third of all rows is as even as any other.

Null texts are empty and fail the base rules; null languages and sources are groups like any other; repeated rows each
count; an empty table gives no rows; columns other than doc_id, text, lang and source stay out of ``judge`` and pass
through ``keep`` whatever their names; texts are read one by one, the longest within what a task holds of it and its words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .textstats import RULE_STATS, statistics, with_statistics

LEAST_WORDS = 50
#: Rows that a prior counts as: the numbers that an estimate of five statistics has (5 means, 15 covariances).
PRIOR = 20
#: Both tails of a normal distribution beyond five standard deviations.
TAIL = math.erfc(5 / math.sqrt(2))
#: Estimates (some 400 bytes each) up to this number are sent to all tasks; beyond, adaptive joins split the rows of a large group.
MOST_BROADCAST = 50_000
#: Bins for each doubling of the squared distance.
FINE = 48


def features() -> dict[str, tuple[Column, float]]:
    """Transformed statistics, and the standard deviation that chance alone gives each in a text of LEAST_WORDS words:
    of the root of a rate whose events come in clumps of c words, sqrt(c / n) / 2 (symbols one by one, lines of some
    four words, repeats of two three-word windows); of a mean word length, that of a word's (2.5) over sqrt(n)."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    rate = lambda clump: math.sqrt(clump / LEAST_WORDS) / 2
    return {
        "x0": (F.log(n), 1 / math.sqrt(LEAST_WORDS)),
        "x1": (F.col("word_chars") / n, 2.5 / math.sqrt(LEAST_WORDS)),
        "x2": (F.sqrt(F.col("n_symbols") / n), rate(1)),
        "x3": (F.sqrt(F.col("n_dup_lines") / n), rate(1)),
        "x4": (F.sqrt(F.col("n_repeat_words") / n), rate(6)),
    }


def chi2_cdf(x: float, p: int) -> float:
    a, x = p / 2, x / 2
    if x <= 0:
        return 0.0
    term = total = 1 / a
    for k in range(1, 10_000):
        term *= x / (a + k)
        total += term
        if term < total * 1e-16:
            break
    return min(1.0, total * math.exp(-x + a * math.log(x) - math.lgamma(a)))


def _root(rising, low: float, high: float) -> float:
    """Where ``rising`` becomes positive."""
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if rising(mid) > 0 else (mid, high)
    return (low + high) / 2


def chi2_quantile(q: float, p: int) -> float:
    return _root(lambda x: chi2_cdf(x, p) - q, 0.0, 1000.0)


def f_tail(x: float, a: int, b: float) -> float:
    """Upper tail of the F distribution: the incomplete beta integral over t < b / (b + a x), with v = -(b / 2) log(t / end), by Simpson's rule."""
    if x <= 0:
        return 1.0
    v = np.linspace(0, 60, 1201)
    end = -math.log1p(a * x / b)
    y = np.exp(-v) * (-np.expm1(end - 2 * v / b)) ** (a / 2 - 1)
    whole = (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum()) * (v[1] - v[0]) / 3 * 2 / b
    return float(whole * math.exp(b / 2 * end + math.lgamma((a + b) / 2) - math.lgamma(a / 2) - math.lgamma(b / 2)))


def distance_cut(n: float, p: int, tail: float = TAIL) -> float:
    """The squared distance of a new row to an estimate from n rows that is exceeded with the chance ``tail``."""
    if n > 1e6:
        return _root(lambda x: chi2_cdf(x, p) - 1 + tail, 0.0, 1000.0)
    f = _root(lambda x: tail - f_tail(x, p, n - p), 0.0, 1e5)
    return p * (n * n - 1) / (n * (n - p)) * f


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _pairs(p: int) -> list[tuple[int, int]]:
    return [(j, k) for j in range(p) for k in range(j, p)]


def _squared(p: int) -> str:
    """Squared Mahalanobis distance from columns x, m (centre) and i (inverse scatter, row by row)."""
    terms = [f"{1 if j == k else 2} * i[{n}] * (x{j} - m[{j}]) * (x{k} - m[{k}])" for n, (j, k) in enumerate(_pairs(p))]
    return f"greatest({' + '.join(terms)}, 0D)"


def _sums(p: int, weight: str | None = None) -> list[Column]:
    """h, s.. and p..: count, sums and products of x.., or those columns themselves summed with a weight."""
    values = {"h": "1D", **{f"s{j}": f"x{j}" for j in range(p)}, **{f"p{j}_{k}": f"x{j} * x{k}" for j, k in _pairs(p)}}
    return [F.expr(f"sum({f'{weight} * {n}' if weight else v}) AS {n}") for n, v in values.items()]


ESTIMATE = "g string, up string, start int, m array<double>, t array<double>, i array<double>, logdet double, h double"


def _solved(sums: DataFrame, prior: DataFrame, noise: list[float], factor: float, weight: float, first: bool = False) -> DataFrame:
    """ESTIMATE from each group's and start's count, sums and products, and its prior (up, m, t).  t and i are scatter and
    inverse, row by row.  first: rows of start 1 give start 0 as well, the prior itself."""
    p = len(noise)
    pairs, extra = _pairs(p), np.diag(np.square(noise))
    joined = sums.join(prior.selectExpr("up", "m AS m0", "t AS t0"), "up")
    kinds = (pa.string(), pa.string(), pa.int32(), *[pa.list_(pa.float64())] * 3, pa.float64(), pa.float64())

    def square(cells) -> np.ndarray:
        out = np.zeros((p, p))
        for (j, k), v in zip(pairs, cells, strict=True):
            out[j, k] = out[k, j] = v
        return out

    def row(r: dict, start: int, centre: np.ndarray, scatter: np.ndarray) -> tuple:
        inverse = np.linalg.inv(scatter + extra)
        cells = [[float(x[j, k]) for j, k in pairs] for x in (scatter, inverse)]
        return (r["g"], r["up"], start, centre.tolist(), *cells, -float(np.linalg.slogdet(inverse)[1]), r["h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                before, shape, h = np.array(r["m0"]), square(r["t0"]), r["h"]
                if first and r["start"] == 1:
                    rows.append(row(r, 0, before, shape))
                mean = np.array([r[f"s{j}"] for j in range(p)]) / h
                spread = square([r[f"p{j}_{k}"] for j, k in pairs]) - h * np.outer(mean, mean)
                centre = (factor * h * mean + weight * before) / (factor * h + weight)
                a, b = mean - centre, centre - before
                scatter = (factor * (spread + h * np.outer(a, a)) + weight * (shape + np.outer(b, b))) / (h + weight)
                rows.append(row(r, r["start"], centre, scatter))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in ESTIMATE.split(", ")])

    return joined.mapInArrow(run, ESTIMATE)


def _sized(estimates: DataFrame) -> DataFrame:
    """A written table of estimates, marked for broadcast if it has at most MOST_BROADCAST rows."""
    return F.broadcast(estimates) if estimates.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else estimates


def _nearest(rows: DataFrame, current: DataFrame, share: float, p: int) -> DataFrame:
    """(g, up, start, h, s.., p..): sums over the nearest ``share`` of each group's rows (g, up, x..), by each of its estimates."""
    near = rows.join(_sized(current.select("g", "start", "m", "i")), "g").selectExpr("g", "up", "start", *[f"x{j}" for j in range(p)], f"cast(floor(log2(greatest({_squared(p)}, 1e-12D)) * {FINE}) AS int) AS bin")
    binned = near.groupBy("g", "up", "start", "bin").agg(*_sums(p))
    upto = binned.withColumns({"upto": F.expr("sum(h) OVER (PARTITION BY g, start ORDER BY bin ROWS UNBOUNDED PRECEDING)"), "whole": F.expr(f"ceil({share}D * sum(h) OVER (PARTITION BY g, start) - 1e-9D)")})
    taken = upto.withColumn("w", F.expr("greatest(0D, least(1D, (whole - (upto - h)) / h))")).where("w > 0")
    return taken.groupBy("g", "up", "start").agg(*_sums(p, "w"))


def _lowest(estimates: DataFrame) -> DataFrame:
    """Of each group the estimate of the lowest determinant, the least start of equals; fell: by how much it is below the highest."""
    cells = ", ".join(c for c in estimates.columns if c != "g")
    return estimates.groupBy("g").agg(F.expr(f"min_by(struct({cells}), struct(logdet, start)) AS x"), F.expr("max(logdet) - min(logdet) AS fell")).select("g", "x.*", "fell")


def estimates(rows: DataFrame, prior: DataFrame, noise: list[float], weight: float = PRIOR, share: float = 0.75, most_steps: int = 30, least_fall: float = 1e-3, tail: float = TAIL, reweigh: bool = True) -> DataFrame:
    """(g, m, t, i, logdet, h, cut): the estimate of each group g over all of its rows (g, up, x..) with the prior of up
    (up, m, t); a written table.  reweigh: estimated once more over the rows within the 0.975 quantile."""
    p = len(noise)
    factor = share / chi2_cdf(chi2_quantile(share, p), p + 2)
    values = ", ".join(f"x{j}" for j in range(p))
    with common.scratch(rows.sparkSession) as stage:
        drawn = ", ".join(f"CASE WHEN pmod(xxhash64({s}, {values}), 8) = 0 THEN {s} END" for s in (2, 3))
        begun = rows.withColumn("start", F.expr(f"explode(array_compact(array(1, {drawn})))"))
        current = stage(_solved(begun.groupBy("g", "up", "start").agg(*_sums(p)), prior, noise, 1.0, weight, True), "estimate")
        step = lambda before: _solved(_nearest(rows, before, share, p), prior, noise, factor, weight)
        current = stage(step(current), "estimate")
        current = stage(_lowest(step(current)), "estimate")
        for _ in range(most_steps):
            both = step(current).withColumn("start", F.lit(-1)).unionByName(current.drop("fell").withColumn("start", F.lit(0)))
            current = stage(_lowest(both), "estimate")
            if current.where(f"start = -1 AND fell > {least_fall}").isEmpty():
                break
        current = current.drop("fell")
        if reweigh:
            near = chi2_quantile(0.975, p)
            inside = rows.join(_sized(current.select("g", "m", "i")), "g").where(f"{_squared(p)} <= {near}D").withColumn("start", F.lit(0))
            again = _solved(inside.groupBy("g", "up", "start").agg(*_sums(p)), prior, noise, 0.975 / chi2_cdf(near, p + 2), weight)
            # A group none of whose rows is so near keeps what it has.
            cells = ", ".join(c for c in current.columns if c != "g")
            current = again.unionByName(current.withColumn("start", F.lit(1))).groupBy("g").agg(F.expr(f"min_by(struct({cells}), start) AS x")).select("g", "x.*")
        return common.staged(_with_cut(current, p, weight, tail), "estimates")


def _with_cut(found: DataFrame, p: int, weight: float, tail: float) -> DataFrame:
    kept = found.select("g", "m", "t", "i", "logdet", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[float, float] = {}
        for batch in batches:
            sizes = [max(h + weight, p + 1.0) for h in batch.column(5).to_pylist()]
            for n in set(sizes) - known.keys():
                known[n] = distance_cut(n, p, tail)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([known[n] for n in sizes], pa.float64())], [*batch.schema.names, "cut"])

    return kept.mapInArrow(run, "g string, m array<double>, t array<double>, i array<double>, logdet double, h double, cut double")


def group(*columns: str) -> Column:
    """A name for a language's group, or that of a language and source; nulls are a value."""
    return F.to_json(F.struct(F.lit(len(columns)).alias("level"), *[F.col(c).cast("string").alias(c) for c in columns]))


def fit(stats: DataFrame, share: float = 0.75, weight: float = PRIOR, tail: float = TAIL) -> DataFrame:
    """From written statistics (doc_id, lang, source, RULE_STATS): the estimate of each language and source; a written table."""
    of = features()
    noise, p, spark = [f for _, f in of.values()], len(of), stats.sparkSession
    with common.scratch(spark) as stage:
        every = stats.where(~base_failed()).select("doc_id", "lang", "source", *[c.cast("double").alias(n) for n, (c, _) in of.items()])
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        passed = stage(every.repartitionByRange(n, "lang", "source", "doc_id").drop("doc_id"), "passed")
        middle = passed.agg(*[F.expr(f"percentile_approx(x{j}, array(0.25, 0.5, 0.75), 1000) AS q{j}") for j in range(p)]).first()
        quartiles = [middle[f"q{j}"] or [0.0, 0.0, 0.0] for j in range(p)]
        spread = [((q[2] - q[0]) / 1.349) ** 2 for q in quartiles]
        begin = ("", [float(q[1]) for q in quartiles], [float(spread[j]) if j == k else 0.0 for j, k in _pairs(p)])
        prior = spark.createDataFrame([begin], "up string, m array<double>, t array<double>")
        for keys in (("lang",), ("lang", "source")):
            above = group(*keys[:-1]) if keys[:-1] else F.expr("left(lang, 0)")
            found = estimates(passed.select(group(*keys).alias("g"), F.coalesce(above, F.lit("")).alias("up"), *of), prior, noise, weight, share, tail=tail)
            prior = found.select(F.col("g").alias("up"), "m", "t")
        return found


def verdict(rows: DataFrame, fitted: DataFrame) -> DataFrame:
    """rows (lang, source, RULE_STATS, ...) with base_failed, distance and kept."""
    of = features()
    named = rows.select("*", *[c.cast("double").alias(n) for n, (c, _) in of.items()], base_failed().alias("base_failed"), group("lang", "source").alias("g"))
    # A row that passed has an estimate, as its group has at least this row.
    out = named.join(_sized(fitted.select("g", "m", "i", "cut")), "g", "left").withColumn("d", F.expr(f"CASE WHEN NOT base_failed THEN {_squared(len(of))} END"))
    return out.select(*rows.columns, "base_failed", F.sqrt("d").alias("distance"), F.expr("coalesce(NOT base_failed AND d <= cut, false)").alias("kept"))


def judge(docs: DataFrame, share: float = 0.75, weight: float = PRIOR, tail: float = TAIL) -> DataFrame:
    """(doc_id, RULE_STATS, base_failed, distance, kept) of every row of docs (doc_id, text, lang, source); distance is
    null where the row failed the base rules."""
    stats = common.staged(statistics(docs), "statistics")
    return verdict(stats, fit(stats, share, weight, tail)).select("doc_id", *RULE_STATS, "base_failed", "distance", "kept")


def keep(docs: DataFrame, share: float = 0.75, weight: float = PRIOR, tail: float = TAIL) -> DataFrame:
    """The rows of docs that ``judge`` keeps, with all their columns."""
    with common.scratch(docs.sparkSession) as stage:
        fitted = fit(stage(statistics(docs), "statistics"), share, weight, tail)
    rows = common.numbered(docs).select("*", F.col(common.place(docs, "lang")).cast("string").alias("lang"), F.col(common.place(docs, "source")).cast("string").alias("source"))
    judged = verdict(with_statistics(rows, common.place(docs, "text"), keep_text=True), fitted)
    return common.named(judged.where("kept"), docs)
