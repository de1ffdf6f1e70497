import math
import zlib

import numpy as np
import pytest

from runloom.llm import outliers, ruleclassifier, textstats
from tests.llm.rows import documents

SF = "/root/testdata/sf0.01"


def brute(text):
    words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in text).split(" ") if w]
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    covered = {j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(k, k + 3)}
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if x.strip(" \t\n\v\f\r"):
            dup += x in seen
            seen.add(x)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)


TEXTS = ["", " \n\t", "a b c a b c a b c", "x\nx\ny\n\nx \n", "é ü ## $ é ü ## $ |", "one two", "a a a a a", "l1\r\nl1\r\n", "\x1c \x85 zz"]


def test_statistics(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(99, None)]
    got = {r.doc_id: tuple(r[c] for c in textstats.RULE_STATS) for r in textstats.statistics(documents(spark, rows)).collect()}
    assert got == {k: brute(t or "") for k, t in rows}


def many(n, seed=0):
    rng = np.random.default_rng(seed)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(400)]
    return [(k, " ".join(rng.choice(words, rng.integers(60, 300)))) for k in range(n)]


def test_outliers_go_and_clean_rows_stay(spark):
    rows = many(300)
    bad = [(1000, " ".join(w + "$$$" for w in rows[0][1].split())), (1001, " ".join("longwordlongwordlong" + w for w in rows[1][1].split())), (1002, "too short"), (1003, None), (1004, "again and again " * 40)]
    got = {r.doc_id: r for r in outliers.judge(documents(spark, rows + bad)).collect()}
    assert {k for k, r in got.items() if not r.kept} == {b[0] for b in bad} and all((r.distance is None) == r.base_failed for r in got.values())
    assert {k for k, r in got.items() if r.base_failed} == {1002, 1003, 1004}
    kept = outliers.keep(documents(spark, rows[:20] + bad))
    assert sorted(r.doc_id for r in kept.collect()) == [r[0] for r in rows[:20]] and kept.columns == documents(spark, []).columns
    assert outliers.judge(documents(spark, [])).count() == 0


def test_one_estimate_for_each_language_and_source(spark):
    """Groups of every size, of one row too, have a distance; equal rows and ties are kept or rejected together."""
    rows = [(k, t, "en" if k % 3 else "fr", f"s{k % 7}" if k < 28 else "hot") for k, t in many(100)]
    rows += [(200, rows[0][1], "xx", "one"), (201, rows[0][1], "xx", "one"), (202, rows[5][1], None, None), (202, rows[5][1], None, None)]
    got = outliers.judge(documents(spark, rows)).collect()
    assert len(got) == 104 and all(r.kept and r.distance is not None for r in got)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, set()).add((r.distance, r.kept))
    assert by_id[200] == by_id[201] and len(by_id[202]) == 1


def test_estimates_against_all_subsets(spark):
    """Of small groups, the lowest determinant over all subsets of h rows, by the formula of the module."""
    from itertools import combinations

    rng, p, weight, share, noise = np.random.default_rng(2), 3, 4.0, 0.75, [0.1, 0.2, 0.3]
    factor = share / outliers.chi2_cdf(outliers.chi2_quantile(share, p), p + 2)
    m0, t0 = np.array([0.5, 0.0, -0.5]), np.array([[2.0, 0.3, 0.0], [0.3, 1.0, 0.1], [0.0, 0.1, 1.5]])
    data = {f"g{n}": np.concatenate([rng.normal(0, 1, (n - n // 4, p)), rng.normal(8, 1, (n // 4, p))]) for n in (1, 2, 5, 8, 11)}
    pairs = [(j, k) for j in range(p) for k in range(j, p)]
    rows = spark.createDataFrame([(g, "u", *map(float, r)) for g, x in data.items() for r in x], "g string, up string, " + ", ".join(f"x{k} double" for k in range(p)))
    prior = spark.createDataFrame([("u", m0.tolist(), [float(t0[j, k]) for j, k in pairs])], "up string, m array<double>, t array<double>")
    got = {r.g: r for r in outliers.estimates(rows.repartition(3), prior, noise, weight, share, reweigh=False).collect()}
    assert set(got) == set(data)
    for g, x in data.items():
        h, best = math.ceil(share * len(x)), None
        for chosen in combinations(range(len(x)), h):
            own = x[list(chosen)]
            centre = (factor * own.sum(0) + weight * m0) / (factor * h + weight)
            s = (factor * (own - centre).T @ (own - centre) + weight * (t0 + np.outer(centre - m0, centre - m0))) / (h + weight)
            best = min(best or (np.inf,), (float(np.linalg.slogdet(s + np.diag(np.square(noise)))[1]), centre.tolist()))
        assert got[g].logdet == pytest.approx(best[0], abs=1e-9) and got[g].m == pytest.approx(best[1], abs=1e-9) and got[g].h == h


def test_estimate_leaves_a_far_group_out(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 3, (300, 5)), rng.normal(40, 1, (60, 5))])
    rows = spark.createDataFrame([("g", "u", *map(float, r)) for r in x], "g string, up string, " + ", ".join(f"x{k} double" for k in range(5)))
    prior = spark.createDataFrame([("u", [1.0] * 5, [9.0 if j == k else 0.0 for j in range(5) for k in range(j, 5)])], "up string, m array<double>, t array<double>")
    got = outliers.estimates(rows, prior, [0.01] * 5).first()
    inverse = np.zeros((5, 5))
    for n, (j, k) in enumerate((j, k) for j in range(5) for k in range(j, 5)):
        inverse[j, k] = inverse[k, j] = got.i[n]
    d = np.einsum("nj,jk,nk->n", x - got.m, inverse, x - got.m)
    assert np.abs(got.m).max() < 0.8 and d[:300].max() < got.cut < d[300:].min()


def test_chi_square():
    assert outliers.chi2_quantile(0.95, 5) == pytest.approx(11.0705, abs=1e-3)
    assert outliers.chi2_cdf(3.84146, 1) == pytest.approx(0.95, abs=1e-5)
    # Points of published tables of the F distribution.
    assert [outliers.f_tail(x, a, b) for x, a, b in ((2.71, 5, 20), (4.10, 5, 20), (2.53, 5, 30))] == pytest.approx([0.05, 0.01, 0.05], rel=0.01)
    assert outliers.distance_cut(2e6, 5) == pytest.approx(outliers.distance_cut(9e5, 5), rel=1e-3)


def test_classifier_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r for r in ruleclassifier.classify(docs, labels).collect()}
    assert len(got) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    held = [(got[r.doc_id].predicted, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert sum(a == b for a, b in held) / len(held) > 0.95


def test_rules_as_columns_equal_rules_in_numpy(spark):
    rng = np.random.default_rng(1)
    x = {"a": rng.random(500), "b": rng.random(500)}
    y = ((x["a"] > 0.5) & (x["b"] <= 0.4)).astype(float)
    model = ruleclassifier.fit(x, y, trees=10)
    assert 0 < len(model.rules) < 60
    want = 1 / (1 + np.exp(-(model.intercept + sum(r.weight * r.holds(x) for r in model.rules))))
    df = spark.createDataFrame(list(zip(x["a"].tolist(), x["b"].tolist(), range(500), strict=True)), "a double, b double, k int")
    got = [r.s for r in df.select("k", model.score().alias("s")).orderBy("k").collect()]
    assert np.allclose(got, want) and ((want > 0.5) == y).mean() > 0.97


def test_classifier_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = ruleclassifier.classify(documents(spark, [(1, "x"), (2, None), (None, "")]), none).collect()
    assert [r.score for r in got] == [0.5] * 3 and [r.predicted for r in got] == [0] * 3
    one = spark.createDataFrame([(1, 1, 0), (None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    assert all(math.isclose(r.score, r.score) for r in ruleclassifier.classify(documents(spark, [(1, "x")]), one).collect())
    assert ruleclassifier.classify(documents(spark, []), none).count() == 0
