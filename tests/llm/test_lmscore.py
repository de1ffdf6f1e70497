import math
from collections import Counter

import pytest

from runloom.llm import lmscore, wordbpe
from tests.llm.rows import documents

ROWS = [(1, "the cat sat on the mat"), (2, "the dog sat on the log and the cat"), (3, "buy now cheap cheap cheap"), (4, ""), (5, None), (6, "the cat"), (6, "the cat")]


def brute(rows, target):
    coder = wordbpe.loaded(wordbpe.default_path())
    ids = [(i, coder.encode(t or "").tolist()) for i, t in rows]
    pairs = lambda x: list(zip([-1, *x], x, strict=False))

    def loss_of(k, x, chosen):
        """Under a model of all chosen rows but the k-th."""
        two = Counter(p for j, (i, y) in enumerate(ids) if chosen(i) and j != k for p in pairs(y))
        one, whole = Counter(), sum(two.values())
        total, kinds = Counter(), Counter()
        for (u, v), n in two.items():
            one[v] += n
            total[u] += n
            kinds[u] += 1

        def loss(u, v):
            p1 = (one[v] + 1) / (whole + 49408)
            return -math.log(p1) if not kinds[u] else -math.log((two[u, v] + kinds[u] * p1) / (total[u] + kinds[u]))

        return sum(loss(*p) for p in pairs(x)) / max(1, len(x))

    return sorted((i, len(x), loss_of(k, x, lambda j: j in target), loss_of(k, x, lambda j: True)) for k, (i, x) in enumerate(ids))


@pytest.mark.parametrize("most", [4_000_000, 0])
@pytest.mark.parametrize("target", [{1, 2}, set(), {99}])
def test_scores(spark, most, target):
    ids = spark.createDataFrame([(t,) for t in (*target, None)], "doc_id long")
    got = sorted((r.doc_id, r.n_tokens, r.loss_target, r.loss_background, r.score) for r in lmscore.score(documents(spark, ROWS), ids, most_broadcast=most).collect())
    for g, w in zip(got, brute(ROWS, target), strict=True):
        assert g[:2] == w[:2] and g[2] == pytest.approx(w[2]) and g[3] == pytest.approx(w[3]) and g[4] == pytest.approx(w[2] - w[3])


def test_empty(spark):
    assert lmscore.score(documents(spark, []), spark.createDataFrame([], "doc_id long")).count() == 0


def test_a_copy_is_known_and_a_sample_is_not(spark):
    """Rows alike but for their words: being in the target changes no score of its own; having a copy does."""
    rng = __import__("random").Random(3)
    words = [f"{a}{b}" for a in ("sun", "rain", "wood", "stone", "bird", "fish") for b in ("light", "fall", "land", "work", "song", "pool")]
    rows = [(k, " ".join(rng.choice(words) for _ in range(60))) for k in range(40)]
    rows += [(100, "zebra quartz violin jumps over lazy fox " * 3), (101, rows[-1][1]), (102, "zygote kilo wax mud fern lynx bulb " * 3)]
    rows.append((103, rows[-3][1]))
    got = {r.doc_id: r.score for r in lmscore.score(documents(spark, rows), spark.createDataFrame([(k,) for k in range(0, 40, 2)], "doc_id long")).collect()}
    mean = lambda ids: sum(got[k] for k in ids) / len(ids)
    assert abs(mean(range(0, 40, 2)) - mean(range(1, 40, 2))) < 0.05
    assert got[100] > got[102] + 1 and got[100] == got[103]
