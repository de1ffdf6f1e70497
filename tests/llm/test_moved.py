"""What the pipeline's near-duplicate stage moves between tasks."""

import corpus_pipeline
import numpy as np

from runloom.llm import nearcopies
from tests.llm.rows import documents
from tests.llm.test_nearcopies import edited


def moved(spark):
    """Bytes that all tasks so far wrote for shuffles."""
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_texts_are_moved_a_few_times_only(spark):
    """All texts once, when what stays is chosen, and those that meet a few times more."""
    rng = np.random.default_rng(3)
    rows = []
    for k in range(300):
        words = [rng.bytes(6).hex() for _ in range(400)]
        rows += [(2 * k, " ".join(words))] + [(2 * k + 1, edited(rng, words, 4))] * (k % 5 == 0)
    docs = documents(spark, rows)
    before = moved(spark)
    assert len(corpus_pipeline.near_duplicates(spark, docs, "").collect()) == 300
    share = (moved(spark) - before) / sum(len(t) for _, t in rows)
    print("moved", share)
    assert share < 3


def test_keys_with_the_same_texts_meet_once(spark):
    keyed = spark.createDataFrame([(v, t, k) for t, k, vs in [(0, 5, (1, 2)), (1, 5, (1, 2)), (2, 7, (1, 2, 3)), (3, 7, (2, 3)), (4, 1, (4,))] for v in vs], "v long, t int, k long")
    assert sorted(map(tuple, nearcopies.shared(keyed).collect())) == [(0, 5, 1), (0, 5, 2), (2, 7, 1), (2, 7, 2), (2, 7, 3), (3, 7, 2), (3, 7, 3)]


def test_texts_that_meet_are_found_either_way(spark):
    texts = spark.createDataFrame([(v, f"t{v}") for v in (1, 2, 2, 3, 4)], "v long, text string")
    met = spark.createDataFrame([(0, 0, v) for v in (1, 2, 2)], "t int, k long, v long")
    for most in (0, 10):
        assert sorted(map(tuple, nearcopies.meeting(texts, met, most).collect())) == [(1, "t1"), (2, "t2")]
