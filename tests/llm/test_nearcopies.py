import corpus_pipeline
import numpy as np

from runloom.llm import nearcopies, simhash
from tests.llm.rows import documents
from tests.llm.test_near import groups


def brute_set(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def edited(rng, words, edits):
    own = list(words)
    for at in rng.choice(len(own), edits, replace=False):
        own[int(at)] = f"x{int(rng.integers(0, 1 << 30))}"
    return " ".join(own)


def check(spark, rows, **more):
    """The pipeline's stage against all pairs; unique ids."""
    sets = [brute_set(t) for _, t in rows]
    want = groups(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8])
    least = {}
    for k, w in enumerate(want):
        least[w] = min(least.get(w, rows[k][0]), rows[k][0])
    docs = documents(spark, rows)
    kept = nearcopies.keep(docs, **more) if more else corpus_pipeline.near_duplicates(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(least.values()) and kept.columns == docs.columns


def test_all_pairs_at_the_similarity_are_found(spark):
    rng = np.random.default_rng(0)
    rows = []
    for k in range(40):
        words = [f"w{c}" for c in rng.integers(0, 5000, int(rng.integers(60, 400)))]
        rows += [(10 * k + j, edited(rng, words, j * len(words) // 100)) for j in range(4)]
    far = sum(1 for i, j in ((i, i - 1) for i in range(len(rows)) if i % 4) if jaccard(brute_set(rows[i][1]), brute_set(rows[j][1])) >= 0.8 and (simhash.fingerprint(rows[i][1].encode()) ^ simhash.fingerprint(rows[j][1].encode())).bit_count() > 3)
    assert far > 20
    rows += [(900, ""), (901, None), (902, "A b"), (903, "a B"), (904, rows[0][1])]
    check(spark, rows)


def test_crowded_keys(spark):
    """A large group of near copies, dealt over chunks."""
    rng = np.random.default_rng(1)
    words = [f"w{c}" for c in rng.integers(0, 5000, 100)]
    check(spark, [(k, edited(rng, words, 1 + k % 4)) for k in range(80)] + [(500, "another text that stays whatever else is here")], most=8)


def test_repeated_and_missing_ids(spark):
    rows = [(1, "a b c d e f g"), (1, "p q r s t u v"), (1, "a b c d e f g"), (2, "p q r s t u v"), (None, "a b c d e f g"), (None, "k l m"), (None, "k l m")]
    kept = nearcopies.keep(documents(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == [(0, "k l m"), (1, "a b c d e f g"), (1, "p q r s t u v")]
    assert nearcopies.keep(documents(spark, [])).count() == 0
