import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from runloom.llm import components, pivots, simhash
from tests.llm.rows import documents


def groups(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


def brute_print(text):
    words = [w for w in text.encode().lower().replace(b"\n", b" ").replace(b"\t", b" ").split(b" ") if w]
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_components(spark):
    rng = np.random.default_rng(0)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(k, k + 1) for k in range(400, 440)] + [(7, 7)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(pairs + [(1, None)], "a long, b long")).collect()}
    want = groups(500, pairs)
    seen = {x for p in pairs if p[0] != p[1] for x in p}
    assert got == {x: want[x] for x in seen}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_two_within_three_bits_share_a_table():
    rng = np.random.default_rng(1)
    tables = simhash.masks(3)
    assert len(tables) == 20
    for _ in range(500):
        flips = sum(1 << int(b) for b in set(rng.integers(0, 64, 3)))
        assert any(flips & m & (1 << 64) - 1 == 0 for m in tables)


def test_links_in_crowded_keys(spark):
    """Many fingerprints in few keys, dealt over chunks, connect as all pairs do."""
    rng = np.random.default_rng(2)
    base = [int(x) for x in rng.integers(0, 1 << 62, 6)]
    prints = sorted({b ^ sum(1 << int(k) for k in rng.integers(0, 64, rng.integers(0, 4))) for b in base for _ in range(60)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    reps = spark.createDataFrame([(p, k) for k, p in enumerate(signed)], "fp long, id long")
    got = {r.id: r.component for r in components.components(simhash.links(reps, most=16)).collect()}
    want = groups(len(prints), [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3])
    assert [got.get(k, k) for k in range(len(prints))] == want


def test_near_duplicates(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{c}" for c in rng.integers(0, 5000, 300)) for _ in range(12)]
    rows = []
    for k, t in enumerate(texts):
        words = t.split()
        for j in range(4):
            own = list(words)
            if j:
                own[int(rng.integers(0, 300))] = "changed"
            rows.append((10 * k + j, " ".join(own)))
    rows += [(900, ""), (901, None), (902, "A b"), (903, "a B"), (904, texts[0]), (904, texts[0]), (905, "É x y")]
    got = {r.doc_id: r for r in simhash.near_duplicates(documents(spark, rows)).collect()}
    unique = sorted({(i, t or "") for i, t in rows})
    prints = [brute_print(t) for _, t in unique]
    want = groups(len(unique), [(i, j) for i in range(len(unique)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3])
    assert {i: (got[i].fingerprint, got[i].component_id) for i, _ in unique} == {i: (f"{p:016x}", unique[w][0]) for (i, _), p, w in zip(unique, prints, want, strict=True)}
    kept = simhash.keep(documents(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({unique[w][0] for w in want}) and kept.columns == documents(spark, []).columns
    assert simhash.near_duplicates(documents(spark, [])).count() == 0 == simhash.keep(documents(spark, [])).count()


def test_rows_without_ids(spark):
    rows = [(None, "a b c d"), (None, "a b c d"), (5, "e f g h"), (None, "e f g h"), (None, "")]
    kept = simhash.keep(documents(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == [(0, ""), (0, "a b c d"), (5, "e f g h")]
    assert len(simhash.near_duplicates(documents(spark, rows)).collect()) == 5


def test_one_id_with_unlike_texts(spark):
    """No text is lost that is like no other, whatever its id."""
    words = [f"word{k}" for k in range(200)]
    one, two = " ".join(words[:100]), " ".join(words[100:])
    kept = simhash.keep(documents(spark, [(1, one), (1, two), (1, two), (2, one), (None, two)])).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([(1, one), (1, two)])


def vectors(spark, rows):
    return spark.createDataFrame([(i, e, g, 1, "x") for i, e, g in rows], "vec_id long, embedding array<float>, label int, weight int, vec string")


def brute_links(rows, least=0.98):
    ok = [e is not None and g is not None and len(e) > 0 and all(x is not None and np.isfinite(x) for x in e) and any(e) for _, e, g in rows]
    pairs = []
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.array(rows[k][1], np.float32).astype(float) for k in (i, j))
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= least:
                    pairs.append((i, j))
    return pairs


def check(spark, rows, **more):
    pairs = brute_links(rows)
    n = np.bincount(np.array(pairs, int).ravel(), minlength=len(rows)) if pairs else np.zeros(len(rows), int)
    want = groups(len(rows), pairs)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in pivots.near_duplicates(vectors(spark, rows), **more).collect()}
    ids = [r[0] for r in rows]
    assert got == {i: (int(c), ids[w], i == ids[w]) for i, c, w in zip(ids, n, want, strict=True)}


def test_vectors(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(12):
        base = rng.normal(size=16)
        rows += [(100 * k + j, [float(x) for x in base + rng.normal(size=16) * 0.05 * (j % 5)], k % 3) for j in range(15)]
    rows += [(5000, rows[0][1], 0), (5001, None, 0), (5002, [0.0] * 16, 0), (5003, [float("nan")] * 16, 0), (5004, [None, 1.0], 1), (5005, rows[0][1], None), (5006, [1.0, 2.0], 0), (5007, [2.0, 4.0], 0), (5008, [], 1), (5009, [float("inf"), 1.0], 1)]
    check(spark, rows)
    check(spark, rows, most=8, sample=64)


def test_one_id_with_several_vectors(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [0.0, 1.0], 0), (3, [1.0, 0.01], 0), (None, [1.0, 0.0], 0), (4, [-1.0, 0.0], 0)]
    got = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in pivots.near_duplicates(vectors(spark, rows)).collect())
    assert got == [(0, 2, 1, False), (1, 1, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 2, 1, False), (4, 0, 4, True)]
    wide = spark.createDataFrame([(1, [1.0, 1e-9], 0), (2, [1.0, 2e-9], 0), (3, [1.0, 0.3], 0)], "vec_id long, embedding array<double>, label int")
    assert [(r.vec_id, r.n_links) for r in pivots.near_duplicates(wide).orderBy("vec_id").collect()] == [(1, 1), (2, 1), (3, 0)]


def near_threshold(groups, dim, seed):
    """Vectors of three labels, each followed by three at cosines of 0.98 to 0.985 with it."""
    rng, rows = np.random.default_rng(seed), []
    for k in range(groups):
        x = rng.normal(size=dim)
        x /= np.linalg.norm(x)
        rows.append((4 * k, x, k % 3))
        for j, c in enumerate((0.9802, 0.982, 0.985), 1):
            e = rng.normal(size=dim)
            e -= (e @ x) * x
            rows.append((4 * k + j, c * x + (1 - c * c) ** 0.5 * e / np.linalg.norm(e), k % 3))
    return [(i, x.astype(np.float32).tolist(), g) for i, x, g in rows]


@pytest.mark.parametrize("dim", [24, 96])
@pytest.mark.parametrize("pivots_", [128, 2048])
def test_recall_of_links_at_the_threshold(spark, dim, pivots_):
    rows = near_threshold(1000, dim, dim)
    got = pivots.near_duplicates(vectors(spark, rows), least_pivots=pivots_)
    found = got.agg(F.sum("n_links")).first()[0]
    x, g = np.array([r[1] for r in rows], float), np.array([r[2] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    total = sum(int((x[g == k] @ x[g == k].T >= 0.98).sum()) - int((g == k).sum()) for k in set(g.tolist()))
    assert total >= 6000 and 0.9 * total <= found <= total


def test_permutation_prefixes():
    base = pivots.choose(np.eye(4), 4)
    x = np.array([[0.9, 0.5, 0.3, 0.1], [0.1, 0.2, 0.3, 0.9]])
    order = pivots.describe(x, base, 3)
    assert [[int(base[p].argmax()) for p in o] for o in order] == [[0, 1, 2], [3, 2, 1]]
    assert pivots.describe(x, base, 6)[:, 4:].tolist() == [[-1, -1]] * 2
    rng = np.random.default_rng(1)
    left, right = (np.array([rng.permutation(12)[:5] for _ in range(40)], np.int32) for _ in "ab")
    for pivot in range(12):
        want = set()
        for i, a in enumerate(left.tolist()):
            for j, b in enumerate(right.tolist()):
                same = [p for p in a if p in b and abs(a.index(p) - b.index(p)) <= 2]
                if len(same) >= 2 and min(same) == pivot:
                    want.add((i, j))
        assert set(zip(*(k.tolist() for k in pivots.candidates(left, right, pivot, 2, 2)), strict=True)) == want
    assert [pivots.number_of_pivots(n, 128, 16_384) for n in (0, 1024, 10**6, 10**12)] == [128, 128, 4000, 16_384]


def test_no_vectors(spark):
    assert pivots.near_duplicates(vectors(spark, [])).count() == 0
    assert pivots.near_duplicates(vectors(spark, [(1, None, None)])).select(F.sum("n_links")).first()[0] == 0
