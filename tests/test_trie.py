"""Plain and merged tries, stored and walked, against all positions; coders whose counts are halved."""

import random

import pytest

from runloom.functions import codecs
from runloom.operators import strings


def brute(text, patterns):
    return sorted((i + len(p), r) for r, p in patterns for i in range(len(text)) if p and text.startswith(p, i))


@pytest.mark.parametrize("kind", strings.KINDS)
def test_walks_over_stored_tries(spark, tmp_path, kind):
    rng = random.Random(1)
    base = ["abcabcabd", "xabcabcabdy", "zabcabcabd", "qqabcabcabdq", "aaaa", "aaaab", "b", "é_abcabcabd", ""]
    pats = [(k, p) for k, p in enumerate(base + ["".join(rng.choice("abc") for _ in range(rng.randint(2, 9))) for _ in range(12)])] + [(90, "aaaa")]
    path = f"file://{tmp_path}/{kind}"
    strings.save_trie(path, spark.createDataFrame(pats, "record long, string string"), kind)
    found, trie = strings.load_trie(spark, path)
    assert found == kind and (trie._size.max() > 1) == (kind == "merged")
    texts = ["".join(rng.choice("abcdxyzqé_") for _ in range(300)) for _ in range(3)] + ["".join(p for _, p in pats), "", "aaaaaaa"]
    for t in texts:
        assert sorted(trie.search(t)) == brute(t, pats)
    distinct = {p for _, p in pats if p}
    assert trie.num_leaves() == len(distinct) and trie.strings_length() == sum(map(len, distinct))
    for p in distinct:
        at = trie.root
        for c in p:
            e = trie.find_edge(at, c)
            assert trie.edge(e)[0] == c and e in range(*trie.edge_range(at))
            at = trie.follow_edge(e, at)
        assert trie.has_leaf(at) and trie.failure_link(at) >= 0
    assert trie.find_edge(trie.root, "!") is None and trie.failure_link(trie.root) == -1
    blocks = spark.createDataFrame(list(enumerate(texts)), "block long, text string")
    assert sorted(map(tuple, strings.search_trie(blocks, path).collect())) == sorted((b, e, r) for b, t in enumerate(texts) for e, r in brute(t, pats))


def test_an_empty_trie_and_an_unknown_kind(spark, tmp_path):
    none = spark.createDataFrame([], "record long, string string")
    strings.save_trie(f"file://{tmp_path}/none", none, "merged")
    assert list(strings.load_trie(spark, f"file://{tmp_path}/none")[1].search("abc")) == []
    with pytest.raises(ValueError):
        strings.save_trie(f"file://{tmp_path}/other", none, "other")


@pytest.mark.parametrize("width", [32, 64])
@pytest.mark.parametrize("limit", [8, 300, 1 << 16])
def test_counts_are_halved(width, limit):
    rng = random.Random(2)
    symbols = [rng.choice([0, 0, 0, 0, 1, 2]) for _ in range(4000)] + [2] * 3000
    data = codecs.range_encode(symbols, 3, width, limit)
    assert codecs.range_decode(data, 3, len(symbols), width, limit) == symbols
    f = codecs.Frequencies(3, limit)
    for s in symbols:
        f.add(s)
        assert f.total == sum(f.counts) < max(limit, 12) and [f.below(k) for k in range(4)] == [sum(f.counts[:k]) for k in range(4)]


def test_counts_beyond_the_register_are_refused():
    coder = codecs.RangeEncoder(32)
    coder.range = 1 << 24
    with pytest.raises(ValueError):
        coder.encode(0, 1, (1 << 24) + 1)
