import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from runloom.functions import codecs
from runloom.functions import sequence as seq
from runloom.functions import tunnels

TEXTS = st.one_of(st.text("ab", max_size=40), st.text("abcd", max_size=40), st.builds(lambda w, n: w * n, st.text("abc", min_size=1, max_size=8), st.integers(1, 8)), st.text(max_size=20))


def edges(text: str, k: int) -> int:
    t = text + "\1"
    n, tt = len(t), t * (k // len(t) + 3)
    small, large = Counter(tt[i : i + k] for i in range(n)), Counter(tt[i : i + k + 1] for i in range(n))
    return n - sum(c - 1 for w, c in large.items() if small[w[:-1]] == c == small[w[1:]])


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_suffixes_and_inverse(text):
    x = seq.codes(text)
    sa = seq.suffix_array(x)
    assert sa.tolist() == sorted(range(len(x)), key=lambda i: x[i:].tolist())
    assert "".join(seq.letters(seq.inverse_bwt(seq.bwt(x, sa)))) == text


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_edge_counts_and_least_order(text):
    x = seq.codes(text)
    counted = seq.edge_counts(x, len(x))
    assert [e for _, _, e in counted] == [edges(text, k) for k in range(1, len(x) + 1)]
    best = (1, len(x))
    for k, _, e in counted:
        if e < best[1]:
            best = (k, e)
    assert seq.min_order(x) == best
    fused, k = tunnels.fused_index(text)
    assert (k, len(fused.symbols)) == best
    assert "".join(seq.letters(fused.invert())) == text


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_plans_fuse_and_invert(text):
    for strategy in ("none", "hirsch", "greedy", "update", "best50", "best100"):
        fused, chosen, t = tunnels.fuse(text, strategy)
        assert "".join(seq.letters(fused.invert())) == text
        assert len(fused.symbols) == len(t.last) - sum((i.height - 1) * len(i.columns) for i in chosen)


def test_plans_of_texts_without_tall_runs():
    for text in ("", "a", "abcd"):
        t = tunnels.Transform.of(text)
        assert tunnels.intervals(t) == []
        assert tunnels.plan("greedy", [], tunnels.Costs.of(t), t) == []


def test_greedy_is_the_best_prefix():
    rng = random.Random(3)
    for _ in range(50):
        text = "".join(rng.choice("ab") for _ in range(6)) * 12
        text = "".join(c if rng.random() > 0.03 else "c" for c in text)
        t = tunnels.Transform.of(text)
        found, costs = tunnels.intervals(t), tunnels.Costs.of(t)
        order = tunnels.ranked(found)
        gains = [costs.benefit(sum(i.rating for i in order[:n])) - costs.cost(n) if n else 0 for n in range(len(order) + 1)]
        n = len(tunnels.plan("greedy", found, costs, t))
        assert costs.weight == 0 or gains[n] == max(gains)
        assert len(tunnels.plan("best50", found, costs, t)) == len(order) // 2


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=80))
def test_coders_are_lossless(symbols):
    x = np.array(symbols, np.int64)
    assert seq.mtf_inverse(seq.mtf(x), seq.first_seen(x).tolist()).tolist() == symbols if symbols else True
    assert seq.rle0_inverse(seq.rle0(x)).tolist() == symbols
    assert codecs.range_decode(codecs.range_encode(symbols, 7), 7, len(symbols)) == symbols
    for width in (32, 64):
        assert codecs.arith_decode(codecs.arith_encode(symbols, 7, width), 7, len(symbols), width) == symbols
    assert codecs.mix_decode(codecs.mix_encode(symbols, 3), 3, len(symbols)) == symbols


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=120))
def test_blocks_of_any_bytes(data):
    for stage in ("bw94", "bcm"):
        coded = codecs.encode_block(data * 2, "best100", stage)
        assert codecs.decode_block(coded, stage) == data * 2


def test_damage_is_noticed():
    data = codecs.container([b"ab", b"", b"c"])
    assert codecs.blocks_of(data) == [b"ab", b"", b"c"]
    for bad in (data[:-1], data + b"x"):
        try:
            codecs.blocks_of(bad)
        except ValueError:
            continue
        raise AssertionError
