"""How much work the block functions do, and that results stay what they were."""

import lzma
from collections import Counter

import numpy as np
import pytest

from runloom.functions import codecs
from runloom.functions import sequence as seq
from runloom.functions import tunnels
from runloom.operators import planning as P

TEXTS = ["", "a", "abracadabra" * 30, "the same long line, é\n" * 9, "".join(chr(97 + int(c)) for c in np.random.default_rng(1).integers(0, 3, 700))]


def block_function(monkeypatch, make):
    """What an operator runs on each text."""
    held = {}
    with monkeypatch.context() as m:
        m.setattr(P, "per_block", lambda blocks, columns, of: held.update(of=of))
        m.setattr(P, "per_many", lambda blocks, columns, of: held.update(of=lambda text: of([text])[0]), raising=False)
        make()
    return held["of"]


@pytest.mark.parametrize("make", [lambda: P.fused_stats(None), lambda: P.codec_sizes(None, ("none", "greedy"), ("bw94",))])
def test_one_transform_for_all_strategies(monkeypatch, make):
    of, made = block_function(monkeypatch, make), []
    real = tunnels.Transform.of.__func__
    monkeypatch.setattr(tunnels.Transform, "of", classmethod(lambda cls, text: made.append(text) or real(cls, text)))
    for n, text in enumerate(TEXTS, 1):
        of(text)
        assert len(made) == n


def test_fused_stats_are_those_of_each_strategy(monkeypatch):
    of = block_function(monkeypatch, lambda: P.fused_stats(None))
    for text in TEXTS:
        for s, n, symbols, removed, benefit, cost in zip(*of(text), strict=True):
            f, chosen, t = tunnels.fuse(text, s)
            c = tunnels.Costs.of(t)
            assert (n, symbols, removed) == (len(chosen), len(f.symbols), c.rle - tunnels.rle_length(f.symbols))
            assert (benefit, cost) == (c.benefit(removed), round(c.cost(len(chosen)), 6))


def test_small_xz_dictionary_gives_the_same_size():
    for text in TEXTS:
        data = text.encode()
        assert len(P.xz_best(data)) == len(lzma.compress(data, preset=9 | lzma.PRESET_EXTREME))
        assert lzma.decompress(P.xz_best(data)) == data


@pytest.mark.parametrize("text", TEXTS)
def test_orders_sort_the_text_once(monkeypatch, text):
    sorts = []
    for name in ("unique", "argsort"):
        real = getattr(np, name)
        monkeypatch.setattr(np, name, lambda x, *a, real=real, **b: sorts.append(len(x)) or real(x, *a, **b))
    x = seq.codes(text)
    assert len(seq.edge_counts(x, 100)) == min(100, len(x))
    assert sum(sorts) <= len(x) * 12
    t = text + chr(1)
    for k, nodes, edges in seq.edge_counts(x, 100)[::7]:
        small, large = (Counter((t * (k // len(t) + 3))[i : i + w] for i in range(len(t))) for w in (k, k + 1))
        assert (nodes, edges) == (len(small), sum(1 if small[w[:-1]] == c == small[w[1:]] else c for w, c in large.items()))


def test_bounds_of_k_mers():
    for text in TEXTS:
        x = seq.codes(text)
        sa = seq.suffix_array(x)
        last = seq.bwt(x, sa)
        for k in {1, min(3, len(x)), min(40, len(x))}:
            bound, inner, outer = tunnels.kmer_bits(x, sa, last, k)
            wrapped = np.concatenate([x] * (2 + k // len(x)))
            mers = [tuple(wrapped[i : i + k]) for i in sa]
            assert bound.tolist() == [int(not i or mers[i] != mers[i - 1]) for i in range(len(x))]
            assert "".join(seq.letters(tunnels.Fused.of(last, inner, outer).invert())) == text


def test_mixing_coders_side_by_side_are_the_plain_one(monkeypatch):
    rng = np.random.default_rng(5)
    for few in (2, 20):
        monkeypatch.setattr(codecs, "FEW", few)
        jobs = [(np.minimum(rng.geometric(0.2, n), (1 << w) - 1), w) for w in (1, 2, 6, 8) for n in (0, 1, 90, 40, 200, *range(30))]
        coded = codecs.mix_many(jobs)
        assert coded == [codecs.mix_encode(x.tolist(), w) for x, w in jobs]
        assert codecs.mix_many([(c, w, len(x)) for c, (x, w) in zip(coded, jobs, strict=True)], decode=True) == [x.tolist() for x, _ in jobs]


def test_many_blocks_at_once_are_those_of_each():
    for strategy in ("none", "best100"):
        fused = [tunnels.fuse(t.encode().decode("latin-1"), strategy)[0] for t in TEXTS * 6]
        coded = codecs.encode_mixed(fused)
        assert coded == [codecs.encode_fused(f, "bcm") for f in fused]
        for f, g in zip(fused, codecs.decode_mixed(coded), strict=True):
            assert (f.symbols.tolist(), f.outer.tolist(), f.inner.tolist()) == (g.symbols.tolist(), g.outer.tolist(), g.inner.tolist())
    with pytest.raises(ValueError):
        codecs.decode_mixed([coded[0][:-1]])


def test_intervals_of_are_those_of_frequencies():
    rng = np.random.default_rng(3)
    for sigma, limit in ((1, 64), (7, 64), (200, 1 << 16), (40, 1000)):
        for n in (0, 1, 63, 64, 65, 9000):
            x, f, want = np.minimum(rng.geometric(0.1, n) - 1, sigma - 1), codecs.Frequencies(sigma, limit), []
            for s in x.tolist():
                want.append((f.below(s), f.counts[s], f.total))
                f.add(s)
            assert list(codecs.intervals_of(x, sigma, limit)) == want
            assert codecs.range_decode(codecs.range_encode(x.tolist(), sigma, 64, limit), sigma, n, 64, limit) == x.tolist()
