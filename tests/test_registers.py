"""Arithmetic coders side by side: their codes are those of one after the other."""

import numpy as np
import pytest

from runloom.functions import codecs, registers
from runloom.operators import planning as P


def odd_texts():
    yield from (b"", b"a", b"\0", b"\xff", b"\xff" * 3000, b"\0" * 700, bytes(range(256)) * 5, bytes(range(255, -1, -1)), b"ab" * 500)
    rng = np.random.default_rng(11)
    for i in range(60):
        n, k = int(rng.integers(0, 900)), (1, 2, 3, 6, 40, 256)[i % 6]
        yield ((rng.integers(0, k, n) ** (1 + i % 2)) % 256).astype(np.uint8).tobytes()


@pytest.mark.parametrize("width", [32, 64])
def test_codes_are_those_of_the_plain_coder(monkeypatch, width):
    texts = list(odd_texts())
    want = [codecs.arith_encode(list(t), 256, width) for t in texts]
    for step, lanes in ((0, 16_384), (0, 7), (100, 16_384)):
        monkeypatch.setattr(registers, "STEP", step)
        monkeypatch.setattr(registers, "LANES", lanes)
        assert registers.encode(texts, width) == want
        assert registers.decode(want, [len(t) for t in texts], width) == texts
    assert registers.encode([], width) == registers.decode([], [], width) == []


@pytest.mark.parametrize("width", [32, 64])
def test_counts_are_halved(monkeypatch, width):
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, 9, 70_000).astype(np.uint8).tobytes(), b"x" * 140_000, (b"z" * 65_000 + bytes(range(256)) * 20), rng.integers(0, 256, 66_000).astype(np.uint8).tobytes(), b"short"]
    monkeypatch.setattr(registers, "STEP", 0)
    want = [codecs.arith_encode(list(t), 256, width) for t in texts]
    assert registers.encode(texts, width) == want
    assert registers.decode(want, [len(t) for t in texts], width) == texts


@pytest.mark.parametrize("kind", ["arith32", "arith64"])
def test_round_trip_codes_texts_together(monkeypatch, kind):
    held, alone = {}, []
    with monkeypatch.context() as m:
        m.setattr(P, "per_block", lambda blocks, columns, of: held.update(of=lambda texts: [of(t) for t in texts]))
        m.setattr(P, "per_many", lambda blocks, columns, of, most=0: held.update(of=of))
        P.coder_roundtrip(None, kind)
    for name in ("arith_encode", "arith_decode"):
        real = getattr(codecs, name)
        monkeypatch.setattr(codecs, name, lambda *a, real=real: alone.append(a) or real(*a))
    texts = ["", "a", *["é abracadabra" * 20 + str(i) for i in range(60)]]
    assert held["of"](texts) == [([t],) for t in texts]
    assert not alone
