"""Short blocks coded side by side: their bytes are those of one after the other."""

import numpy as np
import pytest

from runloom.functions import codecs, pieces
from runloom.operators import planning as P


def odd_pieces():
    yield from (b"", b"a", b"\0", b"\xff", b"\xff\0" * 50, bytes(range(pieces.LONGEST)), bytes(range(255, 135, -1)), b"a" * pieces.LONGEST, b"ab" * 50)
    rng = np.random.default_rng(7)
    for i in range(400):
        n, k = int(rng.integers(0, pieces.LONGEST + 1)), (1, 2, 3, 6, 40, 256)[i % 6]
        part = rng.integers(0, k, int(rng.integers(1, 25)) if i % 5 < 3 else pieces.LONGEST).astype(np.uint8).tobytes()
        data = bytearray((part * pieces.LONGEST)[:n])
        for at in rng.integers(0, n, i % 4) if n else ():
            data[at] = int(rng.integers(0, k))
        yield bytes(data)


def test_bytes_are_those_of_encode_block(monkeypatch):
    whole = list(odd_pieces())
    want = [codecs.encode_block(p) for p in whole]
    for lanes in (4096, 50, 1):
        monkeypatch.setattr(pieces, "LANES", lanes)
        assert pieces.encode(whole) == want
        assert pieces.decode(want) == whole
    assert pieces.encode([]) == pieces.decode([]) == []


def test_damaged_and_long_blocks_are_rejected():
    good = [codecs.encode_block(p) for p in (b"abracadabra" * 9, b"a" * 100, b"")]
    for block in good:
        for bad in (block[:-1], block + b"\0", block[:11], b""):
            with pytest.raises(ValueError):
                pieces.decode([*good, bad])
        for at in range(len(block)):
            bad = block[:at] + bytes([block[at] ^ 255]) + block[at + 1 :]
            try:
                back = pieces.decode([*good, bad, *good])
            except ValueError:
                continue
            assert back[:3] == back[4:] == [b"abracadabra" * 9, b"a" * 100, b""]
    long = b"x" * (pieces.LONGEST + 1)
    with pytest.raises(ValueError):
        pieces.encode([long])
    with pytest.raises(ValueError):
        pieces.decode([codecs.encode_block(long)])


def test_container_codes_pieces_of_all_texts_together(monkeypatch):
    held, alone, sizes = {}, [], []
    with monkeypatch.context() as m:
        m.setattr(P, "per_block", lambda blocks, columns, of: held.update(of=lambda texts: [of(t) for t in texts]))
        m.setattr(P, "per_many", lambda blocks, columns, of, most=0: held.update(of=of))
        P.coder_roundtrip(None, "container")
    encode_block, container = codecs.encode_block, codecs.container
    monkeypatch.setattr(codecs, "encode_block", lambda data, *a: alone.append(data) or encode_block(data, *a))
    monkeypatch.setattr(codecs, "container", lambda blocks: sizes.append(len(blocks)) or container(blocks))
    texts = ["", "a", "é" * 333, "abracadabra" * 40, "the same long line of a text, é again\n" * 12]
    assert held["of"](texts) == [([t],) for t in texts]
    assert sizes == [-(-len(t.encode()) // 100) for t in texts]
    assert not alone
