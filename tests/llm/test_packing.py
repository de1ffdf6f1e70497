import random
import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from runloom.llm import packing, wordbpe
from tests.llm.rows import documents


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=40), st.integers(1, 8))
def test_differencing_deals_every_item_once(sizes, k):
    slots = packing.difference(sizes, k)
    assert len(slots) == k and sorted(i for s in slots for i in s) == list(range(len(sizes)))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=40))
def test_windows_hold_what_they_can(sizes):
    slots = packing.pack_group(sizes, 60)
    assert sorted(i for s in slots for i in s) == list(range(len(sizes)))
    assert all(0 < sum(sizes[i] for i in s) <= 60 for s in slots)


def test_windows_are_near_equal():
    rng = random.Random(5)
    sizes = [rng.randint(1, 500) for _ in range(400)]
    sums = [sum(sizes[i] for i in s) for s in packing.difference(sizes, 40)]
    assert max(sums) - min(sums) <= 20


def test_known_partition():
    sums = sorted(sum([8, 7, 6, 5, 4][i] for i in s) for s in packing.difference([8, 7, 6, 5, 4], 2))
    assert sums == [14, 16]


def test_pieces_cover_documents(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["the", "of", "and", "window"]) for _ in range(rng.choice([0, 3, 200, 3000])))) for i in range(60)] + [(60, None), (61, "")]
    coder = wordbpe.loaded(wordbpe.default_path())
    got = packing.pack(documents(spark, rows)).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, t in rows:
        ids = np.append(coder.encode(t or ""), 1).astype("<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes())) and r.length > 0
            at += r.length
        assert at == len(ids)
    for rows_ in by_sequence.values():
        at = 0
        for r in sorted(rows_, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert packing.pack(documents(spark, [])).count() == 0
    assert {r.doc_id for r in packing.pack(documents(spark, [(None, "a"), (None, "a")])).collect()} == {None}
