import zlib

import numpy as np
import pytest

from runloom.llm import ordering, wordbpe
from tests.llm.rows import documents


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 17, 100, 1000, 4097])
def test_permutation(n):
    slots = ordering.permute(np.arange(n), n, 5)
    assert sorted(slots.tolist()) == list(range(n))
    assert ordering.permute(slots, n, 5, back=True).tolist() == list(range(n))
    assert n < 100 or slots.tolist() != ordering.permute(np.arange(n), n, 6).tolist()


def test_shards_hold_every_token_once(spark, tmp_path):
    rows = [(i, "some words to write " * (i * 7 % 50)) for i in range(80)] + [(80, None), (81, "")]
    out = f"file://{tmp_path}/shards"
    got = sorted(ordering.materialise(documents(spark, rows).repartition(3), out, length=64, per_shard=10).collect())
    assert [r.slot for r in got] == list(range(len(got)))
    assert sorted(r.sequence for r in got) == list(range(len(got)))
    read = list(ordering.read(out))
    for r, ids in zip(got, read, strict=True):
        assert (r.shard, r.byte_offset) == (r.slot // 10, r.slot % 10 * 128)
        assert zlib.crc32(ids[: r.n_tokens].tobytes()) == r.crc32 and not ids[r.n_tokens :].any()
    coder = wordbpe.loaded(wordbpe.default_path())
    every = np.concatenate([ids[: r.n_tokens] for r, ids in zip(got, read, strict=True)])
    want = np.concatenate([np.append(coder.encode(t or ""), 49407) for _, t in rows])
    assert np.bincount(every, minlength=49408).tolist() == np.bincount(want, minlength=49408).tolist()
    assert [x.tolist() for x in ordering.read(out, 13, 9)] == [x.tolist() for x in read[13:22]]


def test_empty(spark, tmp_path):
    out = f"file://{tmp_path}/none"
    assert ordering.materialise(documents(spark, []), out).count() == 0
    assert list(ordering.read(out)) == []
