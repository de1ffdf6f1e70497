"""Queries without SQL over a small folder of documents: long, skewed and repetitive texts."""

from collections import Counter

import numpy as np
import pytest

import __spark_entry__
from runloom.plans.queries import QUERIES

TEXTS = {1: "abracadabra" * 40, 2: "a" * 500, 3: "", 4: "ab", 5: "".join(chr(97 + int(c)) for c in np.random.default_rng(0).integers(0, 3, 600)), 6: "the same long line of a text, é again\n" * 12 + "but not here"}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("documents"))
    spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return path


def spectrum(text):
    """{k: edges} by counting the windows of the cyclic text."""
    t = text + chr(1)
    n, out = len(t), {}
    count = lambda k: Counter((t * (2 + k // n))[i : i + k] for i in range(n))
    for k in range(1, min(100, n) + 1):
        of, wide = count(k), count(k + 1)
        out[k] = sum(1 if of[m[:-1]] == c == of[m[1:]] else c for m, c in wide.items())
    return out


def test_orders_up_to_100(spark, folder):
    got, want = {}, {i: spectrum(t) for i, t in TEXTS.items() if t}
    for r in QUERIES["edge_spectrum"](spark, folder).collect():
        got.setdefault(r.block, {})[r.k] = r.edges
    assert {i: got[i] for i in want} == want and max(want[1]) == 100
    info = {(r.block, r.k): (r.edges, r.fewest, r.most) for r in QUERIES["edge_info"](spark, folder).collect()}
    share = {(r.block, r.k): r.share for r in QUERIES["edge_matrix"](spark, folder).collect()}
    for i, edges in want.items():
        low, high = min(edges.values()), max(edges.values())
        for k, e in edges.items():
            assert info[i, k] == (e, low, high)
            assert share[i, k] == pytest.approx((e - low) / (high - low) if high > low else 0, abs=1e-6)


def test_entry_has_no_cap_on_the_order(spark):
    got = {r.block: (r.k, r.edges) for r in __spark_entry__.entry(spark).collect()}
    assert max(k for k, _ in got.values()) > 8


ROUND_TRIPS = ["tfm_invert", "twobit_roundtrip", "zipped_index_roundtrip", "inverse_tunneled_bwt", "range_roundtrip", "arith_roundtrip", "arith64_roundtrip", "codec_bw94", "codec_bcm", "codec_roundtrip"]


@pytest.mark.parametrize("name", ROUND_TRIPS)
def test_round_trips_over_documents(spark, folder, name):
    got = {r.block: r.text for r in QUERIES[f"{name}_documents"](spark, folder).select("block", "text").collect()}
    assert got == TEXTS


@pytest.mark.parametrize("name", ["tunneled_bwt", "aux_runs", "codec_block_sizes", "bench_ratios", "bench_best", "codec_validate_documents"])
def test_reports_read_documents(spark, folder, name):
    got = {r.block for r in QUERIES[name](spark, folder).select("block").collect()}
    assert {i for i, t in TEXTS.items() if len(t) > 10} <= got <= set(TEXTS)
