"""The reports over results take every method of the reference's benchmark into account."""

import pytest

from runloom.functions import codecs
from runloom.operators import planning as P
from runloom.plans.queries import QUERIES

TEXTS = {1: "abracadabra" * 40, 2: "a" * 500, 3: "", 4: "ab", 5: "the same long line of a text, é again\n" * 12 + "but not here", 6: "ccaabbab" * 3 + "bca" * 20}
METHODS = [(s, g) for s in ("none", "hirsch", "greedy", "update") for g in ("bw94", "bcm")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("documents"))
    spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return path


def sizes(text):
    data = text.encode()
    return {f"{s}-{g}": len(codecs.encode_block(data, s, g)) for s, g in METHODS} | {"xz": len(P.xz_best(data))}


def test_ratios_and_best_are_over_all_methods(spark, folder):
    want = {i: sizes(t) for i, t in TEXTS.items()}
    got = {(r.block, r.method): r.bps for r in QUERIES["bench_ratios"](spark, folder).collect()}
    assert got == {(i, m): n * 8 * 1000 // max(1, len(TEXTS[i].encode())) / 1000 for i, of in want.items() for m, n in of.items()}
    best = {r.block: (r.best, r.coded) for r in QUERIES["bench_best"](spark, folder).collect()}
    assert best == {i: (max(m for m in of if of[m] == min(of.values())), min(of.values())) for i, of in want.items()}
