import importlib

import __spark_entry__
import corpus_pipeline
from runloom.llm import common, packing, ruleclassifier, secrets

SF = "/root/testdata/sf0.01"


def test_stages_feed_each_other(spark):
    docs = common.table(spark, SF, "documents")
    names, texts = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id for r in docs.collect()}
        docs = common.staged(stage(spark, docs, SF), "stage")
        rows = docs.collect()
        if name == "packing":
            break
        assert docs.columns == names and len({r.doc_id for r in rows}) == len(rows)
        assert {r.doc_id for r in rows} <= before
        if name == "quality classifier":
            model = ruleclassifier.train(common.table(spark, SF, "documents"), common.table(spark, SF, "labels"))
            scored = ruleclassifier.score(common.table(spark, SF, "documents"), model)
            assert {r.doc_id for r in rows} == {r.doc_id for r in scored.where("predicted = 1").collect()}
        if name == "secret scan":
            assert {r.doc_id for r in rows} == before
            assert all(r.n_chars == len(r.text) and (r.text == texts[r.doc_id] or "<secret>" in r.text) for r in rows)
            assert secrets.scan(docs).where("n_access > 0 OR n_hex > 0").count() == 0
            last = before
    assert {r.doc_id for r in rows} == last
    direct = packing.pack(common.table(spark, SF, "documents")).count()
    assert 0 < len(rows) < direct
    labels = {r.doc_id: r.quality for r in common.table(spark, SF, "labels").collect()}
    assert not any(labels.get(i) == 0 for i in last)


def test_run_and_registration(spark):
    names = set(__spark_entry__.queries())
    assert {f"op{n}" for n in range(1, 11)} <= {n.split("_")[0] for n in names} and "pipeline" in names
    assert __spark_entry__.queries()["pipeline"](spark, SF).columns[0] == "doc_id"


def test_without_tables(spark):
    docs = common.table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = common.staged(stage(spark, docs, SF), "stage")
        assert docs.count() == 0


def test_entry_without_the_subpackage(monkeypatch):
    import sys

    monkeypatch.setitem(sys.modules, "runloom.llm.queries", None)
    monkeypatch.delattr("runloom.llm.queries", raising=False)
    own = importlib.reload(__spark_entry__)
    assert own.queries() and not any(n.startswith("op") for n in own.queries())
    monkeypatch.undo()
    importlib.reload(__spark_entry__)
