"""Every query with SQL against DuckDB over the smallest tables; the others against what their functions say."""

import math

import duckdb
import pytest
from pyspark.sql import Row

from runloom.functions import sequence as seq
from runloom.functions import tunnels
from runloom.operators import planning, strings
from runloom.plans.queries import QUERIES, SQL
from runloom.sources import texts
from runloom.sources.staging import ranked

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    same = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else v
    return sorted((tuple(map(same, r)) for r in rows), key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    other = duck.sql(SQL[name])
    assert sorted(other.columns) == cols
    assert plain(tuple(r[c] for c in cols) for r in df.collect()) == plain(other.select(*[f'"{c}"' for c in cols]).fetchall())


@pytest.mark.parametrize("name", ["plan_hirsch", "plan_greedy", "plan_greedy_update", "plan_bestp", "tunneled_bwt", "aux_runs", "bench_ratios", "bench_best"])
def test_other_queries_run(spark, name):
    assert QUERIES[name](spark, SF).columns


def test_index_rows_agree_with_the_index(spark):
    blocks = spark.createDataFrame([(1, "abab" * 10), (2, ""), (3, None)], "block long, text string")
    kept = {r.block: r["sum(inner)"] for r in planning.index_rows(blocks).groupBy("block").sum("inner").collect()}
    assert kept == {b: len(tunnels.fused_index(t)[0].symbols) for b, t in ((1, "abab" * 10), (2, ""), (3, ""))}
    assert {r.block: (r.n, r.k) for r in planning.index_stats(blocks).collect()}[1] == (41, seq.min_order(seq.codes("abab" * 10))[0])


def test_minimal_lines_against_all_pairs(spark):
    lines = ["ab", "b", "xabx", "long line with words", "line with", "a long line with words inside", "", "n\0ul", "dup", "dup", None, "é", "éa"]
    got = strings.minimal(spark.createDataFrame([(x, k) for k, x in enumerate(lines)], "line string, line_no long"))
    good = {x for x in lines if x and "\0" not in x}
    assert {(r.line, r.line_no) for r in got.collect()} == {(x, lines.index(x)) for x in good if not any(y != x and y in x for y in good)}


def test_search_both_ways(spark):
    rows = [(1, "abracadabra"), (2, ""), (3, None), (4, "cad" * 5)]
    pats = [(0, "abra"), (1, "cad"), (2, "cadabracad"), (3, ""), (4, "abra"), (5, "dcadcadcadc")]
    blocks, patterns = spark.createDataFrame(rows, "block long, text string"), spark.createDataFrame(pats, "record long, pattern string")
    want = sorted((b, i + len(p), r) for b, t in rows if t for r, p in pats if p for i in range(len(t)) if t.startswith(p, i))
    for found in (strings.search(blocks, patterns), strings.search_by_grams(blocks, patterns)):
        assert sorted(map(tuple, found.collect())) == want


def test_search_stream(spark, tmp_path):
    from runloom.streaming.search import search_chunks, search_stream

    patterns = spark.createDataFrame([(0, "abra"), (1, "cad")], "record long, pattern string")
    spark.createDataFrame([(1, "abracadabra"), (2, "xcad")], "block long, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("block long, text string").parquet(str(tmp_path / "in"))
    q = search_stream(stream, patterns).writeStream.format("memory").queryName("found").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("found").collect())) == [(1, 4, 0), (1, 7, 1), (1, 11, 0), (2, 4, 1)]
    for k, piece in enumerate(("abrac", "adab", "ra")):
        spark.createDataFrame([(1, k, piece)], "block long, seq long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "chunks"))
    stream = spark.readStream.schema("block long, seq long, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "chunks"))
    q = search_chunks(stream, patterns).writeStream.format("memory").queryName("pieces").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("pieces").collect())) == [(1, 4, 0), (1, 7, 1), (1, 11, 0)]


def test_ranks_across_partitions(spark):
    rows = [(w,) for w in ("b", "a", "c", "a", "é", "")]
    got = {r.w: r.n for r in ranked(spark.createDataFrame(rows, "w string"), "w", "n").collect()}
    assert got == {"": 0, "a": 1, "b": 2, "c": 3, "é": 4}


def test_lines_of_odd_texts(spark):
    df = spark.createDataFrame([(1, ""), (2, None), (3, "a\n"), (4, "\n\nb"), (5, "x")], "doc_id long, text string")
    got = sorted((r.doc_id, r.line_no, r.line) for r in texts.lines(df).collect())
    assert got == [(3, 0, "a"), (4, 0, ""), (4, 1, ""), (4, 2, "b"), (5, 0, "x")]
    assert Row(doc_id=1, block_id=0, start=0, length=0, block="") in texts.split_blocks(df.na.fill(""), 3).collect()
