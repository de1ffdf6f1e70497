"""Statistics of symbols, lines and runs: DataFrame operators partitioned by text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import texts

BEFORE = (Window.unboundedPreceding, -1)
UPTO = (Window.unboundedPreceding, 0)


def hi(x):
    """Floor of the binary logarithm of a positive integer column."""
    return (F.length(F.bin(x)) - 1).cast("long")


def symbols(blocks: DataFrame) -> DataFrame:
    """(block, pos, sym) of every code point, from 0; nothing for empty texts."""
    return blocks.select("block", F.posexplode(F.split("text", "")).alias("pos", "sym")).where("sym <> ''").withColumn("pos", F.col("pos").cast("long"))


def histogram(blocks: DataFrame) -> DataFrame:
    return symbols(blocks).groupBy("block", "sym").agg(F.count("*").alias("cnt"))


def c_array(blocks: DataFrame) -> DataFrame:
    """(block, sym, cnt, smaller): occurrences, and those of smaller symbols."""
    w = Window.partitionBy("block").orderBy("sym").rowsBetween(*BEFORE)
    return histogram(blocks).withColumn("smaller", F.coalesce(F.sum("cnt").over(w), F.lit(0)))


def alphabet(blocks: DataFrame) -> DataFrame:
    """(block, sym, comp): a dense code of the symbols, in order."""
    return histogram(blocks).select("block", "sym", (F.row_number().over(Window.partitionBy("block").orderBy("sym")) - 1).cast("long").alias("comp"))


def first_appearance(blocks: DataFrame) -> DataFrame:
    """(block, sym, place) by first appearance."""
    first = symbols(blocks).groupBy("block", "sym").agg(F.min("pos").alias("pos"))
    return first.select("block", "sym", (F.row_number().over(Window.partitionBy("block").orderBy("pos")) - 1).cast("long").alias("place"))


def file_stats(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, sigma, newlines, size): distinct bytes, line feeds plus one, bytes."""
    text = F.coalesce("text", F.lit(""))
    sigma = F.size(F.array_distinct(F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit(".."), F.lit(0))))
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return docs.select("doc_id", "lang", "source", sigma.cast("long").alias("sigma"), lines.cast("long").alias("newlines"), F.octet_length(text).cast("long").alias("size"))


def runs(rows: DataFrame) -> DataFrame:
    """(block, run_id, sym, start, height, lf_start) of a transform (block, row, sym): maximal runs of equal symbols."""
    w = Window.partitionBy("block").orderBy("row")
    new = F.coalesce((F.lag("sym").over(w) != F.col("sym")).cast("int"), F.lit(1))
    marked = lf(rows).withColumn("new", new).withColumn("run_id", F.sum("new").over(w.rowsBetween(*UPTO)) - 1)
    return marked.groupBy("block", "run_id", "sym").agg(F.min("row").alias("start"), F.count("*").alias("height"), F.min("lf").alias("lf_start"))


def lf(rows: DataFrame) -> DataFrame:
    """rows with lf: the row of the preceding position."""
    rank = F.row_number().over(Window.partitionBy("block").orderBy("sym", "row")) - 1
    return rows.withColumn("lf", rank.cast("long"))


def run_of(rows: DataFrame) -> DataFrame:
    """(block, row, run_id, start): the run that holds each row, by the last start at or before it."""
    w = Window.partitionBy("block").orderBy("row")
    start = F.when(F.coalesce(F.lag("sym").over(w) != F.col("sym"), F.lit(True)), F.col("row"))
    marked = rows.withColumn("s", start)
    return marked.select("block", "row", (F.count("s").over(w.rowsBetween(*UPTO)) - 1).alias("run_id"), F.last("s", True).over(w.rowsBetween(*UPTO)).alias("start"))


def rle(rows: DataFrame) -> DataFrame:
    """(block, runs, n_rle, rc, tall): runs with the sentinel's, characters of the run-length code without it (its
    neighbours join), length characters, runs of more than one row."""
    table = runs(rows)
    whole = table.groupBy("block").agg(F.count("*").alias("runs"), F.count_if(F.col("height") > 1).alias("tall"))
    plain = rows.where(F.col("sym") != texts.SENTINEL)
    code = runs(plain).groupBy("block").agg(F.sum(hi(F.col("height")) + 1).alias("n_rle"))
    return whole.join(code, "block", "left").select("block", "runs", F.coalesce("n_rle", F.lit(0)).alias("n_rle"), (F.coalesce("n_rle", F.lit(0)) - F.col("runs")).alias("rc"), "tall")


def rle0_length(ranks: DataFrame) -> DataFrame:
    """(block, symbols): length of the zero-run code of ranks (block, pos, rank), without making it."""
    w = Window.partitionBy("block").orderBy("pos")
    group = F.sum((F.col("rank") > 0).cast("int")).over(w.rowsBetween(*UPTO))
    parts = ranks.withColumn("g", group).groupBy("block", "g").agg(F.count_if(F.col("rank") == 0).alias("z"), F.count_if(F.col("rank") > 0).alias("other"))
    return parts.groupBy("block").agg(F.sum(F.when(F.col("z") > 0, hi(F.col("z") + 1)).otherwise(0) + F.col("other")).alias("symbols"))


def code_length(symbols_: DataFrame) -> DataFrame:
    """(block, bits) of an adaptive order-0 code of (block, pos, symbol): every symbol costs the logarithm of how often
    it and all were seen before, counts starting at one, over an alphabet of the block's symbols and one more."""
    seen = Window.partitionBy("block", "symbol").orderBy("pos").rowsBetween(*BEFORE)
    every = Window.partitionBy("block")
    kinds = symbols_.groupBy("block").agg(F.countDistinct("symbol").alias("kinds"))
    rows = symbols_.join(kinds, "block").withColumn("own", F.count("*").over(seen) + 1)
    rows = rows.withColumn("all", F.row_number().over(every.orderBy("pos")) - 1 + F.col("kinds") + 1)
    return rows.groupBy("block").agg(F.round(F.sum(F.log2(F.col("all") / F.col("own"))), 4).alias("bits"))


def rank_select(rows: DataFrame, sym: str) -> DataFrame:
    """(block, row, bit, rank1, select1): whether a row has the symbol, ones before it, and its number among them."""
    w = Window.partitionBy("block").orderBy("row")
    bit = (F.col("sym") == sym).cast("long")
    out = rows.withColumn("bit", bit).withColumn("rank1", F.coalesce(F.sum("bit").over(w.rowsBetween(*BEFORE)), F.lit(0)))
    return out.select("block", "row", "bit", "rank1", F.when(F.col("bit") == 1, F.col("rank1") + 1).alias("select1"))
