"""Texts as rows: whole texts, blocks of them, lines, and filtered forms.  A text is a block; its id is the block's key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SENTINEL = chr(1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, size) of whole files."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("content").alias("bytes"), F.col("length").alias("size"))


def blocks_of(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(block, text): what the block operators take; null texts are empty."""
    return df.select(F.col(key).cast("long").alias("block"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def with_sentinel(text: Column) -> Column:
    """Without NUL, and one unique least symbol at the end."""
    return F.concat(F.regexp_replace(text, r"\x00", ""), F.lit(SENTINEL))


def lines(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, line_no, line): a final newline ends the last line and begins none; an empty text has no line."""
    parts = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    held = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return docs.select(key, F.posexplode(held).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("long"))


def split_blocks(docs: DataFrame, size: int, key: str = "doc_id") -> DataFrame:
    """(key, block_id, start, length, block): consecutive pieces of ``size`` characters, the last one shorter."""
    n = F.length("text")
    many = docs.select(key, "text", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(n / size) - 1, F.lit(0)).cast("int"))).alias("block_id"))
    piece = F.substring("text", F.col("block_id") * size + 1, F.lit(size))
    return many.select(key, F.col("block_id").cast("long").alias("block_id"), (F.col("block_id") * size).cast("long").alias("start"), F.length(piece).cast("long").alias("length"), piece.alias("block"))
