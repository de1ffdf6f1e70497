"""Compression of files as a DataFrame operator: a method line, then a container of blocks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs
from ..functions import sequence as seq
from .planning import STAGES, STRATEGIES


def _mapped(df: DataFrame, column: str, out: str, of) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [None if c is None else of(c) for c in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cells, pa.binary())], ["file", out])

    return df.select("file", column).mapInArrow(run, f"file string, {out} binary")


def compress(files: DataFrame, strategy: str = "hirsch", stage: str = "bw94", block_size: int = 65_536) -> DataFrame:
    """(file, coded) of files (file, data).  Null data stays null; empty data has no block."""
    if strategy not in STRATEGIES and not strategy.startswith("best"):
        raise ValueError(f"no strategy {strategy}")
    if stage not in STAGES:
        raise ValueError(f"no stage {stage}")
    if block_size < 1:
        raise ValueError("blocks have at least one byte")
    head = f"{strategy}|{stage}\n".encode()

    def of(data: bytes) -> bytes:
        return head + codecs.container([codecs.encode_block(data[i : i + block_size], strategy, stage) for i in range(0, len(data), block_size)])

    return _mapped(files.select("file", "data"), "data", "coded", of)


def decompress(files: DataFrame) -> DataFrame:
    """(file, data) of files (file, coded), whatever they were made with; damaged ones raise ValueError."""

    def of(coded: bytes) -> bytes:
        head, _, body = coded.partition(b"\n")
        _, _, stage = head.decode("ascii", "replace").partition("|")
        if stage not in STAGES:
            raise ValueError("not a compressed file: unknown method line")
        return b"".join(codecs.decode_block(b, stage) for b in codecs.blocks_of(body))

    return _mapped(files.select("file", "coded"), "coded", "data", of)


def register(spark: SparkSession) -> None:
    """For SQL: coded_size(text, strategy, stage), in bytes; and least_order(text), the order with the fewest edges."""

    @F.pandas_udf("long")
    def coded_size(text: pd.Series, strategy: pd.Series, stage: pd.Series) -> pd.Series:
        return pd.Series([len(codecs.encode_block((t or "").encode(), s, g)) for t, s, g in zip(text, strategy, stage, strict=True)])

    @F.pandas_udf("long")
    def least_order(text: pd.Series) -> pd.Series:
        return pd.Series([seq.min_order(seq.codes(t or ""))[0] for t in text])

    spark.udf.register("coded_size", coded_size)
    spark.udf.register("least_order", least_order)
