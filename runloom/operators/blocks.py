"""Operators that need one whole text at a time: Arrow batches in, rows out, no shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import sequence as seq


def per_block(blocks: DataFrame, columns: str, of: Callable[[str], tuple | None]) -> DataFrame:
    """(block, columns) for blocks (block, text): ``of`` gives one sequence for each column, all of one length.

    Long texts come a few at a time; a text's rows leave before the next is read."""
    schema = T.StructType.fromDDL(f"block long, {columns}")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, rows = [], 0
            for block, text in zip(batch.column(0), batch.column(1), strict=True):
                cols = of(text.as_py() or "")
                if cols is None or not len(cols[0]):
                    continue
                arrays = [pa.array(c, f.type) for c, f in zip(cols, list(arrow)[1:], strict=True)]
                held.append(pa.RecordBatch.from_arrays([pa.repeat(block, len(cols[0])), *arrays], schema=arrow))
                rows += len(cols[0])
                if rows > 50_000:
                    yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                    held, rows = [], 0
            if held:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return spread(blocks.select("block", "text")).mapInArrow(run, schema)


def per_many(blocks: DataFrame, columns: str, of: Callable[[list[str]], list[tuple]], most: int = 8_000_000) -> DataFrame:
    """per_block for what works on many texts side by side: ``of`` gets some at a time, of about ``most`` symbols."""
    schema = T.StructType.fromDDL(f"block long, {columns}")
    arrow = to_arrow_schema(schema)

    def rows(keys: list, texts: list[str]) -> pa.RecordBatch:
        held = [(k, *row) for k, cols in zip(keys, of(texts), strict=True) for row in zip(*cols, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], f.type) for i, f in enumerate(arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, texts, size = [], [], 0
        for batch in batches:
            for block, text in zip(batch.column(0), batch.column(1), strict=True):
                keys.append(block.as_py())
                texts.append(text.as_py() or "")
                size += len(texts[-1])
                if size > most:
                    yield rows(keys, texts)
                    keys, texts, size = [], [], 0
        if keys:
            yield rows(keys, texts)

    return spread(blocks.select("block", "text")).mapInArrow(run, schema)


def spread(blocks: DataFrame) -> DataFrame:
    """blocks over all cores if their input has fewer partitions than these, as one small file has; else as they are."""
    cores = blocks.sparkSession.sparkContext.defaultParallelism
    return blocks.repartition(cores, "block") if blocks.rdd.getNumPartitions() < cores else blocks


def suffix_array(blocks: DataFrame) -> DataFrame:
    """(block, row, sa): suffixes of the text and its sentinel, in order; both count from 0."""

    def of(text: str):
        sa = seq.suffix_array(seq.codes(text))
        return range(len(sa)), sa

    return per_block(blocks, "row long, sa long", of)


def bwt(blocks: DataFrame) -> DataFrame:
    """(block, row, sym, sa): the symbol before each suffix; the sentinel is chr(1)."""

    def of(text: str):
        x = seq.codes(text)
        sa = seq.suffix_array(x)
        return range(len(sa)), seq.letters(seq.bwt(x, sa)), sa

    return per_block(blocks, "row long, sym string, sa long", of)


def edge_spectrum(blocks: DataFrame, most: int) -> DataFrame:
    """(block, k, nodes, edges) for orders 1 to ``most``, at least 1, and at most the text's length with its sentinel."""
    if most < 1:
        raise ValueError("the order must be at least 1")

    def of(text: str):
        return tuple(zip(*seq.edge_counts(seq.codes(text), most), strict=True))

    return per_block(blocks, "k long, nodes long, edges long", of)


def min_dbg(blocks: DataFrame, most: int | None = None) -> DataFrame:
    """(block, k, edges): the order with the fewest edges."""

    def of(text: str):
        k, edges = seq.min_order(seq.codes(text), most)
        return [k], [edges]

    return per_block(blocks, "k long, edges long", of)


def inverse_bwt(blocks: DataFrame) -> DataFrame:
    """(block, text): transformed and inverted again."""

    def of(text: str):
        x = seq.codes(text)
        back = seq.inverse_bwt(seq.bwt(x, seq.suffix_array(x)))
        return (["".join(seq.letters(back))],)

    return per_block(blocks, "text string", of)


def mtf(blocks: DataFrame) -> DataFrame:
    """(block, pos, sym, rank) over the text itself."""

    def of(text: str):
        x = seq.codes(text)[:-1]
        return range(len(x)), seq.letters(x), seq.mtf(x)

    return per_block(blocks, "pos long, sym string, rank long", of)


def rle0(blocks: DataFrame) -> DataFrame:
    """(block, pos, symbol) of the zero-run code of the move-to-front ranks."""

    def of(text: str):
        out = seq.rle0(seq.mtf(seq.codes(text)[:-1]))
        return range(len(out)), out

    return per_block(blocks, "pos long, symbol long", of)


def mtf_roundtrip(blocks: DataFrame) -> DataFrame:
    """(block, text) after ranks, zero-run code and back."""

    def of(text: str):
        x = seq.codes(text)[:-1]
        back = seq.mtf_inverse(seq.rle0_inverse(seq.rle0(seq.mtf(x))), seq.first_seen(x).tolist())
        return (["".join(seq.letters(back))],)

    return per_block(blocks, "text string", of)
