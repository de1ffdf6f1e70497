"""Statistics of whole texts, in one pass; words are runs of anything but space and the controls 9 to 13."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

BLANKS = bytes([32, *range(9, 14)])
TAILS = bytes(range(0x80, 0xC0))
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGITS = bytes(range(48, 58))
STOPS = b".?;:"

RULE_STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE_STATS = ("n_lines", "n_distinct", "n_top", "n_adjacent", "n_upper", "n_lower", "n_digits", "n_bangs", "n_commas", "n_stops", "n_bars", "n_long", "n_bytes")


def rule_stats(text: bytes, words: list[bytes]) -> tuple[int, ...]:
    """RULE_STATS: words, code points in them, symbols, repeated lines, words in three-word windows found twice or more."""
    drop = text.translate
    seen, repeats = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            repeats += 1
        elif line.strip():
            seen.add(line)
    n, covered = len(words), 0
    if n > 2:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(windows)) < len(windows):
            often, upto = Counter(windows), 0
            for i, w in enumerate(windows):
                if often[w] > 1:
                    covered += i + 3 - max(i, upto)
                    upto = i + 3
    return n, len(drop(None, BLANKS + TAILS)), len(text) - len(drop(None, SYMBOLS)), repeats, covered


def more_stats(text: bytes, words: list[bytes]) -> tuple[int, ...]:
    """MORE_STATS: counts of characters by kind, and how varied the words are."""
    drop, size = text.translate, len(text)
    often = Counter(words)
    return (
        text.count(b"\n") + 1,
        len(often),
        max(often.values(), default=0),
        sum(map(eq, words, words[1:])),
        *(size - len(drop(None, s)) for s in (UPPER, LOWER, DIGITS)),
        text.count(b"!"),
        text.count(b","),
        size - len(drop(None, STOPS)),
        text.count(b"|"),
        sum(n for w, n in often.items() if len(w) > 20),
        size,
    )


def with_statistics(rows: DataFrame, text: str = "text", more: bool = False, keep_text: bool = False) -> DataFrame:
    """rows, whose column names differ from each other and from the statistics', with RULE_STATS (and MORE_STATS) of
    the text column; null texts are empty."""
    names, at = [*RULE_STATS, *(MORE_STATS if more else ())], rows.columns.index(text)
    kept = [k for k in range(len(rows.columns)) if keep_text or k != at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.parts(batch, text):
                out = []
                for t in part.column(at):
                    data = t.as_buffer().to_pybytes() if t.is_valid else b""
                    words = data.split()
                    out.append(rule_stats(data, words) + (more_stats(data, words) if more else ()))
                cols = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in kept], *cols], [*[part.schema.names[k] for k in kept], *names])

    schema = T.StructType([rows.schema[k] for k in kept] + [T.StructField(n, T.LongType()) for n in names])
    return common.small_batches(rows).mapInArrow(run, schema)


def statistics(docs: DataFrame, more: bool = False) -> DataFrame:
    """(doc_id, RULE_STATS and, if asked for, MORE_STATS) of every row.  A column named lang or source, if docs has it,
    stays as text."""
    keys = [c for c in ("lang", "source") if c in docs.columns]
    return with_statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), *[F.col(c).cast("string").alias(c) for c in keys]), more=more)
