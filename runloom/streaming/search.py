"""Pattern search over a stream of texts."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import strings


def search_stream(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """Matches in a streaming DataFrame (block, text), each text whole; patterns are a static one."""
    held = strings.pattern_list(patterns)
    if held is None:
        raise ValueError("patterns are too many for an automaton; search them in batches")
    return texts.select("block", "text").mapInArrow(strings.search_function(held), strings.FOUND)


def search_chunks(chunks: DataFrame, patterns: DataFrame) -> DataFrame:
    """Matches in texts that come in pieces: chunks (block, seq, text), in order of seq within a trigger.

    A block's state is what a match could still begin in, and how much was consumed."""
    held = strings.pattern_list(patterns)
    if held is None:
        raise ValueError("patterns are too many for an automaton; search them in batches")
    longest = max((len(p) for _, p in held), default=1)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tail, done = state.get if state.exists else ("", 0)
        machine, of = ahocorasick.Automaton(), {}
        for r, p in held:
            of.setdefault(p, []).append(r)
        for p, records in of.items():
            machine.add_word(p, (len(p), records))
        if of:
            machine.make_automaton()
        new = "".join(t or "" for t in pd.concat(list(frames)).sort_values("seq")["text"])
        text, rows = tail + new, []
        for e, (_, records) in machine.iter(text) if of else ():
            if e >= len(tail):
                rows += [(key[0], done - len(tail) + e + 1, r) for r in records]
        keep = text[max(0, len(text) - longest + 1) :]
        state.update((keep, done + len(new)))
        yield pd.DataFrame(rows, columns=["block", "end_pos", "record"]).astype("int64")

    return chunks.groupBy("block").applyInPandasWithState(step, strings.FOUND, "tail string, done long", "append", GroupStateTimeout.NoTimeout)
