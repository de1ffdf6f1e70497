"""Planning, fused transforms and codecs as block operators."""

from __future__ import annotations

import itertools
import lzma

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codecs, pieces, registers, tunnels
from ..functions import sequence as seq
from .blocks import per_block, per_many

STRATEGIES = ("none", "hirsch", "greedy", "update", "best10", "best50", "best100")
STAGES = ("bw94", "bcm")


def chains(blocks: DataFrame) -> DataFrame:
    """(block, run, height, columns, rating) of every prefix interval."""

    def of(text: str):
        return tuple(zip(*[(i.run, i.height, len(i.columns), i.rating) for i in tunnels.intervals(tunnels.Transform.of(text))], strict=True)) or None

    return per_block(blocks, "run long, height long, columns long, rating long", of)


def overlaps(blocks: DataFrame) -> DataFrame:
    """(block, run, inner, inner_height): taller runs that an interval goes through."""

    def of(text: str):
        t = tunnels.Transform.of(text)
        rows = {(i.run, int(r), int(t.heights[r])) for i in tunnels.intervals(t) for r in t.run_of[i.columns] if t.heights[r] > i.height}
        return tuple(zip(*sorted(rows), strict=True)) or None

    return per_block(blocks, "run long, inner long, inner_height long", of)


def plans(blocks: DataFrame, strategies: tuple[str, ...]) -> DataFrame:
    """(block, strategy, place, run, rating) of chosen intervals, best first."""

    def of(text: str):
        t = tunnels.Transform.of(text)
        found, costs = tunnels.intervals(t), tunnels.Costs.of(t)
        rows = [(s, k, i.run, i.rating) for s in strategies for k, i in enumerate(tunnels.plan(s, found, costs, t))]
        return tuple(zip(*rows, strict=True)) or None

    return per_block(blocks, "strategy string, place long, run long, rating long", of)


def fused_stats(blocks: DataFrame, strategies: tuple[str, ...] = STRATEGIES) -> DataFrame:
    """(block, strategy, tunnels, symbols, removed, benefit, cost): what a plan without overlaps does to the transform."""

    def of(text: str):
        rows, t = [], tunnels.Transform.of(text)
        found, costs = tunnels.intervals(t), tunnels.Costs.of(t)
        for s in strategies:
            f, chosen = tunnels.fuse_with(t, tunnels.plan(s, found, costs, t))
            removed = costs.rle - tunnels.rle_length(f.symbols)
            rows.append((s, len(chosen), len(f.symbols), removed, costs.benefit(removed), round(costs.cost(len(chosen)), 6)))
        return tuple(zip(*rows, strict=True))

    return per_block(blocks, "strategy string, tunnels long, symbols long, removed long, benefit long, cost double", of)


def fused_rows(blocks: DataFrame, strategy: str) -> DataFrame:
    """(block, row, sym, aux): symbols that stay, with the codes 2 * outer + inner."""

    def of(text: str):
        f, _, _ = tunnels.fuse(text, strategy)
        return range(len(f.symbols)), seq.letters(f.symbols), 2 * f.outer.astype(int) + f.inner

    return per_block(blocks, "row long, sym string, aux long", of)


def aux_runs(fused: DataFrame) -> DataFrame:
    """(block, run_id, aux): one code for each run of more than one row, its second row's; rows (block, row, sym, aux)."""
    w = Window.partitionBy("block").orderBy("row")
    new = F.coalesce((F.lag("sym").over(w) != F.col("sym")).cast("int"), F.lit(1))
    rows = fused.withColumn("new", new).withColumn("run_id", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("block", "run_id").orderBy("row")))
    return rows.where("nth = 2").select("block", "run_id", "aux")


def fused_inverse(blocks: DataFrame, strategy: str) -> DataFrame:
    """(block, text) fused by a plan and inverted again."""

    def of(text: str):
        return (["".join(seq.letters(tunnels.fuse(text, strategy)[0].invert()))],)

    return per_block(blocks, "text string", of)


def index_rows(blocks: DataFrame) -> DataFrame:
    """(block, row, bound, inner, outer) of each row of the transform at the order with the fewest edges."""

    def of(text: str):
        x = seq.codes(text)
        sa = seq.suffix_array(x)
        return (range(len(x)), *tunnels.kmer_bits(x, sa, seq.bwt(x, sa), seq.min_order(x)[0]))

    return per_block(blocks, "row long, bound long, inner long, outer long", of)


def kmer_bounds(blocks: DataFrame, k: int) -> DataFrame:
    """(block, row, bound): 1 at the first row of each cyclic k-mer."""

    def of(text: str):
        x = seq.codes(text)
        sa = seq.suffix_array(x)
        return range(len(x)), tunnels.kmer_bits(x, sa, seq.bwt(x, sa), min(k, len(x)))[0]

    return per_block(blocks, "row long, bound long", of)


def fused_index(blocks: DataFrame) -> DataFrame:
    """(block, pos, sym, outer, inner): the compacted index."""

    def of(text: str):
        f, _ = tunnels.fused_index(text)
        return range(len(f.symbols)), seq.letters(f.symbols), f.outer, f.inner

    return per_block(blocks, "pos long, sym string, outer long, inner long", of)


def invert_index(index: DataFrame) -> DataFrame:
    """(block, text) from a compacted index (block, pos, sym, outer, inner), one written before, say.  A block's rows
    meet in one task, as its text does everywhere."""

    def of(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        x = np.array([ord(c) + 1 if c != chr(1) else 0 for c in rows["sym"]], np.int64)
        f = tunnels.Fused(x, rows["outer"].to_numpy(), rows["inner"].to_numpy(), 0)
        return pd.DataFrame({"block": rows["block"].iloc[:1], "text": ["".join(seq.letters(f.invert()))]})

    return index.groupBy("block").applyInPandas(of, "block long, text string")


def index_stats(blocks: DataFrame) -> DataFrame:
    """(block, n, k, symbols): length with sentinel, order, and symbols of the compacted index."""

    def of(text: str):
        f, k = tunnels.fused_index(text)
        return [f.length], [k], [len(f.symbols)]

    return per_block(blocks, "n long, k long, symbols long", of)


def xz_best(data: bytes) -> bytes:
    """xz at its highest preset.  The preset's dictionary of 64 MB, set up anew for each text, holds no more than one of
    the text's own size does."""
    size = min(64 << 20, 1 << max(12, len(data).bit_length()))
    return lzma.compress(data, filters=[{"id": lzma.FILTER_LZMA2, "preset": 9 | lzma.PRESET_EXTREME, "dict_size": size}])


def codec_sizes(blocks: DataFrame, strategies: tuple[str, ...] = ("none", "hirsch", "greedy"), stages: tuple[str, ...] = STAGES) -> DataFrame:
    """(block, method, size, coded): bytes before and after, for each strategy and stage, and for xz."""

    def of(texts: list[str]):
        rows, mixed, whose, held = [[] for _ in texts], [], [], 0

        def mix() -> None:
            coded = [len(c) for c in codecs.encode_mixed(mixed)]
            for own, i, k in whose:
                own[i] = (*own[i][:2], coded[k])
            mixed.clear(), whose.clear()

        for text, own in zip(texts, rows, strict=True):
            if held > 8_000_000:  # whatever the number of strategies
                mix()
                held = 0
            data = text.encode()
            t = tunnels.Transform.of(data.decode("latin-1"))
            found, costs = tunnels.intervals(t), tunnels.Costs.of(t)
            known: dict = {}  # strategies that come to the same plan have the same code
            for s in strategies:
                f, chosen = tunnels.fuse_with(t, tunnels.plan(s, found, costs, t))
                for g in stages:
                    key = (g, *sorted(i.run for i in chosen))
                    if key not in known and g == "bcm":
                        known[key] = len(mixed)
                        mixed.append(f)
                        held += len(f.symbols)
                    elif key not in known:
                        known[key] = len(codecs.encode_fused(f, g))
                    if g == "bcm":
                        whose.append((own, len(own), known[key]))
                    own.append((f"{s}-{g}", len(data), known[key]))
            own.append(("xz", len(data), len(xz_best(data))))
        mix()
        return [tuple(zip(*own, strict=True)) for own in rows]

    return per_many(blocks, "method string, size long, coded long", of)


def codec_roundtrip(blocks: DataFrame, strategy: str, stage: str) -> DataFrame:
    def back(f: tunnels.Fused) -> str:
        return "".join(seq.letters(f.invert())).encode("latin-1").decode()

    def of(texts: list[str]):
        fused = [tunnels.fuse(text.encode().decode("latin-1"), strategy)[0] for text in texts]
        if stage == "bcm":
            again = codecs.decode_mixed(codecs.encode_mixed(fused))
        else:
            again = [codecs.decode_fused(codecs.encode_fused(f, stage), stage) for f in fused]
        return [([back(f)],) for f in again]

    return per_many(blocks, "text string", of)


def coder_roundtrip(blocks: DataFrame, kind: str) -> DataFrame:
    """kind: range32, range64, arith32 or arith64 over bytes; index: the compacted index through a stage; two_bits: aux codes; container: pieces of 100 bytes."""

    def containers(texts: list[str]):
        cut = [[data[i : i + 100] for i in range(0, len(data), 100)] for data in map(str.encode, texts)]
        coded = iter(pieces.encode([p for c in cut for p in c]))
        held = [codecs.blocks_of(codecs.container(list(itertools.islice(coded, len(c))))) for c in cut]
        again = iter(pieces.decode([b for blocks in held for b in blocks]))
        return [([b"".join(itertools.islice(again, len(blocks))).decode()],) for blocks in held]

    if kind == "container":
        return per_many(blocks, "text string", containers, 2_000_000)

    def registered(texts: list[str]):
        cut, width = [t.encode() for t in texts], int(kind[5:])
        return [([b.decode()],) for b in registers.decode(registers.encode(cut, width), [len(c) for c in cut], width)]

    if kind.startswith("arith"):
        return per_many(blocks, "text string", registered, 32_000_000)

    def of(text: str):
        data = text.encode()
        if kind.startswith("range"):
            width = int(kind[5:])
            back = bytes(codecs.range_decode(codecs.range_encode(list(data), 256, width), 256, len(data), width))
        elif kind == "two_bits":
            x = [b >> s & 3 for b in data for s in (0, 2, 4, 6)]
            y = codecs.unpack_two_bits(codecs.pack_two_bits(x), len(x)).tolist()
            back = bytes(sum(v << s for v, s in zip(y[i : i + 4], (0, 2, 4, 6), strict=True)) for i in range(0, len(y), 4))
        elif kind == "index":
            f = codecs.decode_fused(codecs.encode_fused(tunnels.fused_index(text)[0], "bw94"), "bw94")
            return (["".join(seq.letters(f.invert()))],)
        else:
            raise ValueError(f"no coder {kind}")
        return ([back.decode()],)

    return per_block(blocks, "text string", of)


def damaged(blocks: DataFrame) -> DataFrame:
    """(block, truncated, enlarged): whether the decoder rejects a block that lost or gained a byte."""

    def rejects(data: bytes) -> bool:
        try:
            codecs.decode_block(data)
        except ValueError:
            return True
        return False

    def of(text: str):
        data = codecs.encode_block(text.encode())
        return [rejects(data[:-1])], [rejects(data + b"\0")]

    return per_block(blocks, "truncated boolean, enlarged boolean", of)


def xz_sizes(blocks: DataFrame) -> DataFrame:
    def of(text: str):
        data = text.encode()
        return [len(data)], [len(lzma.compress(data))]

    return per_block(blocks, "size long, coded long", of)
