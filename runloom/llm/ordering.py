"""Training-order materialisation of token sequences.

Texts become ids, each followed by an end id, and are cut in the order of the input partition into sequences of fixed
length.  Sequence i of N goes to slot P(i), where P is a keyed Feistel permutation of the least even number of bits that
holds N; a value outside [0, N) is permuted again until it is inside (cycle-walking), so slots are exactly 0 .. N-1.
Slots are range-partitioned into shards: shard s holds slots s * per_shard and on, each at a fixed stride, so a reader
finds any slot by arithmetic and resumes from its number.

Ids travel compressed in blocks of sequences, once to the shared folder and once in the shuffle.  Shard files are written
under a name of the attempt and renamed, so a task that runs again replaces nothing but its own file.

Null and empty texts add their end id; repeated rows each count; an empty table gives no shards; the last sequence of
an input partition may be shorter and is padded in its shard; other columns stay out.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, wordbpe

LEVEL = 6
_LONGS = pa.list_(pa.int64())
BLOCK = pa.schema([("part", pa.int64()), ("at", pa.int64()), ("n_tokens", _LONGS), ("first_doc", _LONGS), ("crc32", _LONGS), ("ids", pa.binary())])
SENT = pa.schema([("shard", pa.int32()), ("slot", _LONGS), ("sequence", _LONGS), ("n_tokens", _LONGS), ("first_doc", _LONGS), ("crc32", _LONGS), ("ids", pa.binary())])


def _round(half: np.ndarray, key: np.uint64, bits: int) -> np.ndarray:
    """A keyed mix of a half, of so many bits."""
    with np.errstate(over="ignore"):
        x = half + key
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    return x & np.uint64((1 << bits) - 1)


def round_keys(key: int, rounds: int) -> list[np.uint64]:
    return [np.uint64(int.from_bytes(hashlib.blake2b(f"{key}:{r}".encode(), digest_size=8).digest(), "little")) for r in range(rounds)]


def permute(index: np.ndarray, n: int, key: int, rounds: int = 6, back: bool = False) -> np.ndarray:
    """Slots of the given sequence numbers, or (back) sequence numbers of slots, in a permutation of 0 .. n-1."""
    bits = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    half, keys = np.uint64(bits), round_keys(key, rounds)
    low = np.uint64((1 << bits) - 1)
    out = np.asarray(index).astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> half, x & low
        for k in reversed(keys) if back else keys:
            left, right = (right ^ _round(left, k, bits), left) if back else (right, left ^ _round(right, k, bits))
        x = (left << half) | right
        out[todo] = x
        todo = todo[x >= np.uint64(n)]
    return out.astype(np.int64)


def sequences(docs: DataFrame, path: str, length: int, end_id: int, width: int, together: int = 32) -> DataFrame:
    """(part, at, n_tokens, first_doc, crc32, ids): ``together`` consecutive sequences of an input partition, the first
    of them number ``at``, with a value each, and their ids as one compressed block of integers of ``width`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, pack, part = wordbpe.loaded(path), zstandard.ZstdCompressor(level=LEVEL), TaskContext.get().partitionId()
        end, held, owners, at = np.array([end_id], np.uint32), [], [], 0
        kind = f"<u{width}"

        def cut(last: bool) -> pa.RecordBatch | None:
            nonlocal held, owners, at
            ids = np.concatenate(held) if held else np.zeros(0, np.uint32)
            n = -(-len(ids) // length) if last else len(ids) // (length * together) * together
            if not n:
                return None
            starts = np.cumsum([0, *[len(x) for x in held]])
            rows = []
            for first in range(0, n, together):
                own = [ids[k * length : (k + 1) * length].astype(kind).tobytes() for k in range(first, min(n, first + together))]
                docs_ = [owners[int(np.searchsorted(starts, k * length, "right")) - 1] for k in range(first, first + len(own))]
                rows.append((part, at + first, [len(x) // width for x in own], docs_, [zlib.crc32(x) for x in own], pack.compress(b"".join(own))))
            at += n
            rest = ids[n * length :]
            keep = int(np.searchsorted(starts, n * length, "right")) - 1
            held, owners = ([rest[: starts[keep + 1] - n * length], *held[keep + 1 :]], owners[keep:]) if len(rest) else ([], [])
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), BLOCK.types, strict=True)], schema=BLOCK)

        for batch in batches:
            for slice_ in common.parts(batch, "text"):
                for doc_id, ids in zip(slice_.column(0).to_pylist(), coder.encode_all(slice_.column(1)), strict=True):
                    held += [ids, end]
                    owners += [doc_id, doc_id]
                if out := cut(False):
                    yield out
        if out := cut(True):
            yield out

    return common.small_batches(common.documents(docs)).mapInArrow(run, "part long, at long, n_tokens array<long>, first_doc array<long>, crc32 array<long>, ids binary")


def _store(url: str):
    """The file system of a URL and the path in it."""
    fs, path = pafs.FileSystem.from_uri(url if "://" in url or url.startswith("file:") else f"file://{url}")
    return fs, path


def materialise(docs: DataFrame, out: str, key: int = 20240229, length: int = 2048, per_shard: int = 4096, path: str | None = None, end_id: int = 49407, vocabulary: int = 49408) -> DataFrame:
    """Writes the shards and manifest.json under the URL ``out``; gives (slot, shard, byte_offset, sequence, n_tokens,
    crc32, first_doc) of every sequence, as a written table."""
    spark, path = docs.sparkSession, path or wordbpe.default_path()
    width = 2 if vocabulary <= 1 << 16 else 4
    stride = length * width
    with common.scratch(spark) as stage:
        rows = stage(sequences(docs, path, length, end_id, width), "sequences")
        # One row for each input partition; written, so that its size is known and the join moves no ids.
        counts = rows.groupBy("part").agg(F.sum(F.size("n_tokens")).alias("n"))
        before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
        first = stage(counts.select("part", "n", F.coalesce(before, F.lit(0)).alias("first")), "first")
        total = first.agg(F.sum("n")).first()[0] or 0
        numbered = rows.join(first.drop("n"), "part").select((F.col("first") + F.col("at")).alias("sequence"), "n_tokens", "first_doc", "crc32", "ids")

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Blocks of sequences that go to one shard."""
            pack, unpack = zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()
            for batch in batches:
                for low in range(0, batch.num_rows, 64):
                    held: dict[int, list] = {}
                    for at, sizes, docs_, crcs, blob in zip(*(c.to_pylist() for c in batch.slice(low, 64).columns), strict=True):
                        raw = memoryview(unpack.decompress(blob))
                        slots = permute(np.arange(at, at + len(sizes)), total, key).tolist()
                        for k, slot in enumerate(slots):
                            piece = raw[k * stride : k * stride + sizes[k] * width]
                            held.setdefault(slot // per_shard, []).append((slot, at + k, sizes[k], docs_[k], crcs[k], piece))
                    cols = [[], [], [], [], [], [], []]
                    for shard, own in held.items():
                        *lists, pieces = zip(*own, strict=True)
                        for c, v in zip(cols, (shard, *map(list, lists), pack.compress(b"".join(pieces))), strict=True):
                            c.append(v)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, SENT.types, strict=True)], schema=SENT)

        placed = numbered.mapInArrow(place, "shard int, slot array<long>, sequence array<long>, n_tokens array<long>, first_doc array<long>, crc32 array<long>, ids binary")

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """One shard: ``per_shard`` strides at most are held."""
            unpack, shard, file, known = zstandard.ZstdDecompressor(), None, None, []
            for batch in batches:
                for shard, slots, numbers, sizes, docs_, crcs, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    file = bytearray(min(per_shard, total - shard * per_shard) * stride) if file is None else file
                    raw, at = unpack.decompress(blob), 0
                    for slot, size in zip(slots, sizes, strict=True):
                        to = (slot - shard * per_shard) * stride
                        file[to : to + size * width] = raw[at : at + size * width]
                        at += size * width
                    known += zip(slots, [shard] * len(slots), numbers, sizes, docs_, crcs, strict=True)
            if file is None:
                return
            (fs, base), name = _store(out), f"_{shard:08d}-{TaskContext.get().taskAttemptId()}"
            fs.create_dir(base, recursive=True)
            with fs.open_output_stream(f"{base}/{name}", compression=None) as f:
                f.write(file)
            final = f"{base}/shard-{shard:08d}.bin"
            if fs.get_file_info(final).type != pafs.FileType.NotFound:
                fs.delete_file(final)
            fs.move(f"{base}/{name}", final)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*known, strict=True)], ["slot", "shard", "sequence", "n_tokens", "first_doc", "crc32"])

        shards = max(1, -(-total // per_shard))
        ranged = placed.repartitionById(shards, F.col("shard"))
        done = common.staged(ranged.mapInArrow(write, "slot long, shard long, sequence long, n_tokens long, first_doc long, crc32 long"), "slots")
    fs, base = _store(out)
    fs.create_dir(base, recursive=True)
    for left in fs.get_file_info(pafs.FileSelector(base)):
        if left.base_name.startswith("_"):
            fs.delete_file(left.path)
    with fs.open_output_stream(f"{base}/manifest.json") as f:
        f.write(json.dumps({"sequences": total, "per_shard": per_shard, "stride": stride, "length": length, "width": width, "key": key}).encode())
    return done.select("slot", "shard", ((F.col("slot") % per_shard) * stride).alias("byte_offset"), "sequence", "n_tokens", "crc32", "first_doc")


def read(out: str, slot: int = 0, count: int | None = None) -> Iterator[np.ndarray]:
    """Sequences in training order from a slot on, by one seek and sequential reads."""
    fs, base = _store(out)
    with fs.open_input_stream(f"{base}/manifest.json") as f:
        m = json.loads(f.read())
    end = m["sequences"] if count is None else min(m["sequences"], slot + count)
    while slot < end:
        shard, at = divmod(slot, m["per_shard"])
        n = min(end - slot, m["per_shard"] - at)
        with fs.open_input_file(f"{base}/shard-{shard:08d}.bin") as f:
            f.seek(at * m["stride"])
            for _ in range(n):
                yield np.frombuffer(f.read(m["stride"]), f"<u{m['width']}")
        slot += n


def materialised(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``materialise`` into a new folder beside the session's other shared files."""
    return materialise(docs, common.new_path(spark, "shards"))
