"""BPE encoding and decoding of a table of texts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common, wordbpe


def encode(docs: DataFrame, path: str | None = None, streaming: bool = True) -> DataFrame:
    """(doc_id, ids array<int>) of every whole text; null and empty texts have empty ids, repeated rows stay."""
    path = path or wordbpe.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = wordbpe.loaded(path, streaming)
        for batch in batches:
            for part in common.parts(batch, "text"):
                ids = list(coder.encode_all(part.column(1)))
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                values = np.concatenate([*ids, np.zeros(0, np.uint32)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["doc_id", "ids"])

    return common.small_batches(common.documents(docs)).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text): what ids stand for, words followed by a space; null ids give an empty text."""
    path = path or wordbpe.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = wordbpe.loaded(path, True)
        for batch in batches:
            machine = coder.text_decoder()
            texts = [machine.feed(x or []) + machine.close() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text: ids as little-endian unsigned 32-bit integers,
    and the text they decode to.  Ids are hashed as the transducer emits them and go on into the decoder, whose text is
    hashed as it comes; no text's ids are gathered.  Null texts are empty ones; repeated rows stay, each with its row; an
    empty table gives no rows; other columns, whatever their names, stay out."""
    path = path or wordbpe.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = wordbpe.loaded(path, True)
        machine = coder.decoder()
        for batch in batches:
            for part in common.parts(batch, "text"):
                sizes, hashes, decoded = [], [], []
                n, own, back = 0, hashlib.sha256(), hashlib.sha256()
                for ids, last in coder.emitted(part.column(1)):
                    n += len(ids)
                    own.update(ids.astype("<u4", copy=False).tobytes())
                    for at in range(0, len(ids), 65_536):
                        back.update(machine.feed(ids[at : at + 65_536]).encode())
                    if last:
                        back.update(machine.close().encode())
                        sizes.append(n), hashes.append(own.hexdigest()), decoded.append(back.hexdigest())
                        n, own, back = 0, hashlib.sha256(), hashlib.sha256()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return common.small_batches(common.documents(docs)).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
