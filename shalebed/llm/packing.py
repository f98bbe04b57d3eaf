"""Packing by power-of-two decomposition.

A document of n ids (its tokens and the end id) is cut into whole sequences of
``LENGTH`` ids and the binary lengths of the rest, largest first. Every piece is a
sequence by itself, so no sequence holds two documents and none needs padding.

A sequence's number is made of its length's power, the task that cut it and its rank
among those of that length in the task (7, 24 and 32 bits): numbers are unique, and the
sequences of one length form a bucket, a range of numbers. So packing is one pass over
the documents, with no exchange and nothing to count.

Defined results: a null text is empty and is one piece, the end id; repeated rows are
packed each; a very long text gives as many pieces as it needs; an empty table gives
no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import BYTES, PIECES, encoder, ended, spans
from .workers import caching

VOCABULARY = "byte_bpe_50k.json"
END = 0
LENGTH = 1024


def cuts(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; ``length`` is a power of two."""
    out = [(i * length, length) for i in range(n // length)]
    at = n - n % length
    for k in range(length.bit_length() - 1, -1, -1):
        if (n % length) >> k & 1:
            out.append((at, 1 << k))
            at += 1 << k
    return out


def _packer(vocabulary: str, end: int, length: int, pieces: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), {}
        if part >> 24:
            raise ValueError("more tasks than sequence numbers have room for")
        with caching("tokens", encoder.cache_clear):
            enc = encoder(vocabulary, pieces)
            for batch in batches:
                # with a smaller cache, for memory, smaller slices too
                for lo, rows in spans(batch.column("_text"), BYTES if pieces >= PIECES else 1 << 20):
                    some = batch.slice(lo, rows)
                    ids, ends = ended(*enc.flat(some.column("_text")), end)
                    data, at, ends = memoryview(ids).cast("B"), 0, ends.tolist()
                    doc, start, size, crc, total, number = [], [], [], [], [], []
                    for i, n in enumerate(b - a for a, b in zip([0, *ends], ends, strict=False)):
                        for a, m in cuts(n, length):
                            rank = seen.get(m, 0)
                            seen[m] = rank + 1
                            doc.append(i)
                            start.append(a)
                            size.append(m)
                            crc.append(zlib.crc32(data[4 * at : 4 * (at + m)]))
                            at += m
                            total.append(n)
                            number.append((m.bit_length() - 1) << 56 | part << 32 | rank)
                    off = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                    cols = [some.column("_id").take(pa.array(doc, pa.int32())), *(pa.array(c, pa.int64()) for c in (start, size, crc, total, number, [0] * len(doc)))]
                    cols.append(pa.ListArray.from_arrays(pa.array(off), pa.array(ids)))
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    return run


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, end: int = END, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", cached: int = PIECES) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and ids.

    ``cached``: words that a Python worker keeps the ids of; fewer take less memory and more time, with the same result.
    """
    if length < 1 or length & (length - 1):
        raise ValueError("length must be a power of two")
    kind = docs.select(F.col(id_col).alias("i")).dtypes[0][1]
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(_packer(vocabulary, end, length, cached), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>")
