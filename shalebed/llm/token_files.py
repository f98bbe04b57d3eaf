"""Token ids in Parquet: list columns with delta or dictionary encoding, small row groups and page indexes.

Files lie in ascending order of document id, so that a read of some ids, or of the
counts alone, skips row groups, pages and columns. Each row holds its place among
the ids of its own file part; the offsets of the parts, one row a part, give the place
among all ids.

Defined results: a null text is empty and yields the end id alone; null ids come first;
rows that repeat an id lie in the order of their texts' hashes; an empty table gives
an empty set of files; very long texts are written whole; other columns, whatever their
names, are not written.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tokens import encoder, ended, spans
from .workers import caching

VOCABULARY = "word_bpe_49k.json"
END = 1
#: Parts whose offsets are added up together.
BLOCK = 1024


def _encoder(vocabulary: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        with caching("tokens", encoder.cache_clear):
            enc = encoder(vocabulary)
            for batch in batches:
                for lo, rows in spans(batch.column("_text")):
                    some = batch.slice(lo, rows)
                    ids, ends = ended(*enc.flat(some.column("_text")), end)
                    off = np.append(0, ends)
                    n = np.diff(off)
                    lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids))
                    yield pa.RecordBatch.from_arrays(
                        [some.column("_id"), lists, pa.array(n), pa.array(np.full(len(n), part, np.int32)), pa.array(at + off[:-1])],
                        ["doc_id", "ids", "n_tokens", "part", "at"],
                    )
                    at += int(off[-1])

    return run


def write(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end: int = END, id_col: str = "doc_id", text_col: str = "text", encoding: str = "delta", row_group_bytes: int = 16 << 20, page_bytes: int = 64 << 10) -> None:
    """Write doc_id, ids, n_tokens, part and at (ids before the row in its part) of every row under ``path``."""
    if encoding not in ("delta", "dictionary"):
        raise ValueError(f"encoding must be delta or dictionary, not {encoding}")
    kind = docs.select(F.col(id_col).alias("i")).dtypes[0][1]
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    order = ["_id", F.xxhash64("_text")]
    ids = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_encoder(vocabulary, end), f"doc_id {kind}, ids array<int>, n_tokens long, part int, at long")
    (
        ids.write.option("compression", "zstd").option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary", "false")
        .option("parquet.enable.dictionary#ids.list.element", str(encoding == "dictionary").lower())
        .option("parquet.block.size", row_group_bytes).option("parquet.page.size", page_bytes).option("parquet.page.row.count.limit", 2000)
        .parquet(path)
    )


def index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it) and n_tokens, from the metadata columns alone."""
    return _started(spark.read.parquet(path).select("doc_id", "n_tokens", "part", "at"), spark, path).drop("part", "at")


def _started(rows: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    parts = spark.read.parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("_n")).withColumn("_b", F.floor(F.col("part") / BLOCK))
    # sums over blocks of parts, then over the parts of each block: no window meets more than a block's share of the parts
    earlier = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = parts.groupBy("_b").agg(F.sum("_n").alias("_n")).select("_b", earlier(Window.orderBy("_b")).alias("_block"))
    inside = parts.select("part", "_b", earlier(Window.partitionBy("_b").orderBy("part")).alias("_inside"))
    before = inside.join(blocks, "_b").select("part", (F.col("_block") + F.col("_inside")).alias("_before"))
    return rows.join(before, "part").withColumn("start", F.col("_before") + F.col("at")).drop("_before")


def read(spark: SparkSession, path: str, ids: list[int] | None = None) -> DataFrame:
    """doc_id and ids of the documents asked for (all by default); the filter reaches row groups and pages."""
    rows = spark.read.parquet(path)
    return (rows if ids is None else rows.where(F.col("doc_id").isin(ids))).select("doc_id", "ids", "n_tokens")


def _checksum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        flat, off = lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False), lists.offsets.to_numpy()
        crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(off[:-1], off[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(off), pa.int64()), pa.array(crc, pa.int64()), batch.column("part"), batch.column("at")], ["doc_id", "n_tokens", "ids_crc32", "part", "at"])


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the ids in the files."""
    rows = spark.read.parquet(path)
    kind = rows.select("doc_id").dtypes[0][1]
    summed = rows.select("doc_id", "ids", "part", "at").mapInArrow(_checksum, f"doc_id {kind}, n_tokens long, ids_crc32 long, part int, at long")
    return _started(summed, spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")
