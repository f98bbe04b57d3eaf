"""Record fields: bulky bytes in Parquet files of small row groups, addressed by file and row."""

from __future__ import annotations

import bisect
import itertools
import urllib.parse
import uuid
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW_GROUP = 1 << 20


def _file(location: str) -> Column:
    """A file's name in addresses: below the table for its own files, the whole path for others."""
    own = F.regexp_extract("_metadata.file_path", r"(records/f[^/]*/[^/]+/[^/]+)$", 1)
    return F.when(own != "", own).otherwise(F.col("_metadata.file_path"))


def place(df: DataFrame, fields: list[str], location: str, tmp: str) -> tuple[DataFrame, dict[str, list[str]]]:
    """Write the record fields of ``df``; the frame with addresses in their place, and the folders written.

    ``tmp``: a folder that the caller removes when the frame has been written.
    """
    spark = df.sparkSession
    # written first: the row numbers must not be computed twice
    df.withColumn("__rid", F.monotonically_increasing_id()).write.parquet(f"{location}/{tmp}")
    staged = spark.read.parquet(f"{location}/{tmp}")
    out, where = staged.drop(*fields), {}
    for i, f in enumerate(fields):
        path = f"records/f{i}/{uuid.uuid4().hex}"
        staged.select("__rid", F.col(f"`{f}`").alias("value")).write.option("parquet.block.size", ROW_GROUP).parquet(f"{location}/{path}")
        written = spark.read.parquet(f"{location}/{path}").select("__rid", F.struct(_file(location).alias("_FILE"), F.col("_metadata.row_index").alias("_ROW_ID")).alias(f))
        out, where[f] = out.join(written, "__rid"), [path]
    return out.select(*(f"`{c}`" for c in df.columns)), where


def files_of(addresses: DataFrame, field: str, location: str) -> list[str]:
    """Paths of the record files that ``addresses`` point into; as for any read, paths of files reach the driver."""
    found = [r[0] for r in addresses.select(F.col(f"`{field}`")["_FILE"]).distinct().collect() if r[0] is not None]
    return sorted(f"{location}/{f}" if f.startswith("records/") else urllib.parse.unquote(f.removeprefix("file://")) if f.startswith("file:") else f for f in found)


def values(spark: SparkSession, paths: list[str], location: str, field: str) -> DataFrame:
    """_FILE, _ROW_ID and the value of every record."""
    rows = spark.read.parquet(*paths)
    column = "value" if "value" in rows.columns else field if field in rows.columns else rows.columns[0]
    return rows.select(_file(location).alias("_FILE"), F.col("_metadata.row_index").alias("_ROW_ID"), F.col(f"`{column}`").alias("_value"))


def fetch(df: DataFrame, field: str, paths: list[str], location: str) -> DataFrame:
    """``df`` with the addresses in ``field`` replaced by the records' bytes."""
    if not paths:
        return df.withColumn(field, F.lit(None).cast("binary"))
    held = values(df.sparkSession, paths, location, field)
    address = F.col(f"`{field}`")
    joined = df.join(held, (address["_FILE"] == held["_FILE"]) & (address["_ROW_ID"] == held["_ROW_ID"]), "left")
    return joined.select(*(F.col("_value").alias(c) if c == field else F.col(f"`{c}`") for c in df.columns))


def index_foreign(spark: SparkSession, pattern: str, column: str, field: str, schema: T.StructType, index_fn: Callable[[dict], dict]) -> DataFrame:
    """Rows of the physical schema for foreign records: ``index_fn`` on each, and its address."""
    index = T.StructType([f for f in schema if f.name != field])
    rows = spark.read.parquet(pattern).select(F.col("_metadata.file_path").alias("_FILE"), F.col("_metadata.row_index").alias("_ROW_ID"), F.col(column).alias("_value"))
    out = T.StructType([*index, T.StructField("_FILE", T.StringType()), T.StructField("_ROW_ID", T.LongType())])
    arrow = spark.createDataFrame([], out).toArrow().schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [index_fn({field: v}) | {"_FILE": f, "_ROW_ID": r} for f, r, v in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            yield from pa.Table.from_pylist(got, arrow).to_batches()

    found = rows.mapInArrow(run, out)
    return found.select(*(F.struct("_FILE", "_ROW_ID").alias(field) if f.name == field else F.col(f"`{f.name}`") for f in schema))


class RandomAccess(Sequence):
    """Records by position in a table of addresses: a value for one field, a dict for several.

    The addresses lie in order in files below the table; here is one number for each of
    those files' parts. A request reads the addresses asked for, and then the record files
    they point into, many at once for a list. What is asked for so comes to the driver;
    :meth:`frame` answers a request of any size. :meth:`close` removes the addresses.
    """

    def __init__(self, dataset, fields: list[str] | str, order_by: list[str] | None = None, load: Callable[[bytes], Any] | None = None):
        self.dataset, self.load = dataset, load or (lambda b: b)
        self.fields = [fields] if isinstance(fields, str) else list(fields)
        self.folder, spark = f"tmp/addresses-{uuid.uuid4().hex}", dataset.spark
        order = [f"`{c}`" for c in order_by or dataset.primary_keys]
        rows = dataset.read(fields=[*dataset.primary_keys, *self.fields], reference_read=True).orderBy(*order)
        rows.select(F.monotonically_increasing_id().alias("_at"), F.struct(*(f"`{k}`" for k in dataset.primary_keys)).alias("_key"), *(F.col(f"`{f}`").alias(f"_{i}") for i, f in enumerate(self.fields))).write.parquet(f"{dataset.location}/{self.folder}")
        self.rows = spark.read.parquet(f"{dataset.location}/{self.folder}")
        parts = self.rows.groupBy(F.shiftright("_at", 33).alias("p")).agg(F.count(F.lit(1)), F.min("_at")).orderBy("p").collect()
        self.ends, self.firsts = list(itertools.accumulate(r[1] for r in parts)), [r[2] for r in parts]

    def __len__(self) -> int:
        return self.ends[-1] if self.ends else 0

    def _where(self, i: int) -> int:
        if not -len(self) <= i < len(self):
            raise IndexError(i)
        i %= len(self)
        part = bisect.bisect_right(self.ends, i)
        return self.firsts[part] + i - (self.ends[part - 1] if part else 0)

    def __getitem__(self, at):
        if isinstance(at, slice):
            at = list(range(len(self)))[at]
        many = isinstance(at, (list, tuple))
        wanted = [self._where(i) for i in (at if many else [at])]
        asked = self.rows.where(F.col("_at").isin(sorted(set(wanted))))
        found: list[dict] = []
        for i in range(len(self.fields)):
            got = fetch(asked.select("_at", f"_{i}"), f"_{i}", files_of(asked, f"_{i}", self.dataset.location), self.dataset.location)
            found.append({r[0]: self.load(r[1]) for r in got.collect()})
        rows = [found[0][w] if len(self.fields) == 1 else {f: got[w] for f, got in zip(self.fields, found, strict=True)} for w in wanted]
        return rows if many else rows[0]

    def frame(self, positions: DataFrame) -> DataFrame:
        """Keys and records' bytes at ``positions`` (a column of whole numbers, negative ones from the end), a row for each; neither comes to the driver."""
        at = positions.select(F.col(f"`{positions.columns[0]}`").cast("long").alias("_i"))
        n = len(self)
        if bad := at.where((F.col("_i") < -n) | (F.col("_i") >= n) | F.col("_i").isNull()).first():
            raise IndexError(bad[0])
        parts = [(first >> 33, first, end) for first, end in zip(self.firsts, [0, *self.ends[:-1]], strict=True)] if n else []
        starts = F.broadcast(self.dataset.spark.createDataFrame(parts, "_p long, _first long, _start long"))
        placed = self.rows.join(starts, F.shiftright("_at", 33) == F.col("_p")).withColumn("_n", F.col("_at") - F.col("_first") + F.col("_start"))
        out = placed.join(at.select(F.when(F.col("_i") < 0, F.col("_i") + n).otherwise(F.col("_i")).alias("_n")), "_n")
        names = [f"_{i}" for i in range(len(self.fields))]
        out = out.select("_key", *names)
        for name in names:
            out = fetch(out, name, files_of(self.rows, name, self.dataset.location), self.dataset.location)
        return out.select(*(F.col("_key")[k].alias(k) for k in self.dataset.primary_keys), *(F.col(c).alias(f) for c, f in zip(names, self.fields, strict=True)))

    def close(self) -> None:
        self.dataset.log.store.delete(self.folder)
