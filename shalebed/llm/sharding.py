"""Sharding by histogram sort, with DataFrame functions only.

Rows are ordered by (hash of the text, id), so that equal texts lie side by side and
a group of copies is cut only where a shard must end. The fifteen (shards - 1)
splitters of that order are found by counting exact bytes below candidate
boundaries: each round divides every bracket that still holds a splitter into
``PROBES`` bins, counts the bytes in each, and keeps the one bin in which the target
falls, until that bin holds no more than the tolerance or a single key. Only these
counts reach the driver (at most splitters x PROBES rows a round). Then the rows, texts
included, are exchanged once, dealt out by the splitters: a shard is one partition, or,
if it is larger than ``PART_BYTES``, as many as it takes, among which its rows are dealt
by a hash of their keys, so that a group of copies can't fill one of them.

Defined results: a null text has size 1 and the checksum of no bytes; a null id sorts
first; rows that repeat both text and id are never told apart, so they share a shard;
a very long text is one row and may outweigh a shard; an empty table gives no rows.
Other columns, whatever their names, are written as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .staging import fresh_path, stage

PROBES = 1024
#: Bytes by which a splitter may miss its target, as a share of one shard.
TOLERANCE = 0.001
#: Bytes of text in one partition of the exchange.
PART_BYTES = 128 << 20
_LEAST = -(2**63)


@dataclass(frozen=True)
class Splitter:
    """Rows whose (h, id) is at least this key belong to a later shard."""

    h: int
    id: int
    #: exact bytes of all rows below the key
    below: int


def _keys(id_col: str, text_col: str) -> list[Column]:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [
        F.coalesce(F.col(id_col).cast("long"), F.lit(_LEAST)).alias("_k"),
        F.xxhash64(text).alias("_h"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
    ]


def splitters(rows: DataFrame, targets: list[int], tolerance: int) -> list[Splitter]:
    """For each target, the key with exact ``below`` nearest to it, by rounds of counting over ``rows`` (_h, _k, size)."""
    seen = rows.agg(F.min("_h"), F.max("_h"), F.min("_k"), F.max("_k"), F.sum("size")).first()
    if seen[4] is None:
        return []
    done: dict[int, Splitter] = {}
    # A bracket: inclusive key bounds, bytes below it, bytes in it; in one dimension at a time.
    open_ = {t: (("_h", seen[0], seen[1], seen[0], seen[1]), (seen[2], seen[3]), 0, seen[4]) for t in targets}
    while open_:
        brackets = sorted({v[:3] for v in open_.values()})
        which, bins = F.lit(None).cast("int"), F.lit(None).cast("long")
        for i, ((dim, lo, hi, h0, h1), (k0, k1), _) in enumerate(brackets):
            inside = F.col("_h").between(h0, h1) & F.col("_k").between(k0, k1)
            width = max(1, -(-(hi - lo + 1) // PROBES))
            # rounding keeps the order, and a bracket under 2^53 keys wide is divided exactly
            at = (F.col(dim).cast("double") - F.lit(float(lo))) / F.lit(width) if hi - lo >= 2**53 else (F.col(dim) - F.lit(lo)) / F.lit(width)
            which, bins = F.when(inside, i).otherwise(which), F.when(inside, F.floor(at).cast("long")).otherwise(bins)
        counted = (
            rows.select(which.alias("b"), bins.alias("bin"), "_h", "_k", "size").where("b is not null")
            .groupBy("b", "bin").agg(F.sum("size").alias("n"), F.min("_h"), F.max("_h"), F.min("_k"), F.max("_k"))
            .collect()
        )
        by: dict[int, list] = {}
        for r in sorted(counted, key=lambda r: (r[0], r[1])):
            by.setdefault(r[0], []).append(r)
        for t, (bracket, ids, below, _) in list(open_.items()):
            acc = below
            for r in by[brackets.index((bracket, ids, below))]:
                if acc + r["n"] > t or r is by[brackets.index((bracket, ids, below))][-1]:
                    break
                acc += r["n"]
            h0, h1, k0, k1 = r[3:7]
            if (h0 == h1 and k0 == k1) or r["n"] <= tolerance:
                # the nearer side of the bin: before its first key or after its last
                after = acc + r["n"] - t < t - acc
                if h0 == h1:
                    done[t] = Splitter(h0, k1 + 1, acc + r["n"]) if after else Splitter(h0, k0, acc)
                else:
                    done[t] = Splitter(h1 + 1, _LEAST, acc + r["n"]) if after else Splitter(h0, _LEAST, acc)
                del open_[t]
            elif h0 == h1:
                open_[t] = (("_k", k0, k1, h0, h1), (k0, k1), acc, r["n"])
            else:
                open_[t] = (("_h", h0, h1, h0, h1), ids, acc, r["n"])
    return [done[t] for t in targets]


def _shard_of(found: list[Splitter]) -> Column:
    out = F.lit(0)
    for s in found:
        past = (F.col("_h") > F.lit(s.h)) | ((F.col("_h") == F.lit(s.h)) & (F.col("_k") >= F.lit(s.id))) if s.h < 2**63 else F.lit(False)
        out = out + F.when(past, 1).otherwise(0)
    return out.cast("int")


def write_shards(docs: DataFrame, path: str, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", tolerance: float = TOLERANCE) -> DataFrame:
    """Write the rows of ``docs`` under ``path``/shard=K/; doc_id, size, text_crc32, shard and slot of every row, as read back.

    Each file row holds the document as the struct ``row``. Bytes (size: UTF-8 bytes of
    the text plus 1) of the shards differ by no more than one row and ``tolerance`` of a
    shard; ``slot`` counts from 0 without gaps in each.
    """
    spark = docs.sparkSession
    rows = stage(docs.select(*_keys(id_col, text_col)), "shard-keys")
    total = rows.agg(F.sum("size")).first()[0] or 0
    targets = [total * k // shards for k in range(1, shards)]
    found = splitters(rows, sorted(set(targets)), int(total / shards * tolerance)) if total else []
    at = dict(zip(sorted(set(targets)), found))
    parts = max(1, -(-total // shards // PART_BYTES))
    whole = F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in docs.columns)).alias("row")
    keyed = docs.select(whole, *_keys(id_col, text_col)).withColumn("shard", _shard_of([at[t] for t in targets] if total else []))
    part = (F.col("shard") * parts + F.pmod(F.xxhash64("_h", "_k"), F.lit(parts))).cast("int")
    (
        keyed.repartitionById(shards * parts, part).sortWithinPartitions("_h", "_k")
        .select("row", "shard", F.monotonically_increasing_id().alias("_at")).write.partitionBy("shard").parquet(path)
    )
    return read_shards(spark, path, docs, id_col, text_col)


def read_shards(spark: SparkSession, path: str, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row under ``path``, whose documents are like ``docs``."""
    kept = spark.read.schema(StructType([StructField("row", docs.schema), StructField("_at", LongType()), StructField("shard", IntegerType())])).parquet(path)
    of = lambda c: F.col("row").getField(c)
    text = F.coalesce(of(text_col), F.lit(""))
    part = F.shiftright("_at", 33).alias("_part")
    runs = kept.groupBy("shard", part).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    # one row for each partition of the exchange: grows with the partitions, not the rows
    before = F.sum("_n").over(Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("shard", "_part", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    told = kept.select(of(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), "shard", "_at", part)
    return told.join(runs, ["shard", "_part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("_at") + F.col("_shift")).alias("slot"))


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", tolerance: float = TOLERANCE) -> DataFrame:
    """What :func:`write_shards` gives, with the shards in the shared folder."""
    return write_shards(docs, fresh_path(docs.sparkSession, "shards"), shards, id_col, text_col, tolerance)
