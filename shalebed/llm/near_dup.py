"""Near duplicates: MinHash bands propose, odd sketches sieve, full shingle sets decide.

Documents with the same shingle set are one node. A node has up to ``SAMPLES`` MinHash
samples in bands; a band's samples hash to a bucket, and the samples fold into a parity
bitmap (odd sketch) of 256 bits: two nodes' XOR has few bits if their sets are alike.
The shape of the bands and the bits that may differ follow from the threshold
(:func:`shape`): a pair at the threshold shares no bucket with a probability of at most
``MISS``, and fails the sieve with one of at most ``SIEVED``; both fall quickly above it.

Links are found without listing the pairs of a bucket. First each bucket's most central
member (the one in the fullest buckets), its head, is compared with the others. Buckets that then still hold more
than one component are looked at again: members outside the head's component are
compared with every member of other components. In those of up to ``DENSE`` members a
join does that, with the sieve in its condition. Pairs that pass it are compared by the
parities of their whole sets (:func:`parities`), which bound from below how much they
differ, so no link is lost; full sets move only for pairs that are left. The members of
larger buckets meet in tiles of two blocks of bounded size each (:func:`_tiled`), with
their full sets, once for all buckets of one head: there a pair that isn't near costs a
few machine words, a link joins two components at once, and pairs of one component are
passed over. So each pair of a bucket is compared, or in one component already; the
components are those of comparing all pairs, after two rounds however large a group is.
Components grow from round to round: only new links, between the labels that are there
already, are followed.

Defined results: a document without words (or a null text) has no shingles and is
linked with nothing; one with fewer than five words has its whole sequence as its only
shingle; rows that repeat an id are one node, and rows without an id are each kept with
their text's links unsought; ties go to the smaller id; very long texts are shingled
whole; an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import Scratch
from .words import flat_hashes, mixed, rolling, slices, window_starts
from .workers import alone, caching

SHINGLE = 5
SAMPLES = 126
SKETCH_WORDS = 4
THRESHOLD = 85
#: Probabilities of losing a pair just at the threshold, by the bands and by the sieve.
MISS, SIEVED = 5e-5, 2e-5
#: A bucket's components are compared by a join if its members outside the head's component times all are this squared at most; others in tiles.
DENSE = 128
#: Bytes of full sets of a block of members that are compared in a tile, which holds two (a longer single set makes its own block).
BLOCK_BYTES = 8 << 20
#: Bits of the parities by which members of a tile are compared.
WIDE = 4096
#: Links up to which components are found in one task.
ONE_TASK = 1 << 20
#: Residues of ids by which texts are sieved before they are sent: the bound of that broadcast.
RESIDUES = 1 << 20

_rng = np.random.default_rng(20_240_601)
_A = _rng.integers(1, 2**63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, SAMPLES, dtype=np.uint64)


@lru_cache(None)
def shape(threshold: int) -> tuple[int, int, int]:
    """(bands, rows of a band, bits in which sketches may differ) for links of ``threshold`` percent."""
    if not 0 < threshold <= 100:
        raise ValueError("threshold is a percentage above 0")
    t = threshold / 100
    rows = max((r for r in range(1, 17) if (1 - t**r) ** (SAMPLES // r) <= MISS), default=1)
    bands = SAMPLES // rows
    n, size = bands * rows, 64 * SKETCH_WORDS
    # each of the samples that differ turns two bits over; weight[i]: probability of i set bits after that
    weight, over, bit = np.zeros(size + 1), np.zeros(size + 1), np.arange(size + 1)
    weight[0] = 1.0
    for differ in range(n + 1):
        over += math.comb(n, differ) * (1 - t) ** differ * t ** (n - differ) * weight
        for _ in range(2):
            up, down = weight * (size - bit) / size, weight * bit / size
            weight = np.concatenate([[0], up[:-1]]) + np.concatenate([down[1:], [0]])
    tail = np.concatenate([np.cumsum(over[::-1])[::-1][1:], [0]])
    return bands, rows, int(np.argmax(tail <= SIEVED))


def shingle_sets(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, end to end; len(texts) + 1 offsets."""
    docs = [(t or b"").lower().split() for t in texts]
    flat, off = flat_hashes(docs)
    place, doc = window_starts(off, SHINGLE)
    h = rolling(flat, SHINGLE)[place] if len(place) else np.zeros(0, np.uint64)
    n = np.diff(off)
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(short):
        own = np.array([mixed(rolling(flat[off[i] : off[i + 1]], int(n[i])) + np.uint64(n[i]))[0] for i in short], np.uint64)
        h, doc = np.concatenate([h, own]), np.concatenate([doc, short])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(texts)))]).astype(np.int64)


def signatures(h: np.ndarray, off: np.ndarray, n_bands: int, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(two set digests, bands, sketch words) of the non-empty sets, in order."""
    full = np.flatnonzero(np.diff(off))
    at = off[:-1][full]
    if not len(full):
        return np.zeros((0, 2), np.uint64), np.zeros((0, n_bands), np.uint64), np.zeros((0, SKETCH_WORDS), np.uint64)
    digest = np.stack([mixed(np.add.reduceat(mixed(h), at)), mixed(np.add.reduceat(mixed(h ^ np.uint64(0xABCDEF)), at))], 1)
    bands = np.zeros((len(full), n_bands), np.uint64)
    sketch = np.zeros((len(full), SKETCH_WORDS), np.uint64)
    rows = np.arange(len(full))
    for k in range(n_bands * n_rows):
        low = mixed(np.minimum.reduceat(h * _A[k] + _B[k], at) + np.uint64(k))
        bands[:, k // n_rows] = mixed(bands[:, k // n_rows] * np.uint64(0x9E3779B97F4A7C15) + low)
        bit = low >> np.uint64(56)
        sketch[rows, (bit >> np.uint64(6)).astype(np.int64)] ^= np.uint64(1) << (bit & np.uint64(63))
    return digest, bands, sketch


def parities(h: np.ndarray, off: np.ndarray) -> list[bytes]:
    """Of each set, which hashes modulo n are odd in number, as n bits: its size up to the next power of two (8 at least)."""
    size = np.diff(off)
    n = np.array([max(8, 1 << (k - 1).bit_length()) for k in size.tolist()], np.int64)
    at = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
    doc = np.repeat(np.arange(len(size)), size)
    place = at[doc] + (h & (n[doc] - 1).astype(np.uint64)).astype(np.int64)
    bits = np.packbits((np.bincount(place, minlength=int(at[-1])) & 1).astype(np.uint8), bitorder="little")
    return [bits[a:b].tobytes() for a, b in zip(at[:-1] // 8, at[1:] // 8, strict=True)]


def least_apart(x: bytes, y: bytes) -> int:
    """How many shingles are in one of two sets only, at least: each turns one bit over."""
    if len(x) < len(y):
        x, y = y, x
    n, bits = 8 * len(x), int.from_bytes(x, "little")
    while n > 8 * len(y):
        n //= 2
        bits = (bits >> n) ^ (bits & ((1 << n) - 1))
    return (bits ^ int.from_bytes(y, "little")).bit_count()


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _sign(n_bands: int, n_rows: int):
    @alone("near_dup")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in slices(batch.column("_text")):
                h, off = shingle_sets(texts)
                n = np.diff(off)
                digest, bands, sketch = signatures(h, off, n_bands, n_rows)
                where = np.cumsum(n > 0) - 1
                take = pa.array(where, mask=n == 0)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(bands) + 1) * n_bands, pa.int32()), _long(bands.ravel()))
                cols = [_long(digest[:, 0]), _long(digest[:, 1]), lists, *(_long(sketch[:, i]) for i in range(SKETCH_WORDS))]
                ids = batch.column("_id").slice(start, len(texts))
                yield pa.RecordBatch.from_arrays([ids, pa.array(n), *(c.take(take) for c in cols)], ["doc_id", "n_shingles", "d0", "d1", "bands", *_S])

    return run


_S = [f"s{i}" for i in range(SKETCH_WORDS)]


def sign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles and, where there are shingles, set digests d0 and d1, bands and sketch words."""
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(_sign(*shape(threshold)[:2]), "doc_id long, n_shingles long, d0 long, d1 long, bands array<long>, " + ", ".join(f"{s} long" for s in _S))


@alone("near_dup")
def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, texts in slices(batch.column("_text")):
            h, off = shingle_sets(texts)
            some = [batch.column(c).slice(start, len(texts)) for c in ("node", *_S)]
            told = [pa.array(np.diff(off)), pa.array(parities(h, off), pa.binary()), pa.array([h[a:b].tobytes() for a, b in zip(off[:-1], off[1:], strict=True)], pa.binary())]
            yield pa.RecordBatch.from_arrays([*some, *told], ["node", *_S, "size", "parity", "shingles"])


def _may_be(threshold: int):
    @alone("near_dup")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, n, m = (batch.column(c).to_pylist() for c in ("x", "y", "n", "m"))
            # with d shingles in one set only, the union has (n + m + d) / 2 and the intersection (n + m - d) / 2
            keep = [(100 + threshold) * max(abs(p - q), least_apart(a, b)) <= (100 - threshold) * (p + q) for a, b, p, q in zip(x, y, n, m, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _confirm(threshold: int):
    @alone("near_dup")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                # both are sorted and distinct
                both = np.sort(np.concatenate([x, y]))
                same = int((both[1:] == both[:-1]).sum())
                keep.append(100 * same >= threshold * (len(both) - same))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def full_sets(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, its sketch words, size, parities and shingle hashes (sorted, as bytes) of every node. texts: _id and _text."""
    held = _among(texts, "_id", nodes).join(nodes, F.col("_id") == F.col("node")).dropDuplicates(["node"])
    return held.select("node", *_S, "_text").mapInArrow(_sets, "node long, " + ", ".join(f"{s} long" for s in _S) + ", size long, parity binary, shingles binary")


def _among(rows: DataFrame, col: str, nodes: DataFrame) -> DataFrame:
    """``rows`` but those whose id in ``col`` has the residue of no node, which stay where they are.

    At most ``RESIDUES`` numbers are broadcast for that, however many nodes there are.
    """
    residue = lambda c: F.pmod(F.xxhash64(c), F.lit(RESIDUES))
    return rows.join(F.broadcast(nodes.select(residue("node").alias("_r")).distinct()), residue(col) == F.col("_r"), "left_semi")


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (a, b and more) with the sets x of a and y of b. Sets that no pair names aren't moved."""
    some = _among(sets, "node", pairs.select(F.col("a").alias("node")).union(pairs.select("b")))
    x, y = (some.select(F.col("node").alias(c), F.col("shingles").alias(s)) for c, s in (("a", "x"), ("b", "y")))
    return pairs.join(x, "a").join(y, "b")


def possible(pairs: DataFrame, sets: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The pairs (a, b: node ids) but those whose sizes or parities tell that they are no links; none that is one is lost."""
    x, y = (sets.select(F.col("node").alias(c), F.col("parity").alias(p), F.col("size").alias(n)) for c, p, n in (("a", "x", "n"), ("b", "y", "m")))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y", "n", "m").mapInArrow(_may_be(threshold), "a long, b long")


def confirmed(pairs: DataFrame, sets: DataFrame, scratch: Scratch, threshold: int = THRESHOLD) -> DataFrame:
    """The pairs (a, b: node ids) whose full shingle sets are alike enough. Sets are moved only for pairs that are :func:`possible`."""
    pairs = scratch.stage(possible(pairs, sets, threshold), "near-pairs")
    return _with_sets(pairs, sets).select("a", "b", "x", "y").mapInArrow(_confirm(threshold), "a long, b long")


# --- components ----------------------------------------------------------------------------


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node and comp of all links of one task."""
    held = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
    if not held:
        return
    a, b = (np.concatenate(x) for x in zip(*held, strict=True))
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        now = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(now, a, least)
        np.minimum.at(now, b, least)
        now = np.minimum(now, now[now])
        if (now == label).all():
            break
        label = now
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], ["node", "comp"])


def components(links: DataFrame, n: int, scratch: Scratch, one_task: int = ONE_TASK) -> DataFrame:
    """node, comp (smallest node reachable) of every node of ``links`` (a, b; n rows).

    Up to ``one_task`` links are followed by one task, more by minima of neighbours and pointer jumps.
    """
    if n <= one_task:
        return scratch.stage(links.select("a", "b").coalesce(1).mapInArrow(_joined, "node long, comp long"), "near-comp", kept=True)
    both = scratch.stage(links.select("a", "b").union(links.select("b", "a")).distinct(), "near-edges")
    comp = scratch.stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("comp")), "near-comp", kept=True)
    while True:
        near = both.join(comp, both["b"] == comp["node"]).groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("_near"))
        step = comp.join(near, "node").select("node", F.col("comp").alias("_was"), F.least("comp", "_near").alias("_c"))
        jump = comp.select(F.col("node").alias("_c"), F.col("comp").alias("_j"))
        now = scratch.stage(step.join(jump, "_c").select("node", F.least("_c", "_j").alias("comp"), (F.least("_c", "_j") != F.col("_was")).alias("_new")), "near-comp", kept=True)
        comp = now.select("node", "comp")
        if now.where("_new").isEmpty():
            return comp


def grown(comp: DataFrame | None, links: DataFrame, scratch: Scratch, one_task: int = ONE_TASK) -> DataFrame:
    """``comp`` (node, comp; None if there is none yet) after more links, of which only those between different labels are followed."""
    if comp is None:
        return components(links, links.count(), scratch, one_task)
    for c in ("a", "b"):
        label = comp.select(F.col("node").alias(c), F.col("comp").alias("_l"))
        links = links.join(label, c, "left").withColumn(c, F.coalesce("_l", c)).drop("_l")
    new = scratch.stage(links.where("a <> b").select("a", "b").distinct(), "near-labels")
    if not (n := new.count()):
        return comp
    moved = components(new, n, scratch, one_task)
    onto = moved.select(F.col("node").alias("comp"), F.col("comp").alias("_to"))
    kept = comp.join(onto, "comp", "left").select("node", F.coalesce("_to", "comp").alias("comp"))
    return scratch.stage(kept.unionByName(moved.join(comp, "node", "left_anti")), "near-comp", kept=True)


# --- search --------------------------------------------------------------------------------


def _apart(a: str, b: str):
    return sum((F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))) for s in _S[1:]), F.bit_count(F.col(f"{a}.s0").bitwiseXOR(F.col(f"{b}.s0"))))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, dense: int = DENSE, one_task: int = ONE_TASK, block: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (doc_id = component_id) of every row."""
    scratch = Scratch(docs.sparkSession)
    sieve = shape(threshold)[2]
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    signed = scratch.stage(sign(docs, id_col, text_col, threshold), "near-signs", kept=True)
    kinds = signed.where("n_shingles > 0 and doc_id is not null").groupBy("d0", "d1").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"), *(F.first(s).alias(s) for s in _S))
    kinds = scratch.stage(kinds, "near-nodes", kept=True)
    keys = scratch.stage(_shared(kinds.select("node", F.posexplode("bands").alias("i", "band")).select("node", F.xxhash64("i", "band").alias("key"))), "near-keys")
    sets = scratch.stage(full_sets(texts, kinds.select("node", *_S).join(keys, "node", "left_semi")), "near-sets")
    sketches = sets.select("node", *_S)
    rows = scratch.stage(_sketched(keys, sketches, sieve), "near-buckets")
    star = scratch.stage(confirmed(rows.where("near and node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct(), sets, scratch, threshold), "near-links")
    comp = grown(None, star, scratch, one_task)
    split = scratch.stage(_split(rows, comp), "near-rest")
    sizes = {r["big"] for r in split.select((F.col("work") > dense * dense).alias("big")).distinct().collect()}
    links = []
    if False in sizes:
        pairs = _across(split.where(F.col("work") <= dense * dense), sieve)
        links.append(scratch.stage(confirmed(pairs.distinct(), sets, scratch, threshold), "near-links"))
    if True in sizes:
        links.append(scratch.stage(_tiled(split.where(F.col("work") > dense * dense), sets, scratch, sieve, threshold, block), "near-links"))
    if links:
        comp = grown(comp, reduce(DataFrame.union, links), scratch, one_task)
    scratch.clear()
    ends = signed.select("doc_id", "n_shingles", "d0", "d1").join(kinds.select("d0", "d1", "node"), ["d0", "d1"], "left")
    out = ends.join(comp, "node", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "node", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _shared(rows: DataFrame) -> DataFrame:
    """key, node and n (members of the key) of the keys with more than one row."""
    full = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows.join(full, "key")


def _heads(keys: DataFrame) -> DataFrame:
    """The member of each bucket that is in the fullest buckets: the same one for as many buckets of a group as can be."""
    weight = keys.groupBy("node").agg(F.sum("n").alias("w"))
    return keys.join(weight, "node").groupBy("key").agg(F.max_by("node", F.struct("w", -F.col("node"))).alias("head"))


def _sketched(keys: DataFrame, sketches: DataFrame, sieve: int) -> DataFrame:
    """``keys`` with their heads, the node's sketch, and near: whether the head's passes the sieve."""
    x, y = sketches.alias("x"), sketches.alias("y")
    joined = keys.join(_heads(keys), "key").alias("k").join(x, F.col("k.node") == F.col("x.node")).join(y, F.col("k.head") == F.col("y.node"))
    return joined.select("k.*", *(F.col(f"x.{s}") for s in _S), (_apart("x", "y") <= sieve).alias("near"))


def _split(rows: DataFrame, comp: DataFrame) -> DataFrame:
    """``rows`` with comp, top (the head's component) and work (pairs to compare in the key), of the keys that hold several components."""
    placed = rows.drop("near").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    parts = placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("_m"), F.max(F.col("node") == F.col("head")).alias("_top"))
    # one component in all: nothing left to compare in the bucket
    split = parts.groupBy("key").agg(F.max(F.when(F.col("_top"), F.col("comp"))).alias("top"), (F.sum(F.when(F.col("_top"), 0).otherwise(F.col("_m"))) * F.sum("_m")).alias("work"), F.count(F.lit(1)).alias("_parts")).where("_parts > 1").select("key", "top", "work")
    return placed.join(split, "key")


def _across(split: DataFrame, sieve: int) -> DataFrame:
    """Pairs of one bucket but different components that pass the sieve."""
    x, y = split.where("comp <> top").alias("x"), split.alias("y")
    apart = (F.col("x.comp") != F.col("y.comp")) & ((F.col("y.comp") == F.col("y.top")) | (F.col("x.node") < F.col("y.node")))
    found = x.join(y, (F.col("x.key") == F.col("y.key")) & apart & (_apart("x", "y") <= sieve))
    return found.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def _tiled(split: DataFrame, sets: DataFrame, scratch: Scratch, sieve: int, threshold: int, block: int) -> DataFrame:
    """Links (a, b) between components of the members of ``split``, all buckets of one head together, as far as a tile needs them to join what is alike.

    A head's members are dealt into blocks of about ``block`` bytes of sets, those outside
    its component into the first ones. Each of these meets itself and every other block.
    """
    told = split.select("head", "node", "comp", (F.col("comp") != F.col("top")).alias("out")).distinct()
    members = scratch.stage(told.join(_among(sets, "node", told).select("node", "size"), "node"), "near-members")
    count = lambda out: F.ceil(F.coalesce(F.sum(F.when(F.col("out") == out, F.col("size") * 8)), F.lit(0)) / block)
    blocks = members.groupBy("head").agg(count(True).alias("n_out"), count(False).alias("n_own"))
    at = F.when(F.col("out"), F.pmod(F.xxhash64("node"), "n_out")).otherwise(F.col("n_out") + F.pmod(F.xxhash64("node"), "n_own"))
    dealt = members.join(blocks, "head").withColumn("at", at)
    meets = F.sequence(F.lit(0).cast("long"), F.when(F.col("out"), F.col("n_out") + F.col("n_own")).otherwise(F.col("n_out")) - 1)
    tiles = dealt.withColumn("other", F.explode(meets)).select("node", "head", "comp", F.least("at", "other").alias("lo"), F.greatest("at", "other").alias("hi"), (F.col("at") <= F.col("other")).alias("left"))
    held = tiles.join(_among(sets, "node", members).select("node", *_S, "shingles"), "node")
    return held.select("head", "lo", "hi", "left", "node", "comp", *_S, "shingles").groupBy("head", "lo", "hi").applyInArrow(_tile(sieve, threshold), "a long, b long")


def wide_parities(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """As :func:`parities`, but of ``WIDE`` bits for each set: a matrix of words."""
    out = np.zeros((len(off) - 1, WIDE // 64), np.uint64)
    for i in range(0, len(out), 256):
        part = off[i : i + 257]
        place = np.repeat(np.arange(len(part) - 1) * WIDE, np.diff(part)) + (h[part[0] : part[-1]] & np.uint64(WIDE - 1)).astype(np.int64)
        odd = (np.bincount(place, minlength=(len(part) - 1) * WIDE) & 1).astype(np.uint8)
        out[i : i + 256] = np.packbits(odd, bitorder="little").view(np.uint64).reshape(-1, WIDE // 64)
    return out


def _tile(sieve: int, threshold: int):
    apart = lambda x, y: np.bitwise_count(x ^ y).sum(-1, dtype=np.int64)

    def links(node: np.ndarray, comp: np.ndarray, left: np.ndarray, sketch: np.ndarray, h: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int]]:
        wide, size = wide_parities(h, off), np.diff(off)
        short = np.bitwise_xor.reduce(wide.reshape(len(wide), 8, -1), axis=1)
        label = np.unique(comp, return_inverse=True)[1]
        first, rest = np.flatnonzero(left), np.flatnonzero(~left)
        words = [np.ascontiguousarray(sketch[rest if len(rest) else first, k]) for k in range(SKETCH_WORDS)]
        for n, i in enumerate(first):
            # a block that meets itself: those that come later
            others, held = (rest, words) if len(rest) else (first[n + 1 :], [w[n + 1 :] for w in words])
            bits = sum(np.bitwise_count(w ^ sketch[i, k]) for k, w in enumerate(held[1:], 1)) + np.bitwise_count(held[0] ^ sketch[i, 0]).astype(np.uint16)
            j = others[(bits <= sieve) & (label[others] != label[i])]
            most = ((100 - threshold) * (size[j] + size[i])) // (100 + threshold)
            near = (np.abs(size[j] - size[i]) <= most) & (apart(short[j], short[i]) <= most)
            j, most = j[near], most[near]
            for k in j[apart(wide[j], wide[i]) <= most]:
                if label[k] != label[i]:
                    both = np.sort(np.concatenate([h[off[i] : off[i + 1]], h[off[k] : off[k + 1]]]))
                    same = int((both[1:] == both[:-1]).sum())
                    if 100 * same >= threshold * (len(both) - same):
                        label[label == label[k]] = label[i]
                        yield node[i], node[k]

    def run(tile: pa.Table) -> pa.Table:
        with caching("near_dup"):
            col = lambda c: tile.column(c).to_numpy()
            raw = [memoryview(x.as_buffer()) for x in tile.column("shingles")]
            off = np.concatenate([[0], np.cumsum([len(x) // 8 for x in raw])]).astype(np.int64)
            sketch = np.stack([col(s) for s in _S], 1).view(np.uint64)
            found = list(links(col("node"), col("comp"), col("left"), sketch, np.frombuffer(b"".join(raw), np.uint64), off))
        return pa.table([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


#: Kinds of rows of the index: a shingle that the head lacks, one of the head's that a node has, and those that it misses, all or as many as another's must meet.
LACKED, HELD, MISSED, MET = range(4)


def _prefixes(threshold: int):
    @alone("near_dup")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, xs, kinds, missing, weight, size = [], [], [], [], [], []
            for c, s, own in zip(batch.column("x"), batch.column("y"), batch.column("own").to_pylist(), strict=True):
                c, s = np.frombuffer(c.as_py(), np.uint64), np.frombuffer(s.as_py(), np.uint64)
                p = len(s) - -(-threshold * len(s) // 100) + 1
                inside = np.isin(s, c, assume_unique=True)
                lacked = s[~inside]
                a, k = len(lacked), len(s) - len(lacked)
                m = len(c) - k
                w = 100 * m + threshold * a
                rows = {LACKED: lacked[:p]}
                if a < p and 2 * threshold * k < 100 * len(c):
                    rows[HELD] = s[inside][: p - a]
                if a < p and 2 * k >= len(c):
                    missed = c[~np.isin(c, s, assume_unique=True)]
                    if not own:
                        rows[MISSED] = missed
                    rows[MET] = missed[: max(0, m + (-1 - w) // (100 + threshold) + 1)]
                for kind, x in rows.items():
                    xs.append(x)
                    kinds.append(np.full(len(x), kind, np.int32))
                n.append(sum(map(len, rows.values())))
                missing.append(m)
                weight.append(w)
                size.append(len(c))
            take = pa.array(np.repeat(np.arange(len(n)), n))
            cols = [batch.column(k).take(take) for k in ("a", "b", "comp", "own")]
            cols += [_long(np.concatenate([np.zeros(0, np.uint64), *xs])), pa.array(np.concatenate([np.zeros(0, np.int32), *kinds]))]
            cols += [pa.array(v, pa.int64()).take(take) for v in (missing, weight, size)]
            yield pa.RecordBatch.from_arrays(cols, ["head", "node", "comp", "own", "x", "kind", "missing", "weight", "size"])

    return run


def _indexed(members: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """head, node, comp, own (in the head's component), x (a shingle), kind, missing, weight and size (of the head's set).

    A node's shingles are ordered: first those that the head lacks, then the others, each
    by hash. Two sets of one order that are alike enough share one of their first
    n - t n + 1 shingles (t: threshold), so those that the head lacks are rows if they are
    among these (``LACKED``).

    Let C be the head's set, i a node that isn't linked with it, and let i and j share
    only shingles of C. Both have less than n - t n + 1 others then. Say each lacks m of
    C's shingles and has a others, and s of C's are missing in both. A link needs
    |C| - m_i - m_j + s >= t (|C| - s + a_i + a_j), and that i isn't linked with the head
    says m_i + t a_i > (1 - t) |C|; so (1 + t) s > m_j + t a_j. More than half of what j
    misses is missing in i: of all but the last s of j's missing shingles and one more
    (``MET``), at least one is among i's (``MISSED``). However many nodes have most
    shingles of the head, few share such a row.

    Where a node has less than half of C, what it misses is long; its first common
    shingles are rows instead (``HELD``), as they are of all that it may be linked with,
    which have t of the other's common shingles at least.
    """
    own = members.where("head = node").select("head", F.col("comp").alias("_c"))
    told = members.where("head <> node").join(own, "head", "left").withColumn("own", F.coalesce(F.col("comp") == F.col("_c"), F.lit(False)))
    pairs = told.select(F.col("head").alias("a"), F.col("node").alias("b"), "comp", "own")
    return _with_sets(pairs, sets).select("a", "b", "comp", "own", "x", "y").mapInArrow(_prefixes(threshold), "head long, node long, comp long, own boolean, x long, kind int, missing long, weight long, size long")


def _by_center(index: DataFrame, sketches: DataFrame, sieve: int, threshold: int) -> DataFrame:
    """Pairs that share only shingles of the head and may be links by :func:`_indexed`, through the sieve."""
    rows = index.where(F.col("kind") != LACKED).join(sketches, "node")
    # one of each pair is outside the head's component
    x, y = rows.where(~F.col("own") & (F.col("kind") != MET)).alias("x"), rows.where(F.col("kind") != MISSED).alias("y")
    may = (F.col("x.comp") != F.col("y.comp")) & (F.col("y.own") | (F.col("x.node") < F.col("y.node")))
    # no more can be missing in both than in one
    both = (100 + threshold) * F.least("x.missing", "y.missing") >= F.col("x.weight") + F.col("y.weight") - (100 - threshold) * F.col("x.size")
    fits = F.when(F.col("x.kind") == HELD, F.col("y.kind") == HELD).otherwise((F.col("y.kind") == MET) & both)
    found = x.join(y, (F.col("x.head") == F.col("y.head")) & (F.col("x.x") == F.col("y.x")) & may & fits & (_apart("x", "y") <= sieve))
    return found.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
