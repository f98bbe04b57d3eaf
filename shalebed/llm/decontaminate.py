"""Benchmark decontamination by latent semantic retrieval.

Passages (64 words, every 32) are TF-IDF vectors over hashed words. Their latent
directions come from a randomised SVD whose two products with the passage matrix are
computed by Spark tasks: over all passages of the benchmark and a bounded sample of
passages of the corpus. The rank is fixed while the benchmark grows, so no cosine decides
what is looked at: candidates are all places of all documents that hold enough of an
item's rarest words, a sieve that no match can fail. They are confirmed by the longest
common subsequence of their words, and by the answer (an item's last words) being there
too, unless most of a long item is; of the places that match, the one nearest to the item by cosine is reported.

A place is a passage of two chunks and as many words as the item has on either side. Of
all places at the chunks of all documents, those that match are found without exception.

Document frequencies are counted over all documents. The benchmark is the query set: it
is taken in blocks of ``BLOCK`` items, each of which is sent to the tasks; a block's size
is bounded, so any number of items may be asked.

Words are lower-cased (A-Z) runs between ASCII blanks, stripped of ASCII signs.

Defined results: null or empty texts and items match nothing; repeated rows and items
are each reported; of places that tie in cosine the first counts; very long texts are
searched whole, in overlapping parts of bounded size; empty tables give no rows; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .staging import stage
from .words import slices
from .workers import alone

FEATURES = 1 << 15
RANK = 96
CHUNK = 32
#: Expected corpus passages that the directions are fitted on, beside all of the benchmark's; of ``LEAST_DOCS`` documents at least.
SAMPLE, LEAST_DOCS = 20_000, 64
#: Tasks of the fit, whose sample is bounded.
FIT_TASKS = 8
#: Weight of the corpus passages in the fit: the directions have to tell items apart first.
CORPUS_WEIGHT = 0.1
BLOCK = 4096
#: Share of an item's words, among its rarest, that must stand in a passage before the subsequence is looked for.
RARE = 0.25
#: Share of an item's words that must stand in a passage in order, and of its answer.
LCS = 0.6
ANSWER = 0.5
#: Share of an item's words in order from which its answer isn't asked for any more, and words that such an item has at least.
SURE, SURE_WORDS = 0.75, 20
#: Chunks x items whose hits are counted together: longer texts are searched in overlapping parts.
CELLS = 1 << 20
_LOWER = bytes(range(256)).lower()
_SIGNS = bytes(i for i in range(33, 128) if not chr(i).isalnum())


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_LOWER, _SIGNS).split()


def features(docs: list) -> np.ndarray:
    """The feature of every word of all documents, end to end."""
    h = np.fromiter(map(xxh3_64_intdigest, chain.from_iterable(docs)), np.uint64, sum(map(len, docs)))
    return (h % np.uint64(FEATURES)).astype(np.int64)


def passages(words: list[bytes]) -> list[list[bytes]]:
    """Windows of two chunks; the last one ends with the text."""
    return [words[i : i + 2 * CHUNK] for i in range(0, max(1, len(words) - CHUNK), CHUNK)] if words else []


def bits(words: list[bytes]) -> dict[bytes, int]:
    """The places of each word, as the bits of one integer."""
    where: dict[bytes, int] = {}
    for i, w in enumerate(words):
        where[w] = where.get(w, 0) | 1 << i
    return where


def lcs(where: dict[bytes, int], n: int, b: list[bytes]) -> int:
    """Length of the longest common subsequence of n words (as :func:`bits`) and ``b``, bit-parallel."""
    full = (1 << n) - 1
    v = full
    for w in b:
        if w in where:
            u = v & where[w]
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def rarest(words: list[bytes], weights: np.ndarray, least: float) -> tuple[set[int], int]:
    """Features of the item's rarest words, and how many such words a passage must hold.

    A passage with ``least`` of the words in order lacks at most the rest of them, so of
    any m more words than that rest it holds m. No match is lost.
    """
    spare = len(words) - math.ceil(least * len(words))
    m = min(max(1, int(RARE * len(words))), len(words) - spare)
    f = features([words])
    return set(f[np.argsort(-weights[f], kind="stable")[: spare + m]].tolist()), m


def answer(words: list[bytes]) -> list[bytes]:
    """The item's last fifth, four words at least."""
    return words[-max(4, len(words) // 5) :]


# --- document frequencies -----------------------------------------------------------------


@alone("decontaminate")
def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(FEATURES, np.int64), 0
    for batch in batches:
        for _, texts in slices(batch.column("text"), 1 << 20):
            held = [set(words_of(t)) for t in texts if t]
            n += len(held)
            doc = np.repeat(np.arange(len(held)), [len(ws) for ws in held])
            # two words of one document may share a feature
            both = np.sort(doc * FEATURES + features(held))
            df += np.bincount(both[np.diff(both, prepend=-1) > 0] % FEATURES, minlength=FEATURES)
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], ["f", "n"])


def idf(docs: DataFrame) -> np.ndarray:
    """Smoothed inverse document frequencies; to the driver come FEATURES + 1 numbers."""
    got = np.zeros(FEATURES + 1)
    for f, n in docs.select("text").mapInArrow(_frequencies, "f long, n long").groupBy("f").agg(F.sum("n")).collect():
        got[f] = n
    return np.log((got[-1] + 1) / (got[:-1] + 1)) + 1.0


# --- randomised SVD ------------------------------------------------------------------------


@dataclass
class Directions:
    idf: np.ndarray
    #: FEATURES x rank, each row scaled by the feature's idf
    directions: np.ndarray

    def project(self, docs: list[list[bytes]]) -> np.ndarray:
        """Unit vectors of word lists (zero for one without known words)."""
        if not docs:
            return np.zeros((0, self.directions.shape[1]), np.float32)
        out = np.stack([self.directions[features([d])].sum(0) for d in docs])
        return unit(out)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


_ROWS = 512  # features in one block of a product


def _product(shared):
    """Blocks of A^T (A X) over the passages of the task's texts."""

    @alone("decontaminate")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, x = shared.value
        got = np.zeros(x.shape)
        for batch in batches:
            for t, w in zip(batch.column("text").cast(pa.large_binary()), batch.column("weight").to_pylist(), strict=True):
                for p in passages(words_of(t.as_py())):
                    f, n = np.unique(features([p]), return_counts=True)
                    a = n * weights[f]
                    a *= w / max(np.linalg.norm(a), 1e-9)
                    got[f] += a[:, None] * (a @ x[f])
        blocks = [(i, got[i * _ROWS : (i + 1) * _ROWS].astype(np.float32).tobytes()) for i in range(FEATURES // _ROWS) if got[i * _ROWS : (i + 1) * _ROWS].any()]
        yield pa.RecordBatch.from_arrays([pa.array([b[0] for b in blocks], pa.int32()), pa.array([b[1] for b in blocks], pa.binary())], ["block", "part"])

    return run


def _sum(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.sum([np.frombuffer(p, np.float32).astype(np.float64) for p in pdf["part"]], axis=0)
    return pd.DataFrame({"block": [pdf["block"].iloc[0]], "part": [total.astype(np.float32).tobytes()]})


def fit(corpus: DataFrame, benchmark: DataFrame, rank: int = RANK, sample: int = SAMPLE, rounds: int = 2) -> Directions:
    """Directions of the passages of ``benchmark`` and a sample of ``corpus`` (columns id, text)."""
    spark = corpus.sparkSession
    weights = idf(corpus.unionByName(benchmark))
    chars = corpus.agg(F.sum(F.length("text"))).first()[0] or 0
    share = min(1.0, sample * CHUNK * 6 / max(1, chars))
    hashed = corpus.withColumn("_h", F.shiftrightunsigned(F.xxhash64(F.lit("svd"), "id"), 2))
    least = hashed.select("_h").orderBy("_h").limit(LEAST_DOCS).agg(F.max("_h")).first()[0]
    drawn = hashed.where(F.col("_h") <= max(int(share * 2**62), least or 0))
    fitted = drawn.select("text", F.lit(CORPUS_WEIGHT).alias("weight")).unionByName(benchmark.select("text", F.lit(1.0).alias("weight")))
    # written once and met by few tasks: each task of a product gives a matrix, however few passages it has
    fitted = stage(fitted, "svd-passages").coalesce(FIT_TASKS)
    x = np.random.default_rng(7).standard_normal((FEATURES, rank + 8))
    for _ in range(rounds):
        x, _ = np.linalg.qr(x)
        parts = fitted.mapInArrow(_product(spark.sparkContext.broadcast((weights, x))), "block int, part binary")
        # a block meets one part from each task over a bounded sample
        y = np.zeros_like(x)
        for i, b in parts.groupBy("block").applyInPandas(_sum, "block int, part binary").collect():
            y[i * _ROWS : (i + 1) * _ROWS] = np.frombuffer(b, np.float32).reshape(_ROWS, -1)
        x = y
    u, _, _ = np.linalg.svd(x, full_matrices=False)
    return Directions(weights, (u[:, :rank] * weights[:, None]).astype(np.float32))


# --- search --------------------------------------------------------------------------------


def by_chunks(flat: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of texts of these sizes as rows of ``CHUNK``, filled up with ``FEATURES``; the text of each row."""
    n = -(-size // CHUNK)
    out = np.full(int(n.sum()) * CHUNK, FEATURES)
    out[np.arange(len(flat)) + np.repeat((np.cumsum(n) - n) * CHUNK - (np.cumsum(size) - size), size)] = flat
    return out.reshape(-1, CHUNK), np.repeat(np.arange(len(size)), n)


def hits(chunks: np.ndarray, items: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """How many words of each chunk have a feature of each of n items; items[first[f] : first[f + 1]] have feature f."""
    many = np.diff(first)[chunks]
    at, col = np.nonzero(many)
    m = many[at, col]
    inner = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
    which = items[np.repeat(first[chunks[at, col]], m) + inner]
    return np.bincount(np.repeat(at, m) * n + which, minlength=len(chunks) * n).reshape(len(chunks), n)


def parts(words: list[bytes], most: int, pad: int) -> Iterator[list[bytes]]:
    """``words`` in parts of up to ``most``, in whole chunks, that overlap by 2 ``pad``: each place lies in one of them with ``pad`` words on both sides."""
    if len(words) <= most:
        yield words
        return
    step = (most - 2 * pad) // CHUNK * CHUNK
    for lo in range(0, len(words) - 2 * pad, step):
        yield words[lo : lo + most]


def _search(shared, least: float, least_answer: float):
    @alone("decontaminate")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        latent, items = shared.value
        queries = [(i, p) for i, (_, ws) in enumerate(items) for p in passages(ws)]
        q = latent.project([p for _, p in queries])
        owned = np.searchsorted([i for i, _ in queries], np.arange(len(items) + 1))
        whole, ends = [bits(ws) for _, ws in items], [bits(answer(ws)) for _, ws in items]
        often = [({w: at.bit_count() for w, at in where.items()}.__getitem__, frozenset(where).intersection) for where in whole]
        found = [rarest(ws, latent.idf, least) for _, ws in items]
        need = np.array([m for _, m in found], np.int64)
        rare = np.array([(f, i) for i, (fs, _) in enumerate(found) for f in sorted(fs)], np.int64).reshape(-1, 2)
        rare = rare[np.argsort(rare[:, 0], kind="stable")]
        starts = np.searchsorted(rare[:, 0], np.arange(FEATURES + 2))
        filled = np.concatenate([latent.directions, np.zeros((1, latent.directions.shape[1]), np.float32)])
        reach = np.array([-(-len(ws) // CHUNK) for _, ws in items], np.int64)
        pad = CHUNK * (int(reach.max(initial=0)) + 2)
        most = CHUNK * max(4, CELLS // max(1, len(items))) + 2 * pad

        def matched(docs: list[list[bytes]]) -> Iterator[tuple[int, int, float, float]]:
            """(document, item, cosine, share) of all places that match."""
            chunks, doc = by_chunks(features(docs), np.array([len(d) for d in docs], np.int64))
            if not len(chunks):
                return
            first = np.searchsorted(doc, np.arange(len(docs)))
            # rare words of each item by chunk, then within its reach of each passage (of neighbouring documents too: a few more)
            total = np.concatenate([np.zeros((1, len(items)), np.int64), np.cumsum(hits(chunks, rare[:, 1], starts, len(items)), 0)])
            at, places = np.arange(len(doc)), []
            for r in np.unique(reach):
                k = np.flatnonzero(reach == r)
                part = total[:, k]
                c, j = np.nonzero(part[np.minimum(at + 2 + r, len(doc))] - part[np.maximum(at - r, 0)] >= need[k])
                places += zip(c.tolist(), k[j].tolist(), strict=True)
            for c, i in places:
                d, words = int(doc[c]), items[i][1]
                lo = CHUNK * (c - int(first[d]))
                span = docs[d][max(0, lo - len(words)) : lo + 2 * CHUNK + len(words)]
                # no more words can stand in order than the item has of the words that stand there at all
                times, shared_with = often[i]
                if sum(map(times, shared_with(span))) < least * len(words):
                    continue
                same = lcs(whole[i], len(words), span)
                if same >= least * len(words) and (len(words) >= SURE_WORDS and same >= SURE * len(words) or lcs(ends[i], (m := len(answer(words))), span) >= least_answer * m):
                    # a passage of two chunks, and its first chunk alone for short items
                    one = filled[chunks[c]].sum(0)
                    both = one + filled[chunks[c + 1]].sum(0) if c + 1 < len(doc) and doc[c + 1] == d else one
                    yield d, i, float((unit(np.stack([one, both])) @ q[owned[i] : owned[i + 1]].T).max()), same / len(words)

        for batch in batches:
            best: dict[tuple[int, int], tuple[float, float]] = {}

            def search(rows: list[int], held: list[list[bytes]], best=best) -> None:
                for d, i, near, share in matched(held):
                    if (rows[d], i) not in best or near > best[rows[d], i][0]:
                        best[rows[d], i] = near, share

            rows, held, size = [], [], 0
            for start, texts in slices(batch.column("text"), 1 << 20) if queries else []:
                for k, t in enumerate(texts):
                    for part in parts(words_of(t), most, pad):
                        if held and size + len(part) > most:
                            search(rows, held)
                            rows, held, size = [], [], 0
                        rows.append(start + k)
                        held.append(part)
                        size += -(-len(part) // CHUNK) * CHUNK
            search(rows, held)
            found = [(r, items[i][0], near, share) for (r, i), (near, share) in sorted(best.items())]
            cols = list(zip(*found, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(cols[0], pa.int32())), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.float64())], ["doc_id", "item_id", "cosine", "lcs"])

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least: float = LCS, least_answer: float = ANSWER) -> DataFrame:
    """doc_id, item_id, cosine and lcs (share of the item's words) of each document and item found in it."""
    spark = docs.sparkSession
    corpus = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    asked = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(item_text).cast("string").alias("text")).where("text is not null")
    kind = corpus.dtypes[0][1]
    latent = fit(corpus, asked.select(F.col("id").cast(kind).alias("id"), "text"))
    out, block = None, []
    schema = f"doc_id {kind}, item_id long, cosine double, lcs double"

    def searched(items):
        return corpus.mapInArrow(_search(spark.sparkContext.broadcast((latent, items)), least, least_answer), schema)

    for r in asked.toLocalIterator():
        if ws := words_of(r["text"].encode()):
            block.append((r["id"], ws))
        if len(block) == BLOCK:
            out, block = (searched(block) if out is None else out.unionByName(searched(block))), []
    if block or out is None:
        out = searched(block) if out is None else out.unionByName(searched(block))
    return out
