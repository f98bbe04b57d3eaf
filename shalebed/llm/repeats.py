"""Substring dedup: repeated passages are confirmed, compiled to automata and located.

A window is 50 consecutive words of one document. Every window is sampled by its
minimiser, the phrase of 12 words with the smallest hash in it; equal windows have equal
minimisers. A phrase that is a minimiser in two different texts is confirmed as recurring,
and each document keeps one place of each such phrase. Each slice of documents is a
shard: the words at those places are compiled into one Aho-Corasick automaton, and the
slice's documents are streamed through it, which locates every occurrence. Only windows
around an occurrence can recur; they are compared over all documents by 96 bits of hash,
and windows whose first document is an earlier one are removed.

An automaton over all phrases would have to meet all documents, shard by shard: work
that grows with the square of the corpus. A phrase is instead sent only to the shards
whose documents hold it, which finds the same places.

Exact copies are settled first: a copy loses every word to the first document of its
text, so that only one document of a group of copies is searched.

Defined results: a null text or one without words has n_words 0 and the checksum of no
bytes; texts under 50 words lose nothing; rows that repeat an id lose nothing to each
other; ties go to the smaller id; very long texts are searched whole; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import stage
from .words import flat_hashes, mixed, rolling, slices, window_starts, words
from .workers import alone

WINDOW = 50
PHRASE = 12
#: Phrases of one automaton at most; a slice with more (one very long text) has several.
SHARD = 1 << 16


#: Told apart from the words' own hashes, so that a window's two hashes are independent.
_SECOND = np.uint64(0xD6E8FEB86659FD93)


def minimisers(flat: np.ndarray, off: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each document the distinct hashes of the phrases that are smallest in one of its windows, and a place of each."""
    h = rolling(flat, PHRASE)
    start, doc = window_starts(off, WINDOW)
    out = [(np.zeros(0, np.uint64), np.zeros(0, np.int32))] * (len(off) - 1)
    if not len(start):
        return out
    width = WINDOW - PHRASE + 1
    low, at, done = h, np.arange(len(h)), 1  # minima of growing runs and their places, by doubling
    while 2 * done <= width:
        at = np.where(low[done:] < low[:-done], at[done:], at[:-done])
        low, done = h[at], 2 * done
    left, right = at[start], at[start + width - done]
    at = np.where(h[right] < h[left], right, left)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    at, doc = at[new], doc[new]
    for i, x in zip(np.unique(doc), np.split(at, np.flatnonzero(np.diff(doc)) + 1), strict=True):
        low, one = np.unique(h[x], return_index=True)
        out[i] = low, (x[one] - off[i]).astype(np.int32)
    return out


@alone("repeats")
def _phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, texts in slices(batch.column("_text")):
            got = minimisers(*flat_hashes([words(t) for t in texts]))
            take = pa.array(np.repeat(np.arange(start, start + len(texts)), [len(h) for h, _ in got]))
            h, at = (np.concatenate(x) for x in zip(*got, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(at), batch.column("_id").take(take), batch.column("_t").take(take)], ["h", "p", "_id", "_t"])


def located(docs: list[list[bytes]], known: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(flat word hashes, offsets, flag of each flat place at which a window around a known phrase starts).

    ``known``: a place of each phrase of a document; the automaton finds all others.
    """
    flat, off = flat_hashes(docs)
    open_ = np.zeros(len(flat) + 1, np.int64)
    at = np.concatenate([p + a for p, a in zip(known, off[:-1], strict=True)]).astype(np.int64)
    if not len(at):
        return flat, off, np.zeros(len(flat), bool)
    _, codes = np.unique(flat, return_inverse=True)
    codes = codes.ravel()
    for lo in range(0, len(at), SHARD):
        automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
        for phrase in codes[at[lo : lo + SHARD, None] + np.arange(PHRASE)].tolist():
            automaton.add_word(tuple(phrase))
        automaton.make_automaton()
        for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
            if b - a >= WINDOW:
                for end, n in automaton.iter(tuple(codes[a:b].tolist())):
                    p = a + end - n + 1
                    # windows that start here hold the whole phrase
                    open_[max(a, p + PHRASE - WINDOW)] += 1
                    open_[min(p, b - WINDOW) + 1] -= 1
    flag = np.cumsum(open_[:-1]) > 0
    start, _ = window_starts(off, WINDOW)
    ok = np.zeros(len(flat), bool)
    ok[start] = flag[start]
    return flat, off, ok


@alone("repeats")
def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        places = batch.column("places")
        for start, texts in slices(batch.column("_text")):
            docs = [words(t) for t in texts]
            flat, off, ok = located(docs, [places[start + i].values.to_numpy() for i in range(len(texts))])
            at = np.flatnonzero(ok)
            doc = np.searchsorted(off, at, side="right") - 1
            take = pa.array(start + doc)
            w = rolling(flat, WINDOW)[at].view(np.int64) if len(at) else np.zeros(0, np.int64)
            v = (rolling(mixed(flat ^ _SECOND), WINDOW)[at] >> np.uint64(32)).astype(np.uint32).view(np.int32) if len(at) else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(v), batch.column("_id").take(take), batch.column("_t").take(take), pa.array((at - off[doc]).astype(np.int32))], ["w", "v", "_id", "_t", "at"])


@alone("repeats")
def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for t, copy, at in zip(batch.column("_text").cast(pa.large_binary()), batch.column("copy").to_pylist(), batch.column("at"), strict=True):
            ws = words(t.as_py())
            gone = np.zeros(len(ws), bool)
            if copy and len(ws) >= WINDOW:
                gone[:] = True
            elif at.is_valid:
                edge = np.zeros(len(ws) + 1, np.int64)
                starts = at.values.to_numpy()
                np.add.at(edge, starts, 1)
                np.add.at(edge, starts + WINDOW, -1)
                gone = np.cumsum(edge[:-1]) > 0
            kept = b" ".join(w for w, g in zip(ws, gone.tolist(), strict=True) if not g)
            rows.append((len(ws), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode()))
        cols = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (the words left, joined by blanks) of every row."""
    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), text.alias("_text"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("_t"))
    slim = docs.select(F.col(id_col).cast("long").alias("_id"), F.md5(text.cast("binary")).alias("_m"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("_t")).where("_m is not null")
    slim = stage(slim, "repeat-texts")
    # written too, so that both sides of the join are dealt out anew and Spark can split a text that a third of all rows hold
    first = stage(slim.groupBy("_m").agg(F.min("_id").alias("first"), F.max("_id").alias("last")).where("first < last").select("_m", "first"), "repeat-copied")
    copies = slim.join(first, "_m").where("_id > first").select("_id", "_t").distinct().withColumn("copy", F.lit(True))
    found = stage(texts.mapInArrow(_phrases, "h long, p int, _id long, _t long"), "repeat-phrases")
    twice = found.groupBy("h").agg(F.min("_t").alias("a"), F.max("_t").alias("b")).where("a <> b").select("h")
    held = found.join(twice, "h", "left_semi").groupBy("_id", "_t").agg(F.collect_set("p").alias("places"))
    known = held.join(copies, ["_id", "_t"], "left_anti")
    # texts meet what is known of them once; from here on only those with a candidate phrase are carried
    open_ = stage(texts.join(known, ["_id", "_t"]).select("_id", "_t", "_text", "places"), "repeat-open")
    wins = stage(open_.mapInArrow(_windows, "w long, v int, _id long, _t long, at int"), "repeat-windows")
    # written, as above
    firsts = stage(wins.groupBy("w", "v").agg(F.min("_id").alias("lo"), F.max("_id").alias("hi")).where("lo < hi").select("w", "v", "lo"), "repeat-firsts")
    gone = wins.join(firsts, ["w", "v"]).where("_id > lo").groupBy("_id", "_t").agg(F.collect_set("at").alias("at"))
    fate = stage(gone.withColumn("copy", F.lit(False)).unionByName(copies.withColumn("at", F.lit(None).cast("array<int>"))), "repeat-fates")
    return texts.join(fate, ["_id", "_t"], "left").select("_id", "_text", "copy", "at").mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
