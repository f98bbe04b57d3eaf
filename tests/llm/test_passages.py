"""Repeated passages, decontamination and the pipeline against brute force."""

import hashlib
import random
import resource
from types import SimpleNamespace
import re

import numpy as np
import pyarrow as pa
import pytest
from odd import ODD, PROSE, documents

from pyspark.sql import functions as F

from shalebed.llm import decontaminate, repeats


def brute(texts, ids):
    docs = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    first = {}
    for i, d in zip(ids, docs, strict=True):
        for k in range(len(d) - 49):
            w = tuple(d[k : k + 50])
            first[w] = min(first.get(w, i), i)
    out = []
    for i, d in zip(ids, docs, strict=True):
        gone = {j for k in range(len(d) - 49) if first[tuple(d[k : k + 50])] < i for j in range(k, k + 50)}
        kept = " ".join(w for j, w in enumerate(d) if j not in gone)
        out.append((i, len(d), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def test_repeats_against_brute_force(spark):
    rng = random.Random(5)
    pool = [[f"p{p}w{rng.randrange(300)}" for _ in range(rng.choice([49, 50, 51, 60, 130]))] for p in range(8)]
    texts = list(ODD) + [PROSE + " more", "x " * 120, "x " * 120 + "y", " ".join(["z"] * 49)]
    for d in range(60):
        out = [f"d{d}w{i}" for i in range(rng.randrange(0, 80))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(pool)
            at = rng.randrange(len(out) + 1)
            out[at:at] = p if rng.random() < 0.6 else p[rng.randrange(5) :]
        texts.append(rng.choice([" ", "\n", " \t"]).join(out))
    texts += texts[-5:]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in repeats.remove(documents(spark, texts, ids=ids)).collect())
    want = brute(texts, ids)
    assert got == want and sum(w[2] > 0 for w in want) > 15


@pytest.mark.parametrize("shard", [4, 1 << 16])
def test_the_automaton_locates_what_no_place_tells(monkeypatch, shard):
    monkeypatch.setattr(repeats, "SHARD", shard)
    rng = random.Random(6)
    pool = [[f"p{p}w{i}".encode() for i in range(60)] for p in range(3)]
    docs, known = [], []
    for d in range(12):
        doc, places = [f"d{d}w{i}".encode() for i in range(rng.randrange(60, 200))], []
        for p in pool[: 1 + d % 3]:
            for _ in range(3):
                at = rng.randrange(len(doc))
                doc[at:at] = p
        for p in pool[: 1 + d % 3]:  # one place of one phrase of each passage, if it is whole there
            for at in range(len(doc) - 11):
                if doc[at : at + 12] == p[20:32]:
                    places.append(at)
                    break
        docs.append(doc)
        known.append(np.array(places, np.int32))
    flat, off, flag = repeats.located(docs, known)
    told = {tuple(docs[d][p : p + 12]) for d in range(len(docs)) for p in known[d]}
    want = {(d, k) for d, doc in enumerate(docs) for k in range(len(doc) - 49) if any(tuple(doc[j : j + 12]) in told for j in range(k, k + 39))}
    assert {(d, int(p - off[d])) for d in range(len(docs)) for p in range(off[d], off[d + 1]) if flag[p]} == want
    # the places by themselves tell less
    assert len({(d, k) for d, doc in enumerate(docs) for p in known[d] for k in range(max(0, p - 38), min(p, len(doc) - 50) + 1)}) < len(want)


def test_repeats_of_odd_tables(spark):
    assert repeats.remove(documents(spark, [])).count() == 0
    got = repeats.remove(documents(spark, [PROSE, PROSE, PROSE], ids=[4, 4, 9])).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(4, 0), (4, 0), (9, 120)]


def test_lcs():
    rng = random.Random(1)
    for _ in range(50):
        a, b = ([rng.choice(b"abcd") for _ in range(rng.randrange(1, 12))] for _ in "ab")
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert decontaminate.lcs(decontaminate.bits(a), len(a), b) == t[-1][-1]


def test_leaks(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(900)]
    items = [[rng.choice(words) for _ in range(rng.randrange(20, 60))] for _ in range(30)]
    texts, want = list(ODD), set()
    for d in range(40):
        doc = [rng.choice(words) for _ in range(rng.randrange(50, 400))]
        if d % 3 == 0:
            i = rng.randrange(len(items))
            item = [w.upper() if rng.random() < 0.2 else w for k, w in enumerate(items[i]) if d % 2 or k % 7]  # whole, or a word in seven left out
            at = rng.randrange(len(doc))
            doc[at:at] = item
            want.add((len(texts), i))
        texts.append(" ".join(doc))
    bench = spark.createDataFrame([(i, " ".join(x), "clash") for i, x in enumerate(items)] + [(98, None, ""), (99, "", "")], "item_id long, text string, source string")
    got = decontaminate.leaks(documents(spark, texts), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    assert decontaminate.leaks(documents(spark, []), bench).count() == 0
    assert decontaminate.leaks(documents(spark, texts), bench.limit(0)).count() == 0


def test_leaks_of_many_items_against_brute_force(spark, monkeypatch):
    """Directions that no item shaped, as where items far outnumber them: a cosine by itself would lose some."""
    directions = np.random.default_rng(3).standard_normal((decontaminate.FEATURES, decontaminate.RANK)).astype(np.float32)
    monkeypatch.setattr(decontaminate, "fit", lambda corpus, benchmark: decontaminate.Directions(decontaminate.idf(corpus.unionByName(benchmark)), directions))
    rng = random.Random(8)
    words = [f"w{i}".encode() for i in range(1500)]
    items = [[rng.choice(words) for _ in range(rng.randrange(10, 30))] for _ in range(200)]
    docs = []
    for d in range(60):
        doc = [rng.choice(words) for _ in range(rng.randrange(200, 260))]
        item = items[rng.randrange(len(items))]
        at = rng.randrange(len(doc))
        doc[at:at] = item if d % 3 == 0 else [w for k, w in enumerate(item) if k % 4] if d % 3 == 1 else item[: int(0.8 * len(item))]
        docs.append(doc)
    want = set()
    for d, doc in enumerate(docs):
        for lo in range(0, len(doc), decontaminate.CHUNK):
            near = set(doc[max(0, lo - 30) : lo + 94])
            for i, item in enumerate(items):
                n, end = len(item), decontaminate.answer(item)
                if len(near.intersection(item)) < 0.4 * n:
                    continue
                span = doc[max(0, lo - n) : lo + 2 * decontaminate.CHUNK + n]
                same = decontaminate.lcs(decontaminate.bits(item), n, span)
                if same >= 0.6 * n and (n >= decontaminate.SURE_WORDS and same >= decontaminate.SURE * n or decontaminate.lcs(decontaminate.bits(end), len(end), span) >= 0.5 * len(end)):
                    want.add((d, i))
    bench = spark.createDataFrame([(i, b" ".join(x).decode()) for i, x in enumerate(items)], "item_id long, text string")
    got = decontaminate.leaks(documents(spark, [b" ".join(d).decode() for d in docs]), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want) >= 40
    # the same in parts of few chunks
    monkeypatch.setattr(decontaminate, "CELLS", 4 * len(items))
    got = decontaminate.leaks(documents(spark, [b" ".join(d).decode() for d in docs] + [b" ".join(sum(docs, [])).decode()]), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got if r.doc_id < len(docs)} == want
    assert {r.item_id for r in got if r.doc_id == len(docs)} >= {i for _, i in want}


def test_parts_overlap():
    for n in (1, 31, 500, 1000, 1001, 5000):
        for most, pad in ((512, 96), (1024, 160)):
            words, held = list(range(n)), {}
            for part in decontaminate.parts(words, most, pad):
                assert len(part) <= most and part[0] % decontaminate.CHUNK == 0
                for w in part:
                    if (w < pad or w - part[0] >= pad) and (w >= n - pad or part[-1] - w >= pad):
                        held[w] = True
            assert len(held) == n


def test_a_long_text_and_many_items_in_bounded_memory():
    rng = random.Random(1)
    words = [f"w{i}" for i in range(20_000)]
    items = [(i, [rng.choice(words).encode() for _ in range(30)]) for i in range(4096)]
    text = [rng.choice(words) for _ in range(600_000)]
    text[300_000:300_030] = [w.decode() for w in items[7][1]]
    latent = decontaminate.Directions(np.ones(decontaminate.FEATURES), np.random.default_rng(1).standard_normal((decontaminate.FEATURES, 8)).astype(np.float32))
    shared = SimpleNamespace(value=(latent, items))
    search = decontaminate._search(shared, decontaminate.LCS, decontaminate.ANSWER)
    small = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["a b c"])], ["id", "text"])
    list(search(iter([small])))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    got = pa.Table.from_batches(search(iter([pa.RecordBatch.from_arrays([pa.array([5]), pa.array([" ".join(text)])], ["id", "text"])]))).to_pylist()
    assert [(r["doc_id"], r["item_id"]) for r in got] == [(5, 7)]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 700 * 1024


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(4)
    docs = [" ".join(rng.choice(["the", "cat", "that", "house", "with", "tree", "stone", "river"]) + str(rng.randrange(40)) for _ in range(120)) for _ in range(6)]
    bench = " ".join(f"item{i}" for i in range(40))
    texts = [docs[0], docs[0], docs[1] + " a@b.org", docs[2] + " " + bench, docs[3], None, "12 34", docs[4] + " end"]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, bench)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    frame = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = []
    for i, (name, f) in enumerate(corpus_pipeline.STAGES):
        out = f(spark, frame, str(tmp_path))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == frame.columns
            out.write.parquet(str(tmp_path / name))
            frame = spark.read.parquet(str(tmp_path / name))
            left.append(sorted(r.doc_id for r in frame.collect()))
    # null ids pass, repeats of id and text are one row, columns with the stages' own names are kept
    rows = [(None, docs[0] + " x", 1), (None, docs[5], 2), (3, docs[1], 3), (3, docs[1], 3), (3, docs[2] + " " + bench, 4)]
    odd = spark.createDataFrame([(*r, "p", 0.5) for r in rows], "doc_id long, text string, score int, lang_pred string, comp double")
    odd = corpus_pipeline.near_duplicates(spark, odd, str(tmp_path))
    assert sorted((r.doc_id or -1, r.score) for r in odd.collect()) == [(-1, 1), (-1, 2), (3, 3), (3, 4)]
    odd = corpus_pipeline.decontamination(spark, odd, str(tmp_path))
    assert sorted((r.doc_id or -1, r.score) for r in odd.collect()) == [(-1, 1), (-1, 2), (3, 3)]
    labelled = odd.withColumn("lang", F.lit("en"))
    assert corpus_pipeline.language_id(spark, labelled, str(tmp_path)).columns == labelled.columns
    assert corpus_pipeline.language_id(spark, labelled.limit(0), str(tmp_path)).count() == 0
    assert left == [[0, 1, 2, 3, 4, 7], [0, 2, 3, 4, 7], [0, 2, 4, 7], [0, 2, 4, 7]]
    assert "[EMAIL]" in {r.doc_id: r.text for r in frame.collect()}[2]
    assert {r.doc_id for r in out.collect()} == {0, 2, 4, 7}
