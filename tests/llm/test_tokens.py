"""Cached encoding against the tokenizer itself; packing, token files and language ID against brute force."""

import itertools
import math
import os
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from odd import ODD, PROSE, documents
from tokenizers import Tokenizer

from shalebed.llm import language, packing, token_files, tokens

TEXTS = [
    *ODD, "Hello  two blanks \n and\tit's  ", " lead", "trail ", "a \x1c b\x85c  d  e", "<|endoftext|> x<|endoftext|>", "\0 \0abc \0", "é ́x Ǆ İ Σας ΑΣ", "日本語 テキスト 123 4",
]


def whole(vocabulary, text):
    return LIBRARY[vocabulary].encode(text or "", add_special_tokens=False).ids


LIBRARY = {v: Tokenizer.from_file(tokens.resolve(v)) for v in ("byte_bpe_50k.json", "word_bpe_49k.json")}


@pytest.mark.parametrize("vocabulary", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_those_of_the_tokenizer(vocabulary):
    got = tokens.Encoder(vocabulary).encode(TEXTS)
    for t, x in zip(TEXTS, got, strict=True):
        assert np.frombuffer(x, "<i4").tolist() == whole(vocabulary, t), t


SPECIAL = ["a <|endoftext|> b", "<|endoftext|>", "x<|startoftext|>y <|endoftext|>z", "<|ENDOFTEXT|> <|endoftext |>"]


@pytest.mark.parametrize("vocabulary", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_special_tokens_are_those_of_the_library(vocabulary):
    got = tokens.Encoder(vocabulary).encode(TEXTS + SPECIAL)
    for t, x in zip(TEXTS + SPECIAL, got, strict=True):
        assert np.frombuffer(x, "<i4").tolist() == whole(vocabulary, t), t


@pytest.mark.parametrize("vocabulary", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_every_code_point_that_is_cut_by_rule(vocabulary):
    e = tokens.Encoder(vocabulary)
    points = [c for c in map(chr, [*range(1, 0xD800), *range(0xE000, 0x20000)]) if e.settled(c)]
    assert len(points) > 30_000
    texts = [f"{c} a{c}b 1{c}2 .{c}{c}. {c}" for c in points]
    want = LIBRARY[vocabulary].encode_batch_fast(texts, add_special_tokens=False)
    assert [x for x, w, g in zip(points, want, e.encode(texts), strict=True) if np.array(w.ids, "<i4").tobytes() != g] == []


def test_small_caches_give_the_same():
    for v in LIBRARY:
        e = tokens.Encoder(v, pieces=10)
        for _ in range(2):
            for i in range(0, len(TEXTS), 3):
                for t, x in zip(TEXTS[i : i + 3], e.encode(TEXTS[i : i + 3]), strict=True):
                    assert np.frombuffer(x, "<i4").tolist() == whole(v, t)


class Counted(dict):
    """Counts how often a key is asked for."""

    asked = 0

    def get(self, *a):
        Counted.asked += 1
        return super().get(*a)

    def __getitem__(self, key):
        Counted.asked += 1
        return super().__getitem__(key)


def looked_up(vocabulary):
    e, text = tokens.Encoder(vocabulary), "one two\nthree, four  five" if vocabulary.startswith("word") else "one two\nthree, four five"
    e.encode([text])
    e.kept, Counted.asked = Counted(e.kept), 0
    got = e.encode([text] * 500 + [None, "", "x <|endoftext|> y", " two"])
    assert got == e.encode([text]) * 500 + [b"", b""] + [np.array(whole(vocabulary, t), "<i4").tobytes() for t in ("x <|endoftext|> y", " two")]
    return Counted.asked


def test_a_word_of_a_slice_is_looked_up_once():
    assert looked_up("word_bpe_49k.json") < 50


def test_a_piece_of_a_slice_is_looked_up_once():
    assert looked_up("byte_bpe_50k.json") < 50


def test_an_unknown_file_is_encoded_whole(tmp_path):
    t = Tokenizer.from_file(tokens.resolve("byte_bpe_50k.json"))
    from tokenizers import normalizers

    t.normalizer = normalizers.Lowercase()
    t.save(str(tmp_path / "own.json"))
    e = tokens.Encoder(str(tmp_path / "own.json"))
    assert e.whole and [np.frombuffer(x, "<i4").tolist() for x in e.encode(TEXTS)] == [t.encode(x or "", add_special_tokens=False).ids for x in TEXTS]


def test_queries_read_special_tokens_as_the_library(spark, tmp_path):
    import corpus_pipeline

    from shalebed.llm import queries

    docs = documents(spark, SPECIAL)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    ids = {v: [Tokenizer.from_file(tokens.resolve(v)).encode(t, add_special_tokens=False).ids for t in SPECIAL] for v in (packing.VOCABULARY, token_files.VOCABULARY)}
    want = {i: len(x) + 1 for i, x in enumerate(ids[packing.VOCABULARY])}
    assert {r.doc_id: r.doc_tokens for r in queries.op5_packing(spark, str(tmp_path)).collect()} == want
    assert {r.doc_id: r.doc_tokens for r in corpus_pipeline.packed(spark, docs, str(tmp_path)).collect()} == want
    want = {i: zlib.crc32(np.array([*x, token_files.END], "<i4").tobytes()) for i, x in enumerate(ids[token_files.VOCABULARY])}
    assert {r.doc_id: r.ids_crc32 for r in queries.op8_token_files(spark, str(tmp_path)).collect()} == want


ENC = {v: tokens.Encoder(v) for v in ("byte_bpe_50k.json", "word_bpe_49k.json")}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "Ab", " ", "  ", "\n", "'s", "1", "é", "́", "!", " ", "\x1c", "\0", "ﬁ", "Σ"]), max_size=12).map("".join))
def test_ids_of_any_mix(text):
    for v, e in ENC.items():
        assert np.frombuffer(e.encode([text])[0], "<i4").tolist() == whole(v, text)


@pytest.mark.parametrize("n", [1, 2, 3, 1023, 1024, 1025, 5000])
def test_cuts(n):
    got = packing.cuts(n)
    assert [a for a, _ in got] == list(itertools.accumulate([0, *(m for _, m in got)]))[:-1] and sum(m for _, m in got) == n
    assert all(m & (m - 1) == 0 and m <= 1024 for _, m in got)


def test_packing(spark):
    got = packing.pack(documents(spark, TEXTS)).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
        assert r.length == len(r.ids) and r.offset == 0
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<i4").tobytes())
    for i, t in enumerate(TEXTS):
        rows = sorted(by[i], key=lambda r: r.start)
        assert [x for r in rows for x in r.ids] == [*whole(packing.VOCABULARY, t), 0]
        assert {r.doc_tokens for r in rows} == {len(whole(packing.VOCABULARY, t)) + 1}
    order = sorted(got, key=lambda r: r.sequence_id)
    assert len({r.sequence_id for r in got}) == len(got)
    assert [r.length for r in order] == sorted(r.length for r in got)
    assert packing.pack(documents(spark, [])).count() == 0
    assert packing.pack(documents(spark, ["a b", "a b"], ids=[1, 1])).count() == 4


@pytest.mark.parametrize("encoding", ["delta", "dictionary"])
def test_token_files(spark, tmp_path, encoding):
    import pyarrow.parquet as pq

    path = str(tmp_path / "t")
    ids = [(i * 7) % len(TEXTS) for i in range(len(TEXTS))]
    token_files.write(documents(spark, TEXTS, ids=ids), path, encoding=encoding)
    by = {i: [*whole(token_files.VOCABULARY, t), 1] for i, t in zip(ids, TEXTS, strict=True)}
    at = dict(zip(sorted(by), itertools.accumulate([0, *(len(by[i]) for i in sorted(by))]), strict=False))
    want = sorted((i, at[i], len(x), zlib.crc32(np.array(x, "<i4").tobytes())) for i, x in by.items())
    assert sorted(tuple(r) for r in token_files.checksums(spark, path).collect()) == want
    assert sorted(tuple(r) for r in token_files.index(spark, path).select("doc_id", "start", "n_tokens").collect()) == [w[:3] for w in want]
    assert {r.doc_id: r.ids for r in token_files.read(spark, path, [3, 5]).collect()} == {3: by[3], 5: by[5]}
    kinds = set()
    for f in (tmp_path / "t").glob("*.parquet"):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            c = next(c for c in map(meta.row_group(g).column, range(meta.num_columns)) if c.path_in_schema.startswith("ids."))
            kinds |= set(c.encodings)
            assert c.has_offset_index
    assert ("DELTA_BINARY_PACKED" if encoding == "delta" else "RLE_DICTIONARY") in kinds


def test_token_files_of_odd_tables(spark, tmp_path):
    token_files.write(documents(spark, []), str(tmp_path / "none"))
    assert token_files.checksums(spark, str(tmp_path / "none")).count() == 0
    token_files.write(documents(spark, ["a", "b", None], ids=[2, 2, None]), str(tmp_path / "ties"))
    assert sorted(r.start for r in token_files.checksums(spark, str(tmp_path / "ties")).collect()) == [0, 1, 3]


def test_forward_sums_all_segmentations():
    known, longest = language.pieces(language.VOCABULARY)
    rng = np.random.default_rng(1)
    probs = rng.random((len(known) + 1, 2)) * 1e-3
    m = language.Model(language.VOCABULARY, ["a", "b"], probs)
    for word in ("the", "ation", "ñu", "☃a"):
        whole_ = "▁" + word
        total = np.zeros(2)
        for cut in itertools.product([0, 1], repeat=len(whole_) - 1):
            at = [0, *(i + 1 for i, c in enumerate(cut) if c), len(whole_)]
            parts = [whole_[a:b] for a, b in itertools.pairwise(at)]
            if all(p in known or len(p) == 1 for p in parts):
                total += np.prod([probs[known.get(p, -1)] for p in parts], axis=0)
        assert np.allclose(m.word(word), np.log(total))


EN = "the cat sat on the mat and then the other cat came in with the thing"
FR = "le chat est sur la table et puis une autre chose vient avec les enfants"


def test_language(spark):
    texts = [EN, FR, EN + " again", FR + " encore", None, "", "12 !!", "les enfants et la table", "the other thing and the mat", EN * 500]
    langs = ["en", "fr", "en", "fr", "en", None, None, None, None, None]
    docs = documents(spark, texts, langs=langs)
    model = language.fit(docs)
    assert model.langs == ["en", "fr"]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(docs, model, ["doc_id", "shard"]).collect()}
    assert "shard" in language.predict(docs, model, ["doc_id", "shard"]).columns
    assert [got[i][0] for i in range(len(texts))] == ["en", "fr", "en", "fr", "und", "und", "und", "fr", "en", "en"]
    assert all(0 <= s <= 1 and not math.isnan(s) for _, s in got.values())
    none = language.fit(documents(spark, [PROSE], langs=[None]))
    assert {r.lang_pred for r in language.predict(docs, none).collect()} == {"und"}
    assert language.predict(documents(spark, []), model).count() == 0


def test_held_out_rule(spark):
    ids = [r.doc_id for r in documents(spark, ["x"] * 40).where(language.held_out()).collect()]
    assert ids == [i for i in range(40) if zlib.crc32(str(i).encode()) % 4 == 2]


def test_no_letter_is_und():
    known, _ = language.pieces(language.VOCABULARY)
    m = language.Model(language.VOCABULARY, ["a", "b"], np.full((len(known) + 1, 2), 1e-4))
    for t in ("½ ②", "ⅷ ² 12", "¿! — “”", "_", "\u0301"):
        assert m.text(t) == ("und", 0.0), t
    assert m.text("1é")[0] == "a"  # a tie goes to the first


def test_long_words_are_summed_like_short_ones(monkeypatch):
    known, _ = language.pieces(language.VOCABULARY)
    m = language.Model(language.VOCABULARY, ["a", "b"], np.random.default_rng(2).random((len(known) + 1, 2)) * 1e-3)
    words = ["abcde" * 30, "ation" * 7, "日本語テキスト" * 40, "x", "thé" * 33]

    def plain(word):
        text, longest = "▁" + word, language.pieces(language.VOCABULARY)[1]
        out = []
        for lang in range(2):
            alpha, log = [1.0], 0.0
            for e in range(1, len(text) + 1):
                ends = language.arcs(text[:e], known, longest)[-1] if e <= longest else language.arcs(text[e - longest : e], known, longest)[-1]
                base = max(0, e - longest)
                alpha.append(sum(alpha[base + a] * m.probs[i, lang] for a, i in ends))
                top = alpha[-1]
                alpha, log = [x / top for x in alpha], log + math.log(top)
            out.append(log)
        return out

    want = [plain(w) for w in words]
    assert np.allclose(m.logs(words), want)
    monkeypatch.setattr(language, "TOGETHER", 48)
    assert np.allclose(m.logs(words), want)


def test_a_word_of_two_million_letters_in_bounded_memory():
    import resource

    known, _ = language.pieces(language.VOCABULARY)
    m = language.Model(language.VOCABULARY, ["a", "b"], np.full((len(known) + 1, 2), 1e-4))
    m.text("warm")
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert m.text("ab" * 1_000_000)[0] == "a"
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200 * 1024


def test_sample_is_never_empty_and_is_exact(spark):
    docs = documents(spark, [EN, FR] * 30, langs=["en", "fr"] * 30)
    assert language.fit(docs, sample=1, rounds=1).langs in (["en"], ["fr"])
    words = language.fit(docs, sample=60, rounds=1)
    assert words.langs == ["en", "fr"] and np.isclose(words.probs[:-1].sum(0), 1, atol=1e-3).all()


def test_clashing_names(spark):
    docs = documents(spark, [EN, FR], langs=["en", "fr"])
    model = language.fit(docs)
    clash = docs.selectExpr("doc_id", "text", "1 as lang_pred", "2 as `a.b`", "3 as score")
    assert language.predict(clash, model).columns == ["doc_id", "text", "a.b", "lang_pred", "score"]
    got = language.predict(clash, model, out=("x", "y")).collect()
    assert [(r.lang_pred, r["a.b"], r.score, r.x) for r in got] == [(1, 2, 3, "en"), (1, 2, 3, "fr")]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the driver's tables")
def test_query_is_right_on_held_out_rows(spark):
    from shalebed.llm import queries

    got = queries.op1_language_id(spark, "/root/testdata/sf0.01")
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    want = {r.doc_id: r.lang for r in queries.documents(spark, "/root/testdata/sf0.01").select("doc_id", "lang").collect()}
    rows = [r for r in got.collect() if r.held_out and want[r.doc_id] is not None]
    assert len(rows) > 100 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang_pred == want[r.doc_id] for r in rows) >= 0.98 * len(rows)


def test_language_is_fitted_on_all_labelled_rows(spark):
    from pyspark.sql import functions as F

    docs = documents(spark, [f"word number{i % 50}" for i in range(3200)])
    order = docs.selectExpr("doc_id", "xxhash64('sample', doc_id) h").orderBy("h").collect()
    late = [r.doc_id for r in order[3100:]]
    model = language.fit(docs.withColumn("lang", F.when(F.col("doc_id").isin(late), "fr").otherwise("en")), rounds=1)
    assert model.langs == ["en", "fr"]


def test_expected_counts_against_all_segmentations():
    known, longest = language.pieces(language.VOCABULARY)
    rng = np.random.default_rng(5)
    probs = rng.random((len(known) + 1, 2)).astype(np.float32) ** 8 + np.float32(1e-12)
    model = language.Model(language.VOCABULARY, ["a", "b"], probs)
    held, counts = ["▁the", "▁und", "▁größer", "▁x\u0378y", "▁", "▁nation"], np.array([2.0, 1, 3, 1, 5, 4])
    want = np.zeros(len(probs))
    for word, n in zip(held, counts.tolist(), strict=True):
        ways = [((), 1.0)]
        done = []
        while ways:
            cut, p = ways.pop()
            at = sum(size for _, size in cut)
            if at == len(word):
                done.append((cut, p))
                continue
            ends = [(known[word[at:e]], e - at) for e in range(at + 1, min(len(word), at + longest) + 1) if word[at:e] in known]
            if not any(size == 1 for _, size in ends):
                ends.append((-1, 1))
            ways += [((*cut, end), p * float(probs[end[0], 1])) for end in ends]
        for cut, p in done:
            for i, _ in cut:
                want[i] += n * p / sum(q for _, q in done)
    assert np.allclose(language.expected(model, 1, held, counts), want, rtol=1e-9)
