"""PII, licence templates, host rules and sharding against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from odd import ODD, PROSE, documents

from pyspark.sql import functions as F

from shalebed.llm import host_rules, licenses, pii, sharding

CARD = "4111 1111 1111 1111"
PII = [
    "mail a.b+c@x-y.co.uk, or @bad or q@nodot or z@a.b@c.d ok",
    "ip 1.2.3.4 and 999.1.1.1 and 1.2.3.4.5.6.7.8 and 0000255.1.1.1",
    f"card {CARD} and 4111-1111-1111-1112 and 12345678901234567890",
    "tel +49 (30) 123-4567. and +1 2 and +123456789012345678",
    "iban GB82 WEST 1234 5698 7654 32 but GB83 WEST 1234 5698 7654 32; ssn 123-45-6789, or 123-45-6780 and 1" * 1,
    "é" * 9 + "a@b.c" + "1" * 3000 + "a" * 3000,
    *ODD,
]


def brute_pii(t):
    t = t or ""
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and pii.luhn(d)]
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_pii_against_brute_force(spark):
    got = {r.doc_id: r for r in pii.digest(documents(spark, PII)).collect()}
    assert len(got) == len(PII)
    for i, t in enumerate(PII):
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in brute_pii(t))
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert got[i].spans.startswith(base)
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [Counter(k for k, _, _ in brute_pii(t))[k] for k in pii.BASE]
    assert "iban:5:32" in got[4].spans and got[4].spans.count("iban") == 1 and got[4].spans.count("national") == 2


def test_pii_redaction_and_struct(spark):
    docs = documents(spark, ["x a@b.c y", None, ""])
    assert [r.text for r in pii.redacted(docs).orderBy("doc_id").collect()] == ["x [EMAIL] y", None, ""]
    assert pii.redacted(docs).columns == docs.columns
    row = pii.scan(docs).orderBy("doc_id").first()
    assert (row.pii.base[0].kind, row.pii.base[0].start, row.pii.redacted) == ("email", 2, "x [EMAIL] y")


def test_luhn_and_mod97():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB83WEST12345698765432")


MIT = licenses.TEMPLATES["mit"].replace("[[", "").replace("]]", "")


def test_licence_phrases_and_templates(spark):
    mit = MIT.replace("{{6}}", "the authors or copyright holders")
    texts = ["Under the MIT license, under THE mit-license. CC-BY-NC!", mit, mit.replace("including the next paragraph", ""), mit.replace("merge", "fuse"), "apache license, version 2.0; under the mit", "x " * 30 + "Apache License Version 2", *ODD]
    got = [r.asDict() for r in licenses.scan(documents(spark, texts)).orderBy("doc_id").collect()]
    for r, t in zip(got, texts, strict=True):
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        at = {(i, label) for p, label in licenses.PHRASES.items() for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split()}
        starts = [i for i, _ in at]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(ws), len(at), min(starts, default=None), max(starts, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in at}))
        assert 0 <= r["score"] <= 1
    assert [r["labels"] for r in got[:6]] == ["cc-by-nc,mit", "mit", "mit", "", "apache-2", "apache-2"]
    assert got[1]["base_labels"] == "" and 0 < got[3]["score"] < 1


@pytest.mark.parametrize("label", sorted(licenses.TEMPLATES))
def test_each_template_accepts_its_own_wording_only(label):
    words = re.sub(r"\{\{\d+\}\}", "someone", re.sub(r"\[\[.*?\]\]", "", licenses.TEMPLATES[label], flags=re.S)).encode().split()
    a = licenses.automata()[label]
    assert a.match(words, 0)[0] == len(words)
    for i in (len(words) // 3, len(words) - 1):
        if words[i] != b"someone":
            assert a.match(words[:i] + [b"qqq"] + words[i + 1 :], 0)[0] == -1


def test_host_rules_counts_against_brute_force(spark):
    texts = ["a b c d e f a b c d e x", "k " * 11, *ODD, "é é é é é é\né é é é é é\n\n$$ #"]
    got = host_rules.counts(documents(spark, texts)).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        t = t or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        wins = Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
        cov = {j for i in range(len(ws) - 4) if wins[tuple(ws[i : i + 5])] > 1 for j in range(i, i + 5)}
        seen, dups = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dups += line in seen
                seen.add(line)
        assert tuple(r)[2:] == (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), dups, len(cov))


def test_host_verdicts(spark):
    bad, good = "q " * 40, PROSE
    texts = [bad] * 30 + [good] * 30 + [bad] + [good] * 200 + [None]
    sources = ["bad"] * 25 + ["good"] * 5 + ["good"] * 25 + ["bad"] * 5 + ["tiny"] + [f"h{i % 20}" for i in range(200)] + [None]
    got = host_rules.judge(documents(spark, texts, sources=sources)).orderBy("doc_id").collect()
    assert len(got) == len(texts)
    by = {}
    for r in got:
        by.setdefault(r.host, []).append(r)
    assert all(not r.kept for r in by["bad"]) and any(not r.base_failed for r in by["bad"])
    assert [r.kept for r in by["good"]] == [not r.base_failed for r in by["good"]]
    assert by[None][0].base_failed and not by[None][0].kept
    assert by["tiny"][0].base_failed and not by["tiny"][0].kept
    assert host_rules.judge(documents(spark, [])).count() == 0


def test_verdicts_against_brute_force(spark):
    rng = random.Random(6)
    bad, good, loud = "q " * 40, PROSE, "alpha # beta & gamma | " * 9 + PROSE
    sources = [rng.choice([*"abcdefghijkl", None]) for _ in range(500)]
    share = {h: rng.random() for h in set(sources)}
    texts = [bad if rng.random() < share[h] ** 2 else loud if rng.random() < 0.2 else good for h in sources]
    rows = host_rules.judge(documents(spark, texts, sources=sources)).collect()
    fails = {
        "few_words": lambda r: r.n_words < 10, "repeats": lambda r: 100 * r.n_repeat_words > 20 * r.n_words, "symbols": lambda r: 10 * r.n_symbols > r.n_words,
        "long_words": lambda r: r.word_chars > 12 * r.n_words, "dup_lines": lambda r: 20 * r.n_dup_lines > r.n_words,
    }
    by = {}
    for r in rows:
        by.setdefault(r.host, []).append(r)
    harmonic, ok = len(by) / sum(1 / len(x) for x in by.values()), dict.fromkeys(by, True)
    for fail in fails.values():
        rates = {h: sum(map(fail, x)) / len(x) for h, x in by.items()}
        mean = sum(rates.values()) / len(rates)
        var = sum((x - mean) ** 2 for x in rates.values()) / (len(rates) - 1)
        if 0 < mean < 1:
            total = min(max(mean * (1 - mean) / max(var - mean * (1 - mean) / harmonic, 1e-6) - 1, 2), 1e4)
            a, b = mean * total, (1 - mean) * total
        else:
            a, b = 2 * (mean + 1e-3), 2 * (1 - mean + 1e-3)
        for h, x in by.items():
            ok[h] &= (sum(map(fail, x)) + a) / (len(x) + a + b) <= host_rules.MOST
    assert {r.host: r.host_ok for r in rows} == ok and set(ok.values()) == {True, False}
    for r in rows:
        failed = fails["few_words"](r) or fails["repeats"](r)
        assert (r.base_failed, r.kept) == (failed, not failed and ok[r.host])


def test_shards(spark):
    texts = [f"text {i} " + "y" * (i * 7 % 91) for i in range(600)] + ["copy of one text"] * 500 + ODD
    docs = documents(spark, texts)
    got = sharding.shard(docs).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(texts)))
    sums, slots = Counter(), {}
    for r in got:
        t = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32) == (len(t) + 1, zlib.crc32(t))
        sums[r.shard] += r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sums.values()) - min(sums.values()) <= max(r["size"] for r in got)
    # one row and the tolerance bound each shard, when rows are small against shards
    texts = [f"text {i} " + "y" * (i * 7 % 91) for i in range(6000)] + ["copy of one text"] * 3000
    got = sharding.shard(documents(spark, texts)).groupBy("shard").agg(F.sum("size").alias("n"), F.max("size").alias("most")).collect()
    mean = sum(len(t) + 1 for t in texts) / 16
    assert len(got) == 16 and all(abs(r.n - mean) <= 110 + 2 * sharding.TOLERANCE * mean for r in got)


def test_equal_texts_lie_together(spark):
    got = sharding.shard(documents(spark, [f"text {i % 40}" * 20 for i in range(400)]), 4).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id % 40, set()).add(r.shard)
    assert sum(len(s) > 1 for s in by.values()) <= 3  # at the three borders alone


def test_large_shards_are_dealt_over_partitions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "PART_BYTES", 500)
    texts = [f"text {i}" for i in range(300)] + ["copy"] * 300
    got = sharding.write_shards(documents(spark, texts), str(tmp_path / "out"), 4).collect()
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert sorted(slots) == [0, 1, 2, 3] and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(list((tmp_path / "out" / f"shard={s}").glob("*.parquet"))) > 1 for s in slots)


def test_shards_of_odd_tables(spark):
    assert sharding.shard(documents(spark, [])).count() == 0
    twice = documents(spark, ["a", "a", "a", None], ids=[1, 1, None, None])
    got = sharding.shard(twice).collect()
    assert len(got) == 4 and len({(r.shard, r.slot) for r in got}) == 4
    even = sharding.shard(documents(spark, ["abc"] * 1600)).groupBy("shard").count().collect()
    assert len(even) == 16 and {r["count"] for r in even} == {100}


def test_written_shards(spark, tmp_path):
    docs = documents(spark, [f"t{i}" for i in range(50)])
    dealt = {r.doc_id: r.shard for r in sharding.write_shards(docs, str(tmp_path / "out"), 4).collect()}
    kept = spark.read.parquet(str(tmp_path / "out"))
    assert {r.row.doc_id: r.shard for r in kept.collect()} == dealt
    assert sorted(map(tuple, kept.select("row.*").collect())) == sorted(map(tuple, docs.collect()))
