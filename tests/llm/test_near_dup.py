"""Near duplicates against comparing all pairs of full shingle sets."""

import random
import re
import time

import pytest
from odd import ODD, PROSE, documents

from shalebed.llm import near_dup


def brute(texts, ids, threshold=85):
    sets = []
    for t in texts:
        ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} or ({tuple(ws)} if ws else set()))
    comp = list(range(len(texts)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                comp[root(i)] = root(j)
    least = {}
    for i in range(len(texts)):
        least[root(i)] = min(least.get(root(i), ids[i]), ids[i])
    return {ids[i]: (len(sets[i]), least[root(i)]) for i in range(len(texts))}


def test_against_all_pairs(spark):
    rng = random.Random(3)
    texts = list(ODD)
    for g in range(12):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(150)]
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 4, 6])):
                copy[rng.randrange(len(copy))] = f"n{rng.random()}"
            texts.append(" ".join(copy).title() if rng.random() < 0.3 else "\n".join(copy))
    texts += ["Three Word text", "three word TEXT", "É é", PROSE.upper()]
    ids = list(range(1000, 1000 + len(texts)))
    rng.shuffle(ids)
    want = brute(texts, ids)
    got = {r.doc_id: r for r in near_dup.find(documents(spark, texts, ids=ids)).collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (i == r.component_id) for i, r in got.items())
    assert len({c for _, c in want.values()}) > 20


@pytest.mark.parametrize("threshold", [50, 95])
def test_other_thresholds_against_all_pairs(spark, threshold):
    rng = random.Random(threshold)
    texts = list(ODD)
    for g in range(8):
        base = [f"g{g}w{i}" for i in range(200)]
        for _ in range(10):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 6, 8, 10, 12, 14, 16])):
                copy[rng.randrange(len(copy))] = f"n{rng.random()}"
            texts.append(" ".join(copy))
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.find(documents(spark, texts, ids=ids), threshold=threshold).collect()}
    assert got == brute(texts, ids, threshold)


@pytest.mark.parametrize("one_task", [near_dup.ONE_TASK, 0])
def test_components(spark, one_task):
    rng = random.Random(9)
    pairs = [(rng.randrange(150), rng.randrange(150)) for _ in range(90)] + [(i, i + 1) for i in range(200, 240)]
    comp = {i: i for i in range(300)}
    for a, b in pairs * 100:
        comp[a] = comp[b] = min(comp[a], comp[b])
    want = {i: comp[i] for p in pairs for i in p}
    scratch = near_dup.Scratch(spark)
    first, second = (spark.createDataFrame(x, "a long, b long") for x in (pairs[::2], pairs[1::2]))
    got = near_dup.grown(near_dup.grown(None, first, scratch, one_task), second, scratch, one_task)
    assert {r.node: r.comp for r in got.collect()} == want
    assert got.count() == len(want)
    assert near_dup.grown(got, second, scratch, one_task) is got


def test_large_buckets_against_all_pairs(spark):
    rng = random.Random(5)
    texts = []
    for g in range(3):
        base = [f"g{g}w{i}" for i in range(120)]
        for k in range(70):
            copy = list(base)
            if k % 3 == 0:  # shortened: mostly shingles of the others
                cut = rng.randrange(14, 40)
                at = rng.choice([0, 20, 80])
                copy = copy[:at] + copy[at + cut :]
            for _ in range(rng.choice([0, 1, 2, 3, 4, 5])):
                copy[rng.randrange(len(copy))] = f"n{rng.randrange(300)}"
            if k % 5 == 0:
                copy += [f"tail{g}{i}" for i in range(rng.randrange(10, 30))]
            texts.append(" ".join(copy))
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    want = brute(texts, ids)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.find(documents(spark, texts, ids=ids), dense=4, one_task=8).collect()}
    assert got == want
    assert len({c for _, c in want.values()}) > 20


def variants(rng, g, n):
    """``n`` edited copies of one text, of which about half are too far from it, and a second group among them."""
    base, texts = [f"g{g}w{i}" for i in range(150)], []
    for k in range(n):
        copy = list(base)
        if k % 6 == 0:  # near to each other, not to the others
            copy[100:] = [f"g{g}v{i}" for i in range(60)]
        for _ in range(rng.choice([0, 1, 2, 3, 6, 10, 15, 20])):
            i = rng.randrange(len(copy))
            copy[i : i + 1] = [f"g{g}w{rng.randrange(150)}"] if rng.random() < 0.7 else []
        texts.append(" ".join(copy))
    return texts


def test_a_large_group_takes_two_rounds_and_few_pairs_leave_its_tiles(spark, monkeypatch):
    rng = random.Random(12)
    texts = variants(rng, 0, 260) + variants(rng, 1, 60)
    made, stage = [], near_dup.Scratch.stage

    def told(self, df, name, kept=False):
        made.append(name)
        return stage(self, df, name, kept)

    monkeypatch.setattr(near_dup.Scratch, "stage", told)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.find(documents(spark, texts), dense=4).collect()}
    assert got == brute(texts, list(range(len(texts))))
    # levels that each left out one head of a bucket would be many
    assert made.count("near-buckets") == 1


@pytest.mark.parametrize("threshold, block", [(85, 20_000), (85, 1 << 20), (60, 40_000)])
def test_tiles_join_what_comparing_all_pairs_joins(spark, threshold, block):
    rng = random.Random(13)
    texts = variants(rng, 0, 100) + variants(rng, 1, 30)
    full = near_dup.full_sets(*(lambda d: (d, d.selectExpr("_id as node", *(f"0L as {s}" for s in near_dup._S))))(documents(spark, texts).selectExpr("doc_id as _id", "text as _text"))).cache()
    h, off = near_dup.shingle_sets([t.encode() for t in texts])
    sets = [set(h[a:b].tolist()) for a, b in zip(off, off[1:])]
    link = lambda i, j: 100 * len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])
    # those linked with the head are one component already
    comp = {i: head if link(i, head) else i for head, r in ((0, range(100)), (100, range(100, 130))) for i in r}
    members = spark.createDataFrame([(0 if i < 100 else 100, i, c, 0 if i < 100 else 100) for i, c in comp.items()] * 2, "head long, node long, comp long, top long")
    scratch = near_dup.Scratch(spark)
    got = [tuple(r) for r in near_dup._tiled(members, full, scratch, 256, threshold, block).collect()]
    assert all(link(*p) and comp[p[0]] != comp[p[1]] for p in got)

    def joined(pairs):
        label = dict(comp)
        for a, b in pairs:
            old, new = label[a], label[b]
            label |= {i: new for i, c in label.items() if c == old}
        return {frozenset(i for i in label if label[i] == c) for c in label.values()}

    every = [(i, j) for r in (range(100), range(100, 130)) for i in r for j in r if i < j and link(i, j)]
    assert joined(got) == joined(every) and len(joined(every)) > 10
    # a link is told where it joins two components of a tile, not for each pair
    assert len(got) < len([p for p in every if comp[p[0]] != comp[p[1]]]) / 2


def test_index_of_a_large_group_keeps_links_and_makes_few_pairs(spark):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(300)]
    texts = [" ".join(base)]
    for k in range(240):
        at = rng.randrange(200) if k % 4 == 0 else 0
        copy = base[at : at + rng.randrange(60, 90)] if k % 4 == 0 else list(base)
        edits = rng.randrange(2) if k % 4 == 0 else rng.randrange(6, 14)
        for _ in range(edits):
            i = rng.randrange(len(copy))
            copy[i : i + 1] = [f"n{rng.random()}"] if rng.random() < 0.5 else []
        texts.append(" ".join(copy))
    texts += [" ".join(texts[rng.randrange(1, 241)].split()[rng.randrange(4) :]) for _ in range(60)]
    sets = [near_dup.shingle_sets([t.encode()])[0].tolist() for t in texts]
    sets = [set(s) for s in sets]
    link = lambda a, b: 100 * len(a & b) >= 85 * len(a | b)
    own = {i for i, s in enumerate(sets) if link(s, sets[0])}
    want = set()
    for i in range(1, len(sets)):
        for j in range(1, i):
            if not {i, j} <= own and sets[i] != sets[j] and not (sets[i] & sets[j]) - sets[0] and link(sets[i], sets[j]):
                want.add((j, i))
    docs = documents(spark, texts).selectExpr("doc_id as _id", "text as _text")
    nodes = docs.selectExpr("_id as node", *(f"0L as {s}" for s in near_dup._S))
    full = near_dup.full_sets(docs, nodes).cache()
    members = spark.createDataFrame([(0, i, 0 if i in own else i) for i in range(len(texts))], "head long, node long, comp long")
    index = near_dup._indexed(members, full, 85).cache()
    got = [tuple(sorted(r)) for r in near_dup._by_center(index, full.select("node", *near_dup._S), 256, 85).collect()]
    assert want <= set(got) and len(want) > 20
    # the common shingles of smallest hash, which most members have, would make several rows of each pair
    assert len(got) < (len(texts) - len(own)) * len(texts) / 2


@pytest.mark.parametrize("threshold", [50, 85, 95])
def test_parities_lose_no_link_and_few_others_pass(spark, threshold):
    rng = random.Random(threshold)
    texts = ["", "a b", "A  B", "a b c d e", "x y z"]
    for n in (6, 40, 150, 700, 3000):
        base = [f"b{n}w{i}" for i in range(n)]
        texts.append(" ".join(base))
        for k in range(20):
            copy = base[rng.randrange(1 + n // 2) :] if k % 4 == 0 else list(base)
            for _ in range(rng.randrange(1 + n // rng.choice([12, 25, 50]))):
                copy[rng.randrange(len(copy))] = f"n{rng.random()}"
            texts.append(" ".join(copy))
    h, off = near_dup.shingle_sets([t.encode() for t in texts])
    odd = near_dup.parities(h, off)
    sets = [set(h[a:b].tolist()) for a, b in zip(off, off[1:])]
    pairs = [(i, j) for j in range(len(sets)) for i in range(j) if sets[i] and sets[j]]
    assert all(near_dup.least_apart(odd[i], odd[j]) == near_dup.least_apart(odd[j], odd[i]) <= len(sets[i] ^ sets[j]) for i, j in pairs)
    docs = documents(spark, texts).selectExpr("doc_id as _id", "text as _text")
    full = near_dup.full_sets(docs, docs.selectExpr("_id as node", *(f"0L as {s}" for s in near_dup._S))).cache()
    got = {tuple(r) for r in near_dup.possible(spark.createDataFrame(pairs, "a long, b long"), full, threshold).collect()}
    share = lambda i, j, t: 100 * len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j])
    want = {(i, j) for i, j in pairs if share(i, j, threshold)}
    assert want <= got and len(want) > 50
    # small sets have few bits, and a low threshold allows more shingles apart than bits can tell
    assert threshold < 85 or not [p for p in got if not share(*p, threshold - 15) and min(len(sets[p[0]]), len(sets[p[1]])) > 100]


def shuffled(spark):
    """Bytes written to exchanges so far."""
    time.sleep(0.5)
    spark.range(1).count()  # the figures are brought up to date by a later job
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    held = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(held.apply(i).totalShuffleWrite() for i in range(held.length()))


def test_sets_are_moved_for_links_not_for_all_candidates(spark):
    rng = random.Random(2)
    texts = []
    for g in range(4):  # 78 percent alike: the sketches let many pairs pass that are no links
        base = [f"g{g}w{i}" for i in range(1000)]
        for _ in range(40):
            copy = list(base)
            for i in rng.sample(range(1000), 13):
                copy[i] = f"n{rng.random()}"
            texts.append(" ".join(copy))
    texts += [texts[0] + " more", texts[50] + " more"]
    docs = documents(spark, texts).cache()
    want = brute(texts, list(range(len(texts))))
    wide = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled(spark)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.find(docs).collect()}
        moved = shuffled(spark) - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", wide)
    assert got == want
    assert moved < 2 * 8 * sum(n for n, _ in want.values())


def test_odd_tables(spark):
    assert near_dup.find(documents(spark, [])).count() == 0
    got = near_dup.find(documents(spark, ["a b c", "a b c", None], ids=[4, 4, None])).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in got) == [(-1, -1, True), (4, 4, True), (4, 4, True)]


def test_null_id_and_clashing_names(spark):
    rows = [(None, "one two three four five six", 1), (7, "one two three four five six", 2), (9, "One two three four five SIX", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in near_dup.find(docs).collect())
    assert got == [(-1, -1, True), (7, 7, True), (9, 7, False)]
