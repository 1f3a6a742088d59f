import random
from hashlib import sha256

import numpy as np

from wedgeworks.llm import near_dedup as N
from wedgeworks.llm.components import components, joined


def sentence(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def edited(rng, words, n):
    out = list(words)
    for p in rng.sample(range(len(out)), n):
        out[p] = f"x{rng.randrange(10**6)}"
    return out


def data(seed=1):
    rng = random.Random(seed)
    docs = []
    for _ in range(25):
        base = sentence(rng, rng.choice([6, 30, 150, 400]))
        docs += [base, base] + [edited(rng, base, max(0, round(len(base) * rng.choice([0.005, 0.02, 0.04, 0.1])))) for _ in range(rng.randint(0, 9))]
    big = sentence(rng, 200)
    docs += [edited(rng, big, rng.randint(1, 6)) for _ in range(120)]
    shared = sentence(rng, 60)
    docs += [sentence(rng, 50) + shared + sentence(rng, 50) for _ in range(60)]
    docs += [["same"] * 300, ["same"] * 310, ["same"] * 900, ["a", "b"], ["A", "b."], ["a"], []]
    texts = [" ".join(d) for d in docs]
    rng.shuffle(texts)
    return [(i, t) for i, t in enumerate(texts)] + [(5000, None), (5001, None), (5002, " "), (5003, " "), (5004, ""), (7, texts[7]), (None, "x")]


def brute(rows):
    """(doc_id, text_id, class_id) of every row, sorted; and the rows that stay."""
    last = lambda i: (i is None, i or 0)
    texts = sorted({t for _, t in rows if t is not None})
    bags = [N.shingles(t.encode()) for t in texts]
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if root(a) != root(b) and N.overlap(bags[a], bags[b]) >= 0.8:
                up[root(a)] = root(b)
    first, lowest, kept = {}, {}, {}
    for i, t in rows:
        if t is not None:
            first[t] = min(first.get(t, i), i, key=last)
    for k, t in enumerate(texts):
        c = root(k)
        lowest[c] = min(lowest.get(c, first[t]), first[t], key=last)
        kept[c] = min(kept.get(c, (last(None), "~")), (last(first[t]), sha256(t.encode()).digest().hex()))
    at = {t: root(k) for k, t in enumerate(texts)}
    out = [(i, i, i) if t is None else (i, first[t], lowest[at[t]]) for i, t in rows]
    stay = {(i, t) for i, t in rows if t is not None and kept[at[t]] == (last(i), sha256(t.encode()).digest().hex())}
    return sorted(out, key=str), sorted([*stay, *((i, t) for i, t in rows if t is None)], key=str)


def classes_of(docs):
    return sorted(map(tuple, N.near_duplicates(docs).collect()), key=str)


def test_classes_equal_brute_force(spark):
    rows = data()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as class_id", "2 as v", "3 as n", "'d' as digest", "4 as tag", "5 as kept")
    assert N.near_duplicates(docs).columns == ["doc_id", "text_id", "class_id"]
    want, stay = brute(rows)
    assert classes_of(docs) == want
    kept = N.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == stay


def test_rows_without_ids_or_with_equal_ones(spark):
    rng = random.Random(9)
    bases = [sentence(rng, 80) for _ in range(12)]
    rows = [(rng.choice([None, None, 1, 2, 3, 50]), " ".join(edited(rng, rng.choice(bases), rng.choice([0, 0, 1, 2])))) for _ in range(150)]
    rows += [*rows[:20], (None, None), (1, None), (None, ""), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "text as text_id")
    want, stay = brute(rows)
    assert classes_of(docs) == want
    assert sorted(((r.doc_id, r.text) for r in N.keep_one(docs).collect()), key=str) == stay


def test_group_of_drifting_edits(spark):
    """A group like the check's: most edits too far from each other and from any pivot, others just near enough."""
    rng = random.Random(6)
    base = sentence(rng, 150)
    rows = [" ".join(edited(rng, base, rng.choice([2, 4, 6, 8, 10, 12, 15, 20]))) for _ in range(420)]
    chain = sentence(rng, 150)
    for _ in range(120):  # each like the one before
        chain = edited(rng, chain, 2)
        rows.append(" ".join(chain))
    rows.append(" ".join(sentence(rng, 40_000)))  # a long text and a copy with edits
    rows.append(" ".join(edited(rng, rows[-1].split(), 300)))
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    assert classes_of(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)[0]


def test_large_bucket_is_finished(spark, monkeypatch):
    rng = random.Random(3)
    rows = []
    for _ in range(90):  # pairs of texts unlike all others, in one bucket of 182
        base = sentence(rng, 120)
        rows += [" ".join(base), " ".join(edited(rng, base, rng.choice([1, 2, 3])))]
    rows += [" ".join(["same", "words"] * 55), " ".join(["same", "words"] * 60)]
    rows += [" ".join(edited(rng, rows[0].split(), 1)) for _ in range(40)]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    real = N.fingerprints
    monkeypatch.setattr(N, "fingerprints", lambda docs: real(docs).selectExpr("doc_id", "tag", "digest", "n", "array(1L) as bands", "sketch"))
    want = brute(rows)[0]
    assert len({r[2] for r in want}) < 140
    for texts, size in ((512, 250_000), (30, 250_000), (512, 3000)):
        monkeypatch.setattr(N, "BLOCK_TEXTS", texts)
        monkeypatch.setattr(N, "BLOCK_SHINGLES", size)
        assert classes_of(docs) == want


def test_hot_pivot_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(N, "PIVOT_PAIRS", 7)
    rows = data(seed=12)
    assert classes_of(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)[0]


def test_small_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert N.near_duplicates(none).count() == 0 and N.keep_one(none).count() == 0
    one = spark.createDataFrame([(1, "only one text of some words"), (2, None)], "doc_id long, text string")
    assert sorted(map(tuple, N.near_duplicates(one).collect())) == [(1, 1, 1), (2, 2, 2)] and N.keep_one(one).count() == 2


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(2)
    for _ in range(3):
        codes = N.mix(rng.integers(0, 2**63, 60).astype(np.uint64))
        a, b = (np.unique(codes), rng.integers(1, 40, 60)), (np.unique(codes), rng.integers(1, 40, 60))
        sig = N.signatures([a, b], 4096)
        assert abs((sig[0] == sig[1]).mean() - N.overlap(a, b)) < 0.04
        assert np.array_equal(N.signatures([b], 4096)[0], sig[1])  # nothing depends on the batch


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (102, 101), (7, 7), (200, 300)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100, 200: 200, 300: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_more_edges(spark):
    frame = lambda e: spark.createDataFrame(e, "a long, b long")
    first = [(1, 2), (3, 4), (9, 10)]
    more = [(4, 2), (20, 21), (21, 10), (30, 31), (3, 4)]
    want = dict(map(tuple, components(frame(first + more)).collect()))
    assert dict(map(tuple, joined(components(frame(first)), frame(more)).collect())) == want
