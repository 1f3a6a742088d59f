import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from wedgeworks.llm.decontamination import drop_contaminated, find_contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, width):
    w, hit, names = words(text), set(), set()
    for name, item in items:
        iw = words(item)
        n = min(width, len(iw))
        for k in range(len(iw) - n + 1 if iw else 0):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == iw[k : k + n]:
                    hit |= set(range(p, p + n))
                    names.add("" if name is None else str(name))
    return len(w), len(hit), sorted(names)


def data():
    rng = random.Random(2)
    some = lambda n: " ".join(rng.choice(["a", "b", "C", "d'e", "É", "é", "9", "z-z"]) for _ in range(n))
    items = [(i, some(rng.randint(1, 40))) for i in range(3, 12)] + [(1, None), (2, ""), (20, "!!"), (21, "Single"), (22, "two words"), (3, some(30)), (None, some(14))]
    docs = [None, "", "!?", "single", "Two-words", some(8)] + [some(rng.randint(1, 30)) for _ in range(30)]
    docs += [f"{some(5)} {x or ''}\n{some(5)}" for _, x in items] + [(items[0][1] or "") * 3, " ".join(x or "" for _, x in items) * 20]
    return docs + docs[:4], items


@pytest.mark.parametrize(("width", "block"), [(10, 1 << 20), (4, 1 << 20), (10, 150)])
def test_against_brute_force(spark, width, block):
    docs, items = data()
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").selectExpr("*", "'c' as hits", "1 as items")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"] or [])) for r in find_contamination(d, b, width, block, chunk=500).collect()}
    want = {i: brute(t, items, width) for i, t in enumerate(docs)}
    assert got == want
    clean = drop_contaminated(d, b, width, block, chunk=500)
    assert clean.columns == d.columns and sorted(r.doc_id for r in clean.collect()) == [i for i, x in want.items() if not x[1]]


def test_digest_and_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    row = find_contamination(docs, none).first()
    assert (row.n_words, row.n_hit) == (3, 0)
    assert find_contamination(docs.limit(0), none).count() == 0
    assert docs.select(F.sha2(F.array_join(F.array().cast("array<string>"), ","), 256)).first()[0] == hashlib.sha256(b"").hexdigest()
