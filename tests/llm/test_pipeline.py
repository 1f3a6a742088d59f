import random
import re

import pytest

import corpus_pipeline
from tests.llm.test_decontamination import brute as contamination
from tests.llm.test_near_dedup import brute as classes
from tests.llm.test_pii import base as personal
from wedgeworks.llm import pii, quality_rules


def prose(rng, n):
    return ". ".join(" ".join("".join(rng.choice("abcdefghijklmnoprstu") for _ in range(rng.randint(2, 8))) for _ in range(10)) for _ in range(n // 10)) + "."


@pytest.fixture(scope="module")
def tables(tmp_path_factory, spark):
    rng = random.Random(8)
    d = str(tmp_path_factory.mktemp("sf"))
    clean = [prose(rng, 100) for _ in range(40)]
    items = [(i, prose(rng, 20)) for i in range(4)]
    texts = clean + clean[:5] + [t + " one more" for t in clean[5:8]] + [prose(rng, 60) + " " + items[i % 4][1] for i in range(6)] + [prose(rng, 60) + f" mail me{i}@x.org" for i in range(4)]
    texts += ["too short", None, "", prose(rng, 100).upper(), "again and " * 200]
    docs = [(i, t, "en", rng.choice(["hot", "hot", "b", None]), len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(d + "/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(d + "/benchmark.parquet")
    return d, docs, items


def test_each_stage_against_brute_force(spark, tables):
    d, docs, items = tables
    table = spark.read.parquet(d + "/documents.parquet")
    rejected = {r.doc_id for r in quality_rules.judge(table, min_words=1).where("rejected_by is not null").collect()}
    assert rejected == {i for i, t, *_ in docs if not t or t.isupper() or t.startswith("again and again")}
    rest = [x for x in docs if x[0] not in rejected]
    assert any(x[1] == "too short" for x in rest)  # short documents are as good as long ones
    kept = {i for i, _ in classes([(x[0], x[1]) for x in rest])[1]}
    rest = [x for x in rest if x[0] in kept and not contamination(x[1], items, 10)[1]]
    want = {}
    for i, t, *_ in rest:
        for k, s, e in sorted(personal(t), key=lambda x: -x[1]):
            t = t[:s] + f"[{pii.KINDS[k].upper()}]" + t[e:]
        want[i] = t
    got = table
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        got = stage(spark, got, d)
        if n < len(corpus_pipeline.STAGES) - 1:
            assert got.columns == table.columns, name
            got.write.parquet(f"{d}/{name}")
            got = spark.read.parquet(f"{d}/{name}")
    out = {r.doc_id: r for r in got.collect()}
    assert all(r.text == want[i] and 1 <= r.copies <= 2 for i, r in out.items())
    before = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/pii").collect()}
    assert before == want
    words = sum(len(re.findall(r"\S+", t)) for t in want.values())
    assert abs(sum(r.taken for r in out.values()) - 1.5 * words) < 400
    assert sorted(map(str, corpus_pipeline.run(spark, d).collect())) == sorted(map(str, out.values()))


def test_empty_documents(spark, tables, tmp_path):
    d, _, _ = tables
    empty = spark.read.parquet(d + "/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, d).count() == 0
