import random
import re

from pyspark.sql import functions as F

from wedgeworks.llm.mixing import allocation, allotted, measured, mix, scored, word_count

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def data(n=900, seed=3):
    rng = random.Random(seed)
    docs = [(i, rng.choice([None, "", "hot", "hot", "hot", "a", "B", "é", "rare" if i % 50 == 0 else "hot"]), " ".join(["w"] * rng.choice([0, 1, 5, 50, 300]))) for i in range(n)]
    return docs + [(n, "a", None), (n + 1, "lonely", "one two"), (n + 2, "wordless", " \t "), *docs[:3]]


def waterfill(sizes, weights=(3, 1, 2), budget=1.5, cap=2):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), budget * sum(sizes.values())
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > cap * sizes[s]}
        if not over:
            target.update({s: level * w[s] for s in open_})
            break
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_targets_words_and_limits(spark):
    docs = data()
    frame = spark.createDataFrame(docs, "doc_id long, source string, text string").selectExpr("*", "1 as skey", "2 as target", "'k' as extra")
    got = mix(frame).collect()
    assert len(got) == len(docs) and {r.extra for r in got} == {"k"}
    size = lambda t: len(WORD.findall(t or ""))
    total = {}
    for _, s, t in docs:
        total[s] = total.get(s, 0) + size(t)
    want, taken, largest = waterfill(total), {}, {}
    for r in got:
        assert r.size == size(r.text) and r.source_size == total[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 2
        taken[r.source] = taken.get(r.source, 0) + r.taken
        largest[r.source] = max(largest.get(r.source, 0), r.size)
    for s, n in taken.items():
        assert abs(n - want[s]) <= largest[s] / 2 + 1e-6
    assert sorted(map(str, got)) == sorted(map(str, mix(frame.repartition(7)).collect()))


def test_many_intervals_agree_with_one(spark):
    frame = spark.createDataFrame(data(), "doc_id long, source string, text string")
    sized = measured(frame).select("doc_id", "skey", "size", "steps", "bits")
    by = lambda n: sorted(map(tuple, allotted(sized, allocation(sized, interval_docs=n)).collect()))
    assert by(5) == by(10**6)


def test_inclusion_is_unequal_and_as_asked(spark):
    rng = random.Random(8)
    docs = [(i, "s" if i % 2 else "t", "w " * rng.choice([3, 30, 300])) for i in range(6000)]
    frame = spark.createDataFrame(docs, "doc_id long, source string, text string")
    sized = measured(frame).select("doc_id", "skey", "size", "steps", "bits").cache()
    plan = allocation(sized, weights=(1, 1), budget=0.5)
    expected = {r[0]: (r[1], r[2]) for r in scored(sized, plan).groupBy("size").agg(F.avg("_expected"), F.avg(F.col("_p") * F.col("size"))).collect()}
    assert expected[3][0] > expected[30][0] > expected[300][0] > 0
    words = scored(sized, plan).agg(F.sum(F.col("_expected") * F.col("size")), F.max("_expected")).first()
    assert abs(words[0] - 0.5 * sized.agg(F.sum("size")).first()[0]) < 1e-3 and words[1] <= 2
    got = {r[0]: r[1] for r in allotted(sized, plan).groupBy("size").agg(F.avg("copies")).collect()}
    assert all(abs(got[n] - expected[n][0]) < 0.05 for n in got)
    even = {r[0]: r[1] for r in mix(frame, weights=(1, 1), budget=0.5, damping=0.0).groupBy("size").agg(F.avg("copies")).collect()}
    assert max(even.values()) - min(even.values()) < 0.08


def test_weight_column_raises_inclusion(spark):
    docs = [(i, "s" if i % 2 else "t", "w " * 10) for i in range(2000)]
    frame = spark.createDataFrame(docs, "doc_id long, source string, text string").withColumn("rank", F.when(F.col("doc_id") % 4 < 2, 1).otherwise(3))
    got = mix(frame, weights=(1, 1), budget=0.5, weight="rank", damping=1.0).groupBy("rank").agg(F.avg("copies")).collect()
    share = {r[0]: r[1] for r in got}
    assert share[1] > 0.85 and share[3] < 0.15


def test_order_is_sought_in_one_interval_only(spark):
    """Sources whose target is a whole multiple draw nothing; others put about an interval in order."""
    docs = [(i, "abc"[i % 3], "w " * (5 + i % 7)) for i in range(6000)]
    sized = measured(spark.createDataFrame(docs, "doc_id long, source string, text string")).select("doc_id", "skey", "size", "steps", "bits").cache()
    plan = allocation(sized, weights=(1, 1, 1), budget=2.0, interval_docs=100)
    assert plan.where("_cut is not null").count() == 0 and allotted(sized, plan).where("copies <> 2").count() == 0
    plan = allocation(sized, interval_docs=100)
    ordered = scored(sized, plan.where("_cut is not null")).where("_cell = _cut._cell and _p > 0").groupBy("skey").count().collect()
    assert ordered and all(r["count"] < 400 for r in ordered)


def test_null_and_repeated_ids(spark):
    rng = random.Random(4)
    docs = [(rng.choice([None, 1, 2, 7]), rng.choice(["a", "b", None]), " ".join(f"w{rng.randrange(99)}" for _ in range(rng.randint(0, 60)))) for _ in range(800)]
    frame = spark.createDataFrame([*docs, *docs[:40]], "doc_id long, source string, text string")
    first, again = ([tuple(r) for r in mix(f).collect()] for f in (frame, frame.orderBy("text").repartition(5)))
    assert sorted(map(str, first)) == sorted(map(str, again)) and len(first) == 840
    half = [r for r in first if r[0] is None]
    assert len({r[6] for r in half if r[3]}) > 1  # rows without an id are drawn apart


def test_word_count_and_empty(spark):
    texts = [None, "", " ", "a", " a", "a ", "\x0b a\x85b\xa0c \r\n d ", "x" * 10**6]
    got = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", word_count(F.col("t")).alias("n")).collect()
    assert {r.i: r.n for r in got} == {i: len(WORD.findall(t or "")) for i, t in enumerate(texts)}
    assert mix(spark.createDataFrame([], "doc_id long, source string, text string")).count() == 0
