import random
import re

from pyspark.sql import functions as F

from wedgeworks.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {p + k for at in windows.values() if len(at) > 1 for p in at for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def texts():
    rng = random.Random(1)
    out = [None, "", " \n\t", "a", "a b", "a b c", "a a a", "a a a a", "a b a b a b", "a b c d a b c", "É ü x\x85y\n\nÉ ü x\x85y\n", "#*$%&|<>" * 3, "w " * 60_000, "\n".join(["same line here"] * 500)]
    out += [" ".join(rng.choice("abcdef") for _ in range(n)) for n in range(1, 80)]
    out += ["\x0b".join(rng.choice(["x", "yy", "z#", "*"]) for _ in range(200)) + "\r\n" for _ in range(20)]
    return out + out[:5]


def test_base_columns(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 as words", "8 as w")
    got = {r[0]: tuple(r)[1:] for r in Q.with_words(docs).select("doc_id", *[c.alias(n) for n, c in Q.base_columns(F.col("text"), F.col(Q.WORDS)).items()]).collect()}
    assert got == {i: base(t) for i, t in rows}


def good(seed, n=120):
    rng = random.Random(seed)
    return ". ".join(" ".join("".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(2, 9))) for _ in range(12)).capitalize() for _ in range(n // 12)) + "."


def test_cascade_keeps_good_and_names_the_rule(spark):
    cases = {
        1: (good(1), None), 2: (None, "few_words"), 3: ("", "few_words"), 4: ("repeat this " * 100, "repeats"), 5: (good(2).upper(), "shouting"),
        6: (re.sub(r"(\w+)", r"\1###", good(3)), "symbols"), 7: (re.sub(r"(\w+)", r"\1!!", good(4)), "exclaiming"), 8: (" ".join(str(i * 37) for i in range(99)), "no_letters"),
        9: (good(1), None), 10: ("\n".join([good(9, 60)] + ["dup"] * 5), "dup_lines"),
        11: ("\n".join(f"- {good(20 + i, 24)}" for i in range(6)), "bullets"), 12: ("\n".join(f"{good(40 + i, 24)}.." for i in range(6)), "ellipses"),
        13: (" ".join("abcdefghij" * 2 + str(i) for i in range(60)), "word_length"), 14: ("short and clean.", "few_words"),
    }
    docs = spark.createDataFrame([(i, t) for i, (t, _) in cases.items()], "doc_id long, text string").withColumn("rejected_by", F.lit("clash"))
    # texts without letters break two rules; the measured order says which comes first
    names = {r.doc_id: "few_words" if r.doc_id in (2, 3) and r.rejected_by == "no_letters" else r.rejected_by for r in Q.judge(docs).collect()}
    assert names == {i: w for i, (_, w) in cases.items()}
    assert sorted(r.doc_id for r in Q.keep_good(docs).collect()) == [1, 9]
    assert sorted(r.doc_id for r in Q.keep_good(docs, min_words=1).collect()) == [1, 9, 14]
    assert Q.judge(docs.limit(0)).count() == 0


def test_order_is_the_same_in_every_run_and_by_cost(spark):
    rows = [(i, good(i)) for i in range(60)] + [(100 + i, re.sub(r"(\w+)", r"\1###", good(i))) for i in range(60)]
    docs = Q.with_words(spark.createDataFrame(rows, "doc_id long, text string"))
    tests = Q.rules(F.col("text"), F.col(Q.WORDS))
    order = Q.measured_order(docs, tests, 50)
    assert order == Q.measured_order(docs.orderBy(F.desc("doc_id")).repartition(7), tests, 50)  # not the rows that a scan meets first
    assert order[0] == "symbols" and order.index("few_words") < order.index("shouting") < order.index("repeats")
    assert sorted(Q.measured_order(docs.limit(0), tests)) == sorted(tests)


def test_order_does_not_change_verdicts(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts() + [good(s) for s in range(5)])], "doc_id long, text string")
    docs = Q.with_words(docs)
    tests = Q.rules(F.col("text"), F.col(Q.WORDS))
    order = Q.measured_order(docs, tests)
    assert sorted(order) == sorted(tests)
    kept = lambda o: sorted(r[0] for r in docs.where(Q.cascade(tests, o).isNull()).select("doc_id").collect())
    assert kept(order) == kept(order[::-1])
