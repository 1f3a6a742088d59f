import itertools
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wedgeworks.llm.quality_crf import chain, fit, line_features, remainder, score, train, with_neighbours


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(1)
    lengths = [1, 4, 2, 6, 1]
    starts = np.concatenate([[0], np.cumsum(lengths)])
    good, moves = rng.normal(size=starts[-1]) * 2, rng.normal(size=(2, 2))
    p, pairs, total = chain(good, starts, moves)
    want, seen, log_z = np.zeros(len(good)), np.zeros((2, 2)), 0.0
    for a, b in itertools.pairwise(starts):
        states = list(itertools.product((0, 1), repeat=b - a))
        w = np.array([np.exp(sum(g for g, y in zip(good[a:b], s, strict=True) if y) + sum(moves[x, y] for x, y in itertools.pairwise(s))) for s in states])
        log_z += np.log(w.sum())
        for s, x in zip(states, w / w.sum(), strict=True):
            want[a:b] += x * np.array(s)
            for y in itertools.pairwise(s):
                seen[y] += x
    assert np.allclose(p, want) and np.allclose(pairs, seen) and np.isclose(total, log_z)


def doc(rng, good):
    words = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n)]
    lines = [" ".join(words(12)).capitalize() + "." for _ in range(rng.randint(1, 6))]
    return "\n".join(lines) if good else "\n".join(x.upper() + "!! ### ***" for x in lines)


def test_learns_from_its_fold_and_scores_every_row(spark):
    rng = random.Random(3)
    kinds = [rng.random() < 0.7 for _ in range(400)]
    rows = [(i, doc(rng, k)) for i, k in enumerate(kinds)] + [(900, None), (901, ""), (902, " \n\t"), (903, "one long line " * 30_000), (0, "repeat")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as quality", "2.0 as score", "'x' as lang")
    labels = spark.createDataFrame([(i, int(k)) for i, k in enumerate(kinds)] + [(5, None), (None, 1), (7777, 1), (3, int(kinds[3]))], "doc_id long, quality int")
    mine = labels.where(remainder(F.col("doc_id")) != 1)
    field = train(docs, mine)
    got = score(docs, field).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got if r.doc_id != 0}
    assert by[900] == by[901] == by[902] == 0
    held = [i for i in range(1, 400) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(by[i] >= 0.5) == kinds[i] for i in held]) > 0.97
    again = train(docs.repartition(5), mine.repartition(3))
    assert np.array_equal(field.weights, again.weights)
    assert train(docs, labels.where("quality = 1")).score(*line_features("a"), np.array([1]))[0] == 1.0
    assert train(docs, labels.limit(0)).prior == 0.5
    assert score(docs.limit(0), field).count() == 0


def test_lines_of_both_kinds_in_one_document():
    """The marginals change where the quality does, and the score is the good lines' share by length."""
    rng = random.Random(5)
    field = fit([(int(k), line_features(doc(rng, k))[0]) for k in (i % 2 == 0 for i in range(200))])
    good, bad = "\n".join(doc(rng, True) for _ in range(4)), "\n".join(doc(rng, False) for _ in range(4))
    x, sizes = line_features(good + "\n" + bad)
    n = len(line_features(good)[0])
    starts = np.array([0, len(x)])
    p = field.marginals(with_neighbours((x - field.mean) / field.scale, starts) @ field.weights, starts)
    assert (p[: n - 1] > 0.5).all() and (p[n + 1 :] < 0.5).all()
    assert abs(field.score(x, sizes, np.array([len(x)]))[0] - sizes[:n].sum() / sizes.sum()) < 0.12


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the labelled tables")
def test_held_out_accuracy_of_the_query(spark):
    from wedgeworks.llm.quality_crf import op10_quality_crf

    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("quality is not null")
    rows = op10_quality_crf(spark, sf).where("held_out").join(labels, "doc_id").select("score", "predicted", "quality").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert len(good) > 20 and len(bad) > 3
    assert np.mean([a > b for a in good for b in bad]) > 0.97 and np.mean([r.predicted == r.quality for r in rows]) > 0.95
