"""Document quality from a linear-chain conditional random field over lines.

Every line with a word is labelled good or bad. A line's potential is linear in features of the line and
of the lines before and after it; a 2 x 2 matrix scores neighbouring labels. Forward-backward gives each
line's probability of being good, and a document's score is their mean weighted by line length.

The field is fitted by gradient ascent on the conditional likelihood of at most ``sample_docs`` labelled
documents (the first by a hash of their id), whose features, not texts, go to the driver: 60 bytes a line, 72
MB at most. Lines take their document's label; so that changes of quality inside a document are learned as
well, good and bad documents are also joined into one, in both orders. Documents of more than
``sample_lines`` lines are left out of the fit, never of scoring.
Scoring runs on whole texts, one Arrow batch after another, without a shuffle.

Defined results: texts without a word (null ones too) score 0; repeated labels count once, the larger
quality winning; labels without text, or of null quality, teach nothing; with no labels at all, or one
kind only, the score is the share of good labels (0.5 if none).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, table

SAMPLE_DOCS = 4000
SAMPLE_LINES = 300
OWN = 15
CHUNK = 4_000_000
_UPPER = re.compile("[A-ZÀ-ÖØ-Þ]").findall
_DIGIT = re.compile("[0-9]").findall


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """A row of OWN features for each line that has a word, and the lines' lengths."""
    rows, sizes, seen = [], [], set()
    for line in (text or "").split("\n"):
        words = line.split()
        if not words:
            continue
        n, size, count = len(words), len(line), line.count
        symbols = count("#") + count("*") + count("$") + count("%") + count("&") + count("<") + count(">")
        upper = len(_UPPER(line))
        rows.append((
            np.log1p(n), size / n, upper / size, min(2.0, symbols / n), min(2.0, count("|") / n),
            min(2.0, (count("!") + count("?")) / n), len(_DIGIT(line)) / size, (count(".") + count(",")) / n,
            len(set(words)) / n, sum(map(eq, words, words[1:])) / n, float(line in seen), float(words[-1][-1] in ".!?"),
            float(upper > size / 3), float(n < 5), float(min(2.0, symbols / n) > 0.2),
        ))
        sizes.append(size)
        seen.add(line)
    return np.array(rows, np.float32).reshape(-1, OWN), np.array(sizes, np.float64)


def with_neighbours(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Own, previous and next line's features and whether there are such; starts: first rows of documents, and the end."""
    first, last = np.zeros(len(x), bool), np.zeros(len(x), bool)
    first[starts[:-1]] = True
    last[starts[1:] - 1] = True
    before, after = np.roll(x, 1, 0), np.roll(x, -1, 0)
    before[first] = 0
    after[last] = 0
    return np.concatenate([x, before, after, first[:, None], last[:, None], np.ones((len(x), 1))], 1)


class Field:
    """A fitted chain; weights is None where only a prior is known."""

    def __init__(self, prior: float, mean=None, scale=None, weights=None, moves=None):
        self.prior, self.mean, self.scale, self.weights, self.moves = prior, mean, scale, weights, moves

    def marginals(self, good: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return chain(good, starts, self.moves)[0]

    def score(self, x: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Of documents whose lines follow each other in x; counts: lines of each, 0 allowed."""
        out = np.zeros(len(counts))
        full = counts > 0
        if not full.any():
            return out
        starts = np.concatenate([[0], np.cumsum(counts[full])])
        if self.weights is None:
            out[full] = self.prior
            return out
        p = self.marginals(with_neighbours((x - self.mean) / self.scale, starts) @ self.weights, starts)
        out[full] = np.add.reduceat(p * sizes, starts[:-1]) / np.add.reduceat(sizes, starts[:-1])
        return np.clip(out, 0.0, 1.0)


def chain(good: np.ndarray, starts: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of good, expected moves (2 x 2) and the sum of log partitions; label 0 has potential 0.

    Documents are ordered by length, so step t works on those that have a line t.
    """
    counts = np.diff(starts)
    order = np.argsort(-counts, kind="stable")
    begin, length = starts[:-1][order], counts[order]
    alpha, beta = np.zeros((len(good), 2)), np.zeros((len(good), 2))
    node = np.stack([np.zeros(len(good)), good], 1)
    alpha[begin] = node[begin]
    steps = [int(np.searchsorted(-length, -t, "left")) for t in range(int(length[0]))]  # documents with a line t
    for t in range(1, len(steps)):
        at = begin[: steps[t]] + t
        a = alpha[at - 1]
        alpha[at] = np.logaddexp(a[:, :1] + moves[0], a[:, 1:] + moves[1]) + node[at]
    pairs = np.zeros((2, 2))
    total = np.logaddexp(*alpha[begin + length - 1].T)
    for t in range(len(steps) - 1, 0, -1):
        at = begin[: steps[t]] + t
        b = beta[at] + node[at]
        beta[at - 1] = np.logaddexp(moves[:, 0] + b[:, :1], moves[:, 1] + b[:, 1:])
        pairs += np.exp(alpha[at - 1][:, :, None] + moves + b[:, None, :] - total[: steps[t], None, None]).sum(0)
    marginal = alpha + beta
    return np.exp(marginal[:, 1] - np.logaddexp(marginal[:, 0], marginal[:, 1])), pairs, float(total.sum())


def joins(samples: list[tuple[int, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Labels and features of documents made of a good and a bad one, either first in turn."""
    kinds = [[x for y, x in samples if y == k] for k in (0, 1)]
    out = []
    for i, pair in enumerate(zip(*kinds, strict=False)):
        order = (0, 1) if i % 2 else (1, 0)
        out.append((np.concatenate([np.full(len(pair[k]), float(k)) for k in order]), np.concatenate([pair[k] for k in order])))
    return out


def fit(samples: list[tuple[int, np.ndarray]], rounds: int = 200, rate: float = 0.05, l2: float = 1.0) -> Field:
    """samples: (label, line features) of documents."""
    samples = [(y, x) for y, x in samples if len(x)]
    prior = float(np.mean([y for y, _ in samples])) if samples else 0.5
    if not samples or not 0 < prior < 1:
        return Field(prior)
    chains = [(np.full(len(x), float(y)), x) for y, x in samples] + joins(samples)
    x, y = np.concatenate([x for _, x in chains]).astype(np.float64), np.concatenate([y for y, _ in chains])
    starts = np.concatenate([[0], np.cumsum([len(x) for _, x in chains])])
    mean, scale = x.mean(0), x.std(0) + 1e-3
    full = with_neighbours((x - mean) / scale, starts)
    inner = np.ones(len(y), bool)
    inner[starts[:-1]] = False
    at = np.flatnonzero(inner)
    seen = np.bincount((2 * y[at - 1] + y[at]).astype(int), minlength=4).reshape(2, 2).astype(float)
    # a line's share of its document: each document teaches as much as any other
    n = len(chains)
    size = full.shape[1] + 4
    theta, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    penalty = np.full(size, l2)
    penalty[-4:] = l2 * 20
    for k in range(1, rounds + 1):
        moves = theta[-4:].reshape(2, 2)
        p, pairs, _ = chain(full @ theta[:-4], starts, moves)
        slope = np.concatenate([full.T @ (y - p), (seen - pairs).ravel()]) / n - penalty * theta / n
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        theta += rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return Field(prior, mean, scale, theta[:-4].copy(), theta[-4:].reshape(2, 2).copy())


def remainder(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3, F.lit(0))


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_lines: int = SAMPLE_LINES) -> Field:
    """Fits on labels (doc_id, quality); pass those to learn from only."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    # at most sample_docs short rows, so this side is broadcast
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("quality", "text")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(y, line_features(t)[0]) for y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            found = [(y, x) for y, x in found if 0 < len(x) <= sample_lines]
            yield pa.RecordBatch.from_arrays([pa.array([y for y, _ in found], pa.int32()), pa.array([x.tobytes() for _, x in found], pa.binary())], names=["y", "x"])

    rows = texts.mapInArrow(featured, "y int, x binary").collect()
    return fit(sorted(((r.y, np.frombuffer(bytes(r.x), np.float32).reshape(-1, OWN)) for r in rows), key=lambda s: (s[0], len(s[1]), s[1].tobytes())))


def score(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, score) of every row."""
    bounded_batches(docs.sparkSession)
    kept = docs.select("doc_id", "text")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = max(1, batch.num_rows * CHUNK // max(1, batch.nbytes))
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                found = [line_features(t) for t in part.column(1).to_pylist()]
                counts = np.array([len(x) for x, _ in found])
                values = field.score(np.concatenate([x for x, _ in found]), np.concatenate([s for _, s in found]), counts)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(values, pa.float64())], names=["doc_id", "score"])

    return kept.mapInArrow(scored, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, score double")


def op10_quality_crf(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    field = train(docs, labels.where(remainder(F.col("doc_id")) != 1))
    return score(docs, field).select(
        "doc_id", (remainder(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
