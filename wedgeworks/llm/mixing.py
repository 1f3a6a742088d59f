"""Mixing sources to target weights (native).

Sizes are words. The mix shares ``budget`` times all words among the sources by weight; no target exceeds
``cap`` times its source, and what is cut there is shared again among the others. With sources ordered by
cap over weight those that are cut come first, so the level of the others is one running sum away.

Within a source, documents are expected to be taken unequally often: a document's length steps (bits of its
size) below the source's mean by words raise its expected copies above the source's share, steps over it
lower them, so that long documents don't crowd out many short ones:

    expected = share + damping * min(share, cap - share) * (mean - steps) / (largest distance from the mean)

which lies between 0 and cap and adds up to the target in words, whatever the lengths. The whole part of the
expected copies is certain. Its fraction p is the document's inclusion probability for one copy more, drawn
by Pareto order sampling: with u uniform by document, documents rank by odds(u) / odds(p), and are taken in
that order up to the rest of the target. Taking up to a number of words rather than of documents keeps each
source within half a document of its target. ``damping`` 0 makes all documents of a source alike; ``weight``
names an integer column that takes the steps' place (smaller is likelier).

No source is ranked by one task: ranks are cut at a threshold, found from word sums by source and score
interval, and only the documents of the interval in which the rest runs out are put in order. Scores are
divided by the odds of the source's own p before they are cut into intervals, so that these hold about
equally many documents at any p. Documents with p = 0 take no part in the draw. Only ``targets`` looks at
all sources in one task, a row for each.

Defined results: null text has size 0; null source is a source of its own, the last; a source with no
words has target 0. u depends on doc_id, text and ``seed`` alone, and all sums that decide are of whole
numbers, so reruns agree; rows with the same id and text are drawn together, rows that share an id (or have
none) but not the text apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import small_side, stored, table

WEIGHTS = (3, 1, 2)
DAMPING = 0.5
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; null: 0."""
    parts = F.split(F.coalesce(text, F.lit("")), GAP)
    return (
        F.size(parts)
        - F.when(F.element_at(parts, 1) == "", 1).otherwise(0)
        - F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    ).cast("long")


def source_key(source: Column) -> Column:
    """Orders by code point, null last; never null."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def targets(by_source: DataFrame, weights=WEIGHTS, budget: float = 1.5, cap: int = 2) -> DataFrame:
    """Adds target to (skey, source_size), a row a source."""
    cycle = F.array(*[F.lit(w) for w in weights])
    ranked = by_source.withColumn("w", F.element_at(cycle, (F.row_number().over(W.orderBy("skey")) - 1) % len(weights) + 1).cast("long"))
    by_level = W.orderBy(F.col("source_size") * cap / F.col("w"), "skey")
    before = by_level.rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    level = (F.sum("source_size").over(every) * F.lit(float(budget)) - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * cap) / (
        F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0))
    )
    # the level at the first source that isn't cut holds for all that follow
    leveled = ranked.withColumn("level", level).withColumn("open", F.col("level") * F.col("w") <= F.col("source_size") * cap)
    lowest = F.min(F.when(F.col("open"), F.struct(F.col("source_size") * cap / F.col("w"), "skey", "level"))).over(every)["level"]
    return leveled.select(
        *by_source.columns, F.coalesce(F.least(lowest * F.col("w"), (F.col("source_size") * cap).cast("double")), F.lit(0.0)).alias("target")
    )


def random_bits(doc_id: Column, text: Column, seed: int) -> Column:
    """52 bits from a digest of the id and the text."""
    said = F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(str(seed)), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substr(F.md5(said), F.lit(1), F.lit(13)), 16, 10).cast("long")


def measured(docs: DataFrame, weight: str | None = None, seed: int = 9) -> DataFrame:
    """Adds skey, size, steps and bits, on which all that follows works."""
    rows = docs.withColumns({"skey": source_key(F.col("source")), "size": word_count(F.col("text")), "bits": random_bits(F.col("doc_id"), F.col("text"), seed)})
    return rows.withColumn("steps", F.coalesce(F.col(weight).cast("long"), F.lit(0)) if weight else F.length(F.bin(F.col("size") + 1)).cast("long"))


def scored(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """Adds each row's certain copies, p, Pareto score, mapped into (0, 1), and the score interval that holds it."""
    rows = sized.join(small_side(goals), "skey")
    expected = F.col("_share") + F.col("_reach") * F.coalesce(F.try_divide(F.col("_mean") - F.col("steps"), "_spread"), F.lit(0.0))
    rows = rows.withColumn("_expected", expected).withColumn("_whole", F.floor("_expected").cast("long")).withColumn("_p", F.col("_expected") - F.col("_whole"))
    odds = lambda p: F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9)) / (1 - F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9)))
    u = (F.col("bits") + F.lit(0.5)) / F.lit(float(2**52))
    score = (u / (1 - u)) / odds(F.col("_p")) * odds(F.col("_middle"))
    return rows.withColumn("_s", score / (1 + score)).withColumn("_cell", F.least(F.floor(F.col("_s") * F.col("_cells")), F.col("_cells") - 1))


def allocation(sized: DataFrame, weights=WEIGHTS, budget: float = 1.5, cap: int = 2, damping: float = DAMPING, interval_docs: int = 2_000) -> DataFrame:
    """A row a source: its target, what its documents' expected copies follow from, and the last (score, doc_id) that is drawn.

    interval_docs: about how many documents of a source share a score interval.
    """
    by_source = sized.groupBy("skey").agg(
        F.sum("size").alias("source_size"), F.count("*").alias("_docs"), F.sum(F.col("size") * F.col("steps")).alias("_steps"), F.min("steps").alias("_low"), F.max("steps").alias("_high")
    )
    goals = targets(by_source, weights, budget, cap)
    goals = goals.withColumns({"_share": F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)), "_mean": F.coalesce(F.try_divide("_steps", "source_size"), F.lit(0.0))})
    goals = goals.withColumns({
        "_spread": F.greatest(F.col("_high") - F.col("_mean"), F.col("_mean") - F.col("_low")),
        "_reach": F.least(F.col("_share"), cap - F.col("_share")) * F.lit(float(damping)),
        "_cells": F.ceil(F.col("_docs") / F.lit(interval_docs)).cast("long"),
    })
    same = F.floor(F.col("_share") - F.col("_reach")) == F.floor(F.col("_share") + F.col("_reach"))
    goals = goals.withColumn("_middle", F.when(same, F.col("_share") - F.floor("_share")).otherwise(0.5))
    goals = stored(goals.select("skey", "source_size", "target", "_share", "_mean", "_spread", "_reach", "_middle", "_cells"), "mix-goals")
    drawn = F.when(F.col("_p") > 0, F.col("size")).otherwise(0)
    sums = scored(sized, goals).groupBy("skey", "_cell").agg(F.sum(drawn).alias("_words"), F.sum(F.col("_whole") * F.col("size")).alias("_certain"))
    sums = sums.withColumn("_certain", F.sum("_certain").over(W.partitionBy("skey"))).join(small_side(goals.select("skey", "target")), "skey")
    sums = sums.withColumn("_rest", F.col("target") - F.col("_certain")).drop("target", "_certain")
    running = W.partitionBy("skey").orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_words").over(running), F.lit(0)))
    ends = (F.col("_rest") > 0) & (F.col("_before") <= F.col("_rest")) & (F.col("_before") + F.col("_words") > F.col("_rest"))
    cuts = sums.groupBy("skey").agg(F.first("_rest").alias("_rest"), F.min(F.when(ends, F.struct("_cell", "_before"))).alias("_cut"))
    goals = stored(goals.join(cuts, "skey"), "mix-cuts")
    inside = W.partitionBy("skey").orderBy("_s", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    near = scored(sized, goals.where("_cut is not null")).where((F.col("_cut._cell") == F.col("_cell")) & (F.col("_p") > 0))
    near = near.withColumn("_before", F.col("_cut._before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    last = near.where(F.col("_before") + F.col("size") * F.lit(0.5) <= F.col("_rest"))
    return stored(goals.join(last.groupBy("skey").agg(F.max(F.struct("_s", "doc_id")).alias("_last")), "skey", "left"), "mix-plan")


def allotted(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds source_size, target, copies and taken to measured rows."""
    picked = scored(rows, plan)
    at_cut = (F.col("_cell") == F.col("_cut._cell")) & (F.struct("_s", "doc_id") <= F.col("_last"))
    extra = (
        F.when((F.col("_rest") <= 0) | (F.col("_p") <= 0), 0)
        .when(F.col("_cut").isNull() | (F.col("_cell") < F.col("_cut._cell")), 1)
        .when(F.col("_last").isNotNull() & at_cut, 1)
        .otherwise(0)
    )
    picked = picked.withColumn("copies", F.col("_whole") + extra).withColumn("taken", F.col("copies") * F.col("size"))
    return picked.select(*rows.columns, "source_size", "target", "copies", "taken")


def mix(docs: DataFrame, weights=WEIGHTS, budget: float = 1.5, cap: int = 2, damping: float = DAMPING, weight: str | None = None, seed: int = 9) -> DataFrame:
    """Adds size, source_size, target, copies and taken to rows with doc_id, text and source (and weight)."""
    rows = measured(docs.drop("skey", "size", "steps", "bits", "source_size", "target", "copies", "taken"), weight, seed)
    sized = stored(rows.select("doc_id", "skey", "size", "steps", "bits"), "mix-sizes")
    return allotted(rows, allocation(sized, weights, budget, cap, damping)).drop("skey", "steps", "bits")


def op9_mixing(spark, sf_dir):
    rows = measured(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    sized = stored(rows.select("doc_id", "skey", "size", "steps", "bits"), "mix-sizes")
    return allotted(sized, allocation(sized)).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
with sized as (select doc_id, case when source is null then '1' else '0' || source end as skey,
    cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
    cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || '|9|' || md5(coalesce(text, ''))), 1, 13) as bigint) as bits from documents),
stepped as (select *, cast(length(ltrim(bin(size + 1), '0')) as bigint) as steps from sized),
src as (select skey, cast(sum(size) as bigint) as source_size, cast(sum(size * steps) as bigint) as steps_sum, min(steps) as low, max(steps) as high from stepped group by 1),
ranked as (select *, [3, 1, 2][cast((row_number() over (order by skey) - 1) % 3 + 1 as int)] as w from src),
leveled as (select *, (sum(source_size) over () * 1.5::double
      - coalesce(sum(source_size) over (order by source_size * 2 / w, skey rows between unbounded preceding and 1 preceding), 0) * 2)
    / (sum(w) over () - coalesce(sum(w) over (order by source_size * 2 / w, skey rows between unbounded preceding and 1 preceding), 0)) as level from ranked),
goals as (select skey, source_size, low, high, least(w * (select level from leveled where level * w <= source_size * 2
      order by source_size * 2 / w, skey limit 1), source_size * 2.0::double) as target,
    coalesce(steps_sum::double / nullif(source_size, 0)::double, 0) as mean from leveled),
shared as (select *, coalesce(target / nullif(source_size, 0), 0) as share, greatest(high - mean, mean - low) as spread from goals),
parts as (select s.*, source_size, target, share + least(share, 2 - share) * 0.5::double * coalesce((mean - steps) / nullif(spread, 0), 0) as expected,
    (bits + 0.5::double) / 4503599627370496.0::double as u from stepped s join shared using (skey)),
odds as (select *, floor(expected) as whole, expected - floor(expected) as p, least(greatest(expected - floor(expected), 1e-9::double), 1 - 1e-9::double) as c from parts),
score as (select *, (u / (1 - u)) / (c / (1 - c)) as q, target - sum(cast(whole as bigint) * size) over (partition by skey) as rest from odds),
runs as (select *, coalesce(sum(size) over (partition by skey, p > 0 order by q, doc_id rows between unbounded preceding and 1 preceding), 0) as before from score)
select doc_id, size, source_size, target, cast(size * (whole + case when rest > 0 and p > 0 and before + size * 0.5::double <= rest then 1 else 0 end) as bigint) as taken from runs
"""
