"""Near-duplicate classes by BagMinHash.

A text is the multiset of its five-word shingles. Each shingle's weight axis is discretised at the integers
and covered by blocks [0,1), [1,2), [2,4), [4,8) ...; on every block runs a Poisson process in time, the
same in every text, whose points carry a weight position and one of ``ROWS * BANDS`` components. A text of
weight w sees the points below w: whole blocks, and the last one thinned. The earliest visible point of each
component is the signature, so two signatures agree at a component with probability sum(min) / sum(max), the
weighted Jaccard similarity. Points are drawn in time order for all shingles at once and stop as soon as
every component has a point earlier than the process's next one.

Texts that are equal are one node. Nodes that share a band are candidates. A bucket is never expanded into
all its pairs. Its nodes are compared with a pivot, the node whose buckets hold most nodes together: in a
group of edited copies that is the original, or what comes closest to it, in every band. Links join
components. Buckets that still hold several go on with the best pivot of each of SLOTS hashed parts. What is
left of buckets of up to SMALL_BUCKET nodes is then compared pair by pair. Larger buckets that still hold
several components are finished exactly: those that share nodes form a group, a group is cut into blocks of at
most about BLOCK_TEXTS texts and BLOCK_SHINGLES shingles, texts of one component together, and a task takes two
blocks and compares all their texts of different components. Pairs are made inside tasks only; a text travels
once for each block of its group, and blocks of one component don't meet.

A candidate of the pivots and of small buckets has to pass bounds on sizes and on a two-bit sketch of the
signatures (five standard deviations wide at the threshold) and is verified by the multiset overlap of the
whole texts. So a link can be missed only if its texts share no band (chance below 2e-7 at similarity 0.8), or,
in a bucket of up to SMALL_BUCKET nodes, fail the sketch's bound (below 3e-7). The pivots' steps are linear in the
buckets' rows; finishing is quadratic in what they leave apart.

Returned is a row for each row: doc_id, text_id (the smallest doc_id with an equal text) and class_id (the
smallest doc_id of its component). Defined results: a null text is alone, with its own doc_id in all three;
texts without words are copies of equal texts only; texts of fewer than five words are one shingle; rows with
equal or null doc_ids are classed by their texts alone, and a null doc_id counts as the largest.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, bounded_broadcast, discard, stored, table
from .components import components, joined
from .decontamination import shingle_codes, words_of

ROWS, BANDS = 5, 40
SHINGLE = 5
THRESHOLD = 0.8
SLOTS = 3
SMALL_BUCKET = 64
#: Texts, and shingles, of a block when large buckets are finished.
BLOCK_TEXTS, BLOCK_SHINGLES = 512, 250_000
#: Pairs of one pivot that are verified together.
PIVOT_PAIRS = 1_000
PLANE = 4
_U = np.uint64
#: Word hashes that a Python worker keeps; the table is emptied beyond that.
KNOWN_WORDS = 200_000
_WORDS: dict[bytes, int] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the distinct shingles and their counts."""
    import xxhash

    words = words_of(text)
    if not words:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    if len(_WORDS) > KNOWN_WORDS:
        _WORDS.clear()
    known = _WORDS
    ids = [known.get(w) for w in words]
    if None in ids:
        for i, x in enumerate(ids):
            if x is None:
                ids[i] = known[words[i]] = xxhash.xxh64_intdigest(words[i])
    codes = mix(shingle_codes(np.array(ids, _U), min(SHINGLE, len(words))))
    return np.unique(codes, return_counts=True)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], m: int = ROWS * BANDS) -> np.ndarray:
    """A row of m codes for each bag (codes, counts); bags must not be empty."""
    out = np.zeros((len(bags), m), _U)
    total = np.array([int(n.sum()) for _, n in bags])
    for low, high, step in ((0, 12, 256), (12, 60, 48), (60, 300, 12), (300, 1200, 5), (1200, 1 << 62, 2)):
        mine = np.flatnonzero((total > low) & (total <= high))
        if len(mine):
            out[mine] = _signatures([bags[i] for i in mine], m, step)
    return out


def _signatures(bags: list[tuple[np.ndarray, np.ndarray]], m: int, step: int) -> np.ndarray:
    sizes = [len(c) for c, _ in bags]
    bag = np.repeat(np.arange(len(bags)), sizes)
    code, count = np.concatenate([c for c, _ in bags]), np.concatenate([n for _, n in bags])
    parts = []
    level = 0
    while True:  # blocks of width 1, 1, 2, 4 ...
        low = 0 if level == 0 else 1 << (level - 1)
        here = np.flatnonzero(count > low)
        if not len(here):
            break
        width = 1 if level == 0 else low
        parts.append((bag[here], mix(code[here] + _U(level * 0xD1B54A32D192ED03 % 2**64)), np.full(len(here), width, float), (count[here] - low) / width))
        level += 1
    bag, seed, width, visible = (np.concatenate(x) for x in zip(*parts, strict=True))
    best = np.full(len(bags) * m, np.inf)
    held = np.zeros(len(bags) * m, _U)
    clock = np.zeros(len(bag))
    drawn = 0
    while len(bag):
        steps = np.arange(drawn + 1, drawn + step + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)
        point = mix(seed[:, None] + steps)
        gap = -np.log(((point >> _U(11)).astype(float) + 0.5) * 2.0**-53)
        time = clock[:, None] + np.cumsum(gap, 1) / (m * width)[:, None]
        second = mix(point ^ _U(0xA0761D6478BD642F))
        seen = ((second >> _U(32)).astype(float) * 2.0**-32 < visible[:, None]).ravel()
        slot = (bag[:, None] * m + ((second & _U(0xFFFFFFFF)) * _U(m) >> _U(32)).astype(np.int64)).ravel()[seen]
        early = time.ravel()[seen]
        np.minimum.at(best, slot, early)
        won = best[slot] == early
        held[slot[won]] = point.ravel()[seen][won]
        clock = time[:, -1]
        drawn += step
        latest = best.reshape(-1, m).max(1)
        on = clock < latest[bag]
        bag, seed, width, visible, clock = bag[on], seed[on], width[on], visible[on], clock[on]
    return held.reshape(-1, m)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A key for each band of each row, different between bands."""
    rows = signature.reshape(len(signature), BANDS, ROWS)
    keys = np.broadcast_to(mix(np.arange(BANDS, dtype=_U) + _U(1)), rows.shape[:2]).copy()
    for r in range(ROWS):
        keys = mix(keys ^ rows[:, :, r])
    return keys.view(np.int64)


def sketches(signature: np.ndarray) -> np.ndarray:
    """Two bits of each component as two planes of PLANE longs."""
    planes = [np.pad(((signature >> _U(b)) & _U(1)).astype(bool), ((0, 0), (0, PLANE * 64 - signature.shape[1]))) for b in (0, 1)]
    return np.concatenate([np.packbits(x, axis=1).view(np.int64) for x in planes], 1)


def most_different(threshold: float) -> int:
    """Two-bit components that differ in texts just similar enough: the mean and five standard deviations."""
    m, p = ROWS * BANDS, 0.75 * (1 - threshold)
    return int(m * p + 5 * (m * p * (1 - p)) ** 0.5)


def difference(a: Column, b: Column) -> Column:
    """In how many components two sketches differ."""
    parts = [F.bit_count(F.get(a, i).bitwiseXOR(F.get(b, i)).bitwiseOR(F.get(a, i + PLANE).bitwiseXOR(F.get(b, i + PLANE)))) for i in range(PLANE)]
    return sum(parts[1:], parts[0])


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    whole = int(a[1].sum() + b[1].sum()) - both
    return both / whole if whole else 0.0


def fingerprints(docs: DataFrame, chunk: int = 400_000) -> DataFrame:
    """(doc_id, tag, digest, n, bands, sketch) of every row with a text; n: shingles, 0 without words; tag: tells texts with one doc_id apart."""
    bounded_batches(docs.sparkSession)
    rows = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("tag"), F.col("text").cast("binary").alias("body"))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = max(1, batch.num_rows * chunk // max(1, batch.nbytes))
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                texts = part.column(2).to_pylist()
                digests = [sha256(t).digest() for t in texts]
                first = {d: i for i, d in reversed(list(enumerate(digests)))}  # copies are done once
                bags = {d: shingles(texts[i]) for d, i in first.items()}
                full = [d for d, (c, _) in bags.items() if len(c)]
                signed = signatures([bags[d] for d in full]) if full else np.zeros((0, ROWS * BANDS), _U)
                keys = dict(zip(full, zip(band_keys(signed).tolist(), sketches(signed).tolist(), strict=True), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:2], pa.array(digests, pa.binary()), pa.array([int(bags[d][1].sum()) for d in digests], pa.int64()),
                     *(pa.array([keys.get(d, ([], []))[i] for d in digests], pa.list_(pa.int64())) for i in (0, 1))],
                    names=["doc_id", "tag", "digest", "n", "bands", "sketch"],
                )

    return rows.mapInArrow(made, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, tag bigint, digest binary, n bigint, bands array<bigint>, sketch array<bigint>")


def verify(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Those of pairs (v, w) whose texts (v, body) are similar enough, as (a, b).

    A pivot w with many pairs has its text repeated for each part of them, so no task reads all its pairs.
    """
    bounded_batches(pairs.sparkSession, rows=256)
    parts = pairs.groupBy("w").agg(F.ceil(F.count("*") / F.lit(PIVOT_PAIRS)).cast("int").alias("parts"))
    held = parts.join(texts.select(F.col("v").alias("w"), F.col("body").alias("right")), "w").select("w", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "right")
    asked = pairs.join(parts, "w").select("v", "w", F.pmod(F.xxhash64("v"), "parts").cast("int").alias("part"))
    full = asked.join(texts.select("v", F.col("body").alias("left")), "v").join(held.drop("parts"), ["w", "part"])

    def tested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[bytes, tuple] = (b"", shingles(b""))
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                if held[0] != y:
                    held = (y, shingles(y))
                if overlap(shingles(x), held[1]) >= threshold:
                    keep.append(i)
            keep = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], names=["a", "b"])

    return full.select("v", "w", "left", "right").mapInArrow(tested, "a bigint, b bigint")


class Together:
    """Disjoint sets of labels."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        top = x
        while (above := self.up.get(top, top)) != top:
            top = above
        while x != top:
            self.up[x], x = top, self.up.get(x, x)
        return top

    def join(self, a: int, b: int) -> bool:
        """Whether they were apart."""
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def compared(held: pa.Table, threshold: float) -> list[tuple[int, int]]:
    """Links that join different components among all pairs between the sides, or within the one side, of held (side, v, c, body)."""
    bags = [shingles(x.as_py()) for x in held.column("body")]
    sizes = np.array([int(n.sum()) for _, n in bags], np.int64)
    side, v, c = (held.column(x).to_pylist() for x in ("side", "v", "c"))
    _, ids = np.unique(np.concatenate([x for x, _ in bags]), return_inverse=True)
    ids = np.split(ids, np.cumsum([len(x) for x, _ in bags])[:-1])
    order = np.argsort(sizes, kind="stable")
    right = [i for i in order.tolist() if side[i] == 1] or order.tolist()
    alone = 1 not in side
    left = right if alone else [i for i in order.tolist() if side[i] == 0]
    flat, weights = np.concatenate([ids[i] for i in right]), np.concatenate([bags[i][1] for i in right])
    starts = np.cumsum([0, *(len(ids[i]) for i in right)])
    counts = np.zeros(int(flat.max()) + 1 + max(int(ids[i].max()) for i in left), np.int64)
    sets, out = Together(), []
    ordered = sizes[right]
    for k, x in enumerate(left):
        # of those in order of size only the ones within the threshold; pairs of one side once
        low = k + 1 if alone else int(np.searchsorted(ordered, sizes[x] * threshold - 1e-9))
        high = int(np.searchsorted(ordered, sizes[x] / threshold + 1e-9, "right"))
        counts[ids[x]] = bags[x][1]
        for at in range(low, high, 256):
            to = min(high, at + 256)
            both = np.add.reduceat(np.minimum(counts[flat[starts[at] : starts[to]]], weights[starts[at] : starts[to]]), starts[at:to] - starts[at])
            for j in np.flatnonzero(both / (sizes[x] + ordered[at:to] - both) >= threshold).tolist():
                if sets.join(c[x], c[right[at + j]]):
                    out.append((v[x], v[right[at + j]]))
        counts[ids[x]] = 0
    return out


def finish(here: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(a, b): links between components in buckets here (key, v, n, c): every pair of different components of a group is compared."""
    stars = here.join(here.groupBy("key").agg(F.min("v").alias("b")), "key").select(F.col("v").alias("a"), "b").distinct()
    groups = components(stars).withColumnRenamed("c", "g")
    members = stored(here.select("v", "n", "c").distinct().join(groups, "v"), "members")
    many = lambda: F.greatest(F.ceil(F.count("*") / F.lit(BLOCK_TEXTS)), F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES))).cast("int")
    large = members.groupBy("g", "c").agg(many().alias("slots"), F.count("*").alias("size")).where(F.col("size") * 2 >= BLOCK_TEXTS).drop("size")
    homed = members.join(large, ["g", "c"], "left")
    rest = homed.where("slots is null").groupBy("g").agg(many().alias("rest"))
    slot = F.when(F.col("slots").isNotNull(), F.pmod(F.xxhash64("v"), "slots")).otherwise(F.pmod(F.xxhash64("c"), "rest"))
    home = F.when(F.col("slots").isNotNull(), F.col("c"))
    placed = homed.join(rest, "g", "left").select("g", home.alias("home"), F.concat_ws(":", F.coalesce(home.cast("string"), F.lit("-")), slot.cast("string")).alias("block"), "v", "c")
    placed = stored(placed, "placed")
    blocks = placed.select("g", "home", "block").distinct()
    other = blocks.select("g", F.col("home").alias("k"), F.col("block").alias("j"))
    cells = blocks.withColumnRenamed("block", "i").join(other, "g").where((F.col("i") <= F.col("j")) & F.coalesce(F.col("home") != F.col("k"), F.lit(True)))
    sides = F.when(F.col("i") == F.col("j"), F.array(F.struct(F.lit(0).alias("side"), F.col("i").alias("block")))).otherwise(
        F.array(F.struct(F.lit(0).alias("side"), F.col("i").alias("block")), F.struct(F.lit(1).alias("side"), F.col("j").alias("block")))
    )
    asked = cells.select("g", "i", "j", F.inline(sides)).join(placed.drop("home"), ["g", "block"]).drop("block")
    full = asked.join(texts, "v")

    def tested(held: pa.Table) -> pa.Table:
        found = compared(held, threshold)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return full.select("g", "i", "j", "side", "v", "c", "body").groupBy("g", "i", "j").applyInArrow(tested, "a bigint, b bigint")


def classified(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, tag, text_id, class_id, kept), a row for each row with a text; kept: whether its id and text stand for its class."""
    prints = stored(fingerprints(docs), "prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag", "n", "bands", "sketch")).alias("x")
    nodes = prints.groupBy("digest").agg(first).select(F.monotonically_increasing_id().alias("v"), "digest", F.col("x.doc_id").alias("text_id"), "x.tag", "x.n", "x.bands", "x.sketch")
    nodes = stored(nodes, "nodes")
    keyed = nodes.where("n > 0").select("v", "n", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    buckets = stored(keyed.join(shared, "key"), "buckets")
    hubs = buckets.groupBy("v").agg(F.sum("size").alias("hub"))
    hubbed = stored(buckets.join(hubs.join(nodes.select("v", "sketch"), "v"), "v"), "hubs")
    texts = stored(texts_of(docs, nodes.join(hubs, "v").select("v", "text_id", "tag")), "texts")
    classes = tested = None
    scratch = [buckets, hubbed, texts]

    def close(n: str, sketch: str, m: str, other: str) -> Column:
        sizes = F.least(n, m) >= F.greatest(n, m) * F.lit(threshold)
        return sizes & (difference(F.col(sketch), F.col(other)) <= most_different(threshold))

    for r in range(3):
        if r == 0:
            here = hubbed.withColumn("c", F.col("v"))
        else:
            here = hubbed.join(classes, "v", "left").withColumn("c", F.coalesce("c", "v"))
            several = here.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("key")
            here = stored(here.join(several, "key"), "mixed")
        if r < 2:  # one pivot of each bucket; then one of each slot
            slot = F.lit(0) if r == 0 else F.pmod(F.xxhash64("v", F.lit(r)), F.lit(SLOTS))
            pivots = here.groupBy("key", slot.alias("slot")).agg(F.max(F.struct("hub", "v", "n", "c", "sketch")).alias("p"))
            met = here.join(pivots, "key").where((F.col("c") != F.col("p.c")) & close("n", "sketch", "p.n", "p.sketch")).select("v", F.col("p.v").alias("w"))
        else:  # what is left of small buckets, whole
            few = here.where(F.col("size") <= SMALL_BUCKET).select("key", "v", "n", "c", "sketch")
            other = few.select("key", F.col("v").alias("w"), F.col("n").alias("m"), F.col("c").alias("k"), F.col("sketch").alias("other"))
            met = few.join(other, "key").where((F.col("v") < F.col("w")) & (F.col("c") != F.col("k")) & close("n", "sketch", "m", "other")).select("v", "w")
        pairs = met.distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["v", "w"], "left_anti")
        pairs = stored(pairs, "pairs")
        found = stored(verify(pairs, texts, threshold), "links")
        scratch += [pairs, found, here]
        both = pairs.unionByName(pairs.select(F.col("w").alias("v"), F.col("v").alias("w")))
        tested = both if tested is None else tested.unionByName(both)
        if r == 0:
            classes = components(found)
        elif not found.isEmpty():
            classes = joined(classes, found)
    here = hubbed.where(F.col("size") > SMALL_BUCKET).select("key", "v", "n").join(classes, "v", "left").withColumn("c", F.coalesce("c", "v"))
    several = here.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("key")
    here = stored(here.join(several, "key"), "mixed")
    scratch += [here]
    if not here.isEmpty():
        found = stored(finish(here, texts, threshold), "links")
        scratch += [found]
        if not found.isEmpty():
            classes = joined(classes, found)
    placed = nodes.select("v", "digest", "text_id", "tag").join(classes, "v", "left").withColumn("c", F.coalesce("c", "v"))
    stands = F.min(F.struct(F.col("text_id").isNull().alias("none"), F.col("text_id").alias("doc_id"), "digest", "tag")).alias("stands")
    named = stored(placed.join(placed.groupBy("c").agg(stands), "c"), "classes")
    discard(nodes, classes, *scratch)
    own = prints.select("doc_id", "tag", "digest").join(named.select("digest", "text_id", "stands"), "digest")
    kept = (F.col("digest") == F.col("stands.digest")) & F.col("doc_id").eqNullSafe(F.col("stands.doc_id"))
    return own.select("doc_id", "tag", "text_id", F.col("stands.doc_id").alias("class_id"), kept.alias("kept"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text_id, class_id), a row for each row."""
    bare = docs.where("text is null").select("doc_id", F.col("doc_id").alias("text_id"), F.col("doc_id").alias("class_id"))
    return classified(docs, threshold).select("doc_id", "text_id", "class_id").unionByName(bare)


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(v, body) of the wanted (v, text_id, tag); their table is broadcast up to a measured size, and shuffled beyond that."""
    rows = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("tag"), F.col("text").cast("binary").alias("body"))
    wanted = bounded_broadcast(stored(wanted, "wanted").withColumnsRenamed({"text_id": "_id", "tag": "_tag"}))
    found = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tag") == F.col("_tag"))).select("v", "body")
    repeated = docs.where("text is not null").groupBy("doc_id").count().where("count > 1 or doc_id is null")
    return found if repeated.isEmpty() else found.groupBy("v").agg(F.min("body").alias("body"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class, the one with the smallest doc_id (of rows that share id and text, the smallest in its columns); rows without a text stay."""
    classes = stored(classified(docs, threshold), "classes")
    if classes.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():  # ids tell rows apart
        extra = bounded_broadcast(stored(classes.where("not kept").select("doc_id"), "extra"))
        return docs.join(extra, "doc_id", "left_anti").select(*docs.columns)
    kept = classes.where("kept").select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag")).distinct()
    rows = docs.where("text is not null").withColumn("_row", F.struct(*docs.columns)).join(
        kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_tag")), "left_semi"
    )
    one = rows.groupBy("doc_id", F.xxhash64("text").alias("_tag")).agg(F.min("_row").alias("_row")).select("_row.*")
    return one.unionByName(docs.where("text is null")).select(*docs.columns)


def op1_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = r"""
with recursive d as (select doc_id, text from documents where doc_id is not null and text is not null),
t as (select text, min(doc_id) as v from d group by 1),
w as (select v, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from t),
s as (select v, array_to_string(ws[i:i + 4], ' ') as g, count(*) as c from (select v, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) as i from w where len(ws) > 0) group by 1, 2),
n as (select v, sum(c) as n from s group by 1),
p as (select a.v as x, b.v as y, sum(least(a.c, b.c)) as o from s a join s b on a.g = b.g and a.v < b.v group by 1, 2),
l as (select x, y from p join n nx on nx.v = x join n ny on ny.v = y where o / (nx.n + ny.n - o)::double >= 0.8),
e as (select x, y from l union all select y, x from l),
r as (select x, y from e union select r.x, e.y from r join e on e.x = r.y),
k as (select t.text, t.v, least(t.v, coalesce(min(r.y), t.v)) as c from t left join r on r.x = t.v group by 1, 2),
f as (select d.doc_id, k.v, k.c from d join k using (text) union all select doc_id, doc_id, doc_id from documents where text is null)
select doc_id, v as text_id, c as class_id from f
"""
