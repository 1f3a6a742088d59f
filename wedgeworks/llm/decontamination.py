"""Benchmark decontamination: exact containment of item windows in documents.

A prefix-filtered set join. Every window of ``width`` words of an item (an item of fewer words is one
window) is a set of word shingles that a document has to contain whole. With shingles ordered by rarity a
containment of 1 needs a prefix of one shingle only: the rarest one of each window is its anchor. Document
shingles are joined with anchors; the anchor's offset gives the one place where the window could lie
(positional bound), which has to lie inside the document (length bound); there all words are compared.

Rarity is how often a shingle occurs in all documents, counted in a pass of its own for the shingles of the
items only; any order gives the same matches. The index of a block of items is broadcast; a block holds at most ``block_bytes`` of item
text, and a larger benchmark is split into blocks that pass over the documents one after the other, each
result written to the shared folder before the next. Documents are never shuffled.

Defined results: null or wordless documents have 0 words and no hit; wordless items have no window;
items that share an id count once, a null id counts as the empty id; rows are independent of each other.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, discard, stored, table

#: A-Z to a-z, other ASCII but 0-9 and a-z to blanks, bytes of other characters kept.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SHINGLE = 5
PRIME = np.uint64(0x9E3779B97F4A7C15)
STATE = "hits array<bigint>, items array<string>"


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


def shingle_codes(ids: np.ndarray, k: int) -> np.ndarray:
    """A code for each run of k word numbers; windows are compared in full, so codes may clash."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    codes = ids[:n].astype(np.uint64)
    for j in range(1, k):
        codes = codes * PRIME + ids[j : j + n].astype(np.uint64)
    return codes


class WindowIndex:
    """Anchors of all windows of a block of items."""

    def __init__(self, items: list[tuple[str, bytes]], width: int):
        self.vocabulary: dict[bytes, int] = {}
        self.windows: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for name, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text)]
            for at in range(max(1, len(ids) - width + 1) if ids else 0):
                self.windows[tuple(ids[at : at + width])].add(name)
        self.windows = dict(self.windows)
        #: shingle length -> codes of all windows, sorted
        self.codes = {k: np.unique(np.concatenate([shingle_codes(np.array(w, np.int64), k) for w in self.windows if min(SHINGLE, len(w)) == k])) for k in {min(SHINGLE, len(w)) for w in self.windows}}
        self.anchors: dict[int, dict[int, set[tuple[int, int]]]] = {}
        self.sorted: dict[int, np.ndarray] = {}

    def numbers(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """All words by number in the vocabulary, -1 for others, and where texts start."""
        starts = np.cumsum([0, *map(len, texts)])
        get = self.vocabulary.get
        return np.fromiter((x for words in texts for x in map(get, words, repeat(-1))), np.int64, int(starts[-1])), starts

    def count(self, texts: list[list[bytes]], into: dict[int, np.ndarray]) -> None:
        """Adds how often each code occurs; runs across two texts count too, which only shifts the order."""
        ids, _ = self.numbers(texts)
        for k, known in self.codes.items():
            codes = shingle_codes(ids, k)
            near = np.minimum(np.searchsorted(known, codes), len(known) - 1)
            into[k] += np.bincount(near[known[near] == codes], minlength=len(known))

    def choose(self, counts: dict[int, np.ndarray]) -> None:
        """Makes the rarest shingle of each window its anchor: shingle length -> code -> {(offset, window length)}."""
        anchors: dict[int, dict[int, set[tuple[int, int]]]] = defaultdict(lambda: defaultdict(set))
        for window in self.windows:
            k = min(SHINGLE, len(window))
            own = shingle_codes(np.array(window, np.int64), k)
            seen = counts[k][np.searchsorted(self.codes[k], own)]
            offset = min(range(len(own)), key=lambda i: (seen[i], own[i]))
            anchors[k][int(own[offset])].add((offset, len(window)))
        self.anchors = {k: dict(v) for k, v in anchors.items()}
        self.sorted = {k: np.sort(np.fromiter(v, np.uint64, len(v))) for k, v in self.anchors.items()}

    def find(self, texts: list[list[bytes]]) -> dict[int, tuple[list[tuple[int, int]], set[str]]]:
        """By text: the word ranges that windows cover, and their items."""
        ids, starts = self.numbers(texts)
        found: dict[int, tuple[list[tuple[int, int]], set[str]]] = {}
        for k, anchors in self.sorted.items():
            codes = shingle_codes(ids, k)
            if not len(codes):
                continue
            near = np.minimum(np.searchsorted(anchors, codes), len(anchors) - 1)
            at = np.flatnonzero(anchors[near] == codes)
            for p, doc in zip(at.tolist(), (np.searchsorted(starts, at, "right") - 1).tolist(), strict=True):
                for offset, length in self.anchors[k][int(codes[p])]:
                    a = p - offset
                    if a < starts[doc] or a + length > starts[doc + 1]:
                        continue
                    if items := self.windows.get(tuple(ids[a : a + length].tolist())):
                        ranges, names = found.setdefault(doc, ([], set()))
                        ranges.append((a - int(starts[doc]), a - int(starts[doc]) + length))
                        names |= items
        return found


def merged(ranges: list[tuple[int, int]]) -> list[int]:
    """Sorted, disjoint, as start, end, start, end ..."""
    out: list[int] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def shingle_counts(docs: DataFrame, index: Broadcast, chunk: int) -> dict[int, np.ndarray]:
    """How often each shingle of the index occurs in all documents; a task sends one row per shingle at most."""
    codes = index.value.codes
    bodies = docs.select(F.col("text").cast("binary").alias("body")).where("body is not null")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {k: np.zeros(len(v), np.int64) for k, v in index.value.codes.items()}
        for part in (p for batch in batches for p in slices(batch, chunk)):
            index.value.count([words_of(x) for x in part.column(0).to_pylist()], seen)
        for k, n in seen.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"k": pa.array(np.full(len(at), k), pa.int32()), "i": pa.array(at, pa.int64()), "n": pa.array(n[at], pa.int64())})

    counts = {k: np.zeros(len(v), np.int64) for k, v in codes.items()}
    for r in bodies.mapInArrow(counted, "k int, i bigint, n bigint").groupBy("k", "i").agg(F.sum("n").alias("n")).collect():
        counts[r.k][r.i] = r.n
    return counts


def indexes(docs: DataFrame, items: DataFrame, width: int, block_bytes: int, chunk: int) -> Iterator[tuple[Broadcast, bool]]:
    """Broadcast indexes of the items' blocks, and whether each is the last."""
    spark = items.sparkSession
    bounded_batches(spark)
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("binary").alias("body")).where("body is not null")
    total = rows.agg(F.sum(F.length("body"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    for b in range(blocks):
        mine = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("item", "body"), F.lit(blocks)) == b)
        index = WindowIndex([(r.item, bytes(r.body)) for r in mine.collect()], width)
        counting = spark.sparkContext.broadcast(index)
        index.choose(shingle_counts(docs, counting, chunk))
        counting.destroy()
        yield spark.sparkContext.broadcast(index), b == blocks - 1


def slices(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """Parts of about size bytes, of a row at least."""
    rows = max(1, batch.num_rows * size // max(1, batch.nbytes))
    return (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))


def find_contamination(docs: DataFrame, items: DataFrame, width: int = 10, block_bytes: int = 8 << 20, chunk: int = 2_000_000) -> DataFrame:
    """(doc_id, n_words, n_hit, hits, items) of every row of docs (doc_id, text).

    hits: the covered word ranges as start, end (exclusive) in order; items: the ids of items found, sorted.
    chunk: about how many bytes of text are searched at once.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("body")).withColumns(
        {"hits": F.lit(None).cast("array<bigint>"), "items": F.lit(None).cast("array<string>")}
    )
    last = None
    for index, final in indexes(docs, items, width, block_bytes, chunk):

        def searched(batches: Iterator[pa.RecordBatch], index=index, final=final) -> Iterator[pa.RecordBatch]:
            for part in (p for batch in batches for p in slices(batch, chunk)):
                texts = [words_of(x) for x in part.column(1).to_pylist()]
                found = index.value.find(texts)
                hits, names = part.column(2).to_pylist(), part.column(3).to_pylist()
                for d, (ranges, ids) in found.items():
                    old = hits[d] or []
                    hits[d] = merged([*ranges, *zip(old[::2], old[1::2], strict=True)])
                    names[d] = sorted(ids | set(names[d] or ()))
                columns = {"doc_id": part.column(0), "body": part.column(1)} if not final else {
                    "doc_id": part.column(0), "n_words": pa.array([len(x) for x in texts], pa.int64()),
                    "n_hit": pa.array([sum(h[1::2]) - sum(h[::2]) if h else 0 for h in hits], pa.int64()),
                }
                yield pa.RecordBatch.from_pydict({**columns, "hits": pa.array(hits, pa.list_(pa.int64())), "items": pa.array(names, pa.list_(pa.string()))})

        rows = rows.mapInArrow(searched, f"doc_id {id_type}, n_words bigint, n_hit bigint, {STATE}" if final else f"doc_id {id_type}, body binary, {STATE}")
        if not final:
            rows = stored(rows, "decontamination")
            index.destroy()
            discard(last)
            last = rows
    return rows


def drop_contaminated(docs: DataFrame, items: DataFrame, width: int = 10, block_bytes: int = 8 << 20, chunk: int = 2_000_000) -> DataFrame:
    """The rows of docs, whole, in whose text no window occurs."""
    at = docs.columns.index("text")
    last = None
    for index, final in indexes(docs, items, width, block_bytes, chunk):

        def passed(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for part in (p for batch in batches for p in slices(batch, chunk)):
                found = index.value.find([words_of(x.encode() if x else None) for x in part.column(at).to_pylist()])
                yield part.filter(pa.array([i not in found for i in range(part.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(passed, docs.schema)
        if not final:
            docs = stored(docs, "decontamination")
            index.destroy()
            discard(last)
            last = docs
    return docs


def op8_decontamination(spark, sf_dir):
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.coalesce("items", F.array().cast("array<string>"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


SQL = r"""
with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
b as (select distinct cast(item_id as varchar) as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
bw as (select distinct item, least(len(ws), 10) as n, array_to_string(ws[i:i + 9], ' ') as win from (select item, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) as i from b where len(ws) > 0)),
dw as (select doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') as win
  from (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) as i from w, (select distinct n from bw) where len(ws) >= n)),
hit as (select doc_id, item, i, n from dw join bw using (n, win)),
pos as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hit) group by 1),
its as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as ids from (select distinct doc_id, item from hit) group by 1)
select w.doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from w left join pos using (doc_id) left join its using (doc_id)
"""
