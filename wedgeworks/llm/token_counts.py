"""Token counts without token ids.

The tokenizers that this serves drop white space: their splitting pattern never matches across it, and
nothing before the pattern (NFC, white space to a blank, lower case, special strings) reaches across ASCII
white space, which neither composes nor is reordered. So the tokens of a text are the tokens of its runs
between ASCII white space, its pre-tokens here, and each run goes through the library's whole pipeline.

1. Every text's pre-tokens are counted, added up by task, then over all texts: the distinct pre-tokens.
2. The library counts the pieces of each distinct pre-token once; the dictionary (word, n, tokens) is stored.
3. Each document's pre-token frequencies are joined to the dictionary and summed. The most frequent entries,
   at most ``KNOWN`` of at most ``KNOWN_BYTES`` bytes, are joined where the texts lie (a broadcast of that
   size at most); all others are shuffled as (row, word, frequency) and joined with the whole dictionary.

A tokenizer of another make has its texts counted whole.

Defined results: null and empty texts have 0 bytes and 0 tokens; strings of special tokens inside a text
are one token each, as the library has it by default; every row has a key of its own, so rows that share
an id, or have none, are counted apart; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, stored, table

KNOWN, KNOWN_BYTES = 1 << 18, 64
#: Distinct pre-tokens that a task adds up before it hands them on.
HELD = 200_000
#: Steps before the pattern, and a pattern, for which white space separates; fixed values of the tokenizer's file.
STEPS = ("NFC", "Replace", "Lowercase")
BLANKS = {"pattern": {"Regex": r"\s+"}, "content": " "}
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LIBRARY: dict[str, object] = {}


def library(path: str):
    if path not in _LIBRARY:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        made = Tokenizer.from_file(path)
        made.no_truncation()
        made.no_padding()
        _LIBRARY[path] = made
    return _LIBRARY[path]


def drops_white_space(path: str) -> bool:
    """Whether counts of a text's runs between ASCII white space add up to the count of the text."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    split = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    blanks = [{k: s.get(k) for k in BLANKS} for s in steps if s["type"] == "Replace"]
    apart = all(not any(x[k] for k in ("single_word", "lstrip", "rstrip")) and not set(x["content"]) & set(" \t\n\r\x0b\x0c") for x in spec.get("added_tokens", []))
    return (
        apart and tuple(s["type"] for s in steps) == STEPS and blanks == [BLANKS] and spec.get("post_processor") is None
        and (split.get("behavior"), split.get("invert"), split.get("pattern")) == ("Removed", True, {"Regex": PATTERN})
    )


def lengths(path: str, texts: list[bytes]) -> list[int]:
    """The library's count of each text, whole."""
    return [len(e.ids) for e in library(path).encode_batch([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]


def dictionary(bodies: DataFrame, path: str, held: int = HELD) -> DataFrame:
    """(word, n, tokens): every distinct pre-token of bodies (body), its frequency and its number of pieces; stored."""

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for body in batch.column(0):
                seen.update(body.as_py().split())
                if len(seen) > held:
                    yield rows()
                    seen.clear()
        yield rows()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lengths(path, batch.column(0).to_pylist()), pa.int64())], names=["word", "n", "tokens"])

    words = bodies.where("body is not null").mapInArrow(met, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return stored(words.mapInArrow(counted, "word binary, n bigint, tokens bigint"), "pre-tokens")


def frequent(words: DataFrame, known: int = KNOWN, known_bytes: int = KNOWN_BYTES) -> dict[bytes, int]:
    """At most known entries of the dictionary: those of a frequency of at least a power of two that lets no more through."""
    short = words.where(F.length("word") <= known_bytes)
    power = F.floor(F.log2("n")).cast("int")
    total, least = 0, None
    for row in short.groupBy(power.alias("power")).count().orderBy(F.desc("power")).collect():  # a row a power of two
        total += row["count"]
        if total > known:
            break
        least = row.power
    if least is None:
        return {}
    return {bytes(r.word): r.tokens for r in short.where(F.col("n") >= 2**least).select("word", "tokens").collect()}


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, known: int = KNOWN, held: int = HELD) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("body"))
    schema = f"row bigint, id {rows.schema['id'].dataType.simpleString()}, n_bytes bigint, n_tokens bigint"
    done = [F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = [x or b"" for x in batch.column(2).to_pylist()]
            n = [lengths(tokenizer_path, [x])[0] for x in bodies]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(list(map(len, bodies)), pa.int64()), pa.array(n, pa.int64())], names=["row", "id", "n_bytes", "n_tokens"])

    if not drops_white_space(tokenizer_path):
        return rows.mapInArrow(whole, schema).select(*done)
    words = dictionary(rows.select("body"), tokenizer_path, held)
    near = spark.sparkContext.broadcast(frequent(words, known))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = near.value
        for batch in batches:
            sizes, sums, rest = [], [], []
            for body in batch.column(2):
                found = body.as_py() or b""
                sizes.append(len(found))
                frequency = Counter(found.split())
                sums.append(sum(n * tokens.get(w, 0) for w, n in frequency.items()))
                rest.append([x for x in frequency.items() if x[0] not in tokens])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), pa.array(rest, pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())])))],
                names=["row", "id", "n_bytes", "n_tokens", "rest"],
            )

    parts = stored(rows.mapInArrow(summed, schema + ", rest array<struct<word:binary,n:bigint>>"), "token-sums")
    far = parts.select("row", F.inline("rest")).join(words.select("word", "tokens"), "word").groupBy("row").agg(F.sum(F.col("n") * F.col("tokens")).alias("far"))
    both = parts.select("row", "id", "n_bytes", "n_tokens").join(far, "row", "left")
    return both.withColumn("n_tokens", F.col("n_tokens") + F.coalesce("far", F.lit(0))).select(*done)


def op7_token_counts(spark, sf_dir):
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
