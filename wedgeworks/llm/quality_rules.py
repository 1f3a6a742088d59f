"""Quality rules as a short-circuit cascade (native).

Each rule rejects a text. On a bounded sample the cascade estimates what every rule costs and which texts it
rejects, then orders rules greedily: next comes the rule that rejects most of the texts still standing per
cost on them. A text is tested rule by rule in one conditional expression and leaves at the first rejection,
so expensive rules see few texts. The order changes the cost only: a text is kept exactly if no rule rejects it.

The sample is the ``sample_rows`` texts with the smallest hashes of their ids, over all files (texts beyond
``SAMPLE_CHARS`` are left out of the sample, never of judging). Cost is counted, not timed: how many characters,
words and lines a rule has to look at in a text, in units of a character passed by a pattern. So the order is
the same in every run; it is logged.

Words are runs of characters other than ASCII white space. Repeated three-word windows are found by
their hashes, which have no false negatives, and comparing the words of those that meet.

Defined results: null text counts as empty, has 0 words and is rejected; rows are independent of each
other, so ties and repeats agree; an empty table gives an empty result.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table
from .mixing import GAP

SYMBOLS = r"[#*$%&|<>]"
LETTER = r"\p{L}"
BULLET = r"^[\x20\x09]*[-*\u2022\u2023\u25e6]"
ELLIPSIS = r"(?:\.\.\.|\u2026)[\x20\x09\x0d]*$"
SAMPLE_ROWS, SAMPLE_CHARS = 400, 1 << 17
#: Units of cost: a step over a word, hashing and ordering a window of words, a line.
PER_WORD, PER_WINDOW, PER_LINE = 2, 12, 4
WORDS = "_words"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, whatever the optimizer joins."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_list(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))


def repeat_words(words: Column) -> Column:
    """How many words lie in three-word windows that occur twice or more.

    Window hashes that are all different settle most texts. For others the hashes are sorted as numbers whose
    low bits hold the window's place, and neighbours with one hash compare their words. Should those differ,
    or the text be too long for the low bits, the windows themselves are sorted.
    """
    bits = 20

    def starts(w: Column) -> Column:
        return F.sequence(F.lit(0), F.size(w) - 3)

    def covered(places: Column) -> Column:
        return F.size(F.array_distinct(F.flatten(F.transform(places, lambda i: F.array(i, i + 1, i + 2)))))

    def equal(w: Column, i: Column, j: Column) -> Column:
        return (F.get(w, i) == F.get(w, j)) & (F.get(w, i + 1) == F.get(w, j + 1)) & (F.get(w, i + 2) == F.get(w, j + 2))

    def by_words(w: Column) -> Column:
        windows = F.sort_array(F.transform(starts(w), lambda i: F.struct(F.get(w, i).alias("a"), F.get(w, i + 1).alias("b"), F.get(w, i + 2).alias("c"), i.alias("i"))))
        same = lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])
        twice = lambda s: F.filter(s, lambda x, j: F.coalesce((j > 0) & same(x, F.get(s, j - 1)), F.lit(False)) | F.coalesce(same(x, F.get(s, j + 1)), F.lit(False)))
        return let(windows, lambda s: covered(F.transform(twice(s), lambda x: x["i"])))

    def by_hash(w: Column, codes: Column) -> Column:
        place = lambda x: x.bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
        alike = lambda x, y: F.shiftright(x.bitwiseXOR(y), bits) == 0
        keys = F.sort_array(F.transform(codes, lambda c, i: c.bitwiseAND(F.lit(-1 << bits)).bitwiseOR(i.cast("long"))))
        near = lambda k: F.filter(k, lambda x, j: F.coalesce((j > 0) & alike(x, F.get(k, j - 1)), F.lit(False)) | F.coalesce(alike(x, F.get(k, j + 1)), F.lit(False)))
        clash = lambda t: F.exists(F.transform(t, lambda x, j: F.coalesce(alike(x, F.get(t, j + 1)) & ~equal(w, place(x), place(F.get(t, j + 1))), F.lit(False))), lambda x: x)
        return let(let(keys, near), lambda t: F.when(clash(t), by_words(w)).otherwise(covered(F.transform(t, place))))

    def counted(w: Column) -> Column:
        codes = F.transform(starts(w), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return let(codes, lambda c: F.when(F.size(F.array_distinct(c)) == F.size(c), 0).when(F.size(c) >= 1 << bits, by_words(w)).otherwise(by_hash(w, c)))

    return let(words, lambda w: F.when(F.size(w) < 4, 0).otherwise(counted(w))).cast("long")


def base_columns(text: Column, words: Column) -> dict[str, Column]:
    lines, full = lines_with_words(text), F.coalesce(text, F.lit(""))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.length(full).cast("long") - F.length(F.regexp_replace(full, SYMBOLS + "+", "")),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeat_words(words),
    }


def share(part: Column, of: Column) -> Column:
    return part / F.greatest(of, F.lit(1))


class Rule(NamedTuple):
    rejects: Column
    work: Column


def rules(text: Column, words: Column, min_words: int = 50) -> dict[str, Rule]:
    """Whether each rule rejects the text, and what it looks at. Thresholds follow common published heuristics for web text."""
    full = F.coalesce(text, F.lit(""))
    without = lambda pattern: F.length(full) - F.length(F.regexp_replace(full, pattern, ""))
    lettered = F.size(F.filter(words, lambda x: F.rlike(x, F.lit(LETTER))))
    lines = lines_with_words(full)
    of_lines = lambda pattern: share(F.size(F.filter(lines, lambda x: F.rlike(x, F.lit(pattern)))), F.size(lines))
    chars, n, n_lines = F.length(full), F.size(words), F.size(F.split(full, "\n"))
    return {
        "few_words": Rule(n < min_words, F.lit(1)),
        "repeats": Rule(repeat_words(words) * 100 > n * 50, n * PER_WINDOW),
        "symbols": Rule(share(without(SYMBOLS + "+"), n) > 0.25, chars),
        "shouting": Rule(let(without(r"\p{Lu}+"), lambda up: (up > 50) & (up > without(r"\p{Ll}+"))), chars + F.when(without(r"\p{Lu}+") > 50, chars).otherwise(0)),
        "exclaiming": Rule(share(without(r"[!?]+"), n) > 0.5, chars),
        "no_letters": Rule(share(lettered, n) < 0.5, n * PER_WORD),
        "word_length": Rule(let(share(F.length(F.array_join(words, "")), n), lambda x: (n > 0) & ((x < 2) | (x > 15))), chars),
        "dup_lines": Rule(let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))) * 2 > F.size(x)), chars + n_lines * PER_LINE),
        "bullets": Rule((F.size(lines) > 1) & (of_lines(BULLET) > 0.9), chars + n_lines * PER_LINE),
        "ellipses": Rule((F.size(lines) > 1) & (of_lines(ELLIPSIS) > 0.3), chars + n_lines * PER_LINE),
    }


def with_words(docs: DataFrame) -> DataFrame:
    """Adds the word list, on which most rules work, so that a text is split once."""
    return docs.withColumn(WORDS, word_list(F.col("text")))


def measured_order(docs: DataFrame, tests: dict[str, Rule], sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id") -> list[str]:
    """Rule names by rejections per cost, on a sample by hash of all rows with a text (docs: that id, text, words)."""
    names = list(tests)
    key = F.xxhash64(id_col if id_col in docs.columns else "text")
    # tasks hand on the rows below a hash that about twice the sample lies below, so what travels doesn't grow with the tasks
    least = int(2**64 * min(1.0, 2 * sample_rows / max(1, docs.count()))) - 2**63 - 1
    sample = docs.where((key <= F.lit(least)) & (F.length("text") <= SAMPLE_CHARS)).orderBy(key, "text").limit(sample_rows)
    found = sample.select(*[tests[n].rejects.alias(n) for n in names], *[tests[n].work.cast("double").alias(f"work {n}") for n in names]).collect()
    order: list[str] = []
    standing = [({n: bool(r[n]) for n in names}, {n: r[f"work {n}"] for n in names}) for r in found]
    while len(order) < len(names):
        rated = []
        for n in (x for x in names if x not in order):
            cost = max(1.0, sum(work[n] for _, work in standing))
            rated.append((sum(rejects[n] for rejects, _ in standing) / cost, -cost, n))
        order.append(max(rated)[2])
        standing = [r for r in standing if not r[0][order[-1]]]
    logging.getLogger(__name__).info("rules in order: %s; of %d sampled texts %d stand", ", ".join(order), len(found), len(standing))
    return order


def cascade(tests: dict[str, Rule], order: list[str]) -> Column:
    """Name of the first rule that rejects, null if none does."""
    verdict = F.when(tests[order[0]].rejects, order[0])
    for name in order[1:]:
        verdict = verdict.when(tests[name].rejects, name)
    return verdict


def judge(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, min_words: int = 50) -> DataFrame:
    """Adds rejected_by (null for rows to keep) to rows with a ``text``.

    Words are bound inside the one verdict expression, so a filter on it that Spark moves down still splits once.
    """
    docs = docs.drop("rejected_by")
    sampled = with_words(docs.select(*[c for c in ("doc_id", "text") if c in docs.columns]))
    order = measured_order(sampled, rules(F.col("text"), F.col(WORDS), min_words), sample_rows)
    return docs.withColumn("rejected_by", let(word_list(F.col("text")), lambda w: cascade(rules(F.col("text"), w, min_words), order)))


def keep_good(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, min_words: int = 50) -> DataFrame:
    return judge(docs, sample_rows, min_words).where("rejected_by is null").drop("rejected_by")


def op3_quality_rules(spark, sf_dir):
    docs = with_words(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text, words = F.col("text"), F.col(WORDS)
    tests = {n: c for n, c in rules(text, words).items() if n not in ("few_words", "repeats")}  # those two are the base
    order = measured_order(docs, tests)
    base = docs.withColumns(base_columns(text, words))
    base = base.withColumn("base_failed", (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50))
    verdict = F.when(F.col("base_failed"), F.lit(False)).otherwise(cascade(tests, order).isNull())
    return base.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", verdict.alias("kept"))


SQL = r"""
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
g as (select doc_id, i, ws[i] as a, ws[i + 1] as b, ws[i + 2] as c from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from w where len(ws) > 2)),
m as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, a, b, c) as n from g) where n > 1),
c as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from m) group by 1),
f as (select w.doc_id, t, ws, ls, cast(len(ws) as bigint) as n_words, cast(length(array_to_string(ws, '')) as bigint) as word_chars,
    cast(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols, cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines, coalesce(c.n, 0) as n_repeat_words
  from w left join c using (doc_id)),
j as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, greatest(n_words, 1)::double as one,
    length(regexp_replace(t, '\P{Lu}', '', 'g')) as up, length(regexp_replace(t, '\P{Ll}', '', 'g')) as low, length(regexp_replace(t, '[^!?]', '', 'g')) as cries,
    len(list_filter(ws, lambda x: regexp_matches(x, '\p{L}'))) as lettered,
    len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09]*[-*\x{2022}\x{2023}\x{25e6}]'))) as bulleted,
    len(list_filter(ls, lambda x: regexp_matches(x, '(?:\.\.\.|\x{2026})[\x20\x09\x0d]*$'))) as trailed from f)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or n_symbols / one > 0.25 or (up > 50 and up > low) or cries / one > 0.5 or lettered / one < 0.5 or n_dup_lines * 2 > len(ls)
    or (n_words > 0 and (word_chars / one < 2 or word_chars / one > 15)) or (len(ls) > 1 and (bulleted / len(ls) > 0.9 or trailed / len(ls) > 0.3))) as kept from j
"""
