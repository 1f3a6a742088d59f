"""Personal data spans by weak supervision (native).

Candidates are the matches of four base patterns (those that pass their check are always reported) and of
four looser ones, wide enough to take in much that is no personal data: obfuscated addresses, long
addresses, card-like and phone-like groups of digits of any grouping. On each candidate five labelers vote
yes, no or nothing: shape, check (length, checksum, ranges), gazetteer (top-level domains, calling codes,
issuer prefixes, public address ranges), words before it that speak for the kind, and surroundings that speak
against it (words, glued letters, a reported span of another kind in the same place). Vote patterns are
counted over all documents; expectation-maximisation on the counts estimates each labeler's reliability by
kind and each pattern's probability.

The final decision is a span classifier's, one for each kind, trained on those probabilities: logistic, on
what the span and its surroundings look like (FEATURES: length, digits, separators, how it begins, its own
checks, characters and words around it), which the labelers don't see, or see by halves. It is trained on the
``SAMPLE_PATTERNS`` most frequent patterns of votes and features, and applied to every loose candidate as one
sum of weights. There are at most 4 * 3^5 vote patterns, whatever the corpus.

Base patterns are written with possessive quantifiers and look-behinds that match the same spans as the
plain forms without backtracking over long runs.

Positions come from splitting the text at the matches and adding up lengths in code points.

Defined results: null text is empty; spans of different kinds may overlap; looser candidates that overlap a
reported base span of their kind are dropped; rows are independent but for the fitted model.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, table
from .quality_rules import let

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("shape", "check", "gazetteer", "before", "against")
FEATURES = ("length", "digits", "separators", "start", "check", "gazetteer", "char_before", "char_after", "word_before", "word_after")
PATTERN_TYPE = "array<struct<k:int,s:int,e:int,base:boolean,key:string,f:array<int>>>"
#: Patterns of votes and features that the span classifiers are trained on.
SAMPLE_PATTERNS = 20_000

BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\x20?[\[(]at[\])]\x20?|\x20at\x20)[A-Za-z0-9-]++(?:(?:\x20?[\[(]dot[\])]\x20?|\x20dot\x20)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9-])[0-9]{4}(?:[\x20-]?[0-9]{2,6}){2,4}(?![0-9-])",
    "phone": r"(?<![0-9+.-])(?:\+[0-9]{1,3}[\x20.-]?)?\(?[0-9]{2,4}\)?(?:[\x20.-]{1,2}\(?[0-9]{2,4}\)?){1,4}(?![0-9.-])",
}
#: Shapes that speak neither for nor against a looser candidate; other shapes speak against it.
USUAL = {
    "card": r"^(?:3[47][0-9]{2}[\x20-]?[0-9]{6}[\x20-]?[0-9]{5}|[3-6][0-9]{3}(?:[\x20-]?[0-9]{4}){3})$",
    "phone": r"^(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}$",
}
#: Cheap conditions without which a pattern can't match.
NEEDS = {
    ("email", True): lambda t: F.contains(t, F.lit("@")),
    ("ip", True): lambda t: F.rlike(t, F.lit(r"[0-9]\.[0-9]")),
    ("card", True): lambda t: F.rlike(t, F.lit(r"[0-9](?:[\x20-]?[0-9]){15}")),
    ("phone", True): lambda t: F.contains(t, F.lit("+")),
    ("email", False): lambda t: F.rlike(t, F.lit(r"[\x20\[(]dot[\x20\])]")),
    ("ip", False): lambda t: F.rlike(t, F.lit(r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]")),
    ("card", False): lambda t: F.rlike(t, F.lit(r"[0-9]{4}[\x20-]?[0-9]{2}")),
    ("phone", False): lambda t: F.rlike(t, F.lit(r"[0-9][)\x20.-]{1,3}\(?[0-9]{2}")),
}
# fixed values: common top-level domains, calling codes, issuer prefixes, and words around personal data
DOMAINS = r"\.(?:com|org|net|edu|gov|mil|info|biz|io|co|de|fr|es|it|nl|uk|us|eu|ch|at|be|pt|pl|ru|jp|cn|in|br|au|ca|mx|ar|example|test)$"
CALLING = r"^\+?(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35|30|36|38|62)"
RESERVED = r"^0*(?:0|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])\."
BEFORE = {
    "email": r"(?:e-?mail|mail|contact|write|kontakt|correo|courriel)\W{0,4}(?:\w{1,4}\W{1,2})?$",
    "ip": r"(?:ip|host|server|address|client|adresse|from)\W{0,4}(?:\w{1,4}\W{1,2})?$",
    "card": r"(?:card|visa|mastercard|amex|credit|karte|carte|tarjeta)\W{0,4}(?:\w{1,4}\W{1,2})?$",
    "phone": r"(?:phone|tel|call|fax|mobile|cell|telefon|t.l.phone|tel.fono)\W{0,4}(?:\w{1,4}\W{1,2})?$",
}
AGAINST = r"(?:version|ver|v|isbn|issn|doi|id|order|invoice|section|fig|figure|no|nr|sha|md5|\$|#|=)\W{0,2}$"


def occurrences(text: Column, pattern: str) -> Column:
    """Array of (s, e, hit, left, right) of a pattern's matches, left to right."""
    kind = "array<struct<s:int,e:int,hit:string,left:string,right:string>>"

    def placed(gaps: Column, hits: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            s = acc["at"] + F.length(F.get(gaps, i))
            e = s + F.length(F.get(hits, i))
            row = F.struct(
                s.alias("s"), e.alias("e"), F.get(hits, i).alias("hit"),
                F.lower(F.right(F.get(gaps, i), F.lit(40))).alias("left"),
                F.lower(F.left(F.get(gaps, i + 1), F.lit(12))).alias("right"),
            )
            return F.struct(e.alias("at"), F.array_append(acc["out"], row).alias("out"))

        start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.size(hits) - 1), start, step, lambda acc: acc["out"])

    return let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda hits: F.when(F.size(hits) == 0, F.array().cast(kind)).otherwise(let(F.split(text, pattern, -1), lambda gaps: placed(gaps, hits))),
    )


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(number: Column) -> Column:
    n = F.length(number)

    def step(acc: Column, i: Column) -> Column:
        d = F.substr(number, n - i + 1, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 1, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step) % 10 == 0


def passes(kind: str, hit: Column) -> Column:
    """A base match's own check."""
    number = digits(hit)
    if kind == "ip":
        return F.rlike(hit, F.lit(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])(?:\.|$)){4}$"))
    if kind == "card":
        return let(number, lambda d: F.when(F.length(d).between(16, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(number).between(8, 15)
    return F.lit(True)


def checks(kind: str, base: bool, x: Column) -> tuple[Column, Column]:
    """Whether a candidate passes its kind's check, and is in its gazetteer."""
    hit, n = x["hit"], F.length(digits(x["hit"]))
    flat = F.regexp_replace(F.lower(hit), r"\x20?[\[(]?\bdot\b[\])]?\x20?", ".")
    check = {
        "email": F.rlike(flat, F.lit(r"\.[a-z]{2,24}$")) & ~F.rlike(flat, F.lit(r"^[.-]|\.\.|\.(?:@|$)")),
        "ip": ~F.rlike(hit, F.lit(r"(?:^|\.)0[0-9]")) if base else F.rlike(hit, F.lit("[1-9a-fA-F]")),
        "card": luhn(digits(hit)) & (n >= 13),
        "phone": (n >= 10) & (n <= 15),
    }[kind]
    gazetteer = {
        "email": F.rlike(flat, F.lit(DOMAINS)),
        "ip": ~F.rlike(hit, F.lit(RESERVED)),
        "card": F.rlike(digits(hit), F.lit(ISSUERS)),
        "phone": F.rlike(F.regexp_replace(hit, r"[\x20().-]", ""), F.lit(CALLING if base else r"^(?:\+[0-9]{1,3})?[2-9][0-9]{2}[2-9]")),
    }[kind]
    return check, gazetteer


def votes(kind: str, base: bool, x: Column, check: Column, gazetteer: Column, taken: Column) -> list[Column]:
    """LABELERS' votes; taken: whether a reported span of another kind lies there."""
    yes_no = lambda c: F.when(c, 1).otherwise(-1)
    against = F.rlike(x["left"], F.lit(AGAINST)) | F.rlike(x["left"], F.lit(r"[0-9a-z]$" if not base else r"[0-9]$")) | F.rlike(x["right"], F.lit(r"^(?:[0-9a-z]|[.,][0-9])")) | taken
    shape = F.lit(1) if base else F.when(F.rlike(x["hit"], F.lit(USUAL[kind])), 0).otherwise(-1) if kind in USUAL else F.lit(0)
    return [shape, yes_no(check), yes_no(gazetteer), F.when(F.rlike(x["left"], F.lit(BEFORE[kind])), 1).otherwise(0), F.when(against, -1).otherwise(0)]


def first_that(*tests: Column) -> Column:
    """Number of the first test that holds, or how many there are."""
    out = F.lit(len(tests))
    for i in range(len(tests) - 1, -1, -1):
        out = F.when(tests[i], i).otherwise(out)
    return out


def looks(kind: str, x: Column, check: Column, gazetteer: Column) -> list[Column]:
    """FEATURES as small numbers."""
    hit, left, right = x["hit"], x["left"], x["right"]
    n = F.length(hit)
    has = lambda text, pattern: F.rlike(text, F.lit(pattern))
    return [
        first_that(n < 8, n < 12, n < 16, n < 20, n < 28),
        let(F.length(digits(hit)) / n, lambda share: first_that(share == 0, share < 0.25, share < 0.5, share < 0.9)),
        let(F.regexp_replace(hit, r"[^\x20./-]", ""), lambda bare: first_that(bare == "", has(bare, r"^\x20+$"), has(bare, r"^-+$"), has(bare, r"^\.+$"))),
        first_that(has(hit, r"^\+"), has(hit, r"^\("), has(hit, "^0"), has(hit, "^[1-9]"), has(hit, "^[A-Za-z]")),
        F.when(check, 1).otherwise(0),
        F.when(gazetteer, 1).otherwise(0),
        first_that((left == "") | has(left, r"\n$"), has(left, r"[0-9a-z]$"), has(left, r"[\x20\x09]$"), has(left, r"[(\[<\"':=]$"), has(left, r"\|$")),
        first_that((right == "") | has(right, r"^\n"), has(right, "^[0-9a-z]"), has(right, r"^[\x20\x09]"), has(right, r"^[.,;:!?)\]>\"']"), has(right, r"^\|")),
        first_that(has(left, BEFORE[kind]), has(left, AGAINST), has(left, r"(?:^|[.!?\n])\s*$"), has(left, r"[0-9]\W*$"), has(left, r"[a-z]\W*$")),
        first_that(has(right, r"^\W*$"), has(right, r"^\W*[0-9]"), has(right, r"^\W*[a-z]")),
    ]


def candidates_of(text: Column, k: int, base: bool, found: Column | None = None) -> Column:
    """A kind's base candidates, or its loose ones that overlap none of found, the base ones of all kinds, of their own kind."""
    kind = KINDS[k]
    meets = lambda x, y: (y["s"] < x["e"]) & (x["s"] < y["e"])

    def row(x: Column) -> Column:
        taken = F.lit(False) if found is None else F.exists(found, lambda y: meets(x, y) & (y["k"] != k))

        def told(c: Column) -> Column:
            check, gazetteer = F.get(c, 0), F.get(c, 1)
            seen = F.array(*votes(kind, base, x, check, gazetteer, taken), *looks(kind, x, check, gazetteer))
            return let(seen, lambda v: F.struct(
                F.lit(k).alias("k"), x["s"].alias("s"), x["e"].alias("e"), F.lit(base).alias("base"),
                F.concat_ws("|", F.lit(kind), F.transform(v, lambda n: n.cast("string"))).alias("key"), F.slice(v, len(LABELERS) + 1, len(FEATURES)).alias("f")))

        return let(F.array(*checks(kind, base, x)), told)

    hits = occurrences(text, (BASE if base else LOOSE)[kind])
    if base:
        hits = F.filter(hits, lambda x: passes(kind, x["hit"]))
    else:
        hits = F.filter(hits, lambda x: ~F.exists(found, lambda y: meets(x, y) & (y["k"] == k)) & ((F.length(digits(x["hit"])) >= 7) if kind in USUAL else F.lit(True)))
    return F.when(NEEDS[kind, base](text), F.transform(hits, row)).otherwise(F.array().cast(PATTERN_TYPE))


def candidates(text: Column) -> Column:
    """Array of (k, s, e, base, key, f); key: kind, votes and features; f: the features."""
    base = F.concat(*[candidates_of(text, k, True) for k in range(len(KINDS))])
    return let(base, lambda b: F.concat(b, *[candidates_of(text, k, False, b) for k in range(len(KINDS))]))


@dataclass
class SpanModel:
    """Reliabilities by kind and labeler, probabilities of vote patterns, and each kind's weights by feature and value, the bias first."""

    reliability: dict[tuple[str, str], dict[int, tuple[float, float]]]
    probability: dict[str, float]
    weights: dict[str, list[list[float]]]

    def accepts(self, k: Column, f: Column) -> Column:
        """Whether the classifier of the candidate's kind takes it for personal data."""
        out = F.lit(False)
        for kind, (bias, *features) in self.weights.items():
            score = F.lit(bias[0])
            for i, values in enumerate(features):
                score = score + F.coalesce(F.get(F.array(*[F.lit(v) for v in values]), F.get(f, i)), F.lit(0.0))
            out = F.when(k == KINDS.index(kind), score > 0).otherwise(out)
        return out


def estimate(counted: dict[str, int], rounds: int = 50) -> tuple[dict, dict[str, float]]:
    """Reliabilities and probabilities from how many candidates have each vote pattern (kind|votes)."""
    reliability, posterior = {}, {}
    for kind in KINDS:
        rows = [(key, n, [int(v) for v in key.split("|")[1:]]) for key, n in sorted(counted.items()) if key.startswith(kind + "|")]
        if not rows:
            continue
        weight = np.array([n for _, n, _ in rows], float)
        seen = np.array([v for _, _, v in rows])
        p = 1 / (1 + np.exp(-1.5 * seen.sum(1)))  # majority vote to begin with
        for _ in range(rounds):
            prior = np.clip((weight * p).sum() / weight.sum(), 0.01, 0.99)
            log_odds = np.full(len(rows), np.log(prior / (1 - prior)))
            for j, labeler in enumerate(LABELERS):
                rates = {}
                for v in (-1, 0, 1):
                    mine = seen[:, j] == v
                    # smoothing that trusts a labeler a little more than chance
                    yes = (weight * p)[mine].sum() + (2.0 if v == 1 else 1.0)
                    no = (weight * (1 - p))[mine].sum() + (2.0 if v == -1 else 1.0)
                    rates[v] = (yes / ((weight * p).sum() + 4), no / ((weight * (1 - p)).sum() + 4))
                    log_odds[mine] += np.log(rates[v][0] / rates[v][1])
                reliability[kind, labeler] = rates
            p = 1 / (1 + np.exp(-np.clip(log_odds, -30, 30)))
        posterior.update({key: float(q) for (key, _, _), q in zip(rows, p, strict=True)})
    return reliability, posterior


def of_votes(key: str) -> str:
    return "|".join(key.split("|")[: 1 + len(LABELERS)])


def train(sample: dict[str, int], posterior: dict[str, float], l2: float = 0.05, rounds: int = 25) -> dict[str, list[list[float]]]:
    """Each kind's classifier: logistic, by Newton's method, on the probabilities of the sampled patterns' votes."""
    out = {}
    for kind in KINDS:
        keys = sorted(k for k in sample if k.startswith(kind + "|"))
        if not keys:
            continue
        values = np.array([[int(v) for v in key.split("|")[1 + len(LABELERS) :]] for key in keys])
        sizes = values.max(0) + 1
        starts = np.concatenate([[1], 1 + np.cumsum(sizes)])
        x = np.zeros((len(keys), starts[-1]))
        x[:, 0] = 1
        for i in range(values.shape[1]):
            x[np.arange(len(keys)), starts[i] + values[:, i]] = 1
        w = np.log1p([sample[k] for k in keys])
        target, theta = np.array([posterior[of_votes(k)] for k in keys]), np.zeros(x.shape[1])
        for _ in range(rounds):
            q = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
            theta += np.linalg.solve((x.T * (w * q * (1 - q))) @ x + l2 * np.eye(len(theta)), x.T @ (w * (target - q)) - l2 * theta)
        out[kind] = [[float(theta[0])], *([float(v) for v in theta[starts[i] : starts[i + 1]]] for i in range(values.shape[1]))]
    return out


def fit(found: DataFrame, sample_patterns: int = SAMPLE_PATTERNS) -> SpanModel:
    """The model of the candidates found (spans): all are counted, vote patterns whole, the most frequent patterns of votes and features as a sample."""
    counted = stored(found.select(F.explode("spans.key").alias("key")).groupBy("key").count(), "pii-patterns")
    votes = F.substring_index("key", "|", 1 + len(LABELERS)).alias("votes")
    by_votes = {r.votes: r.n for r in counted.groupBy(votes).agg(F.sum("count").alias("n")).collect()}
    sample = {r.key: r["count"] for r in counted.orderBy(F.desc("count"), "key").limit(sample_patterns).collect()}
    reliability, posterior = estimate(by_votes)
    return SpanModel(reliability, posterior, train(sample, posterior))


def find_spans(docs: DataFrame, keep: list[str]) -> tuple[DataFrame, SpanModel]:
    """Rows with the kept columns and spans: array of (k, s, e, base), in order of kind and start."""
    found = stored(docs.select(*keep, candidates(F.coalesce(F.col("text"), F.lit(""))).alias("spans")), "pii")
    model = fit(found)
    picked = F.filter("spans", lambda x: x["base"] | model.accepts(x["k"], x["f"]))
    ordered = F.sort_array(F.transform(picked, lambda x: F.struct(x["k"], x["s"], x["e"], x["base"])))
    return found.withColumn("spans", ordered), model


def redact(docs: DataFrame) -> DataFrame:
    """Replaces every span of ``text`` by its kind in brackets and sets n_chars; other columns stay."""
    spans, _ = find_spans(docs, docs.columns)
    by_start = F.sort_array(F.transform("spans", lambda x: F.struct(x["s"], x["e"], x["k"])))
    tags = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def step(acc: Column, x: Column) -> Column:
        fresh = x["s"] >= acc["at"]
        piece = F.concat(acc["out"], F.substr(F.col("text"), acc["at"] + 1, F.greatest(x["s"] - acc["at"], F.lit(0))), F.get(tags, x["k"]))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(fresh, piece).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate(by_start, start, step, lambda acc: F.concat(acc["out"], F.substr(F.col("text"), acc["at"] + 1)))
    out = spans.withColumn("text", F.when(F.size("spans") > 0, clean).otherwise(F.col("text"))).drop("spans")
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.length("text").cast(kind))
    return out.select(*docs.columns)


def digests(spans: DataFrame) -> DataFrame:
    """(doc_id, n_<kind>, base_sha256, spans) of rows with spans."""
    names = F.array(*[F.lit(k) for k in KINDS])
    said = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["base"])
    n_base = lambda k: F.size(F.filter("spans", lambda x: x["base"] & (x["k"] == k))).cast("long")
    counts = [n_base(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return spans.select("doc_id", *counts, F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def op5_pii(spark, sf_dir):
    return digests(find_spans(table(spark, sf_dir, "documents"), ["doc_id"])[0])


def pii_base(spark, sf_dir):
    """op5_pii without the method's spans, which SQL can't find."""
    return op5_pii(spark, sf_dir).drop("spans")


BASE_SQL = r"""
with t as (select doc_id, coalesce(text, '') as txt from documents),
p(k, kind) as (values (0, 'email'), (1, 'ip'), (2, 'card'), (3, 'phone')),
m as (select doc_id, 0 as k, regexp_extract_all(txt, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') as hits, string_split_regex(txt, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') as gaps from t
  union all select doc_id, 1, regexp_extract_all(txt, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+'), string_split_regex(txt, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+') from t
  union all select doc_id, 2, regexp_extract_all(txt, '[0-9](?:[\x20-]?[0-9])+'), string_split_regex(txt, '[0-9](?:[\x20-]?[0-9])+') from t
  union all select doc_id, 3, regexp_extract_all(txt, '\+[0-9][\x20().0-9-]+[0-9]'), string_split_regex(txt, '\+[0-9][\x20().0-9-]+[0-9]') from t),
x as (select doc_id, k, hits, gaps, unnest(range(1, len(hits) + 1)) as i from m where len(hits) > 0),
h as (select doc_id, k, hits[i] as hit, length(array_to_string(gaps[1:i], '')) + length(array_to_string(hits[1:i - 1], '')) as s, regexp_replace(hits[i], '[^0-9]', '', 'g') as d from x),
f as (select * from h where case k when 0 then true when 1 then len(list_filter(string_split(hit, '.'), lambda y: try_cast(y as double) > 255)) = 0
  when 2 then length(d) between 16 and 19 and list_sum(list_transform(range(1, length(d) + 1), lambda j: case when j % 2 = 1 then cast(d[length(d) - j + 1] as int)
    else cast(d[length(d) - j + 1] as int) * 2 - case when cast(d[length(d) - j + 1] as int) > 4 then 9 else 0 end end)) % 10 = 0
  else length(d) between 8 and 15 end),
g as (select doc_id, count(*) filter (where k = 0) as n_email, count(*) filter (where k = 1) as n_ip, count(*) filter (where k = 2) as n_card, count(*) filter (where k = 3) as n_phone,
  string_agg(kind || ':' || s || ':' || (s + length(hit)), ',' order by k, s) as said from f join p using (k) group by 1)
select t.doc_id, coalesce(n_email, 0) as n_email, coalesce(n_ip, 0) as n_ip, coalesce(n_card, 0) as n_card, coalesce(n_phone, 0) as n_phone, sha256(coalesce(said, '')) as base_sha256
from t left join g using (doc_id)
"""
