import hashlib
import random
import re

from wedgeworks.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(s):
    return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(s))) % 10 == 0


def base(text):
    out = []
    for k, kind in enumerate(pii.KINDS):
        for m in re.finditer(PLAIN[kind], text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]:
                out.append((k, m.start(), m.end()))
    return out


def card(rng):
    d = "4" + "".join(rng.choice("0123456789") for _ in range(14))
    return next(d + c for c in "0123456789" if luhn(d + c))


def texts():
    rng = random.Random(5)
    bits = ["a@b.co", "a@b.co_c@d.com", "x.y%+z@q-r.s.t.", "@b.c", "a@b", "1.2.3.4", "1.2.3.4.5.6.7.8", "999.1.1.1", "0001.2.03.4", "+1 (555) 123-4567", "+12", "++33 1 23 45 67 89", "+1-", "4111 1111 1111 1111", "4111-1111-1111-1112", "é", "日本", " ", "\n", "v", "12", ",", "."]
    out = [None, "", "a" * 6_000 + "@", "1" * 6_000, "1 " * 6_000, "a@" + "b." * 4_000 + "c", "+" * 4_000 + "1" + "0 " * 4_000, "1." * 4_000 + "1"]
    out += ["".join(rng.choice(bits) for _ in range(rng.randint(1, 14))) for _ in range(250)]
    out += [f"pay {card(rng)} now, mail: me{i}@x.org, 10.0.{i}.7" for i in range(20)]
    return out + out[:4]


def test_base_spans_equal_the_plain_patterns(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as spans", "2 as key")
    found, _ = pii.find_spans(docs, ["doc_id"])
    got = {r.doc_id: [(x.k, x.s, x.e) for x in r.spans if x.base] for r in found.collect()}
    assert got == {i: base(t) for i, t in rows}
    none, model = pii.find_spans(docs.limit(0), ["doc_id"])
    assert none.count() == 0 and model.weights == {}


def test_digests(spark):
    rows = list(enumerate(texts()))
    found, _ = pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"])
    got = {r.doc_id: r for r in pii.digests(found).collect()}
    for i, t in rows:
        spans = base(t)
        said = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in spans)
        r = got[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == n for k, _, _ in spans) for n in range(4))
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        listed = [x.split(":") for x in r.spans.split(",") if x]
        assert {(pii.KINDS.index(k), int(s), int(e)) for k, s, e in listed} >= set(spans)
        assert [(pii.KINDS.index(k), int(s)) for k, s, _ in listed] == sorted((pii.KINDS.index(k), int(s)) for k, s, _ in listed)


def test_classifier_sees_what_labelers_do_not(spark):
    """Groups of digits with equal votes are told apart by what they look like and stand in; wide candidates are turned down."""
    rng = random.Random(2)
    number = lambda: f"{rng.randint(200, 999)}-{rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
    rows = [f"please call {number()} today" for _ in range(120)]
    rows += [f"cells | {rng.randint(10, 99)} {rng.randint(100, 999)} {rng.randint(10, 99)} {rng.randint(10, 99)} | end" for _ in range(120)]
    rows += [f"on 20{rng.randint(10, 30)}-0{rng.randint(1, 9)}-{rng.randint(10, 28)} it" for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found, model = pii.find_spans(docs, ["doc_id", "text"])
    hit = {r.text: len(r.spans) for r in found.collect()}
    assert all(n == 1 for t, n in hit.items() if t.startswith("please")) and not any(n for t, n in hit.items() if not t.startswith("please"))
    assert len(model.weights["phone"]) == 1 + len(pii.FEATURES)


def test_looser_spans_need_the_labelers(spark):
    rng = random.Random(6)
    rows = [f"phone: +1 (555) 123-{n:04d} or mail: user{n}@site.org" for n in range(200)]
    rows += [f"call {a}-{b}-{c} today" for a, b, c in ((rng.randint(200, 999), rng.randint(200, 999), rng.randint(1000, 9999)) for _ in range(60))]
    rows += ["contact jane.doe (at) site (dot) org please"] * 40
    rows += [f"und +1 (555) 123-{n:04d} 190.137.223.{n} der" for n in range(30)]  # one base match with too many digits
    rows += [f"order #{n}55-123-4567x" for n in range(2, 9)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found, model = pii.find_spans(docs, ["doc_id", "text"])
    by = {r.text: [(pii.KINDS[x.k], r.text[x.s : x.e], x.base) for x in r.spans] for r in found.collect()}
    assert all(v for t, v in by.items() if t.startswith("call"))
    assert by["und +1 (555) 123-0007 190.137.223.7 der"] == [("ip", "190.137.223.7", True), ("phone", "+1 (555) 123-0007", False)]
    assert by["contact jane.doe (at) site (dot) org please"] == [("email", "jane.doe (at) site (dot) org", False)]
    assert not any(v for t, v in by.items() if t.startswith("order"))
    yes, no = model.reliability["phone", "before"][1]
    assert yes > no


def test_redaction(spark):
    rows = [(1, "é a@b.co, then +1 555 123 4567!", "s", 9), (2, None, "s", None), (3, "plain", None, 5), (4, "4111 1111 1111 1111", "t", 1), (4, "4111 1111 1111 1111", "t", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    got = pii.redact(docs)
    assert got.schema == docs.schema or got.columns == docs.columns
    assert sorted((r.doc_id, r.text or "", r.n_chars) for r in got.collect()) == sorted(
        [(1, "é [EMAIL], then [PHONE]!", 24), (2, "", None), (3, "plain", 5), (4, "[CARD]", 6), (4, "[CARD]", 6)], key=lambda x: x[:2]
    )


def test_code_points(spark):
    found, _ = pii.find_spans(spark.createDataFrame([(1, "👍🏽é x@y.zz")], "doc_id long, text string"), ["doc_id"])
    assert [(x.s, x.e) for x in found.first().spans] == [(4, 10)]
