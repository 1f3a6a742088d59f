import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from wedgeworks.llm.token_counts import count_tokens, dictionary, drops_white_space, frequent, lengths

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def library(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


def by_runs(text):
    return sum(lengths(PATH, text.encode().split()))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["the", "É", "é", "ΑΣ", "İ", " ", "\n", "\x85", "\xa0", "\x1c", "'re", "'S", "42", "<|endoftext|>", "<|startoftext", "##", "ß", "日本", "ǅ", "%%", "|", "K", "Å", "ﬁ", "👍🏽", "²", "Ⅷ"]), max_size=12).map("".join))
def test_runs_add_up(text):
    assert by_runs(text) == library(text)


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=30))
def test_any_text(text):
    assert by_runs(text) == library(text)


def test_all_of_unicode_after_dotted_capital_and_marks():
    rng = random.Random(4)
    for _ in range(6000):
        marks = "".join(chr(rng.choice([rng.randrange(0x300, 0x600), rng.randrange(0x20, 0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(rng.randint(1, 5)))
        text = rng.choice(["İ", "i", " ", "=", "é", "\t"]) + marks
        assert by_runs(text) == library(text), ascii(text)


def table(spark):
    rng = random.Random(2)
    words = ["the", "of", "Straße", "naïve", "don't", "x" * 200, "42", "%%%", "İ̶", "日本語", "<|endoftext|>", *(f"w{i}" for i in range(300))]
    rows = [(1, None), (2, ""), (3, "Plain words, here."), (3, "Plain words, here."), (3, "other text, same id"), (4, "<|endoftext|> x"), (5, "wort " * 60_000), (None, "no id"), (None, "none either")]
    rows += [(10 + i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 80)))) for i in range(300)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_tokens", "2 as row", "'w' as word")


@pytest.mark.parametrize("known,held", [(1 << 18, 200_000), (20, 50), (0, 1)])
def test_rows(spark, known, held):
    rows, df = table(spark)
    got = sorted(map(str, map(tuple, count_tokens(df, PATH, known=known, held=held).collect())))
    assert got == sorted(map(str, ((i, len((t or "").encode()), library(t or ""), library(t or "") > 2048) for i, t in rows)))
    assert count_tokens(df.limit(0), PATH, known=known).count() == 0


def test_dictionary_counts_each_distinct_run_once(spark):
    rows, df = table(spark)
    words = dictionary(df.selectExpr("cast(text as binary) body"), PATH, held=30)
    want = {}
    for _, t in rows:
        for w in (t or "").encode().split():
            want[w] = want.get(w, 0) + 1
    assert {bytes(r.word): r.n for r in words.collect()} == want
    near = frequent(words, known=10)
    assert 0 < len(near) <= 10 and b"wort" in near and frequent(words, known=0) == {}


def test_other_tokenizers_count_whole_texts(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert drops_white_space(PATH) and not drops_white_space(path)
    other = Tokenizer.from_file(path)
    rows = [(1, " two  words\n"), (2, None), (3, "")]
    got = {r.doc_id: r.n_tokens for r in count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()}
    assert got == {i: len(other.encode(t or "", add_special_tokens=False).ids) for i, t in rows}
