import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from clusterloom.llm import token_counts as tc

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def lib():
    return Tokenizer.from_file(PATH)


def wild(rng, n):
    pieces = ["the ", "don't", "Été ", "é", " ́x", "\n\n", "12345", "<|endoftext|>", "<|startoftext|> ", "日本語", "\x1c", " ", "---", "  ", "ẞ", "Σίσυφος", "\r\n", "🙂", "I'LL "]
    return "".join(rng.choice(pieces) for _ in range(n))


def test_counts_are_the_librarys(lib):
    rng = random.Random(1)
    texts = [wild(rng, n) for n in (0, 1, 5, 50, 400) for _ in range(30)]
    c = tc.Counter(PATH)
    assert c.apart
    got = [n for n, _ in c.count([t.encode() for t in texts])]
    assert got == [len(lib.encode(t, add_special_tokens=False).ids) for t in texts]


@pytest.mark.parametrize("chunk,overlap", [(40, 4), (64, 16), (300, 32)])
def test_chunks_splice_to_the_whole(lib, chunk, overlap):
    rng = random.Random(chunk)
    for _ in range(15):
        t = wild(rng, 300)
        got, chunks, _ = tc.encode_huge(lib, t, chunk, overlap)
        assert got == tc.spans(lib, t) and chunks > 1
    long_word = "ab" * 500
    got, _, widened = tc.encode_huge(lib, long_word, chunk, overlap)
    assert widened and got == tc.spans(lib, long_word)


def test_query_shape_nulls_and_clashes(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 6), (2, "", 6), (None, "a b", 7)], "doc_id long, text string, n_tokens int")
    rows = sorted(map(tuple, tc.count_tokens(df, PATH).collect()), key=str)
    assert rows == sorted([(1, 0, 0, False, 1), (2, 0, 0, False, 1), (2, 0, 0, False, 1), (None, 3, 2, False, 1)], key=str)
    assert tc.count_tokens(df.limit(0), PATH).count() == 0


def test_new_words_need_no_pattern(lib):
    """Words of letters go to the model alone, and marks behind them are known; a worker's next task in a run knows what was counted."""
    c = tc.Counter(PATH)
    list(c.count([b"a... b, !?"]))

    class Closed:
        def encode_batch_fast(self, texts, **how):
            assert not texts
            return []

    c.tokenizer, new = Closed(), "Alpha beta... GAMMA, zeta!? \u00c9t\u00e9, alpha"
    assert list(c.count([new.encode()])) == [(len(lib.encode(new, add_special_tokens=False).ids), 1)]
    known = tc.counter_of("run", PATH, 10, 5, 2)
    assert tc.counter_of("run", PATH, 10, 5, 2) is known and tc.counter_of("other run", PATH, 10, 5, 2) is not known


def test_words_and_marks_apart_are_the_librarys(lib):
    texts = ["Word. eh!! don't's a's B.'s <|endoftext|>. q<| ÉTÉ, ÀÖØÞ! ÿ. ß; é́. x_y 'll", "İ. ª ſ! a.<|startoftext|>b", "é. É! ́x"]
    got = [n for n, _ in tc.Counter(PATH).count([t.encode() for t in texts])]
    assert got == [len(lib.encode(t, add_special_tokens=False).ids) for t in texts]


def test_counting_huge_texts_makes_few_spans(lib, monkeypatch):
    made, span = [], tc._Part.span
    monkeypatch.setattr(tc._Part, "span", lambda self, i: made.append(i) or span(self, i))
    t = "some words, and more of them. " * 2000
    assert list(tc.Counter(PATH, 1000, 4000, 100).count([t.encode()]))[0][0] == len(lib.encode(t, add_special_tokens=False).ids)
    assert len(made) < 20_000 / 4  # of some 18,000 tokens
