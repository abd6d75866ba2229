import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from editloom.llm.text import Permutations, buffers, exact_sets, sets, slices, spans
from editloom.llm.tokens import PieceEncoder
from tests.llm.helpers import WORD, shingles

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbB .,'\n\t é日1😀", max_size=40)), max_size=8)
ODD = [
    "", " ", "a  b", "  x ", "don't stop, it's 's 're", "x\t\n y  ", "é, è. ÷.× .", "naïve—word… ok", "  a   b", "A≮b", "İI ſ ß Σας ΣΑΣ", "12,345.67 1a2",
    "<|endoftext|> hi<|startoftext|>", "é, é", "\x1c a\x1db", "日本 語。 x", "😀 ok😀!", "a'b 'c d' ''s", None, "tab\tword\r\nnext\x0b\x0cq", "it'S DON'T", "hello!!! (yes) [no]",
]


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_words_and_shingle_sets_are_those_of_a_plain_parse(texts):
    raw, off = buffers(pa.array(texts, pa.string()))
    starts, ends, bounds = spans(raw, off)
    found = [bytes(raw[s:e]).decode() for s, e in zip(starts, ends)]
    assert found == [w for t in texts for w in WORD.findall(t or "")]
    assert np.diff(bounds).tolist() == [len(WORD.findall(t or "")) for t in texts]
    hashed, plain = sets(pa.array(texts, pa.string())), [shingles(t) for t in texts]
    assert [len(h) for h in hashed] == [len(p) for p in plain]
    for i in range(len(texts)):
        for j in range(i):
            assert len(np.intersect1d(hashed[i], hashed[j])) == len(plain[i] & plain[j])


def test_slices_cover_all_texts_and_a_long_one_stands_alone():
    off = np.array([0, 5, 5, 50, 52, 53])
    assert list(slices(off, 10)) == [(0, 2), (2, 3), (3, 5)]


def test_signature_shares_estimate_jaccard():
    draw = np.random.default_rng(0)
    a = draw.integers(0, 1 << 62, 1000, dtype=np.uint64)
    b = np.concatenate([a[:700], draw.integers(0, 1 << 62, 300, dtype=np.uint64)])
    sig = Permutations(512).signatures(np.concatenate([a, b]), np.array([0, 1000, 1000, 2000]))
    assert abs((sig[0] == sig[2]).mean() - 700 / 1300) < 0.08
    assert (sig[1] == 0xFFFFFFFF).all()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_encode_like_whole_texts(name):
    encoder, library = PieceEncoder(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name))
    whole = lambda texts: [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [x.tolist() for x in encoder.encode(pa.array(ODD))] == whole(ODD)

    @settings(max_examples=80, deadline=None)
    @given(TEXTS)
    def check(texts):
        assert [x.tolist() for x in encoder.encode(pa.array(texts, pa.string()))] == whole(texts)

    check()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_marks_that_compose_with_capitals_alone(name):
    """Capitals whose composition with a mark differs from the small letter's, and 100,000 random texts of letters and marks."""
    encoder, library = PieceEncoder(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name))
    pairs = [f"{a}{b}{m}" for m in "\u0331\u0308\u030c\u030a\u0307\u0327\u0323\u0338" for a in ("", "the ", "x-") for b in "HTJWYhtjwyABEae<=>"]
    draw = random.Random(5)
    texts = pairs + ["".join(draw.choice("HTJWYhtjwy aE.,'-\u0331\u0308\u030c\u030aé\u212aß<>") for _ in range(draw.randrange(1, 12))) for _ in range(100_000)]
    want = [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    for at in range(0, len(texts), 10_000):
        assert [x.tolist() for x in encoder.encode(pa.array(texts[at : at + 10_000]))] == want[at : at + 10_000]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_strings_of_added_tokens(name):
    """Each one id, as the library has it, unless they are to be ordinary text."""
    path = public_tokenizers.path(name)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|startoftext|><|endoftext|>x", "<|EndOfText|>", "no |endoftext| here", None, "x" * 5000 + "<|endoftext|>" * 3, "é <|startoftext|>", "<|endoftext"]
    library = Tokenizer.from_file(path)
    assert [x.tolist() for x in PieceEncoder(path).encode(pa.array(texts))] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    library.encode_special_tokens = True
    assert [x.tolist() for x in PieceEncoder(path, ordinary=True).encode(pa.array(texts))] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_pieces_of_one_hash_are_told_apart_by_their_bytes(monkeypatch):
    from editloom.llm import tokens

    monkeypatch.setattr(tokens, "span_hashes", lambda raw, starts, ends: np.full(len(starts), 7, np.uint64))
    encoder = PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["one two three two", "two words", "x" * 9000 + " one", "x" * 8999 + "y one"]
    for _ in range(2):
        assert [x.tolist() for x in encoder.encode(pa.array(texts))] == [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("n", [1024, 4096, 65536])
def test_hashes_of_words_made_to_collide_differ(n):
    word, other = "ab"
    while len(word) < n:
        word, other = word + other, other + word
    found = sets(pa.array([word, other, word + " x", other + " x"]))
    assert len({int(f[0]) for f in found}) == 4
    assert [len(x) for x in exact_sets(pa.array([word, other, word]))] == [1, 1, 1]


def test_long_texts_are_worked_on_in_parts(monkeypatch):
    from editloom.llm import text

    words = " ".join(f"w{i % 97}" for i in range(3000))
    texts = pa.array(["a b", words, words + " end", None, "x" * 700])
    whole, exact = sets(texts), [len(x) for x in exact_sets(texts)]
    monkeypatch.setattr(text, "SLICE_BYTES", 300)
    monkeypatch.setattr(text.slices, "__defaults__", (300,))
    monkeypatch.setattr(text.segments, "__defaults__", (300,))
    assert all(np.array_equal(a, b) for a, b in zip(whole, sets(texts))) and exact == [len(x) for x in exact_sets(texts)]
