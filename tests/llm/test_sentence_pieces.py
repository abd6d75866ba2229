import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from editloom.llm import sentence_pieces
from editloom.llm.sentence_pieces import Merger, SentenceModel
from tests.llm.helpers import corpus, empty_documents, frame, odd_documents

FILE = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbehtinrs .,'\n\t é日1▁😀\x00<0x>", max_size=60), st.text(max_size=20)), max_size=8)
ODD = ["", " ", "  ", "▁", "▁ ▁a", " a  b ", "<s></s><unk>", "<0x0A>", "the the  the", "naïve—word… ok", "日本語。x 日本", "😀 ok😀!", "é ́", "x\x00y", "\n\n\t\r\n", None, "123456 1.5e7", "ߪ ֲ"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=FILE)


@pytest.fixture(scope="module")
def held():
    return SentenceModel(FILE)


def test_texts_encode_and_decode_like_the_library(held, library):
    @settings(max_examples=150, deadline=None)
    @given(TEXTS)
    def check(texts):
        for text, ids in zip(texts, held.encode(pa.array(texts, pa.string()))):
            assert ids.tolist() == library.encode(text or "") and held.decode(ids) == library.decode(ids.tolist())

    for text, ids in zip(ODD, held.encode(pa.array(ODD))):
        assert ids.tolist() == library.encode(text or ""), text
    check()


@pytest.mark.parametrize("text", ["a" * 40_000, " " * 40_000 + "x", "ab" * 20_000, "the" * 13_000, "日本語" * 9_000, "\n" * 500 + "é" * 33_000, "straße" * 7_000], ids=lambda t: f"{t[:4]!r}{len(t)}")
def test_long_runs_without_a_cut(held, library, text):
    assert held.encode(pa.array([text]))[0].tolist() == library.encode(text)


def test_windows_and_small_stores_change_nothing(library, monkeypatch):
    monkeypatch.setattr(sentence_pieces, "WINDOW", 3)
    monkeypatch.setattr(sentence_pieces, "PAIRS", 5)
    small, draw = SentenceModel(FILE), random.Random(2)
    texts = ["".join(draw.choice("hetinsraolä") for _ in range(draw.randrange(40))) for _ in range(300)]
    assert [x.tolist() for x in small.encode(pa.array(texts))] == library.encode(texts)


def test_any_ids_decode_like_the_library(held, library):
    draw = random.Random(1)
    for _ in range(5000):
        ids = [draw.choice([draw.randrange(32000), draw.randrange(3, 259), draw.randrange(4), 259]) for _ in range(draw.randrange(12))]
        assert held.decode(np.array(ids, np.int64)) == library.decode(ids), ids


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.text(alphabet="abc", min_size=2, max_size=5), st.integers(-6, 0), max_size=14), st.text(alphabet="abcd", max_size=24))
def test_backtracking_equals_merging_for_any_pieces(scores, text):
    """Also where scores tie, pieces cannot come out, and a piece's letters are no pieces themselves."""
    merger = Merger({k: float(v) for k, v in scores.items()} | {"a": -9.0, "b": -9.0})
    assert merger.encode(text) == merger.merged(text)


def test_another_kind_of_model_is_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    told = sentencepiece_model_pb2.ModelProto()
    with open(FILE, "rb") as f:
        told.ParseFromString(f.read())
    told.normalizer_spec.remove_extra_whitespaces = True
    path = tmp_path / "other.model"
    path.write_bytes(told.SerializeToString())
    with pytest.raises(ValueError, match="normalizes"):
        SentenceModel(str(path))


def test_rows_against_the_library(spark, library):
    texts = corpus()
    got = {r.doc_id: r for r in sentence_pieces.round_trip(frame(spark, texts.items()).repartition(3), FILE).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        ids = library.encode(text or "", add_eos=True)
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_tables_of_ids_and_odd_rows(spark, library):
    docs = odd_documents(spark)
    rows = sentence_pieces.encoded(docs, FILE)
    want = sorted(((r.doc_id, library.encode(r.text or "", add_eos=True)) for r in docs.collect()), key=str)
    assert sorted(((r.doc_id, r.ids) for r in rows.collect()), key=str) == want
    back = sentence_pieces.decoded(rows, FILE).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(r.doc_id), r.text or "") for r in docs.collect())
    assert sentence_pieces.decoded(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), FILE).first().text is None
    for make in (sentence_pieces.encoded, sentence_pieces.round_trip):
        assert make(empty_documents(spark), FILE).count() == 0
