import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from editloom.llm import fingerprint, near_dedup, packing, records, token_output
from editloom.llm.graph import components as graph_components
from tests.llm.helpers import components, corpus, empty_documents, frame, odd_documents, shingles

BYTE, WORDS = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))


@pytest.fixture(scope="module")
def texts():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, texts):
    return frame(spark, texts.items()).repartition(5).cache()


@pytest.mark.parametrize("percent", [80, 85])
def test_near_components_equal_brute_force(docs, texts, percent):
    got = {r.doc_id: r for r in near_dedup.near_components(docs, percent).collect()}
    want = components(texts, percent)
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(shingles(t)) for i, t in texts.items()}
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


def test_large_groups_are_compared_in_blocks(docs, texts, monkeypatch):
    monkeypatch.setattr(near_dedup.verified, "__defaults__", (5, 8))  # nearly all groups have a leader, and texts that it doesn't link
    got = {r.doc_id: r.component_id for r in near_dedup.near_components(docs, 85).collect()}
    assert got == components(texts, 85)


def test_band_groups_find_the_same_groups(docs, texts):
    got = {r.doc_id: r.component_id for r in fingerprint.near_groups(docs, 85).collect()}
    assert got == components(texts, 85)


def test_deduplicate_keeps_one_of_each_group(docs, texts):
    want = components(texts, 80)
    kept = near_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(100, 140)] + [(1, 7), (3, 7), (9, 9), (None, 4)]
    got = {r.node: r.root for r in graph_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(101, 141)} | {3: 1, 7: 1}


def test_fingerprints_against_a_plain_version(docs, texts):
    got = {r.doc_id: r for r in fingerprint.fingerprints(docs).collect()}
    order = sorted(texts, reverse=True)
    for i, then in zip(order, order[1:] + order[:1]):
        text, other = texts[i] or "", texts[then] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        for near, t in ((got[i].near_edited, edited), (got[i].near_next, other)):
            a, b = shingles(text), shingles(t)
            assert abs(near - (len(a & b) / len(a | b) if a | b else 1.0)) < 0.2
    by_text = {}
    for i, t in texts.items():
        assert by_text.setdefault(t or "", got[i].fingerprint) == got[i].fingerprint


def test_token_files_hold_every_id_in_order(docs, texts):
    rows = sorted(token_output.read_back(token_output.write_ordered(docs, BYTE)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted(texts)
    at, encode = 0, Tokenizer.from_file(BYTE)
    for r in rows:
        ids = np.array([*encode.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_damaged_records_are_found(tmp_path):
    whole = records.frame(records.pack(7, np.array([1, 2, 3], "<u2")))
    doc_id, ids = records.unpack(whole[12:-4])
    assert (doc_id, ids.tolist()) == (7, [1, 2, 3])
    for place in (0, 9, 14, len(whole) - 1):
        path = tmp_path / f"r{place}"
        path.write_bytes(whole[:place] + bytes([whole[place] ^ 1]) + whole[place + 1 :])
        with pytest.raises(ValueError), path.open("rb") as f:
            records.read_record(f, "here")


def check_pieces(rows, texts, length):
    encode = Tokenizer.from_file(WORDS)
    ids = {i: np.array([*encode.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t in texts.items()}
    whole = sum(map(len, ids.values()))
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids[r.doc_id])
    for key, begin in (("doc_id", "start"), ("sequence_id", "offset")):
        ends = {}
        for r in sorted(rows, key=lambda r: (r[key], r[begin])):
            assert r[begin] == ends.get(r[key], 0)
            ends[r[key]] = r[begin] + r.length
        if key == "doc_id":
            assert ends == {i: len(x) for i, x in ids.items()}
        else:
            assert sorted(ends.values())[1:] == [length] * (len(ends) - 1) and len(ends) == -(-whole // length)


def test_packing_places_each_id_once_without_gaps(docs, texts):
    check_pieces(packing.packed(docs, WORDS, 256, 32).collect(), texts, 256)


def test_packing_follows_given_shares_while_all_sources_last(spark):
    texts = {i: " ".join(["word"] * 99) for i in range(300)}
    docs = frame(spark, texts.items())
    source = {i: i % 3 for i in texts}
    rows = packing.packed(docs, WORDS, 500, 50, {"0s0": 0.6, "0s1": 0.3, "0s2": 0.1}).collect()
    check_pieces(rows, texts, 500)
    for window in range(3, 15):
        share = [sum(r.length for r in rows if r.sequence_id == window and source[r.doc_id] == s) / 500 for s in range(3)]
        assert abs(share[0] - 0.6) <= 0.2 and abs(share[1] - 0.3) <= 0.2 and abs(share[2] - 0.1) <= 0.2


def test_odd_rows(spark):
    docs = odd_documents(spark)
    near = {(r.doc_id, r.n_shingles): r for r in near_dedup.near_components(docs, 85).collect()}
    assert near[(1, 2)].kept and near[(5, 2)].component_id == 1 and not near[(5, 2)].kept
    assert near[(2, 0)].component_id == 2 and near[(3, 0)].kept and near[(4, 0)].kept and near[(6, 1)].kept
    assert near[(None, 4)].component_id is None and near[(None, 4)].kept
    assert near_dedup.near_components(docs, 85).count() == 9
    kept = near_dedup.deduplicate(docs)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "6", "7", "None"] and kept.columns == docs.columns
    prints = fingerprint.fingerprints(docs).collect()
    assert len(prints) == 9 and {r.n_chars for r in prints if r.doc_id in (2, 3)} == {0}
    same = [r.fingerprint for r in prints if r.doc_id in (1, 5)]
    assert len(set(same)) == 1 and len(same) == 3
    rows = token_output.read_back(token_output.write_ordered(docs, BYTE)).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 1, 2, 3, 4, 5, 6, 7] and [r.n_tokens for r in rows if r.doc_id in (2, 3)] == [1, 1]
    assert fingerprint.near_groups(docs, 85).count() == 9
    pieces = packing.packed(docs, WORDS, 128).collect()
    assert sum(r.length for r in pieces) == sum(r.doc_tokens for r in pieces if r.start == 0)


def thue_morse(letters, n):
    """Two words whose polynomial hashes modulo 2**64 agree, whatever the base and the letters' codes."""
    word, other = letters
    while len(word) < n:
        word, other = word + other, other + word
    return word, other


@pytest.mark.parametrize("n", [1024, 65536])
def test_words_that_collide_under_polynomial_hashes_stay_apart(spark, n):
    a, b = thue_morse("ab", n)
    texts = {1: a, 2: b, 3: f"{a} x y z w", 4: f"{b} x y z w", 5: f"x {a}", 6: f"x {a}"}
    docs = frame(spark, texts.items())
    got = {r.doc_id: r.component_id for r in near_dedup.near_components(docs, 85).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 5}
    assert {r.doc_id: r.component_id for r in fingerprint.near_groups(docs, 85).collect()} == got
    encode = Tokenizer.from_file(BYTE)
    for r in token_output.read_back(token_output.write_ordered(docs, BYTE)).collect():
        assert r.ids_crc32 == zlib.crc32(np.array([*encode.encode(texts[r.doc_id], add_special_tokens=False).ids, 2], "<u4").tobytes())
    check_pieces(packing.packed(docs, WORDS, 4096).collect(), texts, 4096)


def test_rows_that_repeat_an_id_with_different_texts_are_compared_each(spark):
    one, two = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(5, one), (5, two), (7, two + " end"), (9, one + " end"), (9, one + " end"), (11, "alone here with five words")]
    docs = frame(spark, rows).withColumn("text", F.col("text"))
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_components(docs, 85).collect())
    assert got == [(5, 5, True), (5, 5, True), (7, 5, False), (9, 5, False), (9, 5, False), (11, 11, True)]
    assert sorted((r.doc_id, r.text) for r in near_dedup.deduplicate(docs, 85).collect()) == sorted([(5, one), (5, two), (11, "alone here with five words")])
    again = docs.unionByName(docs.withColumn("lang", F.lit("zz")))
    kept = {(r.doc_id, r.text): r.lang for r in near_dedup.deduplicate(again, 85).collect()}
    assert kept == {(r.doc_id, r.text): r.lang for r in near_dedup.deduplicate(again.repartition(3), 85).collect()} and len(kept) == 3


def test_empty_tables(spark):
    docs = empty_documents(spark)
    assert near_dedup.near_components(docs).count() == 0 and near_dedup.deduplicate(docs).count() == 0
    assert fingerprint.fingerprints(docs).count() == 0 and fingerprint.near_groups(docs).count() == 0
    assert token_output.read_back(token_output.write_ordered(docs, BYTE)).count() == 0
    assert packing.packed(docs, WORDS).count() == 0
    one = frame(spark, [(5, "a b c d e f")])
    assert fingerprint.fingerprints(one).collect()[0].near_next == 1.0


def test_ranges_of_ids(spark):
    bounds = list(range(0, 1000, 7))
    got = spark.range(-5, 1010).select("id", fingerprint.range_bucket(F.col("id"), bounds).alias("b")).collect()
    assert all(r.b == sum(x < r.id for x in bounds) for r in got)
