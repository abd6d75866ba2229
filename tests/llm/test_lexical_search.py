import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from editloom.llm import lexical_search
from editloom.llm.text import FOLD, segments
from tests.llm.helpers import LOWER, empty_documents, frame, odd_documents

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain_search(docs, items, k=20):
    """(item_id, rank, doc_id, score) by scoring every document for every item."""
    bags = [(i, Counter(plain_terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for i, bag in bags:
            m = 75 + (25 * sum(bag.values()) * n) // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * bag[t]) // (1000 * bag[t] + 12 * m)) for t in plain_terms(text) if t in bag)
            if score:
                scores.append((-score, i is None, i or 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def rows(table):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in table.collect()), key=str)


@pytest.fixture(scope="module")
def tables():
    draw = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    prose = lambda n: " ".join(draw.choices(words, [1 / (i + 1) for i in range(300)], k=n))
    docs = [(i, prose(draw.randrange(1, 80))) for i in range(900)]
    docs += [(900 + i, docs[5][1]) for i in range(30)]  # ties beyond k
    docs += [(-1, "W1, w2;w3! É日本 İx 7up"), (2000, prose(40_000)), (2001, None), (2002, " .,"), (2003, ""), (7, "w9 w9 w9 again")]
    items = [(i, prose(draw.randrange(1, 40))) for i in range(25)] + [(25, docs[5][1]), (26, None), (27, "zzz unknown"), (28, "w7 w7 w7 É日本 W1"), (29, "w299"), (29, "w0")]
    return docs, items


@pytest.mark.parametrize("chunk,k,block", [(8192, 20, 10_000), (64, 5, 7), (1, 1, 1000)])
def test_ranks_equal_scoring_everything(spark, tables, monkeypatch, chunk, k, block):
    monkeypatch.setattr(lexical_search, "CHUNK", chunk)
    docs, items = tables
    found = lexical_search.search(frame(spark, docs).repartition(3), spark.createDataFrame(items, "item_id long, text string"), k, block)
    assert rows(found) == plain_search(docs, items, k)


def test_accumulators_stop_and_scores_stay_exact(tables):
    """With few wanted and rare terms first, frequent terms create no accumulators, and results are the same."""
    docs, items = tables
    bags = [Counter(plain_terms(t)) for _, t in docs]
    terms = sorted(set().union(*bags))
    number = {t: i for i, t in enumerate(terms)}
    lists = [sorted((number[t], c) for t, c in b.items()) for b in bags]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([i for i, _ in docs], pa.int64()), pa.array([sum(b.values()) for b in bags], pa.int64()), pa.array([[t for t, _ in x] for x in lists], pa.list_(pa.int32())), pa.array([[c for _, c in x] for x in lists], pa.list_(pa.int32()))],
        names=["doc_id", "n", "terms", "counts"],
    )
    n, length, df = sum(bool(b) for b in bags), sum(sum(b.values()) for b in bags), Counter(t for b in bags for t in b)
    chunk, stopped = lexical_search.Chunk(batch, n, length, len(terms)), 0
    for _, text in items:
        wanted = Counter(t for t in plain_terms(text) if t in number)
        held = sorted(wanted, key=lambda t: (df[t], number[t]))
        import numpy as np

        item, weights = np.array([number[t] for t in held], int), np.array([wanted[t] * lexical_search.weight(n, df[t]) for t in held], np.int64)
        chunk.best(item, weights, 0, 10**9)
        every = chunk.scores
        found = chunk.best(item, weights, 0, 3)
        stopped += int((chunk.scores > 0).sum() < (every > 0).sum())
        top = np.sort(every)[::-1][:3]
        assert set(np.flatnonzero(every >= max(top[-1], 1))) <= set(found.tolist()) and (chunk.scores[found] == every[found]).all()
    assert stopped > 5


def test_long_texts_are_cut_between_terms():
    raw = b"".join(b"ab%d." % i for i in range(2000))
    import numpy as np

    parts = list(segments(np.frombuffer(raw, np.uint8), 100, gap=lexical_search.GAP))
    assert len(parts) > 50 and all(raw[b - 1 : b + 1].count(b".") or b == len(raw) for _, b in parts)
    known = pa.array([b"ab5", b"ab1999"], pa.large_binary())
    n, owner, number = lexical_search._numbered(FOLD[np.frombuffer(raw, np.uint8)], np.array([0, len(raw)]), known)
    assert n.tolist() == [2000] and owner.tolist() == [0, 0] and number.tolist() == [0, 1]


def test_odd_rows_and_empty_tables(spark):
    docs = odd_documents(spark)
    items = spark.createDataFrame([(1, "ONE two x é", 3), (None, "row", 4), (3, None, 5)], "item_id long, text string, score int")
    want = plain_search([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert rows(lexical_search.search(docs, items)) == want
    for d, i in ((empty_documents(spark), items), (docs, items.limit(0)), (docs, items.where("item_id = 3"))):
        found = lexical_search.search(d, i)
        assert found.columns == ["item_id", "rank", "doc_id", "score"] and found.count() == 0
