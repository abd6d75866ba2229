"""Ranked lexical search: the ``k`` best documents for each item of a query set, by integer BM25 scores.

Documents are scanned once: each becomes its length and the counts of the query set's terms, written as
postings in the shared folder. Collection size, total length and document frequencies are aggregated over
all of them. Then every task ranks its own documents, chunk by chunk, term at a time. An item's terms are
taken rarest first; a document gets an accumulator when one of them finds it, as long as the bounds of the
terms still to come could lift a new document to the k-th best score known (the partial scores of the chunk,
or the final ones of the chunks before it). Once they cannot, no accumulator is created any more, and those
there are go on to be updated by every remaining term, so that all scores given out are exact. A bound is
the term's largest contribution in the chunk. A task gives out at most k rows an item, and the best of all
tasks are taken by item.

Items are worked on in blocks of ``ITEMS``, each with postings of its own terms, so that what the tasks and
the driver hold follows the block and not the number of items or documents.

Defined cases: a null or empty text has no terms, and an item or document without terms has no rows; rows
that repeat a doc_id are documents of their own; a null doc_id comes last among equal scores; rows of items
are ranked each, also where they repeat an item_id; empty tables give no rows. Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import floor, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from editloom.llm.base import drop, save, ship
from editloom.llm.text import FOLD, buffers, gathered, segments, slices, spans

K, ITEMS, CHUNK = 20, 10_000, 8192
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWER = str.maketrans(UPPER, LOWER)
#: ASCII bytes that are neither letters nor digits: in no term.
GAP = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
_POSTINGS = "doc_id long, n long, terms array<int>, counts array<int>"
_FOUND = "item int, doc_id long, score long"
_PAD = np.iinfo(np.int64).max


def terms_of(text: str | None) -> list[str]:
    return re.findall(TERM, (text or "").translate(_LOWER))


def _numbered(raw: np.ndarray, off: np.ndarray, known: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The number of terms of each text; for each term of ``known`` found, its text and number."""
    if len(off) == 2:  # a text by itself may be long
        cuts = [(a, b, np.array([0, b - a])) for a, b in segments(raw, gap=GAP)]
    else:
        cuts = [(0, len(raw), off)]
    n, owners, numbers = np.zeros(len(off) - 1, np.int64), [], []
    for a, b, rel in cuts:
        part = raw[a:b]
        starts, ends, bounds = spans(part, rel, GAP)
        sizes = np.diff(bounds)
        n += sizes
        told = pc.index_in(gathered(FOLD[part], starts, ends), value_set=known).to_numpy(zero_copy_only=False)
        hit = ~np.isnan(told) if told.dtype.kind == "f" else np.ones(len(told), bool)
        owners.append(np.repeat(np.arange(len(sizes)), sizes)[hit])
        numbers.append(told[hit].astype(np.int64))
    return n, np.concatenate([*owners, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([*numbers, np.zeros(0, np.int64)])


def postings(docs: DataFrame, terms: list[str]) -> DataFrame:
    """doc_id, n (all terms of the text), and of the numbered ``terms`` those in the text with their counts; saved."""
    ship(docs.sparkSession)
    words, width = [t.encode() for t in terms], max(len(terms), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(words, pa.large_binary())
        for batch in batches:
            raw, off = buffers(batch.column(1))
            for a, b in slices(off):
                n, owner, number = _numbered(raw[off[a] : off[b]], off[a : b + 1] - off[a], known)
                pairs, counts = np.unique(owner * width + number, return_counts=True)
                bounds = pa.array(np.searchsorted(pairs, np.arange(b - a + 1) * width), pa.int32())
                lists = [pa.ListArray.from_arrays(bounds, pa.array(v, pa.int32())) for v in (pairs % width, counts)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n), *lists], names=["doc_id", "n", "terms", "counts"])

    return save(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _POSTINGS), "search-postings")


def weight(documents: int, frequency: int) -> int:
    return floor(1000 * log((2 * documents + 2) / (2 * frequency + 1)))


class Chunk:
    """Postings of some documents, by term, with what each adds for a unit of weight."""

    def __init__(self, batch: pa.RecordBatch, documents: int, length: int, terms: int) -> None:
        n = batch.column("n").to_numpy()
        lists, counts = batch.column("terms"), batch.column("counts").flatten().to_numpy().astype(np.int64)
        owner = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
        number = lists.flatten().to_numpy()
        order = np.argsort(number, kind="stable")
        size = 75 + (25 * n * documents) // length
        self.rows = owner[order]
        counts = counts[order]
        self.worth = (1_000_000_000 * counts) // (1000 * counts + 12 * size[self.rows])
        self.bounds = np.searchsorted(number[order], np.arange(terms + 1))
        held = np.flatnonzero(np.diff(self.bounds))
        self.most = np.zeros(terms, np.int64)
        if len(held):
            self.most[held] = np.maximum.reduceat(self.worth, self.bounds[held])
        ids = batch.column("doc_id")
        self.null = ids.is_null().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(_PAD).to_numpy(zero_copy_only=False)

    def best(self, item: np.ndarray, weights: np.ndarray, level: int, k: int) -> np.ndarray:
        """Rows of the chunk that may be among the k best, with exact scores in ``self.scores``. ``item``: its terms'
        numbers, rarest first; ``level``: a score that k documents before reach, or 0."""
        scores = np.zeros(len(self.ids), np.int64)
        ahead = np.cumsum((weights * self.most[item])[::-1])[::-1]  # bounds of a term and all after it
        creating = True
        for i, (term, w) in enumerate(zip(item.tolist(), weights.tolist())):
            if creating and ahead[i] <= scores.max(initial=0):
                found = scores[scores > 0]
                if len(found) >= k:
                    level = max(level, int(np.partition(found, len(found) - k)[len(found) - k]))
            creating = creating and ahead[i] >= level
            a, b = self.bounds[term], self.bounds[term + 1]
            rows, add = self.rows[a:b], w * self.worth[a:b]
            if not creating:
                there = scores[rows] > 0
                rows, add = rows[there], add[there]
            scores[rows] += add
        found = np.flatnonzero(scores > 0)
        if len(found) > k:
            least = np.partition(scores[found], len(found) - k)[len(found) - k]
            found = found[scores[found] >= max(least, level)]
        self.scores = scores
        return found


def ranked(table: DataFrame, queries: list[tuple[int, dict[int, int]]], documents: int, length: int, frequency: dict[int, int], k: int) -> DataFrame:
    """item, doc_id, score: of each task's documents the k best for each item (number, counts of its terms)."""
    terms = max(frequency, default=-1) + 1
    plan = []
    for number, counts in queries:
        held = sorted((t for t in counts if frequency.get(t) and weight(documents, frequency[t])), key=lambda t: (frequency[t], t))
        if held:
            plan.append((number, np.array(held), np.array([counts[t] * weight(documents, frequency[t]) for t in held], np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros((3, 0), np.int64) for _ in plan]
        for batch in (b.slice(i, CHUNK) for b in batches for i in range(0, b.num_rows, CHUNK)):
            chunk = Chunk(batch, documents, length, terms)
            for at, (_, item, weights) in enumerate(plan):
                level = int(kept[at][0, -1]) if kept[at].shape[1] == k else 0
                rows = chunk.best(item, weights, level, k)
                if len(rows):
                    both = np.concatenate([kept[at], [chunk.scores[rows], chunk.null[rows], chunk.ids[rows]]], axis=1)
                    kept[at] = both[:, np.lexsort((both[2], both[1], -both[0]))[:k]]
        for (number, *_), best in zip(plan, kept):
            if best.shape[1]:
                ids = pa.array(best[2], pa.int64(), mask=best[1].astype(bool))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(best.shape[1], number), pa.int32()), ids, pa.array(best[0])], names=["item", "doc_id", "score"])

    return table.mapInArrow(run, _FOUND)


def search(docs: DataFrame, items: DataFrame, k: int = K, block: int = ITEMS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best of ``docs`` (doc_id, text) for each row of ``items`` (item_id, text)."""
    ship(docs.sparkSession)
    wanted = save(items.select("item_id", F.col("text").cast("string").alias("text")).withColumn("row", F.monotonically_increasing_id()), "search-items")
    blocks = -(-wanted.count() // block)
    out = []
    for b in range(blocks):
        held = wanted.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).orderBy("row").collect()  # about ``block`` rows
        texts = [Counter(terms_of(r.text)) for r in held]
        terms = sorted(set().union(*texts))
        number = {t: i for i, t in enumerate(terms)}
        table = postings(docs, terms)
        documents, length = table.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not documents or not terms:
            continue
        frequency = {r.term: r.n for r in table.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()}  # at most the block's terms
        found = ranked(table, [(i, {number[t]: c for t, c in x.items()}) for i, x in enumerate(texts)], documents, length, frequency, k)
        place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        best = save(found.withColumn("rank", place).where(F.col("rank") <= k), "search-best")
        drop(table)
        names = docs.sparkSession.createDataFrame([(i, r.item_id) for i, r in enumerate(held)], f"item int, item_id {dict(wanted.dtypes)['item_id']}")
        out.append(best.join(names, "item").select("item_id", "rank", "doc_id", "score"))
    if not out:
        return wanted.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole


OP13_SQL = rf"""
WITH doc AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}') AS terms FROM documents),
sized AS (SELECT doc_id, r, terms, len(terms) AS n FROM doc WHERE len(terms) > 0),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM sized),
item AS (SELECT item_id, row_number() OVER () AS q, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}') AS terms FROM benchmark),
wanted AS (SELECT q, item_id, term, count(*) AS times FROM (SELECT q, item_id, unnest(terms) AS term FROM item) x GROUP BY ALL),
held AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(terms) AS term FROM sized) x WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
weighed AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM held, total GROUP BY term),
scored AS (SELECT q, item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // length)))) AS BIGINT) AS score
  FROM wanted JOIN held USING (term) JOIN weighed USING (term), total GROUP BY q, item_id, r, doc_id),
placed AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id, r) AS INT) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= {K}"""


def op13_lexical_search(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
