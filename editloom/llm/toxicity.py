"""Toxicity scores by a logistic classifier with counterfactual regularisation.

Features are the presence of words and of their first bytes; those frequent among toxic and rare among
other labelled documents are kept, and so is every term that is swapped. Sentences of labelled documents
that hold a term are written again with the term swapped for the next of its kind, and the fit penalises
the squared change of score between the two, so that naming a group moves no score. Terms are those of
``IDENTITY``, which name groups in four languages, and up to ``NEUTRAL`` words that the labelled documents
use most and alike in both kinds (rates within a factor of ``ALIKE``), next to each other in use.
A fitted model tells how many pairs it was given (``pairs``) and their mean change of log odds (``change``).

The fit sees at most ``SAMPLE`` labelled ids, drawn by digests, one text a label of each, and at most
``PAIRS`` swapped sentences, drawn likewise, and keeps at most ``FEATURES`` features besides the terms'; features are
counted in tasks, and the driver holds the kept ones of those rows. Scoring covers every whole text.

Defined cases: null and empty texts score like a text without features; null labels and labels without a
document are ignored; rows that repeat a doc_id are scored each, and one of them is learned from; without
toxic labels all scores are 0; a null doc_id is scored and not held out. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from editloom.llm.base import save, ship
from editloom.llm.features import word_marks
from editloom.llm.quality import fold, labelled
from editloom.llm.text import steps

SAMPLE, FEATURES, LEAST, ODDS, CUT, FOLDS = 6_000, 4_096, 4, 3.0, 0.7, 3
PAIRS, NEUTRAL, ALIKE, COMMON = 20_000, 32, 1.25, 0.05
STEPS, RIDGE, FAIRNESS = 400, 1e-3, 10.0
STEP_ROWS = 128  # rows whose features are held at once
#: Terms that name groups, by kind; a swap takes the next of its kind.
IDENTITY = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"), ("gay", "straight"), ("lesbian", "heterosexual"), ("transgender", "cisgender"),
    ("muslim", "christian", "jewish", "hindu", "buddhist"), ("muslims", "christians", "jews", "hindus", "buddhists"),
    ("black", "white", "asian", "latino"), ("immigrants", "natives"), ("disabled", "abled"), ("old", "young"),
    ("frauen", "männer"), ("mädchen", "jungen"), ("muslime", "christen", "juden"), ("schwarze", "weiße"), ("ausländer", "einheimische"),
    ("femmes", "hommes"), ("filles", "garçons"), ("musulmans", "chrétiens", "juifs"), ("noirs", "blancs"), ("immigrés", "français"),
    ("mujeres", "hombres"), ("chicas", "chicos"), ("musulmanes", "cristianos", "judíos"), ("negros", "blancos"), ("inmigrantes", "nacionales"),
)
_SENTENCE = re.compile(r"[^.!?\n]+")


class Swaps:
    """The next term of each term's kind."""

    def __init__(self, kinds: tuple[tuple[str, ...], ...] = IDENTITY) -> None:
        self.then = {term: kind[(i + 1) % len(kind)] for kind in kinds for i, term in enumerate(kind)}
        self.terms = re.compile(r"\b(" + "|".join(sorted(map(re.escape, self.then), key=len, reverse=True)) + r")\b", re.IGNORECASE)

    def swapped(self, text: str) -> list[tuple[str, str]]:
        """The sentences that hold a term, each with its terms swapped."""
        out = []
        for sentence in _SENTENCE.findall(text):
            other = self.terms.sub(lambda m: self.then.get(m[0].lower(), m[0]), sentence)
            if other != sentence:
                out.append((sentence, other))
        return out


def neutral_terms(rows: DataFrame, toxic: int, n: int, most: int = NEUTRAL) -> list[tuple[str, str]]:
    """Pairs of words of four letters and more that most of ``rows`` (text, label) use, about as often in toxic ones as in others."""
    named = {term for kind in IDENTITY for term in kind}
    words = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}{4,})"), 1)))
    counts = rows.select("label", words.alias("word")).groupBy("word").agg(F.sum("label").alias("toxic"), F.count("*").alias("n"))
    ratio = (F.col("toxic") / max(toxic, 1)) / ((F.col("n") - F.col("toxic")) / max(n - toxic, 1))
    alike = counts.where((F.col("n") >= COMMON * n) & (F.col("n") > F.col("toxic")) & ratio.between(1 / ALIKE, ALIKE) & ~F.col("word").isin(*named))
    found = [r.word for r in alike.orderBy(F.desc("n"), "word").limit(most).collect()]
    return list(zip(found[::2], found[1::2]))


class Classifier:
    """Sorted feature marks, their weights, a bias, and the threshold's place."""

    def __init__(self, marks: np.ndarray, rows: list[np.ndarray], toxic: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], cut: float = CUT, fairness: float = FAIRNESS) -> None:
        """``rows``: positions in ``marks`` per document; ``pairs``: per swapped sentence, before and after."""
        self.marks = marks
        self.weights, self.bias = np.zeros(len(marks)), 0.0
        self.empty, self.pairs, self.change = not toxic.any(), len(pairs), 0.0
        if self.empty:
            return
        y = toxic.astype(float)
        owner, at = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
        gaps = [(i, p, s) for i, (before, after) in enumerate(pairs) for part, s in ((before, 1.0), (after, -1.0)) for p in part]
        who, where, sign = (np.array([g[k] for g in gaps], t) for k, t in ((0, np.int64), (1, np.int64), (2, float)))
        w, b = np.zeros(len(marks)), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
        for step in range(1, STEPS + 1):  # Adam on the logistic loss, ridge and fairness terms
            score = b + np.bincount(owner, weights=w[at], minlength=len(rows))
            error = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - y) / len(y)
            g = np.bincount(at, weights=error[owner], minlength=len(w)) + RIDGE * w / len(y)
            if len(gaps):
                change = np.bincount(who, weights=sign * w[where], minlength=len(pairs))
                g += 2 * fairness * np.bincount(where, weights=sign * change[who], minlength=len(w)) / len(pairs)
            gb = error.sum()
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
            fix = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            w, b = w - 0.05 * fix * m / (np.sqrt(v) + 1e-9), b - 0.05 * fix * mb / (np.sqrt(vb) + 1e-9)
        if len(gaps):
            self.change = float(np.abs(np.bincount(who, weights=sign * w[where], minlength=len(pairs))).mean())
        score = b + np.bincount(owner, weights=w[at], minlength=len(rows))
        # The threshold with fewest errors, in the middle of its gap, is put at the cut.
        order = np.argsort(score, kind="stable")
        errors = np.concatenate([[0], np.cumsum(y[order])]) + np.concatenate([[0], np.cumsum((1 - y)[order][::-1])])[::-1]
        edge = np.concatenate([[score.min() - 2], (score[order][1:] + score[order][:-1]) / 2, [score.max() + 2]])
        width = np.concatenate([[1.0], np.diff(score[order]), [1.0]])
        best = max(range(len(edge)), key=lambda i: (-errors[i], width[i]))
        self.weights, self.bias = w, b - edge[best] + np.log(cut / (1 - cut))

    def find(self, found: list[np.ndarray]) -> list[np.ndarray]:
        """Positions of each text's features among the kept."""
        out = []
        for marks in found:
            at = np.searchsorted(marks, self.marks)
            at[at == len(marks)] = 0
            out.append(np.flatnonzero(marks[at] == self.marks) if len(marks) else np.zeros(0, np.int64))
        return out

    def scores(self, column: pa.Array) -> np.ndarray:
        if self.empty:
            return np.zeros(len(column))
        found = (at for i in range(0, len(column), STEP_ROWS) for at in self.find(word_marks(column.slice(i, STEP_ROWS))))
        raw = np.array([self.weights[at].sum() for at in found]) + self.bias
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, cut: float = CUT, fairness: float = FAIRNESS) -> Classifier:
    """``labels``: doc_id, toxic, already without held-out rows."""
    ship(docs.sparkSession)
    rows = save(labelled(docs, labels, "toxic", sample), "toxic-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, STEP_ROWS):
            label = batch.column(1).to_numpy()
            found = word_marks(batch.column(0))
            sizes = [len(f) for f in found]
            flat = np.concatenate([*found, np.zeros(0, np.uint64)])
            marks, back = np.unique(flat, return_inverse=True)
            toxic = np.bincount(back, weights=np.repeat(label, sizes), minlength=len(marks)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(marks.view(np.int64)), pa.array(toxic), pa.array(np.bincount(back, minlength=len(marks)).astype(np.int64))], names=["mark", "toxic", "n"])

    totals = rows.agg(F.coalesce(F.sum("label"), F.lit(0)).alias("toxic"), F.count("*").alias("n")).first()
    counts = rows.select("text", "label").mapInArrow(count, "mark long, toxic long, n long").groupBy("mark").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
    rate = lambda hits, of: (hits + 0.5) / (of + 1.0)
    odds = F.log(rate(F.col("toxic"), totals.toxic) / rate(F.col("n") - F.col("toxic"), totals.n - totals.toxic))
    kept = counts.where(F.col("toxic") >= LEAST).withColumn("odds", odds).where(F.col("odds") >= float(np.log(ODDS)))
    top = kept.orderBy((F.col("odds") * F.col("toxic")).desc(), "mark").limit(FEATURES).select("mark").toArrow()
    kinds = (*IDENTITY, *neutral_terms(rows, totals.toxic, totals.n))
    terms = np.concatenate(word_marks(pa.array([term for kind in kinds for term in kind])))
    marks = np.union1d(top.column("mark").to_numpy().view(np.uint64), terms)
    blank = Classifier(marks, [], np.zeros(0, bool), [])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, STEP_ROWS):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), _lists(blank.find(word_marks(batch.column(1))))], names=["id", "label", "at"])

    def swap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        swaps = Swaps(kinds)
        for batch in steps(batches, STEP_ROWS):
            pairs = [p for t in batch.column(0).to_pylist() for p in swaps.swapped(t or "")]
            for i in range(0, len(pairs), 1024):
                sides = [_lists(blank.find(word_marks(pa.array([p[side] for p in pairs[i : i + 1024]])))) for side in (0, 1)]
                yield pa.RecordBatch.from_arrays(sides, names=["before", "after"])

    told = rows.select("doc_id", "text", "label").mapInArrow(find, "id long, label int, at array<int>").toArrow().to_pylist()
    real = sorted((t for t in told), key=lambda t: (t["id"], t["label"], t["at"]))
    moved = rows.select("text").mapInArrow(swap, "before array<int>, after array<int>").where("before <> after").orderBy(F.xxhash64("before", "after"), "before", "after").limit(PAIRS).toArrow().to_pylist()
    pairs = [(np.array(m["before"], np.int64), np.array(m["after"], np.int64)) for m in moved]
    return Classifier(marks, [np.array(t["at"], np.int64) for t in real], np.array([t["label"] == 1 for t in real], bool), pairs, cut, fairness)


def _lists(found: list[np.ndarray]) -> pa.Array:
    return pa.array([f.tolist() for f in found], pa.list_(pa.int32()))


def score(spark: SparkSession, model: Classifier) -> Callable[[Column], Column]:
    """A function from a text column to its scores."""
    ship(spark)
    sent = spark.sparkContext.broadcast(model)  # at most FEATURES weights

    @F.arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(sent.value.scores(texts))

    return lambda text: of(text.cast("string"))


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit(docs, labels.where(fold(F.col("doc_id"), FOLDS) != 1))
    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == 1, F.lit(False))
    out = docs.select("doc_id", held.alias("held_out"), score(spark, model)(F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
