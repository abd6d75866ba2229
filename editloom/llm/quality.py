"""Quality scores by Bradley-Terry ranking.

From labelled documents, preference pairs (a good over a bad one) are drawn, and weights are fitted by
logistic loss on feature differences. A threshold at the score quantile of the low-quality share splits
the ranking; scores are mapped to 0..1 so that the threshold falls on ``cut``.

The fit sees at most ``SAMPLE`` labelled ids, one text a label of each, and ``PAIRS`` pairs, drawn by digests of ids; features are made
in tasks and the driver holds SAMPLE rows of numbers. Scoring covers every whole text.

Defined cases: null and empty texts score like a text whose features are all 0; null labels and labels
without a document are ignored; rows that repeat a doc_id are scored each, and one of them is learned from; with labels of one kind only,
all scores are 1 (or 0 if none is good); a null doc_id is scored and not held out. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from editloom.llm.base import ship
from editloom.llm.features import DENSE, dense

SAMPLE, PAIRS, CUT, FOLDS = 20_000, 20_000, 0.3, 5
STEPS, RIDGE = 25, 1e-3


def fold(doc_id: Column, folds: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds))


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int = SAMPLE) -> DataFrame:
    """doc_id, text, label of at most ``most`` labelled ids, those of the least digests; of rows that repeat an id, the
    text of the least digest."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("__id"), F.col(label).cast("int").alias("label"))
    few = known.distinct().orderBy(F.xxhash64("__id"), "__id", "label").limit(most)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.join(F.broadcast(few), F.col("doc_id") == F.col("__id"))  # at most ``most`` rows
    return found.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("least")).select("doc_id", "least.text", "label")


def _columns(column: pa.Array) -> np.ndarray:
    x = dense(column)
    return np.hstack([x, np.sqrt(x)])


class Ranking:
    """Weights over standardised features, a threshold on the raw score, and a scale."""

    def __init__(self, x: np.ndarray, good: np.ndarray, pairs: int = PAIRS, cut: float = CUT, seed: int = 0) -> None:
        width = 2 * len(DENSE)
        self.mean, self.spread = (x.mean(0), x.std(0) + 1e-9) if len(x) else (np.zeros(width), np.ones(width))
        self.weights, self.threshold, self.scale = np.zeros(width), 0.0, 1.0
        self.shift = np.log(cut / (1 - cut))
        better, worse = np.flatnonzero(good), np.flatnonzero(~good)
        if not len(better) or not len(worse):
            self.threshold = np.inf if len(worse) else -np.inf
            return
        z = self._standard(x)
        draw = np.random.default_rng(seed)
        gap = z[draw.choice(better, pairs)] - z[draw.choice(worse, pairs)]
        for _ in range(STEPS):  # Newton steps on the mean logistic loss
            p = 1 / (1 + np.exp(np.clip(gap @ self.weights, -50, 50)))
            slope = RIDGE * self.weights - (gap * p[:, None]).mean(0)
            bend = (gap * (p * (1 - p))[:, None]).T @ gap / len(gap) + RIDGE * np.eye(width)
            self.weights -= np.linalg.solve(bend, slope)
        raw = np.sort(z @ self.weights)
        at = len(worse)
        self.threshold = (raw[at - 1] + raw[at]) / 2
        self.scale = max(raw.std() / 3, 1e-9)

    def _standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -20, 20)

    def scores(self, column: pa.Array) -> np.ndarray:
        raw = self._standard(_columns(column)) @ self.weights
        if np.isinf(self.threshold):
            return np.full(len(raw), float(self.threshold < 0))
        return 1 / (1 + np.exp(-np.clip((raw - self.threshold) / self.scale + self.shift, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, pairs: int = PAIRS, cut: float = CUT) -> Ranking:
    """``labels``: doc_id, quality (1 is good), already without held-out rows."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _columns(batch.column(1))
            lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, batch.column(2)], names=["doc_id", "x", "label"])

    rows = labelled(docs, labels, "quality", sample).mapInArrow(run, "doc_id long, x array<double>, label int").toArrow()
    x = rows.column("x").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, 2 * len(DENSE)) if rows.num_rows else np.zeros((0, 2 * len(DENSE)))
    order = np.lexsort((rows.column("label").to_numpy(), rows.column("doc_id").to_numpy()))
    return Ranking(x[order], rows.column("label").to_numpy()[order] == 1, pairs, cut)


def score(spark: SparkSession, model: Ranking) -> Callable[[Column], Column]:
    """A function from a text column to its scores."""
    ship(spark)
    sent = spark.sparkContext.broadcast(model)  # two numbers a feature

    @F.arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(sent.value.scores(texts))

    return lambda text: of(text.cast("string"))


def op3_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit(docs, labels.where(fold(F.col("doc_id"), FOLDS) != 0))
    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == 0, F.lit(False))
    out = docs.select("doc_id", held.alias("held_out"), score(spark, model)(F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
