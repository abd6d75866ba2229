"""Trees on the letters of texts."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from editloom.operators import learners, trees


def letters_and_bytes(texts):
    return np.frombuffer("".join(texts).encode(), np.uint8).reshape(len(texts), -1)


@pytest.mark.parametrize("letters,length", [("ACGT", 12), ("ACGTabcdef", 7), ("AC", 1)])
@pytest.mark.parametrize("classify", [False, True])
def test_trees_on_letters_are_those_on_features(letters, length, classify):
    """Texts with letters that are none and cells without training rows."""
    draw = np.random.default_rng(3)
    texts = ["".join(t) for t in draw.choice(list(letters + "N"), (700, length))]
    n = draw.integers(0, 4, len(texts)).astype(float)
    y = draw.binomial(n.astype(int), np.where([t[0] == "C" for t in texts], 0.8, 0.3)).astype(float)
    got = trees.boosted_texts(letters_and_bytes(texts), letters, n, y, classify, 15)
    assert np.allclose(got, trees.boosted(trees.encoded(texts, letters), n, y, classify, 15), atol=1e-12)


def test_a_worker_holds_a_cell_in_two_hundred_bytes():
    draw = np.random.default_rng(4)
    texts = draw.choice(np.frombuffer(b"ACGT", np.uint8), (50_000, 20))
    n, y = np.ones(len(texts)), draw.random(len(texts))
    tracemalloc.start()
    trees.boosted_texts(texts, "ACGT", n, y, False, 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 * len(texts)


def test_a_group_of_three_hundred_thousand_cells_is_grown_in_one_task(spark, monkeypatch):
    """What is planted comes out without a job for each level of each tree."""
    monkeypatch.setattr(learners, "boosted_large", None)
    text = F.translate(F.substring(F.md5(F.col("id").cast("string")), 1, 20), "0123456789abcdef", "ACGTACGTACGTACGT")
    df = spark.range(300_000).select(F.lit("g").alias("grp"), text.alias("context"), F.when(F.col("id") % 4 == 0, "test").otherwise("train").alias("split"))
    df = df.withColumn("y", F.when(F.substring("context", 18, 1) == "C", 1.0).otherwise(0.0))
    found = learners.learn_groups(df, ["grp"], "gbt_classifier", "context", "y", count=2).withColumn("planted", F.substring("context", 18, 1) == "C")
    told = {r.planted: (r.least, r.most) for r in found.groupBy("planted").agg(F.min("predicted").alias("least"), F.max("predicted").alias("most")).collect()}
    assert found.count() == 300_000 and told[True][0] > 0.3 > 0.25 > told[False][1]
