"""Which tables Spark may broadcast."""

import random

import pytest
from pyspark.sql import functions as F

from editloom.llm import base, graph, mixing, near_dedup
from tests.llm.helpers import corpus, frame


@pytest.fixture
def plans(monkeypatch):
    """The plans of stored tables by name; no table is small enough to broadcast."""
    found = []
    monkeypatch.setattr(base, "BROADCAST", 0, raising=False)
    monkeypatch.setattr(graph, "EDGES_A_TASK", 1)
    for module in (near_dedup, graph, mixing):
        monkeypatch.setattr(module, "save", lambda df, name: found.append((name, df._jdf.queryExecution().executedPlan().toString())) or base.save(df, name))
    return found


def test_what_grows_with_the_documents_is_merged(spark, plans):
    docs = frame(spark, corpus().items())
    out = near_dedup.near_components(docs, 85)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    near_dedup.deduplicate(docs, 85).count()
    graph.components(spark.range(20).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))).count()
    grown = [(name, plan) for name, plan in plans if name in ("near-hits", "near-pairs", "near-texts", "near-named", "near-kept") or name.startswith(("cc-", "near-groups-"))]
    assert {"near-hits", "near-pairs", "near-texts", "near-named", "near-kept", "cc-large", "cc-edges"} <= {name for name, _ in grown}
    assert [name for name, plan in grown if "Broadcast" in plan] == []


def test_copies_of_the_mix_are_merged(spark, plans):
    out = mixing.mix_copies(frame(spark, corpus().items()))
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_signatures_are_sized_by_their_rows(spark):
    draw = random.Random(0)
    lists = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.xxhash64("id", i).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))
    wide = spark.range(25_000).select(F.col("id").alias("cid"), lists.alias("sig"), F.lit("x" * 16).cast("binary").alias("mark"), F.lit("y" * 16).cast("binary").alias("words"))
    stored = base.save(wide, "test-signatures")
    edges = spark.createDataFrame([(draw.randrange(25_000),) for _ in range(9)], "cid long")
    plan = lambda side: edges.join(side.select("cid", "sig"), "cid")._jdf.queryExecution().executedPlan().toString()
    taken = stored.select("cid", "sig")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert int(str(taken)) < 25_000 * 256 / 2  # Spark takes them for less than half
    assert "Broadcast" not in plan(base.sized(stored, 336))
    assert "Broadcast" in plan(base.sized(stored.where("cid < 9"), 336))
