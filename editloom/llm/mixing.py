"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations alone.

Each source's documents are shuffled by a digest and queued, once an epoch, and served in packets of at
most ``PACKET`` words. A packet's virtual finish time is its source's cumulative words divided by the
source's target, so all sources are served in proportion. The queues are merged by that time over the
whole mix, and the merged order is truncated where the total budget is spent: what a document is given
is what its packets before the cut hold, and the packet at the cut is cut.

Running totals are taken in two levels: sums per source and digest bucket, then rows within a bucket,
so a source with a third of all rows is spread over as many tasks as any other share of the table.
Sources are ranked by ranges, and the share that a target stops at is found by sums over them.

Targets: sources ordered by code point, null last, weigh as ``weights`` repeat, and share ``budget``
times all sizes; a target stops at ``epochs`` times its source's size and the excess is shared anew.
A source's words in the mix miss its target by about a packet.

Defined cases: a null or blank text has size 0 and is never taken; a null source is a source of its own,
unlike the empty string; repeated rows are queued each; an empty table gives no rows. Columns other
than doc_id, text and source pass through unread in ``mix_copies`` and are ignored in ``mixed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from editloom.llm.base import drop, save, sized, unused, width

WEIGHTS, BUDGET, EPOCHS, SEED, PACKET = (3.0, 1.0, 2.0), 1.5, 2, "mix-1", 128
ROWS_A_BUCKET, LEAST_BUCKETS, MOST_BUCKETS = 20_000, 256, 1 << 16
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def queue_key(source: Column) -> Column:
    """A name that sorts like the source by code point, null last, and is never null."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def buckets_for(rows: int) -> int:
    return max(LEAST_BUCKETS, min(MOST_BUCKETS, rows // ROWS_A_BUCKET))


def digest_bucket(digest: Column, buckets: int) -> Column:
    """Even ranges of the first 32 bits of a hexadecimal digest."""
    return F.floor(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") * F.lit(buckets) / F.lit(1 << 32)).cast("int")


def running_before(df: DataFrame, by: list[str], bucket: str, order: list, value: str, out: str, name: str) -> DataFrame:
    """``out``: the sum of ``value`` over the rows of the same ``by`` that stand before, by ``bucket`` and ``order``."""
    sums = df.groupBy(*by, bucket).agg(F.sum(value).alias("__sum"))
    earlier = Window.partitionBy(*by).orderBy(bucket) if by else Window.orderBy(bucket)
    base = save(sums.select(*by, bucket, F.coalesce(F.sum("__sum").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base")), name)
    within = Window.partitionBy(*by, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.join(base, [*by, bucket]).withColumn(out, F.col("__base") + F.coalesce(F.sum(value).over(within), F.lit(0))).drop("__base")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, epochs: int = EPOCHS) -> DataFrame:
    """queue, source_size, target from (queue, size): one row a source. The level that a weight of 1 gets rises as
    sources stop, until the sources that it stops are those that it was computed with."""
    one = sizes.groupBy("queue").agg(F.sum("size").alias("source_size"))
    ranged = save(one.repartitionByRange(width(sizes.sparkSession), "queue").withColumns({"range": F.spark_partition_id(), "one": F.lit(1)}), "mix-sources")
    ranked = running_before(ranged, [], "range", ["queue"], "one", "rank", "mix-ranks")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    rows = save(ranked.select("queue", "source_size", weight.alias("weight"), (F.lit(float(epochs)) * F.col("source_size")).alias("stop")), "mix-weights")
    total = (rows.agg(F.sum("source_size")).first()[0] or 0) * float(budget)
    level, stopped = None, F.lit(False)
    while True:
        sums = rows.agg(F.sum(F.when(stopped, F.col("stop")).otherwise(0.0)).alias("stop"), F.sum(F.when(~stopped, F.col("weight"))).alias("weight")).first()
        if not sums.weight:  # all stop, or there are none
            return rows.select("queue", "source_size", F.col("stop").alias("target"))
        then = (total - sums.stop) / sums.weight
        if then == level:
            return rows.select("queue", "source_size", F.least(F.lit(level) * F.col("weight"), F.col("stop")).alias("target"))
        level, stopped = then, F.lit(then) * F.col("weight") > F.col("stop")


def queued(docs: DataFrame, weights: tuple[float, ...], budget: float, epochs: int, seed: str) -> tuple[DataFrame, int, int]:
    """Rows of doc_id, queue, digest, size, source_size, target and ``start``: the words of the source's queue
    before the row in the first epoch. Saved; with the number of digest ranges used and the words of the mix."""
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(f":{seed}")))
    narrow = save(docs.select("doc_id", queue_key(F.col("source")).alias("queue"), words(F.col("text")).alias("size"), digest.alias("digest")), "mix-sizes")
    told = narrow.agg(F.count("*").alias("rows"), F.coalesce(F.sum("size"), F.lit(0)).alias("words")).first()
    buckets = buckets_for(told.rows)
    aims = targets(narrow.select("queue", "size"), weights, budget, epochs)
    ranged = narrow.withColumn("bucket", digest_bucket(F.col("digest"), buckets))
    lined = running_before(ranged, ["queue"], "bucket", ["digest", "size"], "size", "start", "mix-base").drop("bucket")
    out = save(lined.join(aims, "queue"), "mix-queues")
    drop(narrow, aims)
    return out, buckets, int(told.words * min(float(budget), float(epochs)))


def served(rows: DataFrame, buckets: int, budget: int, epochs: int, packet: int = PACKET) -> DataFrame:
    """queue, start, epoch, size, part, position: what each packet is given of the ``budget``. Packets are merged by
    virtual finish time, and ``position`` counts the words of the mix before one."""
    entries = rows.where("size > 0 and target > 0").withColumn("epoch", F.explode(F.array(*[F.lit(e).cast("long") for e in range(epochs)])))
    entries = entries.withColumn("number", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / packet))))
    end = F.least((F.col("number") + 1) * packet, F.col("size"))
    finish = (F.col("start") + F.col("epoch") * F.col("source_size") + end) / F.col("target")
    entries = entries.select("queue", "start", "epoch", "number", "size", (end - F.col("number") * packet).alias("words"), finish.alias("finish"))
    # Up to 1 finish times are even in words; beyond, ranges narrow towards the last.
    late = F.lit(buckets) + F.floor((1 - 1 / F.col("finish")) * buckets)
    ranged = entries.withColumn("range", F.when(F.col("finish") <= 1, F.floor(F.col("finish") * buckets)).otherwise(late).cast("int"))
    merged = running_before(ranged, [], "range", ["finish", "queue", "start", "epoch", "number"], "words", "position", "mix-merged")
    return merged.withColumn("part", F.least(F.col("words"), F.lit(budget) - F.col("position"))).where("part > 0")


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, epochs: int = EPOCHS, seed: str = SEED, packet: int = PACKET) -> DataFrame:
    """doc_id, size, source_size, target, taken, position for every row of ``docs`` (doc_id, text, source).
    ``position``: the words of the mix before the document's first, in order of finish time; null if none is taken."""
    rows, buckets, whole = queued(docs, weights, budget, epochs, seed)
    spent = save(served(rows, buckets, whole, epochs, packet).groupBy("queue", "start").agg(F.sum("part").alias("taken"), F.min("position").alias("position")), "mix-taken")
    # Rows of no size share their start with the next of their queue.
    both = rows.join(spent.withColumn("some", F.lit(True)), ["queue", "start"], "left")
    keep = (F.col("size") > 0) & F.col("taken").isNotNull()
    return both.select(
        "doc_id", "size", "source_size", "target", F.when(keep, F.col("taken")).otherwise(F.lit(0)).cast("long").alias("taken"), F.when(keep, F.col("position")).alias("position")
    )


def mix_copies(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, epochs: int = EPOCHS, seed: str = SEED, packet: int = PACKET) -> DataFrame:
    """The mix as rows of ``docs`` with all columns: a document stands there once for each epoch in which at
    least half of its words are served; blank documents, which weigh nothing, stay."""
    rows, buckets, budget_words = queued(docs, weights, budget, epochs, seed)
    whole = served(rows, buckets, budget_words, epochs, packet).groupBy("queue", "start", "epoch").agg(F.sum("part").alias("part"), F.first("size").alias("size")).where("2 * part >= size")
    times = whole.groupBy("queue", "start").agg(F.count("*").alias("uses"))
    counts = rows.where("size > 0").join(times.hint("merge"), ["queue", "start"], "left").groupBy("doc_id", "size").agg(F.sum(F.coalesce("uses", F.lit(0))).alias("uses"), F.count("*").alias("rows"))
    identity, size, copies = (unused(docs, x) for x in ("mix_id", "mix_size", "mix_copies"))
    # Rows that repeat a doc_id and a size share their uses evenly, rounded up.
    each = F.ceil(F.col("uses") / F.col("rows")).cast("int")
    uses = save(counts.select(F.col("doc_id").alias(identity), F.col("size").alias(size), each.alias(copies)).where(F.col(copies) > 0), "mix-uses")
    drop(rows)
    n = words(F.col("text"))
    joined = docs.join(sized(uses, 100), docs["doc_id"].eqNullSafe(F.col(identity)) & (n == F.col(size)), "left")
    times = F.when(n == 0, F.lit(1)).otherwise(F.coalesce(F.col(copies), F.lit(0)))
    return joined.withColumn(copies, F.explode(F.array_repeat(F.lit(0), times))).select(*docs.columns)


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    return mixed(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP5_SQL = """
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS queue,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':mix-1') AS digest FROM documents),
one AS (SELECT queue, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY queue),
weighed AS (SELECT *, list_extract([3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE], CAST((row_number() OVER (ORDER BY queue) - 1) % 3 + 1 AS BIGINT)) AS weight FROM one),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
             - coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY source_size / weight, queue ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY source_size / weight, queue ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
aims AS (
  SELECT queue, source_size, least(weight * (SELECT arg_min(level, row(source_size / weight, queue)) FROM levels WHERE level * weight <= 2.0 * source_size), 2.0::DOUBLE * source_size) AS target FROM levels),
queued AS (
  SELECT d.*, source_size, target, CAST(sum(size) OVER (PARTITION BY d.queue ORDER BY digest, size ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS start
  FROM d JOIN aims USING (queue)),
entries AS (
  SELECT queue, start, e, p, least((p + 1) * 128, size) - p * 128 AS words, (start + e * source_size + least((p + 1) * 128, size)) / target AS finish
  FROM (SELECT *, unnest(range(0, (size - 1) // 128 + 1)) AS p FROM queued, (VALUES (0), (1)) AS t(e) WHERE size > 0 AND target > 0) x),
merged AS (SELECT *, CAST(sum(words) OVER (ORDER BY finish, queue, start, e, p ROWS UNBOUNDED PRECEDING) - words AS BIGINT) AS position FROM entries),
spent AS (
  SELECT queue, start, CAST(sum(least(words, budget - position)) AS BIGINT) AS taken, min(position) AS position
  FROM merged, (SELECT CAST(floor(sum(size) * 1.5::DOUBLE) AS BIGINT) AS budget FROM d) b WHERE position < budget GROUP BY queue, start)
SELECT doc_id, size, source_size, target, CASE WHEN size > 0 THEN coalesce(taken, 0) ELSE 0 END AS taken, CASE WHEN size > 0 THEN position END AS position
FROM queued LEFT JOIN spent USING (queue, start)
"""
