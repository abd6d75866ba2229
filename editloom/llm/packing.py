"""Mixture-controlled packing: deficit round-robin over source queues into windows of fixed length.

Each source queues its documents' tokens in a shuffled order, cut into packets. A round grants each
source a quantum of a window's length times its target proportion; a source sends the packets its
credit covers and carries the deficit on. The credit after r rounds is r quanta whatever was sent
before, so a packet that ends at token c of its queue leaves in round ceil(c / quantum): rounds, and so
the whole schedule, follow from running totals, and deficits carry across windows and partitions with no
sequential pass. Packets in order of round, source and queue form one stream that is cut every window
length: only the last sequence can be short. It is padded unless its length is a power of two.

Token ids live in record files written once by the tasks that encode; the schedule moves only lengths,
and each file is opened again by one task that goes through the pieces cut from it.

Target proportions default to the sources' shares of all tokens; with others, a source that runs dry
leaves its share of later windows to the rest.

Defined cases: a null or empty text is the end id alone; a null source is a queue of its own; rows that
repeat a doc_id, or have none, are packed each; an empty table gives no pieces. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from editloom.llm.base import save
from editloom.llm.mixing import buckets_for, digest_bucket, queue_key, running_before
from editloom.llm.records import crc, read_some, write_tokens

LENGTH, PACKET, END_ID, SEED = 4096, 512, 2, "pack-1"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def encoded(docs: DataFrame, tokenizer_file: str, end_id: int = END_ID, ordinary: bool = False) -> DataFrame:
    """Index of record files with each row's queue."""
    return write_tokens(docs.select("doc_id", "text", queue_key(F.col("source")).alias("queue")), tokenizer_file, end_id, "pack", ordinary)


def schedule(index: DataFrame, length: int = LENGTH, packet: int = PACKET, shares: dict[str, float] | None = None) -> DataFrame:
    """The index's rows exploded to pieces: file, part, offset, doc_id, n_tokens, start, length, sequence_id, place.

    ``shares``: proportions by queue name (``queue_key``); a missing queue gets 0 and is sent last."""
    digest = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(SEED)))
    rows = index.select("file", "part", F.col("offset").alias("at"), "doc_id", "queue", "n_tokens", digest.alias("digest"))
    totals = rows.groupBy("queue").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows"))
    sums = save(totals, "pack-queues")
    total = sums.agg(F.sum("tokens").alias("tokens"), F.sum("rows").alias("rows")).first()
    if not total.tokens:
        return rows.select("file", "part", "at", "doc_id", "n_tokens", *[F.lit(0).cast("long").alias(c) for c in ("start", "length", "sequence_id", "place")]).limit(0)
    buckets = buckets_for(total.rows)
    ranged = rows.withColumn("bucket", digest_bucket(F.col("digest"), buckets))
    lined = running_before(ranged, ["queue"], "bucket", ["digest", "part", "at"], "n_tokens", "ahead", "pack-base")
    if shares is None:
        share = F.col("tokens") / F.lit(total.tokens)
    else:
        share = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in shares.items() for x in kv]), F.col("queue")), F.lit(0.0)) if shares else F.lit(0.0)
    quanta = sums.select("queue", (share * F.lit(length)).alias("quantum"))
    split = lined.join(quanta, "queue").withColumn("number", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_tokens") - 1) / packet))))
    sent = F.col("ahead") + F.least((F.col("number") + 1) * packet, F.col("n_tokens"))
    last = float(2**52)
    packets = split.select(
        "file", "part", "at", "doc_id", "n_tokens", "queue", "ahead", (F.col("number") * packet).alias("start"),
        F.least(F.lit(packet).cast("long"), F.col("n_tokens") - F.col("number") * packet).alias("size"),
        F.when(F.col("quantum") > 0, F.ceil(sent / F.col("quantum")).cast("double")).otherwise(F.lit(last)).alias("round"),
    )
    packets = save(packets, "pack-packets")
    # With own shares, rounds after a source ran dry hold less; ranges by round stay near even all the same.
    rounds = packets.where(F.col("round") < last).agg(F.max("round")).first()[0] or 1.0
    ordered = packets.withColumn("range", F.least(F.floor(F.col("round") * buckets / F.lit(rounds + 1.0)), F.lit(buckets)).cast("int"))
    placed = running_before(ordered, [], "range", ["round", "queue", "ahead", "start"], "size", "spot", "pack-merged")
    windows = F.sequence(F.floor(F.col("spot") / length), F.floor((F.col("spot") + F.col("size") - 1) / length))
    cut = placed.withColumn("sequence_id", F.explode(windows))
    begin = F.greatest(F.col("spot"), F.col("sequence_id") * length)
    end = F.least(F.col("spot") + F.col("size"), (F.col("sequence_id") + 1) * length)
    return cut.select(
        "file", "part", "at", "doc_id", "n_tokens", (F.col("start") + begin - F.col("spot")).alias("start"), (end - begin).alias("length"),
        "sequence_id", (begin - F.col("sequence_id") * length).alias("place"),
    )


def pieces(index: DataFrame, plan: DataFrame) -> DataFrame:
    """Each piece of ``plan`` with the checksum of its ids, from the files."""
    parts = index.agg(F.max("part")).first()[0]
    wanted = plan.select("file", "part", F.col("at").alias("offset"), "doc_id", "n_tokens", "start", "length", "sequence_id", "place")

    def row(ids, w):
        return {
            "doc_id": w["doc_id"], "start": w["start"], "length": w["length"], "ids_crc32": crc(ids[w["start"] : w["start"] + w["length"]]),
            "doc_tokens": w["n_tokens"], "sequence_id": w["sequence_id"], "offset": w["place"],
        }

    return read_some(wanted, (parts if parts is not None else 0) + 1, T._parse_datatype_string(PIECES), row)


def packed(docs: DataFrame, tokenizer_file: str, length: int = LENGTH, packet: int = PACKET, shares: dict[str, float] | None = None) -> DataFrame:
    index = encoded(docs, tokenizer_file)
    return pieces(index, schedule(index, length, packet, shares))


def op8_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
