"""Token-ID output: every document's ids in binary record files in ascending doc_id order, and reading them back.

Defined cases: a null or empty text is the end id alone; a null doc_id comes first and is kept as null;
rows that repeat a doc_id are records of their own, ordered by a digest of their text; an empty table
gives no file and no row. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editloom.llm.base import width
from editloom.llm.records import crc, read_files, write_tokens

END_ID = 2


def write_ordered(docs: DataFrame, tokenizer_file: str, end_id: int = END_ID, ordinary: bool = False) -> DataFrame:
    """The index of record files written in ascending doc_id order: a file a range of ids. ``ordinary``: strings of special
    tokens are encoded like other text; else as those tokens, as the library does."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ranged = narrow.repartitionByRange(width(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return write_tokens(ranged, tokenizer_file, end_id, "tokens", ordinary)


def read_back(index: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every record, from the files."""
    return read_files(index, "doc_id long, start long, n_tokens long, ids_crc32 long", lambda doc, ids, at: (doc, at["start"], len(ids), crc(ids)))


def op2_token_output(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_back(write_ordered(docs, public_tokenizers.path("byte_bpe_50k.json")))
