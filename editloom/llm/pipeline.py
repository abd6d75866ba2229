"""A corpus pipeline over the documents table.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame,
which is written as Parquet and read again as the next one's docs. All but the last return the columns
of documents, and other columns that docs may have, whatever their names.

Defined cases, for every stage: an empty table gives an empty one; a null or empty text is a document like
others; a null doc_id, lang, source or n_chars never drops a row. What each stage makes of ties and
repeated rows is told there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from editloom.llm import mixing, near_dedup, packing, quality, toxicity
from editloom.llm.base import save

TOKENIZER = "word_bpe_49k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go: those that score ``toxicity.CUT`` or more. Each row is judged
    by its text alone, so repeated rows share their fate; a text without words scores like one without features."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels.where(quality.fold(F.col("doc_id"), toxicity.FOLDS) != 1))
    return docs.where(toxicity.score(spark, model)(F.col("text")) < toxicity.CUT)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality ranking rejects go: those that score less than ``quality.CUT``. Each row is judged by
    its text alone, so repeated rows share their fate; an empty text is judged as one whose features are all 0."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels.where(quality.fold(F.col("doc_id"), quality.FOLDS) != 0))
    return docs.where(quality.score(spark, model)(F.col("text")) >= quality.CUT)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document stays, that of the smallest id; of repeated rows one, told by a digest
    of the row. Texts without words are no copies of each other; rows without a doc_id all stay."""
    return near_dedup.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stand once for each epoch in which the mix serves at least half of their words. Ties in the order are
    broken by digest and size; a null source is a source; texts without words stay once."""
    return mixing.mix_copies(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 token ids. Every row is packed, repeated ones each, an empty text as its end id."""
    import public_tokenizers

    return packing.packed(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", drop_poor),
    ("MinHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack),
]
#: Models and shingle signatures are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), "stage-" + name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
