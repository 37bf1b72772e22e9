"""The corpus pipeline: five stages over ``documents``, each on all that the one before kept.

Every stage is a function of (spark, docs, sf_dir). Its result is written as Parquet and read
again as the next stage's ``docs``. All but the last return the columns of ``documents``.

1. ``language``: documents without a recognisable language go: those without text or letters, and those
   that the byte network, which learns a class of junk for it, rejects (see ``langid``).
2. ``near_duplicates``: one document of each group of linked ones stays, that of least doc_id.
3. ``pseudonyms``: personal data gives way to format-preserving pseudonyms.
4. ``mix``: sources are mixed to their target weights; a document may go, or come up to three times.
5. ``pieces``: every text becomes sampled piece ids, which decode to the text again.

Edge cases: null or empty texts, and texts that are mostly numbers, hashes or marks, go in the first stage; rows of one doc_id are one document in the
second, and rows without a doc_id all stay; columns beyond those of ``documents`` are dropped by the
first stage; an empty table goes through all stages.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievekit.llm import langid, mixing, ngram_join, pii, sptokens
from sievekit.llm.common import bound_batches, word_count
from sievekit.session import scratch_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in which the byte network recognises a language."""
    bound_batches(spark)
    docs = docs.select(*COLUMNS)
    model = langid.fit(docs, F.col("doc_id").isNotNull() & ~langid.held_out(F.col("doc_id")), reject=True)
    return langid.predict(docs, model).where(F.col("lang_pred") != langid.UNKNOWN).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least doc_id of each group."""
    bound_batches(spark)
    return ngram_join.representatives(docs).select(*COLUMNS)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data; n_chars follows the new text."""
    return pii.pseudonymise(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emits every document as often as the mix takes it."""
    sized = docs.select(*COLUMNS, word_count(F.col("text")).alias("size"))
    return mixing.emit_copies(mixing.systematic_copies(sized, tie="text")).select(*COLUMNS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled piece ids of every text."""
    bound_batches(spark)
    words = sptokens.Vocabulary.from_model()
    coded = sptokens.encode(docs.select(*COLUMNS), words, F.col("doc_id"))
    return coded.select("doc_id", "lang", "source", F.size("ids").alias("n_pieces"), "ids")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("pseudonyms", pseudonyms),
    ("mix", mix),
    ("pieces", pieces),
]

# Neither a trained network nor sampled segmentations can be said in SQL; the tests hold the
# stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, with Parquet in the shared folder between them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch_path(spark, f"pipeline-{uuid.uuid4()}")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return out
        out.write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
