"""The registered corpus queries: name -> (function of (spark, sf_dir), DuckDB SQL or None)."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievekit.llm import ann, chat, collocations, fingerprint, langid, merkle, minhash, mixing, ngram_join, pii, sharding, sptokens, url_filter
from sievekit.llm.common import bound_batches, cut, table, word_count
from sievekit.llm.sql import COLLOCATIONS_SQL, merkle_sql

SHARDS = 8

MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS key,
    CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size
  FROM documents),
s AS (
  SELECT source, key, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
  FROM d GROUP BY source, key),
c AS (SELECT *, (place % 3 + 1)::DOUBLE AS weight, source_size::DOUBLE * 3 AS cap FROM s),
l AS (
  SELECT *, cap / weight AS ratio,
    ((sum(source_size) OVER ())::DOUBLE
      - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM c),
t AS (
  SELECT key, source_size,
    CASE WHEN level > ratio THEN cap ELSE weight * (SELECT max(level) FROM l WHERE level <= ratio) END AS target
  FROM l),
r AS (
  SELECT doc_id, size, source_size, target, row_number() OVER (PARTITION BY key ORDER BY size, coalesce(substr(md5(doc_id::VARCHAR), 1, 3), ''), doc_id) AS nth,
    ('0x' || substr(md5(key || '#8'), 1, 5))::INT / 1048576::DOUBLE AS start,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate
  FROM d JOIN t USING (key))
SELECT doc_id, size, source_size, target,
  (least(floor(start + rate * nth) - floor(start + rate * (nth - 1)), 3) * size)::BIGINT AS taken
FROM r
"""


def op1_url_language_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL: by rule, else by the two language models."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_filter.judge(pages, url_filter.fit_on_rules(pages))
    return judged.select("page_id", "host", "path", "rule", "verdict", "lm_score")


def op2_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with pseudonyms for their personal data."""
    docs = table(spark, sf_dir, "documents")
    return pii.pseudonymise(docs).withColumn("pii_kinds", F.array_join("pii_kinds", ","))


def op3_universe_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component and number of links of all documents, linked by five-word shingles at a Jaccard similarity of 0.75."""
    bound_batches(spark)
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op4_byte_convolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text, by a network that never saw the held-out documents."""
    bound_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs, ~langid.held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 7 of all documents under the law `bytes`; `slot` is the row's place in its shard."""
    docs = table(spark, sf_dir, "documents")
    body = F.col("text").cast("binary")
    rows = cut(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(body).alias("text_crc32"),
        ).withColumn("vslot", sharding.slot_of(F.col("doc_id"), F.col("text_crc32")))
    )
    slot_map = cut(sharding.build_map(sharding.slot_loads(rows, "size"), SHARDS))
    placed = sharding.assign(rows, slot_map, ["doc_id", "text_crc32", "size"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        F.col("position").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        F.col("vslot").alias("virtual_slot"),
    )


def op6_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled piece ids of every whole text, and whether decoding gives back the text."""
    bound_batches(spark)
    words = sptokens.Vocabulary.from_model()
    coded = sptokens.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), words, F.col("doc_id"))
    # An expression between the two functions: chained directly, Spark would encode twice.
    ids = F.when(F.col("text").isNotNull(), F.col("ids"))
    same = sptokens.decode(ids, spark, words).eqNullSafe(F.col("text"))
    return coded.select("doc_id", F.size("ids").alias("n_pieces"), "ids", same.alias("lossless"))


def op7_vantage_point_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest by inner product of every vector whose id is divisible by 20."""
    bound_batches(spark)
    vectors = ann.usable_vectors(table(spark, sf_dir, "embeddings"))
    index = cut(ann.build_index(vectors))
    queries = vectors.where(F.col("vec_id") % 20 == 0)
    return ann.search(index, queries, index.count())


def op8_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    docs = table(spark, sf_dir, "documents")
    rows = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    mixed = mixing.systematic_copies(rows)
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken")
    )


def op9_budgeted_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation, read back from its formatted windows."""
    bound_batches(spark)
    mark = "<|im_end|><|im_start|>assistant ok"
    probe = spark.sql("SELECT -1L AS conv_id, id AS turn, element_at(array('user', 'assistant'), int(id) + 1) AS role FROM range(2)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    every = rows.unionByName(probe.withColumn("text", F.lit(mark)))
    return chat.digests(chat.windows(every))


def op10_consistent_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edited form, and their likeness."""
    bound_batches(spark)
    buckets = fingerprint.BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    return fingerprint.compare_edits(table(spark, sf_dir, "documents"), buckets)


def op11_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents, by two-word shingles at a Jaccard similarity of 0.8."""
    bound_batches(spark)
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op12_de_bruijn_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of each language, from the counts of all texts."""
    bound_batches(spark)
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_postorder_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle proofs of all documents, a fifth of them tampered with."""
    bound_batches(spark)
    return merkle.verify(table(spark, sf_dir, "documents"))


QUERIES: dict = {
    "pipeline": (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL),
    "op1_url_language_models": (op1_url_language_models, None),
    "op2_feistel_pseudonyms": (op2_feistel_pseudonyms, None),
    "op3_universe_partition": (op3_universe_partition, None),
    "op4_byte_convolutions": (op4_byte_convolutions, None),
    "op5_virtual_slots": (op5_virtual_slots, None),
    "op6_sampled_pieces": (op6_sampled_pieces, None),
    "op7_vantage_point_trees": (op7_vantage_point_trees, None),
    "op8_systematic_mix": (op8_systematic_mix, MIX_SQL),
    "op9_budgeted_windows": (op9_budgeted_windows, None),
    "op10_consistent_parsing": (op10_consistent_parsing, None),
    "op11_circulant_minhash": (op11_circulant_minhash, None),
    "op12_de_bruijn_phrases": (op12_de_bruijn_phrases, COLLOCATIONS_SQL),
    "op13_postorder_manifest": (op13_postorder_manifest, merkle_sql()),
}
