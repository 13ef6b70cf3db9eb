"""Corpus pipeline over the documents table: five stages, each one operator.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before
has kept; ``run`` writes each stage's documents to the shared folder and reads
them again.

1. quality: documents that the attention classifier scores below 0.3 go.
2. line dedup: lines that stand, up to one to three edits by their length, in an
   earlier document or earlier in the same one are cut out; a document left without a line goes.
3. MinHash near-dedup: of each class of near-duplicates the first document stays.
4. decontamination: documents that share ten words in a row with a benchmark
   item go.
5. tokens: every document's BPE ids, and whether they decode to its text.

Rows: an empty table runs through; null texts are scored, kept and encoded as
empty ones; rows without an id are never dropped as copies.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bagminhash, bpe, common, decontam, line_dedup, quality

MIN_QUALITY = 0.3
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~common.held_out("doc_id"))
    return quality.keep(docs, quality.fit(docs, labels), MIN_QUALITY)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.remove(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bagminhash.keep_first(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, round_trip): ids as little-endian unsigned 32-bit integers."""
    source = bpe.tokenizer(docs, TOKENIZER)
    kept = F.struct("doc_id", "lang", "source", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha"))
    coded = bpe.encode(docs.withColumn("_kept", kept), source, id_col="_kept", decoded=True)
    return coded.select("id.doc_id", "id.lang", "id.source", F.expr("octet_length(ids) div 4").alias("n_tokens"), "ids",
                        (F.sha2(F.col("text").cast("binary"), 256) == F.col("id.sha")).alias("round_trip"))


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("minhash_near_dedup", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("bpe_tokens", token_stage),
]

# stages 1, 2, 3 and 5 have no SQL form; tests/llm compare the pipeline with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = common.Shared(spark, "corpus-pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = shared.write(stage(spark, docs, sf_dir))
    return docs
