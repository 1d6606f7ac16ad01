"""A training corpus from raw documents: five stages, each written as Parquet and read again for the next.

quality     keeps what the quality classifier keeps; labels are read from the same folder
near_dedup  keeps of each group of near duplicates (five-word shingles, similarity 0.8) the document of least id and text digest
pii         puts <KIND> for personal data in the texts
mixing      repeats or leaves out documents, so that sources come near their target shares
tokens      encodes the texts; one row for each copy: doc_id, source, n_tokens, ids, and the digests of ids and decoded text

Defined results: an empty table gives an empty one at every stage; documents without id pass the near-dedup stage; rows
that share an id and the text are one document there, those that share an id only are several; null texts count as empty and stay null until they are encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import Scratch, table
from tidewell.llm.op2_bpe import encode_table
from tidewell.llm.op4_pii import redact
from tidewell.llm.op7_quality import kept_rows
from tidewell.llm.op8_mixing import mix_sources
from tidewell.llm.op10_minhash import near_duplicates

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return kept_rows(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    stay = near_duplicates(docs, words_per=5, percent=80).where("kept and id is not null").select(F.col("id").alias("doc_id"), "digest").distinct()
    rows = docs.withColumn("digest", F.md5(F.coalesce("text", F.lit(""))))
    return rows.join(stay, ["doc_id", "digest"], "left_semi").dropDuplicates(["doc_id", "digest"]).select(*COLUMNS).union(docs.where("doc_id is null"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs.select(*COLUMNS)).withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mix_sources(docs.select(*COLUMNS), keep=("text", "lang", "n_chars")).where("copies > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_table(docs.select(*COLUMNS), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep=("source",))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("pii", pii), ("mixing", mixing), ("tokens", tokens)]
#: None of the stages has a form in SQL: tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir))
    return docs


QUERIES = {"pipeline": run}
ORACLE: dict = {}
