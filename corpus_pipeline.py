"""From raw documents to tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.

1. language ID: documents without letters, or foreign to all languages, go; a null language is filled in.
2. line dedup: lines that ten documents hold go from every document.
3. near-dedup: of each group of documents alike in their five-word shingles, the one of least id stays.
4. mixing: documents are repeated or left out so that sources come to their target shares of words.
5. SentencePiece: each document's token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amplitract.llm.language_id import identify, train
from amplitract.llm.line_dedup import dedup_lines
from amplitract.llm.minhash_dedup import dedup_documents
from amplitract.llm.mixing import mix_documents
from amplitract.llm.sentencepiece_matching import encode
from amplitract.llm.shared import materialize

#: Stages learn, sample and encode in ways that SQL can't express; tests hold them against brute-force versions.
ORACLE_SQL = None

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = identify(docs.select(*COLUMNS), train(docs))
    lang = F.coalesce("lang", F.col("lang_pred")).alias("lang")
    return judged.where(~F.col("rejected")).select(*[lang if c == "lang" else c for c in COLUMNS])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup_lines(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup_documents(docs.select(*COLUMNS))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_documents(docs.select(*COLUMNS))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = encode(docs.select("doc_id", "lang", "source", "text"))
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("sentencepiece", sentencepiece),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, with each stage's result written to the shared folder for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
