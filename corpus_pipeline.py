"""A pipeline from raw documents to token ids: rules, near-duplicates, repeated passages, mixture, tokens."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablestore.llm import bpe, copies, mixing, rules, substring
from tablestore.llm.common import clear_scratch, fresh, quoted, scratch_mark, scratch_path
from tablestore.llm.queries import tokenizer_path

def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the rules on documents and hosts reject. Null and empty texts go; repeated rows go or stay together."""
    return rules.keep_good(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates: that of the smallest id, nulls last. Null and empty texts are equal texts."""
    return copies.keep_one(docs, similarity=0.8, words=5)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut the words of repeated 35-word windows out of the texts; a document with no word left goes.

    n_chars, where present, is brought up to date.
    """
    others, no_text = [c for c in docs.columns if c != "text"], fresh("no_text")
    rows = docs.select(F.struct(*(quoted(c) for c in others), F.col("text").isNull().alias(no_text)).alias("whole"), F.col("doc_id").alias("id"), F.col("text").alias("body"))
    judged = substring.dedupe(rows, "id", "body", ["whole"], with_text=True).where("n_removed < n_words or n_removed = 0")
    whole = F.col("row.whole")
    column = {c: whole[c].alias(c) for c in others} | {"text": F.when(~whole[no_text], F.col("kept_text")).alias("text")}
    if "n_chars" in others:
        kind = docs.schema["n_chars"].dataType
        column["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept_text").cast(kind)).otherwise(whole["n_chars"]).alias("n_chars")
    return judged.select(*(column[c] for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat and cut the sources to their target weights. Null texts have no words; repeated rows are documents of their own."""
    return mixing.mixed(docs)


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with the digests of the ids and of the text decoded from them. Null texts have no tokens.

    Of the other columns, lang and source go along where they exist.
    """
    vocabulary = Path(tokenizer_path()).read_text(encoding="utf-8")
    return bpe.encode(docs, vocabulary, carry=[c for c in ("lang", "source") if c in docs.columns], with_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", simhash_dedup),
    ("substring dedup", substring_dedup),
    ("source mixing", mix_sources),
    ("bpe encoding", bpe_encode),
]

#: SQL has no XXH64 fingerprints and no byte-pair merges; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`; each stage's rows are written to the shared folder and read again, the last one's stay there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mark = scratch_mark()
    for _, stage in STAGES:
        path = scratch_path(spark, "pipeline")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        # what the stage needed goes, its predecessor's rows among it
        clear_scratch(spark, mark, path)
    return docs
