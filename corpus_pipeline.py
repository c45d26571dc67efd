"""Corpus pipeline: five stages from raw documents to token ids, each reading the table that the one before wrote.

1. quality: documents below the classifier's threshold go;
2. near_dedup: of each group of near-copies (5-word shingles, similarity 0.8 or more) one document stays;
3. decontaminate: documents that hold a benchmark item within its error budget go;
4. secrets: every secret in a text is replaced by a mark;
5. tokenize: texts become byte-level BPE ids and back; one row a document with digests of both.

Stages 1 to 4 return the columns of their input.  Rows of a null doc_id pass stage 2.  A table that holds several rows
of the smallest doc_id of its group keeps all of these in stage 2, as they are one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm.bpe import bpe_round_trip
from loomgraph.llm.common import materialise, table
from loomgraph.llm.decontaminate import drop_contaminated
from loomgraph.llm.near_dup import near_duplicates
from loomgraph.llm.quality import keep_good
from loomgraph.llm.queries import tokenizer_path
from loomgraph.llm.secret_scan import redact_secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, table(spark, sf_dir, "labels"), threshold=0.3)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    dropped = near_duplicates(docs, k=5, threshold=0.8).where("not kept").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact_secrets(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_round_trip(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("secrets", secrets), ("tokenize", tokenize)]

#: A trained classifier and a tokenizer decide here; SQL can't say that.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
