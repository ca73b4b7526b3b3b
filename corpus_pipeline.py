"""A corpus pipeline over the table documents: five stages, each one operator of retort.llm.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and returns a DataFrame that is
written as Parquet and read again for the next one. All but the last return the columns of documents.

* language_id drops documents without a letter and those whose language stays unclear (score under 0.4, or with more than four languages under 1.6 times an even share).
* line_dedup removes repeated lines from texts; n_chars follows the text.
* near_duplicates keeps one document, the smallest doc_id, of each group of near duplicates; equal doc_ids stay or go together.
* decontamination drops documents that hold a passage of the benchmark.
* packing returns the token pieces of what is left.

Rows without doc_id cannot be named by a finding: line_dedup, near_duplicates and decontamination keep them. Other columns pass
through, whatever their names.

SQL expresses neither the network of the first stage nor the tokenizer of the last: there is no ORACLE_SQL, and tests
hold the stages against brute force.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retort.llm import decontaminate, jaccard_join, language_id, line_dedup, packing
from retort.llm.common import scratch, table

LEAST_SCORE, LEAST_TIMES = 0.4, 1.6
ORACLE_SQL = None


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    net = language_id.train(docs)
    least = min(LEAST_SCORE, LEAST_TIMES / len(net.labels)) if net else LEAST_SCORE
    found = language_id.identify(docs, net, "__language")
    return found.where((F.col("__language.lang_pred") != "und") & (F.col("__language.score") >= least)).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    new = {"text": F.when(F.col("__lines.n_dropped") > 0, F.col("__lines.kept")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("__lines.n_dropped") > 0, F.length("__lines.kept").cast("long")).otherwise(F.col("n_chars"))
    return line_dedup.dedup_lines(docs, out="__lines").withColumns(new).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = jaccard_join.jaccard_components(docs)
    gone = groups.where("component_id <> doc_id").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("found_id")).distinct()
    return docs.join(found, docs["doc_id"] == found["found_id"], "left_anti")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{scratch(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
