"""A corpus from raw documents: filter, dedup exactly and nearly, mix, tokenize.

``run`` applies STAGES to the table of documents; each stage's result is written
as Parquet in the shared folder and read again as the next one's input. Stages
work by row, not by id: ids may be null or repeated. All but the last return the
columns that they are given, whatever their names; an empty table gives an empty
result. The two stages with the most memory, in the JVM (n-gram join) and in Python
(byte BPE), first have the executors give back what stages before them have left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from apilens.llm.byte_bpe import encode_documents
from apilens.llm.common import collected, table, written
from apilens.llm.exact_dedup import deduplicated
from apilens.llm.mixing import laid_out, mixed, tempered_weights
from apilens.llm.ngram_join import representatives
from apilens.llm.quality_rules import judge, learn_rules


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base filter nor the learned list rejects (null and empty texts fail the filter)."""
    rules = learn_rules(docs, table(spark, sf_dir, "labels"))
    return judge(docs, rules).filter("kept").select("row.*")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the smallest id (null ids last); of a repeated row, one."""
    return deduplicated(docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the row with the smallest id (null ids last); texts without words all stay."""
    collected(spark)
    return representatives(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, laid out in the order that gives each source its tempered share."""
    return mixed(docs, tempered_weights(docs))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts, digests of the ids and of the decoded text, and each row's place in the order that mixing laid out."""
    collected(spark)
    rows = laid_out(docs).select("row.doc_id", "row.text", "mix_position")
    return encode_documents(rows, with_ids=False, keep=["mix_position"])


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("n-gram join", ngram_join),
    ("mixing", mixing),
    ("byte BPE", byte_bpe),
]

#: The learned rules and the tokenizer can't be said in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; the last one's result."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
