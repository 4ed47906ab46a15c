"""From documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet to the shared folder and read
again as the next one's ``docs``. All but the last return the columns of ``documents``:

1. ``language_id`` drops documents without a letter and those whose language is not clear;
2. ``quality`` drops documents that the rule ensemble scores below its cut;
3. ``ngram_dedup`` keeps, of each group of near copies, the document with the smallest id;
4. ``mixing`` repeats or leaves out documents so that sources come near their target weights;
5. ``packing`` cuts what is left into sequences.

Stages learn from what they are given, so each works on all that its predecessor kept.

Defined results: null and wordless texts go in the first stage. Documents without an id are documents
like any others: copies of theirs go, their pieces have a null ``doc_id``. Of rows that repeat an id and
a text one stays; rows that share an id but not the text are documents of their own. Which document of
a group stays is settled by the smallest id, then by a hash of the text. Very long texts pass whole.
Extra columns travel along until packing, whatever their names. Without labels every score of the
quality stage is one half and nothing goes there; without training rows (no document has a language)
the first stage knows no language and rejects all. An empty table gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewipe.llm import language_id, mixing, ngram_join, packing, quality
from tracewipe.llm.common import saved, table
from tracewipe.session import prepare


def _language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return language_id.accepted(docs)


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def _dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return ngram_join.keep_first(docs)


def _mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return mixing.mixed_documents(docs)


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return packing.pack(docs)


STAGES = [("language_id", _language), ("quality", _quality), ("ngram_dedup", _dedup), ("mixing", _mixing), ("packing", _packing)]

#: Models, near-duplicate components and token ids are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
