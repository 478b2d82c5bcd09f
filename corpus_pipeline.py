"""A corpus pipeline: language ID, line dedup, near-dedup, decontamination and packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and
read again as the next one's docs. All but the last return the columns of docs, whatever
their names. Rows with null or empty text, and empty tables, pass through the stages
without failing; what becomes of them is said at each stage. A row is told by its doc_id
and text: rows that share an id alone are judged apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm.common import own_name, table, written
from evidentia.llm.decontaminate import contamination
from evidentia.llm.language_id import UNDETERMINED, fit, predict, training_rows
from evidentia.llm.line_dedup import dedup_lines
from evidentia.llm.minhash import near_duplicates
from evidentia.llm.packing import pack_documents

#: Bytes of texts that go to a worker at a time.
BATCH = "8m"
WORD = r"[0-9A-Za-z]|[^\x00-\x7F]"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; a null text or one without a letter goes."""
    names = tuple(own_name("lang", "score"))
    judged = predict(docs, fit(training_rows(docs)), names=names)
    return judged.where(F.col(names[0]) != UNDETERMINED).drop(*names)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring lines; one that has no word left after that goes.

    n_chars, if there, follows the text.
    """
    names = tuple(own_name("lines", "dropped"))
    kept = dedup_lines(docs, counts=names)
    kept = kept.where((F.col(names[1]) == 0) | F.col("text").rlike(WORD)).drop(*names)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs less the rows that have the doc_id and text_key of one in gone."""
    key, doc, text = own_name("key", "doc", "text")
    gone = gone.select(F.col("doc_id").alias(doc), F.col("text_key").alias(text)).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & F.col(key).eqNullSafe(F.col(text))
    return docs.withColumn(key, F.xxhash64("text")).join(gone, same, "left_anti").drop(key)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, that with the least doc_id."""
    return _without(docs, near_duplicates(docs, keyed=True).where(~F.col("kept")))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of ten words with a benchmark item."""
    found = contamination(docs, table(spark, sf_dir, "benchmark"), keyed=True).where("contaminated")
    return _without(docs, written(found.select("doc_id", "text_key"), "contaminated", BATCH))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4,096 tokens."""
    return pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL expresses none of these stages; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
