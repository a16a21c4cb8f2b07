"""A corpus from raw documents to token ids, in five stages; each is written as Parquet and read again by the next.

Toxic documents go; recurring lines go from the documents that repeat them; one document of each group of near
duplicates stays; documents that hold benchmark passages go; the rest is encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cellwatch.llm.bpe import encode_documents
from cellwatch.llm.line_templates import drop_recurring_lines
from cellwatch.llm.near_dedup import drop_near_duplicates
from cellwatch.llm.queries import PATTERN, RANKS
from cellwatch.llm.scratch import Scratch
from cellwatch.llm.toxicity import score, train_on
from cellwatch.llm.winnow import drop_contaminated

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier marks. Null and empty texts, repeated rows and rows without an id are scored like others."""
    return score(docs, train_on(docs, _table(spark, sf_dir, "labels"))).where("predicted = 0").select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document of which no word is left repeats others altogether, and goes as well."""
    out = drop_recurring_lines(docs)
    return out.where("n_dropped = 0 OR trim(text) <> ''").withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the least id. Texts without words and rows without an id stay."""
    return drop_near_duplicates(docs, similar_pct=80).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark passage. Texts without words hold none."""
    return drop_contaminated(docs, _table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, one row for each row; null and empty texts have none."""
    return encode_documents(docs, RANKS, PATTERN)


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("near_dedup", dedup_near), ("decontamination", decontaminate), ("bpe", encode)]

#: The toxicity model, set similarity and merges are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    name, stage = STAGES[-1]
    return scratch.save(stage(spark, docs, sf_dir), name)
