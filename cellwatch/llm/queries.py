"""Queries over the driver's tables, one for each operator, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cellwatch.llm.bpe import round_trip
from cellwatch.llm.collocations import PHRASES_SQL, collocations
from cellwatch.llm.line_templates import LINES_SQL, line_report
from cellwatch.llm.near_dedup import near_duplicates
from cellwatch.llm.oracles import COSINE_SQL, NEAR_SQL, WARC_SQL, WINDOWS_SQL
from cellwatch.llm.ordinal_quality import quality
from cellwatch.llm.packing import packed_pieces
from cellwatch.llm.periodic_runs import RUNS_SQL, run_report
from cellwatch.llm.pii import personal_data_report
from cellwatch.llm.snapshots import RENDER_SQL, render_conversations
from cellwatch.llm.tiled_cosine import near_vectors
from cellwatch.llm.toxicity import toxicity
from cellwatch.llm.warc import archived_pages
from cellwatch.llm.winnow import contamination

#: The rank file and pattern that op4 and the pipeline use.
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
#: The tokenizer file of op12.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data_report(_table(spark, sf_dir, "documents"))


def op2_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render_conversations(_table(spark, sf_dir, "conversations"))


def op3_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived_pages(_table(spark, sf_dir, "pages"))


def op4_rank_queue_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_table(spark, sf_dir, "documents"), RANKS, PATTERN)


def op5_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_chosen_path_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), similar_pct=85)


def op8_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(_table(spark, sf_dir, "documents"))


def op10_tiled_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.98)


def op11_tiled_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


def op12_configuration_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_pieces(_table(spark, sf_dir, "documents"), TOKENIZER, PATTERN, capacity=2048)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_report(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # it imports this module

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bootstrapped_pii": op1_bootstrapped_pii,
    "op2_snapshot_collapse": op2_snapshot_collapse,
    "op3_warc_salvage": op3_warc_salvage,
    "op4_rank_queue_bpe": op4_rank_queue_bpe,
    "op5_ordinal_quality": op5_ordinal_quality,
    "op6_compression_toxicity": op6_compression_toxicity,
    "op7_chosen_path_dedup": op7_chosen_path_dedup,
    "op8_winnowing_decontamination": op8_winnowing_decontamination,
    "op9_line_templates": op9_line_templates,
    "op10_tiled_cosine": op10_tiled_cosine,
    "op11_tiled_collocations": op11_tiled_collocations,
    "op12_configuration_packing": op12_configuration_packing,
    "op13_periodic_runs": op13_periodic_runs,
    "pipeline": pipeline,
}

ORACLES: dict[str, str] = {
    "op2_snapshot_collapse": RENDER_SQL,
    "op3_warc_salvage": WARC_SQL,
    "op7_chosen_path_dedup": NEAR_SQL,
    "op8_winnowing_decontamination": WINDOWS_SQL,
    "op9_line_templates": LINES_SQL,
    "op10_tiled_cosine": COSINE_SQL,
    "op11_tiled_collocations": PHRASES_SQL,
    "op13_periodic_runs": RUNS_SQL,
}
