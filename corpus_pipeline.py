"""The text corpus pipeline: quality rules, line dedup, near-dedup, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and all that the one before it kept. The first four return the
columns of documents; the last one the encoded corpus.

In every stage an empty table gives an empty one, further columns of any name stay, texts may be of any
length, and rows that repeat a document are treated alike. Null and empty texts fail the quality rules;
the later stages take them as texts without lines, words or pieces. Ties go to the smallest doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eddyforge.llm import decontaminate, lines, near, pieces, quality
from eddyforge.llm.common import materialize
from eddyforge.llm.queries import tokenizer_path

#: Edits between near lines. The query's SQL fixes one for op1_line_dedup.
LINE_EDITS = 2


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or their language's perplexity band reject go."""
    return quality.keep_good(spark, docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later equal or near lines go; n_chars follows the text. Every document stays, if only empty."""
    out = lines.without_repeats(spark, docs, LINE_EDITS)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (SimHash candidates, 5-word Jaccard of 0.8 or more) the smallest doc_id stays."""
    return near.keep_one(spark, docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold any benchmark passage go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.keep_clean(spark, docs, benchmark)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, n_words, round_trip."""
    return pieces.encode(spark, docs, pieces.load(tokenizer_path()))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: The perplexity model, the fingerprints and the encoder are beyond SQL: tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each one's rows are written to the shared folder and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(spark, stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
