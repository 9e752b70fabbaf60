"""Training-corpus pipeline: quality, lines, near copies, contamination, mix.

Each stage is one operator of ``basketlab.llm`` with production parameters; it takes
(spark, docs, sf_dir), works on every row its predecessor kept, and returns a DataFrame.
All but the last return the columns of ``documents`` (extra columns pass through); the
last adds ``repeats``, how often the mix takes a document, and drops those it doesn't take. ``run`` writes each stage's
rows to the shared folder and reads them again for the next one.
"""
from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlab.llm import op1_decontaminate as decontamination
from basketlab.llm import op2_quality as quality
from basketlab.llm import op3_line_dedup as lines
from basketlab.llm import op4_mixing as mixing
from basketlab.llm import op8_jaccard as jaccard
from basketlab.llm.common import fresh_name, read_columns, staged
from basketlab.session import apply_job_conf

def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier rejects (score under 0.3) go."""
    model = quality.fit(docs, read_columns(spark, sf_dir, "labels", "doc_id", "quality"))
    name = fresh_name(docs, "score")
    scored = quality.score(docs, model, out=name)
    return scored.where(F.col(name) >= 0.3).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go; every document stays."""
    out = lines.line_dedup(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(
            F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: the one with the smallest id."""
    found = jaccard.jaccard_components(docs).where("id != component_id")
    gone = staged(found.select(F.col("id").alias("doc_id")).distinct(), "near-copies")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark passages in a twentieth of their words or more go."""
    items = read_columns(spark, sf_dir, "benchmark", "item_id", "text")
    return decontamination.decontaminate(docs, items).where(
        ~decontamination.contaminated(F.col("n_hit"), F.col("n_words"))).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents taken at least once, with how often."""
    docs = docs.drop("repeats")
    # a row is known by its place in the stage's input, so rows that agree keep their own count
    try:
        placed = docs.select("*", F.col("_metadata.file_path").alias("mix_file"),
                             F.col("_metadata.row_index").alias("mix_row"))
    except AnalysisException:  # not read from files
        placed = staged(docs.select("*", F.lit("").alias("mix_file"),
                                    F.monotonically_increasing_id().alias("mix_row")), "mix-input")
    picked, _ = mixing.by_source(placed, carry=("mix_file", "mix_row"))
    taken = picked.where("repeats > 0").select("mix_file", "mix_row", "repeats")
    return placed.join(taken, ["mix_file", "mix_row"]).select(*docs.columns, "repeats")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("near_copies", near_copies),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mix_sources", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    apply_job_conf(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


# A learned model and similarity joins: tested against brute force instead.
ORACLE_SQL = None
