"""A corpus pipeline: quality, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet in the shared
folder and reads it again as the next stage's ``docs``. All but the last return the columns of ``documents``.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm import decontaminate as leaks
from quadrille.llm import lines, near_dup, packing
from quadrille.llm import quality as good
from quadrille.llm.storage import bounded, drop_stored, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of at least 0.3; the classifier is fitted on the labelled documents.

    Null and empty texts have the score of the model's bias alone; repeated rows are judged alike; without usable labels
    all score 0.5 and stay; extra columns, whatever their names, go. An empty table gives an empty one, as in all stages.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = good.with_quality(docs.select(*COLUMNS), good.fit(docs, labels), out="__score")
    return scored.where("__score >= 0.3").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that are on eight sites or more, copies of a text counted once; n_chars is that of what is left.

    All rows stay: null texts null, texts whose lines all go empty. Lines on exactly eight sites go.
    """
    found = lines.dedup_lines(docs.select(*COLUMNS), once=True, out="__lines")
    return found.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8), the one with the least doc_id; one row for a doc_id.

    Null, empty and blank texts link with nothing and stay, and so do all rows with a null doc_id. Of rows that share a
    doc_id the one that sorts first by text, lang, source and n_chars stays, whatever order they come in.
    """
    found = near_dup.near_duplicates(docs)
    away = stored(found.where(~F.col("kept")).select(F.col("doc_id").alias("__away")).distinct(), "away")
    kept = docs.select(*COLUMNS).join(bounded(away), F.col("doc_id") == F.col("__away"), "left_anti")
    repeated = stored(kept.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return kept
    once = kept.join(bounded(repeated), "doc_id", "left_anti").select(*COLUMNS)
    first = F.min(F.struct("text", "lang", "source", "n_chars")).alias("row")
    return once.unionByName(kept.join(bounded(repeated), "doc_id", "left_semi").groupBy("doc_id").agg(first).select("doc_id", "row.*"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of ten words of a benchmark item. Null and empty texts have none and stay; repeated rows stay or go together."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = leaks.decontaminate(docs.select(*COLUMNS), benchmark, out="__leaks")
    return found.where("__leaks.n_hit = 0").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in bins of 2048 words. Null and empty texts have one row without a bin; repeated rows are packed one by one."""
    return packing.pack(packing.measured(docs, ["doc_id", "source"]))


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pack", pack)]

#: Scores and packing aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        if before is not None:
            drop_stored(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
