"""The corpus pipeline: toxicity, near-duplicates, repeated passages, benchmark text, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; the result is written as
Parquet and read again as the next stage's ``docs``. All but the last return the columns of
``documents``. Nulls, empty and repeated rows are treated as the operators' docstrings say; a
row that no stage has reason to remove or change passes unchanged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm import decontaminate, packing, simhash, substring, toxicity
from panelwright.llm.common import fresh, read, shared_dir, unused


def keeping_columns(docs: DataFrame, outputs: list[str], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work(docs)`` with the columns of ``docs``: those named as an operator's ``outputs`` stand aside meanwhile, values and all."""
    clash = [c for c in docs.columns if c.lower() in outputs]
    aside = dict(zip(clash, unused(docs, *[f"own_{c}" for c in clash]), strict=True))
    out = work(docs.withColumnsRenamed(aside))
    return out.select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under one half. The machine learns from ``labels`` outside its held-out fold."""
    machine = toxicity.train(docs, read(spark, sf_dir, "labels"))
    return keeping_columns(docs, ["score"], lambda own: toxicity.score_toxicity(own, machine).where("score < 0.5"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates, the document with the smallest id."""
    return simhash.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of recurring 35-word windows; a document that loses none keeps its text as it is.

    A null text stays null. ``n_chars`` follows the text where that changes.
    """
    def work(own: DataFrame) -> DataFrame:
        out = substring.remove_repeats(own)
        changed = F.col("n_removed") > 0
        out = out.withColumn("text", F.when(changed, F.col("kept_text")).otherwise(F.col("text")))
        if "n_chars" in docs.columns:
            out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
        return out

    return keeping_columns(docs, ["n_words", "n_removed", "kept_text"], work)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated: benchmark windows cover none of their words, or fewer than a twentieth."""
    def work(own: DataFrame) -> DataFrame:
        found = decontaminate.find_contamination(own, read(spark, sf_dir, "benchmark"))
        return decontaminate.judged(found).where(~F.col("contaminated"))

    return keeping_columns(docs, ["n_words", "hit_spans", "hit_items", "n_hit", "contaminated"], work)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences of 2048 tokens."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: SQL can express neither the models nor the tokenizer; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``, each written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark).rstrip('/')}/{fresh('pipeline')}"
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
