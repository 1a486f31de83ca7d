"""The corpus pipeline: STAGES applied one after another, each written and read again.

Each stage takes (spark, docs, sf_dir) and returns the columns of documents, the last one the packed pieces. Stages judge what their
predecessor kept. A text that a stage changes keeps its row, and n_chars follows the text.

Defined cases, for every stage: columns beyond doc_id, text and lang may be absent, null or of any name, and are carried as they are; an
empty table gives an empty one; texts of any length are taken whole; rows that repeat a doc_id are rows of their own, and a null doc_id stays
null. What a stage does with them is said there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.llm import common, langid, line_dedup, minhash, packing, secrets

#: Chance gives 1 / k among k languages; a text whose best language is no further than this part of the way from there to certainty
#: is rejected.
MARGIN = 0.1


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts that are null or have no letter, and those whose language can't be told. Repeated rows fare alike; without any
    labelled row no language can be told, and all go."""
    model = langid.trained(docs.select("doc_id", "text", "lang"))
    chance = 1 / len(model.labels) if model else 1.0
    rows = docs.select(F.struct(*[F.col(common.quoted(x)) for x in docs.columns]).alias("row"), "text")
    judged = langid.with_language(rows, model)
    return judged.filter((F.col("lang_pred") != "und") & (F.col("score") >= chance + MARGIN * (1 - chance))).select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that repeat in many documents; all documents stay, those of null doc_id unchanged, and a null text becomes empty."""
    return _counted(line_dedup.drop_repeated_lines(docs).select(*[F.col(common.quoted(x)) for x in docs.columns]))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the smallest doc_id with all its rows; texts without words and rows of null
    doc_id stay."""
    gone = minhash.near_duplicates(docs).filter("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(common.quoted(x)) for x in docs.columns])


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; all documents stay, a null text stays null."""
    return _counted(secrets.redacted(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences; a null text is one piece, the end id alone."""
    return packing.pack(docs)


STAGES = [("language_id", language), ("line_dedup", lines), ("minhash_near_dedup", near_duplicates), ("secret_scan", redact), ("packing", pack)]
#: Language ID is a trained network and packing needs a tokenizer, which SQL can't express; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, common.cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
        common.drop(before)  # what the stage read; the input itself isn't a written table
    return STAGES[-1][1](spark, docs, sf_dir)
