"""A training corpus in stages: each stage's rows are written as Parquet and are the next one's documents.

language: documents go whose text has no letter, or whose language the model gives less than ``SURE``.
near_duplicates: of each group of near copies the smallest doc_id stays.
repeated_strings: 200-byte strings that also start elsewhere are cut out of all texts; a text with nothing left goes.
benchmark: documents that hold a benchmark item within its edit budget go.
mix: all documents get their place in a mixture of the sources; order by (mix_slot, mix_place) to read it.

Rows that repeat a doc_id stay or go together; a null doc_id is a document without copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.llm.decontaminate import drop_contaminated
from statloom.llm.langid import UNKNOWN, fit_language_model, held_out, identify_language
from statloom.llm.minhash import near_duplicates
from statloom.llm.mixing import mix_sources
from statloom.llm.store import keep
from statloom.llm.substrings import cut_documents
from statloom.sources.tables import Tables

SURE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = fit_language_model(docs.filter(~held_out("doc_id", 4, 2)))
    names = docs.columns
    guessed = identify_language(docs, model)
    return guessed.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= SURE)).select(*names)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    stays = keep(near_duplicates(docs).filter("kept").select(F.col("doc_id").alias("stays")), "stays")
    return docs.join(stays, docs["doc_id"].eqNullSafe(stays["stays"]), "left_semi")


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = cut_documents(docs).withColumn("n_chars", F.length("text").cast("long"))
    return cut.filter(F.length(F.btrim(F.col("text"), F.lit(" \t\n\r"))) > 0)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, Tables(spark, sf_dir).benchmark)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_sources(docs)


STAGES = [("language", language), ("near_duplicates", near_copies), ("repeated_strings", repeated_strings),
          ("benchmark", benchmark), ("mix", mix)]

ORACLE_SQL = None  # models, signatures and edit distances are not for SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = Tables(spark, sf_dir).documents
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return keep(STAGES[-1][1](spark, docs, sf_dir), f"stage-{STAGES[-1][0]}")


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
