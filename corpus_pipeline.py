"""From raw documents to packed training sequences, in five stages.

Each stage takes all that its predecessor kept and decides on it:
language identification (documents that look like no language of the corpus go), line
deduplication (recurring lines go), SimHash near-deduplication (one document of each
group stays), benchmark decontamination (covered documents go), packing.
Rows with a null id are never removed by the stages that decide by id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import decontam, langid, line_templates, packing, simhash
from marlstone.llm.common import swept, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without anything to learn from, all documents stay."""
    model = langid.fit_on_folds(docs, folds=4, held_out=2, calibration=3)
    if model is None:
        return docs
    return langid.identified(docs, model)


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    columns = [F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return line_templates.drop_recurring_lines(docs, min_docs=5, counts=False).select(*columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = simhash.near_copies(docs, distance=8, confirm=12)
    copies = groups.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontam.contaminated(docs, table(spark, sf_dir, "benchmark"), min_match=5, coverage=0.8)
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, capacity=4096, tokenizer="word_bpe_49k.json", end_id=1)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("language", identify_language),
    ("lines", drop_recurring_lines),
    ("near_duplicates", drop_near_duplicates),
    ("benchmark", decontaminate),
    ("packing", pack),
]

#: Language models, tiling and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with swept(spark) as keep:
            docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
