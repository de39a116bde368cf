"""Corpus pipeline: quality classifier, line dedup, SimHash near-dedup, benchmark decontamination, mixing.

Each stage takes (spark, docs, sf_dir), works on all documents it is given, and returns documents (the last one adds their
rate); ``run`` writes each stage's result to the shared work folder and reads it again as the next one's documents.
There is no SQL for the result: the classifier, the token order and the fitted rates are not SQL; each stage is tested
against a plain version instead.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tauflow.llm import decontaminate, line_dedup, mixing, quality, simhash
from tauflow.llm.common import read, shared_folder


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents scored below the cut-off go. The model learns from the documents of ``sf_dir``."""
    model = quality.train(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return docs.where(quality.quality_score(spark, model)("text") >= quality.CUTOFF)


def drop_copied_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: copied lines go; a document goes as a whole only if no line with a token is left."""
    rows = line_dedup.remove_copied_lines(docs).where((F.col("n_removed") == 0) | (F.col("n_left") > 0))
    n_chars = F.when(F.col("n_removed") > 0, F.char_length("text").cast("bigint")).otherwise(F.col("_doc.n_chars"))
    changed = {"text": F.col("text"), "n_chars": n_chars}
    return rows.select(*[changed.get(c, F.col(f"_doc.`{c}`")).alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: one document of each group stays."""
    return simhash.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Decontamination: documents with a benchmark window go."""
    return decontaminate.clean_documents(docs, read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: every document gets its rate. The classifier learns from the documents of ``sf_dir``."""
    return mixing.mix_documents(docs, read(spark, sf_dir, "labels"), training=read(spark, sf_dir, "documents"))


STAGES = [
    ("quality", keep_good), ("line_dedup", drop_copied_lines), ("simhash", drop_near_copies),
    ("decontamination", drop_contaminated), ("mixing", mix),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
