"""The corpus pipeline: language ID, exact and near deduplication, substring deduplication, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from docquarry.llm import exact_dedup, jaccard, langid, packing, recompress
from docquarry.llm.common import BROADCAST_ROWS, numbered
from docquarry.session import shared_dir, stash, stash_mark, sweep, table

#: Documents with letters are rejected below this score only; clean text scores far above it.
LEAST_SCORE = 0.2
#: Column of rows' numbers; a name that no input should have.
ROW = "__docquarry_row__"


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with a number of its own for each row, in the order of doc_id, null ones last."""
    return numbered(docs, ROW)[0]


def _by_row(keyed: DataFrame) -> DataFrame:
    """What operators read: number and text of each row."""
    return keyed.select(F.col(ROW).alias("doc_id"), "text")


def _without(keyed: DataFrame, dropped: DataFrame) -> DataFrame:
    """keyed without the rows whose numbers are dropped's doc_id; a broadcast only below BROADCAST_ROWS, else a shuffle join."""
    dropped = stash(dropped.select(F.col("doc_id").alias(ROW)), "dropped")
    few = dropped.count() <= BROADCAST_ROWS
    return keyed.join(F.broadcast(dropped) if few else dropped, ROW, "left_anti").drop(ROW)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters and those whose language is uncertain; fills in a null lang."""
    model = langid.learn(docs, F.lit(True))
    told = langid.label_rows(docs, model)
    ok = (F.col(langid.LABEL) != "und") & (F.col(langid.LABEL_SCORE) >= LEAST_SCORE)
    return told.where(ok).withColumn("lang", F.coalesce("lang", langid.LABEL)).select(*docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest doc_id of each group of equal texts stays; one of them where rows repeat a doc_id."""
    keyed = _keyed(docs)
    return _without(keyed, exact_dedup.dedup_table(_by_row(keyed)).where("not kept"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest doc_id of each class of near copies stays."""
    keyed = _keyed(docs)
    return _without(keyed, jaccard.jaccard_classes(_by_row(keyed)).where("doc_id != class_id"))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated windows go; rows that lose all their words go; others stay as they are."""
    text, gone = (f"__docquarry_{c}__" for c in ("text", "gone"))  # no input should have such columns
    keyed = _keyed(docs)
    told = recompress.dedup_words(_by_row(keyed), keep_text=True)
    kept = told.where("n_removed = 0 or n_removed < n_words").select(F.col("doc_id").alias(ROW), F.col("kept_text").alias(text), F.col("n_removed").alias(gone))
    joined = keyed.drop("text").join(kept, ROW).withColumn("text", F.col(text))
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.when(F.col(gone) > 0, F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return joined.select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' pieces in training sequences."""
    return packing.pack_table(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_copies),
    ("ngram_jaccard", near_copies),
    ("substring_dedup", substrings),
    ("best_fit_packing", packing_stage),
]

#: Packing is sequential within a group, which SQL can't express; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written as Parquet to the shared folder and read again, then what it had stashed goes."""
    folder = f"{shared_dir(spark)}/docquarry/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        mark = stash_mark(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        sweep(spark, mark)
        docs = spark.read.parquet(path)
    return docs
