"""Checklist reviews: findings drafted from answers, kept by thread until decisions come, then a report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docquarry.functions import quantities as Q
from docquarry.operators import answers as A


def draft(items: DataFrame, answer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """item_id, element, measured, question, requirement, citations, grounding_status, flagged_numbers, refusal_reason, outcome,
    outcome_reason, limits of items (id, element, measured (value, unit), question).

    answer(questions: query_id, question) gives rows of answer_from(); a refused one leaves the requirement open.
    """
    asked = answer(items.select(F.col("id").alias("query_id"), "question")).drop("question")
    both = items.join(asked.withColumnRenamed("query_id", "id"), "id", "left")
    requirement = F.when(~F.col("refused"), F.col("text"))
    rows = both.withColumn("requirement", requirement)
    rows = rows.withColumn("o", Q.outcome(F.col("requirement"), F.col("grounding_status"), F.col("measured.value"), F.col("measured.unit"), F.col("refusal_reason")))
    carried = [c for c in ("expected_outcome", "expected_section") if c in items.columns]
    return rows.select(
        F.col("id").alias("item_id"), "element", "measured", "question", "requirement", F.transform("citations", lambda c: c["citation"]).alias("citations"), "grounding_status",
        F.transform("flagged", lambda f: f["raw"]).alias("flagged_numbers"), "refusal_reason", F.col("o.status").alias("outcome"), F.col("o.reason").alias("outcome_reason"),
        F.struct(F.col("o.minimum").alias("minimum"), F.col("o.maximum").alias("maximum")).alias("limits"), *carried)


def _path(folder: str, thread: str, table: str) -> str:
    return f"{folder}/thread={thread}/{table}"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def start(items: DataFrame, answer: Callable[[DataFrame], DataFrame], folder: str, thread: str) -> DataFrame:
    """Draft a thread's findings and keep them; the review waits until resume(). A thread that waits isn't drafted anew."""
    spark, path = items.sparkSession, _path(folder, thread, "findings")
    if not _exists(spark, path):
        draft(items, answer).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def pending(spark: SparkSession, folder: str, thread: str) -> DataFrame | None:
    """The findings that wait for decisions, or None: nothing was drafted, or the report is written."""
    path = _path(folder, thread, "findings")
    return spark.read.parquet(path) if _exists(spark, path) and not _exists(spark, _path(folder, thread, "report")) else None


def resume(spark: SparkSession, folder: str, thread: str, decisions: DataFrame, checklist_id: str, title: str, reviewed_at: Column | None = None) -> DataFrame:
    """Apply the decisions to a waiting thread and write its report; returns json and markdown, one row."""
    waiting = pending(spark, folder, thread)
    if waiting is None:
        raise ValueError(f"no findings wait in thread {thread!r}")
    out = report(A.apply_decisions(waiting, decisions), checklist_id, title, reviewed_at)
    out.write.mode("overwrite").parquet(_path(folder, thread, "report"))
    return spark.read.parquet(_path(folder, thread, "report"))


def report(reviewed: DataFrame, checklist_id: str, title: str, reviewed_at: Column | None = None) -> DataFrame:
    """One row: reviewed findings as JSON and as Markdown (a checklist has a handful of items)."""
    now = reviewed_at if reviewed_at is not None else F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    or_dash = lambda c: F.when(c == "", "–").otherwise(F.coalesce(c, F.lit("–")))
    limited = F.concat_ws(", ", F.concat(F.lit("minimum "), F.col("limits.minimum")), F.concat(F.lit("maximum "), F.col("limits.maximum")))
    final = F.concat(F.col("final_outcome"), F.when(F.col("review.changed"), " (edited)").otherwise(""))
    cells = ["element", Q.shown_measure(F.col("measured.value"), F.col("measured.unit")), or_dash(limited), or_dash(F.array_join("citations", "<br>")), "outcome", F.concat(F.lit("**"), final, F.lit("**")), or_dash(F.col("review.note"))]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    flagged = F.when(F.size("flagged_numbers") > 0, F.concat(F.lit(", flagged: ['"), F.array_join("flagged_numbers", "', '"), F.lit("']"))).otherwise("")
    quoted = F.replace(F.coalesce("requirement", F.concat(F.lit("(no grounded requirement: "), F.coalesce("refusal_reason", F.lit("None")), F.lit(")"))), F.lit("\n"), F.lit("\n> "))
    detail = F.concat(
        F.lit("### "), F.col("element"), F.lit("\n\n- question: "), F.col("question"), F.lit("\n- drafted outcome: "), F.col("outcome"), F.lit(" ("), F.col("outcome_reason"), F.lit(")\n- number grounding: "),
        F.coalesce("grounding_status", F.lit("n/a")), flagged, F.lit("\n\n> "), quoted, F.lit("\n"))
    rows = reviewed.withColumn("_now", now).select("item_id", "_now", F.struct(*reviewed.columns).alias("r"), line.alias("line"), detail.alias("detail"))
    held = rows.agg(F.array_sort(F.collect_list(F.struct("item_id", "line", "detail", "r"))).alias("x"), F.max("_now").alias("now"))
    head = F.concat(
        F.lit(f"# Findings: {title}\n\nChecklist `{checklist_id}`, reviewed "), F.col("now"),
        F.lit(". Outcomes: drafted by code from the grounded requirement, then approved or edited by the inspector.\n\n| item | measured | requirement limits | citation | drafted | final | reviewer note |\n|---|---|---|---|---|---|---|\n"))
    markdown = F.concat(head, F.array_join(F.transform("x", lambda v: v["line"]), "\n"), F.lit("\n\n## Requirements as found\n\n"), F.array_join(F.transform("x", lambda v: v["detail"]), "\n"))
    as_json = F.to_json(F.struct(F.lit(checklist_id).alias("checklist_id"), F.lit(title).alias("title"), F.col("now").alias("reviewed_at"), F.transform("x", lambda v: v["r"]).alias("findings")))
    return held.select(as_json.alias("json"), markdown.alias("markdown"))


def ratios(drafted: DataFrame) -> DataFrame:
    """One row of drafted findings with expected_outcome and expected_section: items, as_expected, wrong, needs_review, cites_expected."""
    cited = F.exists("citations", lambda c: F.regexp_extract(c, r"§([^\]]*)\]?$", 1) == F.col("expected_section"))
    right = F.col("outcome") == F.col("expected_outcome")
    return drafted.agg(
        F.count(F.lit(1)).alias("items"), F.count_if(right).alias("as_expected"), F.count_if(~right & (F.col("outcome") != "needs_review")).alias("wrong"),
        F.count_if(F.col("outcome") == "needs_review").alias("needs_review"), F.count_if(cited).alias("cites_expected"))
