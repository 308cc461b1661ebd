"""The answer chain: contexts to prompts, replies to checked and cited answers, or refusals. All queries of a batch at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from docquarry.functions import text as X
from docquarry.operators import answers as A, models
from docquarry.session import stash

CITATION = "array<struct<label:string,source:string,page_start:int,page_end:int,section_id:string,section_title:string,citation:string>>"
FLAGGED = "array<struct<raw:string,key:string,sentence:string,cited:array<string>,found_in:array<string>>>"


def cite(contexts: DataFrame) -> DataFrame:
    """Contexts of retrieve() with citation and section_title, as sources need them."""
    out = contexts
    if "section_title" not in out.columns and "title" in out.columns:
        out = out.withColumn("section_title", F.col("title"))
    if "citation" not in out.columns and {"source", "page_start", "page_end", "section_id"} <= set(out.columns):
        out = out.withColumn("citation", X.format_citation(F.col("source"), F.col("page_start"), F.col("page_end"), F.col("section_id")))
    return out


def answer_from(questions: DataFrame, contexts: DataFrame, llm: Callable[[DataFrame], DataFrame], total: int = A.PROMPT_CHARS) -> DataFrame:
    """query_id, question, text, refused, refusal_reason, citations, invalid_labels, grounding_status, flagged, raw_text, sources,
    llm_calls, input_tokens, output_tokens, shadow_cost, latency_ms of questions (query_id, question).

    Refused are, in this order: questions without sources (the model isn't asked), replies that say so, replies without a valid
    label, replies with a number that no source has.
    """
    src = A.sources(cite(contexts), total).where(F.size("sources") > 0)
    asked = questions.select("query_id", "question").join(src, "query_id")
    prompts = asked.select("query_id", F.lit(A.SYSTEM_PROMPT).alias("system"), A.user_prompt(F.col("question"), F.col("sources")).alias("user"))
    replies = stash(llm(prompts).select("query_id", *models.REPLY), "replies")  # each prompt goes out once
    rows = questions.select("query_id", "question").join(src, "query_id", "left").join(replies, "query_id", "left")
    none = F.array().cast("array<string>")
    held = F.coalesce(F.transform("sources", lambda s: s["label"]), none)
    said = X.cited_labels(F.coalesce("reply", F.lit("")))
    rows = rows.withColumn("valid", F.array_intersect(said, held)).withColumn("invalid", F.array_except(said, held))
    early = (
        F.when(F.col("sources").isNull(), "no_relevant_sources").when(F.col("reply").contains(A.NOT_IN_SOURCES), "model_not_in_sources")
        .when(F.size("valid") == 0, "no_valid_citation"))
    rows = rows.withColumn("early", early)
    rows = rows.withColumn("a", F.when(F.col("early").isNull(), A.assess(F.col("reply"), F.transform("sources", lambda s: F.struct(s["label"].alias("label"), s["text"].alias("text"))))))
    reason = F.coalesce("early", F.when(F.col("a.status") == "refused", "ungrounded_number"))
    of = lambda label: F.filter("sources", lambda s: s["label"] == label)[0]
    citation = F.transform("valid", lambda v: X.let(of(v), lambda s: F.struct(*(s[c].alias(c) for c in ("label", "source", "page_start", "page_end", "section_id", "section_title", "citation")))))
    called = F.col("sources").isNotNull()
    asked_nothing = F.coalesce(F.col("early") == "no_relevant_sources", F.lit(False)) | F.coalesce(F.col("early") == "model_not_in_sources", F.lit(False))
    return rows.select(
        "query_id", "question", F.when(reason.isNull(), X.strip(F.col("reply"))).otherwise(A.REFUSAL_TEXT).alias("text"), reason.isNotNull().alias("refused"), reason.alias("refusal_reason"),
        F.when(F.col("early").isNull(), citation.cast(CITATION)).otherwise(F.array().cast(CITATION)).alias("citations"), F.when(asked_nothing, none).otherwise(F.col("invalid")).alias("invalid_labels"),
        F.col("a.status").alias("grounding_status"), F.coalesce(F.col("a.flagged").cast(FLAGGED), F.array().cast(FLAGGED)).alias("flagged"), F.col("reply").alias("raw_text"), "sources",
        called.cast("int").alias("llm_calls"), F.coalesce("input_tokens", F.lit(0)).cast("long").alias("input_tokens"), F.coalesce("output_tokens", F.lit(0)).cast("long").alias("output_tokens"),
        F.when(called, models.shadow_cost(F.col("input_tokens"), F.col("output_tokens"))).otherwise(F.create_map().cast("map<string,double>")).alias("shadow_cost"), F.coalesce("latency_ms", F.lit(0.0)).alias("latency_ms"))


def answer(questions: DataFrame, retrieve: Callable[[DataFrame], DataFrame], llm: Callable[[DataFrame], DataFrame] = models.extractive, total: int = A.PROMPT_CHARS) -> DataFrame:
    """answer_from() with the contexts that retrieve(queries: query_id, text) gives."""
    found = retrieve(questions.select("query_id", F.col("question").alias("text")))
    return answer_from(questions, stash(found, "contexts"), llm, total)
