"""Retrieve, grade each source, answer from the relevant ones; rewrite the query where none is, a bounded number of times.

A round is one plan for all queries that are still open; each table that a later step reads is written once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from docquarry.functions import text as X
from docquarry.operators import answers as A, models
from docquarry.plans.answer import CITATION, FLAGGED, answer_from, cite
from docquarry.session import stash

MAX_RETRIES = 2
# What the grader and the rewriter are told.
GRADE_SYSTEM = "You judge whether a source passage from an accessibility building code is relevant to a question. Reply with one word: yes or no."
REWRITE_SYSTEM = (
    "You rewrite questions about accessibility building codes into short search queries. Use the vocabulary of the 2010 ADA Standards, for example: "
    "clear width, clear floor space, operable parts, reach range, water closet, lavatory, running slope, turning space, accessible route. "
    "Reply with the search query only."
)
GRADES = "array<struct<query:string,section:string,verdict:string,parsed:boolean>>"
DIAGRAM = """graph TD
    retrieve --> grade_documents
    grade_documents -- some relevant --> generate
    grade_documents -- none, retries left --> rewrite_query
    grade_documents -- none --> refuse
    rewrite_query --> retrieve
"""


def grade(left: DataFrame, contexts: DataFrame, llm: Callable[[DataFrame], DataFrame], total: int) -> DataFrame:
    """A row for each source of open queries (query_id, question, query): rank, section, relevant, parsed and the call's usage.

    A source is graded on the text that the prompt would hold; a reply without yes or no counts as relevant.
    """
    shown = left.join(A.sources(contexts, total), "query_id").select("query_id", "question", "query", F.explode("sources").alias("s"))
    user = F.concat(
        F.lit("Question: "), F.col("question"), F.lit("\n\nSource "), F.coalesce("s.citation", F.lit("")), F.lit(" "), F.coalesce("s.breadcrumb", F.lit("")), F.lit("\n"), F.col("s.text"),
        F.lit("\n\nDoes this source contain information that helps answer the question? Reply with one word: yes or no."))
    section = F.concat(F.coalesce("s.section_id", F.lit("")), F.lit(" ["), F.coalesce("s.source", F.lit("")), F.lit("]"))
    asked = shown.select("query_id", "query", F.col("s.rank").alias("rank"), section.alias("section"), F.lit(GRADE_SYSTEM).alias("system"), user.alias("user"))
    return llm(asked).withColumn("g", X.parse_grade(F.col("reply"))).select("query_id", "query", "rank", "section", "g.relevant", "g.parsed", "input_tokens", "output_tokens", "latency_ms")


def rewrite(left: DataFrame, llm: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """left (query_id, question, queries) with a new query, and the calls' usage."""
    user = F.concat(F.lit("Question: "), F.col("question"), F.lit("\nQueries already tried without finding a relevant source: "), F.array_join("queries", "; "), F.lit("\nSearch query:"))
    asked = left.select("query_id", "question", "queries", F.lit(REWRITE_SYSTEM).alias("system"), user.alias("user"))
    return llm(asked).select("query_id", "question", "queries", X.parse_rewrite(F.col("reply"), F.col("question")).alias("query"), "input_tokens", "output_tokens", "latency_ms")


def _usage(rows: DataFrame, stage: str) -> DataFrame:
    return rows.select("query_id", F.lit(stage).alias("stage"), F.lit(1).alias("calls"), "input_tokens", "output_tokens", models.shadow_cost(F.col("input_tokens"), F.col("output_tokens")).alias("cost"), F.col("latency_ms").alias("ms"))


def stage_times(rows: DataFrame, by: list[str]) -> DataFrame:
    """Milliseconds of each stage summed over its runs, to one decimal: rows of by, stage, ms."""
    return rows.groupBy(*by, "stage").agg(F.round(F.sum("ms"), 1).alias("ms"))


def add_costs(rows: DataFrame, by: list[str]) -> DataFrame:
    """MAP<model, dollars> summed over rows with a map `cost`."""
    each = rows.select(*by, F.explode("cost").alias("model", "usd")).groupBy(*by, "model").agg(F.sum("usd").alias("usd"))
    return each.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", "usd")))).alias("cost"))


def agent(questions: DataFrame, retrieve: Callable[[DataFrame], DataFrame], llm: Callable[[DataFrame], DataFrame], with_rewrite: bool = True, most: int = MAX_RETRIES, total: int = A.PROMPT_CHARS) -> DataFrame:
    """answer_from()'s columns, and queries, grades, retries, timings, with calls, tokens and costs of all model calls.

    questions: query_id, question. retrieve(query_id, text) gives contexts.
    """
    left = questions.select("query_id", "question", F.col("question").alias("query"), F.array("question").alias("queries"))
    usage, grades, kept, refused, tries = [], [], [], None, []
    for turn in range(most + 1):
        found = stash(cite(retrieve(left.select("query_id", F.col("query").alias("text")))), "contexts")
        graded = stash(grade(left, found, llm, total), "grades")
        usage.append(_usage(graded, "grading"))
        grades.append(graded.withColumn("turn", F.lit(turn)))
        good = stash(found.join(graded.where("relevant").select("query_id", "rank"), ["query_id", "rank"], "left_semi"), "relevant")
        kept.append(good)
        done = good.select("query_id").distinct()
        tries.append(left.join(done, "query_id", "left_semi").select("query_id", "queries"))
        left = stash(left.join(done, "query_id", "left_anti"), "left")
        if turn == most or not with_rewrite or left.isEmpty():
            refused = left.join(found.select("query_id").distinct().withColumn("had", F.lit(True)), "query_id", "left")
            tries.append(left.select("query_id", "queries"))
            break
        told = stash(rewrite(left, llm), "rewrites")
        usage.append(_usage(told, "rewrite"))
        left = told.select("query_id", "question", "query", F.array_append("queries", F.col("query")).alias("queries"))
    union = lambda parts: parts[0] if len(parts) == 1 else union([parts[0].unionByName(parts[1], allowMissingColumns=True), *parts[2:]])
    relevant = union(kept)
    answered = stash(answer_from(questions.join(relevant.select("query_id").distinct(), "query_id", "left_semi"), relevant, llm, total), "answers")
    none = lambda kind: F.lit(None).cast(kind)
    refusals = refused.select(
        "query_id", "question", F.lit(A.REFUSAL_TEXT).alias("text"), F.lit(True).alias("refused"), F.when(F.col("had"), "graded_not_relevant").otherwise("no_relevant_sources").alias("refusal_reason"),
        F.array().cast(CITATION).alias("citations"), F.array().cast("array<string>").alias("invalid_labels"), none("string").alias("grounding_status"), F.array().cast(FLAGGED).alias("flagged"),
        none("string").alias("raw_text"), none(answered.schema["sources"].dataType).alias("sources"), F.lit(0).alias("llm_calls"), F.lit(0).cast("long").alias("input_tokens"), F.lit(0).cast("long").alias("output_tokens"),
        F.create_map().cast("map<string,double>").alias("shadow_cost"), F.lit(0.0).alias("latency_ms"))
    own = ["llm_calls", "input_tokens", "output_tokens", "shadow_cost"]
    both = answered.unionByName(refusals)
    calls = union([*usage, both.select("query_id", F.lit("llm").alias("stage"), F.col("llm_calls").alias("calls"), "input_tokens", "output_tokens", F.col("shadow_cost").alias("cost"), F.col("latency_ms").alias("ms"))])
    calls = stash(calls, "usage")
    sums = calls.groupBy("query_id").agg(F.sum("calls").cast("int").alias("llm_calls"), F.sum(F.coalesce("input_tokens", F.lit(0))).alias("input_tokens"), F.sum(F.coalesce("output_tokens", F.lit(0))).alias("output_tokens"))
    costs = add_costs(calls, ["query_id"]).withColumnRenamed("cost", "shadow_cost")
    times = stage_times(calls, ["query_id"]).groupBy("query_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", "ms")))).alias("timings"))
    verdicts = union(grades).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("turn", "rank", "query", "section", F.when(F.col("relevant"), "yes").otherwise("no").alias("verdict"), "parsed"))).alias("g"))
    verdicts = verdicts.select("query_id", F.transform("g", lambda g: F.struct(g["query"].alias("query"), g["section"].alias("section"), g["verdict"].alias("verdict"), g["parsed"].alias("parsed"))).cast(GRADES).alias("grades"))
    out = both.drop(*own).join(sums, "query_id").join(costs, "query_id", "left").join(times, "query_id").join(verdicts, "query_id", "left").join(union(tries), "query_id")
    return out.withColumn("shadow_cost", F.coalesce("shadow_cost", F.create_map().cast("map<string,double>"))).withColumn("grades", F.coalesce("grades", F.array().cast(GRADES))).withColumn("retries", F.size("queries") - 1)
