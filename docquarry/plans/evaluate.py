"""Runners and report tables: configurations over question sets, answers over setups, as tables and as Markdown."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, functions as F

from docquarry.functions import text as X
from docquarry.operators import evalx
from docquarry.plans.retrieve import Config, Stores, retrieve
from docquarry.session import stash


def run_config(questions: DataFrame, stores: Stores, config: Config, query_vectors: DataFrame | None = None) -> DataFrame:
    """query_id, type, in_corpus, answer_rank, n_found, found, latency_ms of questions (query_id, type, question, expected).

    All questions are one batch: latency is the batch's time, shared equally.
    """
    result = retrieve(questions.select("query_id", F.col("question").alias("text")), stores, config, query_vectors=query_vectors)
    n = questions.count()
    contexts = stash(result.contexts.select("query_id", "rank", "parent_id", "source", "section_id"), "found")
    ranks = evalx.answer_ranks(contexts, evalx.expected_items(questions), ["source", "section_id"])
    found = contexts.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_found"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "source", "section_id"))), lambda x: F.struct(x["source"].alias("source"), x["section_id"].alias("section_id"))).alias("found"))
    rows = questions.select("query_id", "type", (F.size("expected") > 0).alias("in_corpus")).join(ranks, "query_id", "left").join(found, "query_id", "left")
    return rows.withColumn("n_found", F.coalesce("n_found", F.lit(0))).withColumn("latency_ms", F.lit(sum(result.timings.values()) / max(n, 1)))


def run_grid(questions: DataFrame, stores: Stores, configs: dict[str, Config], query_vectors: DataFrame | None = None) -> DataFrame:
    """metrics() and percentiles of each configuration: run, uses_rerank, ..."""
    out = None
    for name, config in configs.items():
        rows = stash(run_config(questions, stores, config, query_vectors).withColumn("run", F.lit(name)), "run")
        got = evalx.metrics(rows, ["run"]).join(evalx.percentiles(rows, "latency_ms", ["run"]).drop("n"), "run").withColumn("uses_rerank", F.lit(config.rerank))
        out = got if out is None else out.unionByName(got)
    return out


def experiments(questions: DataFrame, stores: Stores, base: Config = Config(), query_vectors: DataFrame | None = None) -> tuple[Config, DataFrame]:
    """One change at a time, kept where it answers more (or, for leaving out sections, no fewer): the last configuration, and a row for each step."""
    steps: list[tuple[str, str, int, str]] = []
    count = lambda c: int(run_grid(questions, stores, {"x": c}, query_vectors).first()["correct"])
    best, n = base, count(base)
    steps.append(("baseline", describe(base), n, ""))
    deep = replace(best, rerank_depth=25)
    m = count(deep)
    steps.append(("depth 25", describe(deep), m, "kept" if m > n else "rejected"))
    best, n = (deep, m) if m > n else (best, n)
    plain = replace(best, section_vector=False)
    m = count(plain)
    steps.append(("no sections", describe(plain), m, "kept" if m >= n else "rejected"))
    best, n = (plain, m) if m >= n else (best, n)
    modes = {mode: count(replace(best, mode=mode)) for mode in evalx.MODES}
    chosen = next(mode for mode in evalx.MODES if modes[mode] >= max(modes.values()) - 1)
    steps += [(f"mode {mode}", describe(replace(best, mode=mode)), c, "chosen" if mode == chosen else "") for mode, c in modes.items()]
    best, n = replace(best, mode=chosen), modes[chosen]
    wordy = replace(best, glossary=True)
    m = count(wordy)
    steps.append(("glossary", describe(wordy), m, "kept" if m > n else "rejected"))
    best = wordy if m > n else best
    spark = questions.sparkSession
    return best, spark.createDataFrame([(i, *s) for i, s in enumerate(steps)], "step int, run string, configuration string, correct int, decision string")


def describe(config: Config) -> str:
    return f"depth {config.rerank_depth}, sections {'on' if config.section_vector else 'off'}, {config.mode}, glossary {'on' if config.glossary else 'off'}"


def run_setups(questions: DataFrame, setups: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """evaluate()'s rows of all setups, with setup; a setup answers questions (query_id, question)."""
    out = None
    for name, answer in setups.items():
        got = evalx.evaluate(stash(answer(questions.select("query_id", "question")), "answers"), questions).withColumn("setup", F.lit(name))
        out = got if out is None else out.unionByName(got, allowMissingColumns=True)
    return out


# --- Markdown. Tables of a report are small: a row for each configuration, or for each question of a set.


def markdown(rows: DataFrame, cells: dict[str, Column | str], order: list, empty: str | None = None) -> DataFrame:
    """One row, `markdown`: a table with the cells as columns, in order; `empty` where there are no rows."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("–")) for c in cells.values())), F.lit(" |"))
    ordered = rows.select(F.struct(*order).alias("o"), line.alias("line")).agg(F.array_sort(F.collect_list(F.struct("o", "line"))).alias("x"))
    head = "| " + " | ".join(cells) + " |\n|" + "---|" * len(cells)
    table = F.concat(F.lit(head), F.array_join(F.transform("x", lambda v: F.concat(F.lit("\n"), v["line"])), ""))
    return ordered.select((table if empty is None else F.when(F.size("x") == 0, empty).otherwise(table)).alias("markdown"))


def _share(name: str) -> Column:
    return F.concat(X.percent(F.col(name)), F.lit(" ("), F.col(f"{name}_n"), F.lit("/"), F.col(f"{name}_of"), F.lit(")"))


def main_table(runs: DataFrame) -> DataFrame:
    pct = lambda c: X.percent(F.col(c))
    cells = {"config": "run", "hit@1": pct("hit_1"), "hit@3": pct("hit_3"), "hit@5": pct("hit_5"), "MRR": F.format_number("mrr", 3), "refusal acc.": pct("refusal_accuracy"), "false refusals": pct("false_refusals"), "p50 ms": F.round("p50"), "p95 ms": F.round("p95")}
    return markdown(runs, cells, ["run"])


def by_type_table(by_type: DataFrame, metric: str, types: tuple[str, ...] = evalx.TYPES) -> DataFrame:
    """by_type: run, type and metrics; the last type's cell is its refusal accuracy."""
    wide = by_type.groupBy("run").agg(*(F.max(F.when(F.col("type") == t, F.col("refusal_accuracy" if t == types[-1] else metric))).alias(t) for t in types))
    return markdown(wide, {"config": "run"} | {t: X.percent(F.col(t)) for t in types}, ["run"])


def sweep_table(swept: DataFrame) -> DataFrame:
    pct = lambda c: X.percent(F.col(c))
    return markdown(swept, {"threshold": F.format_string("%+.0f", F.col("threshold").cast("double")), "refusal acc.": pct("refusal_accuracy"), "false refusals": pct("false_refusals"), "hit@1": pct("hit_1"), "hit@3": pct("hit_3"), "MRR": F.format_number("mrr", 3)}, ["threshold"])


def misses(results: DataFrame, questions: DataFrame, k: int = 3) -> DataFrame:
    """Questions whose expected sections aren't all in the first k, and those out of the corpus that found anything."""
    missed = F.when(F.col("in_corpus"), F.col("answer_rank").isNull() | (F.col("answer_rank") > k)).otherwise(F.col("n_found") > 0)
    return results.where(missed).join(questions.select("query_id", "question", "expected"), "query_id")


def _wanted(none: str) -> Column:
    told = F.array_join(F.transform("expected", lambda g: F.array_join(F.transform(g, lambda e: e["section_id"]), "/")), " + ")
    return F.when(told == "", none).otherwise(told)


def misses_table(results: DataFrame, questions: DataFrame, k: int = 3) -> DataFrame:
    shown = F.array_join(F.transform(F.slice("found", 1, k), lambda f: X.source_tag(f["section_id"], f["source"])), ", ")
    cells = {"id": "query_id", "type": "type", "question": "question", "expected": _wanted("(empty)"), "returned": F.when(F.coalesce(shown, F.lit("")) == "", "(empty)").otherwise(shown)}
    return markdown(misses(results, questions, k), cells, ["query_id"])


def failures(results: DataFrame) -> DataFrame:
    """evaluate()'s rows in which something went wrong, with `problems`."""
    problems = F.array_compact(F.array(
        F.when(F.col("in_corpus") & F.col("refused"), F.concat(F.lit("false refusal ("), F.col("refusal_reason"), F.lit(")"))),
        F.when(~F.col("in_corpus") & ~F.col("refused"), "answered out-of-corpus"), F.when(~F.col("contains_ok") & ~F.col("refused"), "wrong or missing number"),
        F.when(~F.col("citation_valid"), "cited section not in expected"), F.when(F.size("invalid_labels") > 0, F.concat(F.lit("invalid labels "), F.array_join("invalid_labels", ", ")))))
    return results.withColumn("problems", problems).where(F.size("problems") > 0)


def failures_table(results: DataFrame, questions: DataFrame) -> DataFrame:
    rows = failures(results).join(questions.select("query_id", "expected", "answer_contains"), "query_id")
    wanted = F.concat(_wanted("(refuse)"), F.when(F.size("answer_contains") > 0, F.concat(F.lit("; contains "), F.array_join("answer_contains", ", "))).otherwise(""))
    cells = {"id": "query_id", "failure": F.array_join("problems", "; "), "question": "question", "expected": wanted, "answer / model output": X.short(F.when(F.col("refused"), F.coalesce("raw_text", "text")).otherwise(F.col("text"))), "cited": F.nullif(F.array_join(F.transform("citations", lambda c: c["section_id"]), ", "), F.lit(""))}
    return markdown(rows, cells, ["query_id"])


def grounding_table(results: DataFrame) -> DataFrame:
    rows = results.where("grounding_status in ('needs_review', 'refused')")
    join = lambda labels, none: F.when(F.size(labels) == 0, none).otherwise(F.array_join(labels, "/"))
    flags = F.array_join(F.transform("flagged", lambda f: F.concat(f["raw"], F.lit(": "), join(f["cited"], "–"), F.lit(" → "), join(f["found_in"], "nowhere"))), "; ")
    correct = F.when(F.col("raw_contains_ok").isNull(), "n/a").when(F.col("raw_contains_ok"), "yes").otherwise("no")
    cells = {"id": "query_id", "status": "grounding_status", "flagged number: cited → found in": flags, "answer correct?": correct, "model output": X.short(F.coalesce("raw_text", "text"))}
    return markdown(rows, cells, ["query_id"], "Every answer was verified.")


def wrong_but_verified_table(results: DataFrame, questions: DataFrame) -> DataFrame:
    rows = results.where("grounding_status = 'verified' and not contains_ok").join(questions.select("query_id", "answer_contains"), "query_id")
    cells = {"id": "query_id", "expected numbers": F.array_join("answer_contains", ", "), "cited": F.array_join(F.transform("citations", lambda c: c["section_id"]), ", "), "answer": X.short(F.col("text"))}
    return markdown(rows, cells, ["query_id"], "None.")


def comparison_table(summary: DataFrame) -> DataFrame:
    """summary: answer_metrics() by setup."""
    cells = {
        "setup": "setup", "wrong but verified": F.concat(F.lit("**"), F.col("wrong_but_verified"), F.lit("**")), "correct among verified": _share("correct_verified"), "needs_review": _share("needs_review"), "correct overall": _share("correct"),
        "citation valid": _share("citation_valid"), "refusal acc.": _share("refusal_accuracy"), "false refusals": _share("false_refusals"),
        "LLM calls / q (mean, max)": F.concat(F.format_number("calls_mean", 1), F.lit(", "), F.col("calls_max")), "p50 ms": F.round("p50_ms"), "p95 ms": F.round("p95_ms")}
    return markdown(summary, cells, ["setup"])


def outcome_diff_table(diff: DataFrame, setups: list[str]) -> DataFrame:
    return markdown(diff, {"id": "query_id"} | {s: F.try_element_at("outcomes", F.lit(s)) for s in setups}, ["query_id"], "Same outcome in every setup.")


def graph_decisions_table(results: DataFrame) -> DataFrame:
    """Questions in which the grader rejected a source or didn't say, or the query was rewritten; results: labelled()."""
    rows = results.where((F.col("retries") > 0) | F.exists("grades", lambda g: (g["verdict"] == "no") | ~g["parsed"]))
    queries = F.array_join(F.transform("queries", lambda q: F.concat(F.lit("`"), q, F.lit("`"))), " → ")
    grades = F.array_join(F.transform("grades", lambda g: F.concat(g["section"], F.lit(": "), g["verdict"], F.when(g["parsed"], "").otherwise("?"))), "; ")
    return markdown(rows, {"id": "query_id", "queries tried": queries, "grades (section: verdict, ? = unparsed → yes)": grades, "outcome": "outcome"}, ["query_id"], "Every source was graded relevant; no rewrite.")


def cost_table(costs: DataFrame, summary: DataFrame, models: list[str]) -> DataFrame:
    """costs: cost_per_1000() by setup; summary: answer_metrics() by setup."""
    wide = summary.select("setup", "tokens_in", "tokens_out").join(costs.groupBy("setup").agg(*(F.max(F.when(F.col("model") == m, F.col("usd"))).alias(m) for m in models)), "setup", "left")
    money = {m: F.concat(F.lit("$"), F.format_string("%.2f", F.coalesce(F.col(m), F.lit(0.0)))) for m in models}
    return markdown(wide, {"setup": "setup"} | money | {"tokens in/out per question": F.concat(F.round("tokens_in").cast("int"), F.lit("/"), F.round("tokens_out").cast("int"))}, ["setup"])


def write_report(parts: list[tuple[str, DataFrame]], path: str) -> None:
    """Titles and one-row Markdown tables, one after the other, as a text file; tables are small."""
    spark = parts[0][1].sparkSession
    text = "\n\n".join(f"## {title}\n\n{df.first()['markdown']}" for title, df in parts)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
