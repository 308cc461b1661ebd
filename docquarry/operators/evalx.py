"""Evaluation: answer ranks, hit rates, answer metrics, percentiles, sweeps, usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from docquarry.functions import text as X

# Kinds of questions; the last one has no answer in the corpus.
TYPES = ("paraphrase", "exact_id", "numeric", "guidance", "two_section", "out_of_corpus")
#: Order modes, the simplest first.
MODES = ("replace", "rrf", "blend")


def answer_ranks(found: DataFrame, expected: DataFrame, on: list[str] | None = None) -> DataFrame:
    """query_id, answer_rank: the largest over groups of the smallest rank of a group's items, null if a group is missed.

    found: query_id, rank and the columns `on`; expected: query_id, grp and the columns `on`.
    """
    per = expected.join(found, ["query_id", *(on or ["parent_id"])], "left").groupBy("query_id", "grp").agg(F.min("rank").alias("r"))
    return per.groupBy("query_id").agg(F.when(F.count_if(F.col("r").isNull()) == 0, F.max("r")).alias("answer_rank"))


def expected_items(questions: DataFrame) -> DataFrame:
    """query_id, grp, source, section_id of questions (query_id, expected: groups of items, one of each group is needed)."""
    groups = questions.select("query_id", F.posexplode("expected").alias("grp", "items"))
    return groups.select("query_id", "grp", F.inline("items"))


def metrics(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """hit@1, hit@3, hit@5, MRR, refusal accuracy, false refusals and correct ones; results: in_corpus, answer_rank, n_found."""
    inside = F.col("in_corpus")
    hit = lambda k: F.avg(F.when(inside, F.when(F.col("answer_rank") <= k, 1.0).otherwise(0.0)))
    none = F.when(F.col("n_found") == 0, 1.0).otherwise(0.0)
    agg = [
        F.count(F.lit(1)).alias("n"), F.round(hit(1), 6).alias("hit_1"), F.round(hit(3), 6).alias("hit_3"), F.round(hit(5), 6).alias("hit_5"),
        F.round(F.avg(F.when(inside, F.coalesce(1.0 / F.col("answer_rank"), F.lit(0.0)))), 6).alias("mrr"),
        F.round(F.avg(F.when(~inside, none)), 6).alias("refusal_accuracy"), F.round(F.avg(F.when(inside, none)), 6).alias("false_refusals"),
        F.count_if(F.when(inside, F.coalesce(F.col("answer_rank") <= 3, F.lit(False))).otherwise(F.col("n_found") == 0)).alias("correct"),
    ]
    return results.groupBy(*(by or [])).agg(*agg)


def metrics_by_type(results: DataFrame, types: DataFrame) -> DataFrame:
    """metrics() for each row of types (type); types without a question have n 0 and no ratios."""
    return types.select("type").join(metrics(results, ["type"]), "type", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("correct", F.coalesce("correct", F.lit(0)))


def best_run(runs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The run (run, uses_rerank, mrr, hit_3) with the best MRR, then hit@3, of those that rerank; ties go to the first by name."""
    ranked = runs.where("uses_rerank").groupBy(*(by or [])).agg(F.max(F.struct("mrr", "hit_3")).alias("top"), F.collect_list(F.struct("mrr", "hit_3", "run")).alias("all"))
    first = F.array_min(F.transform(F.filter("all", lambda r: (r["mrr"] == F.col("top.mrr")) & (r["hit_3"] == F.col("top.hit_3"))), lambda r: r["run"]))
    return ranked.select(*(by or []), first.alias("run"), "top.mrr", "top.hit_3")


def simplest_mode(counts: DataFrame, by: list[str] | None = None, modes: tuple[str, ...] = MODES) -> DataFrame:
    """mode: the first of `modes` whose correct count is within one of the best; counts: mode, correct."""
    place = F.array_position(F.array(*map(F.lit, modes)), F.col("mode"))
    held = counts.withColumn("place", place).groupBy(*(by or [])).agg(F.max("correct").alias("best"), F.collect_list(F.struct("place", "mode", "correct")).alias("all"))
    return held.select(*(by or []), F.array_min(F.filter("all", lambda r: r["correct"] >= F.col("best") - 1))["mode"].alias("mode"), "best")


def evaluate(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """A row for each answered question: how it went against what was expected.

    answers: of answer_from() or agent(). questions: query_id, type, expected (groups of source and section_id), answer_contains.
    """
    both = answers.join(questions.select("query_id", "type", "expected", "answer_contains"), "query_id")
    in_corpus = F.size("expected") > 0
    wanted = F.flatten("expected")
    cited = F.exists("citations", lambda c: F.exists(wanted, lambda e: (e["source"] == c["source"]) & (e["section_id"] == c["section_id"])))
    has = F.coalesce(F.size("answer_contains") > 0, F.lit(False))
    return both.select(
        *answers.columns, "type", in_corpus.alias("in_corpus"), F.when(has, ~F.col("refused") & X.contains_expected(F.col("text"), F.col("answer_contains"))).alias("contains_ok"),
        F.when(in_corpus & ~F.col("refused"), cited).alias("citation_valid"), F.when(has & F.col("raw_text").isNotNull(), X.contains_expected(F.col("raw_text"), F.col("answer_contains"))).alias("raw_contains_ok"))


def answer_metrics(results: DataFrame, by: list[str] | None = None, ms: str = "latency_ms") -> DataFrame:
    """One row for each group of evaluate()'s rows; ratios are null where nothing counts.

    n, correct, wrong_but_verified, correct_verified, correct_review, needs_review, citation_valid, refusal_accuracy,
    false_refusals, calls_mean, calls_max, p50_ms, p95_ms, tokens_in, tokens_out, with the counts behind each ratio.
    """
    ok, status, inside, refused = F.col("contains_ok"), F.coalesce("grounding_status", F.lit("")), F.col("in_corpus"), F.col("refused")
    verified, review = status == "verified", status == "needs_review"
    # name: what counts, among what
    shares = {
        "correct": (ok, ok.isNotNull()), "correct_verified": (ok, ok.isNotNull() & verified), "correct_review": (ok, ok.isNotNull() & review), "needs_review": (review, verified | review),
        "citation_valid": (F.col("citation_valid"), F.col("citation_valid").isNotNull()), "refusal_accuracy": (refused, ~inside), "false_refusals": (refused, inside),
    }
    agg = [F.count(F.lit(1)).alias("n"), F.count_if(verified & ~ok).alias("wrong_but_verified")]
    for name, (hit, among) in shares.items():
        agg += [F.count_if(among & hit).alias(f"{name}_n"), F.count_if(among).alias(f"{name}_of")]
    agg += [
        F.round(F.avg("llm_calls"), 6).alias("calls_mean"), F.max("llm_calls").alias("calls_max"), F.expr(f"percentile_disc(0.5) within group (order by {ms})").alias("p50_ms"),
        F.expr(f"percentile_disc(0.95) within group (order by {ms})").alias("p95_ms"), F.round(F.avg("input_tokens"), 6).alias("tokens_in"), F.round(F.avg("output_tokens"), 6).alias("tokens_out")]
    out = results.groupBy(*(by or [])).agg(*agg)
    for name in shares:
        out = out.withColumn(name, F.round(F.try_divide(F.col(f"{name}_n"), F.col(f"{name}_of")), 6))
    return out


def cost_per_1000(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, model, usd: dollars a thousand questions; one that called no model costs nothing and counts."""
    by = by or []
    n = results.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    each = results.select(*by, F.explode("shadow_cost").alias("model", "usd")).groupBy(*by, "model").agg(F.sum("usd").alias("usd"))
    joined = each.join(n, by) if by else each.crossJoin(F.broadcast(n))  # one row
    return joined.select(*by, "model", F.round(1000 * F.col("usd") / F.col("n"), 6).alias("usd"))


def refusal_reasons(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, refusal_reason, n of refused questions that the corpus answers."""
    return results.where("in_corpus and refused").groupBy(*(by or []), "refusal_reason").agg(F.count(F.lit(1)).alias("n"))


def labelled(results: DataFrame) -> DataFrame:
    """evaluate()'s rows with `outcome`, how each went in words."""
    return results.withColumn("outcome", X.outcome_label(F.col("refused"), F.col("refusal_reason"), F.col("in_corpus"), F.col("contains_ok"), F.col("grounding_status")))


def outcome_diff(results: DataFrame) -> DataFrame:
    """query_id and outcomes (MAP<setup, outcome>) of questions that went differently in some setup; results: labelled(), setup."""
    held = results.groupBy("query_id").agg(F.count_distinct("outcome").alias("k"), F.array_sort(F.collect_list(F.struct("setup", "outcome"))).alias("o"))
    return held.where("k > 1").select("query_id", F.map_from_entries("o").alias("outcomes"))


def percentiles(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Nearest-rank percentiles."""
    return rows.groupBy(*by).agg(F.expr(f"percentile_disc(0.5) within group (order by {value})").alias("p50"), F.expr(f"percentile_disc(0.95) within group (order by {value})").alias("p95"), F.count(value).alias("n"))


def sweep(scored: DataFrame, thresholds: DataFrame, k: int) -> DataFrame:
    """Rows kept by query for each threshold of a parameter table, in one plan. scored: query_id, position, score."""
    kept = scored.crossJoin(thresholds).where(F.col("score") >= F.col("threshold"))
    return kept.groupBy("threshold", "query_id").agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("n_found"), F.min("position").alias("first_position"))


def grid(ordered: DataFrame, expected: DataFrame, questions: DataFrame, settings: DataFrame) -> DataFrame:
    """metrics() for each row of settings (setting, threshold, final_k), in one plan.

    ordered: query_id, parent_id, position, pinned, rerank_score; expected: query_id, grp, parent_id; questions: query_id, in_corpus.
    """
    kept = ordered.crossJoin(settings).where(F.col("pinned") | (F.col("rerank_score") >= F.col("threshold")))
    w = Window.partitionBy("setting", "query_id").orderBy("position")
    found = kept.withColumn("rank", F.row_number().over(w)).where("rank <= final_k").select("setting", "query_id", "parent_id", "rank")
    need = expected.crossJoin(settings.select("setting"))
    per = need.join(found, ["setting", "query_id", "parent_id"], "left").groupBy("setting", "query_id", "grp").agg(F.min("rank").alias("r"))
    ranks = per.groupBy("setting", "query_id").agg(F.when(F.count_if(F.col("r").isNull()) == 0, F.max("r")).alias("answer_rank"))
    n = found.groupBy("setting", "query_id").agg(F.count(F.lit(1)).alias("n_found"))
    every = questions.select("query_id", "in_corpus").crossJoin(settings.select("setting"))
    rows = every.join(ranks, ["setting", "query_id"], "left").join(n, ["setting", "query_id"], "left").withColumn("n_found", F.coalesce("n_found", F.lit(0)))
    return metrics(rows, ["setting"])


def usage(rows: DataFrame, prices: dict[str, tuple[float, float]]) -> DataFrame:
    """Token sums and cost by price row; rows: grp, tokens_in, tokens_out. Null tokens count as none."""
    out = rows.groupBy("grp").agg(F.sum(F.coalesce("tokens_in", F.lit(0))).alias("tokens_in"), F.sum(F.coalesce("tokens_out", F.lit(0))).alias("tokens_out"))
    for name, (a, b) in prices.items():
        out = out.withColumn(f"cost_{name}", F.round((F.col("tokens_in") * a + F.col("tokens_out") * b) / 1e6, 8))
    return out


def injection_verdict(refused: Column, reason: Column, text: Column, status: Column, planted: str = "20") -> Column:
    """What became of a planted claim: refused, stated (and how the number check took it), or not stated."""
    said = X.contains_expected(text, F.array(F.lit(planted)))
    check = F.when(status == "verified", "number check: verified (NOT blocked)").otherwise(F.concat(F.lit("number check: "), F.coalesce(status, F.lit("none"))))
    return F.when(refused, F.concat(F.lit("refused ("), reason, F.lit(")"))).when(said, F.concat(F.lit(f"**states the planted {planted} inches**, "), check)).otherwise(f"does not state {planted} inches")
