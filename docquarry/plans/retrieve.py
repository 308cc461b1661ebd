"""The retrieval pipeline for a table of queries: from texts to contexts, every intermediate ranking as a table."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from docquarry.functions import text as X
from docquarry.operators import answers, ingest, models, search
from docquarry.session import stash


@dataclass(frozen=True)
class Config:
    """Stage switches, depths and sizes; a stage that is off isn't part of the plan."""

    normalise: bool = True
    glossary: bool = True
    child_vector: bool = True
    keyword: bool = True
    section_vector: bool = False
    exact_refs: bool = True
    rerank: bool = True
    window: bool = True
    child_k: int = 20
    keyword_k: int = 20
    section_k: int = 5
    rrf_k: int = search.RRF_K
    rerank_depth: int = 10
    final_k: int = 3
    threshold: float | None = 0.0
    mode: str = "replace"
    weight: float = 0.5
    whole_chars: int = answers.WHOLE_CHARS
    window_chars: int = answers.WINDOW_CHARS


@dataclass(frozen=True)
class Stores:
    """What a retrieval reads.

    parents: parent_id, text, breadcrumb, section_id, searchable, occurrence, the filter columns, and any others that contexts carry.
    children: child_id, parent_id, child_index, start_char, text. index: over child_id. child_vectors: child_id, embedding.
    section_vectors: parent_id, embedding. embed(df, column) adds embeddings to queries; reranker(query tokens, passage) scores.
    """

    parents: DataFrame
    children: DataFrame
    index: search.Index | None = None
    child_vectors: DataFrame | None = None
    section_vectors: DataFrame | None = None
    embed: Callable[[DataFrame, str], DataFrame] | None = None
    reranker: Callable[[Column, Column], Column] = models.shared_words
    filter_keys: tuple[str, ...] = search.FILTER_KEYS


@dataclass
class Result:
    """contexts: query_id, rank, parent_id, context, window, focus, scores, and the parents' columns; the rest by name.

    timings: milliseconds of each written stage, in the order in which they ran.
    """

    contexts: DataFrame
    stages: dict[str, DataFrame] = field(default_factory=dict)
    timings: dict[str, float] = field(default_factory=dict)


def normalise(queries: DataFrame, config: Config) -> DataFrame:
    """query_id, original, text, tokens, section_refs of queries (query_id, text)."""
    text = F.col("text")
    if config.normalise:
        text = X.expand_abbreviations(text)
    if config.glossary:
        text = X.expand_glossary(text)
    return queries.select("query_id", F.col("text").alias("original"), text.alias("text")).select("*", X.tokenize(F.col("text"), True).alias("tokens"), X.section_refs(F.col("original")).alias("section_refs"))


def build_children(parents: DataFrame) -> DataFrame:
    """child_id, parent_id, child_index, start_char, text of searchable parents."""
    kids = ingest.children(parents.where("searchable").select("parent_id", "text"), "parent_id")
    return kids.select(X.child_id(F.col("parent_id").cast("string"), F.col("child_index")).alias("child_id"), "parent_id", "child_index", "start_char", "text")


def retrieve(queries: DataFrame, stores: Stores, config: Config = Config(), filters: dict | None = None, query_vectors: DataFrame | None = None) -> Result:
    """Contexts that answer queries (query_id, text); a query without any has none that answers it.

    Filters hold for every ranking and for pins, before the cut. query_vectors: query_id, q, where they aren't to be embedded.
    Rankings are written once, since fusion and best children both read them.
    """
    stages: dict[str, DataFrame] = {}
    timings: dict[str, float] = {}

    def keep(name: str, df: DataFrame) -> DataFrame:
        began = time.perf_counter()
        stages[name] = stash(df, name)
        timings[name] = round((time.perf_counter() - began) * 1000, 1)
        return stages[name]

    q = stages["normalised"] = normalise(queries, config)
    matches = search.filter_column(filters, stores.filter_keys)
    parents = stores.parents if not filters else stores.parents.where(matches)
    kin = stores.children.select("child_id", "parent_id")
    allowed = kin.join(parents.select("parent_id"), "parent_id", "left_semi").select("child_id") if filters else None
    if (config.child_vector or config.section_vector) and query_vectors is None:
        query_vectors = keep("query_vectors", stores.embed(q.select("query_id", "text"), "text").select("query_id", F.col("embedding").alias("q")))
    child_rankings, rankings = [], {}
    if config.child_vector:
        vectors = stores.child_vectors if allowed is None else stores.child_vectors.join(allowed, "child_id", "left_semi")
        hits = keep("child_vector", search.vector_top_k(vectors, query_vectors, config.child_k, "child_id"))
        child_rankings.append(hits)
        rankings["child_vector"] = search.parents_of(kin.join(search.maybe_broadcast(hits), "child_id"))
    if config.keyword:
        hits = keep("bm25", search.bm25(stores.index, search.query_tokens(q, F.col("tokens")), config.keyword_k, allowed))
        child_rankings.append(hits)
        rankings["bm25"] = search.parents_of(kin.join(search.maybe_broadcast(hits), "child_id"))
    if config.section_vector:
        vectors = stores.section_vectors if not filters else stores.section_vectors.join(parents.select("parent_id"), "parent_id", "left_semi")
        rankings["section_vector"] = keep("section_vector", search.vector_top_k(vectors, query_vectors, config.section_k, "parent_id"))
    fused = search.fuse(rankings, config.rrf_k)
    if config.exact_refs:
        refs = q.select("query_id", F.posexplode("section_refs").alias("pos", "ref"))
        fused = search.pin(fused, refs, search.exact_refs(parents))
    else:
        fused = fused.withColumn("pinned", F.lit(False)).withColumn("pin_pos", F.lit(None).cast("int"))
    fused = fused.where(F.col("fused_pos") <= (config.rerank_depth if config.rerank else config.final_k))
    candidates = keep("fused", fused.select("query_id", "parent_id", "rrf", "ranks", "pinned", "pin_pos", "fused_pos"))
    scores = search.child_scores(child_rankings, config.rrf_k) if child_rankings else None
    if scores is None:
        scores = candidates.select("query_id", F.lit(None).cast(dict(kin.dtypes)["child_id"]).alias("child_id"), F.lit(0.0).alias("score")).where(F.lit(False))
    texts = stores.parents.join(search.maybe_broadcast(candidates.select("parent_id").distinct()), "parent_id", "left_semi")
    known = search.best_children(candidates, scores, stores.children).join(texts, "parent_id")
    if config.rerank:
        passage = F.concat_ws("\n", "breadcrumb", F.coalesce(F.get("best", F.lit(0))["text"], F.substring("text", 1, 400)))
        scored = known.join(q.select("query_id", "tokens"), "query_id").withColumn("rerank_score", stores.reranker(F.col("tokens"), passage)).drop("tokens")
        ordered = keep("reranked", search.order(scored, config.mode, config.weight, config.rrf_k))
        final = search.final_cut(ordered, config.threshold, config.final_k)
    else:
        final = search.final_cut(known.withColumn("rerank_score", F.lit(None).cast("double")).withColumn("position", F.col("fused_pos")), None, config.final_k)
    spans = final.withColumn("spans", F.transform("best", lambda b: answers.span(b["start"], b["end"])))
    shown = answers.contexts(spans, config.window, config.whole_chars, config.window_chars).withColumnRenamed("final_rank", "rank")
    return Result(shown.withColumn("parent_length", F.length("text")).drop("spans", "best"), stages, timings)
