"""Seams for models, and deterministic stand-ins: an embedder, a reranker, a language model with usage.

An embedder takes a DataFrame with an id and a text and adds `embedding`. A reranker takes query tokens and a passage's tokens.
A language model takes rows with `system` and `user` and adds `reply`, `input_tokens`, `output_tokens` and `latency_ms`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from docquarry.functions import text as X

# Dollars a million tokens, in and out.
PRICES = {"small": (1.0, 5.0), "medium": (2.0, 10.0), "large": (5.0, 25.0)}
REPLY = {"reply": "string", "input_tokens": "long", "output_tokens": "long", "latency_ms": "double"}


def hashed_embedder(dims: int = 64) -> Callable[[DataFrame, str], DataFrame]:
    """A bag of words hashed into `dims` counts, of length one."""
    def embed(rows: DataFrame, text: str) -> DataFrame:
        slots = F.transform(X.tokenize(F.col(text), True), lambda t: F.pmod(F.xxhash64(t), F.lit(dims)))
        counts = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda k: (F.size(F.filter(slots, lambda s: s == k)) + F.lit(0.1)).cast("double"))
        norm = X.let(counts, lambda c: F.transform(c, lambda x: (x / F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, y: a + y * y))).cast("float")))
        return rows.withColumn("embedding", norm)

    return embed


def batch_embedder(encode: Callable[[list[str]], list[list[float]]], prefix: str = "", batch: int = 32) -> Callable[[DataFrame, str], DataFrame]:
    """A model's own encode(texts), by Arrow batch in rows of `batch`; prefix: an instruction that queries get."""
    def embed(rows: DataFrame, text: str) -> DataFrame:
        @F.pandas_udf("array<float>")
        def run(s: pd.Series) -> pd.Series:
            texts = [prefix + (t or "") for t in s]
            return pd.Series([v for a in range(0, len(texts), batch) for v in encode(texts[a : a + batch])], index=s.index, dtype=object)

        return rows.withColumn("embedding", run(text))

    return embed


def shared_words(query_tokens: Column, passage: Column) -> Column:
    """The stand-in reranker: how many different words of the query the passage has."""
    return F.size(F.array_intersect(query_tokens, X.tokenize(passage, True))).cast("double")


def pair_reranker(score: Callable[[list[tuple[str, str]]], list[float]]) -> Callable[[Column, Column], Column]:
    """A model's score(pairs of query and passage), by Arrow batch."""
    @F.pandas_udf("double")
    def run(query: pd.Series, passage: pd.Series) -> pd.Series:
        return pd.Series(score(list(zip(query, passage, strict=True))), index=query.index, dtype=float)

    return run


def extractive(rows: DataFrame) -> DataFrame:
    """The stand-in language model: yes to gradings, the question again to rewrites, else the first sentence of the first source."""
    user = F.col("user")
    first = F.regexp_extract(user, r"(?s)Sources:\n\n\[S1\][^\n]*\n(.*?[.!?](?=\s)|[^\n]*)", 1)
    asked = F.regexp_extract(user, r"Question: ([^\n]*)", 1)
    reply = F.when(user.contains("Reply with one word"), "yes").when(user.endswith("Search query:"), asked).when(first == "", "NOT_IN_SOURCES").otherwise(F.concat(X.strip(first), F.lit(" [S1]")))
    return metered(rows.withColumn("reply", reply))


def metered(rows: DataFrame) -> DataFrame:
    """Token counts as words of the prompt and of the reply, where a model reports none."""
    count = lambda *c: F.size(F.filter(F.split(F.concat_ws(" ", *c), r"\s+"), lambda w: w != "")).cast("long")
    return rows.withColumn("input_tokens", count("system", "user")).withColumn("output_tokens", count("reply")).withColumn("latency_ms", F.lit(0.0))


def chat(complete: Callable[[str, str], dict]) -> Callable[[DataFrame], DataFrame]:
    """A client's complete(system, user), a dict with text and, if known, input_tokens, output_tokens and latency_ms."""
    def run(rows: DataFrame) -> DataFrame:
        @F.pandas_udf(", ".join(f"{k} {v}" for k, v in REPLY.items()))
        def call(system: pd.Series, user: pd.Series) -> pd.DataFrame:
            got = [complete(s, u) for s, u in zip(system, user, strict=True)]
            return pd.DataFrame([(g["text"], g.get("input_tokens"), g.get("output_tokens"), g.get("latency_ms", 0.0)) for g in got], columns=list(REPLY)).astype({"input_tokens": "Int64", "output_tokens": "Int64"})

        return rows.withColumn("_r", call("system", "user")).select(*rows.columns, "_r.*")

    return run


def shadow_cost(tokens_in: Column, tokens_out: Column, prices: dict = PRICES) -> Column:
    """MAP<model, dollars> of a call; an empty map where tokens aren't known."""
    costs = F.map_from_arrays(F.array(*map(F.lit, prices)), F.array(*((tokens_in * a + tokens_out * b) / 1e6 for a, b in prices.values())))
    return F.when(tokens_in.isNull() | tokens_out.isNull(), F.create_map().cast("map<string,double>")).otherwise(costs)


@dataclass(frozen=True)
class Settings:
    """What is set from outside: stores' folder, model names, sizes."""

    store: str = "store"
    provider: str = "extractive"
    model: str = "extractive"
    temperature: float = 0.0
    max_context_chars: int = 12000
    chunk_size: int = 400
    chunk_overlap: int = 60
    section_prefix_chars: int = 1500
    tracing: bool = False


PROVIDERS = ("extractive", "chat")


def load_settings(env: dict[str, str]) -> Settings:
    """Settings from variables named DOCQUARRY_<FIELD>; an unknown provider raises."""
    kinds = {"int": int, "float": float, "bool": lambda x: x not in ("", "0", "false"), "str": str}
    given = {n: kinds[f.type if isinstance(f.type, str) else f.type.__name__](env[f"DOCQUARRY_{n.upper()}"]) for n, f in Settings.__dataclass_fields__.items() if f"DOCQUARRY_{n.upper()}" in env}
    out = Settings(**given)
    if out.provider not in PROVIDERS:
        raise ValueError(f"Unknown LLM provider {out.provider!r}")
    return out
