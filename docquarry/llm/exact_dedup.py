"""Exact deduplication: immutable snapshots screened by binary-fuse filters, exact buckets behind them.

Texts are equal when they are identical after each run of white space (space, 0x09-0x0D) became one space. A snapshot is
an immutable set of rows that came earlier. Its digests are spread over shards, and each shard has one static filter.
Incoming rows are first grouped among themselves by digest; each group's digest is screened by its shard's filter. Only
groups that the filter lets through are joined to the snapshot's exact buckets, and only for those are texts fetched and
compared byte for byte. A group whose bytes differ stays a group of its own. write_snapshot() keeps a snapshot's buckets, texts
and filters as tables; dedup_batch() holds any later batch against them without reading the snapshot's rows again.

Edge cases: a null text counts as empty, and empty texts equal each other. Rows with a null doc_id are returned; they
never give the id that stays unless a group has no other (then keep_id is null and they are kept). Repeated rows of one
doc_id count as that many rows and share the verdict of their doc_id. An empty table gives an empty result. Further
columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from docquarry.llm import fuse
from docquarry.llm.common import SPACE_CLASS, fetch_texts, join_unique, text_or_empty
from docquarry.session import ship, stash

#: Keys that one shard's filter holds, on average.
KEYS_PER_SHARD = 200_000
NO_ID = (1 << 63) - 1


def normalised(name: str = "text"):
    return F.regexp_replace(text_or_empty(name), SPACE_CLASS + "+", " ")


def digests(documents: DataFrame) -> DataFrame:
    """doc_id and the SHA-256 of the normalised text."""
    return documents.select(_id().alias("doc_id"), _digest(normalised()).alias("digest"))


def _id():
    """doc_id, the largest number for a null one."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))


def _digest(text):
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _key(table: pa.Table) -> np.ndarray:
    """Bytes 8-16 of each digest; the shard comes from the first bytes."""
    joined = b"".join(x[8:16] for x in table["digest"].to_pylist())
    return np.frombuffer(joined, "<u8")


def _build(table: pa.Table) -> pa.Table:
    return pa.table({"shard": table["shard"].slice(0, 1), "filter": pa.array([fuse.build(_key(table))], pa.binary())})


def _screen(key, incoming: pa.Table, filters: pa.Table) -> pa.Table:
    hit = np.zeros(incoming.num_rows, bool)
    for blob in filters["filter"].to_pylist():
        hit |= fuse.probe(blob, _key(incoming))
    return incoming.drop_columns(["shard"]).filter(pa.array(hit))


def build_filters(snapshot_groups: DataFrame, shards: int) -> DataFrame:
    """One immutable filter for each shard of a snapshot's distinct digests."""
    ship(snapshot_groups.sparkSession)
    return snapshot_groups.select(_shard(shards), "digest").groupBy("shard").applyInArrow(_build, "shard int, filter binary")


def _shard(shards: int):
    return F.pmod(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), F.lit(shards)).cast("int").alias("shard")


def screen(groups: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """The groups whose digest a filter lets through."""
    left = groups.select("*", _shard(shards))
    return left.groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(_screen, groups.schema)


def write_snapshot(documents: DataFrame, folder: str) -> None:
    """Keep an immutable snapshot: one row for each digest (rep, n, the text of rep) and the filters of its shards."""
    spark = documents.sparkSession
    ship(spark)
    said = documents.select(_id().alias("doc_id"), normalised().alias("text")).withColumn("digest", _digest(F.col("text")))
    said.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.min("text").alias("text")).write.parquet(f"{folder}/groups")
    groups = spark.read.parquet(f"{folder}/groups")
    shards = max(1, -(-groups.count() // KEYS_PER_SHARD))
    build_filters(groups, shards).withColumn("shards", F.lit(shards)).write.parquet(f"{folder}/filters")


def dedup_batch(folder: str, incoming: DataFrame) -> DataFrame:
    """exact_dedup() of an incoming batch against a kept snapshot; a row for each row of the batch."""
    spark = incoming.sparkSession
    ship(spark)
    old, filters = spark.read.parquet(f"{folder}/groups"), spark.read.parquet(f"{folder}/filters")
    first = filters.select("shards").first()
    rows = stash(digests(incoming).withColumn("fresh", F.lit(True)), "digests")
    new = stash(rows.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "groups")
    positive = screen(new, filters.drop("shards"), first["shards"] if first else 1)
    pairs = stash(positive.select("digest", F.col("rep").alias("new_rep")).join(old.select("digest", F.col("rep").alias("old_rep")), "digest"), "pairs")
    return _verdict(rows, new.withColumn("fresh", F.lit(True)), old.select("digest", "rep", "n"), new, _equal(pairs, incoming, old.select(F.col("rep").alias("doc_id"), "text")), rows.count())


def exact_dedup(snapshot: DataFrame, incoming: DataFrame) -> DataFrame:
    """A row for each row of both tables: doc_id, digest, keep_id, group_size, kept.

    Rows of the snapshot come before those of the incoming batch; within either, the smallest doc_id stays.
    """
    spark = snapshot.sparkSession
    ship(spark)
    both = digests(snapshot).withColumn("fresh", F.lit(False)).unionByName(digests(incoming).withColumn("fresh", F.lit(True)))
    rows = stash(both, "digests")
    grouped = stash(rows.groupBy("digest", "fresh").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "groups")
    old, new = grouped.where("not fresh").drop("fresh"), grouped.where("fresh").drop("fresh")
    shards = max(1, -(-old.count() // KEYS_PER_SHARD))
    positive = screen(new, stash(build_filters(old, shards), "filters"), shards)
    pairs = stash(positive.alias("a").join(old.alias("b"), "digest").select("digest", F.col("a.rep").alias("new_rep"), F.col("b.rep").alias("old_rep")), "pairs")
    return _verdict(rows, grouped, old, new, _equal(pairs, incoming, snapshot.withColumn("doc_id", _id())), rows.count())


def _equal(pairs: DataFrame, incoming: DataFrame, held: DataFrame) -> DataFrame:
    """digest and old_rep of the pairs whose texts are equal byte for byte."""
    n = pairs.count()
    new_texts = fetch_texts(incoming.withColumn("doc_id", _id()), pairs.select(F.col("new_rep").alias("doc_id")).distinct(), n)
    old_texts = fetch_texts(held, pairs.select(F.col("old_rep").alias("doc_id")).distinct(), n)

    def said(texts: DataFrame, name: str) -> DataFrame:  # by digest too: rows without an id, or of one id, may differ
        return texts.select(F.col("doc_id").alias(name), normalised().alias(f"{name}_text")).withColumn("digest", _digest(F.col(f"{name}_text")))

    both = pairs.join(said(new_texts, "new_rep"), ["new_rep", "digest"]).join(said(old_texts, "old_rep"), ["old_rep", "digest"])
    return both.where(F.col("new_rep_text") == F.col("old_rep_text")).select("digest", "old_rep").distinct()


def _verdict(rows: DataFrame, grouped: DataFrame, old: DataFrame, new: DataFrame, equal: DataFrame, n_rows: int) -> DataFrame:
    verdict = stash(
        grouped.join(equal.withColumn("same", F.lit(True)), "digest", "left")
        .join(new.select("digest", F.col("n").alias("new_n")), "digest", "left").join(old.select("digest", F.col("n").alias("old_n")), "digest", "left")
        .select(
            "digest", "fresh",
            F.when(F.col("same") & F.col("fresh"), F.col("old_rep")).otherwise(F.col("rep")).alias("keep_id"),
            F.when(F.col("same"), F.coalesce("old_n", F.lit(0)) + F.coalesce("new_n", F.lit(0))).otherwise(F.col("n")).alias("group_size"),
            F.col("n").alias("own_n"),
        ),
        "verdict",
    )
    out = join_unique(rows, verdict, ["digest", "fresh"], "own_n", n_rows)
    null = lambda c: F.nullif(F.col(c), F.lit(NO_ID)).alias(c)
    return out.select(null("doc_id"), "digest", null("keep_id"), "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"))


def split_at(documents: DataFrame):
    """The middle of the table's doc_id range: rows at or below it count as the snapshot."""
    low, high = documents.agg(F.min("doc_id"), F.max("doc_id")).first()
    return None if low is None else (int(low) + int(high)) // 2


def dedup_table(documents: DataFrame) -> DataFrame:
    """exact_dedup of one table: its lower half of doc_ids is the snapshot, the rest the incoming batch."""
    cut = split_at(documents)
    past = F.col("doc_id") <= F.lit(cut if cut is not None else 0)
    known = F.coalesce(past, F.lit(False))
    return exact_dedup(documents.where(known), documents.where(~known))
