"""Spans of a run: what was done, how long it took, what came out. Off by default; then nothing is kept."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "trace_id string, span_id string, parent_id string, name string, kind string, started double, ms double, fields string"


@dataclass
class Trace:
    """Spans nest by the order in which they open; rows() gives them as a table, flush() appends them to a folder."""

    enabled: bool = False
    trace_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    spans: list[dict] = field(default_factory=list)
    open: list[dict] = field(default_factory=list)

    @contextmanager
    def observe(self, name: str, kind: str = "span", **fields) -> Iterator[dict | None]:
        if not self.enabled:
            yield None
            return
        span = {"trace_id": self.trace_id, "span_id": uuid.uuid4().hex, "parent_id": self.open[-1]["span_id"] if self.open else None, "name": name, "kind": kind, "started": time.time(), "fields": dict(fields)}
        self.open.append(span)
        began = time.perf_counter()
        try:
            yield span
        finally:
            span["ms"] = round((time.perf_counter() - began) * 1000, 1)
            self.open.pop()
            self.spans.append(span)

    @staticmethod
    def update(span: dict | None, **fields) -> None:
        if span is not None:
            span["fields"] |= fields

    def rows(self, spark: SparkSession) -> DataFrame:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        return spark.createDataFrame([tuple(json.dumps(s["fields"], default=str) if n == "fields" else s[n] for n in names) for s in self.spans], SCHEMA)

    def flush(self, spark: SparkSession, folder: str) -> None:
        """Append the closed spans to a table, by trace, and forget them."""
        if self.enabled and self.spans:
            self.rows(spark).write.mode("append").partitionBy("trace_id").parquet(folder)
            self.spans.clear()
