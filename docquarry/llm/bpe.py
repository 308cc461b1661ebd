"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The queue has one bucket for each merge rank. A bucket holds linked-list positions whose pair had that rank when they were
put in; a three-level bitmap over the ranks finds the first non-empty bucket with find-first-set. A position taken from a
bucket is stale if its node is gone or its pair has another rank by now, and is skipped.

Pre-tokens are independent, so one queue serves all new pre-tokens of an Arrow batch together: each step takes the
smallest rank of the whole batch and merges, with numpy, the leftmost live position in each pre-token. Very long
pre-tokens go through the scalar form of the same queue, whose cost is O(n) queue operations.

Edge cases: a null text counts as empty; an empty text has no tokens, and the digests of the empty string. Each row has a
result of its own, repeated rows and rows without a doc_id too; an empty table gives an empty result. Extra columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from docquarry.session import ship, spread

#: Pre-tokens of more bytes than this go through the scalar queue.
LONG = 48
#: Pre-tokens that a worker remembers; further ones are encoded again in each batch.
CACHE = 600_000


def load_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file, read by Spark unless the path is a plain local file of the driver."""
    try:
        lines = open(path, "rb").read().splitlines()
    except OSError:
        lines = [r.value.encode() for r in spark.read.text(path).collect()]
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class BitQueue:
    """Buckets by rank under a hierarchical bitmap of 64-bit words (as Python integers)."""

    def __init__(self, size: int):
        self.buckets: dict[int, list] = {}
        self.levels = []
        while True:
            size = -(-size // 64)
            self.levels.append([0] * size)
            if size == 1:
                break

    def put(self, rank: int, item) -> None:
        held = self.buckets.get(rank)
        if held is not None:
            held.append(item)
            return
        self.buckets[rank] = [item]
        at = rank
        for level in self.levels:
            word, bit = at >> 6, 1 << (at & 63)
            was = level[word]
            level[word] = was | bit
            if was:
                break
            at = word

    def first(self) -> int:
        """The smallest rank with a bucket, or -1."""
        if not self.levels[-1][0]:
            return -1
        at = 0
        for level in reversed(self.levels):
            word = level[at]
            at = at << 6 | ((word & -word).bit_length() - 1)
        return at

    def take(self, rank: int) -> list:
        out = self.buckets.pop(rank)
        at = rank
        for level in self.levels:
            word = at >> 6
            level[word] &= ~(1 << (at & 63))
            if level[word]:
                break
            at = word
        return out


class Encoder:
    """Encodes pre-tokens by the ranks of a vocabulary that has all single bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.split = regex.compile(pattern).findall
        self.ranks, self.size = ranks, max(ranks.values()) + 1
        self.byte_id = np.zeros(256, np.int64)
        for i in range(256):
            self.byte_id[i] = ranks[bytes([i])]
        self.token = {str(i): b for b, i in ranks.items()}
        pairs = [(ranks[b[:k]] * self.size + ranks[b[k:]], i) for b, i in ranks.items() for k in range(1, len(b)) if b[:k] in ranks and b[k:] in ranks]
        table = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        self.pair_key, self.pair_rank = table[:, 0].copy(), table[:, 1].copy()
        self.pair = dict(zip(self.pair_key.tolist(), self.pair_rank.tolist(), strict=True))
        self.cache: dict[str, str] = {}

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, -1 where they don't merge."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == key, self.pair_rank[at], -1)

    def encode_long(self, data: bytes) -> list[int]:
        """One pre-token through the scalar queue."""
        sym = self.byte_id[np.frombuffer(data, np.uint8)].tolist()
        n, size, pair = len(sym), self.size, self.pair
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = BitQueue(size)
        for i in range(n - 1):
            if (r := pair.get(sym[i] * size + sym[i + 1])) is not None:
                queue.put(r, i)
        live: dict[int, list] = {}
        while (r := queue.first()) >= 0:
            got = queue.take(r)
            heap = live.pop(r, [])
            for i in got:
                heapq.heappush(heap, i)
            i = heapq.heappop(heap)
            if heap:  # the rest of the bucket waits: a merge may open a smaller rank
                queue.put(r, heap[0])
                heapq.heappop(heap)
                if heap:
                    live[r] = heap
            j = after[i]
            if sym[i] < 0 or j >= n or pair.get(sym[i] * size + sym[j]) != r:
                continue
            sym[i], sym[j], after[i] = r, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (x := pair.get(r * size + sym[after[i]])) is not None:
                    queue.put(x, i)
            if before[i] >= 0 and (x := pair.get(sym[before[i]] * size + r)) is not None:
                queue.put(x, before[i])
        return [s for s in sym if s >= 0]

    def encode_many(self, words: list[bytes]) -> list[str]:
        """Ids of each pre-token as decimals joined by a space; one queue for all."""
        lengths = np.array([len(w) for w in words], np.int64)
        sym = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        n = len(sym)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        word_of = np.repeat(np.arange(len(words)), lengths)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1], before[starts] = -1, -1
        alive = np.ones(n, bool)
        queue = BitQueue(self.size)

        def put(at: np.ndarray, rank: np.ndarray) -> None:
            at, rank = at[rank >= 0], rank[rank >= 0]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cut = np.flatnonzero(np.diff(rank)) + 1
            for r, piece in zip(rank[np.r_[0, cut]].tolist(), np.split(at, cut), strict=True):
                queue.put(r, piece)

        open_ = np.flatnonzero(after >= 0)
        put(open_, self._rank(sym[open_], sym[after[open_]]))
        while (r := queue.first()) >= 0:
            at = queue.take(r)
            at = np.unique(np.concatenate(at)) if len(at) > 1 else np.sort(at[0])
            at = at[alive[at]]
            at = at[after[at] >= 0]
            at = at[self._rank(sym[at], sym[after[at]]) == r]
            if not len(at):
                continue
            owner = word_of[at]
            lead = np.ones(len(at), bool)
            lead[1:] = owner[1:] != owner[:-1]
            if not lead.all():  # only the leftmost of a pre-token: its merge may open a smaller rank
                queue.put(r, at[~lead])
                at = at[lead]
            gone = after[at]
            sym[at], alive[gone] = r, False
            nxt = after[gone]
            after[at] = nxt
            inner = nxt >= 0
            before[nxt[inner]] = at[inner]
            put(at[inner], self._rank(sym[at[inner]], sym[nxt[inner]]))
            prev = before[at]
            prev = prev[prev >= 0]
            put(prev, self._rank(sym[prev], sym[after[prev]]))
        ids = sym[alive].astype("U").tolist() if n else []
        stops = np.cumsum(np.bincount(word_of[alive], minlength=len(words))).tolist()
        out, a = [], 0
        for b in stops:
            out.append(" ".join(ids[a:b]))
            a = b
        return out

    def _learn(self, pretokens: set[str]) -> dict[str, str]:
        """The encoding of each pre-token, from the cache where it is known."""
        get = self.cache.get
        known = {p: get(p) for p in pretokens}
        new = [p for p, ids in known.items() if ids is None]
        data = [p.encode() for p in new]
        short = [i for i, d in enumerate(data) if len(d) <= LONG]
        fresh = {new[i]: ids for i, ids in zip(short, self.encode_many([data[i] for i in short]) if short else [], strict=True)}
        fresh |= {p: " ".join(map(str, self.encode_long(d))) for p, d in zip(new, data, strict=True) if len(d) > LONG}
        known |= fresh
        if len(self.cache) + len(fresh) <= CACHE:
            self.cache |= {p: ids for p, ids in fresh.items() if len(p) <= LONG}
        return known

    def encode(self, texts: list[str | None]) -> list[str]:
        """Ids of each text as decimals joined by a space."""
        split = [self.split(t) if t else [] for t in texts]
        get = self._learn(set().union(*split)).__getitem__
        return [" ".join(map(get, s)) for s in split]

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.token.__getitem__, ids.split(" "))) if ids else b""


_ENCODERS: dict[str, Encoder] = {}


def encoder(ranks, pattern: str, name: str) -> Encoder:
    """The worker's own encoder for a broadcast vocabulary."""
    if name not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[name] = Encoder(ranks.value, pattern)
    return _ENCODERS[name]


#: Bytes of texts that a worker takes at once; bounds its memory.
BATCH_BYTES = 3 << 20
#: For encoding, whose queue works best on many new pre-tokens.
ENCODE_BYTES = 8 << 20


def encode_table(documents: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, how many ids its whole text has, the digest of their decimals, the digest and number of the decoded bytes.

    The vocabulary is read once by the driver and broadcast (a fixed file of about a megabyte).
    """
    spark = documents.sparkSession
    ship(spark)
    ranks = spark.sparkContext.broadcast(load_ranks(spark, vocabulary))
    name = f"{vocabulary}\n{pattern}"

    def run(batches):
        enc = encoder(ranks, pattern, name)
        for batch in batches:
            for piece in slices(batch, ENCODE_BYTES):
                ids = enc.encode(piece["text"].to_pylist())
                raw = [enc.decode(x) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [
                        piece["doc_id"],
                        pa.array([x.count(" ") + 1 if x else 0 for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in ids], pa.string()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string()),
                        pa.array([len(x) for x in raw], pa.int64()),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes"],
                )

    docs = spread(documents.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"))
    return docs.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long")


def encode_ids(documents: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id and ids (array of int) of each whole text, for tokenised corpora."""
    spark = documents.sparkSession
    ship(spark)
    ranks = spark.sparkContext.broadcast(load_ranks(spark, vocabulary))
    name = f"{vocabulary}\n{pattern}"

    def run(batches):
        enc = encoder(ranks, pattern, name)
        for batch in batches:
            for piece in slices(batch, ENCODE_BYTES):
                ids = [[int(i) for i in x.split()] for x in enc.encode(piece["text"].to_pylist())]
                yield pa.RecordBatch.from_arrays([piece["doc_id"], pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return documents.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and the decoded bytes of a table of doc_id and ids; a null list counts as empty."""
    spark = encoded.sparkSession
    ship(spark)
    ranks = spark.sparkContext.broadcast(load_ranks(spark, vocabulary))

    def run(batches):
        token = {i: b for b, i in ranks.value.items()}
        for batch in batches:
            out = [b"".join(token[i] for i in ids or []) for ids in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(out, pa.binary())], names=["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def slices(batch: pa.RecordBatch, most: int = BATCH_BYTES):
    """The batch in pieces of about `most` bytes of text, whole rows each."""
    import pyarrow.compute as pc

    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False))
    a = 0
    while a < batch.num_rows:
        base = sizes[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(sizes, base + most, "right")))
        yield batch.slice(a, b - a)
        a = b
