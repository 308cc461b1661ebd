"""Helpers that several corpus operators share."""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import secrets

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from docquarry.session import stash

#: Bytes that count as white space for words: space and 0x09-0x0D.
SPACE_CLASS = "[\\x20\\x09-\\x0D]"
#: A table of ids up to this many rows (8 bytes each, plus Spark's overhead) may be broadcast.
BROADCAST_ROWS = 1_000_000
#: Upper bound on the number of hot keys that are ever broadcast.
HOT_KEYS = 10_000
#: Rows of a key below which it is never hot.
HOT_ROWS = 1000

SPLITMIX_A, SPLITMIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser (public domain constants)."""
    x = x.astype(np.uint64, copy=True)
    x += GOLDEN
    x ^= x >> np.uint64(30)
    x *= SPLITMIX_A
    x ^= x >> np.uint64(27)
    x *= SPLITMIX_B
    x ^= x >> np.uint64(31)
    return x


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def join_unique(left: DataFrame, right: DataFrame, keys: list[str], size_col: str, n_rows: int, how: str = "inner") -> DataFrame:
    """left joined to right, where right has one row per key and size_col says how many rows of left carry the key.

    A key with n_rows / HOT_KEYS rows or more is hot. There can be HOT_KEYS such keys at most, whatever the input, so
    they are broadcast; their rows of left are never shuffled. All other keys go through an ordinary shuffle join.
    """
    hot_at = max(HOT_ROWS, -(-n_rows // HOT_KEYS))
    hot = right.where(F.col(size_col) >= hot_at)
    rest = right.where(F.col(size_col) < hot_at)
    on_hot = left.join(F.broadcast(hot), keys, "inner")
    cold = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return on_hot.unionByName(cold.join(rest, keys, how), allowMissingColumns=True)


def numbered(docs: DataFrame, name: str) -> tuple[DataFrame, bool]:
    """docs with a number of its own for each row in the column `name`, in the order of doc_id, null ones last.

    That is doc_id itself where that will do (then True comes second). Otherwise rows are written with their numbers, since
    places may change; the text and the row's place spread a repeated id over tasks.
    """
    number = F.col("doc_id").cast("long")
    n, ids = docs.agg(F.count(F.lit(1)), F.count_distinct(number)).first()
    if n == ids:
        return docs.withColumn(name, number), True
    order = [F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_last(), F.monotonically_increasing_id()]
    return stash(docs.orderBy(*order).withColumn(name, F.monotonically_increasing_id()), "numbered"), False


def fetch_texts(documents: DataFrame, ids: DataFrame, n_ids: int) -> DataFrame:
    """Rows of documents whose doc_id is in ids (one column doc_id, distinct); a broadcast only below BROADCAST_ROWS."""
    small = F.broadcast(ids) if n_ids <= BROADCAST_ROWS else ids
    return documents.join(small, "doc_id", "left_semi")


#: Modulus of the sequence hashes, a Mersenne prime.
PRIME = np.uint64((1 << 61) - 1)
_P = (1 << 61) - 1
_LOW31, _LOW30 = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
#: Powers of a base that a worker keeps at most; tables for longer sequences are made anew.
KEPT_POWERS = 1 << 20
#: Bytes whose words are hashed together, about.
HASH_BYTES = 1 << 20
_POWERS: dict[int, np.ndarray] = {}


def new_seed(spark) -> int:
    """128 random bits, drawn once by the driver of an application; they go to workers with the functions that use them."""
    sc = spark.sparkContext
    if getattr(sc, "_docquarry_seed", None) is None:
        sc._docquarry_seed = secrets.randbits(128)
    return sc._docquarry_seed


def _bases(seed: int) -> tuple[int, int]:
    """Two independent bases for a seed."""
    raw = hashlib.blake2b(seed.to_bytes(16, "little"), digest_size=32).digest()
    return tuple(int.from_bytes(raw[i : i + 16], "little") % (_P - 1000) + 500 for i in (0, 16))


def _fold(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, for any uint64."""
    x = (x >> np.uint64(61)) + (x & PRIME)
    return np.where(x >= PRIME, x - PRIME, x)


def mulmod(a: np.ndarray, b) -> np.ndarray:
    """a * b modulo PRIME, both below PRIME."""
    b = np.asarray(b, np.uint64)
    a1, a0, b1, b0 = a >> np.uint64(31), a & _LOW31, b >> np.uint64(31), b & _LOW31
    mid = a0 * b1 + a1 * b0
    return _fold(a1 * b1 * np.uint64(2) + (mid >> np.uint64(30)) + ((mid & _LOW30) << np.uint64(31)) + a0 * b0)


def powers(base: int, n: int) -> np.ndarray:
    """base**i modulo PRIME for i in range(n + 1) at least."""
    got = _POWERS.get(base)
    if got is None or len(got) <= n:
        size = 1 << max(12, int(n + 1).bit_length())
        got = np.ones(size, np.uint64)
        have = 1
        while have < size:
            got[have : 2 * have] = mulmod(got[:have], np.uint64(pow(base, have, _P)))
            have *= 2
        if size <= 2 * KEPT_POWERS:
            _POWERS[base] = got
    return got


class Rolling:
    """Hashes of any slices of a sequence: two polynomials modulo 2**61 - 1 at random bases, from prefix sums.

    Two different slices of n elements have one pair of hashes with a chance of (n / 2**61)**2 at most over the choice of
    the bases, whatever the input. Elements are below 2**61 and not 0; `second` are the elements of the other polynomial.
    """

    #: Elements whose products are summed before a reduction: 2**20 products of 31 by 31 bits stay below 2**64 in halves.
    BLOCK = 1 << 20

    def __init__(self, values: np.ndarray, seed: int, second: np.ndarray | None = None):
        self.n = n = len(values)
        self.sums = []
        for base, v in zip(_bases(seed), (values, values if second is None else second), strict=True):
            v = v.astype(np.uint64, copy=False)
            up = powers(base, n)
            if n and int(v.max()) >> 12:
                x = mulmod(v, up[:n])
                high, low = x >> np.uint64(31), x & _LOW31
            else:
                high, low = v * (up[:n] >> np.uint64(31)), v * (up[:n] & _LOW31)
            h, s, carry = np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.uint64), [0]
            for a in range(0, max(n, 1), self.BLOCK):
                b = min(n, a + self.BLOCK)
                np.cumsum(high[a:b], out=h[a + 1 : b + 1])
                np.cumsum(low[a:b], out=s[a + 1 : b + 1])
                carry.append((carry[-1] + (int(h[b]) << 31) + int(s[b])) % _P)
            self.sums.append((base, up, h, s, np.array(carry, np.uint64)))

    def _prefix(self, h, s, carry, at: np.ndarray) -> np.ndarray:
        high = _fold(h[at])
        turned = ((high & _LOW30) << np.uint64(31)) + (high >> np.uint64(30))  # times 2**31
        own = _fold(_fold(turned) + _fold(s[at]))
        if len(carry) > 2:
            own = _fold(own + carry[np.maximum(at - 1, 0) // self.BLOCK])
        return own

    def of(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both hashes of each slice [start, end), independent of where it stands."""
        out = []
        for base, up, h, s, carry in self.sums:
            x = _fold(self._prefix(h, s, carry, end) + (PRIME - self._prefix(h, s, carry, start)))
            x = mulmod(x, up[self.n - start])
            out.append(mulmod(x, np.uint64(pow(base, -self.n, _P))))
        return out[0], out[1]


def name64(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """One well mixed 64-bit name for a pair of hashes."""
    return mix64(first ^ mix64(second))


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of a UTF-8 text (uint8)."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~_IS_SPACE[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


def word_hashes(data: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and both hashes of the words; a megabyte or one word at a time."""
    a, b = word_bounds(data)
    first, second = np.zeros(len(a), np.uint64), np.zeros(len(a), np.uint64)
    k = 0
    while k < len(a):
        m = max(k + 1, int(np.searchsorted(b, a[k] + HASH_BYTES, "right")))
        base = a[k]
        roll = Rolling(data[base : b[m - 1]].astype(np.uint64) + np.uint64(1), seed)
        first[k:m], second[k:m] = roll.of(a[k:m] - base, b[k:m] - base)
        k = m
    return a, b, first, second


def arrow_bytes(column) -> list:
    """The UTF-8 bytes of a string column as uint8 views without a copy; null is empty."""
    import pyarrow as pa

    out = []
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if pa.types.is_string(chunk.type):
            chunk = chunk.cast(pa.large_string())
        if not len(chunk):
            continue
        offsets = np.frombuffer(chunk.buffers()[1], np.int64)[chunk.offset : chunk.offset + len(chunk) + 1]
        data = np.frombuffer(chunk.buffers()[2], np.uint8) if chunk.buffers()[2] else np.zeros(0, np.uint8)
        out.extend(data[offsets[i] : offsets[i + 1]] for i in range(len(chunk)))
    return out


def spare() -> None:
    """Give freed memory back to the system between groups or after a task; a worker takes one after the other."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
