"""Best-fit packing of documents into sequences, under conflicts.

Bins stand in order of their residual; each duplicate cluster has a bitmap of the bins that hold a piece of it, each source
a bitmap of the bins that hold SOURCE_LIMIT pieces of it. A piece goes to the tightest bin with room: the search starts at
the least residual that fits and goes on to the successors until one has a compatible bin, which is one that has no piece
of the same duplicate cluster from another document and fewer than SOURCE_LIMIT of the same source. All bins of a
residual are tried at once, as a bitmap without the bits of both conflicts, so many conflicting bins cost no more than few.

Without a compatible bin a new one opens, as long as the bins are fewer than the words need at FILL. Beyond that a source's
limit gives way (a source that holds most of the words can't be spread): the search runs again under clusters alone, and
only if that fails too a bin opens. Duplicates never share a bin.

Documents are cut into pieces of at most the capacity. Groups of documents, by a hash of doc_id, are packed apart, each of
about GROUP_BINS bins, so work spreads and the loss is at most the last bins of each group. Pieces go largest first.

Edge cases: null or empty texts have no words and get no piece. A null source is a source of its own. Rows with a null
doc_id are packed like others, in groups by a hash of their texts. Repeated rows are pieces of the same cluster, so they
never share a bin. An empty table gives an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from docquarry.llm.common import SPACE_CLASS, text_or_empty
from docquarry.session import ship

CAPACITY = 2048
SOURCE_LIMIT = 8
GROUP_BINS = 1000
#: Share of the bins' room that must be filled before a source's limit gives way.
FILL = 0.97


class Bins:
    """Open bins and their conflicts; most: bins that may open while sources' limits hold."""

    def __init__(self, capacity: int, source_limit: int, most: float):
        self.capacity, self.limit, self.most = capacity, source_limit, most
        self.at = [0] * (capacity + 1)  # for each residual a bitmap of its bins
        self.some = 0  # bit r: there are bins of residual r
        self.free: list[int] = []
        self.held: dict = {}  # of a cluster: bins with a piece of it
        self.planes: dict = {}  # of a source: plane i has the bins with more than i pieces of it

    def place(self, size: int, source, cluster) -> tuple[int, int]:
        """Bin and offset for a piece; cluster None: nothing conflicts."""
        no = self.held.get(cluster, 0) if cluster is not None else 0
        planes = self.planes.get(source)
        if planes is None:
            planes = self.planes[source] = [0] * self.limit
        b = self._find(size, no | planes[-1])
        if b < 0 and len(self.free) >= self.most and planes[-1]:
            b = self._find(size, no)
        if b < 0:
            b = len(self.free)
            self.free.append(self.capacity)
        else:
            r = self.free[b]
            self.at[r] ^= 1 << b
            if not self.at[r]:
                self.some ^= 1 << r
        bit, offset = 1 << b, self.capacity - self.free[b]
        left = self.free[b] = self.free[b] - size
        if cluster is not None:
            self.held[cluster] = no | bit
        for plane, had in enumerate(planes):
            planes[plane] |= bit
            if not had & bit:
                break
        if left:
            self.at[left] |= bit
            self.some |= 1 << left
        return b, offset

    def _find(self, size: int, no: int) -> int:
        """The first compatible bin of the least residual that has one, or -1."""
        above, r = self.some >> size, size
        while above:
            step = (above & -above).bit_length() - 1
            r += step
            ok = self.at[r] & ~no
            if ok:
                return (ok & -ok).bit_length() - 1
            above >>= step + 1
            r += 1
        return -1


def pack_group(rows: list[tuple], capacity: int = CAPACITY, source_limit: int = SOURCE_LIMIT, fill: float = FILL) -> list[tuple[int, int, int, int, int]]:
    """(row number, piece, bin, offset, size) for rows of (n_words, source, cluster)."""
    pieces = []
    for i, (n, _, _) in enumerate(rows):
        pieces += [(min(capacity, n - a), i, a // capacity) for a in range(0, n, capacity)]
    pieces.sort(key=lambda x: (-x[0], x[1], x[2]))
    count: dict = {}
    for _, _, c in rows:
        count[c] = count.get(c, 0) + 1
    bins, out = Bins(capacity, source_limit, sum(x[0] for x in pieces) / capacity / fill), []
    for size, i, piece in pieces:
        _, s, c = rows[i]
        b, offset = bins.place(size, s, c if count[c] > 1 else None)
        out.append((i, piece, b, offset, size))
    return out


def _pack(capacity: int, source_limit: int):
    def run(key, table):
        group = int(key[0].as_py())
        table = table.sort_by([("n_words", "descending"), ("doc_id", "ascending"), ("cluster", "ascending")])
        rows = list(zip(table["n_words"].to_pylist(), table["source"].to_pylist(), table["cluster"].to_pylist(), strict=True))
        got = pack_group(rows, capacity, source_limit)
        take = table.take(pa.array([x[0] for x in got], pa.int64()))
        column = lambda k, kind: pa.array([x[k] for x in got], kind)
        return pa.table({
            "doc_id": take["doc_id"], "piece": column(1, pa.int32()), "pack_group": pa.array([group] * len(got), pa.int64()),
            "bin": column(2, pa.int64()), "bin_offset": column(3, pa.int32()), "n_words": column(4, pa.int32()), "source": take["source"],
        })

    return run


def groups_for(n_bytes: int, capacity: int = CAPACITY) -> int:
    """Groups for a table of n_bytes of text, at six bytes a word."""
    return max(1, int(n_bytes / 6 / capacity / GROUP_BINS))


def pack_table(documents: DataFrame, capacity: int = CAPACITY, source_limit: int = SOURCE_LIMIT) -> DataFrame:
    """A row for each piece: doc_id, piece, pack_group, bin, bin_offset, n_words, source."""
    spark = documents.sparkSession
    ship(spark)
    text = text_or_empty()
    # words without a split into strings: a blank before the text, then the starts of words
    starts = F.regexp_count(F.concat(F.lit(" "), text), F.lit(SPACE_CLASS + "(?=[^\\x20\\x09-\\x0D])"))
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), starts.cast("long").alias("n_words"),
        F.xxhash64(F.regexp_replace(text, SPACE_CLASS + "+", " ")).alias("cluster"),
    ).where("n_words > 0")
    total = documents.select(F.octet_length("text").alias("n")).agg(F.sum("n")).first()[0] or 0
    keyed = rows.withColumn("g", F.pmod(F.xxhash64(F.coalesce("doc_id", "cluster")), F.lit(groups_for(total, capacity))))
    return keyed.groupBy("g").applyInArrow(_pack(capacity, source_limit), "doc_id long, piece int, pack_group long, bin long, bin_offset int, n_words int, source string")
