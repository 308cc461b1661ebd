"""N-gram Jaccard join: all pairs of texts whose five-word shingle sets have a similarity of 0.8 or more.

1. Each text becomes the set of its five-word shingles (a text of one to four words has one shingle: all its words). Texts
   with the same set form a class with one representative, so copies are never expanded into pairs.
2. MinHash bands of the representatives group them into buckets; a bucket is kept as links to its smallest member, never
   as pairs. Connected components of those links hold every pair that shares a bucket.
3. Each component is cut into blocks by shingle count (a similarity of t needs sizes within a factor t) and by hash. A
   task gets two blocks, or several small components, and looks at each pair in them once: MinHash values are compared in
   steps, and a pair is dropped when, by the beta posterior of its similarity, the chance of reaching the threshold falls
   below TOLERANCE. What is left is verified exactly on the shingle sets, whose shingles a task numbers by their
   words and not by hashes. Tasks return counts and a spanning forest.
4. Components of the verified links give the classes of near copies.

Two texts at the threshold share no band with a chance of (1 - 0.8**ROWS)**BANDS = 3e-6; larger similarities less.

Edge cases: null and empty texts have no shingle and no link; each is its own class. Exact repeats of a text link to each
other. Each row is a document of its own: repeated rows of a doc_id, and rows without one, have a result each, and link to
each other like any others. class_id is the doc_id of the class's first row (smallest doc_id, null ones last). An empty table
gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from docquarry.llm.common import GOLDEN, HASH_BYTES, Rolling, arrow_bytes, fetch_texts, join_unique, mix64, name64, new_seed, numbered, spare, word_hashes
from docquarry.llm.components import components
from docquarry.session import ship, spread, stash

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 42, 6
#: A pair is dropped when its chance of reaching the threshold is below this.
TOLERANCE = 1e-9
STEP = 28
#: Texts in a block; a task holds two blocks.
BLOCK = 256
_RNG = np.random.default_rng(20240229)
_MUL = (_RNG.integers(0, 1 << 32, BANDS * ROWS, np.uint32) | np.uint32(1))[:, None]
_ADD = _RNG.integers(0, 1 << 32, BANDS * ROWS, np.uint32)[:, None]


def shingles(texts: list[np.ndarray], seed: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit names of each text's shingles; texts are hashed about a megabyte at a time."""
    out: list[np.ndarray] = []
    blank, a = np.array([0x20], np.uint8), 0
    while a < len(texts):
        b, size = a, 0
        while b < len(texts) and (b == a or size + len(texts[b]) < HASH_BYTES):
            size += len(texts[b]) + 1
            b += 1
        starts, _, h, g = word_hashes(np.concatenate([x for t in texts[a:b] for x in (t, blank)]), seed)
        ends = np.cumsum([len(t) + 1 for t in texts[a:b]])
        cut = np.concatenate([[0], np.searchsorted(starts, ends)])
        roll, n = Rolling(h, seed, g), np.diff(cut)
        # all runs of five words, and the whole of texts with fewer; runs over two texts are left out
        at = np.arange(max(len(h) - SHINGLE + 1, 0))
        five = name64(*roll.of(at, at + SHINGLE))
        whole = name64(*roll.of(cut[:-1], cut[1:]))
        for k, m in enumerate(n.tolist()):
            out.append(np.unique(five[cut[k] : cut[k + 1] - SHINGLE + 1]) if m >= SHINGLE else whole[k : k + 1] if m else whole[:0])
        a = b
    return out


def exact_shingles(texts: list[np.ndarray]) -> list[np.ndarray]:
    """Sorted distinct numbers of each text's shingles; equal numbers stand for equal words, in all of these texts."""
    number: dict[bytes, int] = {}
    short: dict[bytes, int] = {}
    words, sizes = [], []
    for data in texts:
        own = data.tobytes().split()  # the same white space as word_bounds()
        words.append(np.fromiter((number.setdefault(w, len(number)) for w in own), np.int64, len(own)))
        sizes.append(len(own))
    flat = np.concatenate([*words, np.zeros(0, np.int64)])
    pair = lambda a, b: np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1]
    two = pair(flat[:-1], flat[1:])
    four = pair(two[:-2], two[2:])
    five = pair(four[:-1], flat[SHINGLE - 1 :])
    out, at = [], 0
    for k, n in enumerate(sizes):
        if n >= SHINGLE:
            out.append(np.unique(five[at : at + n - SHINGLE + 1]))
        elif n:
            out.append(np.array([-1 - short.setdefault(b" ".join(texts[k].tobytes().split()), len(short))]))
        else:
            out.append(np.zeros(0, np.int64))
        at += n
    return out


def signature(names: np.ndarray) -> np.ndarray:
    """MinHash values (uint32) of a set."""
    h = (names >> np.uint64(16)).astype(np.uint32)
    out = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for a in range(0, len(h), 1024):
            x = h[a : a + 1024] * _MUL
            x += _ADD
            x ^= x >> np.uint32(15)
            np.minimum(out, x.min(axis=1), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each row of signatures."""
    with np.errstate(over="ignore"):
        bands = sig.reshape(-1, BANDS, ROWS).astype(np.uint64)
        key = np.zeros(bands.shape[:2], np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * GOLDEN
        for r in range(ROWS):
            key = mix64(key ^ bands[:, :, r])
    return key


def digest_of(names: np.ndarray) -> bytes | None:
    """Of a set of shingles; None for the empty set."""
    return hashlib.blake2b(names.tobytes(), digest_size=16).digest() if len(names) else None


def _describe(seed: int):
    def run(batches):
        for batch in batches:
            count, digest, sigs = [], [], []
            for s in shingles(arrow_bytes(batch["text"]), seed):
                count.append(len(s))
                digest.append(digest_of(s))
                if len(s):
                    sigs.append(signature(s))
            flat = band_keys(np.stack(sigs)).view(np.int64) if sigs else np.zeros((0, BANDS), np.int64)
            offsets = np.concatenate([[0], np.cumsum((np.array(count, np.int64) > 0) * BANDS)]).astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(count, pa.int32()), pa.array(digest, pa.binary()), keys], names=["doc_id", "n_shingles", "digest", "keys"])
        spare()

    return run


def least_matches(steps, total: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """For each number of compared values, the least matches with which P(similarity >= threshold) >= tolerance.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), whose upper tail is a binomial sum.
    """
    out = {}
    for n in steps:
        tail, least = 0.0, 0
        for m in range(n + 1):  # P(J >= t | m of n) = P(Binomial(n + 1, t) <= m)
            tail += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * math.log(threshold) + (n + 1 - m) * math.log(1 - threshold))
            if tail >= tolerance:
                least = m
                break
        out[n] = least
    return out


_LEAST = least_matches(range(STEP, BANDS * ROWS + 1, STEP), BANDS * ROWS)


def surviving(sig_a: np.ndarray, sig_b: np.ndarray, upper: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of a, row of b) that Bayesian pruning lets through; upper: a is b, take each pair once."""
    i, j = np.triu_indices(len(sig_a), 1) if upper else (x.ravel() for x in np.indices((len(sig_a), len(sig_b))))
    same = np.zeros(len(i), np.int32)
    for n in range(STEP, BANDS * ROWS + 1, STEP):
        if not len(i):
            break
        for c in range(n - STEP, n):
            same += sig_a[i, c] == sig_b[j, c]
        keep = same >= _LEAST[n]
        i, j, same = i[keep], j[keep], same[keep]
    return i, j


def links(sets_a: list[np.ndarray], sets_b: list[np.ndarray], sig_a: np.ndarray, sig_b: np.ndarray, upper: bool):
    """Exactly verified pairs between two blocks."""
    i, j = surviving(sig_a, sig_b, upper)
    if not len(i):
        return i, j
    if len(i) < 40:
        both = np.array([len(np.intersect1d(sets_a[x], sets_b[y], assume_unique=True)) for x, y in zip(i, j, strict=True)])
    else:
        ua, ub = np.unique(i), np.unique(j)
        pos_a, pos_b = np.zeros(len(sets_a), np.int64), np.zeros(len(sets_b), np.int64)
        pos_a[ua], pos_b[ub] = np.arange(len(ua)), np.arange(len(ub))
        va, vb = np.concatenate([sets_a[x] for x in ua]), np.concatenate([sets_b[x] for x in ub])
        ra, rb = np.repeat(np.arange(len(ua)), [len(sets_a[x]) for x in ua]), np.repeat(np.arange(len(ub)), [len(sets_b[x]) for x in ub])
        names = np.intersect1d(va, vb)
        ca, cb = np.searchsorted(names, va), np.searchsorted(names, vb)
        ok_a, ok_b = names[np.minimum(ca, len(names) - 1)] == va, names[np.minimum(cb, len(names) - 1)] == vb
        ca, ra, cb, rb = ca[ok_a], ra[ok_a], cb[ok_b], rb[ok_b]
        common = np.zeros((len(ua), len(ub)), np.float32)
        oa, ob = np.argsort(ca, kind="stable"), np.argsort(cb, kind="stable")
        ca, ra, cb, rb = ca[oa], ra[oa], cb[ob], rb[ob]
        for a in range(0, len(names), 4096):  # exact: counts stay far below 2**24
            x, y = np.zeros((len(ua), 4096), np.float32), np.zeros((len(ub), 4096), np.float32)
            s = slice(*np.searchsorted(ca, [a, a + 4096]))
            t = slice(*np.searchsorted(cb, [a, a + 4096]))
            x[ra[s], ca[s] - a] = 1
            y[rb[t], cb[t] - a] = 1
            common += x @ y.T
        both = common[pos_a[i], pos_b[j]].astype(np.int64)
    size_a, size_b = np.array([len(x) for x in sets_a]), np.array([len(x) for x in sets_b])
    ok = both >= THRESHOLD * (size_a[i] + size_b[j] - both) - 1e-9
    return i[ok], j[ok]


class _Forest:
    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def link(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def _linker(seed: int):
    return lambda table: _pairs_of(table, seed)


def _pairs_of(table: pa.Table, seed: int) -> pa.Table:
    """All links in one task's rows: per text its number of links (texts, documents) and a root of the local forest."""
    spare()
    ids, comp, block = table["doc_id"].to_numpy(), table["comp"].to_numpy(), table["block"].to_numpy()
    pair, n = table["pair"].to_numpy(), table["n"].to_numpy()
    sig = np.stack([signature(s) for s in shingles(arrow_bytes(table["text"]), seed)])
    sets = exact_shingles(arrow_bytes(table["text"]))
    texts, docs, forest = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64), _Forest()

    def note(a: np.ndarray, b: np.ndarray, upper: bool) -> None:
        i, j = links([sets[x] for x in a], [sets[x] for x in b], sig[a], sig[b], upper)
        i, j = a[i], b[j]
        np.add.at(texts, i, 1)
        np.add.at(texts, j, 1)
        np.add.at(docs, i, n[j])
        np.add.at(docs, j, n[i])
        for x, y in zip(ids[i].tolist(), ids[j].tolist(), strict=True):
            forest.link(x, y)

    order = np.lexsort((block, pair, comp))
    cut = np.flatnonzero((np.diff(comp[order]) != 0) | (np.diff(pair[order]) != 0)) + 1
    for rows in np.split(order, cut):
        sides = np.unique(block[rows])
        if pair[rows[0]] == 0:  # a whole component
            for a in range(0, len(rows), BLOCK):
                note(rows[a : a + BLOCK], rows[a : a + BLOCK], True)
                for b in range(a + BLOCK, len(rows), BLOCK):
                    note(rows[a : a + BLOCK], rows[b : b + BLOCK], False)
        elif pair[rows[0]] == 1:  # a block with itself
            note(rows, rows, True)
        elif len(sides) == 2:
            note(rows[block[rows] == sides[0]], rows[block[rows] == sides[1]], False)
    hit = np.flatnonzero(texts)
    return pa.table({"doc_id": ids[hit], "texts": texts[hit], "docs": docs[hit], "root": np.array([forest.root(x) for x in ids[hit].tolist()], np.int64)})


def jaccard_classes(documents: DataFrame) -> DataFrame:
    """A row for each document: doc_id, class_id (smallest doc_id linked to it, directly or not), n_links (documents
    with a similarity of THRESHOLD or more to it), n_text_links (different shingle sets among those), n_shingles."""
    rows, plain = numbered(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "row")
    out = _classes(rows.select(F.col("row").alias("doc_id"), "text"))
    if plain:
        return out
    names = rows.select("row", "doc_id")
    own = out.withColumnRenamed("doc_id", "row").join(names, "row")
    return own.join(names.select(F.col("row").alias("class_id"), F.col("doc_id").alias("first_id")), "class_id").select(
        "doc_id", F.col("first_id").alias("class_id"), "n_links", "n_text_links", "n_shingles")


def _classes(source: DataFrame) -> DataFrame:
    """jaccard_classes() of rows with a doc_id each of its own."""
    spark = source.sparkSession
    ship(spark)
    seed = new_seed(spark)
    described = stash(spread(source).mapInArrow(_describe(seed), "doc_id long, n_shingles int, digest binary, keys array<long>"), "shingled")
    has = described.where("digest is not null").select("doc_id", "digest", "n_shingles", "keys")
    classes = stash(has.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("n_shingles").alias("n_shingles"), F.first("keys").alias("keys")), "classes")
    banded = classes.select("rep", F.explode("keys").alias("key"))
    shared = banded.groupBy("key").agg(F.min("rep").alias("low"), F.count(F.lit(1)).alias("m")).where("m > 1")
    star = banded.join(shared, "key").where("rep != low").select(F.col("rep").alias("a"), F.col("low").alias("b"))
    members = stash(components(star, "candidates").join(classes.select(F.col("rep").alias("node"), "n", "n_shingles"), "node"), "members")
    n_members = members.count()
    tasks = _blocks(members, n_members)
    placed = fetch_texts(source, members.select(F.col("node").alias("doc_id")), n_members).join(tasks, "doc_id")
    found = stash(placed.groupBy("task").applyInArrow(_linker(seed), "doc_id long, texts long, docs long, root long"), "links")
    counted = found.groupBy("doc_id").agg(F.sum("texts").alias("n_text_links"), F.sum("docs").alias("docs"))
    rooted = components(found.select(F.col("doc_id").alias("a"), F.col("root").alias("b")), "classes")
    verdict = (
        classes.select("digest", "rep", "n").join(counted.withColumnRenamed("doc_id", "rep"), "rep", "left").join(rooted.withColumnRenamed("node", "rep"), "rep", "left")
        .select("digest", "n", F.coalesce("root", "rep").alias("class_id"), (F.coalesce("docs", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("n_text_links", F.lit(0)).alias("n_text_links"))
    )
    mine = described.select("doc_id", "digest", "n_shingles")
    out = join_unique(mine.where("digest is not null"), stash(verdict, "verdict"), ["digest"], "n", described.count()).select("doc_id", "class_id", "n_links", "n_text_links", "n_shingles")
    none = mine.where("digest is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("n_text_links"), "n_shingles")
    return out.unionByName(none)


def _blocks(members: DataFrame, n_members: int) -> DataFrame:
    """Where each text goes: doc_id, n, comp, block, pair (0 whole component, 1 own block, more: two blocks), task."""
    size = members.groupBy("root").agg(F.count(F.lit(1)).alias("m"))
    m = members.join(size, "root")
    spread = F.lit(max(1, -(-n_members // (2 * BLOCK))))
    small = m.where(F.col("m") <= 2 * BLOCK).select(
        F.col("node").alias("doc_id"), "n", F.col("root").alias("comp"), F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("pair"),
        F.pmod(F.xxhash64("root"), spread).alias("task"))
    # sizes within a factor THRESHOLD of each other are in the same or in neighbouring classes
    width = -math.log(THRESHOLD) * 1.0000001
    large = m.where(F.col("m") > 2 * BLOCK).withColumn("size", F.floor(F.log(F.col("n_shingles").cast("double")) / F.lit(width)))
    per = large.groupBy("root", "size").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).alias("cuts"))
    nxt = per.select("root", (F.col("size") - 1).alias("size"), F.col("cuts").alias("cuts_up"))
    prv = per.select("root", (F.col("size") + 1).alias("size"), F.col("cuts").alias("cuts_down"))
    plan = per.join(nxt, ["root", "size"], "left").join(prv, ["root", "size"], "left")
    cut = large.join(plan, ["root", "size"]).withColumn("cut", F.pmod(F.xxhash64("node", F.lit(7)), F.col("cuts")))
    name = lambda size, cut: F.xxhash64("root", size, cut)
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<long>"))
    own = F.struct(F.col("size"), F.col("cut"))
    low = lambda a, b: F.struct(F.least(a, b).alias("x"), F.greatest(a, b).alias("y"))
    mates = F.concat(
        F.transform(upto(F.col("cuts")), lambda c: low(own, F.struct(F.col("size"), c.alias("cut")))),
        F.transform(upto(F.coalesce("cuts_up", F.lit(0))), lambda c: low(own, F.struct((F.col("size") + 1).alias("size"), c.alias("cut")))),
        F.transform(upto(F.coalesce("cuts_down", F.lit(0))), lambda c: low(own, F.struct((F.col("size") - 1).alias("size"), c.alias("cut")))),
    )
    pairs = cut.select("node", "n", "root", name(F.col("size"), F.col("cut")).alias("block"), F.explode(mates).alias("p"))
    big = pairs.select(
        F.col("node").alias("doc_id"), "n", F.col("root").alias("comp"), "block",
        F.when(F.col("p.x") == F.col("p.y"), F.lit(1).cast("long")).otherwise(F.shiftrightunsigned(F.xxhash64("p"), 1) + F.lit(2)).alias("pair"),
        F.xxhash64("root", "p").alias("task"))
    return small.unionByName(big)
