"""The corpus operators against brute force, and their edge cases."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.llm import bpe, covertree, exact_dedup, fuse, jaccard, langid, packing, queries, recompress, repeats, suffix_dedup, toxicity, wordpiece
from docquarry.llm.components import components
from docquarry.llm.suffixes import sorted_suffixes
from tests.oracle import same

SF = "/root/testdata/sf0.001"
#: null and empty texts, one letter, blanks, ties, repeats within a text, a long text, code points of four bytes.
ODD = [
    (0, None), (1, ""), (2, "a"), (3, " \t\n "), (4, "a b c d"), (5, "a  b\tc d"), (6, "x " * 400), (7, "x " * 300), (8, "né 𝔘 " * 60), (9, "né 𝔘 " * 60),
    (10, "".join(chr(97 + i * 7 % 26) for i in range(120))), (11, "zz" + "".join(chr(97 + i * 7 % 26) for i in range(120))), (12, "w" * 20000),
]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, key int, kept boolean, part int, score double"


def docs(spark, rows):
    """documents with extra columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", 0, "x", 1, True, 2, 0.5) for i, t in rows], DOCS)


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def random_rows(seed, n=70):
    rng = random.Random(seed)
    text = lambda k, v: " ".join(rng.choice(v) for _ in range(k))
    few, many = ["a", "b"], [f"w{i}é" for i in range(60)]
    shared = [text(60, many) for _ in range(5)]
    make = lambda: " ".join(rng.choice([text(rng.randint(1, 40), few), text(rng.randint(1, 60), many), rng.choice(shared), rng.choice(shared)[17:250]]) for _ in range(rng.randint(1, 8)))
    return [(100 + i * 7 % 1009, make()) for i in range(n)]


@pytest.mark.parametrize("name", ["op2_suffix_array_dedup", "op4_exact_top_k", "op5_substring_dedup", "op6_exact_dedup", "op10_ngram_jaccard"])
def test_query_equals_oracle(spark, name):
    same(spark, name, queries.queries(), queries.oracle_sql(), SF)


# --- 1, 8


def ranks():
    with open(queries.vocabulary(), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def test_bpe_equals_tiktoken(spark):
    import public_tokenizers as P
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks(), special_tokens={})
    rng = random.Random(1)
    rows = ODD + [(100 + i, "".join(rng.choice("aeinrst thEΣ1.\n'") for _ in range(rng.randint(1, 300)))) for i in range(60)] + [(200, "ab" * 3000), (201, "".join(rng.choice("et") for _ in range(3000))), (202, "<|endoftext|>")]
    want = []
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = bpe.encode_table(docs(spark, rows), queries.vocabulary(), P.PATTERN)
    assert rows_of(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    ids = bpe.encode_ids(docs(spark, rows[:20]), queries.vocabulary(), P.PATTERN)
    assert rows_of(bpe.decode_ids(ids, queries.vocabulary()), "doc_id", "bytes") == sorted(((i, bytearray((t or "").encode())) for i, t in rows[:20]), key=repr)
    assert bpe.encode_table(docs(spark, []), queries.vocabulary(), P.PATTERN).count() == 0


def brute_count(word, vocabulary):
    """Greedy longest match that tries each length."""
    longest, n, at = max(map(len, vocabulary)), 0, 0
    while at < len(word):
        at += next(k for k in range(min(longest, len(word) - at), 0, -1) if word[at : at + k] in vocabulary)
        n += 1
    return n


def test_wordpiece_equals_longest_match(spark):
    vocabulary = ranks()
    auto = wordpiece.Automaton(vocabulary)
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh éß1") for _ in range(rng.randint(1, 30))).encode() for _ in range(2000)]
    assert [auto.count(w) for w in words] == [brute_count(w, vocabulary) for w in words]
    got = rows_of(wordpiece.count_table(docs(spark, ODD), queries.vocabulary()), "doc_id", "n_words", "n_pieces")
    want = [(i, len(w := wordpiece.WORD.findall(t or "")), sum(brute_count(b" " + x.encode(), vocabulary) for x in w)) for i, t in ODD]
    assert got == sorted(want, key=repr)
    assert rows_of(wordpiece.count_table(docs(spark, [(None, "a"), (1, "b"), (1, "b")]), queries.vocabulary()), "doc_id", "n_words") == [(1, 1), (1, 1), (None, 1)]
    assert wordpiece.count_table(docs(spark, []), queries.vocabulary()).count() == 0


# --- 2, 5


def brute_bytes(rows, width=50):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - width + 1):
            first[b[k : k + width]] = min(i, first.get(b[k : k + width], i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if first[b[k : k + width]] < i:
                gone[k : k + width] = b"\1" * width
        out.append((i, len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(bytes(x for x, y in zip(b, gone) if not y)).hexdigest()))
    return sorted(out, key=repr)


def brute_words(rows, width=20):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    first, out = {}, []
    for i in sorted(words):
        for k in range(len(words[i]) - width + 1):
            first.setdefault(tuple(words[i][k : k + width]), (i, k))
    for i, w in words.items():
        gone = [0] * len(w)
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < (i, k):
                gone[k : k + width] = [1] * width
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, y in zip(w, gone) if not y).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup(spark, seed):
    rows = ODD + random_rows(seed)
    assert rows_of(suffix_dedup.dedup_bytes(docs(spark, rows).repartition(3)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_bytes(rows)
    assert rows_of(recompress.dedup_words(docs(spark, rows).repartition(3)), "doc_id", "n_words", "n_removed", "kept_sha256") == brute_words(rows)


def thue_morse(n):
    """Words on which polynomial hashes modulo 2**64 collide, whatever the base."""
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_words_that_defeat_a_hash_modulo_a_power_of_two(spark):
    a, b = thue_morse(10)
    head, tail = [f"w{i}" for i in range(10)], [f"v{i}" for i in range(20)]
    rows = [(1, " ".join([*head, a, *tail])), (2, " ".join([*head, b, *tail])), (3, a + a + b), (4, b + b + a), (5, a), (6, b)]
    assert rows_of(recompress.dedup_words(docs(spark, rows)), "doc_id", "n_words", "n_removed", "kept_sha256") == brute_words(rows)
    assert rows_of(suffix_dedup.dedup_bytes(docs(spark, rows)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_bytes(rows)
    assert rows_of(jaccard.jaccard_classes(docs(spark, rows)), "doc_id", "class_id", "n_links") == brute_links(rows)


def test_substring_dedup_nulls_and_repeats(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = docs(spark, [(None, text), (None, text), (3, text), (3, text)])
    assert rows_of(recompress.dedup_words(rows), "doc_id", "n_removed") == [(3, 0), (3, 0), (None, 40), (None, 40)]
    assert rows_of(suffix_dedup.dedup_bytes(rows), "doc_id", "n_spans") == [(3, 0), (3, 0), (None, 1), (None, 1)]
    for f in (recompress.dedup_words, suffix_dedup.dedup_bytes):
        assert f(docs(spark, [])).count() == 0


@pytest.mark.parametrize("local, hot, limit", [(16, 512, 10**7), (0, 512, 500), (16, 0, 100), (1, 2, 10**7)])
def test_long_texts_are_cut_with_an_overlap(monkeypatch, local, hot, limit):
    """Documents above PIECE go through in pieces, runs of hot anchors window by window; results are those of whole documents."""
    import pyarrow as pa

    rows = ODD[:12] + random_rows(3, 30)
    for module in (repeats, recompress, suffix_dedup):
        monkeypatch.setattr(module, "PIECE", 400)
    for name, value in (("CHUNK", 300), ("LOCAL_RUNS", local), ("HOT_RUNS", hot), ("STORE", limit)):
        monkeypatch.setattr(repeats, name, value)
    for op, want in ((suffix_dedup.ByteWindows(7, limit=limit), brute_bytes(rows)), (recompress.WordWindows(7), brute_words(rows))):
        table = pa.table({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "own_id": pa.array([i for i, _ in rows], pa.int64()), "text": pa.array([t or "" for _, t in rows])})
        scalar = lambda *x: tuple(pa.scalar(v) for v in x)
        sent = [b for batch in table.to_batches() for out in repeats._entries(op, 3, 1)([batch]) for b in out.to_pylist()]

        def grouped(wires, f):
            groups = collections.defaultdict(list)
            for r in wires:
                groups[r["kind"], r["part"]].append((r["kind"], r["part"], r["blob"]))
            return [r for key, own in groups.items() for r in f(scalar(*key), repeats.wire(own)).to_pylist()]

        def streamed(f):
            return lambda key, table: pa.Table.from_batches(list(f(key, iter(table.to_batches()))), repeats._WIRE)

        def of(wires):
            return repeats.wire([(r["kind"], r["part"], r["blob"]) for r in wires])

        held = pa.table({"blob": [repeats.pack_texts(np.array([i for i, _ in rows]), np.ones(len(rows), np.uint8), [np.frombuffer((t or "").encode(), np.uint8) for _, t in rows])]})
        replies = grouped(sent, repeats._answer(op, 1))
        wanted = repeats._send(op, 3)(scalar(0), held, of(replies)).to_pylist()
        assert local or any(r["kind"] == 2 for r in wanted)
        spans = grouped(wanted, streamed(repeats._compare(op, 1)))
        got = repeats._finish(op)(scalar(0), held, of(spans)).to_pylist()
        assert sorted((tuple(r.values()) for r in got), key=repr) == want


@pytest.mark.parametrize("text", ["w" * (repeats.SLICE + 1), " " * (repeats.PIECE + 1), "w" * repeats.PIECE + " x y"])
def test_long_text_of_few_words(spark, text):
    """A text above PIECE without a window of its own, alone in its batch."""
    want = [(1, len(text.split()), 0, hashlib.sha256(" ".join(text.split()).encode()).hexdigest())]
    assert rows_of(recompress.dedup_words(docs(spark, [(1, text)])), "doc_id", "n_words", "n_removed", "kept_sha256") == want


def check_suffixes(t, pos, lcp, depth):
    assert sorted(pos) == list(range(len(t)))
    for k, (a, b) in enumerate(zip(pos[:-1], pos[1:])):
        n = 0
        while n < depth and max(a, b) + n < len(t) and t[a + n] == t[b + n]:
            n += 1
        assert t[a : a + depth] <= t[b : b + depth] and lcp[k + 1] == n


def test_suffix_sorting():
    rng = random.Random(5)
    for _ in range(600):
        raw = [rng.randint(0, rng.choice([1, 3, 5])) for _ in range(rng.randint(1, 60))]
        depth, limit = rng.choice([3, 8, 50]), rng.choice([10**9, 5, 2])  # 5: queues go to disk
        t = [x + 1 for x in raw] + [0]
        pos, lcp = sorted_suffixes(np.array(t, np.uint16), depth, limit)
        check_suffixes(t, pos.tolist(), lcp.tolist(), depth)


def test_recursion_reaches_disk_at_each_level(monkeypatch):
    """With a tiny limit the strings of names are sorted through the disk-backed queue, level below level."""
    from docquarry.llm import suffixes

    rng, levels = random.Random(7), []
    order = suffixes.Names.order

    def noted(self, different):
        levels.append((len(self.t), isinstance(self.t, np.memmap)))
        return order(self, different)

    monkeypatch.setattr(suffixes.Names, "order", noted)
    some = [rng.randint(1, 3) for _ in range(400)]
    for t in ([*(some * 4), 0], [*([1, 2] * 700), 0], [*([1] * 300 + [2] * 300), 0], [rng.randint(1, 200) for _ in range(1500)] + [0]):
        del levels[:]
        pos, lcp = sorted_suffixes(np.array(t, np.uint16), 50, 20)
        check_suffixes(t, pos.tolist(), lcp.tolist(), 50)
        assert all(disk for n, disk in levels if n > 20)
        if t[:400] == some:
            assert len([n for n, _ in levels if n > 20]) >= 3


def test_sort_keeps_few_tuples_in_memory(monkeypatch):
    """Tuples of type L and the result go to disk beyond the limit, and results don't depend on it."""
    from docquarry.llm import suffixes

    rng, limit, most, blocks = random.Random(6), 64, [], []
    put, write = suffixes.Spool.put, suffixes.Spool._write

    def counted(self, pos, lcp):
        put(self, pos, lcp)
        most.append(self.inside)

    monkeypatch.setattr(suffixes.Spool, "put", counted)
    monkeypatch.setattr(suffixes.Spool, "_write", lambda self: (write(self), blocks.append(len(self.blocks))))
    s = np.array([rng.randint(1, 4) for _ in range(5000)] + [0], np.uint16)
    pieces = list(suffixes.suffix_pieces(s, 50, limit))
    assert max(len(p) for p, _ in pieces) <= limit and max(most) <= limit and len(blocks) > 100
    whole = sorted_suffixes(s, 50)
    assert all((np.concatenate(x) == y).all() for x, y in zip(zip(*pieces), whole))
    rows = random_rows(4, 40)
    contents, ids = [t.encode() for _, t in rows], np.array([i for i, _ in rows])
    zero, sizes, data = np.zeros(len(rows), np.int64), np.array([len(c) for c in contents]), np.frombuffer(b"".join(contents), np.uint8)

    def covered(limit):
        got = set()
        for doc, _, start, end in suffix_dedup.ByteWindows(7, limit=limit).compare(ids, zero, zero, sizes, data):
            got |= {(d, p) for d, a, b in zip(doc.tolist(), start.tolist(), end.tolist()) for p in range(a, b)}
        return got

    assert covered(10**7) == covered(200) != set()


# --- 3


def brute_packing(rows, capacity=2048, limit=8, fill=0.97):
    """The tightest compatible bin, the first of several, by trying all of them."""
    pieces = sorted(((min(capacity, n - a), i, a // capacity) for i, (n, _, _) in enumerate(rows) for a in range(0, n, capacity)), key=lambda x: (-x[0], x[1], x[2]))
    twins, most = collections.Counter(c for _, _, c in rows), sum(x[0] for x in pieces) / capacity / fill
    free, clusters, sources, out = [], [], [], []
    for size, i, piece in pieces:
        _, s, c = rows[i]
        fits = [b for b in range(len(free)) if free[b] >= size and (twins[c] == 1 or c not in clusters[b])]
        ok = [b for b in fits if sources[b].count(s) < limit] or (fits if len(free) >= most else [])
        if not ok:
            free.append(capacity), clusters.append([]), sources.append([])
            ok = [len(free) - 1]
        b = min(ok, key=lambda b: (free[b], b))
        out.append((i, piece, b, capacity - free[b], size))
        free[b] -= size
        clusters[b].append(c)
        sources[b].append(s)
    return out


def test_packing():
    rng = random.Random(4)
    for kinds, clusters, top in (("abc", 30, 5000), ("a", 10**6, 300), ("ab", 2, 500), ("abcdefghijkl", 40, 200)):
        rows = [(rng.randint(1, top), rng.choice(kinds), rng.randint(0, clusters)) for _ in range(400)]
        got = packing.pack_group(rows)
        assert got == brute_packing(rows)
        bins = collections.defaultdict(list)
        for i, _, b, offset, size in got:
            bins[b].append((offset, size, rows[i][2]))
        twins = collections.Counter(c for _, _, c in rows)
        for held in bins.values():
            held.sort()
            assert sum(s for _, s, _ in held) <= packing.CAPACITY
            assert all(a + s == b for (a, s, _), (b, _, _) in zip(held, held[1:]))
            again = [c for _, _, c in held if twins[c] > 1]
            assert len(again) == len(set(again))


def test_packing_of_one_source_and_of_copies():
    """Bins fill although one source holds all; many copies don't make the search slow."""
    import time

    rng, began = random.Random(5), time.perf_counter()
    rows = [(rng.randint(20, 60), "s", i) for i in range(50_000)]
    n = len({x[2] for x in packing.pack_group(rows)})
    assert sum(r[0] for r in rows) / n / packing.CAPACITY > 0.95
    assert len({x[2] for x in packing.pack_group([(30, "s", 1)] * 12_000)}) == 12_000
    assert time.perf_counter() - began < 20


def test_packing_query_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_BINS", 2)
    rows = ODD + random_rows(9, 90) + [(None, "a b"), (None, "a b"), (None, "c")]
    d = docs(spark, [(i, t) for i, t in rows]).withColumn("source", F.concat(F.lit("s"), F.pmod(F.col("doc_id"), F.lit(3))))
    groups = packing.groups_for(sum(len((t or "").encode()) for _, t in rows))
    norm = F.regexp_replace(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+", " ")
    held = d.withColumn("c", F.xxhash64(norm)).withColumn("g", F.pmod(F.xxhash64(F.coalesce("doc_id", "c")), F.lit(groups))).collect()
    want = []
    for g in range(groups):
        own = [(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")), r) for r in held if r["g"] == g]
        own = sorted([(n, r) for n, r in own if n], key=lambda x: (-x[0], x[1]["doc_id"] is None, x[1]["doc_id"], x[1]["c"]))
        for i, piece, b, offset, size in brute_packing([(n, r["source"], r["c"]) for n, r in own]):
            want.append((own[i][1]["doc_id"], piece, g, b, offset, size, own[i][1]["source"]))
    assert groups > 3
    assert rows_of(packing.pack_table(d), "doc_id", "piece", "pack_group", "bin", "bin_offset", "n_words", "source") == sorted(want, key=repr)
    assert packing.pack_table(docs(spark, [])).count() == 0


# --- 4


def brute_top(vectors, k, asked):
    """(query_id, rank, vec_id, score) of rows (id, integers); scores saturate at the ends of a long."""
    out = []
    for n, (i, x) in enumerate(vectors):
        if asked(i):
            found = sorted((-sum(a * b for a, b in zip(x, y)), j, m) for m, (j, y) in enumerate(vectors) if m != n and len(x) == len(y))
            out += [(i, r, j, max(-(2**63), min(2**63 - 1, -s))) for r, (s, j, _) in enumerate(found[:k], 1)]
    return sorted(out, key=repr)


def test_dual_tree():
    rng = np.random.default_rng(1)
    for it in range(40):
        n, d, k = int(rng.integers(1, 600)), int(rng.integers(1, 6)), int(rng.integers(1, 25))
        p = rng.integers(-5, 6, (n, d)) * (10**9 if it % 5 == 0 else 1)  # products beyond a long
        if it % 3 == 0:
            p[: n // 2] = p[0]  # a vector that half of all rows hold
        if it % 4 == 1:
            p += rng.integers(-1, 2, (1, d)) * 40 * (rng.integers(0, 3, (n, 1)))  # clusters
        ids, pick = rng.permutation(2000)[:n], rng.permutation(n)[:30]
        got = covertree.dual_top_k(p[pick], pick, p, ids, np.arange(n), k)
        for r, j in enumerate(pick):
            score = p.astype(object) @ p[j].astype(object)
            want = sorted((-int(score[t]), int(ids[t])) for t in range(n) if t != j)[:k]
            assert [(-s, i) for i, s in got[r]] == want


def test_cover_tree_invariants():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(300, 3)) * 0.1 + c for c in rng.normal(size=(9, 3)) * 5])
    tree, inner = covertree.CoverTree(x, leaf=8), 0
    away = lambda a, b: np.sqrt(((x[a] - x[b]) ** 2).sum(axis=-1))
    for at, kids in enumerate(tree.children):
        assert away(tree.rows[at], tree.centre[at]).max() <= tree.radius[at] + 1e-12
        if kids:
            inner += 1
            centres = np.array([tree.centre[c] for c in kids])
            assert sorted(np.concatenate([tree.rows[c] for c in kids])) == sorted(tree.rows[at])
            assert max(tree.radius[c] for c in kids) <= tree.radius[at] / 2 + 1e-12
            assert all(away(np.delete(centres, c), centres[c]).min() > tree.radius[at] / 2 for c in range(len(kids)))
    assert inner > 9


def test_pairs_of_nodes_are_dropped():
    """Far clusters: most products are never computed, on both levels."""
    rng = np.random.default_rng(3)
    centres = np.eye(8) * 1000
    x = np.floor(np.concatenate([rng.normal(size=(400, 8)) + c for c in centres])).astype(np.int64)
    search, seen = covertree.Search(x[::40], np.arange(0, len(x), 40), 5), []
    leaf = search._leaf
    search._leaf = lambda i, *a: (seen.append(len(search.tree.rows[i]) * len(a[4])), leaf(i, *a))
    search.add(x, np.arange(len(x)), np.arange(len(x)))
    assert sum(seen) < 0.3 * len(x) * len(search.q)
    stats = {8: (np.arange(8), np.full(8, 400), np.full(8, 5.0), np.ones(8, np.int64))}
    group = __import__("pyarrow").RecordBatch.from_pylist([{"dim": 8, "grp": 0, "chunk": 0, "radius": 5.0, "worst": 900_000.0}])
    pairs = lambda first: [r for b in covertree._pairs({8: centres}, {8: centres}, stats, 5, first)([group]) for r in b.to_pylist()]
    assert [r["cell"] for r in pairs(True)] == [0] and pairs(False) == []


@pytest.mark.parametrize("seed", [1, 2])
def test_top_k(spark, monkeypatch, seed):
    """Many cells, blocks, chunks and stripes; repeated ids; two lengths; a vector that a third of all rows hold; large numbers."""
    rng = np.random.default_rng(seed)
    for name, value in (("BLOCK_ROWS", 40), ("QUERY_ROWS", 8), ("STRIPE", 2), ("SAMPLE_ROWS", 60)):
        monkeypatch.setattr(covertree, name, value)
    x = rng.integers(-9, 10, (300, 4)) + 30 * rng.integers(-1, 2, (300, 1))
    x[:100] = x[0]
    if seed == 2:
        x = x * 10**9
    ids = rng.permutation(500)[:300].tolist()
    if seed == 1:
        ids[250:] = ids[200:250]  # repeated ids
    vectors = [(i, r.tolist()) for i, r in zip(ids, x)] + [(1000 + i, [i - 20, 3]) for i in range(40)] + [(2000, [5])]
    d = spark.createDataFrame([(*r, 1) for r in vectors], "vec_id long, v array<long>, rank int")
    got = covertree.top_k(d, F.col("vec_id") % 4 == 0, 7)
    assert rows_of(got, "query_id", "rank", "vec_id", "score") == brute_top(vectors, 7, lambda i: i % 4 == 0)


def test_top_k_odd_rows(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.5]), (1, None), (2, [None, 1.0]), (3, [nan, 1.0]), (4, [float("inf"), 1.0]), (5, [-0.3, 0.2]), (6, [0.9, 0.5]), (7, [0.9, 0.5]), (None, [1.0, 1.0]), (8, [1.0]), (9, [])]
    v = covertree.quantised(spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int"))
    got = rows_of(covertree.top_k(v, F.col("vec_id") % 5 == 0, 2), "query_id", "rank", "vec_id", "score")
    assert got == [(0, 1, 6, 64 * 57 + 32 * 32), (0, 2, 7, 64 * 57 + 32 * 32), (5, 1, 6, -20 * 57 + 12 * 32), (5, 2, 7, -20 * 57 + 12 * 32)]
    assert covertree.top_k(v.where("vec_id < 0"), F.col("vec_id") % 5 == 0, 2).count() == 0


# --- 6


def test_fuse_filters():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 10, 1000, 30000):
        keys = rng.integers(0, 2**63, n).astype(np.uint64)
        blob = fuse.build(keys)
        assert fuse.probe(blob, keys).all()
        assert fuse.probe(blob, rng.integers(0, 2**63, 100_000).astype(np.uint64)).sum() < 20


def test_exact_dedup(spark):
    rows = ODD + [(50, "a b  c d"), (51, "a b c e"), (900, "a\nb c d"), (901, None), (902, "new"), (903, "new"), (904, "a b c d ")]
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    want = [(i, min(groups[norm(t)]), len(groups[norm(t)]), i == min(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows]
    got = exact_dedup.dedup_table(docs(spark, rows)).withColumn("h", F.lower(F.hex("digest")))
    assert rows_of(got, "doc_id", "keep_id", "group_size", "kept", "h") == sorted(want, key=repr)
    assert exact_dedup.dedup_table(docs(spark, [])).count() == 0
    got = exact_dedup.dedup_table(docs(spark, [(None, "q"), (4, "q"), (4, "q"), (None, "r")]))
    assert rows_of(got, "doc_id", "keep_id", "group_size", "kept") == [(4, 4, 3, True), (4, 4, 3, True), (None, 4, 3, False), (None, None, 1, True)]


def test_kept_snapshot(spark, tmp_path):
    old, new = [(1, "a  b"), (2, "a b"), (3, "c"), (None, "d"), (9, None)], [(20, "a\tb"), (21, "c"), (4, "e"), (22, "e"), (23, "d"), (24, ""), (None, "f")]
    exact_dedup.write_snapshot(docs(spark, old), f"{tmp_path}/snapshot")
    got = rows_of(exact_dedup.dedup_batch(f"{tmp_path}/snapshot", docs(spark, new)), "doc_id", "keep_id", "group_size", "kept")
    assert got == sorted([(20, 1, 3, False), (21, 3, 2, False), (4, 4, 2, True), (22, 4, 2, False), (23, None, 2, False), (24, 9, 2, False), (None, None, 1, True)], key=repr)
    exact_dedup.write_snapshot(docs(spark, []), f"{tmp_path}/empty")
    assert rows_of(exact_dedup.dedup_batch(f"{tmp_path}/empty", docs(spark, [(5, "x"), (6, "x")])), "doc_id", "keep_id", "kept") == [(5, 5, True), (6, 5, False)]


# --- 7, 9


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def test_levenshtein_trie():
    rng = random.Random(3)
    for _ in range(1500):
        terms = {"".join(rng.choice("abc") for _ in range(rng.randint(5, 8))): float(i + 1) for i in range(4)}
        w = "".join(rng.choice("abc") for _ in range(rng.randint(4, 9)))
        trie = toxicity.Trie(terms)
        want = max((x for t, x in terms.items() if distance(t, w) <= 1), default=0.0)
        assert trie.near(w) == want and (not want or trie.may_be_near(w))


def test_toxicity_context():
    s = toxicity.Scorer({"terms": {"moron": 5.0, "lowe*": 4.0}, "curve": (-3.0, 2.0)})
    assert s.score("you moron") > s.score('he wrote "moron" there') > s.score("you there") == s.score("") == s.score(None)
    assert s.score("you m0ron") == s.score("you there") and s.score("you morron") > 0.3 and s.score("loweitum") > 0.3


def brute_total(text, terms):
    """Sum of hits' weights by trying every term and every quotation."""
    low, out = (text or "").lower(), 0.0
    quotes, at = [], 0
    while at < len(low):
        if low[at] in toxicity.QUOTES and (b := low.find(toxicity.QUOTES[low[at]], at + 1)) >= 0:
            quotes.append((at, b))
            at = b
        at += 1
    found = [(m.start(), m.group()) for m in re.finditer(r"[^\W\d_]+", low)]
    for k, (at, w) in enumerate(found):
        x = max([v for t, v in terms.items() if (w.startswith(t[:-1]) if t.endswith("*") else w == t)], default=0.0)
        if not x:
            x = 0.6 * max([v for t, v in terms.items() if not t.endswith("*") and len(t) >= 5 and distance(t, w) <= 1], default=0.0)
        if any(v in toxicity.REPORTING for _, v in found[max(0, k - 3) : k]):
            x *= 0.7
        out += 0.4 * x if any(a <= at < b for a, b in quotes) else x
    return out


def test_toxicity_equals_brute_force(spark):
    rng = random.Random(9)
    terms = {"moron": 5.0, "lowe*": 4.0, "idiots": 3.0, "vermin": 2.0, "twit": 1.5}
    words = ["moron", "morron", "mron", "lowery", "loweitum", "idiot", "idiots", "vermim", "twit", "twits", "said", "nicht", "mot", "you", "are", '"', "“", "”", "«", "»", "İ", ".", "x" * 60]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(300)] + [None, "", '"' + "a " * 400 + 'moron"', "İ" * 40 + ' he wrote "moron" there']
    scorer = toxicity.Scorer({"terms": terms, "curve": (-3.0, 2.0)})
    assert [scorer.total(t) for t in texts] == pytest.approx([brute_total(t, terms) for t in texts])
    model = {"terms": terms, "curve": (-3.0, 2.0)}
    rows = [*enumerate(texts), (None, "moron"), (7, "moron"), (7, "moron")]
    got = rows_of(toxicity.score_table(docs(spark, rows), model), "doc_id", "score")
    sigmoid = lambda t: 1 / (1 + np.exp(-min(30.0, -3 + 2 * np.log1p(brute_total(t, terms)))))
    want = sorted(((i, sigmoid(t)) for i, t in rows), key=repr)
    assert [i for i, _ in got] == [i for i, _ in want] and [x for _, x in got] == pytest.approx([x for _, x in want])


def test_quotation_whatever_its_length_and_letters():
    s = toxicity.Scorer({"terms": {"moron": 5.0}, "curve": (-3.0, 2.0)})
    assert s.total('"' + "a " * 400 + 'moron"') == s.total('"a moron"') == 2.0
    assert s.total("İ" * 40 + ' "moron"') == 2.0


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op7_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    hit, told, bad = got.agg(F.sum(F.col("predicted") * F.col("toxic")), F.sum("predicted"), F.sum("toxic")).first()
    assert hit / bad > 0.75 and hit / told > 0.75
    e = toxicity.learn(docs(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert rows_of(toxicity.score_table(docs(spark, ODD[:3]), e), "score")[0][0] < 0.01


def test_held_out_rows(spark):
    rows = spark.range(200).withColumnRenamed("id", "doc_id")
    assert {r[0] for r in rows.where(toxicity.held_out()).collect()} == {i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert {r[0] for r in rows.where(langid.held_out()).collect()} == {i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0}


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op9_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    model = langid.learn(spark.read.parquet(f"{sf}/documents.parquet"), F.lit(True))
    rows = [(1, None), (2, ""), (3, "12 34 !?"), (4, "Ελληνικά"), (5, "the of and " * 5000)]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict_table(docs(spark, rows), model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 1.0) and got[4][0] in model["langs"] and got[5][0] == "en"
    assert langid.learn(docs(spark, []), F.lit(True)) == {"langs": []}
    # each row's prediction by a plain Viterbi recursion over plain counts
    d = spark.read.parquet(f"{sf}/documents.parquet").limit(150).select("doc_id", "text", "lang")
    model = langid.learn(d, ~langid.held_out())
    counts = collections.defaultdict(collections.Counter)
    for r in d.collect():
        if zlib.crc32(str(r.doc_id).encode()) % 5 and r.lang and r.text:
            counts[r.lang].update(re.findall(r"[^\W\d_]{1,24}", r.text.lower()))
    assert model["langs"] == sorted(counts) and set(model["number"]) == {w for c in counts.values() for w, n in c.items() if n >= 3}
    scorer, got = langid.Scorer(model), {r["doc_id"]: r["lang_pred"] for r in langid.predict_table(d, model).collect()}
    for r in d.collect():
        words = re.findall(r"[^\W\d_]{1,24}", (r.text or "").lower())
        if not words:
            assert got[r.doc_id] == "und"
            continue
        scorer.add(set(words))
        best, paths = scorer.of(words[:1])[0].astype(float), [[k] for k in range(len(model["langs"]))]
        for row in scorer.of(words)[1:].astype(float):
            step = [[best[i] - (langid.SWITCH_PENALTY if i != j else 0) for i in range(len(best))] for j in range(len(best))]
            lead = [max(range(len(best)), key=lambda i: (step[j][i], i == j)) for j in range(len(best))]
            best, paths = np.array([step[j][lead[j]] for j in range(len(best))]) + row, [paths[lead[j]] + [j] for j in range(len(best))]
        path = paths[int(best.argmax())]
        weight = np.bincount(path, list(map(len, words)), len(best))
        assert got[r.doc_id] == model["langs"][int(weight.argmax())]
    model = langid.learn(spark.read.parquet(f"{sf}/documents.parquet"), F.lit(True))
    mixed = langid.spans("the of and that in is it for on with the of and " * 2 + "der die und ist nicht mit auf für den ein " * 3, langid.Scorer(model))
    assert [s[2] for s in mixed] == ["en", "de"]


def test_all_letters_of_a_long_run_count():
    """Words that agree in their first 24 letters, as texts without blanks do."""
    rng = random.Random(3)
    make = lambda letters: "".join(rng.choice(letters) for _ in range(400))
    model = langid.model_of({"aa": collections.Counter(langid.WORD.findall(make("abcd"))), "bb": collections.Counter(langid.WORD.findall(make("wxyz")))})
    head, scorer = make("abcd")[:24], langid.Scorer(model)
    assert [x for x, _ in langid.predict_many([head + make("abcd"), head + make("wxyz")], scorer)] == ["aa", "bb"]
    assert [x[2] for x in langid.spans(make("abcd")[:240] + make("wxyz")[:240], scorer)] == ["aa", "bb"]


def test_viterbi_short_cut():
    rng = np.random.default_rng(1)
    for _ in range(300):
        s = rng.normal(size=(int(rng.integers(1, 40)), 3)) * rng.choice([0.3, 3])
        total = lambda path: sum(s[i, p] for i, p in enumerate(path)) - 2.0 * np.count_nonzero(np.diff(path))
        assert total(langid.label(s, 2.0)) == pytest.approx(total(langid.viterbi(s, 2.0)))


# --- 10


def brute_links(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    links, up = collections.Counter(), {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return sorted(((i, root(i), links[i]) for i in sets), key=repr)


@pytest.mark.parametrize("hot", [1000, 5])
def test_jaccard(spark, monkeypatch, hot):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    near = [(1000 + i, " ".join(x if rng.random() > 0.012 else f"z{rng.randint(0, 999)}" for x in base)) for i in range(600)]  # several blocks
    rows = ODD + random_rows(6) + near + [(3000, near[0][1]), (3001, near[0][1] + " ")]
    from docquarry.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", hot)
    got = jaccard.jaccard_classes(docs(spark, rows))
    assert rows_of(got, "doc_id", "class_id", "n_links") == brute_links(rows)
    assert jaccard.jaccard_classes(docs(spark, [])).count() == 0


def test_bayesian_pruning_keeps_pairs_at_the_threshold():
    least = jaccard.least_matches([28, 252], 252)
    assert 0 < least[28] < 0.8 * 28 and 0 < least[252] < 0.8 * 252
    rng = np.random.default_rng(2)
    lost = sum(any(rng.binomial(n, 0.8) < least[n] for n in (28, 252)) for _ in range(20_000))
    assert lost == 0


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1100)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame(edges, "a long, b long"))
    assert rows_of(got, "node", "root") == sorted(((x, root(x)) for x in up if any(x in e and e[0] != e[1] for e in edges)), key=repr)


# --- the pipeline


def test_pipeline_equals_brute_force(spark):
    import corpus_pipeline
    from docquarry.session import table

    assert [s[0] for s in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_jaccard", "substring_dedup", "best_fit_packing"]
    d = table(spark, SF, "documents")
    rows = [(r.doc_id, r.text, r.source) for r in d.collect()]
    model = langid.learn(d, F.lit(True))
    told = langid.predict_many([t for _, t, _ in rows], langid.Scorer(model))
    rows = [r for r, (lang, score) in zip(rows, told) if lang != "und" and score >= corpus_pipeline.LEAST_SCORE]
    seen = {}
    for i, t, s in sorted(rows):
        seen.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), (i, t, s))
    rows = sorted(seen.values())
    classes = {i: c for i, c, _ in brute_links([r[:2] for r in rows])}
    rows = [r for r in rows if classes[r[0]] == r[0]]
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t) for i, t, _ in rows}
    removed = {i: (n, gone) for i, n, gone, _ in brute_words([r[:2] for r in rows])}
    left = collections.Counter({i: n - gone for i, (n, gone) in removed.items() if n > gone or not gone})
    got = collections.Counter()
    for r in corpus_pipeline.run(spark, SF).collect():
        got[r["doc_id"]] += r["n_words"]
    assert got == collections.Counter({i: n for i, n in left.items() if n}) and len(words) == len(rows)
    assert corpus_pipeline.near_copies(spark, d, SF).columns == d.columns


def test_pipeline_takes_odd_rows(spark):
    import corpus_pipeline

    d = docs(spark, [*ODD, (4, "a b c d"), (None, "some words here"), (60, "the of and " * 30)]).withColumn("_id", F.lit(1))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, SF)
        assert out.columns == d.columns
        out.collect()
    assert corpus_pipeline.packing_stage(spark, d, SF).count() > 0


def test_pipeline_keeps_clean_rows_of_odd_ids(spark):
    """Null and repeated doc_ids: each row is judged by its own text and keeps its own columns."""
    import corpus_pipeline

    text = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    clean = [(None, text(1), "n1"), (None, text(2), "n2"), (4, text(3), "a"), (4, text(4), "b"), (7, text(5), "c"), (8, None, "d")]
    again = [(4, text(3), "a"), (9, text(4), "e"), (None, text(5), "f")]  # copies of clean rows, the first of the same doc_id
    d = spark.createDataFrame([(i, t, "en", s) for i, t, s in again + clean], "doc_id long, text string, lang string, source string").repartition(3)
    for stage in (corpus_pipeline.exact_copies, corpus_pipeline.near_copies, corpus_pipeline.substrings):
        # near and substring operators take a null text as an empty one
        got = sorted(((r.doc_id, r.text or None, r.source) for r in stage(spark, d, SF).collect()), key=repr)
        assert got == sorted(clean, key=repr)
    mixed = spark.createDataFrame([(5, text(6), "en", "g"), (5, text(7), "de", "h"), (6, text(7) + " " + text(8), "fr", "i")], d.schema)
    got = sorted((r.doc_id, r.text, r.lang, r.source) for r in corpus_pipeline.substrings(spark, mixed, SF).collect())
    assert got == [(5, text(6), "en", "g"), (5, text(7), "de", "h"), (6, text(8), "fr", "i")]
