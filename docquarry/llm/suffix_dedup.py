"""Suffix-array deduplication: remove every byte that a repeated string of 50 bytes covers.

A byte goes if a string of WIDTH bytes over it also starts in a document with a smaller doc_id; strings are judged on the
input. Windows are anchored at the least hash of their GRAM-byte strings; see repeats.py for the exchange, and suffixes.py
for the induced sorting with which a shard finds the strings that its documents share.

Edge cases: null and empty texts have no bytes; texts shorter than WIDTH lose nothing. Strings never cross documents.
Rows with a null doc_id come last, in the order of a hash of their texts. Repeated rows of one doc_id (and equal rows
without one) get results of their own and never remove each other's bytes. An empty table gives an empty result. Extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docquarry.llm.common import Rolling, mix64
from docquarry.llm.repeats import PIECE, Runs, Windows, cut_runs, remove_repeats
from docquarry.llm.suffixes import QUEUE_LIMIT, Grown, array, blocks, suffix_pieces

WIDTH, GRAM = 50, 20
MOST = np.iinfo(np.int64).max


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes at each place. It only decides where windows are anchored; equal bytes have equal hashes."""
    x = data.astype(np.uint64)
    with np.errstate(over="ignore"):
        for step in (1, 2, 4):  # the 8 bytes at each place as one number
            x = x[:-step] | (x[step:] << np.uint64(8 * step))
        y = mix64(x[:-8]) + x[8:]
        return mix64(y[: len(data) - GRAM + 1] ^ (x[GRAM - 8 :] << np.uint64(1)))


class ByteWindows(Windows):
    within = False

    def __init__(self, seed: int, width: int = WIDTH, keep_text: bool = False, limit: int = QUEUE_LIMIT):
        self.seed, self.width, self.keep_text, self.limit = seed, width, keep_text, limit

    def split(self, data):
        n = len(data) - self.width + 1
        return [(a, data[a : min(n, a + PIECE) + self.width - 1]) for a in range(0, max(n, 1), PIECE)]

    def runs(self, pieces):
        sizes = np.array([len(x) for x in pieces])
        base = np.cumsum(sizes) - sizes
        data = np.concatenate(pieces)
        counts = np.maximum(sizes - self.width + 1, 0)
        if not counts.sum():
            none = np.zeros(0, np.uint64)
            return Runs(np.zeros(0, np.int64), none, (none, none), np.zeros(0, np.int64), np.zeros(0, np.int64))
        roll = Rolling(data.astype(np.uint64) + np.uint64(1), self.seed)
        best = gram_hashes(data)
        span, have = self.width - GRAM + 1, 1
        while 2 * have <= span:
            best = np.minimum(best[:-have], best[have:])
            have *= 2
        if have < span:
            best = np.minimum(best[: len(best) - (span - have)], best[span - have :])
        piece = np.repeat(np.arange(len(pieces)), counts)
        at = np.arange(len(piece)) + np.repeat(base - (np.cumsum(counts) - counts), counts)
        anchor = best[at]
        head, n = cut_runs(at, anchor, piece)
        start, piece = at[head], piece[head]
        digest = roll.of(start, start + n - 1 + self.width)

        def split(ks):
            offset = np.arange(int(n[ks].sum())) - np.repeat(np.cumsum(n[ks]) - n[ks], n[ks])
            k = np.repeat(ks, n[ks])
            return k, offset, *roll.of(start[k] + offset, start[k] + offset + self.width)

        return Runs(piece, anchor[head], digest, start - base[piece], n, lambda k: data[start[k] : start[k] + n[k] - 1 + self.width].tobytes(), split)

    def compare(self, docs, crcs, starts, sizes, data):
        limit = self.limit
        base = np.cumsum(sizes) - sizes
        # contents of one shard as one string: bytes as 2 to 257, 1 behind each content, 0 at the end
        flat = array(len(data) + len(sizes) + 1, np.uint16, limit)
        at = base + np.arange(len(sizes))
        for part in blocks(len(sizes), max(1, limit // 64)):
            own = sizes[part]
            a, b = int(base[part.start]), int(base[part.stop - 1] + own[-1])
            flat[at[part.start] : at[part.stop - 1] + own[-1] + 1] = np.insert(data[a:b].astype(np.uint16) + 2, np.cumsum(own), 1)
        flat[len(flat) - 1] = 0

        def spans(pos, of, gone):
            of, start = of[gone], pos[gone] - at[of[gone]]
            order = np.lexsort((start, of))  # neighbours in one content make one span
            of, start = of[order], start[order]
            cut = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (start[1:] != start[:-1] + 1)]))
            ends = np.concatenate([cut[1:], [len(of)]]) - 1
            of, begin, stop = of[cut], start[cut], start[ends] + self.width
            return docs[of], crcs[of], starts[of] + begin, starts[of] + stop

        def whole(pos):
            """Suffixes that have WIDTH bytes, and their contents."""
            of = np.searchsorted(at, pos, "right") - 1
            ok = (pos < len(flat) - 1) & (pos - at[of] + self.width <= sizes[of])
            return pos[ok], of[ok], ok

        def close(group, least):
            """A group that lay over several pieces."""
            pos = group.get()
            for part in blocks(len(pos), limit):
                p, of, _ = whole(np.asarray(pos[part]))
                gone = docs[of] > least
                if gone.any():
                    yield spans(p, of, gone)

        # a group: suffixes next to each other that agree in WIDTH bytes; the last one of a piece stays open
        group, least = Grown(np.int64, limit), MOST
        for pos, lcp in suffix_pieces(flat, self.width, limit):
            new = np.flatnonzero(lcp < self.width)
            first, last = (int(new[0]), int(new[-1])) if len(new) else (len(pos), len(pos))
            group.put(pos[:first])
            _, of, _ = whole(pos[:first])
            least = min(least, int(docs[of].min(initial=MOST)))
            if not len(new):
                continue
            yield from close(group, least)
            p, of, ok = whole(pos[first:last])
            if len(p):
                number = np.cumsum(lcp[first:last] < self.width)[ok]
                doc = docs[of]
                head = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
                gone = doc > np.repeat(np.minimum.reduceat(doc, head), np.diff(np.concatenate([head, [len(doc)]])))
                if gone.any():
                    yield spans(p, of, gone)
            group = Grown(np.int64, limit)
            group.put(pos[last:])
            _, of, _ = whole(pos[last:])
            least = int(docs[of].min(initial=MOST))
        yield from close(group, least)

    def finish(self, ids, data, spans):
        n, removed, runs, digest, texts = [], [], [], [], []
        for i, d in enumerate(data):
            start, end = spans(i)
            n.append(len(d))
            runs.append(len(start))
            removed.append(int((end - start).sum()))
            if len(start):
                keep = np.ones(len(d), bool)
                for s, e in zip(start.tolist(), end.tolist(), strict=True):
                    keep[s:e] = False
                d = d[keep]
            raw = d.tobytes()
            digest.append(hashlib.sha256(raw).hexdigest())
            if self.keep_text:
                texts.append(raw)
        out = {"doc_id": ids, "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(runs, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
        if self.keep_text:
            out["kept_bytes"] = pa.array(texts, pa.binary())
        return pa.table(out)


def dedup_bytes(documents: DataFrame, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept_bytes) of each document."""
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_bytes binary" * keep_text
    return remove_repeats(documents, lambda seed: ByteWindows(seed, keep_text=keep_text), schema)
