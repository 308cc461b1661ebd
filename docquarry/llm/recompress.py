"""Substring deduplication over words by recompression.

Every document's words are compressed in rounds. A round names maximal runs of one symbol and then pairs of neighbours
whose first lies in the left class and whose second in the right class; a name is a hash of what it stands for, and so is
its class, so all documents of the corpus, on whatever executor, give equal names to equal parts without a dictionary.
Each symbol carries the range of words that its forming depended on. Inside a repeated passage, all symbols whose range
lies in the passage are the same at each of its places.

A window of WIDTH words is anchored at a symbol of the highest round that has one whose range lies in the window (round
zero, the words themselves, always has one): at the least hash of such a range's words, which is far rarer than a symbol. Windows that share an anchor are grouped and verified: runs of equal
content by their digest, others word by word. Repeats inside a document go by the windows' digests of 122 bits. Digests are
polynomials over word hashes at bases that the driver draws. See repeats.py for the exchange.

Edge cases: null and empty texts have no words; texts of fewer than WIDTH words lose nothing. Rows with a null doc_id come
last, in the order of a hash of their texts. Repeated rows of one doc_id and text (and equal rows without a doc_id) get the
same result; none is earlier than the other. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docquarry.llm.common import GOLDEN, Rolling, mix64, name64, word_bounds, word_hashes
from docquarry.llm.repeats import PIECE, Runs, Windows, cut_runs, remove_repeats

ROUNDS, WIDTH = 2, 20


def compress(names: np.ndarray, rounds: int = ROUNDS):
    """Symbols of each round: lists of (names, low, high), where low..high is the range of words that a symbol depends on."""
    low = np.arange(len(names))
    high = low.copy()
    out = [(names, low, high)]
    for r in range(1, rounds + 1):
        names, low, high = _pairs(*_runs(names, low, high), r)
        out.append((names, low, high))
    return out


def _around(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges widened by those of both neighbours; at an end of the text by one word beyond it."""
    return np.minimum(low, np.concatenate([[-1], low[:-1]])), np.maximum(high, np.concatenate([high[1:], [high[-1] + 1]]))


def _runs(names, low, high):
    if len(names) < 2:
        return names, low, high
    low, high = _around(low, high)
    at = np.concatenate([[0], np.flatnonzero(names[1:] != names[:-1]) + 1])
    n = np.diff(np.concatenate([at, [len(names)]]))
    if len(at) == len(names):
        return names, low, high
    with np.errstate(over="ignore"):
        named = np.where(n > 1, mix64(names[at] ^ (GOLDEN * n.astype(np.uint64))), names[at])
    return named, np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)


def _pairs(names, low, high, r: int):
    if len(names) < 2:
        return names, low, high
    left = (mix64(names ^ np.uint64(r)) & np.uint64(1)).astype(bool)
    joins = left[:-1] & ~left[1:]
    wide_low, wide_high = _around(low, high)
    first = np.flatnonzero(joins)
    stay = np.ones(len(names), bool)
    stay[first + 1] = False
    out, lo, hi = names.copy(), wide_low, wide_high
    with np.errstate(over="ignore"):
        out[first] = mix64(names[first] * np.uint64(3) ^ mix64(names[first + 1] + np.uint64(r)))
    lo[first] = np.minimum(low[first], low[first + 1])
    hi[first] = np.maximum(high[first], high[first + 1])
    return out[stay], lo[stay], hi[stay]


def _number(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dense numbers of pairs of dense numbers; equal for equal pairs only."""
    return np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1]


class WordWindows(Windows):
    within = True

    def __init__(self, seed: int, width: int = WIDTH, rounds: int = ROUNDS, keep_text: bool = False):
        self.seed, self.width, self.rounds, self.keep_text = seed, width, rounds, keep_text

    def split(self, data):
        a, b = word_bounds(data)
        step = max(1, len(a) * PIECE // len(data))
        n = len(a) - self.width + 1
        if n <= 0:
            return [(0, data[:0])]  # no window, as little text as that takes
        return [(k, data[a[k] : b[min(n, k + step) + self.width - 2]]) for k in range(0, n, step)]

    def anchors(self, names: np.ndarray, roll: Rolling) -> np.ndarray:
        """The anchor of each window."""
        n, w = len(names), self.width
        held: list[list] = [[] for _ in range(w + 1)]  # places and values by length of the range
        for r, (_, low, high) in enumerate(compress(names, self.rounds)):
            size = high - low + 1
            ok = np.flatnonzero((size <= w) & (low >= 0) & (high < n))
            low, size = low[ok], size[ok]
            value = (name64(*roll.of(low, low + size)) >> np.uint64(2)) | (np.uint64(self.rounds - r) << np.uint64(62))
            order = np.argsort(size, kind="stable")
            low, size, value = low[order], size[order], value[order]
            cut = np.searchsorted(size, np.arange(w + 2))
            for s in range(1, w + 1):
                if cut[s + 1] > cut[s]:
                    held[s].append((low[cut[s] : cut[s + 1]], value[cut[s] : cut[s + 1]]))
        best = np.full(n, 0xFFFFFFFFFFFFFFFF, np.uint64)
        for s in range(1, w + 1):
            if s > 1:
                best = np.minimum(best[:-1], best[1:])
            for low, value in held[s]:  # symbols of one round and length may share a range, and then a value
                best[low] = np.minimum(best[low], value)
        return best

    def runs(self, pieces):
        w = self.width
        blank = np.array([0x20], np.uint8)
        data = np.concatenate([x for p in pieces for x in (p, blank)])
        sizes = np.array([len(p) + 1 for p in pieces])
        a, b, h, g = word_hashes(data, self.seed)
        if len(h) < w:
            h, g = h[:0], g[:0]
        piece_of = np.searchsorted(np.cumsum(sizes), a, "right")
        first = np.searchsorted(piece_of, np.arange(len(pieces)))
        at = np.flatnonzero(piece_of[: len(h) - w + 1] == piece_of[w - 1 :]) if len(h) else np.zeros(0, np.int64)
        if not len(at):
            none, zero = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            return Runs(zero, none, (none, none), zero, zero, None, None, (zero, zero, none, none))
        roll = Rolling(h, self.seed, g)
        anchor, piece = self.anchors(name64(h, g), roll)[at], piece_of[at]
        head, n = cut_runs(at, anchor, piece)
        start = at[head]
        digest = roll.of(start, start + n - 1 + w)
        own = piece[head]
        h, g = roll.of(at, at + w)
        window = (piece, at - first[piece], h, g)

        def split(ks):
            offset = np.arange(int(n[ks].sum())) - np.repeat(np.cumsum(n[ks]) - n[ks], n[ks])
            k = np.repeat(ks, n[ks])
            place = head[k] + offset
            return k, offset, h[place], g[place]

        return Runs(own, anchor[head], digest, start - first[own], n, lambda k: data[a[start[k]] : b[start[k] + n[k] + w - 2]].tobytes(), split, window)

    def compare(self, docs, crcs, starts, sizes, data):
        w = self.width
        ends = np.cumsum(sizes)
        contents = [data[e - n : e].tobytes() for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
        order = np.lexsort((starts, docs))
        number: dict[bytes, int] = {}
        ids = []
        for k in order.tolist():
            words = contents[k].split()
            ids.append(np.fromiter((number.setdefault(x, len(number)) for x in words), np.int64, len(words)))
        sizes = np.array([len(x) for x in ids])
        flat = np.concatenate(ids)
        base = np.cumsum(sizes) - sizes
        n = np.maximum(sizes - w + 1, 0)
        owner = np.repeat(np.arange(len(ids)), n)
        first = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = base[owner] + first
        # the number of each window, by numbers of 2, 4, 8 and 16 words and of two of those that overlap: exact
        name, have = flat, 1
        while 2 * have <= w:
            name = _number(name[:-have], name[have:])
            have *= 2
        if have < w:
            name = _number(name[: len(name) - (w - have)], name[w - have :])
        key = name[at]
        by = np.argsort(key, kind="stable")  # order within a key: document, start
        head = np.concatenate([[True], key[by][1:] != key[by][:-1]])
        lead = by[np.maximum.accumulate(np.where(head, np.arange(len(by)), 0))]
        late = by != lead
        gone = by[late]
        which, start = order[owner[gone]], first[gone]
        led = order[owner[lead[late]]]
        other = docs[which] != docs[led]
        which, start = which[other], start[other] + starts[which[other]]
        yield docs[which], crcs[which], start, start + w

    def finish(self, ids, data, spans):
        words, removed, digest, texts = [], [], [], []
        for i, d in enumerate(data):
            a, b = word_bounds(d)
            start, end = spans(i)
            gone = int((end - start).sum())
            raw = d.tobytes()
            kept = np.ones(len(a), bool)
            for s, e in zip(start.tolist(), end.tolist(), strict=True):
                kept[s:e] = False
            # bytes.split() takes the same white space as word_bounds()
            joined = b" ".join(raw[x:y] for x, y in zip(a[kept].tolist(), b[kept].tolist(), strict=True)) if gone else b" ".join(raw.split())
            words.append(len(a))
            removed.append(gone)
            digest.append(hashlib.sha256(joined).hexdigest())
            if self.keep_text:
                texts.append(joined.decode() if gone else raw.decode())
        out = {"doc_id": ids, "n_words": pa.array(words, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
        if self.keep_text:
            out["kept_text"] = pa.array(texts, pa.string())
        return pa.table(out)


def dedup_words(documents: DataFrame, keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text: the text itself where nothing is removed, else the kept
    words joined by one space) of each document, without the words of windows that start earlier elsewhere."""
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text
    return remove_repeats(documents, lambda seed: WordWindows(seed, keep_text=keep_text), schema)
