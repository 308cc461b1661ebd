"""Repeated windows across a corpus: the exchange that the byte and the word operator share.

A document is a sequence of units (bytes or words); a window is WIDTH units. An operator gives each window an anchor that
the window's content alone decides, so equal windows have equal anchors. Consecutive windows with one anchor form a run.
Runs of equal content are recognised by their digest (common.Rolling: 93 bits of two polynomials at bases that the driver
draws, so no input can be built to collide); only runs that share an anchor but differ are compared in detail.

1. Each task sends (anchor, digest, document) of its documents' runs to the anchor's shard; of equal runs within the task
   only the smallest document's goes out (pre-aggregation, so a passage in a third of all rows costs one entry a task).
   An anchor with more than LOCAL_RUNS differing runs in a slice is hot: its shard gets one mark for the slice.
2. A shard tells every document that holds a run which a smaller document holds too ("removed"), and asks the smallest
   holder of each differing run under a shared anchor for its content ("wanted"). Runs of an anchor with a mark or with more
   than HOT_RUNS runs are "split" instead.
3. Documents send the wanted contents to shards. Split runs go window by window to the shards of the windows' digests, one
   entry for a window and bucket, so that no hot anchor's windows meet in one task.
4. The operator compares the windows of a shard exactly and answers with intervals; split windows answer by digest.
5. Documents get all intervals and the operator finishes them.

Shards and buckets are hashed; their number follows the bytes of the table, so that a task's data stay of one size. Only
entries, never texts of other documents, meet in a task. Everything is keyed, so lost executors cost only a recomputation.
Rows with a null doc_id come last, in the order of a hash of their texts, and are spread by it.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from docquarry.llm.bpe import slices
from docquarry.llm.common import arrow_bytes, mix64, new_seed, spare
from docquarry.llm.suffixes import Grown
from docquarry.session import ship

#: Bytes of text for which there is one bucket and one shard.
BYTES_PER_BUCKET = 2 << 20
#: Bytes of a document that are looked at together; longer ones are cut with an overlap.
PIECE = 1 << 20
#: Bytes of documents that are looked at together, about.
CHUNK = 1 << 19
#: Bytes of documents within which a task sends equal runs once, about.
SLICE = 6 << 20
#: Items of a shard's contents that stay in memory.
STORE = 32 << 20
#: Differing runs of an anchor in one slice, and in all, above which it is split by windows.
LOCAL_RUNS, HOT_RUNS = 16, 512
#: Rows without a doc_id get numbers from here on, by a hash of their texts.
NO_ID = 0x7000_0000_0000_0000

_ENTRY = [np.dtype("<u4"), np.dtype("<u8"), np.dtype("<u4"), np.dtype("<i8")]  # anchor, digest in two parts, document
_REPLY = [np.dtype("<i8"), np.dtype("<u8"), np.dtype("<u4"), np.dtype("u1")]  # document, digest, code
_SPAN = [np.dtype("<i8"), np.dtype("<u4"), np.dtype("<i8"), np.dtype("<i8")]  # document, text's crc, start, end
_WINDOW = [np.dtype("<u8"), np.dtype("<u4"), np.dtype("<i8"), np.dtype("<u4"), np.dtype("<i8")]  # digest, document, crc, start
REMOVED, WANTED, SPLIT = 1, 2, 3
#: The document of a mark.
MARK = -(1 << 63)


def pack(columns: list[np.ndarray], kinds: list[np.dtype]) -> bytes:
    return np.int64(len(columns[0])).tobytes() + b"".join(np.ascontiguousarray(c, k).tobytes() for c, k in zip(columns, kinds, strict=True))


def unpack(blobs: list[bytes], kinds: list[np.dtype]) -> list[np.ndarray]:
    out: list[list[np.ndarray]] = [[] for _ in kinds]
    for blob in blobs:
        n, at = int(np.frombuffer(blob, np.int64, 1)[0]), 8
        for held, kind in zip(out, kinds, strict=True):
            held.append(np.frombuffer(blob, kind, n, at))
            at += n * kind.itemsize
    return [np.concatenate(x) if x else np.zeros(0, k) for x, k in zip(out, kinds, strict=True)]


_CODEC = "zstd"
_TEXT = [np.dtype("<i8"), np.dtype("u1"), np.dtype("<i8")]  # document, whether it has a doc_id, bytes


def pack_texts(ids: np.ndarray, known: np.ndarray, data: list[np.ndarray]) -> bytes:
    """Documents of one bucket and slice as one compressed blob: texts side by side shrink far better than row by row."""
    raw = pack([ids, known, np.array([len(x) for x in data], np.int64)], _TEXT) + b"".join(x.tobytes() for x in data)
    return np.int64(len(raw)).tobytes() + pa.Codec(_CODEC).compress(raw, asbytes=True)


def unpack_texts(blobs: list[bytes]) -> tuple[np.ndarray, pa.Array, list[np.ndarray]]:
    """Numbers, doc_ids (null where there is none) and UTF-8 bytes of a bucket's documents."""
    ids, known, data = [np.zeros(0, np.int64)], [np.zeros(0, np.uint8)], []
    for blob in blobs:
        raw = pa.Codec(_CODEC).decompress(blob[8:], int(np.frombuffer(blob, np.int64, 1)[0]))
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        at = 8 + n * sum(k.itemsize for k in _TEXT)
        i, k, size = unpack([memoryview(raw)[:at]], _TEXT)
        ends = at + np.cumsum(size)
        whole = np.frombuffer(raw, np.uint8)
        data += [whole[e - m : e] for e, m in zip(ends.tolist(), size.tolist(), strict=True)]
        ids.append(i)
        known.append(k)
    ids, known = np.concatenate(ids), np.concatenate(known)
    return ids, pa.array(ids, mask=known == 0), data


def bucket_of(ids: np.ndarray, n: int) -> np.ndarray:
    """Bucket of a document; the same as bucket_column()."""
    with np.errstate(over="ignore"):
        h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(33)) % np.uint64(n)).astype(np.int64)


def by_part(part: np.ndarray, columns: list[np.ndarray], kinds: list[np.dtype]):
    """(part, blob) of the entries of each part."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    columns = [c[order] for c in columns]
    cut = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if b > a:
            yield int(part[a]), pack([c[a:b] for c in columns], kinds)


_WIRE = pa.schema([("kind", pa.int32()), ("part", pa.int64()), ("blob", pa.binary())])
WIRE = "kind int, part long, blob binary"


def wire(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], schema=_WIRE)


class Runs:
    """Runs of a chunk of pieces: piece number, anchor, digest (two arrays), start within the piece, number of windows."""

    def __init__(self, piece, anchor, digest, start, n, content=None, split=None, window=None):
        self.piece, self.anchor, self.start, self.n = piece, anchor, start, n
        self.digest, self.digest2 = digest[0], digest[1].astype(np.uint32)
        self.content = content  # of a run's number: the units it covers, for compare()
        self.split = split  # of runs' numbers: for each of their windows the run's number, the offset and the digest
        self.window = window  # piece, start and digest of each window, where repeats within a document count


class Windows:
    """What an operator gives: WIDTH, whether repeats within one document count, and how to read, compare and finish."""

    width: int
    within: bool

    def split(self, data: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """A long text (UTF-8 bytes) in pieces that overlap by WIDTH - 1 units: number of the first unit, bytes."""
        raise NotImplementedError

    def runs(self, pieces: list[np.ndarray]) -> Runs:
        """The runs of several pieces; windows never cross them."""
        raise NotImplementedError

    def compare(self, docs: np.ndarray, crcs: np.ndarray, starts: np.ndarray, sizes: np.ndarray, data: np.ndarray):
        """Spans (document, crc, start, end) of windows that also start in a smaller document of these contents, part by
        part; data: the contents' bytes end to end."""
        raise NotImplementedError

    def finish(self, ids: pa.Array, data: list[np.ndarray], spans) -> pa.Table:
        """The result rows of documents; spans(i) gives the removed spans of the i-th as starts and ends."""
        raise NotImplementedError

    def chunks(self, data: list[np.ndarray]):
        """(document numbers and first units of the pieces, their runs), a few megabytes at a time."""
        held, size = [], 0
        for i, d in enumerate(data):
            for first, piece in self.split(d) if len(d) > PIECE else [(0, d)]:
                held.append((i, first, piece))
                size += len(piece)
                if size >= CHUNK:
                    yield self._chunk(held)
                    held, size = [], 0
        if held:
            yield self._chunk(held)

    def _chunk(self, held):
        return np.array([h[0] for h in held]), np.array([h[1] for h in held]), self.runs([h[2] for h in held])


def cut_runs(at: np.ndarray, anchor: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First window and number of windows of each run; at: places of the windows that count, in order."""
    new = (np.diff(at) != 1) | (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])
    head = np.concatenate([[0], np.flatnonzero(new) + 1]) if len(at) else np.zeros(0, np.int64)
    return head, np.diff(np.concatenate([head, [len(at)]]))


def _by_digest(last: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by digest, then `last`, and in that order whether a row has another digest than the one before."""
    order = np.lexsort((last, d1))
    a, b = d1[order], d2[order]
    new = np.ones(len(a), bool)
    new[1:] = a[1:] != a[:-1]
    if (~new[1:] & (b[1:] != b[:-1])).any():  # digests that agree in the first part only
        order = np.lexsort((last, d2, d1))
        a, b = d1[order], d2[order]
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, new


def _local_first(d1: np.ndarray, d2: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each distinct (digest, document): rows that hold their digest's smallest document, and all others."""
    order, first = _by_digest(doc, d1, d2)
    o = doc[order]
    keep = first.copy()
    keep[1:] |= o[1:] != o[:-1]
    order, first = order[keep], first[keep]
    return order[first], order[~first]


def _entries(op: Windows, shards: int, buckets: int):
    def run(batches):
        for batch in batches:
            for piece in slices(batch, SLICE):
                ids = piece["doc_id"].to_numpy(zero_copy_only=False)
                got = [(r.anchor, r.digest, r.digest2, ids[number[r.piece]]) for number, _, r in op.chunks(arrow_bytes(piece["text"]))]
                anchor, d1, d2, doc = map(np.concatenate, zip(*got, strict=True))
                first, later = _local_first(d1, d2, doc)
                _, back, n = np.unique(anchor[first], return_inverse=True, return_counts=True)
                hot = n[back] > LOCAL_RUNS
                split, first = first[hot], first[~hot]
                first = first[np.argsort(doc[first], kind="stable")]
                marks = np.unique(anchor[split])
                zero = np.zeros(len(marks), np.uint64)
                a = np.concatenate([anchor[first], marks])
                entries = [a & np.uint64(0xFFFFFFFF), np.concatenate([d1[first], zero]), np.concatenate([d2[first], zero]), np.concatenate([doc[first], np.full(len(marks), MARK)])]
                rows = [(0, p, blob) for p, blob in by_part(((a >> np.uint64(32)) % np.uint64(shards)).astype(np.int64), entries, _ENTRY)]
                told = np.concatenate([later, split])
                code = np.concatenate([np.full(len(later), REMOVED), np.full(len(split), SPLIT)])
                rows += [(1, p, blob) for p, blob in by_part(bucket_of(doc[told], buckets), [doc[told], d1[told], d2[told], code], _REPLY)]
                yield from wire(rows).to_batches()
        spare()

    return run


def _answer(op: Windows, buckets: int):
    def run(key, table):
        kind, part = int(key[0].as_py()), int(key[1].as_py())
        blobs = table["blob"].to_pylist()
        if kind == 1:
            return wire([(1, part, b) for b in blobs])
        spare()
        anchor, d1, d2, doc = unpack(blobs, _ENTRY)
        del blobs
        marked = np.unique(anchor[doc == MARK])
        real = doc != MARK
        anchor, d1, d2, doc = anchor[real], d1[real], d2[real], doc[real]
        order, first = _by_digest(doc, d1, d2)
        anchor, d1, d2, doc = anchor[order], d1[order], d2[order], doc[order]
        head = np.flatnonzero(first)
        least = np.repeat(doc[head], np.diff(np.concatenate([head, [len(doc)]])))
        late = doc > least
        # runs that differ under one anchor
        a, o = anchor[head], doc[head]
        order = np.lexsort((o, a))
        head, a, o = head[order], a[order], o[order]
        top = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)
        size = np.diff(np.concatenate([top, [len(a)]]))
        split = np.isin(a, marked) | (np.repeat(size, size) > HOT_RUNS)
        want = (np.repeat(np.maximum.reduceat(o, top) > np.minimum.reduceat(o, top), size) if len(o) else np.zeros(0, bool)) | split
        late, want, code = np.flatnonzero(late), head[want], np.where(split, SPLIT, WANTED)[want]
        told = np.concatenate([late, want])
        out = [doc[told], d1[told], d2[told], np.concatenate([np.full(len(late), REMOVED), code])]
        return wire([(1, p, b) for p, b in by_part(bucket_of(doc[told], buckets), out, _REPLY)])

    return run


def _pair_key(doc: np.ndarray, digest: np.ndarray) -> np.ndarray:
    """One number for a document and a digest."""
    with np.errstate(over="ignore"):
        return mix64(doc.astype(np.uint64) * np.uint64(3)) ^ digest


def _again(row: np.ndarray, start: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    """Windows that also start earlier in their row; starts ascend within a row."""
    if not len(row):
        return np.zeros(0, np.int64)
    _, lead, back = np.unique(_pair_key(row, d1), return_index=True, return_inverse=True)
    lead = lead[back]
    if ((row != row[lead]) | (d1 != d1[lead]) | (d2 != d2[lead])).any():  # keys met by chance
        order = np.lexsort((start, d2, d1, row))
        r, a, b = row[order], d1[order], d2[order]
        new = np.concatenate([[True], (r[1:] != r[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        lead = np.empty(len(row), np.int64)
        lead[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(row)), 0))]
    return np.flatnonzero(start > start[lead])


def _send(op: Windows, shards: int):
    def run(key, texts, replies):
        part = int(key[0].as_py())
        spare()
        doc, digest, digest2, code = unpack(replies["blob"].to_pylist(), _REPLY)
        ids, _, data = unpack_texts(texts["blob"].to_pylist())
        crcs = np.array([zlib.crc32(d) for d in data], np.uint32)
        # repeated rows of one document and text are looked at once; without repeats inside documents, only those with a reply
        use = np.zeros(len(ids), bool)
        use[np.unique(np.stack([ids, crcs.astype(np.int64)]), axis=1, return_index=True)[1]] = True
        if not op.within:
            use &= np.isin(ids, doc)
        use = np.flatnonzero(use)
        key = _pair_key(doc, digest)
        by = np.lexsort((code, key))
        key, digest2, code = key[by], digest2[by], code[by]
        out: list[list[np.ndarray]] = [[], [], []]  # row, start, end
        shard_of, sent, long_windows = [], [], {}
        split: list[list[np.ndarray]] = [[], [], [], []]  # row, start, digest of windows
        for number, first, r in op.chunks([data[i] for i in use.tolist()]):
            row = use[number[r.piece]]
            start = r.start + first[r.piece]
            told = np.zeros(len(row), np.uint8)
            if len(key):
                own = _pair_key(ids[row], r.digest)
                at = np.minimum(np.searchsorted(key, own), len(key) - 1)
                told = np.where((key[at] == own) & (digest2[at] == r.digest2), code[at], 0)
            gone = told == REMOVED
            out[0].append(row[gone])
            out[1].append(start[gone])
            out[2].append(start[gone] + r.n[gone] - 1 + op.width)
            if op.within:
                p, s, h, g = r.window
                w_row, s = use[number[p]], s + first[p]
                cut = np.isin(w_row, w_row[first[p] > 0]) | (len(data[use[number[-1]]]) > PIECE) & (w_row == use[number[-1]])
                for i in np.unique(w_row[cut]).tolist():
                    long_windows.setdefault(i, []).append((s[w_row == i], h[w_row == i], g[w_row == i]))
                again = _again(w_row[~cut], s[~cut], h[~cut], g[~cut])
                out[0].append(w_row[~cut][again])
                out[1].append(s[~cut][again])
                out[2].append(s[~cut][again] + op.width)
            apart = np.flatnonzero(told == SPLIT)
            if len(apart):
                k, offset, h, g = r.split(apart)
                for held, x in zip(split, (row[k], start[k] + offset, h, g.astype(np.uint32)), strict=True):
                    held.append(x)
            for k in np.flatnonzero(told == WANTED).tolist():
                shard_of.append(int(r.anchor[k] >> np.uint64(32)) % shards)
                sent.append((int(ids[row[k]]), int(crcs[row[k]]), int(start[k]), r.content(k)))
        for i, got in long_windows.items():
            s, h, g = (np.concatenate(c) for c in zip(*got, strict=True))
            again = _again(np.zeros(len(s), np.int64), s, h, g)
            out[0].append(np.full(len(again), i))
            out[1].append(s[again])
            out[2].append(s[again] + op.width)
        rows = []
        if split[0]:
            row, begin, h, g = (np.concatenate(c) for c in split)
            order, new = _by_digest(ids[row], h, g)
            row, begin, h, g = row[order], begin[order], h[order], g[order]
            head = np.flatnonzero(new)
            least = np.repeat(ids[row[head]], np.diff(np.concatenate([head, [len(row)]])))
            gone = ids[row] > least  # repeats inside a document are known already where they count
            for held, x in zip(out, (row[gone], begin[gone], begin[gone] + op.width), strict=True):
                held.append(x)
            row, begin, h, g = row[~gone], begin[~gone], h[~gone], g[~gone]
            rows += [(2, p, b) for p, b in by_part((h % np.uint64(shards)).astype(np.int64), [h, g, ids[row], crcs[row], begin], _WINDOW)]
        if out[0]:
            row, begin, stop = (np.concatenate(c) for c in out)
            order = np.lexsort((begin, row))
            row, begin, stop = row[order], begin[order], stop[order]
            far = np.int64(1) << 40  # rows end to end on one line, so that spans of all rows are united at once
            begin, stop = union(begin + row * far, stop + row * far)
            row = begin // far
            rows.append((1, part, pack([ids[row], crcs[row], begin - row * far, stop - row * far], _SPAN)))
        order = sorted(range(len(sent)), key=shard_of.__getitem__)
        a = 0
        while a < len(order):
            b = a
            while b < len(order) and shard_of[order[b]] == shard_of[order[a]]:
                b += 1
            own = [sent[k] for k in order[a:b]]
            body = pack([np.array([x[0] for x in own]), np.array([x[1] for x in own]), np.array([x[2] for x in own]), np.array([len(x[3]) for x in own])], _SPAN)
            rows.append((0, shard_of[order[a]], body + b"".join(x[3] for x in own)))
            a = b
        return wire(rows)

    return run


def _meet(op: Windows, blobs: list[bytes]) -> list[np.ndarray]:
    """Spans of split windows that a smaller document holds too."""
    d1, d2, doc, crc, start = unpack(blobs, _WINDOW)
    order, new = _by_digest(doc, d1, d2)
    doc, crc, start = doc[order], crc[order], start[order]
    head = np.flatnonzero(new)
    gone = doc > np.repeat(doc[head], np.diff(np.concatenate([head, [len(doc)]])))
    return [doc[gone], crc[gone], start[gone], start[gone] + op.width]


def _compare(op: Windows, buckets: int):
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, part = int(key[0].as_py()), int(key[1].as_py())
        if kind == 1:
            yield from batches
            return
        blobs = (blob for batch in batches for blob in batch["blob"].to_pylist())
        spare()
        found = iter([_meet(op, list(blobs))]) if kind == 2 else op.compare(*_contents(blobs))
        for spans in found:
            yield from wire([(1, p, b) for p, b in by_part(bucket_of(spans[0], buckets), list(spans), _SPAN)]).to_batches()

    return run


def _contents(blobs) -> list[np.ndarray]:
    """Documents, crcs, starts and sizes of a shard's contents, and their bytes end to end; on disk beyond STORE items."""
    held = [Grown(k, STORE) for k in (*_SPAN, np.uint8)]
    for blob in blobs:
        n = int(np.frombuffer(blob, np.int64, 1)[0])
        at = 8 + n * sum(k.itemsize for k in _SPAN)
        for store, x in zip(held, [*unpack([blob[:at]], _SPAN), np.frombuffer(blob, np.uint8, offset=at)], strict=True):
            store.put(x)
    return [x.get() for x in held]


def _finish(op: Windows):
    def run(key, texts, intervals):
        doc, crc, start, end = unpack(intervals["blob"].to_pylist(), _SPAN)
        order = np.lexsort((start, crc, doc))
        doc, crc, start, end = doc[order], crc[order], start[order], end[order]
        numbers, own, data = unpack_texts(texts["blob"].to_pylist())
        ids = numbers.tolist()

        def spans(i: int) -> tuple[np.ndarray, np.ndarray]:
            a, b = np.searchsorted(doc, ids[i], "left"), np.searchsorted(doc, ids[i], "right")
            if a < b:
                own = crc[a:b]
                c = zlib.crc32(data[i])
                a, b = a + np.searchsorted(own, c, "left"), a + np.searchsorted(own, c, "right")
            return union(start[a:b], end[a:b])

        return op.finish(own, data, spans)

    return run


def union(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal spans covered by spans that are sorted by start."""
    if not len(start):
        return start, end
    reach = np.maximum.accumulate(end)
    new = np.concatenate([[True], start[1:] > reach[:-1]])
    return start[new], reach[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(start) - 1]])]


def remove_repeats(documents: DataFrame, op, schema: str) -> DataFrame:
    """Run the exchange over doc_id and text of documents; op(seed) gives the operator, schema is of its finish()."""
    spark = documents.sparkSession
    ship(spark)
    op = op(new_seed(spark))
    text, own = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("doc_id").cast("long")
    number = F.coalesce(own, F.lit(NO_ID) + F.shiftrightunsigned(F.xxhash64(text), 4))
    docs = documents.select(number.alias("doc_id"), own.alias("own_id"), text.alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = shards = max(2 * spark.sparkContext.defaultParallelism, -(-int(total) // BYTES_PER_BUCKET))

    def placed(batches):
        for batch in batches:
            for piece in slices(batch, SLICE):
                ids, data = piece["doc_id"].to_numpy(zero_copy_only=False), arrow_bytes(piece["text"])
                known = np.array(piece["own_id"].is_valid())
                part = bucket_of(ids, buckets)
                order = np.argsort(part, kind="stable")
                rows = [(int(part[g[0]]), pack_texts(ids[g], known[g], [data[i] for i in g.tolist()])) for g in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(g)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["part", "blob"])

    texts = docs.mapInArrow(placed, "part long, blob binary")
    entries = docs.select("doc_id", "text").mapInArrow(_entries(op, shards, buckets), WIRE)
    replies = entries.groupBy("kind", "part").applyInArrow(_answer(op, buckets), WIRE)
    sent = texts.groupBy("part").cogroup(replies.groupBy("part")).applyInArrow(_send(op, shards), WIRE)
    intervals = sent.groupBy("kind", "part").applyInArrow(_compare(op, buckets), WIRE)
    return texts.groupBy("part").cogroup(intervals.groupBy("part")).applyInArrow(_finish(op), schema)
