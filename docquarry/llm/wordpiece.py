"""Greedy word-piece lengths by a linear longest-match automaton.

The automaton is a trie of the vocabulary's byte strings. Each node has a failure link and the number of pieces that
following the link pops, both computed beforehand, so one pass over a word's bytes gives the number of pieces that greedy
longest-match splitting makes, without building any piece. The vocabulary holds all single bytes, so no word fails.

A word is a run of letters, digits and underscores, or one other character that isn't white space; it is looked up with
the leading blank that marks a word's start in the vocabulary.

Edge cases: a null or empty text, or one of white space only, has no words and no pieces. Each row has a result of its own,
repeated rows and rows without a doc_id too; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from docquarry.llm.bpe import load_ranks, slices
from docquarry.session import ship, spread

WORD = re.compile(r"\w+|[^\w\s]")
#: Words that a worker remembers.
CACHE = 1_000_000


class Automaton:
    def __init__(self, vocabulary):
        child: list[dict[int, int]] = [{}]
        final = [False]
        parent = [(0, 0)]
        for piece in vocabulary:
            at = 0
            for byte in piece:
                nxt = child[at].get(byte)
                if nxt is None:
                    nxt = child[at][byte] = len(child)
                    child.append({})
                    final.append(False)
                    parent.append((at, byte))
                at = nxt
            final[at] = at != 0
        if len(child[0]) < 256:
            raise ValueError("the vocabulary must hold all single bytes")
        self.child = child
        self.link, self.pops = [0] * len(child), [0] * len(child)
        order = [0]
        for at in order:
            order.extend(child[at].values())
        for at in order[1:]:
            if final[at]:
                self.pops[at] = 1  # the node is a piece: pop it, go on from the root
                continue
            above, byte = parent[at]
            z, popped = self.link[above], self.pops[above]
            while byte not in child[z]:
                popped += self.pops[z]
                z = self.link[z]
            self.link[at], self.pops[at] = child[z][byte], popped

    def count(self, word: bytes) -> int:
        """The number of pieces of greedy longest match."""
        child, link, pops = self.child, self.link, self.pops
        at = n = 0
        for byte in word:
            nxt = child[at].get(byte)
            while nxt is None:
                n += pops[at]
                at = link[at]
                nxt = child[at].get(byte)
            at = nxt
        while at:
            n += pops[at]
            at = link[at]
        return n


_AUTOMATA: dict[str, tuple[Automaton, dict[str, int]]] = {}


def count_table(documents: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_words and n_pieces of each whole text."""
    spark = documents.sparkSession
    ship(spark)
    ranks = spark.sparkContext.broadcast(load_ranks(spark, vocabulary))

    def run(batches):
        if vocabulary not in _AUTOMATA:
            _AUTOMATA.clear()
            _AUTOMATA[vocabulary] = Automaton(ranks.value), {}
        automaton, cache = _AUTOMATA[vocabulary]
        for batch in batches:
            for piece in slices(batch):
                words = [WORD.findall(t) if t else [] for t in piece["text"].to_pylist()]
                known = {w: cache.get(w) for w in set().union(*words)}
                for w, n in known.items():
                    if n is None:
                        known[w] = automaton.count(b" " + w.encode())
                        if len(cache) < CACHE:
                            cache[w] = known[w]
                get = known.__getitem__
                yield pa.RecordBatch.from_arrays(
                    [piece["doc_id"], pa.array([len(w) for w in words], pa.int64()), pa.array([sum(map(get, w)) for w in words], pa.int64())],
                    names=["doc_id", "n_words", "n_pieces"],
                )

    docs = spread(documents.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"))
    return docs.mapInArrow(run, "doc_id long, n_words long, n_pieces long")

