"""Substring dedup on words, with suffix automata of reference shards.

A shard holds the stretches of text that share a key (see `repeats`): those passages of the corpus that may repeat each other.
Its automaton takes them in corpus order. While a stretch is streamed through, the link of the current state tells the
matching statistic: the longest suffix of the words so far that also ends earlier, in this stretch or one before it. Words
of windows that reach the threshold are removed; overlapping windows make one maximal span.

The shards grow with the corpus, so that none is broadcast whole: each one meets the stretches of its key in one task.

Defined results: null or empty texts have no words and keep the empty text; shorter texts than a window lose nothing; rows
that repeat id and text lose what the first such row loses; of rows with one id and different texts, the order is that of
the text's hash; a null id ranks first; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .repeats import Kind, covered, cut, repeated
from .shared import ranked, small_batches


class SuffixAutomaton:
    """Grows by one symbol at a time; texts are kept apart by symbols of their own."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.last = [-1], [0], 0

    def extend(self, symbol: int) -> int:
        """Add a symbol; the length of the longest suffix of all so far that also ends earlier."""
        nexts, link, length = self.next, self.link, self.length
        cur, p = len(nexts), self.last
        nexts.append({})
        length.append(length[p] + 1)
        link.append(0)
        while p >= 0 and symbol not in nexts[p]:
            nexts[p][symbol] = cur
            p = link[p]
        if p >= 0:
            q = nexts[p][symbol]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nexts[p].get(symbol) == q:
                    nexts[p][symbol] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        self.last = cur
        return length[link[cur]]


def shard_spans(contents: list[np.ndarray], window: int) -> list[tuple[int, int, int]]:
    """(content, start, end) of the stretches covered by windows that start earlier in the shard."""
    names: dict[int, int] = {}
    automaton, out = SuffixAutomaton(), []
    for i, content in enumerate(contents):
        automaton.extend(-1 - i)
        start = end = -1
        for at, word in enumerate(content.tolist()):
            if automaton.extend(names.setdefault(word, len(names))) >= window and at + 1 >= window:
                if at + 1 - window > end:
                    if end >= 0:
                        out.append((i, start, end))
                    start = at + 1 - window
                end = at + 1
        if end >= 0:
            out.append((i, start, end))
    return out


def remove_repeats(docs: DataFrame, window: int = 20, gram: int = 5) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (the kept words, joined by one space) of every row."""
    rows = small_batches(ranked(docs))
    found = repeated(rows, Kind(True, window, gram), lambda shards: [shard_spans(contents, window) for contents in shards])

    def keep(batches):
        for batch in batches:
            counts, removed, kept = [], [], []
            for text, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("text", "starts", "ends")), strict=True):
                words = text.encode().split()
                gone = covered(len(words), starts, ends)
                counts.append(len(words))
                removed.append(int(gone.sum()))
                kept.append(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if starts else words))
            digests = [hashlib.sha256(k).hexdigest() for k in kept]
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array([k.decode() for k in kept], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return cut(rows, found, keep, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
