"""Suffix-array dedup on bytes, with a linear grouping construction.

A shard holds the stretches of bytes that share a key (see `repeats`). Its suffix array is built in two phases. The first one
groups the suffixes by their Lyndon prefixes: groups are processed in descending order; each member's nearest smaller
position to the left (found over the pointers of what is processed) is moved up, as its prefix grows by the members' one, by
as many steps as members point to it. The second one emits the order within the groups: whatever follows a suffix that is in
place, along the same pointers, is the next of its group; nothing is renamed or sorted again.

Suffixes with equal windows then stand side by side; all but the first of them in corpus order are repeats.

Defined results: null or empty texts have no bytes; shorter texts than a window lose nothing; rows that repeat id and text
lose what the first such row loses; of rows with one id and different texts, the order is that of the text's hash; a null
id ranks first; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .repeats import Kind, covered, cut, repeated
from .seqhash import Rolling, mix, ragged
from .shared import ranked, small_batches


def suffix_array(text: list[int]) -> list[int]:
    """Starts of the suffixes of `text` (positive numbers and zeros as separators) in ascending order; a suffix that is a
    prefix of another comes first."""
    n = len(text)
    if not n:
        return []
    places: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        places.setdefault(c, []).append(i)
    members = [places[c] for c in sorted(places)]
    above, below = list(range(1, len(members))) + [-1], list(range(-1, len(members) - 1))
    group = [0] * n
    for g, m in enumerate(members):
        for i in m:
            group[i] = g
    previous, settled = [-1] * n, [False] * (n + 1)  # the last entry stands for the position before the text
    current, order = len(members) - 1, []
    while current >= 0:
        own = [i for i in members[current] if group[i] == current]
        own.sort()
        order.append(own)
        touched: dict[int, int] = {}
        for i in own:
            j = i - 1
            while settled[j]:
                j = previous[j]
            previous[i] = j
            settled[i] = True
            if j >= 0:
                touched[j] = touched.get(j, 0) + 1
        if touched:
            made: dict[tuple[int, int], int] = {}
            by_count = touched.items() if max(touched.values()) == 1 else sorted(touched.items(), key=lambda x: -x[1])
            for j, count in by_count:
                old = group[j]
                new = made.get((old, count))
                if new is None:
                    new = made[old, count] = len(members)
                    members.append([])
                    up = above[old]
                    above.append(up)
                    below.append(old)
                    above[old] = new
                    if up >= 0:
                        below[up] = new
                members[new].append(j)
                group[j] = new
        current = below[current]
    order.reverse()
    free, at = [0] * len(members), 0
    for own in order:
        if own:
            free[group[own[0]]] = at
            at += len(own)
    out, placed = [-1] * n, [False] * (n + 1)
    placed[-1] = True

    def settle(j: int) -> None:
        while not placed[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = True
            j = previous[j]

    settle(n - 1)
    for i in range(n):
        settle(out[i] - 1)
    return out


def shard_spans(contents: list[np.ndarray], window: int) -> list[tuple[int, int, int]]:
    """(content, start, end) of the stretches covered by windows that start earlier in the shard."""
    return sorted_spans(contents, candidates([contents], window)[0], window)


def sorted_spans(contents: list[np.ndarray], stretches: list[tuple[int, int, int]], window: int) -> list[tuple[int, int, int]]:
    """Those of the stretches that candidates gave. Of equal ones, all but the first are covered whole; only the first ones
    are sorted."""
    kept, out, different = [], [], {}
    for i, a, b in stretches:
        if different.setdefault(contents[i][a:b].tobytes(), len(kept)) == len(kept):
            kept.append((i, a, b))
        else:
            out.append((i, a, b))
    contents = [contents[i][a:b] for i, a, b in kept]
    raw = b"\0".join(c.tobytes() for c in contents)
    text, owner, first, full = [], [], [], []
    for i, c in enumerate(contents):
        first.append(len(text))
        text += (c.astype(np.int64) + 1).tolist()
        text.append(0)
        owner += [i] * (len(c) + 1)
        full += [True] * (len(c) - window + 1) + [False] * window
    spans: dict[int, list[int]] = {}
    before, least, members = None, -1, []
    for p in [*suffix_array(text), None]:
        if p is not None and not full[p]:
            continue
        here = raw[p:p + window] if p is not None else None
        if here == before and p is not None:
            members.append(p)
            continue
        if len(members) > 1:
            least = min(members)
            for m in members:
                if m != least:
                    spans.setdefault(owner[m], []).append(m)
        before, members = here, [p]
    for k, places in spans.items():
        i, begin, _ = kept[k]
        places.sort()
        start = end = -1
        for p in places:
            p += begin - first[k]
            if p > end:
                if end >= 0:
                    out.append((i, start, end))
                start = p
            end = p + window
        out.append((i, start, end))
    return out


def candidates(shards: list[list[np.ndarray]], window: int) -> list[list[tuple[int, int, int]]]:
    """For each shard (content, start, end) of the stretches of windows whose hash occurs twice in it; no other window can
    repeat."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in shards]
    contents, number = [c for s in shards for c in s], np.array([len(s) for s in shards], np.int64)
    length, shard = np.array([len(c) for c in contents], np.int64), np.repeat(np.arange(len(shards)), number)
    first, sizes = np.cumsum(length + 1) - length - 1, length - window + 1
    text = np.zeros(int(length.sum()) + len(length), np.int64)
    text[ragged(first, length)] = np.concatenate(contents).astype(np.int64) + 1
    at = ragged(first, sizes)
    hashes = Rolling(text).grams(window, 4)[at] ^ np.repeat(mix(shard.astype(np.uint64)), sizes)
    order = np.argsort(hashes)
    same = hashes[order][1:] == hashes[order][:-1]
    twice = np.zeros(len(text) + 1, bool)  # one ahead; no window starts at the end of a content
    twice[at[order[1:][same]] + 1] = True
    twice[at[order[:-1][same]] + 1] = True
    edge = np.flatnonzero(twice[1:] != twice[:-1])
    owner = np.searchsorted(first, edge[0::2], side="right") - 1
    inner = owner - (np.cumsum(number) - number)[shard[owner]]
    for s, *stretch in zip(*(x.tolist() for x in (shard[owner], inner, edge[0::2] - first[owner], edge[1::2] - first[owner] + window - 1)), strict=True):
        out[s].append(tuple(stretch))
    return out


def remove_repeats(docs: DataFrame, window: int = 100, gram: int = 24) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes) of every row."""
    rows = small_batches(ranked(docs))
    found = repeated(rows, Kind(False, window, gram), lambda shards: [sorted_spans(c, s, window) for c, s in zip(shards, candidates(shards, window), strict=True)])

    def keep(batches):
        for batch in batches:
            sizes, removed, spans, kept = [], [], [], []
            for text, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("text", "starts", "ends")), strict=True):
                data = text.encode()
                gone = covered(len(data), starts, ends)
                sizes.append(len(data))
                removed.append(int(gone.sum()))
                spans.append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
                kept.append(np.frombuffer(data, np.uint8)[~gone].tobytes() if starts else data)
            counts = [pa.array(c, pa.int64()) for c in (sizes, removed, spans)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), pa.array(kept, pa.binary())],
                                             names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return cut(rows, found, keep, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
