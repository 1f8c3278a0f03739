"""Byte-level BPE: encoding and decoding of whole texts with a rank file.

Each Arrow batch is split into pre-tokens by the pattern; the distinct ones that were not met before are merged together.
They are put into buckets of equal padded length, as rows of a numpy matrix of token ids. In every round, each row finds
the rank of every neighbouring pair (a lookup in a sorted table of hashed pairs), merges its leftmost pair of least rank and
closes the gap; rows without a mergeable pair leave the matrix. Long rows merge, in one round, all places of their least
pair from left to right, which gives the same ids, as a merged token never forms a pair of lower rank than its own.

Narrow: one pass, no shuffle. Results of pre-tokens are remembered per task, in bounded memory.

Defined results: null counts as the empty text, which has no tokens; every row gives a row; other columns are kept out.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import small_batches

_NONE = np.int32((1 << 31) - 1)
#: Pre-tokens that a worker remembers, a long one counting as several: some 30 MB.
_REMEMBERED = 1 << 17
_LONG = 128
_CELLS = 1 << 18


class Vocabulary:
    """Ranks of byte strings, and the pairs of tokens that merge."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        pairs = [(ranks[t[:i]] * len(self.tokens) + ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        keys, values = np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64)
        # open addressing: a pair stands at its hash or one of the next places
        self.bits = max(4, int(np.ceil(np.log2(len(keys) * 4 + 2))))
        self.slots = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, _NONE, np.int32)
        at, left = self._hash(keys), np.arange(len(keys))
        while len(left):
            free = self.slots[at] < 0
            place, first = np.unique(at[free], return_index=True)
            chosen = np.flatnonzero(free)[first]
            self.slots[place], self.values[place] = keys[left[chosen]], values[left[chosen]]
            rest = np.ones(len(left), bool)
            rest[chosen] = False
            left, at = left[rest], (at[rest] + 1) & ((1 << self.bits) - 1)

    def _hash(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that a pair merges into, which is also its id; _NONE for pairs that do not merge and for padding (negative ids)."""
        pairs = left.astype(np.int64) * len(self.tokens) + right
        at = self._hash(pairs)
        found = self.slots[at]
        out = np.where(found == pairs, self.values[at], _NONE)
        left_over = np.nonzero((found != pairs) & (found >= 0))  # another pair stands there: look on
        pairs, at = pairs[left_over], at[left_over]
        while len(at):
            at = (at + 1) & ((1 << self.bits) - 1)
            found = self.slots[at]
            out[left_over] = np.where(found == pairs, self.values[at], _NONE)
            more = (found != pairs) & (found >= 0)
            left_over, pairs, at = tuple(x[more] for x in left_over), pairs[more], at[more]
        out[(left < 0) | (right < 0)] = _NONE
        return out

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of each pre-token, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        buckets: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            whole = self.ranks.get(w)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            else:
                buckets.setdefault(-(-len(w) // 4) * 4 if len(w) <= 32 else 1 << (len(w) - 1).bit_length(), []).append(i)
        for width, members in buckets.items():
            step = max(1, _CELLS // width)
            for k in range(0, len(members), step):
                self._merge_bucket(words, members[k:k + step], width, out)
        return out

    def _merge_bucket(self, words: list[bytes], rows: list[int], width: int, out: list[bytes]) -> None:
        ids = np.full((len(rows), width), -1, np.int32)
        number, size = np.array(rows), np.array([len(words[i]) for i in rows])
        ids[np.arange(width)[None, :] < size[:, None]] = self.byte_ids[np.frombuffer(b"".join([words[i] for i in rows]), np.uint8)]
        ranks = self.pair_ranks(ids[:, :-1], ids[:, 1:])
        while len(number):
            best = ranks.argmin(axis=1)  # the leftmost of least rank
            least = ranks[np.arange(len(number)), best]
            done = least == _NONE
            if done.any():
                flat = ids[done][np.arange(ids.shape[1])[None, :] < size[done][:, None]].astype("<u4").tobytes()
                ends = (np.cumsum(size[done]) * 4).tolist()
                for i, start, end in zip(number[done].tolist(), [0, *ends], ends, strict=False):
                    out[i] = flat[start:end]
                live = ~done
                number, size, ids, ranks, best, least = number[live], size[live], ids[live], ranks[live], best[live], least[live]
                if not len(number):
                    break
            if width >= _LONG:
                ids, size = self._merge_everywhere(ids, ranks, least, size)
                ranks = self.pair_ranks(ids[:, :-1], ids[:, 1:])
            else:
                every, place = np.arange(len(number)), np.arange(ids.shape[1] - 1)
                ids[every, best] = least
                shift = place[None, :] > best[:, None]
                ids[:, :-1] = np.where(shift, ids[:, 1:], ids[:, :-1])
                ids[:, -1] = -1
                size = size - 1
                ranks[:, :-1] = np.where(shift[:, :-1], ranks[:, 1:], ranks[:, :-1])
                ranks[:, -1] = _NONE
                ranks[every, best] = self.pair_ranks(ids[every, best], ids[every, best + 1]) if ids.shape[1] > 1 else _NONE
                before = np.maximum(best - 1, 0)
                ranks[every, before] = np.where(best > 0, self.pair_ranks(ids[every, before], ids[every, best]), ranks[every, before])
            used = max(2, int(size.max()))
            if used < ids.shape[1]:
                ids, ranks = ids[:, :used].copy(), ranks[:, :used - 1].copy()

    @staticmethod
    def _merge_everywhere(ids: np.ndarray, ranks: np.ndarray, least: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hit = ranks == least[:, None]
        # of overlapping places (a run of one symbol), every second one counts, from the left
        flat = np.zeros((len(ids), ids.shape[1]), bool)
        flat[:, :-1] = hit
        f = flat.ravel()
        place = np.flatnonzero(f)
        start = np.ones(len(place), bool)
        start[1:] = place[1:] != place[:-1] + 1
        first = np.maximum.accumulate(np.where(start, np.arange(len(place)), 0))
        taken = place[(np.arange(len(place)) - first) % 2 == 0]
        row = taken // ids.shape[1]
        flat_ids = ids.ravel().copy()
        flat_ids[taken] = least[row]
        keep = flat_ids >= 0
        keep[taken + 1] = False
        size = size - np.bincount(row, minlength=len(ids))
        new = np.full((len(ids), max(2, int(size.max()))), -1, np.int32)
        new[np.arange(new.shape[1])[None, :] < size[:, None]] = flat_ids[keep]
        return new, size


def _room(words: list[str]) -> int:
    return len(words) + sum(map(len, words)) // 16


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One per worker process, so that tasks that follow each other share what it remembers."""
    return Encoder(vocabulary(path, pattern))


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    with open(path, "rb") as f:
        return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)


class Encoder:
    """Encodes texts; remembers pre-tokens, and forgets all of them when they are too many."""

    def __init__(self, v: Vocabulary):
        self.v, self.known, self.size = v, {}, 0

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.v.split(t) for t in texts]
        new = list(set().union(*split) - self.known.keys())
        self.size += _room(new)
        if self.size > _REMEMBERED:
            self.known, new = {}, list(set().union(*split))
            self.size = _room(new)
        self.known.update(zip(new, self.v.merge([w.encode() for w in new]), strict=True))
        known = self.known.__getitem__
        return [b"".join(map(known, s)) for s in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.v.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _groups(texts: list[str], limit: int = 1 << 20) -> Iterator[list[str]]:
    """Stretches of texts of about a million characters."""
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t)
        if size >= limit:
            yield group
            group, size = [], 0
    if group:
        yield group


def encode(docs: DataFrame, path: str, pattern: str, keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit; unless keep_ids is false), ids_sha256, and
    decoded_sha256 of the bytes that the ids decode to."""
    def run(batches):
        coder = encoder(path, pattern)
        for batch in batches:
            at, texts = 0, batch.column("text").fill_null("").to_pylist()
            for group in _groups(texts):
                ids = coder.encode(group)
                columns = [batch.column("doc_id").slice(at, len(group)), pa.array([len(x) // 4 for x in ids], pa.int64())]
                if keep_ids:
                    columns.append(pa.array(ids, pa.binary()))
                columns.append(pa.array([hashlib.sha256(x).hexdigest() for x in ids]))
                columns.append(pa.array([hashlib.sha256(coder.decode(x)).hexdigest() for x in ids]))
                at += len(group)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc_id", "n_tokens", *["ids"] * keep_ids, "ids_sha256", "decoded_sha256"]
    schema = "doc_id long, n_tokens long, " + "ids binary, " * keep_ids + "ids_sha256 string, decoded_sha256 string"
    return small_batches(docs).selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, schema)
