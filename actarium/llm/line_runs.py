"""Line dedup by levelled sorted runs of line hashes.

The key of a line is its text without the white space at both ends, A-Z in lower case; keys shorter than `least_chars` code
points are never judged. A run is a written table of (hash of a key, document), dealt by hash and sorted by hash and falling
document, with at most `copies` documents of a hash, the largest ones: more cannot change the result. Every new batch is cut
to that form before its shuffle (a line that a third of all documents share leaves a task as `copies` rows), merge-anti-joined
with the runs in one sorted pass (pairs that the runs hold, or that `copies` larger documents outrank, go) and added as a run
of level 0. A level with `fan` runs is compacted to one run of the next level, so that a batch meets few runs.

A key that the compacted runs find in `copies` documents loses its lines in all but the largest one. A bit pattern of fixed
size lets a task tell lines that may be concerned; only those are joined, and only their documents are shuffled.

Defined results: null or empty text is one empty line; rows that share an id are one document (a null id is the
smallest); an empty table gives no row; keys are compared by 64-bit hashes; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import bits_of, has_bit, parted
from .shared import ranked, small_batches, written

_SPACE = b" \t\n\x0b\x0c\r"
_CONTINUATION = bytes(range(0x80, 0xC0))
_PATTERN_BITS = 26
#: Pairs that a task gathers before it cuts them to the largest documents of each key.
_GATHERED = 1 << 20


def line_key(line: bytes, least_chars: int) -> int | None:
    """Hash of the key of a line, none if the key is too short."""
    if len(line) < least_chars:
        return None
    key = line.strip(_SPACE)
    if len(key) < least_chars or (not key.isascii() and len(key.translate(None, _CONTINUATION)) < least_chars):
        return None
    return xxhash.xxh3_64_intdigest(key.lower())


def foremost(key: np.ndarray, rank: np.ndarray, copies: int) -> np.ndarray:
    """Of pairs sorted by key and falling rank: which are among the first `copies` different ranks of their key (the first
    of equal pairs)."""
    if not len(key):
        return np.zeros(0, bool)
    new_key = np.ones(len(key), bool)
    new_key[1:] = key[1:] != key[:-1]
    new = new_key.copy()
    new[1:] |= rank[1:] != rank[:-1]
    order = np.cumsum(new)
    at = np.maximum.accumulate(np.where(new_key, np.arange(len(key)), 0))
    return new & (order - order[at] < copies)


def _pairs(key: np.ndarray, rank: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(rank)], names=["key", "rank"])


def line_pairs(docs: DataFrame, copies: int, least_chars: int) -> DataFrame:
    """key, rank of the lines of `ranked` documents; every task keeps the largest documents of each key only."""
    def found(batches):
        keys, ranks, size = [], [], 0

        def out():
            key, rank = np.concatenate(keys).view(np.int64), np.concatenate(ranks)
            order = np.lexsort((~rank, key))
            key, rank = key[order], rank[order]
            keep = foremost(key, rank, copies)
            return _pairs(key[keep], rank[keep])

        for batch in batches:
            for text, rank in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("rank").to_pylist(), strict=True):
                own = {k for line in text.split(b"\n") if (k := line_key(line, least_chars)) is not None}
                keys.append(np.fromiter(own, np.uint64, len(own)))
                ranks.append(np.full(len(own), rank, np.int64))
                size += len(own)
                if size >= _GATHERED:
                    yield out()
                    keys, ranks, size = [], [], 0
        if size:
            yield out()

    return small_batches(docs.select("text", "rank")).mapInArrow(found, "key long, rank long")


def _streamed(copies: int, only_new: bool):
    """Over partitions sorted by key, falling rank and `new`: the foremost pairs of each key, or those of them that the batch adds."""
    def merged(batches):
        rest = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)]
        for batch in (*batches, None):
            if batch is not None:
                columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "rank", "new")]
                rest = [np.concatenate(x) for x in zip(rest, columns, strict=True)]
            keep = foremost(*rest[:2], copies)
            rest = [c[keep] for c in rest]
            # the last key may go on in the next batch: its foremost pairs, at most `copies`, wait
            end = int(np.searchsorted(rest[0], rest[0][-1])) if batch is not None and len(rest[0]) else len(rest[0])
            whole = rest[2][:end] if only_new else slice(0, end)
            yield _pairs(rest[0][:end][whole], rest[1][:end][whole])
            rest = [c[end:] for c in rest]

    return merged


class LineRuns:
    """Levelled sorted runs of (key, rank)."""

    def __init__(self, copies: int = 3, fan: int = 3):
        self.copies, self.fan, self.levels = copies, fan, []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def _merge(self, parts: list[tuple[DataFrame, bool]], only_new: bool) -> DataFrame:
        tagged = [df.select("key", "rank", F.lit(new).alias("new")) for df, new in parts]
        both = tagged[0]
        for df in tagged[1:]:
            both = both.unionByName(df)
        return both.repartition("key").sortWithinPartitions("key", F.desc("rank"), "new").mapInArrow(_streamed(self.copies, only_new), "key long, rank long")

    def add(self, pairs: DataFrame) -> None:
        """Adds what is new in a batch of pairs, then compacts full levels."""
        run = written(self._merge([*((r, False) for r in self.runs()), (pairs, True)], only_new=True), "line-run")
        level = 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < self.fan:
                return
            run = written(self._merge([(r, False) for r in self.levels[level]], only_new=False), "line-run")
            self.levels[level] = []
            level += 1

    def repeated(self) -> DataFrame:
        """key, last: keys that at least `copies` documents hold, and the largest of these documents."""
        whole = self._merge([(r, False) for r in self.runs()], only_new=False)
        return whole.groupBy("key").agg(F.count("*").alias("n"), F.max("rank").alias("last")).where(F.col("n") >= self.copies).select("key", "last")


def drop_repeated(docs: DataFrame, copies: int = 3, least_chars: int = 20, batches: int = 6, fan: int = 3) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept (text), kept_sha256 of every document."""
    spark = docs.sparkSession
    base = small_batches(ranked(docs))
    batch = F.pmod(F.xxhash64("rank"), F.lit(batches)).cast("int")
    # every pair once, so that no batch reads the texts again
    pairs = written(line_pairs(base, copies, least_chars).withColumn("batch", batch), "line-pairs")
    store = LineRuns(copies, fan)
    for b in range(batches):
        store.add(pairs.where(F.col("batch") == b).select("key", "rank"))
    repeated = written(store.repeated(), "repeated-lines")
    shared = spark.sparkContext.broadcast(bits_of(repeated, F.shiftrightunsigned("key", 64 - _PATTERN_BITS), _PATTERN_BITS))

    def concerned(batches):
        for batch in batches:
            out: list[list] = [[], [], []]
            for rank, mark, text in zip(batch.column("rank").to_pylist(), batch.column("mark").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                own = {k for line in text.split(b"\n") if (k := line_key(line, least_chars)) is not None}
                out[0] += own
                out[1] += [rank] * len(own)
                out[2] += [mark] * len(own)
            key = np.array(out[0], np.uint64)
            keep = has_bit(shared.value, key >> np.uint64(64 - _PATTERN_BITS))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)[keep]), *(pa.array(np.array(c, np.int64)[keep]) for c in out[1:])], names=["key", "rank", "mark"])

    held = base.mapInArrow(concerned, "key long, rank long, mark long")
    lost = held.join(repeated, "key").where(F.col("rank") < F.col("last"))
    # rows that repeat id and text name the same keys: a set, no longer than the document has lines
    lost = written(lost.groupBy("rank", "mark").agg(F.collect_set("key").alias("keys")), "lost-lines")
    inside, outside = parted(base, lost)

    def cut(batches):
        for batch in batches:
            texts, out = batch.column("text").cast(pa.binary()).to_pylist(), []
            lists = batch.column("keys").to_pylist() if "keys" in batch.schema.names else [None] * len(texts)
            for text, keys in zip(texts, lists, strict=True):
                lines = text.split(b"\n")
                gone = {k & 0xFFFFFFFFFFFFFFFF for k in keys or ()}
                kept = [line for line in lines if line_key(line, least_chars) not in gone] if gone else lines
                data = b"\n".join(kept)
                out.append((len(lines), len(lines) - len(kept), data.decode(), hashlib.sha256(data).hexdigest()))
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=["doc_id", "n_lines", "n_dropped", "kept", "kept_sha256"])

    schema = "doc_id long, n_lines long, n_dropped long, kept string, kept_sha256 string"
    judged = inside.join(lost, ["rank", "mark"], "left").select("doc_id", "text", "keys").mapInArrow(cut, schema)
    return judged.unionByName(outside(cut, schema))
