"""Stretches of a fixed number of symbols that start earlier in the corpus: the part that byte and word operators share.

Every window of w symbols gets its k-gram of least hash as key, which equal windows share. Neighbouring windows with one
place of that gram form a run. Keys that occur once in the corpus can hold no repeated window; a bit pattern of fixed size lets tasks drop
most of them before anything but the keys is shuffled (wrongly kept ones do no harm). Equal runs are collapsed to the first
one before the next shuffle, so that thousands of copies cost one row per task. Where a key has runs that differ, the first
of each kind is brought to the key's shard, and the operator's own structure (suffix array, suffix automaton) finds the
windows that start earlier. Keys with very many different runs are divided by further hashes of the same windows first.

The order of windows is (rank of the id, hash of the text, start); rows that repeat id and text share their windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .seqhash import Rolling, chunks, mix, ragged, window_min, word_hashes
from .shared import written

PATTERN_BITS, _DOCUMENT_BITS = 26, 24
#: Runs of one key from which it is divided, and the number of further hashes.
MANY, FURTHER = 64, 4
#: Bytes of contents from which the keys that a task has gathered are searched.
SEARCHED_BYTES = 1 << 20


@dataclass(frozen=True)
class Kind:
    """What counts as a symbol, how many make a window, and the length of the hashed grams."""

    words: bool
    window: int
    gram: int


@dataclass
class Packed:
    """Symbols of some texts; text r has symbols first[r] to first[r] + length[r]."""

    symbols: np.ndarray
    first: np.ndarray
    length: np.ndarray


def packed(texts: pa.Array, kind: Kind) -> Iterator[tuple[int, Packed]]:
    for row, _, buf, starts in chunks(texts):
        if kind.words:
            hashes, _, _, first = word_hashes(buf, starts)
            yield row, Packed(hashes, first[:-1], np.diff(first))
        else:
            yield row, Packed(buf, starts[:-1], np.diff(starts) - 1)


def chosen(grams: np.ndarray, w: int) -> np.ndarray:
    """For each stretch of w grams the place of the one of least hash (by its upper bits), the first of equals."""
    low, block = np.uint64((1 << 24) - 1), (1 << 24) - w
    out = []
    for at in range(0, max(1, len(grams) - w + 1), block):
        part = grams[at:at + block + w - 1]
        least = window_min((part & ~low) | np.arange(len(part), dtype=np.uint64), w)
        out.append((least & low).astype(np.int64) + at)
    return np.concatenate(out)


def runs(p: Packed, kind: Kind) -> tuple[np.ndarray, ...]:
    """row, start in the row, number of windows, key and hash of the content of every run. All windows of a run have the
    same place of their least gram, so that no two of them are equal."""
    rolling = Rolling(p.symbols)
    grams = rolling.grams(kind.gram)
    gram = chosen(grams, kind.window - kind.gram + 1)
    sizes = np.maximum(p.length - kind.window + 1, 0)
    row = np.repeat(np.arange(len(p.first)), sizes)
    place = ragged(p.first, sizes)
    if not len(place):
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    gram = gram[place]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(row)))
    content = rolling.of(place[at], place[at] + count + kind.window - 1, 2)
    return row[at], place[at] - p.first[row[at]], count, mix(grams[gram[at]], 3), content


def divided(symbols: np.ndarray, length: np.ndarray, kind: Kind) -> tuple[np.ndarray, ...]:
    """Of contents that stand one after the other: content, start in it, number of windows and further key of their runs under
    several further hashes."""
    rolling, keys = Rolling(symbols), None
    for seed in range(31, 31 + FURTHER):
        grams = rolling.grams(kind.gram, seed)
        least = mix(grams[chosen(grams, kind.window - kind.gram + 1)], seed)
        keys = least if keys is None else mix(keys + least)
    first, sizes = np.cumsum(length) - length, length - kind.window + 1
    row, keys = np.repeat(np.arange(len(length)), sizes), keys[ragged(first, sizes)]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (keys[1:] != keys[:-1])
    at = np.flatnonzero(new)
    return row[at], at - (np.cumsum(sizes) - sizes)[row[at]], np.diff(np.append(at, len(row))), keys[at]


def _binary(symbols: np.ndarray, length: np.ndarray) -> pa.Array:
    """Stretches that stand one after the other, each as its bytes."""
    at = np.zeros(len(length) + 1, np.int64)
    np.cumsum(length * symbols.itemsize, out=at[1:])
    return pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(symbols))])


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def bits_of(frame: DataFrame, bit, size: int) -> np.ndarray:
    """A pattern of 2**size bits with those of the column set; combined in the tasks before it comes to the driver."""
    words = frame.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toArrow()
    pattern = np.zeros(1 << (size - 6), np.uint64)
    pattern[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return pattern


def has_bit(pattern: np.ndarray, bit: np.ndarray) -> np.ndarray:
    return (pattern[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


def parted(docs: DataFrame, keys: DataFrame, mark: str = "mark") -> tuple[DataFrame, Callable[[Callable, str], DataFrame]]:
    """docs in two: those whose mark (a hash of the text) may be among the keys, by a bit pattern of a fixed size, and those whose is not.
    Only the first part needs a shuffle to be joined with them. The second one is given as a function that maps it."""
    shared = docs.sparkSession.sparkContext.broadcast(bits_of(keys, F.shiftrightunsigned(mark, 64 - _DOCUMENT_BITS), _DOCUMENT_BITS))

    def side(batches, inside: bool):
        for batch in batches:
            yield batch.filter(pa.array(has_bit(shared.value, batch.column(mark).to_numpy().view(np.uint64) >> np.uint64(64 - _DOCUMENT_BITS)) == inside))

    def others(fn: Callable, schema) -> DataFrame:
        return docs.mapInArrow(lambda batches: fn(side(batches, False)), schema)

    return docs.mapInArrow(lambda batches: side(batches, True), docs.schema), others


def _pieces(places: np.ndarray, length: np.ndarray, most: int = 1 << 20) -> Iterator[np.ndarray]:
    """The places in stretches whose lengths come to about `most`."""
    if len(places):
        yield from np.split(places, np.flatnonzero(np.diff(np.cumsum(length[places]) // most)) + 1)


def repeated(docs: DataFrame, kind: Kind, search_shards: Callable[[list[list[np.ndarray]]], list[list[tuple[int, int, int]]]]) -> DataFrame:
    """Intervals (rank, mark, start, end) of symbols that repeated windows cover, in `docs` (rank, mark, text).

    search_shards gets, for some keys, the contents of each in their order, and returns for each (content, start, end) of the
    covered stretches."""
    def keys(batches):
        for batch in batches:
            for _, p in packed(batch.column("text"), kind):
                yield pa.RecordBatch.from_arrays([_long(runs(p, kind)[3])], names=["key"])

    twice = docs.select("text").mapInArrow(keys, "key long").groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = docs.sparkSession.sparkContext.broadcast(bits_of(twice, F.shiftrightunsigned("key", 64 - PATTERN_BITS), PATTERN_BITS))

    def candidates(batches):
        pattern = shared.value
        for batch in batches:
            rank, mark = batch.column("rank").to_numpy(), batch.column("mark").to_numpy()
            for first, p in packed(batch.column("text"), kind):
                row, start, count, key, content = runs(p, kind)
                keep = has_bit(pattern, key >> np.uint64(64 - PATTERN_BITS))
                at = first + row[keep]
                columns = [pa.array(rank[at]), pa.array(mark[at]), pa.array(start[keep], pa.int32()), pa.array(count[keep], pa.int32()), _long(key[keep]), _long(content[keep])]
                yield pa.RecordBatch.from_arrays(columns, names=["rank", "mark", "start", "windows", "key", "content"])

    found = written(docs.select("rank", "mark", "text").mapInArrow(candidates, "rank long, mark long, start int, windows int, key long, content long"), "runs")
    kinds = written(found.groupBy("key", "content").agg(F.min(F.struct("rank", "mark", "start")).alias("first"), F.max(F.struct("rank", "mark", "start")).alias("last"), F.first("windows").alias("windows")), "run-kinds")
    again = kinds.where("first <> last").select("key", "content", "first")
    later = found.join(again, ["key", "content"]).where(F.struct("rank", "mark", "start") > F.col("first"))
    later = later.select("rank", "mark", "start", (F.col("start") + F.col("windows") + (kind.window - 1)).alias("end"))

    several = kinds.groupBy("key").agg(F.count("*").alias("kinds")).where("kinds > 1")
    wanted = kinds.join(several, "key").select("first.rank", "first.mark", F.struct(F.col("first.start").alias("start"), "windows", "key", "kinds").alias("run"))
    wanted = wanted.groupBy("rank", "mark").agg(F.collect_list("run").alias("runs"))
    wanted = written(wanted, "wanted-runs")
    texts = parted(docs, wanted)[0].join(wanted, ["rank", "mark"]).dropDuplicates(["rank", "mark"]).select("rank", "mark", "text", "runs")

    def contents(batches):
        for batch in batches:
            rank, mark, lists = batch.column("rank").to_numpy(), batch.column("mark").to_numpy(), batch.column("runs")
            ends, fields = np.append(0, np.cumsum(lists.value_lengths().to_numpy())), lists.flatten()
            starts, windows, keys, kinds_of = (fields.field(c).to_numpy() for c in ("start", "windows", "key", "kinds"))
            for first, p in packed(batch.column("text"), kind):
                of_row = np.diff(ends[first:first + len(p.first) + 1])
                runs_of = np.repeat(np.arange(len(of_row)), of_row)
                own, whole = slice(int(ends[first]), int(ends[first + len(p.first)])), windows[ends[first]:ends[first + len(p.first)]].astype(np.int64) + kind.window - 1
                ahead, few = p.first[runs_of] + starts[own], kinds_of[own] <= MANY
                for division in (False, True):
                    for chosen_runs in _pieces(np.flatnonzero(few != division), whole):
                        symbols = p.symbols[ragged(ahead[chosen_runs], whole[chosen_runs])]
                        key, begin, length, row = keys[own][chosen_runs], starts[own][chosen_runs].astype(np.int64), whole[chosen_runs], runs_of[chosen_runs]
                        if division:
                            which, inner, count, more = divided(symbols, length, kind)
                            symbols = symbols[ragged((np.cumsum(length) - length)[which] + inner, count + kind.window - 1)]
                            key, begin, length, row = key[which] ^ more.view(np.int64), begin[which] + inner, count + kind.window - 1, row[which]
                        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(rank[first + row]), pa.array(mark[first + row]), pa.array(begin.astype(np.int32)), _binary(symbols, length)], names=["key", "rank", "mark", "start", "content"])

    shards = texts.mapInArrow(contents, "key long, rank long, mark long, start int, content binary")
    shards = shards.repartition("key").sortWithinPartitions("key", "rank", "mark", "start")
    dtype = np.uint64 if kind.words else np.uint8

    def search(batches):
        key, size, many = None, 0, []

        def done():
            found = search_shards([[np.frombuffer(r[3], dtype) for r in rows] for rows in many])
            spans = [(rows[i][0], rows[i][1], rows[i][2] + a, rows[i][2] + b) for rows, stretches in zip(many, found, strict=True) for i, a, b in stretches]
            if spans:
                kinds_of = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*spans, strict=True), kinds_of, strict=True)], names=["rank", "mark", "start", "end"])

        for batch in batches:
            for k, *row in zip(*(batch.column(c).to_pylist() for c in ("key", "rank", "mark", "start", "content")), strict=True):
                if k != key:
                    if size >= SEARCHED_BYTES:
                        yield from done()
                        size, many = 0, []
                    key = k
                    many.append([])
                many[-1].append(row)
                size += len(row[3])
        if many:
            yield from done()

    inside = shards.mapInArrow(search, "rank long, mark long, start int, end int")
    return later.unionByName(inside)


def cut(docs: DataFrame, intervals: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """fn over Arrow batches of all rows of docs with the lists of their intervals (starts, ends; null: none). A document has no
    more of them than symbols; documents without any are not shuffled."""
    lists = intervals.groupBy("rank", "mark").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    lists = written(lists.select("rank", "mark", F.col("spans.start").alias("starts"), F.col("spans.end").alias("ends")), "intervals")
    inside, outside = parted(docs, lists)

    def without(batches):
        for batch in batches:
            none = pa.nulls(batch.num_rows, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), none, none], names=["doc_id", "text", "starts", "ends"])

    return inside.join(lists, ["rank", "mark"], "left").select("doc_id", "text", "starts", "ends").mapInArrow(fn, schema).unionByName(outside(lambda batches: fn(without(batches)), schema))


def covered(n: int, starts: list[int] | None, ends: list[int] | None) -> np.ndarray:
    """Which of n symbols the intervals cover."""
    change = np.zeros(n + 1, np.int64)
    if starts:
        np.add.at(change, starts, 1)
        np.add.at(change, ends, -1)
    return np.cumsum(change[:-1]) > 0
