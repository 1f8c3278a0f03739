"""Vector code compression: product quantisation with per-dimension value dictionaries.

Vectors become integers floor(scale * x) and are written once in blocks. Every block holds, per dimension, the sorted
dictionary of its distinct integers and one code per vector. In each round a task tabulates, per dimension, the squared
differences of every dictionary value to all entries of the codebook; the distances of a part are then gathers and adds of
table rows by the vectors' codes. A table has at most `block` x `entries` cells, whatever the size of the tables or the
range of the values. Only sums and counts per (part, entry, position) leave the tasks; codebooks (`entries` x dimension
integers) are the only thing that comes to the driver and is sent out.

Arithmetic is exact: 64-bit while every partial sum fits, Python integers beyond.

Defined results: vectors that are null, empty or hold a null or non-finite component take no part, neither do those of
another length than the vector of the smallest id. A length that four does not divide is cut as evenly as it goes. A null id
comes after all others; repeated rows count as often as they occur. Integers are bounded to +-2**60 and errors to the
largest long. An empty table gives no row and no codebook. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

_LIMIT, _LONG = 1 << 60, (1 << 63) - 1
_TOTAL = pa.decimal128(38, 0)
BLOCK, _ROWS = 4096, 512


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    return np.clip(np.floor(x.astype(np.float64) * scale), -float(_LIMIT), float(_LIMIT)).astype(np.int64)


def bounds(dim: int, parts: int) -> list[int]:
    return [i * dim // parts for i in range(parts + 1)]


@dataclass
class Block:
    """Dictionaries and codes of some vectors, by dimension."""

    values: list[np.ndarray]
    codes: np.ndarray

    def vectors(self, a: int, b: int) -> np.ndarray:
        return np.stack([self.values[d][self.codes[d]] for d in range(a, b)], axis=1) if b > a else np.zeros((self.codes.shape[1], 0), np.int64)


def encoded(v: np.ndarray) -> Block:
    pairs = [np.unique(v[:, d], return_inverse=True) for d in range(v.shape[1])]
    return Block([values for values, _ in pairs], np.array([codes for _, codes in pairs], np.uint16).reshape(v.shape[1], len(v)))


def squares(values: np.ndarray, entries: np.ndarray, dtype) -> np.ndarray:
    """The table of one dimension: squared difference of every dictionary value to every entry."""
    d = values.astype(dtype)[:, None] - entries.astype(dtype)[None, :]
    return d * d


def nearest(block: Block, codebook: np.ndarray, a: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (the lowest of equals) and its squared distance, for the part whose dimensions start at a."""
    n, dims = block.codes.shape[1], codebook.shape[1]
    most = max([0, *(int(np.abs(block.values[a + j]).max()) for j in range(dims))]) + int(np.abs(codebook).max(initial=0)) if n else 0
    dtype = np.int32 if most * most * max(dims, 1) < 1 << 31 else np.int64 if most * most * max(dims, 1) < 1 << 63 else object
    tables = [squares(block.values[a + j], codebook[:, j], dtype) for j in range(dims)]
    index, least = np.zeros(n, np.int64), np.zeros(n, dtype)
    for at in range(0, n, _ROWS):
        some = slice(at, min(n, at + _ROWS))
        distance = np.zeros((some.stop - at, len(codebook)), dtype)
        for j, table in enumerate(tables):
            distance += table[block.codes[a + j, some]]
        index[some] = distance.argmin(axis=1)
        least[some] = distance[np.arange(some.stop - at), index[some]]
    return index, least


def _blocks(batches, dim: int) -> Iterator[tuple[pa.RecordBatch, int, Block]]:
    """(batch, row, block) of the written blocks."""
    for batch in batches:
        dictionaries, codes = batch.column("dictionaries"), batch.column("codes")
        for row in range(batch.num_rows):
            values = [np.frombuffer(x, np.int64) for x in dictionaries[row].as_py()]
            yield batch, row, Block(values, np.frombuffer(codes[row].as_py(), np.uint16).reshape(dim, -1))


@dataclass
class Compressed:
    """Codebooks by part (entries x dimensions of the part) and the coded vectors: vec_id, label, code, error, label_error."""

    codebooks: list[np.ndarray]
    rows: DataFrame

    def codebooks_sha256(self) -> str:
        return hashlib.sha256(",".join(str(int(x)) for c in self.codebooks for x in c.ravel()).encode()).hexdigest()

    def vector(self, code: str) -> np.ndarray:
        """The integer vector that a code stands for."""
        return np.concatenate([c[int(code[2 * i:2 * i + 2], 16)] for i, c in enumerate(self.codebooks)])


def _improved(blocks: DataFrame, codebooks: list[np.ndarray], cut: list[int]) -> list[np.ndarray]:
    """One round: assign all parts, then every used entry becomes the floor of the mean of its parts."""
    dim = cut[-1]

    def totals(batches):
        sums = [np.zeros(c.shape, object) for c in codebooks]
        counts = [np.zeros(len(c), np.int64) for c in codebooks]
        for _, _, block in _blocks(batches, dim):
            for k, c in enumerate(codebooks):
                index, _ = nearest(block, c, cut[k])
                v = block.vectors(cut[k], cut[k + 1])
                fits = not v.size or int(np.abs(v).max()) * len(v) < 1 << 62
                part = np.zeros(c.shape, np.int64 if fits else object)
                np.add.at(part, index, v if fits else v.astype(object))
                sums[k] = sums[k] + part
                counts[k] += np.bincount(index, minlength=len(c))
        for k, c in enumerate(codebooks):
            used = np.flatnonzero(counts[k])
            width = c.shape[1]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(used) * width, k, np.int32)), pa.array(np.repeat(used, width).astype(np.int32)), pa.array(np.tile(np.arange(width, dtype=np.int32), len(used))),
                pa.array([Decimal(int(x)) for x in sums[k][used].ravel()], _TOTAL), pa.array(np.repeat(counts[k][used], width))], names=["part", "entry", "position", "total", "n"])

    found = blocks.mapInArrow(totals, "part int, entry int, position int, total decimal(38,0), n long")
    out = [c.copy() for c in codebooks]
    for r in found.groupBy("part", "entry", "position").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
        out[r["part"]][r["entry"], r["position"]] = int(r["total"]) // r["n"]
    return out


def compress(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, block: int = BLOCK) -> Compressed:
    """Codebooks of `entries` entries per part after `rounds` rounds, and the code of every vector (vec_id, embedding, label).
    Codes have two hex digits a part, so that `entries` is at most 256."""
    x = F.col("embedding")
    usable = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = vectors.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<double>").alias("v"), F.col("label").alias("label"))
    by_id = [F.asc_nulls_last("vec_id"), F.asc("v")]
    least = kept.orderBy(*by_id).first()
    dim = len(least["v"]) if least else 0
    kept = kept.where(F.size("v") == dim)
    foremost = [r["v"] for r in kept.orderBy(*by_id).limit(entries).collect()]
    start = integers(np.array(foremost, np.float64).reshape(len(foremost), dim), scale)
    cut = bounds(dim, parts)
    codebooks = [start[:, a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def blocked(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, block):
                batch = whole.slice(at, block)
                v = integers(batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim), scale)
                b, ends = encoded(v), pa.array([0, batch.num_rows], pa.int32())
                yield pa.RecordBatch.from_arrays([
                    pa.ListArray.from_arrays(ends, batch.column("vec_id")), pa.ListArray.from_arrays(ends, batch.column("label")),
                    pa.array([[d.tobytes() for d in b.values]], pa.list_(pa.binary())), pa.array([b.codes.tobytes()], pa.binary())], names=["vec_ids", "labels", "dictionaries", "codes"])

    kind = kept.schema["label"].dataType.simpleString()
    blocks = written(kept.mapInArrow(blocked, f"vec_ids array<long>, labels array<{kind}>, dictionaries array<binary>, codes binary"), "vector-blocks")
    for _ in range(rounds if least else 0):
        codebooks = _improved(blocks, codebooks, cut)

    def coded(batches):
        digits = np.array([f"{i:02x}" for i in range(256)], object)
        for batch, row, b in _blocks(batches, dim):
            code, error = np.full(b.codes.shape[1], "", object), np.zeros(b.codes.shape[1], object)
            for k, c in enumerate(codebooks):
                index, distance = nearest(b, c, cut[k])
                code, error = code + digits[index], error + distance.astype(object)
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_ids")[row].values, batch.column("labels")[row].values, pa.array(code, pa.string()), pa.array([min(int(e), _LONG) for e in error], pa.int64())],
                names=["vec_id", "label", "code", "error"])

    rows = written(blocks.mapInArrow(coded, f"vec_id long, label {kind}, code string, error long"), "vector-codes")
    by_label = rows.groupBy(F.col("label").alias("l")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("sum"))
    by_label = by_label.select("l", F.least("sum", F.lit(_LONG).cast("decimal(38,0)")).cast("long").alias("label_error"))
    return Compressed(codebooks, rows.join(by_label, F.col("label").eqNullSafe(F.col("l"))).drop("l"))
