"""Training-order materialisation: all documents as one stream of fixed-length sequences, written in a keyed random order.

The byte ids of the documents, each followed by an end mark, form one stream in the order in which the table is stored; it
is cut into sequences of `length` ids. Sequence i gets the global slot P(i), where P is a keyed permutation of 0 .. n - 1: a
Feistel network over the next even number of bits, applied again while the result is not below n (cycle-walking). Slots are
dealt by range to shards, one task and file each, in which the sequence of slot s lies at (s % per_shard) * length. A reader
therefore needs nothing but a slot number to go on from.

Ids are bytes (0 to 247 occur in UTF-8); END and PAD are byte values that UTF-8 never uses. Offsets need two narrow passes:
sizes are summed per input partition, and only one number per partition comes to the driver.

A shard is written under a name of its own and then renamed, so that a lost or doubled task changes nothing. Defined
results: null counts as the empty text, of which the end mark remains; repeated rows are written as often as they occur; an
empty table gives no shard; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .seqhash import chunks, mix
from .shared import small_batches

END, PAD = 0xFF, 0xFE
_ROUNDS = 4


def permuted(i: np.ndarray, n: int, key: int) -> np.ndarray:
    """P(i) of the keyed permutation of 0 .. n - 1."""
    half = max(1, -(-max(1, (n - 1).bit_length()) // 2))
    mask, x = np.uint64((1 << half) - 1), i.astype(np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        left, right = x[todo] >> np.uint64(half), x[todo] & mask
        for r in range(_ROUNDS):
            left, right = right, left ^ (mix(right, key * _ROUNDS + r + 1) & mask)
        x[todo] = (left << np.uint64(half)) | right
        todo = todo[x[todo] >= n]
    return x.astype(np.int64)


def _file_system(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def shard_name(folder: str, shard: int) -> str:
    return f"{folder.rstrip('/')}/shard-{shard:06d}.bin"


def read_slots(folder: str, first: int, count: int, length: int, per_shard: int) -> Iterator[bytes]:
    """The sequences of slots first, first + 1, ...: sequential reads that can start anywhere."""
    slot, end = first, first + count
    while slot < end:
        system, path = _file_system(shard_name(folder, slot // per_shard))
        here = min(end, (slot // per_shard + 1) * per_shard)
        with system.open_input_file(path) as f:
            f.seek(slot % per_shard * length)
            for _ in range(slot, here):
                yield f.read(length)
        slot = here


def materialise(docs: DataFrame, folder: str, length: int = 2048, per_shard: int = 8192, key: int = 1) -> DataFrame:
    """Writes the shards when it is computed; slot, shard, sequence, first_doc_id (whose bytes or end mark come first),
    n_ids (without padding) and sha256 of every sequence."""
    narrow = docs.select(F.spark_partition_id().alias("part"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("n"))
    sizes = dict(narrow.groupBy("part").agg(F.sum("n")).collect())
    bases, total = {}, 0
    for part in sorted(sizes):
        bases[part], total = total, total + sizes[part]
    n = -(-total // length)
    shards = max(1, -(-n // per_shard))

    def pieces(batches):
        at = bases.get(TaskContext.get().partitionId(), 0)
        for batch in batches:
            ids = batch.column("doc_id")
            for first, _, buf, starts in chunks(batch.column("text")):
                buf[starts[1:] - 1] = END
                cuts = np.concatenate([[0], np.arange((-at) % length or length, len(buf), length), [len(buf)]])
                sequence = (at + cuts[:-1]) // length
                slot = permuted(sequence, n, key)
                row = np.searchsorted(starts, cuts[:-1], side="right") - 1
                yield pa.RecordBatch.from_arrays([
                    pa.array((slot // per_shard).astype(np.int32)), pa.array(slot), pa.array(((at + cuts[:-1]) % length).astype(np.int32)), pa.array(sequence),
                    ids.take(pa.array(first + row)), pa.array([buf[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())],
                    names=["shard", "slot", "offset", "sequence", "doc_id", "ids"])
                at += len(buf)

    def write(batches):
        state: dict = {"shard": None}
        names = ["slot", "shard", "sequence", "first_doc_id", "n_ids", "sha256"]

        def close():
            if state["shard"] is not None:
                state["file"].close()
                state["system"].move(state["temporary"], state["path"])

        def record(parts):
            shard, slot, _, sequence, doc_id, _ = parts[0]
            if shard != state["shard"]:
                close()
                system, path = _file_system(shard_name(folder, shard))
                system.create_dir(path.rpartition("/")[0], recursive=True)
                temporary = f"{path}.{uuid.uuid4().hex}"
                state.update(shard=shard, system=system, path=path, temporary=temporary, file=system.open_output_stream(temporary))
            data = b"".join(p[5] for p in parts)
            padded = data.ljust(length, bytes([PAD]))
            state["file"].write(padded)
            return slot, shard, sequence, doc_id, len(data), hashlib.sha256(padded).hexdigest()

        parts, out = [], []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("shard", "slot", "offset", "sequence", "doc_id", "ids")), strict=True):
                if parts and row[1] != parts[0][1]:
                    out.append(record(parts))
                    parts = []
                parts.append(row)
            if out:
                yield _rows(out, names)
                out = []
        if parts:
            yield _rows([record(parts)], names)
        close()

    cut = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pieces, "shard int, slot long, offset int, sequence long, doc_id long, ids binary")
    cut = cut.repartitionById(shards, F.col("shard")).sortWithinPartitions("slot", "offset")
    return cut.mapInArrow(write, "slot long, shard int, sequence long, first_doc_id long, n_ids int, sha256 string")


def _rows(out: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
