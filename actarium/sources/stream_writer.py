"""Files put together from many rows: sorted partitions are streamed into them, so that no row and no task holds a file's
content. A file is written under a name that readers skip and renamed when it is whole; a repeated task writes it again."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BUFFER = 1 << 20


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class _File:
    def __init__(self, folder: str, name: str):
        system, folder = _file_system(folder)
        self.system, self.at, self.temporary, self.held, self.size = system, f"{folder}/{name}", f"{folder}/_{name}.{uuid.uuid4().hex}", [], 0
        self.out = system.open_output_stream(self.temporary)

    def put(self, data: bytes) -> None:
        self.held.append(data)
        self.size += len(data)
        if self.size >= _BUFFER:
            self.flush()

    def flush(self) -> None:
        self.out.write(b"".join(self.held))
        self.held, self.size = [], 0

    def close(self) -> None:
        self.flush()
        self.out.close()
        self.system.move(self.temporary, self.at)


def write_files(pieces: DataFrame, path: str, name: str | None, order: list[str], extension: str) -> int:
    """Number of files written: the pieces (text) of every value of column ``name`` in one file of that name, in order of the
    columns of ``order``; without a name, those of every partition in one file. What column ``between`` holds goes before a
    piece that follows another one with the same values but for the last of ``order``. The folder is emptied first."""
    spark = pieces.sparkSession
    spark.createDataFrame([], "value string").write.mode("overwrite").text(path)
    file = F.lit(None).cast("string") if name is None else F.col(name).cast("string")
    group = F.to_json(F.struct(F.lit(0).alias("at"), *order[:-1]))
    rows = pieces.select(file.alias("file"), group.alias("group"), *order, *[F.encode(F.coalesce(c, F.lit("")), "utf-8").alias(c) for c in ("between", "piece")])
    rows = (rows.repartition(order[0]) if name is None else rows.repartition("file")).sortWithinPartitions("file", *order, "piece").select("file", "group", "between", "piece")

    def put(batches):
        file, now, before, n = None, None, None, 0
        for batch in batches:
            for key, at, between, piece in zip(*(batch.column(c).to_pylist() for c in ("file", "group", "between", "piece")), strict=True):
                if file is None or key != now:
                    if file is not None:
                        file.close()
                    file, now, before, n = _File(path, f"{key if name else f'part-{TaskContext.get().partitionId():06d}'}{extension}"), key, None, n + 1
                if at == before:
                    file.put(between)
                file.put(piece)
                before = at
        if file is not None:
            file.close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return rows.mapInArrow(put, "n long").agg(F.sum("n")).first()[0] or 0
