"""Fill-in-middle transformation by secondary-sort assembly.

Every text becomes pieces of at most `chunk` code points, cut at the borders of its prefix, middle and suffix and keyed by
row and output position. One exchange deals rows to partitions, which are sorted by row and position
(repartitionAndSortWithinPartitions in its DataFrame form: `repartition` and `sortWithinPartitions`); a task then streams
the pieces of a row in output order into an incremental digest. For restoration the output stream alone is read back: its
marks are found, also where they cross pieces, every stretch between them gets its place in the source, and the partition is
sorted again by that place (no second exchange). No task holds a whole text after it has been cut.

Defined results: null counts as the empty text, which is plain; a null id hashes as the empty string; repeated rows give
as many rows. Rows are numbered by their place in the stored table: an input that a shuffle feeds is to be written first,
so that a repeated task numbers them alike. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CHUNK = 1 << 16
_MARK = re.compile(b"<[PSM]>")
_SOURCE_ORDER = {b"<P>": 0, b"<M>": 1, b"<S>": 2}
_ABOUT = ["row", "doc_id", "n", "form", "prefix_chars", "middle_chars"]
_ABOUT_TYPES = "row long, doc_id long, n long, form string, prefix_chars long, middle_chars long"
_ARROW = {"row": pa.int64(), "position": pa.int64(), "doc_id": pa.int64(), "n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(),
          "middle_chars": pa.int64(), "piece": pa.binary(), "output_sha256": pa.string(), "restored_sha256": pa.string()}
_BATCH_ROWS, _BATCH_BYTES = 8192, 4 << 20


def layout(doc_id: int | None, text: str, key: int, plain_from: int, spm_below: int) -> tuple[str, int | None, int | None]:
    """Form, code points of the prefix and code points of the middle."""
    digest = hashlib.sha256(f"{key}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i:8 * i + 8], 16) for i in range(4))
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= plain_from:
        return "plain", None, None
    first, second = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
    return ("spm" if h4 % 100 < spm_below else "psm"), first, second - first


def stretches(text: str, form: str, first: int | None, middle: int | None, chunk: int) -> Iterator[str]:
    """The pieces of the output in order; a mark goes with the first piece of its part."""
    if form == "plain":
        parts = [("", 0, len(text))]
    else:
        second = first + middle
        prefix, suffix = (PREFIX, 0, first), (SUFFIX, second, len(text))
        parts = [*((suffix, prefix) if form == "spm" else (prefix, suffix)), (MIDDLE, first, second)]
    for mark, a, b in parts:
        yield mark + text[a:min(b, a + chunk)]
        for at in range(a + chunk, b, chunk):
            yield text[at:min(b, at + chunk)]


class _Out:
    """Rows gathered into Arrow batches of bounded size."""

    def __init__(self, names: list[str]):
        self.names, self.rows, self.size = names, [], 0

    def add(self, row: tuple, size: int = 0) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.size += size
        if len(self.rows) >= _BATCH_ROWS or self.size >= _BATCH_BYTES:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = [pa.array(c, _ARROW[name]) for name, c in zip(self.names, zip(*self.rows, strict=True), strict=True)]
            self.rows, self.size = [], 0
            yield pa.RecordBatch.from_arrays(columns, names=self.names)


def pieces(docs: DataFrame, key: int = 1, plain_from: int = 90, spm_below: int = 20, chunk: int = CHUNK) -> DataFrame:
    """The transformed corpus: row, position, doc_id, n, form, prefix_chars, middle_chars and piece (UTF-8 bytes), where the
    pieces of a row in order of their position are its output. Partitioned by row and sorted by row and position."""
    names = ["row", "position", *_ABOUT[1:], "piece"]

    def emitted(batches):
        out = _Out(names)
        for batch in batches:
            for row, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "text")), strict=True):
                form, first, middle = layout(doc_id, text, key, plain_from, spm_below)
                for position, s in enumerate(stretches(text, form, first, middle, chunk)):
                    data = s.encode()
                    yield from out.add((row, position, doc_id, len(text), form, first, middle, data), len(data))
        yield from out.rest()

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = small_batches(numbered).mapInArrow(emitted, f"{_ABOUT_TYPES.replace('row long,', 'row long, position long,')}, piece binary")
    return found.repartition("row").sortWithinPartitions("row", "position")


class _Reader:
    """Splits the output of one row at its marks; gives (place in the source, bytes) as the pieces come."""

    def __init__(self, form: str):
        self.plain, self.kept, self.part, self.at = form == "plain", b"", 0, 0

    def _put(self, data: bytes) -> Iterator[tuple[int, bytes]]:
        if data:
            yield self.part << 48 | self.at, data
            self.at += len(data)

    def feed(self, data: bytes) -> Iterator[tuple[int, bytes]]:
        if self.plain:
            yield from self._put(data)
            return
        data, last = self.kept + data, 0
        for m in _MARK.finditer(data):
            yield from self._put(data[last:m.start()])
            self.part, self.at, last = _SOURCE_ORDER[m.group()], 0, m.end()
        held = max(last, len(data) - 2)
        yield from self._put(data[last:held])
        self.kept = data[held:]

    def close(self) -> Iterator[tuple[int, bytes]]:
        yield from self._put(self.kept)


def digested(assembled: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256 and restored_sha256 of every row of `pieces`."""
    names = ["row", "position", *_ABOUT[1:], "piece", "output_sha256"]
    last_place = (1 << 63) - 1

    def outputs(batches):
        out, about, reader, sha = _Out(names), None, None, None

        def stretch(found):
            for place, data in found:
                yield from out.add((about[0], place, *about[1:], data, None), len(data))

        def closed():
            if about is not None:
                yield from stretch(reader.close())
                yield from out.add((about[0], last_place, *about[1:], None, sha.hexdigest()))

        for batch in batches:
            for *now, data in zip(*(batch.column(c).to_pylist() for c in (*_ABOUT, "piece")), strict=True):
                if about is None or now[0] != about[0]:
                    yield from closed()
                    about, reader, sha = now, _Reader(now[3]), hashlib.sha256()
                sha.update(data)
                yield from stretch(reader.feed(data))
        yield from closed()
        yield from out.rest()

    def restored(batches):
        out, sha = _Out([*_ABOUT, "output_sha256", "restored_sha256"]), hashlib.sha256()
        for batch in batches:
            for *now, data, output in zip(*(batch.column(c).to_pylist() for c in (*_ABOUT, "piece", "output_sha256")), strict=True):
                if output is None:
                    sha.update(data)
                else:
                    yield from out.add((*now, output, sha.hexdigest()))
                    sha = hashlib.sha256()
        yield from out.rest()

    stream = assembled.mapInArrow(outputs, f"{_ABOUT_TYPES.replace('row long,', 'row long, position long,')}, piece binary, output_sha256 string")
    return stream.sortWithinPartitions("row", "position").mapInArrow(restored, f"{_ABOUT_TYPES}, output_sha256 string, restored_sha256 string").drop("row")
