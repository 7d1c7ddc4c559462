"""Data sources that write rows to their places in one file, a NumPy array or plain bytes, each task its own byte ranges.

Rows are (pos, values...): the values of row `pos` of the array, all of one number type. Tasks write to a file beside the
target, in a folder that all of them can write, and report the runs of rows that they wrote. The commit checks that
the runs of the tasks that count cover every row once, adds the header and renames the file; anything else removes it.
A task that is run again writes the same bytes to the same places.
"""

from __future__ import annotations

import io
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage


def header(dtype: str, rows: int, width: int | None) -> bytes:
    out = io.BytesIO()
    shape = (rows,) if width is None else (rows, width)
    np.lib.format.write_array_header_2_0(out, {"descr": np.lib.format.dtype_to_descr(np.dtype(dtype)), "fortran_order": False, "shape": shape})
    return out.getvalue()


def runs_of(pos: np.ndarray, size: np.ndarray | int = 1) -> Iterator[tuple[int, int]]:
    """(first, end) places in pos of stretches in which each number is the one before plus its size."""
    cuts = np.flatnonzero(np.diff(pos) != (size if isinstance(size, int) else size[:-1])) + 1
    yield from zip([0, *cuts.tolist()], [*cuts.tolist(), len(pos)], strict=True)


def joined(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs (start, end) in order, those that touch as one; ones that overlap are an error."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(runs):
        if out and start < out[-1][1]:
            raise ValueError(f"row {start} was written twice")
        if out and start == out[-1][1]:
            out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    return out


@dataclass
class Written(WriterCommitMessage):
    runs: list[tuple[int, int]]


class RangesWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.path, self.beside, self.dtype = options["path"], options["beside"], options["dtype"]
        self.rows, self.width = int(options["rows"]), int(options["width"]) if options.get("width") else None
        self.start = len(header(self.dtype, self.rows, self.width))
        self.row_bytes = np.dtype(self.dtype).itemsize * (self.width or 1)

    def _blocks(self, batch: pa.RecordBatch) -> Iterator[tuple[int, int, memoryview]]:
        """(place, how many, bytes) of the stretches of rows that lie next to each other."""
        pos, *columns = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        values = np.stack(columns, axis=1).astype(self.dtype)
        for first, end in runs_of(pos):
            yield int(pos[first]), end - first, memoryview(np.ascontiguousarray(values[first:end])).cast("B")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        runs: list[tuple[int, int]] = []
        file = os.open(self.beside, os.O_WRONLY | os.O_CREAT, 0o644)
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                for pos, n, block in self._blocks(batch):
                    if pos < 0 or pos + n > self.rows:
                        raise ValueError(f"a row lies outside 0..{self.rows - 1}")
                    at = self.start + pos * self.row_bytes
                    while len(block):
                        done = os.pwrite(file, block, at)
                        block, at = block[done:], at + done
                    runs.append((pos, pos + n))
                if len(runs) > 10_000:
                    runs = joined(runs)
            os.fsync(file)
        finally:
            os.close(file)
        return Written(joined(runs))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        try:
            covered = joined([r for m in messages if m is not None for r in m.runs])
            if covered != ([(0, self.rows)] if self.rows else []):
                raise ValueError(f"{self.path}: of {self.rows} rows these were written: {covered[:5]}")
            file = os.open(self.beside, os.O_WRONLY | os.O_CREAT, 0o644)
            try:
                if self.start:
                    os.pwrite(file, header(self.dtype, self.rows, self.width), 0)
                os.ftruncate(file, self.start + self.rows * self.row_bytes)
                os.fsync(file)
            finally:
                os.close(file)
            os.replace(self.beside, self.path)
        except BaseException:
            self.abort(messages)
            raise

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        if os.path.exists(self.beside):
            os.remove(self.beside)


class BytesWriter(RangesWriter):
    """The same for rows (at long, data binary): bytes of a file without a header."""

    def __init__(self, options: dict[str, str]):
        self.path, self.beside, self.rows = options["path"], options["beside"], int(options["rows"])
        self.start, self.row_bytes, self.dtype, self.width = 0, 1, "", None

    def _blocks(self, batch: pa.RecordBatch) -> Iterator[tuple[int, int, memoryview]]:
        size = np.asarray(pc.binary_length(batch.column(1))).astype(np.int64)
        pos = np.asarray(batch.column(0))
        for first, end in runs_of(pos, size):
            data = b"".join(v.as_py() for v in batch.column(1)[first:end])
            yield int(pos[first]), len(data), memoryview(data)


class ByteRanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "byte_ranges"

    def writer(self, schema, overwrite: bool) -> BytesWriter:
        return BytesWriter(dict(self.options))


class NpyRanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy_ranges"

    def writer(self, schema, overwrite: bool) -> RangesWriter:
        return RangesWriter(dict(self.options))


def _write(df: DataFrame, source: type[DataSource], path: str, **options: object) -> None:
    df.sparkSession.dataSource.register(source)
    beside = os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.{uuid.uuid4().hex}.tmp")
    df.write.format(source.name()).options(path=path, beside=beside, **{k: str(v) for k, v in options.items()}).mode("append").save()


def write_npy(rows: DataFrame, path: str, dtype: str, n: int, width: int | None = None) -> None:
    """Writes rows (pos long, values...) as an array of n rows, of `width` values each or plain numbers, that replaces path."""
    _write(rows, NpyRanges, path, dtype=dtype, rows=n, **({"width": width} if width else {}))


def write_bytes(rows: DataFrame, path: str, n: int) -> int:
    """Writes rows (at long, data binary) as a file of n bytes that replaces path."""
    _write(rows, ByteRanges, path, rows=n)
    return n
