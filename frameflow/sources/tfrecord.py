"""TFRecord files of tf.train.Example messages as a Spark data source, without TensorFlow.

    spark.dataSource.register(TFRecordSource)
    spark.read.format("tfrecord_examples").schema("...").load("/data/shard-*.tfrecord")

Framing: little-endian u64 length, u32 CRC of the length, payload, u32 CRC of the payload. An Example maps names to
lists of bytes, floats or 64-bit integers. Columns of the schema are looked up by name: arrays take the whole list,
scalars its first value; what is absent is null. A cut-off record is an error. Payload CRCs are not checked.

A file is read in ranges of `splitBytes` (64 MB), each by its own task, with one record in memory. A range has the
records that begin in it. The first one is found by its length's CRC, confirmed by that of the record behind it, and
each task makes sure that its last record ends where the next range will look for its first, so a file whose frames
are broken is an error and loses nothing. Files that carry no CRC of lengths can't be searched and are one range.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructType

from frameflow.sources.byte_files import Range, Window, listed, ranges

_HEAD, _FOOT = 12, 4


@cache
def _crc_table() -> np.ndarray:
    """Remainders of the Castagnoli polynomial (reflected 0x82F63B78) for all bytes."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0x82F63B78), out >> 1).astype(np.uint32)
    return out


def _masked(crc: np.ndarray) -> np.ndarray:
    """The form in which the format stores a CRC."""
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(0xA282EAD8)


def masked_crc(data: bytes) -> int:
    table, crc = _crc_table(), 0xFFFFFFFF
    for b in data:
        crc = int(table[(crc ^ b) & 0xFF]) ^ (crc >> 8)
    return int(_masked(np.array([crc ^ 0xFFFFFFFF], np.uint32))[0])


def heads(data: bytes) -> np.ndarray:
    """Offsets at which twelve bytes are a length and its CRC."""
    b = np.frombuffer(data, np.uint8)
    n = len(b) - _HEAD + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    table, crc = _crc_table(), np.full(n, 0xFFFFFFFF, np.uint32)
    for k in range(8):
        crc = table[(crc ^ b[k : k + n]) & 0xFF] ^ (crc >> np.uint32(8))
    stored = sum(b[8 + k : 8 + k + n].astype(np.uint32) << np.uint32(8 * k) for k in range(4))
    return np.flatnonzero(_masked(~crc) == stored)


def _head(window: Window, at: int, size: int) -> int | None:
    """The end of the record at `at` if a length and its CRC are there and it fits in the file."""
    head = window.at(at, _HEAD)
    if len(head) < _HEAD or not len(heads(head)):
        return None
    end = at + _HEAD + struct.unpack("<Q", head[:8])[0] + _FOOT
    return end if end <= size else None


def first_record(window: Window, start: int, size: int, block: int = 1 << 18) -> int:
    """Where the first record at or after start begins; the file's end if there is none."""
    if start == 0:
        return 0
    at = start
    while at < size:
        data = window.at(at, block + _HEAD)
        for offset in heads(data).tolist():
            end = _head(window, at + offset, size)
            if end is not None and (end == size or _head(window, end, size) is not None):
                return at + offset
        at += max(1, len(data) - _HEAD + 1)
    return size


def records_in(part: Range) -> Iterator[bytes]:
    """Payloads of the records that begin in a range of a file."""
    with Window(part.path) as window, Window(part.path) as ahead:
        at = first_record(window, part.start, part.size)
        while at < part.end:
            head = window.at(at, _HEAD)
            if len(head) < _HEAD:
                raise ValueError(f"{part.path}: cut off in a record's header")
            (n,) = struct.unpack("<Q", head[:8])
            if at + _HEAD + n + _FOOT > part.size:
                raise ValueError(f"{part.path}: cut off in a record of {n} bytes")
            yield window.at(at + _HEAD, n)
            at += _HEAD + n + _FOOT
        if part.end < part.size and first_record(ahead, part.end, part.size) != max(at, part.end):
            raise ValueError(f"{part.path}: the records that begin before byte {part.end} don't end where others begin")


def record_at(path: str, number: int) -> bytes:
    """The payload of one record of a file, by its number from 0; of those before it only the lengths are read."""
    [(path, size)] = listed(path)
    with Window(path, 64) as window:
        at = 0
        while at < size:
            head = window.at(at, _HEAD)
            end = at + _HEAD + struct.unpack("<Q", head.ljust(8, b"\0")[:8])[0] + _FOOT
            if len(head) < _HEAD or end > size:
                raise ValueError(f"{path}: cut off in record {number}")
            if not number:
                return window.at(at + _HEAD, end - at - _HEAD - _FOOT)
            at, number = end, number - 1
    raise IndexError(f"{path} has no such record")


def splits(pattern: str, split_bytes: int) -> list[Range]:
    """Ranges of the files; files whose first length carries no CRC are one range."""
    out: list[Range] = []
    for part in ranges(pattern, split_bytes, "*.tfrecord*"):
        if part.start == 0 and part.end < part.size:
            with Window(part.path, 64) as window:
                whole = not len(heads(window.at(0, _HEAD)))
        elif part.start == 0:
            whole = False
        if not whole:
            out.append(part)
        elif part.start == 0:
            out.append(Range(part.path, 0, part.size, part.size))
    return out


def records(stream, name: str = "stream") -> Iterator[bytes]:
    """Payloads of a TFRecord stream."""
    while head := stream.read(12):
        if len(head) < 12:
            raise ValueError(f"{name}: cut off in a record's header")
        (size,) = struct.unpack("<Q", head[:8])
        body = stream.read(size + 4)
        if len(body) < size + 4:
            raise ValueError(f"{name}: cut off in a record of {size} bytes")
        yield body[:size]


def _varint(b: memoryview, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        x = b[at]
        at += 1
        out |= (x & 0x7F) << shift
        if x < 0x80:
            return out, at
        shift += 7


def _fields(b: memoryview) -> Iterator[tuple[int, int, object]]:
    """(number, wire type, value) of a protobuf message."""
    at = 0
    while at < len(b):
        tag, at = _varint(b, at)
        number, wire = tag >> 3, tag & 7
        if wire == 0:
            value, at = _varint(b, at)
        elif wire == 1:
            value, at = b[at : at + 8], at + 8
        elif wire == 2:
            size, at = _varint(b, at)
            value, at = b[at : at + size], at + size
        elif wire == 5:
            value, at = b[at : at + 4], at + 4
        else:
            raise ValueError(f"wire type {wire}")
        yield number, wire, value


def _values(feature: memoryview) -> list:
    """The list in a Feature: bytes (1), floats (2) or integers (3)."""
    for kind, _, inner in _fields(feature):
        out: list = []
        for number, wire, value in _fields(inner):
            if number != 1:
                continue
            if kind == 1:
                out.append(bytes(value))
            elif kind == 2:
                out += struct.unpack(f"<{len(value) // 4}f", value)
            elif wire == 0:
                out.append(value - (1 << 64) if value >> 63 else value)
            else:
                at = 0
                while at < len(value):
                    x, at = _varint(value, at)
                    out.append(x - (1 << 64) if x >> 63 else x)
        return out
    return []


def example(payload: bytes) -> dict[str, list]:
    """Names and lists of an Example."""
    out: dict[str, list] = {}
    for number, _, features in _fields(memoryview(payload)):
        if number != 1:
            continue
        for entry_number, _, entry in _fields(features):
            if entry_number != 1:
                continue
            key, feature = "", memoryview(b"")
            for k, _, v in _fields(entry):
                if k == 1:
                    key = bytes(v).decode()
                elif k == 2:
                    feature = v
            out[key] = _values(feature)
    return out


def _size(n: int) -> bytes:
    out = b""
    while n > 0x7F:
        out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
    return out + bytes([n])


def _message(number: int, body: bytes) -> bytes:
    return _size(number << 3 | 2) + _size(len(body)) + body


def write_records(path: str, examples: Iterator[dict[str, list]]) -> None:
    """Writes a TFRecord file, for fixtures and tests."""
    with open(path, "wb") as f:
        for row in examples:
            entries = b""
            for name, values in row.items():
                if values and isinstance(values[0], bytes):
                    feature = _message(1, b"".join(_message(1, v) for v in values))
                elif values and isinstance(values[0], float):
                    feature = _message(2, _message(1, struct.pack(f"<{len(values)}f", *values)))
                else:
                    feature = _message(3, _message(1, b"".join(_size(v & (1 << 64) - 1) for v in values)))
                entries += _message(1, _message(1, name.encode()) + _message(2, feature))
            body = _message(1, entries)
            size = struct.pack("<Q", len(body))
            f.write(size + struct.pack("<I", masked_crc(size)) + body + struct.pack("<I", masked_crc(body)))


class Split(InputPartition):
    def __init__(self, part: Range):
        super().__init__(part)
        self.part = part


class TFRecordReader(DataSourceReader):
    def __init__(self, schema: StructType, pattern: str, split_bytes: int):
        self.schema, self.pattern, self.split_bytes = schema, pattern, split_bytes

    def partitions(self) -> list[Split]:
        return [Split(part) for part in splits(self.pattern, self.split_bytes)]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(self.schema)

        def value(values: list | None, kind):
            if isinstance(kind, ArrayType):
                return None if values is None else [text(v, kind.elementType) for v in values]
            return text(values[0], kind) if values else None

        def text(v, kind):
            return v.decode("utf-8", "replace") if isinstance(v, bytes) and isinstance(kind, StringType) and not isinstance(kind, BinaryType) else v

        rows: list[dict] = []
        for payload in records_in(partition.part):
            e = example(payload)
            rows.append({c.name: value(e.get(c.name), c.dataType) for c in self.schema})
            if len(rows) == 1024:
                yield pa.RecordBatch.from_pylist(rows, arrow)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, arrow)


class TFRecordSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tfrecord_examples"

    def schema(self) -> str:
        raise ValueError("give a schema: the names of an Example's features and their types")

    def reader(self, schema: StructType) -> TFRecordReader:
        return TFRecordReader(schema, self.options["path"], int(self.options.get("splitBytes", 64 << 20)))
