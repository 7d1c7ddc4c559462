"""Large JSON files whose top level is an array, read element by element in bounded memory.

    read_json_array(spark, path)  # columns path, position, value; many tasks a file

    spark.dataSource.register(JsonArraySource)
    spark.read.format("json_array").load(path)  # the same in one pass, a task a file

For files that fit a task's memory, `spark.read.json(path, multiLine=True)` is simpler.
"""

from __future__ import annotations

import io
import json
import os
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from frameflow.operators.sampling import running
from frameflow.sources.byte_files import Range, Window, blocks, listed, opened, ranges
from frameflow.sources.npy_ranges import write_bytes
from frameflow.tables import scratch

_BLANK = re.compile(r"[ \t\n\r]*")


def elements(stream, chunk: int = 1 << 20) -> Iterator[object]:
    """The elements of the array; anything but one array is an error.

    Elements are read in place; the text before them is dropped when more is read. An element that isn't whole yet
    is tried again after twice as much, so that a large one costs in proportion to its size.
    """
    decoder = json.JSONDecoder()
    text, at, size = "", 0, chunk

    def more() -> bool:
        nonlocal text, at, size
        got = stream.read(size)
        text, at, size = text[at:] + got, 0, 2 * size
        return bool(got)

    def skip() -> str:
        """The next character that isn't blank; empty at the end."""
        nonlocal at
        while True:
            at = _BLANK.match(text, at).end()
            if at < len(text):
                return text[at]
            if not more():
                return ""

    if skip() != "[":
        raise ValueError("the top level is no array")
    at += 1
    first = True
    while True:
        c = skip()
        if not c:
            raise ValueError("the array is not closed")
        if c == "]":
            at += 1
            if skip():
                raise ValueError("text after the array")
            return
        if not first:
            if c != ",":
                raise ValueError("elements are not set apart by a comma")
            at += 1
            skip()
        while True:
            try:
                value, end = decoder.raw_decode(text, at)
                if isinstance(value, (dict, list, str)) or text[end : end + 1] in tuple(",] \t\r\n") or not more():  # a number may go on
                    break
            except ValueError:
                if not more():
                    raise
        yield value
        at, first, size = end, False, chunk


class JsonFile(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class JsonArrayReader(DataSourceReader):
    def __init__(self, pattern: str):
        self.pattern = pattern

    def partitions(self) -> list[JsonFile]:
        return [JsonFile(path) for path, _ in listed(self.pattern)]

    def read(self, partition: JsonFile) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[str, int, str]] = []
        with opened(partition.path) as f:
            for k, value in enumerate(elements(io.TextIOWrapper(f, "utf-8"))):
                rows.append((partition.path, k, json.dumps(value, ensure_ascii=False)))
                if len(rows) == 4096:
                    yield self._batch(rows)
                    rows = []
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple[str, int, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.string()))], ["path", "position", "value"])


class JsonArraySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "json_array"

    def schema(self) -> str:
        return "path string, position long, value string"

    def reader(self, schema: StructType) -> JsonArrayReader:
        return JsonArrayReader(self.options["path"])


class Scan:
    """Follows JSON text through blocks of bytes: what is inside a string, and how deep brackets are nested."""

    def __init__(self, inside: bool = False, depth: int = 0, backslashes: int = 0):
        self.inside, self.depth, self.backslashes = inside, depth, backslashes

    def block(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Offsets of brackets and commas outside strings, those bytes, and the depth that each one stands at: that
        inside a bracket for the bracket itself, whether it opens or closes."""
        b = np.frombuffer(data, np.uint8)
        slash = b == 0x5C
        places = np.arange(len(b))
        plain = np.maximum.accumulate(np.where(slash, -1, places)) if len(b) else places
        before = np.r_[-1, plain[:-1]][: len(b)]
        run = np.where(before < 0, places + self.backslashes, places - 1 - before)
        quote = (b == 0x22) & (run % 2 == 0)
        inside = (np.cumsum(quote) + self.inside) % 2 == 1
        at = np.flatnonzero(((b == 0x5B) | (b == 0x7B) | (b == 0x5D) | (b == 0x7D) | (b == 0x2C)) & ~inside)
        kind = b[at]
        step = np.where((kind == 0x5B) | (kind == 0x7B), 1, np.where(kind == 0x2C, 0, -1))
        depth = self.depth + np.cumsum(step)
        if len(b):
            self.backslashes = 0 if not slash[-1] else len(b) - 1 - int(plain[-1]) if plain[-1] >= 0 else len(b) + self.backslashes
            self.inside = bool(inside[-1])
        self.depth = int(depth[-1]) if len(depth) else self.depth
        return at, kind, np.where(step < 0, depth + 1, depth)


def _backslashes_before(path: str, start: int) -> int:
    n = 0
    with Window(path, 64) as window:
        while n < start and window.at(start - n - 1, 1) == b"\\":
            n += 1
    return n


def _summary(path: str, start: int, end: int) -> list[tuple[bool, int, dict[int, int], bool]]:
    """If the range begins outside a string, and if it begins inside one: whether it ends inside one, by how much it
    changes the depth, and how many commas it has at which depth, as seen from its start. Last: is it all blank?"""
    out = []
    for inside in (False, True):
        scan, commas, blank = Scan(inside, 0, _backslashes_before(path, start)), Counter(), True
        for data in blocks(path, start, end):
            _, kind, depth = scan.block(data)
            commas.update(depth[kind == 0x2C].tolist())
            blank = blank and not data.strip(b" \t\r\n")
        out.append((scan.inside, scan.depth, dict(commas), blank))
    return out


def _range_elements(r: dict) -> Iterator[tuple[int, str]]:
    """(position, text) of the elements of the array that begin in a range whose state at its start is known."""
    path, start, end, size = r["path"], r["start"], r["end"], r["size"]
    scan, place, held, at = Scan(r["inside"], r["depth"], _backslashes_before(path, start)), r["commas"], None, start
    for data in blocks(path, start, size):
        offsets, kind, depth = scan.block(data)
        if at == start and r["first"] and not data.lstrip(b" \t\r\n").startswith(b"["):
            raise ValueError(f"{path}: the top level is no array")
        cuts = np.flatnonzero(depth == 1)
        cuts = cuts[(kind[cuts] == 0x2C) | (kind[cuts] == 0x5D) | (kind[cuts] == 0x5B)]
        used = 0
        for c, k in zip(offsets[cuts].tolist(), kind[cuts].tolist(), strict=True):
            if held is not None and k != 0x5B:
                text = held + data[used:c]
                if text.strip(b" \t\r\n") or k == 0x2C or place > 0:
                    yield place, text
                held = None
            place += k == 0x2C
            if k != 0x5D:
                if at + c >= end:
                    return
                held, used = b"", c + 1
            elif data[c + 1 :].strip(b" \t\r\n"):
                raise ValueError(f"{path}: text after the array")
        at += len(data)
        if held is not None:
            held += data[used:]
        elif at >= end:
            return
    if held is not None:
        raise ValueError(f"{path}: the array is not closed")


def _begun(parts: list[Range], found: dict[int, list]) -> Iterator[tuple]:
    """The ranges in which elements may begin, with the state at their start: inside a string or not, depth, commas of
    the array so far; and if the array itself begins there."""
    for k, p in enumerate(parts):
        if p.start == 0:
            inside, depth, commas, open_yet = False, 0, 0, False
        next_inside, change, counts, blank = found[k][inside]
        if open_yet and not depth and not blank:
            raise ValueError(f"{p.path}: text after the array")
        if depth or not open_yet and not blank:
            yield p.path, p.start, p.end, p.size, inside, depth, commas, not open_yet
        open_yet = open_yet or not blank
        commas += counts.get(1 - depth, 0)
        inside, depth = next_inside, depth + change
        if p.end == p.size and (inside or depth or not open_yet):
            raise ValueError(f"{p.path}: the array is not closed" if open_yet else f"{p.path} is empty")


def read_json_array(spark: SparkSession, pattern: str, split_bytes: int = 64 << 20) -> DataFrame:
    """(path, position, value): the elements of arrays at the top level of files, as JSON text, in ranges of split_bytes.

    Two passes. The first tells for each range what it does to strings and depth, for both states that it may begin in;
    put together in order, that is the state at each range's start. The second one reads the elements that begin in a
    range, each task its own. Anything but one array is an error. A row for each range goes through the driver.
    """
    parts = ranges(pattern, split_bytes)
    described = spark.createDataFrame([(k, p.path, p.start, p.end, p.size) for k, p in enumerate(parts)], "k long, path string, start long, end long, size long").repartition(len(parts), "k")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"k": r["k"], "states": [{"inside": i, "depth": d, "commas": list(c.items()), "blank": b} for i, d, c, b in _summary(r["path"], r["start"], r["end"])]} for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(rows, _SUMMARY)

    found = {r.k: r.states for r in described.mapInArrow(look, "k long, states array<struct<inside: boolean, depth: long, commas: map<long, long>, blank: boolean>>").collect()}
    known = spark.createDataFrame(list(_begun(parts, found)), "path string, start long, end long, size long, inside boolean, depth long, commas long, first boolean")
    known = known.repartition(max(1, len(parts)), "path", "start")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                rows: list[tuple[str, int, str]] = []
                for place, text in _range_elements(r):
                    rows.append((r["path"], place, json.dumps(json.loads(text), ensure_ascii=False)))
                    if len(rows) == 4096:
                        yield JsonArrayReader._batch(rows)
                        rows = []
                if rows:
                    yield JsonArrayReader._batch(rows)

    return known.mapInArrow(read, "path string, position long, value string")


_SUMMARY = pa.schema([("k", pa.int64()), ("states", pa.list_(pa.struct([("inside", pa.bool_()), ("depth", pa.int64()), ("commas", pa.map_(pa.int64(), pa.int64())), ("blank", pa.bool_())])))])


def write_json_array(rows: DataFrame, path: str, value: str, *order: str, overwrite: bool = False) -> int:
    """Writes JSON texts in an order as one array to a file that replaces path at the end; tells how many bytes it has.

    Tasks write disjoint byte ranges of it, at places found by running totals of the lengths, in a folder that all of
    them can write.
    """
    if os.path.exists(path) and not overwrite:
        raise FileExistsError(path)
    texts = rows.select(*order, F.concat(F.lit(","), F.col(value)).alias("__v"))
    with scratch(rows.sparkSession):
        placed = running(texts, F.octet_length("__v").cast("long"), *order, to="__at")
        total = placed.agg(F.max(F.col("__at") + F.octet_length("__v"))).first()[0] or 1
        first = placed.select(F.col("__at").alias("at"), F.when(F.col("__at") == 0, F.concat(F.lit("["), F.substr("__v", F.lit(2)))).otherwise(F.col("__v")).cast("binary").alias("data"))
        tail = rows.sparkSession.createDataFrame([(total, b"]\n") if first.limit(1).count() else (0, b"[]\n")], "at long, data binary")
        return write_bytes(first.unionByName(tail), path, total + 2)


def rewrite(spark: SparkSession, source: str, target: str, change: Callable[[Column], Column], overwrite: bool = False, split_bytes: int = 64 << 20) -> int:
    """Writes the elements of a file, each as `change` makes its JSON text, as one array to a file that replaces target at
    the end; source and target may be the same."""
    rows = read_json_array(spark, source, split_bytes)
    return write_json_array(rows.select("position", change(F.col("value")).alias("value")), target, "value", "position", overwrite=overwrite)
