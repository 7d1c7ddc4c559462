"""SimHash near copies: exact comparison of 64-bit fingerprints in tiles, and the components of their links.

Equal fingerprints are one. Two that differ in at most r bits agree in at least one of r + 1 parts of their bits, so
each is dealt out once for each part, to the cell of those that agree with it there. A cell is sorted by population
count and cut into tiles; tile pairs whose population counts differ by more than r are skipped, as bits apart are at
least counts apart, and the others are compared with exclusive-or and bit counts in numpy. Nothing is left out.

Cells of more members than a task should hold are never gathered: their members are dealt out again by parts of the
bits in which they may still differ. A cell with b such bits has at most 2^b members, so this ends after a few rounds.
Of a cell's links only as many are passed on as connect the same fingerprints.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameflow.llm.common import SPACE, discard, mapped, stored
from frameflow.llm.components import _united, components

_ALL = (1 << 64) - 1
_TILE = 256
_PAIRS = 1 << 20  # links that a task holds before it unites them
_BLANK = re.compile(f"[{SPACE}]".encode())
_SEED = 42


def _word_lists(data: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of data, from about `size` bytes at a time. bytes.split() knows just the six separators of SPACE."""
    at = 0
    while at < len(data):
        end = _BLANK.search(data, at + size) if len(data) - at > size else None
        stop = end.start() if end else len(data)
        if got := data[at:stop].split():
            yield got
        at = stop


def fingerprint(text: str | None, k: int = 3) -> int:
    """Bits set in over half of the XXH64 values (seed 42) of the k-word shingles; zero without words."""
    counts, n = np.zeros(64, np.int64), 0
    before: list[bytes] = []

    def add(shingles: Iterator[bytes] | list[bytes]) -> None:
        nonlocal n
        h = np.array([xxhash.xxh64_intdigest(s, _SEED) for s in shingles], "<u8")
        for i in range(0, len(h), 1 << 14):
            counts[:] += np.unpackbits(h[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)

    for more in _word_lists((text or "").encode("utf-8", "surrogatepass").lower()):
        words = before + more
        if len(words) >= k:
            line = b" ".join(words)
            begin = [0, *accumulate(len(w) + 1 for w in words)]
            add([line[i : j - 1] for i, j in zip(begin, begin[k:], strict=False)])
        before = words[-(k - 1) :] if k > 1 else []
    if not n and before:
        add([b" ".join(before)])
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0]) if n else 0


def fingerprints(docs: DataFrame, k: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fp long) of every row: the fingerprint of its whole text as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), k) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], [id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string")).transform(mapped, run, f"`{id_col}` {kind}, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def parts_left(free: int, parts: int) -> list[int]:
    """The bits left free if one of `parts` interleaved parts of those in `free` is held equal, for each part."""
    bits = [b for b in range(64) if free >> b & 1]
    return [free & ~sum(1 << b for b in bits[i::parts]) for i in range(parts)]


def _cells(members: DataFrame, masks: list[int], parts: int) -> DataFrame:
    """Members (fp, free) once for each part: (fp, free, key), where key has the bits that a cell agrees in."""
    long = lambda mask: F.lit(_signed(mask)).cast("long")
    choice = F.create_map(*(x for m in masks for x in (long(m), F.array(*map(long, parts_left(m, parts))))))[F.col("free")]
    return members.select("fp", F.explode(choice).alias("free")).withColumn("key", F.col("fp").bitwiseAND(F.bitwise_not("free")))


def linked_in_cell(fp: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of different uint64 fingerprints at most `radius` bits apart, tile by tile."""
    count = np.bitwise_count(fp)
    order = np.argsort(count, kind="stable")
    fp, count = fp[order], count[order].astype(np.int64)
    for i in range(0, len(fp), _TILE):
        left = fp[i : i + _TILE]
        most = count[i : i + _TILE][-1]
        for j in range(i, len(fp), _TILE):
            if count[j] - most > radius:
                break
            near = np.bitwise_count(left[:, None] ^ fp[None, j : j + _TILE]) <= radius
            a, b = np.nonzero(np.triu(near, 1) if i == j else near)
            if len(a):
                yield left[a], fp[j + b]


def _compared(radius: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (fp, free, key) sorted by cell -> links (a, b) that connect what the cells' links connect."""

    def edges(pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        both = [pa.array(np.concatenate([p[i] for p in pairs]).view(np.int64)) for i in range(2)]
        [out] = _united(iter([pa.RecordBatch.from_arrays(both, ["a", "b"])]))
        return pa.RecordBatch.from_arrays(out.columns, ["a", "b"])

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        held: list[np.ndarray] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            fp, free, key = (np.asarray(batch.column(i)) for i in range(3))
            starts = np.flatnonzero(np.r_[last != (free[0], key[0]), (free[1:] != free[:-1]) | (key[1:] != key[:-1])])
            last = (free[-1], key[-1])
            for piece, new in zip(np.split(fp, starts), [False] + [True] * len(starts), strict=True):
                if new and held:
                    yield np.concatenate(held) if len(held) > 1 else held[0]
                    held = []
                if len(piece):
                    held.append(piece)
        if held:
            yield np.concatenate(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        for fp in cells(batches):
            if len(fp) < 2:
                continue
            for a, b in linked_in_cell(fp.view(np.uint64), radius):
                pairs.append((a, b))
                held += len(a)
                if held >= _PAIRS:
                    got = edges(pairs)
                    pairs, held = [], 0
                    if got.num_rows > _PAIRS // 2:
                        yield got
                    else:
                        pairs, held = [tuple(np.asarray(c).view(np.uint64) for c in got.columns)], got.num_rows
        if pairs:
            yield edges(pairs)

    return run


def links(prints: DataFrame, radius: int = 2, most: int = 1 << 16) -> DataFrame:
    """Stored links (a, b) between the distinct `fp` of prints; their components are those of all pairs within radius.

    most: members of a cell that one task compares. Larger cells are dealt out anew, by joins that may split a hot one.
    """
    found: list[DataFrame] = []
    masks, members, old = [_ALL], prints.select("fp", F.lit(-1).cast("long").alias("free")), []
    while True:
        cells = _cells(members, masks, radius + 1)
        hot = stored(cells.groupBy("free", "key").count().where(F.col("count") > most).select("free", "key"), "hot")
        more = not hot.isEmpty()
        small = cells.join(hot, ["free", "key"], "left_anti").select("fp", "free", "key") if more else cells
        by_cell = small.repartition("free", "key").sortWithinPartitions("free", "key")
        found.append(stored(by_cell.transform(mapped, _compared(radius), "a long, b long"), "links"))
        if more:
            masks = [r.free % (1 << 64) for r in hot.select("free").distinct().collect()]  # of the few that rounds so far can make
            members = stored(cells.join(hot, ["free", "key"], "left_semi").select("fp", "free"), "members")
        discard(hot, *old)
        if not more:
            break
        old = [members]
    if len(found) == 1:
        return found[0]
    out = found[0]
    for part in found[1:]:
        out = out.union(part)
    out = stored(out.distinct(), "links")
    discard(*found)
    return out


def near_copies(docs: DataFrame, k: int = 3, radius: int = 2, most: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fingerprint, component_id) for every row of docs.

    fingerprint is 16 lowercase hex digits: the SimHash of the whole text's k-word shingles with repeats, A-Z in lower
    case, from XXH64 with seed 42. A null or empty text, or one without words, has fingerprint zero and links like any
    other. Rows whose fingerprints differ in at most `radius` bits are linked; component_id is the smallest id reachable.
    Rows with a null id link like others but lend no id: theirs is null if the component has no other. Repeated rows
    are kept; other columns are ignored; an empty table gives an empty result. The result is a table in the shared
    folder, the only one that stays.
    """
    prints = stored(fingerprints(docs, k, id_col, text_col), "prints")
    firsts = stored(prints.groupBy("fp").agg(F.min(id_col).alias("first")), "firsts")
    near = links(firsts, radius, most)
    roots = components(near)
    reach = firsts.join(roots, firsts.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    ids = reach.groupBy("root").agg(F.min("first").alias("component_id"))
    named = reach.join(ids, "root").select("fp", "component_id")
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    out = stored(prints.join(named, "fp").select(id_col, digits, "component_id"), "near_copies")
    discard(prints, firsts, near)
    return out
