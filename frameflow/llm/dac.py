"""Token ids on disk as directly addressable codes.

An id is split into chunks of fixed widths, lowest first. Level k holds the k-th chunk of every id that has one,
and a bit per entry that says whether another level follows; a rank directory (ones before every 512th bit) finds
an entry's place on the next level. Any token is read by touching one chunk per level, without decoding a block.
Widths are chosen per segment from its own histogram of id sizes, so that chunks and bits take least room.

A segment is one binary value: a header, the directory of its documents, then the levels. Segments are rows of
Parquet files (uncompressed), written by Spark's committer in ascending document order: `part` numbers the ranges of
documents, `base` counts the tokens of the part before the segment. Writers hold one segment at a time.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameflow.llm.bytelex import parts
from frameflow.llm.common import fresh_path, mapped
from frameflow.llm.wordcodec import WordCodec, default_path

MAGIC = b"DAC1"
SEGMENT_SCHEMA = "part long, base long, n_docs long, n_tokens long, payload binary"
RESULT_SCHEMA = "part long, doc_id long, start long, n_tokens long, ids_crc32 long"
_RANK = 512


def best_widths(ids: np.ndarray) -> list[int]:
    """Chunk widths of least total size for these ids, with one continuation bit for each entry but on the last level."""
    bits = np.zeros(33, np.int64)
    values, counts = np.unique(ids, return_counts=True)
    for v, c in zip(values.tolist(), counts.tolist()):
        bits[max(1, v.bit_length())] += c
    top = int(np.flatnonzero(bits)[-1]) if bits.any() else 1
    over = [int(bits[b + 1 :].sum()) for b in range(top + 1)]  # ids with more than b bits
    over[0] = len(ids)
    best: list[tuple[int, list[int]]] = [(0, [])] * (top + 1)
    for at in range(top - 1, -1, -1):  # best[at]: the levels from bit `at` on
        best[at] = min((over[at] * (w + (at + w < top)) + best[at + w][0], [w, *best[at + w][1]]) for w in range(1, top - at + 1))
    return best[0][1]


def _pack_bits(values: np.ndarray, width: int) -> bytes:
    """Values of `width` bits each, lowest bit first, end to end."""
    if width == 8:
        return values.astype(np.uint8).tobytes()
    if width == 16:
        return values.astype("<u2").tobytes()
    out = np.empty((len(values), width), np.uint8)
    for k in range(width):
        out[:, k] = (values >> np.uint32(k)) & np.uint32(1)
    return np.packbits(out, bitorder="little").tobytes()


def _unpack_bits(raw: np.ndarray, n: int, width: int) -> np.ndarray:
    if width == 8:
        return raw[:n].astype(np.uint32)
    if width == 16:
        return raw[: 2 * n].view("<u2").astype(np.uint32)
    bits = np.unpackbits(raw, count=n * width, bitorder="little").reshape(n, width)
    out = np.zeros(n, np.uint32)
    for k in range(width):
        out |= bits[:, k].astype(np.uint32) << np.uint32(k)
    return out


def write_segment(doc_ids: np.ndarray, known: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """The bytes of one segment; known is False where doc_id is null."""
    ids = np.ascontiguousarray(ids, np.uint32)
    widths = best_widths(ids)
    head = [MAGIC, struct.pack("<QQB", len(sizes), len(ids), len(widths)), bytes(widths)]
    directory = [doc_ids.astype("<i8").tobytes(), known.astype(np.uint8).tobytes(), np.concatenate([[0], np.cumsum(sizes)]).astype("<u8").tobytes()]
    body, rest = [], ids
    for k, w in enumerate(widths):
        body.append(struct.pack("<Q", len(rest)))
        body.append(_pack_bits(rest & np.uint32((1 << w) - 1), w))
        if k + 1 < len(widths):
            more = (rest >> np.uint32(w)) > 0
            ones = np.concatenate([[0], np.cumsum(more)])[::_RANK]
            body += [np.packbits(more, bitorder="little").tobytes(), ones.astype("<u8").tobytes()]
            rest = rest[more] >> np.uint32(w)
    return b"".join([*head, *directory, *body])


class Segment:
    """A segment's bytes, read in place."""

    def __init__(self, raw: bytes | memoryview):
        self.raw = np.frombuffer(raw, np.uint8)
        if self.raw[:4].tobytes() != MAGIC:
            raise ValueError("not a token segment")
        self.n_docs, self.n_tokens, levels = struct.unpack("<QQB", self.raw[4:21].tobytes())
        self.widths = self.raw[21 : 21 + levels].tolist()
        at = 21 + levels

        def take(n: int) -> np.ndarray:
            nonlocal at
            at += n
            return self.raw[at - n : at]

        self.doc_ids, self.known, self.starts = take(8 * self.n_docs).view("<i8"), take(self.n_docs).astype(bool), take(8 * (self.n_docs + 1)).view("<u8")
        self.levels = []
        for k, w in enumerate(self.widths):
            n = int(take(8).view("<u8")[0])
            chunks = take((n * w + 7) // 8)
            last = k + 1 == levels
            self.levels.append((n, chunks, None if last else take((n + 7) // 8), None if last else take(8 * (n // _RANK + 1)).view("<u8")))

    def token(self, i: int) -> int:
        """The i-th id, from one chunk per level."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        out = shift = 0
        for w, (_, chunks, more, ranks) in zip(self.widths, self.levels):
            first, bit = divmod(i * w, 8)
            out |= ((int.from_bytes(chunks[first : first + (bit + w + 7) // 8].tobytes(), "little") >> bit) & ((1 << w) - 1)) << shift
            if more is None or not more[i >> 3] >> (i & 7) & 1:
                return out
            block = i // _RANK
            inside = np.unpackbits(more[block * _RANK // 8 : (i + 7) // 8], bitorder="little")[: i - block * _RANK]
            i, shift = int(ranks[block]) + int(inside.sum()), shift + w
        return out

    def tokens(self) -> np.ndarray:
        """All ids."""
        out = None
        for w, (n, chunks, more, _) in zip(self.widths[::-1], self.levels[::-1]):
            low = _unpack_bits(chunks, n, w)
            if more is not None:
                where = np.flatnonzero(np.unpackbits(more, count=n, bitorder="little"))
                low[where] |= out << np.uint32(w)
            out = low
        return out if out is not None else np.zeros(0, np.uint32)


def write_tokens(docs: DataFrame, path: str, end_id: int = 1, segment_tokens: int = 1 << 20, tokenizer: str | None = None) -> None:
    """Encodes every text of docs (doc_id, text; null text: empty), adds end_id, and writes segments under path.

    Documents are in ascending doc_id order over the parts, nulls first, equal ids by a hash of their texts; equal rows
    may lie in several parts, so that no id is too much for one task. Other columns are ignored; an empty table writes
    no segment.
    """
    file = tokenizer or default_path()

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        codec, part = WordCodec.of(file), TaskContext.get().partitionId()
        held: list[tuple] = []
        base = size = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, base, size
            names, ids, sizes = pa.concat_arrays([h[0] for h in held]), np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            raw = write_segment(np.asarray(names.fill_null(0)), np.asarray(names.is_valid()), sizes, ids)
            out = [[part], [base], [len(sizes)], [len(ids)], [raw]]
            base, held, size = base + len(ids), [], 0
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, [pa.int64()] * 4 + [pa.binary()])], [x.split()[0] for x in SEGMENT_SCHEMA.split(", ")])

        for batch in batches:
            for a, b, texts in parts(batch.column("text")):
                ids, counts = codec.encode(texts)
                held.append((batch.column("doc_id").slice(a, b - a), np.insert(ids, np.cumsum(counts), end_id), counts + 1))
                size += len(held[-1][1])
                if size >= segment_tokens:
                    yield flush()
        if held:
            yield flush()

    keyed = docs.selectExpr("cast(doc_id as long) doc_id", "text", "xxhash64(text) digest", "monotonically_increasing_id() row")
    ordered = keyed.repartitionByRange("doc_id", "digest", "row").sortWithinPartitions("doc_id", "digest", "row").select("doc_id", "text")
    ordered.transform(mapped, step, SEGMENT_SCHEMA).write.option("compression", "none").parquet(path)


def read_tokens(spark, path: str) -> DataFrame:
    """Per document, from the segments under path: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, base, payload in zip(*(batch.column(c) for c in ("part", "base", "payload"))):
                s = Segment(payload.as_buffer())
                raw = memoryview(np.ascontiguousarray(s.tokens(), "<u4")).cast("B")
                starts = s.starts.astype(np.int64)
                bounds = starts.tolist()
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds, bounds[1:])]
                columns = [np.full(s.n_docs, part.as_py()), pa.array(s.doc_ids, pa.int64(), mask=~s.known), starts[:-1] + base.as_py(), np.diff(starts), np.array(crc, np.int64)]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns], [x.split()[0] for x in RESULT_SCHEMA.split(", ")])

    segments = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    # one row for each part: as many as there were tasks
    totals = segments.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("part", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rows = segments.select("part", "base", "payload").transform(mapped, step, RESULT_SCHEMA)
    return rows.join(before, "part").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, end_id: int = 1, tokenizer: str | None = None) -> DataFrame:
    """Writes docs as token segments in the shared folder and reads them back."""
    path = fresh_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, end_id=end_id, tokenizer=tokenizer)
    return read_tokens(docs.sparkSession, path)
