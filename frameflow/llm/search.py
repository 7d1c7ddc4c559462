"""Ranked lexical search: an inverted index by windows of documents, scored window by window.

The index has one row for each window of up to 4,096 documents: their ids and lengths, and the postings of their terms
as (slot in the window, occurrences), sorted by term. Documents keep the table's storage order, so building it takes
one pass without a shuffle; each partition cuts its own windows.

A task takes its windows one after the other. For each item it scatters the shares of the item's terms into an array
of one 64-bit score for each slot (32 KB), marks in a bitset of one word which blocks of 64 slots were hit, harvests
those blocks alone into the item's heap of the best documents, and clears them. Shares depend on the term and the
document only, so they are computed once for a window and all items. What a task passes on is its heaps.

All arithmetic behind the weights is in integers, so order and partitioning change nothing. Terms are compared by
64-bit hashes. Items are taken in blocks of bounded size, each a pass over the index.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameflow.llm.common import discard, fresh_path, mapped, shuffles_removed, stored

#: Terms are letters and digits of ASCII, and any character beyond it; only A-Z are folded.
_FOLD = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))
_WINDOW = 4096
_BLOCK = 64
_TOKENS = 1 << 21  # of a window, unless its last document has more
_INDEX = "n_docs long, n_terms long, doc_ids array<long>, lengths array<long>, terms array<long>, sizes array<int>, slots binary, counts binary"


def term_lists(text: str | None, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The terms of text with repeats, from about `size` bytes at a time."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD)
    at = 0
    while at < len(data):
        stop = data.find(b" ", at + size)
        stop = len(data) if stop < 0 else stop
        if got := data[at:stop].split():
            yield got
        at = stop


class _Numbers(dict):
    """Numbers terms in the order in which they are asked for."""

    def __missing__(self, term: bytes) -> int:
        self[term] = n = len(self)
        return n


def term_hash(terms: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(t) for t in terms], np.uint64)


class _Writer:
    """Collects one window."""

    def __init__(self) -> None:
        self.numbers = _Numbers()
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.held = 0

    def _merge(self) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate(self.keys) if self.keys else np.zeros(0, np.int64)
        counts = np.concatenate(self.counts) if self.counts else np.zeros(0, np.int64)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        return keys[first], np.add.reduceat(counts[order], first) if len(keys) else counts

    def add(self, doc_id: int | None, text: str | None) -> None:
        slot, n = len(self.ids), 0
        number = self.numbers.__getitem__
        for terms in term_lists(text):
            keys, counts = np.unique(np.fromiter(map(number, terms), np.int64, len(terms)), return_counts=True)
            self.keys.append(keys << 16 | slot)
            self.counts.append(counts)
            n += len(terms)
            self.held += len(keys)
            if self.held > 2 * _TOKENS:  # within a very long document
                keys, counts = self._merge()
                self.keys, self.counts, self.held = [keys], [counts], len(keys)
        self.ids.append(doc_id)
        self.lengths.append(n)

    @property
    def full(self) -> bool:
        return len(self.ids) >= _WINDOW or self.held >= _TOKENS

    def row(self) -> pa.RecordBatch:
        terms = term_hash(list(self.numbers))
        order = np.argsort(terms)
        place = np.empty(len(terms), np.int64)
        place[order] = np.arange(len(terms))
        self.keys = [place[k >> 16] << 16 | k & 0xFFFF for k in self.keys]
        keys, counts = self._merge()
        sizes = np.bincount(keys >> 16, minlength=len(terms)).astype(np.int32)
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        columns = [
            pa.array([sum(n > 0 for n in self.lengths)]), pa.array([sum(self.lengths)]), one(pa.array(self.ids, pa.int64())), one(pa.array(self.lengths, pa.int64())), one(pa.array(terms[order].view(np.int64))), one(pa.array(sizes)),
            pa.array([(keys & 0xFFFF).astype("<u2").tobytes()], pa.binary()), pa.array([counts.astype("<u4").tobytes()], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["n_docs", "n_terms", "doc_ids", "lengths", "terms", "sizes", "slots", "counts"])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index of docs: every row is a document, with or without an id or a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window = _Writer()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                window.add(doc_id, text.as_py())
                if window.full:
                    yield window.row()
                    window = _Writer()
        if window.ids:
            yield window.row()

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    # a reader holds a row group of such rows at once
    return stored(rows.transform(mapped, run, _INDEX), "index", **{"parquet.block.size": str(16 << 20)})


@dataclass(frozen=True)
class Block:
    """Items with the hashes and weights of their terms; items refer to terms by place."""

    keys: list[int]
    item_ids: list[int | None]
    terms: np.ndarray
    weights: np.ndarray
    places: list[np.ndarray]


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def _penalty(lengths: np.ndarray, n: int, total: int) -> np.ndarray:
    """m of each document: 10 plus 90 times its length by the mean length, rounded down; exact at any size."""
    if 90 * n * int(lengths.max(initial=0)) < 1 << 63:
        return 10 + 90 * lengths * n // max(1, total)
    return np.array([10 + 90 * int(x) * n // max(1, total) for x in lengths], np.int64)


def _best(block: Block, n: int, total: int, top: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Index rows -> (item, item_id, doc_id, score): the best `top` documents of this task's windows for each item."""

    def harvest(heap: list[tuple], scores: np.ndarray, word: int, ids: list, by_id: np.ndarray) -> None:
        hit = np.flatnonzero(np.unpackbits(np.array([word], "<u8").view(np.uint8), bitorder="little"))
        values = scores[hit]
        scores[hit] = 0
        least = heap[0][0] if len(heap) == top else 1
        if len(over := values[values >= least]) > top:
            least = max(least, int(np.partition(over, -top)[-top]))
        row, column = np.nonzero(values >= least)
        slots = hit[row] * _BLOCK + column
        got = values[row, column]
        for i in np.lexsort((by_id[slots], -got))[:top]:
            doc_id = ids[slots[i]]
            entry = (int(got[i]), -math.inf if doc_id is None else -doc_id)
            if len(heap) < top:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: list[list[tuple]] = [[] for _ in block.keys]
        scores = np.zeros((_WINDOW // _BLOCK, _BLOCK), np.int64)
        flat = scores.reshape(-1)
        for batch in batches:
            cells = {name: batch.column(i) for i, name in enumerate(("doc_ids", "lengths", "terms", "sizes", "slots", "counts"))}
            for r in range(batch.num_rows):
                array = lambda name, r=r: cells[name][r].values.to_numpy(zero_copy_only=False)
                terms, sizes = array("terms").view(np.uint64), array("sizes").astype(np.int64)
                if not len(terms):
                    continue
                at = np.minimum(np.searchsorted(terms, block.terms), len(terms) - 1)
                known = terms[at] == block.terms
                size = np.where(known, sizes[at], 0)
                bound = np.r_[0, np.cumsum(size)]
                begin = (np.cumsum(sizes) - sizes)[at]
                take = np.arange(bound[-1]) + np.repeat(begin - bound[:-1], size)
                slots = np.frombuffer(cells["slots"][r].as_buffer(), "<u2")[take].astype(np.int64)
                tf = np.frombuffer(cells["counts"][r].as_buffer(), "<u4")[take].astype(np.int64)
                m = _penalty(array("lengths"), n, total)
                share = np.repeat(block.weights, size) * (1_000_000_000 * tf // (1000 * tf + 8 * m[slots]))
                blocks = np.left_shift(np.uint64(1), (slots // _BLOCK).astype(np.uint64))
                words = np.zeros(len(size), np.uint64)
                words[known] = np.bitwise_or.reduceat(blocks, bound[:-1][known]) if known.any() else 0
                ids = cells["doc_ids"][r].values.to_pylist()
                by_id = np.empty(len(ids), np.int64)
                by_id[sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))] = np.arange(len(ids))
                for heap, places in zip(heaps, block.places, strict=True):
                    word = 0
                    for p in places[known[places]]:
                        own = slots[bound[p] : bound[p + 1]]
                        flat[own] += share[bound[p] : bound[p + 1]]
                        word |= int(words[p])
                    if word:
                        harvest(heap, scores, word, ids, by_id)
        out = [(key, item_id, None if doc == -math.inf else -doc, score) for heap, key, item_id in zip(heaps, block.keys, block.item_ids, strict=True) for score, doc in heap]
        columns = list(zip(*out, strict=True)) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item", "item_id", "doc_id", "score"])

    return run


def _blocks(weighed: DataFrame, n: int, block_bytes: int) -> Iterator[Block]:
    """Items (item, item_id, terms of (term, df)) as blocks of about `block_bytes`, streamed through the driver once."""

    def made(rows: list) -> Block:
        df = {t.term % (1 << 64): t.df for r in rows for t in r.terms}
        terms = np.array(sorted(df), np.uint64)
        places = [np.searchsorted(terms, np.array([t.term % (1 << 64) for t in r.terms], np.uint64)) for r in rows]
        return Block([r.item for r in rows], [r.item_id for r in rows], terms, np.array([weight(n, df[int(t)]) for t in terms], np.int64), places)

    rows, held = [], 0
    for r in weighed.toLocalIterator():
        rows.append(r)
        held += 24 * len(r.terms) + 64
        if held >= block_bytes:
            yield made(rows)
            rows, held = [], 0
    if rows:
        yield made(rows)


def _item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Stored (item, item_id, terms): a number for each row, and the hashes of its distinct terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [term_hash(sorted({t for part in term_lists(text.as_py()) for t in part})).view(np.int64) for text in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(terms, pa.list_(pa.int64()))], ["item", "item_id", "terms"])

    rows = items.select(F.monotonically_increasing_id().alias("item"), F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    return stored(rows.transform(mapped, run, "item long, item_id long, terms array<long>"), "items")


def _ranked(rows: DataFrame, top: int, *keys: str) -> DataFrame:
    order = Window.partitionBy("item", *keys).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def search(index: DataFrame, items: DataFrame, top: int = 10, id_col: str = "item_id", text_col: str = "text", block_bytes: int = 2 << 20) -> DataFrame:
    """(item, item_id, rank, doc_id, score): the `top` best documents of the index for each row of items, as a stored table.

    `item` tells rows with the same item_id apart. Of documents with equal scores the smaller doc_id comes first, those
    without an id last. Items without a term that the index has give no row.
    """
    spark = index.sparkSession
    n, total = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    asked = _item_terms(items, id_col, text_col)
    wanted = asked.select("item", "item_id", F.explode("terms").alias("term"))
    found = index.select(F.explode(F.arrays_zip("terms", "sizes")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.sizes").alias("size"))
    df = found.join(wanted.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("size").alias("df"))
    weighed = wanted.join(df, "term").groupBy("item", "item_id").agg(F.collect_list(F.struct("term", "df")).alias("terms"))
    postings = index.select("doc_ids", "lengths", "terms", "sizes", "slots", "counts")
    schema = "item long, item_id long, doc_id long, score long"
    path = fresh_path(spark, "best")
    with shuffles_removed(spark):
        spark.createDataFrame([], schema).write.parquet(path)
        for block in _blocks(weighed, n or 0, block_bytes):
            best = postings.transform(mapped, _best(block, n, total, top), schema).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(64)))
            _ranked(best, top, "salt").select("item", "item_id", "doc_id", "score").write.mode("append").parquet(path)
    best = spark.read.schema(schema).parquet(path)
    best._frameflow_path = path
    out = stored(_ranked(best, top).select("item", "item_id", F.col("rank").cast("int"), "doc_id", "score"), "ranks")
    discard(asked, best)
    return out


def rank(docs: DataFrame, items: DataFrame, top: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` documents of the highest score above 0 for each row of items.

    Terms are runs of ASCII letters and digits and of characters beyond ASCII in the whole text, A-Z in lower case. With
    N documents that have a term, L terms in all, n terms in a document, df documents that hold a term and tf times that
    a document has it: weight w = floor(1000 ln((2N + 2) / (2df + 1))), m = 10 + 90nN div L, score = sum over the item's
    distinct terms of w * (10^9 tf div (1000 tf + 8m)). Equal scores go by ascending doc_id.

    Null and empty texts have no terms. Every row is a document, and every row of items an item: repeated rows are
    ranked one by one, a null doc_id after others of its score. An empty table on either side gives an empty result.
    Other columns are ignored. The result is a table in the shared folder, the only one that stays.
    """
    index = build_index(docs)
    out = search(index, items, top)
    discard(index)
    return out.drop("item")


#: The same by exploding all terms of all documents.
SEARCH_SQL = r"""with d as materialized (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
 q as materialized (select row_number() over () as item, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from benchmark),
 t as materialized (select r, term, count(*) as tf from (select r, unnest(w) as term from d) group by r, term),
 g as (select count(*) filter (len(w) > 0) as n_docs, sum(len(w))::bigint as total from d),
 f as (select term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::bigint as weight from t, g group by term, n_docs),
 m as (select r, doc_id, 100 - 90 + (90 * len(w) * n_docs) // total as m from d, g where len(w) > 0),
 s as (select item, item_id, doc_id, r, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score
 from (select distinct item, item_id, unnest(w) as term from q) join f using (term) join t using (term) join m using (r) group by all)
 select item_id, (row_number() over (partition by item order by score desc, doc_id))::integer as rank, doc_id, score from s where score > 0 qualify rank <= 10"""
