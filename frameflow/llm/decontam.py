"""Benchmark decontamination: rare n-grams find candidate passages, local alignment judges them.

Test items are taken in blocks of bounded size, each against all documents. Seeds are pairs of words, next to each
other or one word apart, in an item as in a document. A passage that reaches the least score of p points has M matches
and at most 2M - p errors, and two of its matches that follow each other make no such pair only if two errors or more
lie between them; so at least p/2 - 1 of the matches begin a pair that item and passage share. Of any but p/2 - 1 - j of
the item's words, at least j therefore do: the words whose pairs are rarest in the whole corpus, counted in a first
pass, are the seeds, and j of them within the longest passage that can reach the score make a candidate. A second pass
finds these and aligns them with the item by Smith-Waterman over words. No passage is lost; how frequent pairs are only
decides how many have to be aligned. Scores are shares of the item's perfect score, so that edited, shortened or
padded copies score by how much of the item survives in order.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameflow.llm.bytelex import Table, Texts, hashes, mixed, parts
from frameflow.llm.common import discard, mapped, stored

SCHEMA = "doc_id long, item_id long, score double, n_seeds long"
_LEAST_WORDS = 5  # of items whose edited copies count; shorter ones must be found whole
_LEAST_POINTS = 6  # of an alignment, as of three words: two common words are no copy of a short item
_CELLS = 1 << 18  # words that are aligned at once
_HELD = 32 << 20  # bytes of stretches that wait for alignment
_PART = 1 << 18  # bytes of text that are looked at together
_HITS = 1 << 20  # meetings of a text's words with seeds of items that are looked at together
_APART = (1, 2)  # words from the first of a pair to the second


#: Blocks of scripts that are written without spaces between words: each character is a word.
_UNSPACED = (
    (0x0E00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19FF), (0x1A20, 0x1AAF), (0x1B00, 0x1B7F), (0x2E80, 0x312F), (0x31A0, 0x31FF),
    (0x3400, 0x4DBF), (0x4E00, 0xA4CF), (0xA980, 0xA9FF), (0xAA60, 0xAADF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1AFF0, 0x1B16F), (0x20000, 0x3FFFF),
)
_OUTSIDE, _RUN, _SINGLE = range(3)
_KIND: list[np.ndarray] = []


def _kinds() -> np.ndarray:
    """By code point: outside words, in runs (letters with their combining marks), or a word by itself (digits, unspaced scripts)."""
    if not _KIND:
        of = {"L": _RUN, "M": _RUN, "N": _SINGLE}
        kind = np.fromiter((of.get(unicodedata.category(chr(i))[0], _OUTSIDE) for i in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
        for a, b in _UNSPACED:
            kind[a : b + 1][kind[a : b + 1] == _RUN] = _SINGLE
        _KIND.append(kind)
    return _KIND[0]


def word_hashes(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, and bounds by text.

    Words are runs of letters; digits and characters of scripts without spaces stand one by one. Case, composition of
    accents and all between words don't count.
    """
    folded = [texts.data[a:b].tobytes().decode("utf-8", "replace").casefold() for a, b in zip(texts.begin.tolist(), texts.end.tolist())]
    folded = [t if t.isascii() else unicodedata.normalize("NFC", t) for t in folded]
    data = np.frombuffer("\n".join(["", *folded, ""]).encode("utf-32-le"), np.uint32)
    kind = _kinds()[data]
    at = np.flatnonzero((kind[1:] != kind[:-1]) | (kind[1:] == _SINGLE)) + 1
    begin, end = at[:-1], at[1:]
    keep = kind[begin] != _OUTSIDE
    begin, end = begin[keep], end[keep]
    size = np.array([len(t) + 1 for t in folded], np.int64)
    return hashes(data, begin, end, 2), np.append(np.searchsorted(begin, np.cumsum(size) - size + 1), len(begin))


class Items:
    """A block of test items: words by number, the score that counts, and after counting, seeds."""

    def __init__(self, item_ids: list[int], texts: list[str], least_score: float):
        t = Texts(pa.array(texts, pa.string()))
        h, bounds = word_hashes(t)
        self.vocabulary = Table()
        self.vocabulary.add(np.unique(h))
        ids = self.vocabulary.find(h)
        spans = list(zip(bounds[:-1].tolist(), bounds[1:].tolist()))
        keep = [k for k, (a, b) in enumerate(spans) if b > a]
        self.item_ids = [item_ids[k] for k in keep]
        self.words = [ids[spans[k][0] : spans[k][1]] for k in keep]
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.points = np.maximum(np.ceil(2 * least_score * self.size - 1e-9).astype(np.int64), _LEAST_POINTS)
        self.points = np.where(self.size < _LEAST_WORDS, 2 * self.size, self.points)
        self.reach = self.size + np.maximum(2 * self.size - self.points, 0)  # words of the longest passage with these points
        flat = np.concatenate([*self.words, np.zeros(0, np.int64)]).astype(np.int64)
        ends = np.repeat(np.cumsum(self.size), self.size)
        keys = [self._pair_keys(flat, ends, d) for d in _APART]
        keys.append(np.where(np.repeat(self.size, self.size) == 1, self._word_keys(flat), np.uint64(0)))
        self.pairs = Table()
        distinct = np.unique(np.concatenate(keys))
        self.pairs.add(distinct[distinct != 0])
        self.one_word = bool((self.size == 1).any())
        #: By item: the numbers of the pairs that each of its words begins, -1 for none; a single word is its own pair.
        self.begun = np.split(np.stack([np.where(k != 0, self.pairs.find(k), -1) for k in keys], axis=1), np.cumsum(self.size)[:-1]) if len(flat) else []

    def find(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Words of texts by number, -1 for those of no item, and bounds."""
        h, bounds = word_hashes(texts)
        return self.vocabulary.find(h), bounds

    def _word_keys(self, ids: np.ndarray) -> np.ndarray:
        return mixed((self.vocabulary.n * self.vocabulary.n + ids + 1).astype(np.uint64))

    def _pair_keys(self, ids: np.ndarray, ends: np.ndarray, apart: int) -> np.ndarray:
        """For each word the key of the pair with the one `apart` words on, 0 if its text (up to ends) has none or if
        either is no item's word."""
        out = np.zeros(len(ids), np.uint64)
        if len(ids) > apart:
            first, second = ids[:-apart].astype(np.int64), ids[apart:].astype(np.int64)
            key = mixed((first * self.vocabulary.n + second + 1).astype(np.uint64))
            fine = (first >= 0) & (second >= 0) & (np.arange(apart, len(ids)) < ends[:-apart])
            out[:-apart] = np.where(fine, key, np.uint64(0))
        return out

    def pairs_in(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, pair number) of the items' pairs in texts, in the order of words."""
        ends = np.repeat(bounds[1:], np.diff(bounds))
        keys = [self._pair_keys(ids, ends, d) for d in _APART]
        if self.one_word:
            keys.append(np.where(ids >= 0, self._word_keys(ids.astype(np.int64)), np.uint64(0)))
        at, pair = [], []
        for k in keys:
            some = np.flatnonzero(k)
            number = self.pairs.find(k[some])
            at.append(some[number >= 0])
            pair.append(number[number >= 0])
        at, pair = np.concatenate(at), np.concatenate(pair)
        order = np.argsort(at, kind="stable")
        return at[order], pair[order]

    def choose(self, frequency: np.ndarray) -> None:
        """Seeds: of each item the words whose pairs are rarest, as many as leave `needed` in any passage with its points."""
        surely = np.minimum((self.points + 1) // 2, self.size) - 1  # words of any such passage that begin a pair
        self.needed = np.maximum(surely // 4, 1)
        of = np.append(frequency, 0)
        self.seeds = []
        for begun, size, most, needed in zip(self.begun, self.size.tolist(), surely.tolist(), self.needed.tolist(), strict=True):
            starts = begun[: size - 1] if size > 1 else begun
            n = max(1, len(starts) - most + needed) if size > 1 else 1
            chosen = starts[np.argsort(of[starts].sum(axis=1), kind="stable")[:n]]
            self.seeds.append(np.unique(chosen[chosen >= 0]))
        pair = np.concatenate(self.seeds)
        order = np.argsort(pair, kind="stable")
        self.seed_item = np.repeat(np.arange(len(self.seeds)), [len(x) for x in self.seeds])[order]
        self.seed_at = np.searchsorted(pair[order], np.arange(self.pairs.n + 1))


def align(docs: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Best local alignment score of each row of docs (word numbers, -2 beyond the end) with the item: 2, -1, -1.

    item is one for all rows, or one row for each with -3 beyond the end.
    """
    docs, item = np.ascontiguousarray(docs.T), np.atleast_2d(item)
    kind = np.int16 if docs.shape[0] + 2 * item.shape[1] < 32_000 else np.int32
    h = np.zeros((docs.shape[0] + 1, docs.shape[1]), kind)
    ramp = np.arange(len(h), dtype=kind)[:, None]
    best, new, step = np.zeros(docs.shape[1], kind), np.zeros_like(h), np.zeros(docs.shape, kind)
    for j in range(item.shape[1]):
        np.multiply(docs == item[:, j], kind(3), out=step)
        step -= 1
        step += h[:-1]
        h -= 1
        np.maximum(step, h[1:], out=new[1:])
        np.maximum(new, 0, out=new)
        new[0] = 0
        new += ramp
        np.maximum.accumulate(new, axis=0, out=h)  # gaps along the document
        h -= ramp
        np.maximum(best, h.max(0), out=best)
    return best


def _candidates(items: Items, ids: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(text, item, begin, end) of stretches that hold every passage with enough points.

    Words are taken in stretches that meet about _HITS seeds, each with as many words more as the longest passage has,
    so memory doesn't grow with the number of items.
    """
    at, pair = items.pairs_in(ids, bounds)
    times = items.seed_at[pair + 1] - items.seed_at[pair]
    at, pair, times = at[times > 0], pair[times > 0], times[times > 0]
    met = np.concatenate([[0], np.cumsum(times)])
    first, longest = 0, int(items.reach.max(initial=0))
    while first < len(at):
        end = max(first + 1, int(np.searchsorted(met, met[first] + _HITS, "right")) - 1)
        more = int(np.searchsorted(at, at[end - 1] + longest, "right"))
        yield from _stretches(items, at[first:more], pair[first:more], times[first:more], bounds)
        first = end


def _stretches(items: Items, at: np.ndarray, pair: np.ndarray, times: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """The same for some words of a text that begin seeds."""
    total, lo = int(times.sum()), items.seed_at[pair]
    number = np.arange(total)
    item = items.seed_item[number + np.repeat(lo - (np.cumsum(times) - times), times)]
    order = np.argsort(item, kind="stable")
    item, place = item[order], np.repeat(at, times)[order]
    text = np.searchsorted(bounds, place, "right") - 1
    new = np.concatenate([[True], (item[1:] != item[:-1]) | (text[1:] != text[:-1]) | (place[1:] != place[:-1])])
    item, place, text = item[new], place[new], text[new]  # a word counts once, whichever pairs it begins
    last = np.arange(len(item)) + items.needed[item] - 1
    here = np.minimum(last, len(item) - 1)
    enough = (last == here) & (item[here] == item) & (text[here] == text) & (place[here] - place < items.reach[item])
    first = np.flatnonzero(enough)
    if not len(first):
        return
    last = place[here[first]]
    item, text, place = item[first], text[first], place[first]
    begin = np.maximum(bounds[text], last - items.reach[item] + 1)
    end = np.minimum(bounds[text + 1], place + items.reach[item])
    new = np.flatnonzero(np.concatenate([[True], (item[1:] != item[:-1]) | (text[1:] != text[:-1]) | (begin[1:] > end[:-1])]))
    for t, k, a, b in zip(text[new].tolist(), item[new].tolist(), begin[new].tolist(), end[np.append(new[1:], len(first)) - 1].tolist(), strict=True):
        reach = int(items.reach[k])
        while b - a > 8 * reach:  # parts of long stretches overlap by the longest passage
            yield t, k, a, a + 8 * reach
            a += 7 * reach
        yield t, k, a, b


def _scores(items: Items, keys: list[tuple[int, bytes]]) -> dict[tuple[int, bytes], int]:
    """Alignment scores of (item, 32-bit word numbers of a stretch)."""
    size = items.size.tolist()
    todo = sorted(set(keys), key=lambda key: (size[key[0]] // 4, len(key[1])))
    out: dict[tuple[int, bytes], int] = {}
    while todo:
        n = max(1, min(256, 4 * _CELLS // max(len(raw) for _, raw in todo[-256:])))
        group, todo = todo[-n:], todo[:-n]
        docs = np.full((len(group), max(len(raw) for _, raw in group) // 4), -2, np.int32)
        words = np.full((len(group), max(size[k] for k, _ in group)), -3, np.int32)
        for j, (k, raw) in enumerate(group):
            docs[j, : len(raw) // 4] = np.frombuffer(raw, np.int32)
            words[j, : size[k]] = items.words[k]
        out.update(zip(group, align(docs, words).tolist()))
    return out


def counted(docs: DataFrame, block: list[tuple[int, str]], least_score: float) -> Items | None:
    """The items of a block with seeds by how often docs (text) have their words; None if there is nothing to find."""
    spark = docs.sparkSession
    items = Items([i for i, _ in block], [t for _, t in block], least_score)
    if not items.item_ids:
        return None
    shared = spark.sparkContext.broadcast(items)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        total = np.zeros(own.pairs.n, np.int64)
        for batch in batches:
            for _, _, texts in parts(batch.column("text"), _PART):
                np.add.at(total, own.pairs_in(*own.find(texts))[1], 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["pair", "n"])

    frequency = np.zeros(items.pairs.n, np.int64)
    found = docs.select("text").transform(mapped, count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # as many as the block has pairs
    frequency[np.asarray(found.column("pair"))] = np.asarray(found.column("n"))
    items.choose(frequency)
    return items


def copies(own: Items, column: pa.Array) -> Iterator[dict[tuple[int, int], tuple[float, int]]]:
    """(score, seeds) by (text, item), some of a column of texts at a time; seeds are distinct pairs."""
    for a, _, texts in parts(column, _PART):
        best: dict[tuple[int, int], tuple[float, int]] = {}
        found: list[tuple[int, tuple[int, bytes]]] = []
        held = 0

        def judge() -> None:
            points = _scores(own, [key for _, key in found])
            for text, key in found:
                item = key[0]
                if points[key] >= own.points[item]:
                    words = np.frombuffer(key[1], np.int32)
                    seeds = len(np.intersect1d(own.pairs_in(words, np.array([0, len(words)]))[1], own.seeds[item]))
                    best[text, item] = max(best.get((text, item), (0.0, 0)), (points[key] / (2 * len(own.words[item])), seeds))
            found.clear()

        ids, bounds = own.find(texts)
        for text, item, begin, end in _candidates(own, ids, bounds):
            found.append((a + text, (item, ids[begin:end].astype(np.int32).tobytes())))
            held += 4 * (end - begin) + 200
            if held > _HELD:
                judge()
                held = 0
        judge()
        if best:
            yield best


def search(docs: DataFrame, items: Items) -> DataFrame:
    """Hits (doc_id, item_id, score, n_seeds) of a block's items in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for best in copies(own, batch.column("text")):
                columns = [batch.column("doc_id").take(pa.array([t for t, _ in best], pa.int64())), pa.array([own.item_ids[i] for _, i in best], pa.int64()), pa.array([s for s, _ in best.values()], pa.float64()), pa.array([n for _, n in best.values()], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "score", "n_seeds"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(mapped, find, SCHEMA)


def without(docs: DataFrame, items: Items) -> DataFrame:
    """The rows of docs, with all their columns, whose text has no copy of a block's items."""
    shared = docs.sparkSession.sparkContext.broadcast(items)
    place = docs.columns.index("text")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            stays = np.ones(len(batch), bool)
            for best in copies(own, batch.column(place)):
                stays[[t for t, _ in best]] = False
            yield batch.filter(pa.array(stays))

    return docs.transform(mapped, step, docs.schema)


def blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """The distinct items (item_id, text) in blocks of about `block_bytes` of text or one item."""
    items = benchmark.selectExpr("cast(item_id as long) item_id", "text").where("text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // max(1, block_bytes // 2)))
    for k in range(n):
        block = [(r.item_id, r.text) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").collect()]
        if block:
            yield block


def contamination(docs: DataFrame, benchmark: DataFrame, least_score: float = 0.4, block_bytes: int = 4 << 20) -> DataFrame:
    """One row per document and test item that it holds a copy of, exact or edited, with score from 0 to 1.

    docs has doc_id and text, benchmark item_id and text; other columns are ignored. Items of fewer than five words
    tell no edited copy from chance: their words must all be found, in a row. Nor is an alignment of under six points
    (three words) a copy of a longer item. Items without a letter or digit hold nothing to be found. Null texts hold
    nothing; repeated rows are reported each; a null id is reported as null. Blocks of items are sent to all tasks,
    each of `block_bytes` of text or one item.
    """
    out = None
    for block in blocks(benchmark, block_bytes):
        items = counted(docs, block, least_score)
        if items is not None:
            found = search(docs, items)
            out = found if out is None else out.union(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], SCHEMA)


def clean(docs: DataFrame, benchmark: DataFrame, least_score: float = 0.4, block_bytes: int = 4 << 20) -> DataFrame:
    """The rows of docs, with all their columns, that hold no copy of a test item, by the rules of contamination().

    One block of items after another strikes rows out of what the one before left.
    """
    left, before = docs, None
    for block in blocks(benchmark, block_bytes):
        items = counted(left, block, least_score)
        if items is None:
            continue
        if left is not docs:
            left = stored(left, "clean")
            if before is not None:
                discard(before)
            before = left
        left = without(left, items)
    return left
