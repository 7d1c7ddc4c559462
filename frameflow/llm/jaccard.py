"""Exact Jaccard self-join of documents on word n-grams, as a blocked sparse product with size-derived bounds.

The document by n-gram incidence matrix M gives overlaps as M times its transpose. Only what can reach the threshold
is multiplied:

1. Documents with equal sets are one class, so exact copies cost nothing further.
2. N-grams have one global order, rare first: long n-grams before short ones, and n-grams found frequent after all
   others. A pair over the threshold shares an n-gram among each one's first n - ceil(t n) + 1 ("prefix"). The order
   decides only how much work there is; any order gives the same pairs.
3. The columns of the matrix cut down to prefixes are dealt out by n-gram. Within a column, sorted by set size, a
   class is paired with the classes just before it (a band), if their sizes allow the threshold. Counts of common
   n-grams, accumulated over columns, and the place of the first one discard pairs that cannot reach it. Columns no
   longer than the band are thereby done; longer ones first serve to find classes that are connected anyway, and
   afterwards are multiplied out for pairs across components alone.
4. Remaining pairs are dealt into cells of bounded pairs and bytes, each cell gets the rows of M that it needs, once,
   and multiplies them: overlap counts of whole sets decide.

Links are never listed for all pairs of a group, nothing is collected but bounded lists of frequent n-grams and
bitmaps of bounded size, and every intermediate result that is used again is a table in the shared folder.

Classes are named by a 64-bit hash of one row's id and text. Two of N classes with one name would be taken for one
in the links (N * N / 2^65 are expected, under three in 10^10); rows that stay or go are told apart by 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameflow.llm.bytelex import Texts, hashes, lower_ascii, mixed, of_text, parts, spans, words
from frameflow.llm.common import discard, lean, mapped, stored
from frameflow.llm.components import components

_BAND = 16
_FREQUENT = 50
_MOST_FREQUENT = 200_000
_CELL_PAIRS = 4_000
_CELL_BYTES = 8 << 20
_SALT_ROWS = 2_000
_SKETCH = 1024
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Threshold:
    """den * intersection >= num * union."""

    def __init__(self, num: int = 90, den: int = 100):
        if not 0 < num <= den:
            raise ValueError("the threshold lies over 0 and at most at 1")
        self.num, self.den = num, den

    def prefix(self, n: np.ndarray | int) -> np.ndarray | int:
        """How many of the first n-grams a set of size n has to show: a partner shares at least ceil(t n)."""
        return n + (-self.num * n) // self.den + 1

    def least_overlap(self, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        """The least intersection of sets of these sizes that links them."""
        return -((-self.num * (n + m)) // (self.num + self.den))

    def linked(self, overlap: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        return self.den * overlap >= self.num * (n + m - overlap)


def shingle_sets(texts: Texts, k: int) -> list[np.ndarray]:
    """Each text's distinct k-word n-grams as 64-bit numbers in ascending order (A-Z in lower case).

    A text with fewer words has its whole word sequence as one, a text without words none. The upper byte falls with
    the n-gram's length in bytes, so that ascending order puts long, mostly rarer, n-grams first.
    """
    begin, end = words(texts)
    h = hashes(lower_ascii(texts.data), begin, end, 1)
    bounds = of_text(texts, begin)
    n = len(h) - k + 1
    if n > 0:
        mix = np.zeros(n, np.uint64)
        for j in range(k):
            mix = mixed(mix * _STEP + h[j : j + n])
        long = np.minimum(255, end[k - 1 :] - begin[:n]).astype(np.uint64)
        ids = (np.uint64(255) - long) << np.uint64(56) | mix >> np.uint64(8)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(ids[a : b - k + 1]))
        elif b > a:
            whole = np.array([b - a], np.uint64)
            for j in range(a, b):
                whole = mixed(whole * _STEP + h[j : j + 1])
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    size = np.cumsum([0] + [len(x) for x in arrays]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(size), pa.array(flat.view(np.int64)))


def sketches(sets: list[np.ndarray]) -> pa.Array:
    """Per set a bitmap, in longs, of which of _SKETCH residues an odd number of its n-grams has.

    Two bitmaps differ in at most as many bits as the sets do in n-grams.
    """
    rows = [np.packbits((np.bincount((s % np.uint64(_SKETCH)).astype(np.int64), minlength=_SKETCH) & 1).astype(np.uint8)).view(np.uint64) for s in sets]
    return _lists(rows)


class Wanted:
    """Nodes whose rows are asked for: a bitmap that surely has them all and few others, which tasks filter by.

    Nodes that would need more than `most_bits` are left to a join instead.
    """

    def __init__(self, nodes: DataFrame, per_node: int = 16, most_bits: int = 1 << 26):
        self.nodes = nodes
        self.size = 1 << max(10, (per_node * max(1, nodes.count())).bit_length())
        self.words: np.ndarray | None = None
        if self.size <= most_bits:
            bit = F.pmod(F.xxhash64("node"), F.lit(self.size))
            rows = nodes.select(bit.alias("bit")).groupBy(F.expr("bit div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits"))
            got = rows.toArrow()  # at most most_bits / 64 rows
            self.words = np.zeros(self.size // 64, np.uint64)
            self.words[np.asarray(got.column("word"))] = np.asarray(got.column("bits")).view(np.uint64)

    def of(self, docs: DataFrame) -> DataFrame:
        """(node, bit, text) of the rows that are to be looked at; bit is -1 if all of them are wanted."""
        if self.words is None:
            return docs.join(self.nodes.select("node").distinct(), "node", "left_semi").select("node", F.lit(-1).cast("long").alias("bit"), "text")
        return docs.select("node", F.pmod(F.xxhash64("node"), F.lit(self.size)).cast("long").alias("bit"), "text")


def row_key(doc_id: str, text: str) -> tuple[Column, Column]:
    """128 bits that name a row, by its id and text."""
    parts = F.col(doc_id).cast("long"), F.coalesce(F.col(text), F.lit(""))
    return F.xxhash64(*parts), F.xxhash64(F.lit(0x5DEECE66D), *parts[::-1])


class Join:
    """One self-join; the methods are its steps in order."""

    def __init__(self, docs: DataFrame, k: int = 3, threshold: Threshold | None = None):
        self.k, self.limit = k, threshold or Threshold()
        self.spark = docs.sparkSession
        # a row's key: a hash of id and text; equal rows share it
        node, twin = row_key("doc_id", "text")
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("node", node).withColumn("twin", twin)

    def prefixes(self) -> DataFrame:
        """Per row: doc_id, node and twin (its key), n, digest of the set, its prefix in order of length, its sketch."""
        k, limit = self.k, self.limit

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, b, texts in parts(batch.column("text")):
                    sets = shingle_sets(texts, k)
                    n = np.array([len(s) for s in sets], np.int64)
                    digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                    cut = [s[: limit.prefix(len(s))] if len(s) else s for s in sets]
                    key = [batch.column(c).slice(a, b - a) for c in ("doc_id", "node", "twin")]
                    yield pa.RecordBatch.from_arrays([*key, pa.array(n), pa.array(digest, pa.binary()), _lists(cut), sketches(sets)], ["doc_id", "node", "twin", "n", "digest", "prefix", "sketch"])

        return self.docs.transform(mapped, step, "doc_id long, node long, twin long, n long, digest binary, prefix array<long>, sketch array<long>")

    def sets_of(self, wanted: Wanted, then: Callable | None = None, schema: str = "node long, grams binary") -> DataFrame:
        """(node, set as bytes) of the wanted rows, and maybe some more; a bitmap's other rows never leave their task.

        With `then`, what it makes of an iterator of (nodes, sets), a megabyte of text at a time, in the same worker.
        """
        k = self.k
        shared = self.spark.sparkContext.broadcast(wanted.words)

        def chosen_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
            words = shared.value
            for batch in batches:
                for a, b in spans(batch.column("text")):
                    piece = batch.slice(a, b - a)
                    if words is not None:
                        bit = np.asarray(piece.column("bit")).astype(np.uint64)
                        here = words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)
                        piece = piece.filter(pa.array(here.astype(bool)))
                    if len(piece):
                        yield piece.column("node"), shingle_sets(Texts(piece.column("text")), k)

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if then is not None:
                yield from then(chosen_sets(batches))
                return
            for node, sets in chosen_sets(batches):
                yield pa.RecordBatch.from_arrays([node, pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "grams"])

        return wanted.of(self.docs).transform(mapped, step, schema)

    def frequent(self, classes: DataFrame) -> tuple[DataFrame, Wanted | None, np.ndarray, np.ndarray]:
        """Classes marked if their prefix has a frequent n-gram, those by node, and the frequent n-grams in ascending order with their counts."""
        spark = self.spark
        top = lambda df: df.where(f"c > {_FREQUENT}").orderBy(F.desc("c"), "key").limit(_MOST_FREQUENT)
        keys = classes.select(F.explode("prefix").alias("key"))
        first = top(keys.groupBy("key").agg(F.count(F.lit(1)).alias("c"))).toArrow()
        heavy = dict(zip(first.column("key").to_pylist(), first.column("c").to_pylist()))
        shared = spark.sparkContext.broadcast(np.sort(np.array(list(heavy), np.int64)))

        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = batch.column("prefix")
                flat = np.asarray(lists.flatten())
                ends = np.cumsum(np.concatenate([[0], np.asarray(lists.value_lengths())]))
                hit = np.concatenate([[0], np.cumsum(np.isin(flat, shared.value))])
                hot = hit[ends[1:]] > hit[ends[:-1]]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hot)], [*batch.schema.names, "hot"])

        marked = stored(classes.select("node", "n", "prefix").transform(mapped, mark, "node long, n long, prefix array<long>, hot boolean"), "classes")
        if not heavy:
            return marked, None, np.zeros(0, np.uint64), np.zeros(0, np.int64)
        hot = Wanted(marked.where("hot").select("node"))

        def count(found: Iterator[tuple[pa.Array, list[np.ndarray]]]) -> Iterator[pa.RecordBatch]:
            """Counts within the task; what it met once won't be frequent for its sake."""
            held, size = [], 0

            def flush() -> pa.RecordBatch:
                key, c = np.unique(np.concatenate(held), return_counts=True)
                key, c = key[c > 1], c[c > 1]
                return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(c)], ["key", "c"])

            for _, sets in found:
                held += sets
                size += sum(map(len, sets))
                if size > 1_000_000:
                    yield flush()
                    held, size = [], 0
            if held:
                yield flush()

        again = self.sets_of(hot, count, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))
        more = top(again)
        # a set without frequent n-grams in its prefix keeps that prefix, so none of its n-grams may become frequent now
        spared = marked.where("not hot").select(F.explode("prefix").alias("key"))
        second = stored(more, "frequent")
        taken = {r.key for r in spared.join(F.broadcast(second.select("key")), "key", "left_semi").distinct().collect()}  # at most _MOST_FREQUENT
        for r in second.collect():
            if r.key not in taken or r.key in heavy:
                heavy[r.key] = max(r.c, heavy.get(r.key, 0))
        discard(second)
        key = np.array(list(heavy), np.int64).view(np.uint64)
        order = np.argsort(key)
        return marked, hot, key[order], np.array(list(heavy.values()), np.int64)[order]

    def entries(self, marked: DataFrame, hot: Wanted | None, key: np.ndarray, c: np.ndarray) -> DataFrame:
        """(key, node, n, pos): the prefixes in the global order; pos is the n-gram's place in its set."""
        fixed = marked.where("not hot").select(F.posexplode("prefix").alias("pos", "key"), "node", "n").select("key", "node", "n", F.col("pos").cast("long").alias("pos"))
        if hot is None:
            return fixed
        limit = self.limit
        shared = self.spark.sparkContext.broadcast((key, c))

        def step(found: Iterator[tuple[pa.Array, list[np.ndarray]]]) -> Iterator[pa.RecordBatch]:
            key, c = shared.value
            seen: set[int] = set()
            for nodes, sets in found:
                out = []
                for node, s in zip(nodes.to_pylist(), sets):
                    if node in seen or not len(s):
                        continue
                    seen.add(node)
                    at = np.minimum(np.searchsorted(key, s), len(key) - 1)
                    late = np.where(key[at] == s, c[at], 0)
                    s = s[np.lexsort((s, late))][: limit.prefix(len(s))] if late.any() else s[: limit.prefix(len(s))]
                    out.append((node, len(at), s))
                if out:
                    size = [len(s) for _, _, s in out]
                    columns = [np.concatenate([s for _, _, s in out]).view(np.int64), np.repeat([x for x, _, _ in out], size), np.repeat([x for _, x, _ in out], size), np.concatenate([np.arange(x) for x in size])]
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["key", "node", "n", "pos"])

        return fixed.unionByName(self.sets_of(hot, step, "key long, node long, n long, pos long"))

    def band(self, entries: DataFrame) -> DataFrame:
        """Rows of kind 0: pairs (a, b) within the band of some columns, with sizes n and m, in how many columns (c) and
        the most that either set has left from there on (pos). Of kind 1: entries (key, a, n, pos) of columns longer
        than the band."""
        limit = self.limit
        names = ["kind", "a", "b", "key", "n", "m", "pos", "c"]

        def pairs(key: np.ndarray, node: np.ndarray, n: np.ndarray, pos: np.ndarray, old: int) -> list[np.ndarray]:
            found = []
            rest = n - pos
            for d in range(1, _BAND + 1):
                same = np.flatnonzero(key[d:] == key[:-d]) if len(key) > d else np.zeros(0, np.int64)
                if not len(same):
                    break
                same = same[same + d >= old]  # earlier ones were told with the batch before
                i, j = same, same + d
                ok = (limit.den * n[i] >= limit.num * n[j]) & (node[i] != node[j])
                i, j = i[ok], j[ok]
                turn = node[i] > node[j]
                i, j = np.where(turn, j, i), np.where(turn, i, j)
                found.append(np.stack([node[i], node[j], n[i], n[j], np.minimum(rest[i], rest[j])]))
            if not found or not sum(f.shape[1] for f in found):
                return []
            x = np.concatenate(found, 1)
            x = x[:, np.lexsort((x[1], x[0]))]
            first = np.flatnonzero(np.concatenate([[True], (x[0, 1:] != x[0, :-1]) | (x[1, 1:] != x[1, :-1])]))
            return [*x[:4, first], np.maximum.reduceat(x[4], first), np.diff(np.append(first, x.shape[1]))]

        def rows(columns: dict[str, np.ndarray], kind: int) -> pa.RecordBatch:
            size = len(next(iter(columns.values())))
            columns = {"kind": np.full(size, kind)} | columns
            return pa.RecordBatch.from_arrays([pa.array(columns.get(k, np.zeros(size, np.int64)), pa.int64()) for k in names], names)

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tail: list[np.ndarray] | None = None  # the last rows of the batch before, up to a band's length
            met = 0  # rows of the tail's first key before it
            for batch in batches:
                new = [np.asarray(batch.column(c)) for c in ("key", "node", "n", "pos")]
                if not len(new[0]):
                    continue
                old = len(tail[0]) if tail else 0
                key, node, n, pos = (np.concatenate([a, b]) for a, b in zip(tail, new)) if tail else new
                first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                last = np.append(first[1:], len(key))
                rank = np.arange(len(key)) - np.repeat(first, last - first) + np.where(np.arange(len(key)) < last[0], met, 0)
                p = pairs(key, node, n, pos, old)
                if p:
                    yield rows(dict(zip(("a", "b", "n", "m", "pos", "c"), p)), 0)
                # a column's rows are told when its 17th comes; rows after that one by one
                turn = np.flatnonzero((rank == _BAND) & (np.arange(len(key)) >= old))
                extra = np.concatenate([np.flatnonzero((rank > _BAND) & (np.arange(len(key)) >= old)), turn, *[t - np.arange(1, _BAND + 1) for t in turn]]).astype(np.int64)
                if len(extra):
                    yield rows({"a": node[extra], "key": key[extra], "n": n[extra], "pos": pos[extra]}, 1)
                keep = slice(max(0, len(key) - _BAND), None)
                tail = [x[keep].copy() for x in (key, node, n, pos)]
                met = int(rank[keep][0])

        return entries.repartition("key").sortWithinPartitions("key", "n", "node").transform(mapped, step, ", ".join(f"{k} long" for k in names))

    def apart(self, x: str, y: str):
        """How many n-grams two sets differ in, at least, by their sketches."""
        return F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, k: s + k)

    def possible(self, banded: DataFrame, classes: DataFrame) -> DataFrame:
        """The pairs of the band that may reach the threshold.

        Common n-grams are either in both prefixes or, for the set whose prefix ends first, beyond it; so the overlap
        is at most those in both prefixes plus the longer rest. Long columns, which the band saw in part, count in
        full for the set that has fewer of them. Where it has none, the place of the first common n-gram bounds too.
        Last, sketches bound the difference from below.
        """
        num, den = self.limit.num, self.limit.den
        pairs = banded.where("kind = 0").groupBy("a", "b").agg(F.max("n").alias("n"), F.max("m").alias("m"), F.sum("c").alias("c"), F.max("pos").alias("rest"))
        longer = banded.where("kind = 1").groupBy("a").count()
        with_long = pairs.join(longer.select("a", F.col("count").alias("la")), "a", "left").join(longer.select(F.col("a").alias("b"), F.col("count").alias("lb")), "b", "left")
        least = f"({num} * (n + m) + {num + den - 1}) div {num + den}"
        beyond = f"(({num} * greatest(n, m) + {den - 1}) div {den} - 1)"
        unseen = "least(coalesce(la, 0), coalesce(lb, 0))"
        left = with_long.where(f"c + {unseen} + {beyond} >= {least} and ({unseen} > 0 or rest >= {least})").select("a", "b", "n", "m", F.expr(f"n + m - 2 * ({least})").alias("most"))
        drawn = classes.select(F.col("node").alias("a"), F.col("sketch").alias("sa")), classes.select(F.col("node").alias("b"), F.col("sketch").alias("sb"))
        return left.join(drawn[0], "a").join(drawn[1], "b").where(self.apart("sa", "sb") <= F.col("most")).select("a", "b", "n", "m")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Links (a, b) among distinct pairs (a, b, n, m): cells of bounded size multiply the rows of their nodes.

        Pairs are grouped by a common neighbour. A group is cut into ways times ways cells, so that none has more than
        about _CELL_PAIRS pairs, nor sets of more than about _CELL_BYTES, but for a single pair of larger ones.
        """
        ends = lambda df, *more: df.select(F.col("a").alias("node"), *more).union(df.select(F.col("b").alias("node"), *more))
        least = ends(pairs, F.col("a").alias("lab")).groupBy("node").agg(F.min("lab").alias("lab"))
        near = stored(pairs.join(least.withColumnRenamed("node", "a"), "a"), "near")
        sized = near.select("lab", F.col("a").alias("node"), "n").union(near.select("lab", F.col("b").alias("node"), F.col("m").alias("n"))).distinct()
        size = near.groupBy("lab").count().join(sized.groupBy("lab").agg(F.sum("n").alias("grams")), "lab")
        ways = F.ceil(F.greatest(F.sqrt(F.col("count") / _CELL_PAIRS), F.col("grams") * (16 / _CELL_BYTES))).cast("int")
        way = lambda c: F.pmod(F.xxhash64(c), F.col("ways"))
        dealt = stored(near.join(size.select("lab", ways.alias("ways")), "lab").select("a", "b", F.xxhash64("lab", way("a"), way("b")).alias("cell")), "cells")
        discard(near)
        wanted = ends(dealt, "cell").distinct()
        rows = self.sets_of(Wanted(ends(dealt).distinct()))
        sent = wanted.join(rows, "node").select(F.col("cell").alias("place"), "node", "grams")
        limit = self.limit

        def multiply(left: pa.Table, right: pa.Table) -> pa.Table:
            lean()
            sets = {node: np.frombuffer(raw.as_buffer(), np.uint64) for node, raw in zip(right.column("node").to_pylist(), right.column("grams"))}
            kept = []
            for a, b in zip(left.column("a").to_pylist(), left.column("b").to_pylist()):
                x, y = sets[a], sets[b]
                if limit.linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)):
                    kept.append((a, b))
            return pa.table([pa.array([k[i] for k in kept], pa.int64()) for i in range(2)], ["a", "b"])

        links = stored(dealt.groupBy("cell").cogroup(sent.groupBy("place")).applyInArrow(multiply, "a long, b long"), "links")
        discard(dealt)
        return links

    def across(self, hot: DataFrame, roots: DataFrame, classes: DataFrame) -> DataFrame:
        """Pairs (a, b, n, m) of long columns across components, within the bounds of sizes, places and sketches.

        A column's largest component meets only the column's other classes, not itself; sizes meet within bands; and
        a band of more than _SALT_ROWS rows is dealt out to as many tasks as it takes.
        """
        num, den = self.limit.num, self.limit.den
        named = hot.join(roots.select(F.col("node").alias("a"), "root"), "a", "left").select("key", F.col("a").alias("x"), "n", F.expr("n - pos").alias("rest"), F.coalesce("root", "a").alias("r"))
        main = named.groupBy("key", "r").count().groupBy("key").agg(F.max_by("r", F.struct("count", "r")).alias("main"), F.count(F.lit(1)).alias("components")).where("components > 1")
        drawn = named.join(main.select("key", "main"), "key").join(classes.select(F.col("node").alias("x"), "sketch"), "x")
        # sizes within the threshold are in the same band of sizes or a neighbouring one
        level = F.floor(F.log(F.col("n").cast("double")) / F.lit(-float(np.log(num / den)) if num < den else 1.0) + F.lit(1e-9))
        drawn = stored(drawn.withColumn("size_band", level), "columns")
        salts = drawn.groupBy("key", "size_band").agg(F.ceil(F.count(F.lit(1)) / _SALT_ROWS).cast("int").alias("salts"))
        right = drawn.join(salts, ["key", "size_band"]).select("key", "size_band", F.pmod(F.xxhash64("x"), F.col("salts")).cast("int").alias("salt"), F.col("x").alias("y"), F.col("n").alias("m"), F.col("rest").alias("rest2"), F.col("r").alias("r2"), F.col("sketch").alias("sketch2"))
        left = drawn.where("r <> main").withColumn("size_band", F.explode(F.array(*(F.col("size_band") + d for d in (-1, 0, 1)))))
        left = left.join(salts, ["key", "size_band"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        bound = f"r <> r2 and {den} * least(n, m) >= {num} * greatest(n, m) and least(rest, rest2) * {num + den} >= {num} * (n + m)"
        most = F.expr(f"n + m - 2 * (({num} * (n + m) + {num + den - 1}) div {num + den})")
        size = lambda first: F.when(F.col("x") < F.col("y"), F.col("n" if first else "m")).otherwise(F.col("m" if first else "n"))
        met = left.join(right, ["key", "size_band", "salt"]).where(bound).where(self.apart("sketch", "sketch2") <= most)
        found = stored(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), size(True).alias("n"), size(False).alias("m")).distinct(), "far")
        discard(drawn)
        return found

    def grouped(self) -> tuple[DataFrame, DataFrame]:
        """Rows (doc_id, node, twin, n, digest, ...), and classes (digest, rep, keep, root): the least doc_id, the key of
        its row, and the root of the component."""
        rows = stored(self.prefixes(), "prefixes")
        first = F.struct(F.col("doc_id").isNull(), "doc_id", "node", "twin")
        sets = rows.where("n > 0").groupBy("digest").agg(F.min("node").alias("node"), F.min("doc_id").alias("rep"), F.min_by(F.struct("node", "twin"), first).alias("keep"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("sketch").alias("sketch"))
        classes = stored(sets, "sets")
        marked, hot, key, c = self.frequent(classes)
        banded = stored(self.band(self.entries(marked, hot, key, c)), "band")
        discard(marked)
        near = stored(self.possible(banded, classes), "pairs")
        links = self.verified(near)
        roots = components(links)
        long = banded.where("kind = 1").select("key", "a", "n", "pos")
        met = self.across(long, roots, classes)
        far = stored(met.join(near, ["a", "b"], "left_anti").select("a", "b", "n", "m"), "pairs")
        discard(banded, near, met)
        if not far.isEmpty():
            more = self.verified(far)
            roots = components(links.union(more))
            discard(more)
        discard(links, far)
        return rows, classes.select("digest", "node", "rep", "keep").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).drop("node")

    def run(self) -> DataFrame:
        rows, found = self.grouped()
        ids = found.groupBy("root").agg(F.min("rep").alias("component_id"))
        named = found.join(ids, "root").select("digest", "component_id")
        out = rows.select("doc_id", "n", "digest").join(named, "digest", "left")
        return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))

    def keepers(self) -> DataFrame:
        """The key (node, twin) of one row of each component, that with the least doc_id, and of every row with an empty set."""
        rows, found = self.grouped()
        one = found.groupBy("root").agg(F.min_by("keep", F.struct(F.col("rep").isNull(), "rep", "digest")).alias("keep")).select("keep.node", "keep.twin")
        return one.union(rows.where("n = 0").select("node", "twin")).distinct()


def one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs, with all their columns, that stand for their component: the one with the least doc_id.

    Of repeated rows one stays. A row without doc_id stands for its component only if no other has one.
    """
    keep = Join(docs, k, Threshold(num, den)).keepers().select(F.col("node").alias("__node"), F.col("twin").alias("__twin"))
    node, twin = row_key("doc_id", "text")
    keyed = docs.withColumn("__node", node).withColumn("__twin", twin)
    return keyed.join(keep, ["__node", "__twin"], "left_semi").dropDuplicates(["__node", "__twin"]).select(*docs.columns)


def jaccard_components(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs (doc_id, text).

    Two documents are linked if den * intersection >= num * union of their sets of k-word n-grams; component_id is
    the smallest doc_id reachable by links. A null or empty text, or one without words, has an empty set and is its
    own component. Rows with a null doc_id link like others but lend no id: theirs is null if the component has no
    other. Repeated rows are kept; other columns are ignored. N-grams are compared by 64-bit numbers.
    """
    return Join(docs, k, Threshold(num, den)).run()
