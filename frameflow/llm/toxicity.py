"""Toxicity by a classifier chain: linear models in a fixed order, each fed the probabilities of those before it.

Features are the words of a text and their beginnings, present or not. A category's model is a logistic regression
over the features that tell it best. For training, the probabilities of earlier categories are out-of-fold: each
document's come from models that have not seen it, so later models learn how far to trust them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameflow.llm.bytelex import LETTER, WHOLE, Texts, hashes, of_text, parts, pretokens
from frameflow.llm.common import mapped

_BEGINNINGS = (4, 5, 6, 8)


def features(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of words and of their first bytes, and the text of each."""
    begin, end, kind, low = pretokens(texts)
    keep = (kind == LETTER) | (kind == WHOLE)
    begin, end = begin[keep], end[keep]
    owner = np.searchsorted(texts.begin, begin, "right") - 1
    found, own = [hashes(low, begin, end, 2)], [owner]
    for k, size in enumerate(_BEGINNINGS):
        long = end - begin > size
        found.append(hashes(low, begin[long], begin[long] + size, 2) ^ np.uint64(k + 1))
        own.append(owner[long])
    return (np.concatenate(found) >> np.uint64(32)).astype(np.uint32), np.concatenate(own)


class Linear:
    """Logistic regression over chosen hashed features and a few dense inputs."""

    def __init__(self, keys: np.ndarray, weight: np.ndarray, dense: np.ndarray, bias: float):
        self.keys, self.weight, self.dense, self.bias = keys, weight, dense, bias

    @classmethod
    def train(cls, keys: np.ndarray, number: np.ndarray, own: np.ndarray, extra: np.ndarray, y: np.ndarray, most_features: int = 1000, least_gain: float = 40.0, steps: int = 300, ridge: float = 1.0) -> "Linear":
        """keys: feature hashes in ascending order; number, own: which of them which row has, each pair once; extra: rows
        by earlier probabilities; y: 0 or 1.

        Features are those whose log-likelihood ratio against independence is at least `least_gain`, which chance
        gives to fewer than one in a billion, at most `most_features` of them.
        """
        n = len(y)
        on = np.bincount(number, y[own], minlength=len(keys))
        off = np.bincount(number, minlength=len(keys)) - on
        p, q = max(1.0, y.sum()), max(1.0, n - y.sum())
        both = on + off
        gain = np.zeros(len(keys))
        for seen, of in ((on, p), (off, q), (p - on, p), (q - off, q)):
            rate = both / n if seen is on or seen is off else 1 - both / n
            gain += 2 * np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(of * rate, 1e-9)), 0.0)
        best = np.sort(np.argsort(-gain, kind="stable")[: min(most_features, int((gain >= least_gain).sum()))])
        place = np.full(len(keys), -1)
        place[best] = np.arange(len(best))
        col = place[number]
        col, own = col[col >= 0], own[col >= 0]
        balance = np.where(y > 0, n / (2 * p), n / (2 * q))
        w, d, b = np.zeros(len(best)), np.zeros(extra.shape[1]), 0.0
        gw, gd, gb = np.full(len(w), 1e-8), np.full(len(d), 1e-8), 1e-8
        for _ in range(steps):  # full-batch steps, scaled by past gradients
            z = np.bincount(own, w[col], minlength=n) + extra @ d + b
            r = balance * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
            dw, dd, db = np.bincount(col, r[own], minlength=len(w)) + ridge * w / n, extra.T @ r, r.sum()
            gw, gd, gb = gw + dw * dw, gd + dd * dd, gb + db * db
            w, d, b = w - 0.3 * dw / np.sqrt(gw), d - 0.3 * dd / np.sqrt(gd), b - 0.3 * db / np.sqrt(gb)
        return cls(keys[best], w, d, float(b))

    def predict(self, h: np.ndarray, own: np.ndarray, extra: np.ndarray) -> np.ndarray:
        n = len(extra)
        z = extra @ self.dense + self.bias
        if len(self.keys) and len(h):
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            hit = self.keys[at] == h
            pairs = np.unique(at[hit].astype(np.int64) * n + own[hit])
            z = z + np.bincount(pairs % n, self.weight[pairs // n], minlength=n)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Chain:
    """A fitted chain: categories, their models and the probabilities from which they hold."""

    def __init__(self, categories: tuple[str, ...], models: list[Linear | float], limits: list[float]):
        self.categories, self.models, self.limits = categories, models, limits

    @classmethod
    def train(cls, categories: tuple[str, ...], h: np.ndarray, own: np.ndarray, labels: np.ndarray, folds: int = 3) -> "Chain":
        """h, own: feature hashes and the rows that have them; labels: rows by categories.

        A category with one class only has no model; its probability is 0 or 1 throughout, and 0 without rows. Fewer
        rows than folds teach no model either: the share of positives is the probability.
        """
        n = len(labels)
        keys, number = np.unique(h, return_inverse=True)
        pairs = np.sort(number.astype(np.int64) * max(n, 1) + own)
        pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])] if len(pairs) else pairs
        number, own = (pairs // max(n, 1)).astype(np.int32), (pairs % max(n, 1)).astype(np.int32)
        del pairs
        fold = np.arange(n) % folds

        def part(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """The pairs of these rows, which are numbered anew."""
            back = np.full(n, -1, np.int32)
            back[rows] = np.arange(len(rows))
            here = back[own]
            return number[here >= 0], here[here >= 0]

        extra, models, limits = np.zeros((n, 0)), [], []
        for k in range(len(categories)):
            y = labels[:, k].astype(float)
            if n < folds or y.min() == y.max():
                models.append(float(y.mean()) if n else 0.0)
                limits.append(0.5)
                extra = np.concatenate([extra, np.full((n, 1), models[-1])], 1)
                continue
            out = np.zeros(n)
            for f in range(folds):
                seen, rest = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
                m = Linear.train(keys, *part(seen), extra[seen], y[seen])
                theirs, row = part(rest)
                out[rest] = m.predict(keys[theirs], row, extra[rest])
            order = np.argsort(-out, kind="stable")
            hits = np.cumsum(y[order])
            f1 = 2 * hits / (np.arange(1, n + 1) + y.sum())
            at = int(np.argmax(f1))
            limits.append(float((out[order[at]] + (out[order[at + 1]] if at + 1 < n else 0.0)) / 2))
            models.append(Linear.train(keys, number, own, extra, y))
            extra = np.concatenate([extra, out[:, None]], 1)
        return cls(categories, models, limits)

    def predict(self, h: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
        extra = np.zeros((n, 0))
        for m in self.models:
            p = m.predict(h, own, extra) if isinstance(m, Linear) else np.full(n, m)
            extra = np.concatenate([extra, p[:, None]], 1)
        return extra


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], most_per_class: int = 3000, most_bytes: int = 1 << 16) -> Chain:
    """A chain from a bounded sample: the labelled documents with the least hashes of doc_id, `most_per_class` of each
    class of the last category at most, whose texts have at most `most_bytes` bytes.

    categories: in the order of the chain, 0/1 columns of labels; rows with a null in one are unlabelled. Of several
    labels of a document the greatest counts, category by category; of several rows with its id, the least text.
    """
    names = tuple(categories)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *(c.cast("int").alias(k) for k, c in categories.items())).dropna().groupBy("doc_id").agg(*(F.max(k).alias(k) for k in names))
    some = None
    for y in (0, 1):
        part = known.where(F.col(names[-1]) == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_per_class)
        some = part if some is None else some.union(part)
    spark = docs.sparkSession
    chosen = spark.createDataFrame([tuple(r) for r in some.collect()], known.schema)  # at most twice most_per_class rows

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in parts(batch.column("text")):
                h, own = features(texts)
                order = np.argsort(own, kind="stable")
                h, own = h[order], own[order]
                bounds = np.searchsorted(own, np.arange(b - a + 1))
                lists = [np.unique(h[x:y]).tobytes() for x, y in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in ("doc_id", *names)), pa.array(lists, pa.binary())], ["doc_id", *names, "h"])

    short = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).where(F.coalesce(F.octet_length("text"), F.lit(0)) <= most_bytes)
    texts = short.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", *names).agg(F.min("text").alias("text"))
    found = texts.transform(mapped, step, ", ".join(["doc_id long", *(f"{k} int" for k in names), "h binary"])).toArrow()
    found = found.sort_by("doc_id").combine_chunks()
    y = np.stack([found.column(k).to_numpy() for k in names], 1).astype(np.int64) if len(found) else np.zeros((0, len(names)), np.int64)
    lists = found.column("h").to_pylist()
    del found
    h = np.frombuffer(b"".join(lists), np.uint32)
    own = np.repeat(np.arange(len(lists), dtype=np.int32), [len(x) // 4 for x in lists])
    return Chain.train(names, h, own, y)


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id, then p_<category> and is_<category> for each category, for every row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    names = [f"p_{k}" for k in chain.categories] + [f"is_{k}" for k in chain.categories]
    schema = ", ".join(["doc_id long", *(f"p_{k} double" for k in chain.categories), *(f"is_{k} boolean" for k in chain.categories)])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_chain = shared.value
        for batch in batches:
            for a, b, texts in parts(batch.column("text")):
                h, own = features(texts)
                p = own_chain.predict(h, own, b - a)
                columns = [pa.array(p[:, k]) for k in range(p.shape[1])] + [pa.array(p[:, k] >= own_chain.limits[k]) for k in range(p.shape[1])]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *columns], ["doc_id", *names])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").transform(mapped, step, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Trains on labels (doc_id, quality, toxic) and scores every row of docs.

    The chain is low quality, then toxic. A null or empty text is scored by the models' constants. Without labels all
    probabilities are 0. Null ids and repeated rows are kept; other columns are ignored.
    """
    return score(docs, fit(docs, labels, {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")}))
