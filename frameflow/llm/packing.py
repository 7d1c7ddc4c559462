"""Packing of tokenised documents into fixed windows by order-preserving dynamic programming.

Documents keep the order of their table partition. Cuts between windows may fall at document ends (free), at
sentence ends (a small penalty) or, so that no stretch is without a cut, inside a sentence (a larger one). The
least total of padding plus penalties over all ways to cut at these places is found exactly: with f(j) the least cost
of a prefix that ends at candidate j, f(j) = min over i within one window of f(i) + pos(i), plus window - pos(j) +
penalty(j), so the inner minimum slides monotonically and a monotone queue makes each step O(1) amortised. Windows
whose length is a power of two aren't padded; the few candidates at such distances are tried one by one.

A partition is packed on its own, block by block, with bounded memory and no shuffle; the last window of a block is
opened again and packed with the next block. A recomputed partition gives the same windows, so a lost executor costs
only its own partitions.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from frameflow.llm.bytelex import Texts, of_text, parts
from frameflow.llm.common import mapped
from frameflow.llm.wordcodec import WordCodec, default_path, per_range

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padding long"
_MARKS = np.zeros(256, bool)
_MARKS[[0x2E, 0x21, 0x3F]] = True
_BLANKS = np.zeros(256, bool)
_BLANKS[[0x20, *range(0x09, 0x0E)]] = True


def sentence_ends(texts: Texts) -> np.ndarray:
    """Positions of `.`, `!` or `?` before white space."""
    d = texts.data
    return np.flatnonzero(_MARKS[d[:-1]] & _BLANKS[d[1:]])


def exempt(position: np.ndarray, window: int) -> tuple[list[int], list[int]]:
    """(j, i) of candidates whose distance is a power of two below the window, in order of j."""
    js, ks = [], []
    size = 1
    while size < window:
        at = np.minimum(np.searchsorted(position, position + size), len(position) - 1)
        hit = np.flatnonzero(position[at] == position + size)
        js.append(at[hit])
        ks.append(hit)
        size *= 2
    j, i = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (js, ks))
    order = np.argsort(j, kind="stable")
    return j[order].tolist(), i[order].tolist()


def best_cuts(position: np.ndarray, penalty: np.ndarray, window: int) -> np.ndarray:
    """Indices of the chosen cuts among candidate positions (first 0, last the total; gaps at most window)."""
    pos, pen = position.tolist(), penalty.tolist()
    js, ks = exempt(position, window)
    js.append(-1)
    value, total, came = [0.0] * len(pos), [0.0] * len(pos), [0] * len(pos)
    queue: deque[int] = deque()
    cost, at = 0.0, 0
    for j in range(1, len(pos)):
        i, here = j - 1, pos[j]
        v = value[i] = cost + pos[i]
        while queue and value[queue[-1]] >= v:
            queue.pop()
        queue.append(i)
        least = here - window
        while pos[queue[0]] < least:
            queue.popleft()
        best = queue[0]
        cost = value[best] + window - here
        while js[at] == j:  # a sequence whose length is a power of two isn't padded
            if total[ks[at]] < cost:
                best, cost = ks[at], total[ks[at]]
            at += 1
        came[j] = best
        cost += pen[j]
        total[j] = cost
    out, j = [], len(pos) - 1
    while j:
        out.append(j)
        j = came[j]
    return np.array([0, *out[::-1]], np.int64)


def candidates(doc_ends: np.ndarray, sentences: np.ndarray, window: int, sentence_penalty: float, inner_penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a window may end and the penalty of each; inner ones fill gaps over a 64th of a window."""
    total, step = int(doc_ends[-1]), max(1, window // 64)
    sentences = sentences[(sentences > 0) & (sentences < total)]
    marks = np.unique(np.concatenate([[0], doc_ends, sentences]))
    gap = np.diff(marks)
    wide = np.flatnonzero(gap > step)
    inner = [np.arange(marks[k] + step, marks[k + 1], step) for k in wide.tolist()]
    position = np.unique(np.concatenate([marks, *inner]))
    penalty = np.full(len(position), float(inner_penalty))
    penalty[np.searchsorted(position, sentences)] = sentence_penalty
    penalty[np.searchsorted(position, doc_ends)] = 0
    return position, penalty


def pack_block(sizes: np.ndarray, sentences: np.ndarray, window: int, sentence_penalty: float = 4, inner_penalty: float = 64) -> dict[str, np.ndarray]:
    """Pieces of documents with these token counts (all over 0) laid end to end."""
    ends = np.cumsum(sizes)
    position, penalty = candidates(ends, sentences, window, sentence_penalty, inner_penalty)
    cuts = position[best_cuts(position, penalty, window)]
    first = ends - sizes
    begin = np.unique(np.concatenate([first, cuts[:-1]]))
    end = np.append(begin[1:], ends[-1])
    doc, seq = np.searchsorted(first, begin, "right") - 1, np.searchsorted(cuts, begin, "right") - 1
    length = np.diff(cuts)
    padding = np.where(length & (length - 1) == 0, 0, window - length)
    return {"cuts": cuts, "begin": begin, "end": end, "doc": doc, "start": begin - first[doc], "sequence": seq, "offset": begin - cuts[seq], "padding": padding[seq], "sequences": np.int64(len(length))}


def pack(docs: DataFrame, window: int = 4096, end_id: int = 2, block_tokens: int = 1 << 20, tokenizer: str | None = None, sentence_penalty: float = 4, inner_penalty: float = 64) -> DataFrame:
    """Pieces of all documents in sequences of at most `window` tokens.

    docs needs doc_id and text; other columns are ignored. A null or empty text is the end id alone; a null doc_id
    and repeated rows are packed like any other row; an empty table gives no rows. `padding` is that of the piece's
    sequence, by the rule that a sequence is padded to the window unless its length is a power of two. sequence_id
    is unique over the table: the partition's number, then the sequence's within it. Penalties are in tokens of padding.
    """
    path = tokenizer or default_path()

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        codec = WordCodec.of(path)
        base = TaskContext.get().partitionId() << 32
        held: list[tuple] = []  # names, ids, sizes, sentence ends, and of each document the ids before these and in all
        size = 0

        def flush(last: bool) -> pa.RecordBatch:
            nonlocal held, size, base
            at = np.cumsum([0] + [len(h[1]) for h in held])
            names, stops = pa.concat_arrays([h[0] for h in held]), np.concatenate([h[3] + a for h, a in zip(held, at)])
            ids, sizes, before, whole = (np.concatenate([h[k] for h in held]) for k in (1, 2, 4, 5))
            p = pack_block(sizes, stops, window, sentence_penalty, inner_penalty)
            told, count = len(p["begin"]), int(p["sequences"])
            held, size = [], 0
            if not last and count > 1:
                cut = int(p["cuts"][-2])
                told, count = int(np.searchsorted(p["begin"], cut)), count - 1
                k = int(p["doc"][told])
                done = int(p["start"][told])
                rest = np.append(sizes[k] - done, sizes[k + 1 :])
                held = [(names.slice(k), ids[cut:], rest, stops[stops > cut] - cut, np.append(before[k] + done, before[k + 1 :]), whole[k:])]
                size = len(ids) - cut
            raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
            begin, end, doc = (p[k][:told] for k in ("begin", "end", "doc"))
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), end.tolist())]
            columns = [names.take(pa.array(doc)), p["start"][:told] + before[doc], end - begin, np.array(crc, np.int64), whole[doc], base + p["sequence"][:told], p["offset"][:told], p["padding"][:told]]
            base += count
            return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns], _names(SCHEMA))

        for batch in batches:
            for a, b, texts in parts(batch.column("text")):
                codes, begin, _ = codec.codes(texts)
                where, width = codec.tokens(codes)
                counts = per_range(width, of_text(texts, begin))
                own = np.cumsum(counts)
                ids = np.insert(codec.ids[where].astype(np.uint32), own, end_id)
                stops = sentence_ends(texts)
                before = np.concatenate([[0], np.cumsum(width)])[np.searchsorted(begin, stops, "right")]
                shift = np.searchsorted(texts.begin, stops, "right") - 1  # an end id for each text before
                held.append((batch.column("doc_id").slice(a, b - a), ids, counts + 1, before + shift, np.zeros(b - a, np.int64), counts + 1))
                size += len(ids)
                if size >= block_tokens:
                    yield flush(False)
        if held:
            yield flush(True)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").transform(mapped, step, SCHEMA)


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]
