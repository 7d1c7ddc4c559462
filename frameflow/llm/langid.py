"""Language identification by cross-parsing entropy.

For each language a suffix automaton of a bounded labelled sample accepts exactly the substrings of that sample. A
text is cut greedily into the longest phrases the automaton accepts; few, long phrases mean low cross-entropy. The
language with the fewest phrases per symbol wins, equal ones by name.

Symbols are lower-case letters and marks; a run of anything else is one separator. A symbol that the sample lacks is
a phrase by itself.

All blocks of a batch of texts advance together in one vectorised walk, each as if a phrase began with it. The parse
that comes over from the block before is then followed into the block until both begin a phrase at one place; from
there on they are one, so that the sums are those of a single parse of the whole text. Texts with a block in which
the two never meet (long periods) are parsed once more from end to end.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameflow.llm.common import mapped

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"
BLOCK = 512
#: Texts of fewer symbols say too little to be told from noise.
LEAST_SYMBOLS = 64
_WINDOWS = 6  # of a long text that is learnt
_START = np.int32(1 << 30)  # in a transition: a phrase begins with this symbol
_PLACE = np.int32((1 << 30) - 1)
_MODELS: dict[tuple, "CrossParser"] = {}
_KIND: list[np.ndarray] = []


def held_out(doc_id: str = "doc_id") -> Column:
    """True for documents that the model may not learn from; false for a null id, which isn't learnt from either."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def _kinds() -> np.ndarray:
    """By code point: 0 outside, 1 a mark, 2 a letter."""
    if not _KIND:
        of = {"L": 2, "M": 1}
        _KIND.append(np.fromiter((of.get(unicodedata.category(chr(i))[0], 0) for i in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1))
    return _KIND[0]


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings; state 0 is the start."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return nxt


@dataclass(frozen=True)
class Sample:
    """What is learnt of a language: a text, and the phrase rate that its texts keep under."""

    lang: str
    text: str
    most_rate: float = 1.0


class Automaton:
    """One language's automaton as a table: row (state) plus symbol gives the next row, with _START if a phrase begins.

    Own symbols are 0 for the separator, 1 for letters that the sample lacks, and from 2 on its letters.
    """

    def __init__(self, symbols: np.ndarray, alphabet: int):
        """symbols: of the model's alphabet, 0 the separator, 1 unknown, from 2 on letters; alphabet: how many."""
        mine = np.unique(symbols[symbols > 1])
        self.own = np.full(alphabet, 1, np.int32)
        self.own[0] = 0
        self.own[mine] = 2 + np.arange(len(mine))
        width = 2 + len(mine)
        trans = suffix_automaton(self.own[symbols].tolist())
        if len(trans) * width > int(_PLACE):
            raise ValueError("a language's sample is too large for one table")
        table = np.full((len(trans), width), -1, np.int32)
        for s, row in enumerate(trans):
            table[s, list(row)] = list(row.values())
        first = np.where(table[0] >= 0, table[0], 0) * width | _START  # a letter that the sample lacks ends where it begins
        self.table = np.where(table >= 0, table * width, first)
        self.table[0] = first
        self.table = self.table.reshape(-1)

    def parse(self, symbols: np.ndarray) -> int:
        """Phrases of one text (own symbols), step by step."""
        table, at, n = memoryview(self.table), 0, 0
        for c in symbols.tolist():
            got = table[at + c]
            n += got >> 30
            at = got & 0x3FFFFFFF
        return n

    def phrases(self, symbols: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Phrases of each text; symbols: of the model's alphabet, of all texts end to end."""
        flat = np.append(self.own[symbols], np.int32(0))
        blocks = -(-size // BLOCK)
        owner = np.repeat(np.arange(len(size)), blocks)
        run = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        length = np.minimum(BLOCK, size[owner] - run * BLOCK)
        order = np.argsort(-length, kind="stable")
        lane = np.empty(len(order), np.int64)
        lane[order] = np.arange(len(order))
        at, own, length, block = (begin[owner] + run * BLOCK)[order], owner[order], length[order], order
        if not len(order):
            return np.zeros(len(size), np.int64)
        live = np.searchsorted(-length, -np.arange(BLOCK), "left")  # lanes longer than t
        state = np.zeros(len(order), np.int32)
        starts = np.zeros((int(length[0]), len(order)), bool)
        for t in range(int(length[0])):
            k = int(live[t])
            got = self.table.take(state[:k] + flat.take(at[:k] + t))
            np.greater_equal(got, _START, out=starts[t, :k])
            np.bitwise_and(got, _PLACE, out=state[:k])
        count = starts.sum(0, dtype=np.int64)
        total = np.bincount(own, count, minlength=len(size)).astype(np.int64)
        # the parse that comes over from the block before, until it meets the block's own
        here = np.flatnonzero(np.append(owner[1:] == owner[:-1], False)[block])
        state, to = state[here], lane[block[here] + 1]
        more, less = np.zeros(len(here), np.int64), np.zeros(len(here), np.int64)
        gain = np.zeros(len(size), np.int64)
        for t in range(BLOCK):
            if not len(to):
                break
            over = length[to] <= t
            if over.any():  # the text ends first
                np.add.at(gain, own[to[over]], more[over] - less[over])
                state, to, more, less = (x[~over] for x in (state, to, more, less))
            got = self.table.take(state + flat.take(at[to] + t))
            new, old = got >= _START, starts[t, to] if t < len(starts) else np.zeros(len(to), bool)
            met = new & old
            if met.any():
                np.add.at(gain, own[to[met]], more[met] - less[met])
            state, to, more, less = (x[~met] for x in (got & _PLACE, to, more + new, less + old))
        total += gain
        for k in np.unique(own[to[length[to] == BLOCK]]).tolist():
            total[k] = self.parse(flat[begin[k] : begin[k] + size[k]])
        ends = to[length[to] < BLOCK]
        assert not len(ends), "a block's walk ends with the block"
        return total


class CrossParser:
    """The automata of all languages over one alphabet."""

    def __init__(self, samples: tuple[Sample, ...]):
        self.langs = [s.lang for s in samples]
        self.most_rate = np.array([s.most_rate for s in samples])
        self.index = np.minimum(_kinds(), 1).astype(np.int32)
        texts = [np.frombuffer(s.text.lower().encode("utf-32-le", "surrogatepass"), np.uint32) for s in samples]
        letters = np.unique(np.concatenate(texts)) if texts else np.zeros(0, np.uint32)
        letters = letters[self.index[letters] > 0]
        self.index[letters] = 2 + np.arange(len(letters))
        self.automata = [Automaton(self.symbols([s.text])[0], 2 + len(letters)) for s in samples]

    @classmethod
    def of(cls, samples: tuple[Sample, ...]) -> "CrossParser":
        if samples not in _MODELS:
            _MODELS.clear()
            _MODELS[samples] = cls(samples)
        return _MODELS[samples]

    def symbols(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The symbols of all texts end to end, each text's number of them, and whether it has a letter."""
        low = [t.lower() if t else "" for t in texts]
        chars = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.array([len(t) for t in low], np.int64)
        end = np.cumsum(size + 1) - 1  # of each text: the place of the line feed after it
        kind = _kinds()[chars]
        s = self.index[chars]
        keep = s != 0
        keep[1:] |= s[:-1] != 0
        if len(size):
            keep[0] = True
            keep[np.minimum(end[:-1] + 1, len(keep) - 1)] = True  # a text's first
            keep[end] = False
        letters = np.concatenate([[0], np.cumsum(kind == 2)])
        kept = np.concatenate([[0], np.cumsum(keep)])
        return s[keep], kept[end] - kept[end - size], letters[end] > letters[end - size]

    def phrases(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases by text and language, symbols by text, and whether the text has a letter."""
        flat, size, letters = self.symbols(texts)
        begin = np.cumsum(size) - size
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        for k, a in enumerate(self.automata):
            out[:, k] = a.phrases(flat, begin, size)
        return out, size, letters


def sample(docs: DataFrame, docs_per_lang: int = 64, chars_per_lang: int = 12_000, slack: float = 2.0) -> tuple[Sample, ...]:
    """The bounded labelled sample that the model learns from, in order of lang.

    Of each language `docs_per_lang` labelled rows that aren't held out: those with the least hash of doc_id among
    texts of at most `chars_per_lang` characters, then, where these are too few, longer ones, shortest first. Of a
    longer one six windows are taken, evenly spaced from its start to its end, of an eighth of `chars_per_lang`
    together, so that neither the driver nor the model ever holds a long text. What is taken is learnt in this
    order, as much as comes to `chars_per_lang` together, one text at least. Lines that rows of several
    languages have (licences, notices) teach nothing about a language and are left out; of those that several rows
    of one language have, the first copy counts.

    The rows that aren't learnt tell how a language's texts parse: its most_rate is `slack` times the highest phrase
    rate of the middle nine tenths of them, and 1 (no bound) if there are fewer than ten.
    """
    labelled = docs.selectExpr("cast(doc_id as long) doc_id", "cast(lang as string) lang", "text").where("lang is not null and doc_id is not null and text is not null").where(~held_out())
    n = F.length("text")
    least = Window.partitionBy("lang").orderBy(F.when(n <= chars_per_lang, F.lit(0)).otherwise(n), F.xxhash64("doc_id"), "doc_id", "text")
    chosen = labelled.withColumn("rank", F.row_number().over(least)).where(f"rank <= {int(docs_per_lang)}")
    size = max(1, chars_per_lang // (8 * _WINDOWS))
    begin = lambda i: (F.lit(1) + F.floor((n - size) * i / (_WINDOWS - 1))).cast("int")
    windows = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(_WINDOWS - 1)), lambda i: F.substring("text", begin(i), F.lit(size))), "\n")
    rows = chosen.select("lang", "rank", F.when(n <= chars_per_lang, F.col("text")).otherwise(windows).alias("text")).collect()  # at most docs_per_lang a language, of chars_per_lang each
    langs: dict[str, set[str]] = {}
    for r in rows:
        for line in r.text.split("\n"):
            langs.setdefault(line, set()).add(r.lang)
    taught: dict[str, list[str]] = {}
    rest: dict[str, list[str]] = {}
    had: set[str] = set()
    for r in sorted(rows, key=lambda r: (r.lang, r["rank"])):
        own = taught.setdefault(r.lang, [])
        lines = [line for line in r.text.split("\n") if len(langs[line]) < 2 and line not in had]
        text = " ".join(lines)
        if own and sum(map(len, own)) + len(text) > chars_per_lang:
            rest.setdefault(r.lang, []).append(text)
        elif text:
            had.update(lines)
            own.append(text)
    found = tuple(Sample(lang, " ".join(ts)) for lang, ts in sorted(taught.items()))
    model = CrossParser.of(found)
    out = []
    for k, s in enumerate(found):
        held = rest.get(s.lang, [])
        phrases, size, _ = model.phrases(held)
        rate = np.sort((phrases[:, k] / np.maximum(size, 1))[size >= LEAST_SYMBOLS])
        out.append(Sample(s.lang, s.text, float(min(1.0, slack * rate[int(0.95 * len(rate))])) if len(rate) >= 10 else 1.0))
    return tuple(out)


def _judge(model: CrossParser, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text the best language's number, the score, whether it has a letter, and whether it parses as that language."""
    n, k = len(texts), len(model.langs)
    if not k:
        _, _, letters = model.symbols(texts)
        return np.zeros(n, np.int64), np.zeros(n), letters, letters
    phrases, size, letters = model.phrases(texts)
    rate = phrases / np.maximum(size, 1)[:, None]
    best = np.argmin(rate, 1)
    if k > 1:
        two = np.partition(rate, 1, 1)[:, :2]
        with np.errstate(invalid="ignore", divide="ignore"):
            score = two[:, 1] / (two[:, 0] + two[:, 1])
    else:
        score = np.ones(n)
    fits = letters & ((size < LEAST_SYMBOLS) | (rate[np.arange(n), best] <= model.most_rate[best]))
    return best, np.where(letters, score, 0.0), letters, fits


def predict(docs: DataFrame, samples: tuple[Sample, ...]) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of docs.

    Only the text counts. `und` with score 0 where text is null or has no letter, or nothing was learnt. The score
    is the runner-up's phrase rate over the sum of both best: 0.5 for a tie (the language first by name wins),
    towards 1 for a clear winner; 1 with one language. Null ids, repeated rows and other columns do no harm.
    """
    shared = docs.sparkSession.sparkContext.broadcast(samples)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = CrossParser.of(shared.value)
        for batch, texts in _texts(batches, 2):
            best, score, letters, _ = _judge(model, texts)
            names = [model.langs[k] if ok and model.langs else "und" for k, ok in zip(best.tolist(), letters.tolist())]
            score = score if model.langs else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text")).transform(mapped, step, SCHEMA)


def _texts(batches: Iterator[pa.RecordBatch], place: int, limit: int = 2_000_000) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Batches cut so that the texts in column `place` come to about `limit` characters, and these texts."""
    for batch in batches:
        column = batch.column(place)
        size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0)).astype(np.int64)
        total, at = np.cumsum(size), 0
        while at < len(size):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + limit, "right")))
            part = batch.slice(at, to - at)
            yield part, part.column(place).to_pylist()
            at = to


def identify(docs: DataFrame) -> DataFrame:
    """Learns from the labelled documents of docs (doc_id, text, lang) and predicts the language of every one."""
    return predict(docs, sample(docs))


def accepted(docs: DataFrame, slack: float = 2.0) -> DataFrame:
    """The rows of docs, with all their columns, whose text is in a language that the labelled documents teach.

    A text goes if it is null or without a letter, or if even its best language needs more phrases per symbol than
    `slack` times what that language's labelled texts need (see sample()); texts of under 64 symbols need a letter
    only. Where nothing is labelled, no language can be told from another, and all texts with a letter stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(sample(docs, slack=slack))
    place = docs.columns.index("text")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = CrossParser.of(shared.value)
        for batch, texts in _texts(batches, place):
            yield batch.filter(pa.array(_judge(model, texts)[3]))

    return docs.transform(mapped, step, docs.schema)
