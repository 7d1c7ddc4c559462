"""Token counts of fields and sections from one encoding of the whole document.

A document is encoded once, with the character span of each token. Sections are character spans too, of several
kinds at once: fields (a line's name before a colon, and what follows), lines, and windows of fixed length, which cut
through words. A sorted interval join attributes tokens to them. A token that crosses a boundary counts by three
rules: for the section where it begins (n_first), for the one that has most of its characters, the earlier of equals
(n_most), and for each in proportion to its characters (share).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from frameflow.llm.bytelex import Texts, of_text, parts
from frameflow.llm.common import mapped
from frameflow.llm.wordcodec import WordCodec, default_path, per_range

SCHEMA = "doc_id long, kind string, section_id long, begin long, end long, n_first long, n_most long, share double, n_crossing long, doc_tokens long"
WINDOW = 1000  # code points


def line_sections(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sections that end with each line feed (which belongs to the line it ends): owner, begin, end in bytes."""
    lf = np.flatnonzero(texts.data == 10)
    text = np.arange(len(texts))
    owner = np.searchsorted(texts.begin, lf, "right") - 1
    inside = (owner >= 0) & (lf < texts.end[np.maximum(owner, 0)])
    ends = np.concatenate([lf[inside] + 1, texts.end])
    owners = np.concatenate([owner[inside], text])
    order = np.lexsort((ends, owners))
    ends, owners = ends[order], owners[order]
    first = np.concatenate([[True], owners[1:] != owners[:-1]]) if len(owners) else np.zeros(0, bool)
    begins = np.where(first, texts.begin[owners], np.concatenate([[0], ends[:-1]]) if len(ends) else ends)
    keep = (ends > begins) | first & np.concatenate([owners[1:] != owners[:-1], [True]])  # no empty section, but one for an empty text
    return owners[keep], begins[keep], ends[keep]


def window_sections(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sections of WINDOW code points each, the last one shorter; an empty text has an empty one."""
    starts = np.flatnonzero((texts.data & 0xC0) != 0x80)  # the first byte of every character
    first, end = np.searchsorted(starts, texts.begin), np.searchsorted(starts, texts.end)
    n = np.maximum(-(-(end - first) // WINDOW), 1)
    owner = np.repeat(np.arange(len(texts)), n)
    run = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    begin = first[owner] + run * WINDOW
    stop = np.minimum(begin + WINDOW, end[owner])
    starts = np.append(starts, len(texts.data))
    last = run == n[owner] - 1
    return owner, np.where(run == 0, texts.begin[owner], starts[np.minimum(begin, len(starts) - 1)]), np.where(last, texts.end[owner], starts[np.minimum(stop, len(starts) - 1)])


def field_sections(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each line its name, up to the first colon in it, and its value, the colon and what follows; else the line whole."""
    owner, begin, end = line_sections(texts)
    colon = np.append(np.flatnonzero(texts.data == 0x3A), len(texts.data))
    at = colon[np.searchsorted(colon, begin)]
    cut = np.flatnonzero((at > begin) & (at < end))
    owner, begin, end = np.concatenate([owner, owner[cut]]), np.concatenate([begin, at[cut]]), np.concatenate([end, end[cut]])
    end[cut] = at[cut]
    order = np.lexsort((begin, owner))
    return owner[order], begin[order], end[order]


SECTIONS = {"field": field_sections, "line": line_sections, "window": window_sections}


def attribute(token_begin: np.ndarray, token_end: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of each section by the rules first, most and share, and how many tokens cross its bounds.

    Sections are in order, adjoining or apart. Tokens outside every section count nowhere; shares add up to each
    token's part inside sections.
    """
    n = len(begin)
    if not n:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0), np.zeros(0, np.int64))
    lo, hi = np.searchsorted(end, token_begin, "right"), np.searchsorted(begin, token_end, "left") - 1
    at = np.minimum(lo, n - 1)
    whole = (lo == hi) & (begin[at] <= token_begin) & (token_end <= end[at])
    first = np.bincount(lo[whole], minlength=n)
    most, share = first.copy(), first.astype(float)
    over = np.flatnonzero(~whole & (lo <= hi))
    times = hi[over] - lo[over] + 1
    token = np.repeat(over, times)
    section = np.arange(len(token)) - np.repeat(np.cumsum(times) - times - lo[over], times)
    part = np.minimum(token_end[token], end[section]) - np.maximum(token_begin[token], begin[section])
    share += np.bincount(section, part / np.maximum(token_end[token] - token_begin[token], 1), minlength=n)
    order = np.lexsort((section, -part, token))
    new = np.concatenate([[True], token[order][1:] != token[order][:-1]]) if len(order) else np.zeros(0, bool)
    first += np.bincount(lo[over], minlength=n)
    most += np.bincount(section[order][new], minlength=n)
    return first, most, share, np.bincount(section, minlength=n)


def token_counts(docs: DataFrame, sections: dict[str, Callable[[Texts], tuple]] | None = None, tokenizer: str | None = None) -> DataFrame:
    """A row for every section of every text and kind: doc_id, kind, section_id, begin, end, n_first, n_most, share,
    n_crossing, doc_tokens.

    begin and end are code points of the text; section_id counts from 0 within a text and kind. A null or empty text
    has one empty section of each kind. Null doc_ids and repeated rows are kept as they are; other columns of docs are
    ignored. An empty table gives no rows.
    """
    path, kinds = tokenizer or default_path(), sections or SECTIONS

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = WordCodec.of(path, spans=True)
        for batch in batches:
            for a, b, texts in parts(batch.column("text")):
                codes, start, _ = codec.codes(texts)
                where, width = codec.tokens(codes)
                base = np.repeat(start, width)
                starts_char = (texts.data & 0xC0) != 0x80
                chars = np.concatenate([[0], np.cumsum(starts_char)])
                tb, te = base + codec.begin[where], base + codec.end[where]
                tb, te = chars[tb] - ~starts_char[tb], chars[te]  # a token inside a character covers it
                total = per_range(width, of_text(texts, start))
                for kind, cut in kinds.items():
                    owner, sb, se = cut(texts)
                    cb, ce = chars[sb], chars[se]
                    first, most, share, crossing = attribute(tb, te, cb, ce)
                    run = np.arange(len(owner)) - np.searchsorted(owner, owner)
                    zero = chars[texts.begin[owner]]
                    columns = [batch.column("doc_id").slice(a, b - a).take(pa.array(owner)), pa.array([kind] * len(owner), pa.string()), run, cb - zero, ce - zero, first, most, pa.array(share, pa.float64()), crossing, total[owner]]
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns], [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").transform(mapped, step, SCHEMA)
