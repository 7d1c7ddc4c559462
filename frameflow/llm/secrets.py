"""Secret scanning: fixed patterns, and a lexer that ties literals to the names they are assigned to.

The lexer reads assignments of source and configuration syntax (`name = "x"`, `"name": "x"`, `name: x`,
`export NAME=x`, `name := x`, `name => x`) into name-literal pairs, joins literals added with `+` or set side by
side, over line ends too, and carries constants through later assignments (`b = a`, `"$A"`, `${A}`). A literal whose value reaches a
name that stands for a credential is scored by that name and by the value's make-up, and reported where it stands.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameflow.llm.bytelex import spans as pieces
from frameflow.llm.common import mapped

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_literal long"
LEAST_SENSITIVITY = 0.6  # of a name whose values are judged
KINDS = ("assign", "access", "hex", "literal")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")

_OPERATOR = re.compile(r"(?<![=!<>:+\-*/|&])(?::=|=>|=|:)(?![=:/])")
_NAME_START = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_$")
_NAME_REST = _NAME_START | frozenset("0123456789.-")
_TERM = re.compile(
    r"""[ \t]*(?:\"{3}((?s:.*?))\"{3}|'{3}((?s:.*?))'{3}|"([^"\\\n]*+(?:\\(?s:.)[^"\\\n]*+)*+)"|'([^'\\\n]*+(?:\\(?s:.)[^'\\\n]*+)*+)'|`([^`]*+)`"""
    r"""|\$\{?([A-Za-z_]\w*+)\}?|([A-Za-z_][\w.]*+)(?=[ \t]*(?:[+;,)}\]]|\Z|\n))|([A-Za-z0-9+/_.=@!#$%^&*~-]+))"""
)
_OPEN = re.compile(r"[ \t]*\(\s*")
_JOIN = re.compile(r"[ \t]*\+[ \t]*(?![ \t\r\n])|[ \t]+(?=[\"'])")
#: Over line ends only what can't start an assignment of its own: a quote, or a name that ends the term.
_JOIN_LINES = re.compile(r"""\s*\+\s*(?=["'`]|\$\{?[A-Za-z_]|[A-Za-z_][\w.]*+[ \t]*(?:[+;,)}\]]|\Z|\r?\n))|[ \t]*\\\r?\n\s*(?=["'])""")
_JOIN_INSIDE = re.compile(r"\s+(?=[\"'])")
_KEYED = re.compile(r"[ \t]*(?::|=)")
_PEM = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----")
_PEM_BODY = re.compile(r"[A-Za-z0-9+/=]{16,}")
_INNER = re.compile(r"\$\{?([A-Za-z_]\w*)\}?")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
#: What names of credentials contain, with weights.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 1.0, "pass": 0.7, "secret": 1.0, "token": 1.0, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "bearer": 0.9, "auth": 0.6, "authorization": 0.8, "private": 0.6, "signing": 0.6,
    "encryption": 0.6, "license": 0.4, "webhook": 0.5, "dsn": 0.6, "key": 0.4, "access": 0.4, "api": 0.4, "client": 0.2, "salt": 0.5,
}
#: Words that mark a stand-in for a secret.
STAND_IN = re.compile(r"example|sample|changeme|placeholder|dummy|redacted|your[_-]|xxxx|\*\*\*\*|<[^<>]*>|\$\{|test123|^(?:true|false|null|none|undefined|todo)$", re.I)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the fixed patterns, leftmost and non-overlapping within a kind."""
    out = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        out += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text)]
    out += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], x[2]))


def sensitivity(name: str) -> float:
    """How much a name stands for a credential, from 0."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    return sum(SENSITIVE.get(p.removesuffix("s") if p not in SENSITIVE else p, 0.0) for p in dict.fromkeys(parts)) + (0.6 if "apikey" in "".join(parts) else 0)


def strength(value: str) -> float:
    """0 to 1: how little a value looks like a word or a stand-in."""
    pem = _PEM.search(value)
    if pem and any(len(set(m[0])) >= 8 for m in _PEM_BODY.finditer(value, pem.end())):
        return 1.0
    if len(value) < 8 or STAND_IN.search(value) or len(value.split()) > 2:
        return 0.0
    counts = Counter(value)
    bits = -sum(c / len(value) * math.log2(c / len(value)) for c in counts.values())
    kinds = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, bits / 4.0) * (0.4 if kinds == 1 else 0.8 if kinds == 2 else 1.0)


class Literal:
    """What is assigned: places of literals, and other literals that it is made of."""

    def __init__(self, parts: list[tuple[int, int] | Literal], quoted: bool):
        self.parts, self.quoted = parts, quoted

    def spans(self) -> list[tuple[int, int]]:
        """Places in order, each once, however often constants repeat them."""
        out: dict[tuple[int, int], None] = {}
        seen, stack = set(), [self]
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                out[x] = None
            elif id(x) not in seen:
                seen.add(id(x))
                stack += reversed(x.parts)
        return list(out)


def _name_before(text: str, at: int) -> str:
    """The name that ends before an operator, with quotes and brackets closed; empty if there is none."""
    while at and text[at - 1] in " \t":
        at -= 1
    at -= at > 0 and text[at - 1] == "]"
    at -= at > 0 and text[at - 1] in "\"'`"
    begin = at
    while begin and text[begin - 1] in _NAME_REST:
        begin -= 1
    while begin < at and text[begin] not in _NAME_START:
        begin += 1
    return text[begin:at]


def assignments(text: str) -> Iterator[tuple[str, Literal]]:
    """Name-literal pairs in order; constants assigned earlier in the text stand for their values.

    Operators inside a value of several terms take one term each. Inside an unquoted value they take what is left of
    it, but for those of a sensitive name, where the whole is the value already. So each character is read a bounded
    number of times.
    """
    known: dict[str, Literal] = {}
    chain_end, bare_end, settled = 0, 0, False
    for m in _OPERATOR.finditer(text):
        inside = m.end() < bare_end
        if inside and settled:
            continue
        name = _name_before(text, m.start())
        if not name:
            continue
        parts: list[tuple[int, int] | Literal] = []
        quoted = False
        if inside:
            parts.append((m.end(), bare_end))
            settled = sensitivity(name) >= LEAST_SENSITIVITY
        else:
            alone = m.end() < chain_end
            opened = None if alone else _OPEN.match(text, m.end())
            at, over, terms = opened.end() if opened else m.end(), False, 0
            while t := _TERM.match(text, at):
                which = t.lastindex
                body = t.group(which)
                if over and _KEYED.match(text, t.end()):  # the name of an assignment on a line of its own
                    break
                terms += 1
                if which <= 5:
                    quoted = True
                    inner = _INNER.fullmatch(body)
                    if inner and inner[1] in known:
                        parts.append(known[inner[1]])
                    elif body:
                        parts.append(t.span(which))
                elif which <= 7 and body in known:
                    parts.append(known[body])
                    quoted = quoted or known[body].quoted
                elif which != 6:  # else a reference to something outside
                    parts.append(t.span(which))
                    if which == 8 and t.end() > bare_end:
                        bare_end, settled = t.end(), sensitivity(name) >= LEAST_SENSITIVITY
                at = t.end()
                if alone:
                    break
                j, over = _JOIN.match(text, at), False
                if not j:
                    j, over = _JOIN_LINES.match(text, at) or (opened and _JOIN_INSIDE.match(text, at)), True
                if not j:
                    break
                at = j.end()
            if terms > 1:
                chain_end = max(chain_end, at)
        if parts:
            found = Literal(parts, quoted)
            known[name.rsplit(".", 1)[-1]] = known[name] = found
            yield name, found


def literal_spans(text: str, threshold: float = 0.6) -> list[tuple[int, int, int]]:
    """Places of literals whose value reaches a sensitive name with a score of at least `threshold`.

    Of a value that is built up in steps (`token = token + "x"`) the last one counts, which holds all of it.
    """
    out: dict[tuple[int, int], None] = {}
    if "=" not in text and ":" not in text:
        return []
    values: list[tuple[float, Literal] | None] = []
    last: dict[str, int] = {}
    for name, found in assignments(text):
        s = sensitivity(name)
        if s < LEAST_SENSITIVITY:
            continue
        before = last.get(name)
        if before is not None and any(p is values[before][1] for p in found.parts):
            values[before] = None
        last[name] = len(values)
        values.append((s, found))
    for s, found in filter(None, values):
        spans = found.spans()
        value = "".join(text[a:b] for a, b in spans)
        if min(1.0, s) * strength(value) >= threshold and (found.quoted or re.search("[0-9]", value)):
            out |= dict.fromkeys(spans)
    return [(a, b, 3) for a, b in out]


def all_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and base spans with those of the lexer that no base span covers."""
    base = base_spans(text)
    starts = [a for a, _, _ in base]
    furthest = list(accumulate((b for _, b, _ in base), max))
    covered = lambda a, b: (k := bisect_right(starts, a)) and furthest[k - 1] >= b
    more = [x for x in literal_spans(text) if not covered(x[0], x[1])]
    return base, sorted([*base, *more], key=lambda x: (x[0], x[2]))


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): counts and spans, in code points with exclusive ends.

    A null or empty text has no spans (the digest is that of the empty string). Null ids and repeated rows are kept;
    other columns are ignored. Texts of any length are read whole.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x.slice(a, b - a) for x in batches for a, b in pieces(x.column("text"))):
            rows = []
            for text in batch.column("text").to_pylist():
                base, spans = all_spans(text or "")
                n = Counter(k for _, _, k in spans)
                rows.append((n[0], n[1], n[2], hashlib.sha256(written(base).encode()).hexdigest(), written(spans), n[3]))
            columns = list(zip(*rows)) if rows else [()] * 6
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types))], [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").transform(mapped, step, SCHEMA)


def redacted(text: str, mark: str = "[SECRET]") -> str:
    """The text with each stretch that spans cover replaced by a mark."""
    out, at = [], 0
    for a, b, _ in all_spans(text)[1]:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with secrets in its text replaced by a mark, and n_chars, if it has that, counted anew.

    Rows, order and other columns stay as they are.
    """
    schema = docs.schema
    place = docs.columns.index(text)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x.slice(a, b - a) for x in batches for a, b in pieces(x.column(place))):
            column = batch.column(place)
            new = pa.array([None if t is None else redacted(t) for t in column.to_pylist()], column.type)
            yield batch.set_column(place, batch.schema.field(place), new)

    out = docs.transform(mapped, step, schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text).cast(schema["n_chars"].dataType))
    return out
