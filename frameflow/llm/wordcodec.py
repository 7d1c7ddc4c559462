"""Exact tokenizer output at dictionary speed.

The word tokenizer drops white space and never merges across pre-tokens, so the ids of a text are the ids of its
pre-tokens in order. Each worker keeps a bounded dictionary, by hash, of the pre-tokens it has met, and the ids of
a batch of texts come from one vectorised gather; only new pre-tokens reach the tokenizers library. Pre-tokens of
ASCII or Latin-1 letters, digits and marks go to the tokenizer's own BPE model; words with any other character go
through the whole tokenizer. A wrong look-up needs two pre-tokens with one 64-bit hash.
"""

from __future__ import annotations

import json
import os

import numpy as np

from frameflow.llm.bytelex import WHOLE, Table, Texts, hashes, of_text, pretokens

_CODECS: dict[tuple, "WordCodec"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_chars() -> dict[int, str]:
    """The printable character that byte-level BPE writes for each byte: itself where printable, else U+0100 onwards."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordCodec:
    """Dictionary from pre-tokens to token ids (and token spans in bytes), filled through the tokenizers library."""

    def __init__(self, path: str, max_words: int = 1_000_000, spans: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        if not self._is_known(spec):
            raise ValueError(f"{path}: not a lower-casing byte-level BPE that drops white space")
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        end = spec["model"]["end_of_word_suffix"]
        if not end:
            raise ValueError(f"{path}: has no word-end suffix")
        self.width = np.zeros(max(spec["model"]["vocab"].values()) + 1, np.int32)
        self.last = np.zeros(len(self.width), bool)
        for token, i in spec["model"]["vocab"].items():
            self.width[i], self.last[i] = len(token.removesuffix(end)), token.endswith(end)
        self.to_chars = {b: c for b, c in _byte_chars().items() if b != 0x20}
        self.max_words, self.spans = max_words, spans
        self._clear()

    @staticmethod
    def _is_known(spec: dict) -> bool:
        """True if normaliser and pre-tokenizer are those that bytelex.pretokens stands for."""
        steps = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        cuts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        return steps == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in cuts] == ["Split", "ByteLevel"] and cuts[0]["pattern"] == {"Regex": pattern}

    @classmethod
    def of(cls, path: str, spans: bool = False) -> "WordCodec":
        """One codec per worker process and file."""
        key = (path, spans)
        if key not in _CODECS:
            _CODECS[key] = cls(path, spans=spans)
        return _CODECS[key]

    def _clear(self) -> None:
        self.table = Table()
        self.hash, self.ids, self.begin, self.end = (np.zeros(0, t) for t in (np.uint64, np.uint16 if len(self.width) < 1 << 16 else np.uint32, np.int32, np.int32))
        self.start, self.size, self.met = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.used = 0

    def _forget(self) -> None:
        """Keeps what was met twice or more since the last time, up to half the bound."""
        n = self.table.n
        keep = np.flatnonzero(self.met[:n] > 1)
        if len(keep) > self.max_words // 2:
            keep = np.sort(keep[np.argsort(-self.met[keep], kind="stable")[: self.max_words // 2]])
        where, size = self.tokens(keep)
        ids, begin, end, h, met = self.ids[where], self.begin[where] if self.spans else None, self.end[where] if self.spans else None, self.hash[keep], self.met[keep] // 2
        self._clear()
        self._add(h, size, ids, begin, end)
        self.met[: len(met)] = met

    def _put(self, name: str, at: int, values: np.ndarray) -> None:
        table = getattr(self, name)
        if at + len(values) > len(table):
            wider = np.zeros(max(2 * len(table), at + len(values), 1 << 14), table.dtype)
            wider[:at] = table[:at]
            setattr(self, name, table := wider)
        table[at : at + len(values)] = values

    def _add(self, h: np.ndarray, size: np.ndarray, ids: np.ndarray, begin: np.ndarray | None, end: np.ndarray | None) -> None:
        n = self.table.n
        self._put("hash", n, h)
        self._put("start", n, self.used + np.cumsum(size) - size)
        self._put("size", n, size)
        self._put("met", n, np.zeros(len(h), np.int32))
        self._put("ids", self.used, ids)
        if self.spans:
            self._put("begin", self.used, begin)
            self._put("end", self.used, end)
        self.used += len(ids)
        self.table.add(h)

    def _learn(self, h: np.ndarray, keys: list[bytes], whole: np.ndarray) -> None:
        plain = np.flatnonzero(~whole).tolist()
        for at in range(0, len(plain), 4096):
            part = plain[at : at + 4096]
            text = b" ".join([keys[i] for i in part]).decode("latin-1").translate(self.to_chars)
            e = self.model.encode_batch_fast([text], add_special_tokens=False)[0]
            ids = np.array(e.ids, np.int64)
            last = np.flatnonzero(self.last[ids])
            size = np.diff(last, prepend=-1)
            assert len(size) == len(part), "a pre-token's last token carries the word-end suffix"
            begin = end = None
            if self.spans:
                width = self.width[ids]
                ends = np.cumsum(width)
                first = np.concatenate([[0], ends])[np.cumsum(size) - size]
                end = ends - np.repeat(first, size)
                begin = end - width
            self._add(h[part], size, ids, begin, end)
        odd = np.flatnonzero(whole).tolist()
        for at in range(0, len(odd), 4096):
            part = odd[at : at + 4096]
            texts = [keys[i].decode("utf-8", "replace") for i in part]
            found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
            begin = end = None
            if self.spans:
                byte = [np.cumsum([0] + [len(c.encode()) for c in t]) for t in texts]
                begin = np.array([b[x] for b, e in zip(byte, found) for x, _ in e.offsets], np.int32)
                end = np.array([b[y] for b, e in zip(byte, found) for _, y in e.offsets], np.int32)
            self._add(h[part], np.array([len(e.ids) for e in found], np.int64), np.array([i for e in found for i in e.ids], np.int64), begin, end)

    def codes(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The dictionary number, begin and end of each pre-token; numbers are valid until the next call."""
        if self.table.n > self.max_words:
            self._forget()
        begin, end, kind, low = pretokens(texts)
        h = hashes(low, begin, end, 0)
        h[kind == WHOLE] ^= np.uint64(0x5555555555555555)
        out = self.table.find(h)
        lost = np.flatnonzero(out < 0)
        if len(lost):
            fresh, first = np.unique(h[lost], return_index=True)
            first = lost[first]
            raw = low.tobytes()
            self._learn(fresh, [raw[a:b] for a, b in zip(begin[first].tolist(), end[first].tolist())], kind[first] == WHOLE)
            out[lost] = self.table.find(h[lost])
        self.met[: self.table.n] += np.bincount(out, minlength=self.table.n).astype(np.int32)
        return out, begin, end

    def tokens(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in the id tables of all tokens of these pre-tokens, and each one's number of tokens."""
        size = self.size[codes].astype(np.int64)
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return np.repeat(self.start[codes] - (ends - size), size) + np.arange(total), size

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the number of ids of each."""
        codes, begin, _ = self.codes(texts)
        where, size = self.tokens(codes)
        return self.ids[where].astype(np.uint32), per_range(size, of_text(texts, begin))


def per_range(size: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of size between consecutive bounds."""
    return np.diff(np.concatenate([[0], np.cumsum(size)])[bounds])
