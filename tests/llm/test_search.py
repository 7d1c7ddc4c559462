"""Ranked search against scoring every document for every item."""

import math
import random
import re
from collections import Counter

import duckdb
import pyarrow as pa
import pytest

from frameflow.llm import search as module
from frameflow.llm.search import SEARCH_SQL, build_index, rank, search, term_lists

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def brute(docs, items, top=10):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    n = sum(bool(c) for _, c in counts)
    total = sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item_id, text in items:
        scored = []
        for doc_id, c in counts:
            m = 10 + 90 * sum(c.values()) * n // total if total else 10
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def tables(spark, docs, items, parts=3):
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, item_id int, terms string").repartition(parts)
    return d, spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, doc_id int")


def drawn(n, seed=0):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)] + ["Äpfel", "it's", "x-y", "A1", "　z"]
    return [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 60, 200])))) for i in range(n)]


ODD = [(None, None), (None, "w1 w2 w3"), (7, ""), (7, " .,; "), (7, "w1 W1 w2"), (7, "w1 W1 w2"), (9000, "\x00w1\x7fw2{w3}"), (-5, "w1 " * 3000)]


@pytest.mark.parametrize("term", ["", "a", "It's 5 o'clock, ÄÖ-ß  x y", "\x1ca\x85b", "a_b A9z", "word " * 400])
def test_terms(term):
    assert [t.decode() for part in term_lists(term, 16) for t in part] == terms(term)


def test_equals_full_scoring(spark):
    docs = drawn(300) + ODD + [(1000 + i, "w2 w3 same copy") for i in range(40)]
    random.Random(1).shuffle(docs)
    items = [(i, t) for i, t in drawn(25, 9)] + [(3, "w2 same"), (3, "w2 same"), (None, "copy"), (99, None), (98, "unheard"), (97, "w1 w1 W1")]
    got = rank(*tables(spark, docs, items))
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items)


def test_windows_and_blocks_change_nothing(spark, monkeypatch):
    docs, items = drawn(200, 3), drawn(12, 4)
    want = brute(docs, items, 4)
    monkeypatch.setattr(module, "_TOKENS", 300)
    d, i = tables(spark, docs, items, 8)
    writer = module._Writer()
    for doc_id, text in docs:
        writer.add(doc_id, text)
    assert writer.full
    index = build_index(d)
    assert sorted(map(tuple, search(index, i, 4, block_bytes=1).drop("item").collect()), key=str) == want


def test_very_long_document(spark, monkeypatch):
    monkeypatch.setattr(module, "_TOKENS", 50)
    pieces = module.term_lists
    monkeypatch.setattr(module, "term_lists", lambda text: pieces(text, 100))
    writer = module._Writer()
    text = " ".join(t for _, t in drawn(60, 5))
    writer.add(1, text)
    row = writer.row().to_pylist()[0]
    assert row["n_terms"] == len(terms(text)) and len(row["terms"]) == len(set(terms(text))) == sum(row["sizes"])


def test_empty_tables(spark):
    docs, items = drawn(20), drawn(3)
    for d, i in (([], items), (docs, []), ([], []), ([(1, None)], items)):
        assert rank(*tables(spark, d, i, 1)).collect() == []


def test_sql(spark):
    docs, items = [(i, t) for i, t in drawn(150, 6)], drawn(10, 7)
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [i for i, _ in docs], "text": [t for _, t in docs]}))
    con.register("benchmark", pa.table({"item_id": [i for i, _ in items], "text": [t for _, t in items]}))
    want = con.execute(SEARCH_SQL)
    names = [c[0] for c in want.description]
    assert sorted(map(tuple, rank(*tables(spark, docs, items)).select(*names).collect())) == sorted(want.fetchall())


def test_lengths_beyond_64_bits():
    import numpy as np

    lengths = np.array([0, 5, 10**9])
    assert module._penalty(lengths, 10**11, 10**12).tolist() == [10 + 90 * x * 10**11 // 10**12 for x in lengths.tolist()]
