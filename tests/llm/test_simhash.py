"""SimHash near copies against comparing all pairs of fingerprints."""

import random
import re

import numpy as np
import pytest
import xxhash

from frameflow.llm import simhash
from frameflow.llm.simhash import fingerprint, linked_in_cell, near_copies, parts_left

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, radius=2):
    prints = [slow_print(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [r[0] for j, r in enumerate(rows) if find(j) == find(i) and r[0] is not None]
        out.append((doc_id, f"{prints[i]:016x}", min(ids, default=None)))
    return sorted(out, key=str)


def texts(n, seed=0):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    base = [[rng.choice(words) for _ in range(rng.choice([1, 2, 3, 40, 200, 400]))] for _ in range(n // 3)]
    out = []
    for _ in range(n):
        own = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2])):
            own[rng.randrange(len(own))] = rng.choice(words)
        out.append(" ".join(own))
    return out


ODD = [None, "", " \t\n", "One", "one TWO", "One two three", "ÄÖ x y z", "\x1c a\x1cb c \x85d", "a b c " * 500]


@pytest.mark.parametrize("text", ODD + texts(6))
def test_fingerprint(text):
    assert fingerprint(text) == slow_print(text)


def test_long_text_in_pieces(monkeypatch):
    text = " ".join(texts(30, 5))
    whole = fingerprint(text)
    small = simhash._word_lists
    monkeypatch.setattr(simhash, "_word_lists", lambda data: small(data, 7))
    assert fingerprint(text) == whole == slow_print(text)


def test_near_copies(spark):
    rows = list(enumerate(ODD + texts(200, 1)))
    rows += [(None, rows[20][1]), (None, "quite alone in this table, with no other of its kind"), (5, rows[30][1]), (5, rows[30][1])]
    random.Random(2).shuffle(rows)
    docs = spark.createDataFrame([(i, t, "f", 1) for i, t in rows], "doc_id long, text string, fp string, root int")
    want = brute(rows)
    assert sorted(map(tuple, near_copies(docs.repartition(3)).collect()), key=str) == want
    assert len({r[2] for r in want}) < len(want) - 50


def test_empty(spark):
    assert near_copies(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_tiles_find_all_pairs():
    rng = np.random.default_rng(0)
    fp = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (900, 3), dtype=np.uint64)
    fp = np.unique(np.concatenate([fp, fp ^ flips[:, 0], fp ^ flips[:, 0] ^ flips[:, 1], fp ^ flips[:, 0] ^ flips[:, 1] ^ flips[:, 2]]))
    got = {frozenset((int(x), int(y))) for a, b in linked_in_cell(fp, 2) for x, y in zip(a, b, strict=True)}
    near = np.argwhere(np.triu(np.bitwise_count(fp[:, None] ^ fp[None]) <= 2, 1))
    assert got == {frozenset((int(fp[i]), int(fp[j]))) for i, j in near}


def test_parts_cover_all_bits():
    masks = [simhash._ALL]
    for _ in range(6):
        for mask in masks:
            held = [mask & ~left for left in parts_left(mask, 3)]
            assert sum(held) == mask and all(a & b == 0 for i, a in enumerate(held) for b in held[:i])
        masks = [left for mask in masks for left in parts_left(mask, 3)][:9]


def test_full_cells_are_dealt_out_again(spark):
    rng = random.Random(4)
    base = rng.getrandbits(64)
    prints = {base ^ sum(1 << b for b in rng.sample(range(40, 64), rng.randint(0, 5))) for _ in range(600)} | {rng.getrandbits(64) for _ in range(300)}
    frame = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")
    fp = np.array(sorted(prints), np.uint64)
    near = [(int(fp[i]), int(fp[j])) for i, j in np.argwhere(np.triu(np.bitwise_count(fp[:, None] ^ fp[None]) <= 2, 1))]

    def groups(pairs):
        root = {}
        find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
        for a, b in pairs:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        return {x: find(x) for x in root}

    want = groups(near)
    for most in (60, 1 << 16):
        got = groups([(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(frame, 2, most).collect()])
        assert got == want
