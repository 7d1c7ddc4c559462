import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameflow.llm.components import components
from frameflow.llm.jaccard import Wanted, jaccard_components, one_of_each

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, k, num, den):
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(s), d if not s else least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def corpus():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(1, 9)))
    base = [word() for _ in range(70)]
    notice = [word() for _ in range(25)]
    texts = []
    for _ in range(150):  # a large group of near copies, some linked, many not
        w = list(base)
        for _ in range(r.randint(0, 5)):
            w[r.randrange(len(w))] = word()
        texts.append(" ".join(w))
    for _ in range(90):  # one notice in texts of their own
        texts.append(" ".join([word() for _ in range(r.randint(5, 60))] + notice))
    for _ in range(20):  # chains: each a little further from the first
        w = [word() for _ in range(60)]
        for _ in range(4):
            texts.append(" ".join(w))
            w[r.randrange(60)] = word()
            w = w[1:] + [word()]
    texts += ["same text here of five"] * 40 + ["Same TEXT here of five", "one", "ONE", "two words", "", "  \n", None]
    rows = list(enumerate(texts))
    r.shuffle(rows)
    return rows + [(None, " ".join(base)), (None, None), rows[0], rows[0]]


@pytest.mark.parametrize("k,num", [(3, 90), (5, 80)])
def test_components_equal_brute_force(spark, k, num):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).repartition(5)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(df, k, num, 100).collect()), key=str)
    assert got == brute(rows, k, num, 100)


def test_one_of_each_component_stays(spark):
    rows = [x for x in corpus() if x[0] is not None]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, node string")
    kept = one_of_each(df, 5, 80, 100)
    assert kept.columns == df.columns
    want = {c for d, _, c in brute(rows, 5, 80, 100)}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_components(df).collect() == []
    assert one_of_each(df).collect() == []


@pytest.mark.parametrize("one_task", [0, 1000])
def test_components_of_chains_and_stars(spark, one_task):
    edges = [(i, i + 1) for i in range(20)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), one_task=one_task).collect()}
    assert got == {i: 0 for i in range(1, 21)} | {i: 100 for i in range(101, 140)} | {201: 200}


def test_bitmap_and_join_ask_for_the_same_rows(spark):
    """Wanted filters by a bitmap, which may let others through, or by a join, which may not: both have all that is wanted."""
    docs = spark.range(500).selectExpr("xxhash64(id) node", "cast(id as string) text")
    nodes = docs.where("text % 7 = 0").select("node")
    by_map, by_join = Wanted(nodes), Wanted(nodes, most_bits=0)
    assert by_map.words is not None and by_join.words is None
    want = {r.text for r in docs.where("text % 7 = 0").collect()}
    assert {r.text for r in by_join.of(docs).collect()} == want and {r.bit for r in by_join.of(docs).collect()} == {-1}
    through = {r.text for r in by_map.of(docs).collect() if by_map.words[r.bit // 64] >> np.uint64(r.bit % 64) & np.uint64(1)}
    assert want <= through and len(through) < len(want) + 60


@pytest.mark.parametrize("k,num", [(3, 90), (5, 80)])
def test_components_by_joins_equal_brute_force(spark, monkeypatch, k, num):
    made = Wanted.__init__
    monkeypatch.setattr(Wanted, "__init__", lambda self, nodes, per_node=16, most_bits=0: made(self, nodes, per_node, 0))
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard_components(docs, k, num, 100).collect()), key=str) == sorted(brute(rows, k, num, 100), key=str)
