"""Draws of a mixture and their stand-ins, against plain loops."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameflow.operators import sampler


def low_half(epoch, draw, seed):
    return int(hashlib.sha256(repr((epoch, draw, seed)).encode()).hexdigest(), 16) & ((1 << 128) - 1)


@pytest.fixture(scope="module")
def parts(spark):
    steps = spark.range(900).selectExpr("case when id % 9 = 0 then 'b' when id % 9 = 1 then 'c' else 'a' end dataset", "id div 10 episode", "id % 10 step", "id")
    index = sampler.step_index(steps, "dataset", "episode", "step")
    sets = spark.createDataFrame([("a", 1.0), ("b", 0.25), ("c", 2.0)], "dataset string, weight double")
    rows = {}
    for r in index.orderBy("dataset", "episode", "step").collect():
        rows.setdefault(r.dataset, []).append(r.id)
        assert r.place == len(rows[r.dataset]) - 1
    return index, sampler.mixture(index, sets, "dataset", "weight"), rows


def test_seeds_and_remainders(spark):
    df = spark.range(200).select("id", sampler.seed_digits(F.col("id"), 3, 17).alias("h"), sampler.seed_digits(F.col("id"), 3, 17, train=False).alias("e"))
    ns = [1, 2, 7, 1000, 2**31 + 11, 2**47 - 1]
    for r in df.select("*", *(sampler.remainder(F.col("h"), 32, F.lit(n)).alias(f"r{n}") for n in ns)).collect():
        seed = low_half(3, r.id, 17)
        assert int(r.h, 16) == seed and int(r.e, 16) == r.id
        assert [r[f"r{n}"] for n in ns] == [seed % n for n in ns]


def test_draws_name_real_frames_by_share(spark, parts):
    index, mix, rows = parts
    got = sampler.sampled(sampler.draws(spark.range(4000).withColumnRenamed("id", "draw"), mix, "dataset", 1, 5), index, "dataset").collect()
    assert sorted(r.draw for r in got) == list(range(4000))
    share = {r.dataset: r.share for r in mix.collect()}
    assert share == pytest.approx({"a": 700 / 925, "b": 25 / 925, "c": 200 / 925})
    for r in got:
        low = low_half(1, r.draw, 5)
        unit = (low >> 80) / (1 << 48)
        want = "a" if unit < share["a"] else "b" if unit < share["a"] + share["b"] else "c"
        assert r.dataset == want and r.id == rows[want][(low & ((1 << 80) - 1)) % len(rows[want])]
    evaluated = sampler.draws(spark.range(500).withColumnRenamed("id", "draw"), mix, "dataset", 1, 5, train=False)
    assert evaluated.count() == 500 and evaluated.select("place").distinct().count() > 200


@pytest.mark.parametrize("train", [True, False])
def test_generator_draws(spark, parts, train):
    index, mix, rows = parts
    order = ["c", "a", "b"]
    got = sampler.sampled(sampler.generator_draws(spark.range(300).withColumnRenamed("id", "draw"), mix, "dataset", order, 4, 9, train), index, "dataset")
    shares = {r.dataset: r.share for r in mix.collect()}
    for r in got.collect():
        rng = np.random.default_rng(low_half(4, r.draw, 9) if train else r.draw)
        dataset = order[rng.choice(3, p=np.array([shares[d] for d in order]))]
        assert (r.dataset, r.id) == (dataset, rows[dataset][rng.choice(len(rows[dataset]))])
    assert got.count() == 300


def test_dataset_without_steps(spark, parts):
    index, _, _ = parts
    with pytest.raises(Exception, match="no steps in z"):
        sampler.mixture(index, spark.createDataFrame([("a", 1.0), ("z", 1.0)], "dataset string, weight double"), "dataset", "weight").collect()


def loop(good, i, tries):
    for k in range(tries):
        if good[(i + k) % len(good)]:
            return (i + k) % len(good)
    return None


@pytest.mark.parametrize("n,block", [(1, 16), (2, 16), (7, 16), (16, 16), (17, 16), (100, 16), (100, 1000), (333, 12)])
def test_next_good_equals_the_loop(spark, n, block):
    rng = random.Random(n)
    good, left = [], 0
    while len(good) < n:
        good += [True] * rng.randint(1, 5) + [False] * rng.choice([1, 3, 9, 10, 12])
    good = good[:n]
    if n == 333:
        good[-5:], good[:6] = [False] * 5, [False] * 6
    rows = [(i, g, f"r{i}") for i, g in enumerate(good)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "draw long, ok boolean, name string").repartition(5)
    for tries in (1, 3, 10):
        got = {r.draw: (r.taken, r.name) for r in sampler.next_good(df, "draw", F.col("ok"), tries, fail=False, block=block).collect()}
        want = {i: loop(good, i, tries) for i in range(n)}
        assert got == {i: (j, None if j is None else f"r{j}") for i, j in want.items()}
    if not all(good):
        with pytest.raises(Exception, match="no good sample in 1 "):
            sampler.next_good(df, "draw", F.col("ok"), strict=True).collect()
