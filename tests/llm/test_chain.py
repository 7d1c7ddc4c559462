"""The classifier chain against a logistic regression by Newton's method, and against folds made by hand."""

import numpy as np

from frameflow.llm.toxicity import Chain, Linear


def drawn(n=600, seed=0):
    """Rows with features 1..8, of which 1 to 3 speak for the first category and 4, 5 for the second, that follows it."""
    r = np.random.default_rng(seed)
    has = r.random((n, 8)) < 0.4
    first = r.random(n) < 1 / (1 + np.exp(-(has[:, :3] @ [2.5, 2.0, -2.5] - 0.8)))
    second = r.random(n) < 1 / (1 + np.exp(-(has[:, 3:5] @ [2.0, -2.0] + 2.5 * first - 1.5)))
    own, number = np.nonzero(has)
    return has.astype(float), number, own, np.stack([first, second], 1).astype(float)


def newton(x, y, ridge):
    """Balanced logistic regression with a ridge on all but the intercept."""
    n = len(y)
    x = np.column_stack([x, np.ones(n)])
    weight = np.where(y > 0, n / (2 * y.sum()), n / (2 * (n - y.sum())))
    pull = np.append(np.full(x.shape[1] - 1, ridge), 0)
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(pull + 1e-9), x.T @ (weight * (p - y)) + pull * w)
        w = w - step
    return 1 / (1 + np.exp(-x @ w))


def test_linear_model_equals_newton():
    has, number, own, labels = drawn()
    keys = np.arange(1, 9, dtype=np.uint64)
    m = Linear.train(keys, number, own, np.zeros((len(has), 0)), labels[:, 0], least_gain=-1.0, steps=20_000)
    got = m.predict(keys[number], own, np.zeros((len(has), 0)))
    assert np.abs(got - newton(has, labels[:, 0], 1.0)).max() < 0.01
    quick = Linear.train(keys, number, own, np.zeros((len(has), 0)), labels[:, 0], least_gain=-1.0)
    assert np.corrcoef(quick.predict(keys[number], own, np.zeros((len(has), 0))), got)[0, 1] > 0.99


def test_chain_learns_from_predictions_of_rows_that_were_held_out():
    has, number, own, labels = drawn(seed=1)
    n, keys = len(has), np.arange(1, 9, dtype=np.uint64)
    chain = Chain.train(("one", "two"), keys[number], own, labels)
    none = np.zeros((n, 0))
    held = np.zeros(n)
    for f in range(3):
        rest = np.arange(n) % 3 == f
        back = np.cumsum(~rest) - 1
        seen = ~rest[own]
        m = Linear.train(keys, number[seen], back[own[seen]], none[~rest], labels[~rest, 0])
        there = np.cumsum(rest) - 1
        held[rest] = m.predict(keys[number[~seen]], there[own[~seen]], none[rest])
    want = Linear.train(keys, number, own, held[:, None], labels[:, 1])
    assert (chain.models[1].weight == want.weight).all() and (chain.models[1].dense == want.dense).all() and chain.models[1].bias == want.bias
    assert chain.models[1].dense[0] > 0.5  # the second category hears the first
    alone = Linear.train(keys, number, own, none, labels[:, 1])
    said = chain.predict(keys[number], own, n)
    loss = lambda p: -np.mean(labels[:, 1] * np.log(p) + (1 - labels[:, 1]) * np.log(1 - p))
    assert loss(said[:, 1]) < loss(alone.predict(keys[number], own, none))
