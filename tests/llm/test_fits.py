"""The fits of op1, op4 and op5 against plain search."""

import math
import random
from itertools import combinations

import numpy as np
import pytest

from twinlens.llm import langmix, ordinal, trees

# --- trees: exhaustive splits, and each row walked by itself -------------------------


def plain_tree(x, grad, hess, cuts, depth):
    """Nested (feature, cut, left, right) or a leaf value, by trying every cut of every feature."""
    best = (1e-6, None)
    g, h = grad.sum(), hess.sum()
    if depth:
        for f, own in enumerate(cuts):
            for c in own:
                low = x[:, f] <= c
                hl, hr = hess[low].sum(), hess[~low].sum()
                if min(hl, hr) < trees.LEAST_HESSIAN:
                    continue
                gain = grad[low].sum() ** 2 / (hl + trees.RIDGE) + grad[~low].sum() ** 2 / (hr + trees.RIDGE) - g**2 / (h + trees.RIDGE)
                if gain > best[0] + 1e-9:
                    best = (gain, (f, c))
    if best[1] is None:
        return -trees.RATE * g / (h + trees.RIDGE)
    f, c = best[1]
    low = x[:, f] <= c
    return f, c, *(plain_tree(x[s], grad[s], hess[s], cuts, depth - 1) for s in (low, ~low))


def walk(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_trees_equal_exhaustive_search(seed):
    r = np.random.default_rng(seed)
    x = np.column_stack([r.normal(size=400), r.integers(0, 4, 400), r.exponential(size=400)])
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > 1) | (x[:, 2] > 2.5)).astype(float)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, trees.BINS + 1)[1:-1])) for f in range(3)]
    score = np.full(400, math.log(y.mean() / (1 - y.mean())))
    for _ in range(4):
        p = 1 / (1 + np.exp(-score))
        tree = plain_tree(x, p - y, p * (1 - p), cuts, 3)
        score += [walk(tree, row) for row in x]
    model = trees.fit_arrays(x, y, trees=4, depth=3)
    assert trees.score_arrays(model, x) == pytest.approx(1 / (1 + np.exp(-score)), abs=1e-9)


# --- ordinal regression: no better likelihood to be found ------------------------------


def likelihood(params, x, grades, width):
    w, theta = params[:width], params[width:]
    if (np.diff(theta) < 0).any():
        return -np.inf
    cum = 1 / (1 + np.exp(-(np.concatenate([[-40], theta, [40]])[None, :] - (x @ w)[:, None])))
    p = cum[np.arange(len(x)), grades + 1] - cum[np.arange(len(x)), grades]
    return np.log(np.maximum(p, 1e-12)).mean() - ordinal.RIDGE / 2 * (w**2).sum()


def climbed(params, x, grades, width, rounds=400):
    step = 1.0
    for _ in range(rounds):
        e = 1e-5 * np.eye(len(params))
        slope = np.array([likelihood(params + d, x, grades, width) - likelihood(params - d, x, grades, width) for d in e]) / 2e-5
        now = likelihood(params, x, grades, width)
        while step > 1e-8 and likelihood(params + step * slope, x, grades, width) < now:
            step /= 2
        params, step = params + step * slope, min(step * 2, 50)
    return params


@pytest.mark.parametrize("seed", [1, 2])
def test_ordinal_fit_is_at_the_optimum(seed):
    r = np.random.default_rng(seed)
    x = (r.random((300, 4)) < [0.5, 0.3, 0.2, 0.4]).astype(float)
    eta = x @ [2.0, -1.5, 1.0, 0.0] + r.logistic(size=300)
    grades = (eta > 0.5).astype(int) + (eta > 2.0)
    w, theta = ordinal.fit_arrays([np.flatnonzero(row) for row in x], grades, 4)
    own = likelihood(np.concatenate([w, theta]), x, grades, 4)
    best = climbed(np.concatenate([np.zeros(4), [0.0, 1.0]]), x, grades, 4)
    assert own == pytest.approx(likelihood(best, x, grades, 4), abs=1e-3)
    assert w == pytest.approx(best[:4], abs=0.1) and theta == pytest.approx(best[4:], abs=0.1)


# --- language mixtures: all subsets with plain expectation-maximisation -----------------


def plain_em(p, n, rounds=3000):
    share = np.full(p.shape[1], 1 / p.shape[1])
    for _ in range(rounds):
        part = p * share
        share = (part * (n / part.sum(1))[:, None]).sum(0) / n.sum()
    return share, float((n * np.log((p * share).sum(1))).sum())


def test_mixtures_against_all_subsets():
    r = random.Random(4)
    alphabets = ["abcdefgh", "ghijklmn", "opqrstab"]
    word = lambda k: "".join(r.choice(alphabets[k]) for _ in range(r.randint(3, 8)))
    texts = [" ".join(word(k) for _ in range(3000)) for k in range(3)]
    n = np.zeros((langmix.CELLS, 3))
    for k, t in enumerate(texts):
        n[:, k] = np.bincount(langmix.trigrams([t])[1], minlength=langmix.CELLS)
    model = langmix.Model(["a", "b", "c"], (n + langmix.SMOOTHING) / (n.sum(0) + langmix.SMOOTHING * langmix.CELLS))
    mixed = [" ".join(word(k) for k in kinds for _ in range(60)) for kinds in ((0,), (1,), (2,), (0, 1), (0, 2), (1, 2), (0, 1, 2), (0, 0, 0, 1))]
    share, _ = langmix.mixtures(mixed, model)
    for t, got in zip(mixed, share, strict=True):
        cell, count = np.unique(langmix.trigrams([t])[1], return_counts=True)
        p, cost = model.probability[cell], langmix.PENALTY * math.log(count.sum() + 1)
        found = []
        for size in (1, 2, 3):
            for own in combinations(range(3), size):
                s, like = plain_em(p[:, own], count)
                found.append((like - cost * size, own, s))
        _, own, s = max(found, key=lambda f: f[0])
        want = np.zeros(3)
        want[list(own)] = s
        assert got == pytest.approx(want, abs=0.01)
