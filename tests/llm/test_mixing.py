import random

import numpy as np
import pytest
from awkward_rows import ROWS

from dragline.llm import mixing


def members_of(spark, n, size, p):
    rows = [(int(a), int(b), [float(x) for x in c]) for a, b, c in zip(n, size, p, strict=True)]
    return spark.createDataFrame(rows, "n long, size long, p array<double>").repartition(4)


def brute(n, size, p, targets):
    """Least sum b (r - 1)^2 with exact totals: one clipped plane for each set of documents at zero, all sets but few tried in turn."""
    n, size = n.astype(float), np.maximum(size, 1).astype(float)
    free = np.ones(len(n), bool)
    for _ in range(1000):
        a = (p * n[:, None])[free]
        shift = np.linalg.lstsq((a / size[free, None]).T @ a, a.T @ np.ones(free.sum()) - targets, rcond=None)[0]
        r = np.where(free, 1 - n / size * (p @ shift), 0.0)
        low = free & (r < -1e-12)
        back = ~free & (1 - n / size * (p @ shift) > 1e-12)
        if not low.any() and not back.any():
            return r
        free = (free & ~low) | back
    raise AssertionError("no fixed point")


@pytest.mark.parametrize("seed", range(4))
def test_rates_agree_with_an_active_set_solver(spark, seed):
    rnd = np.random.default_rng(seed)
    p, n = rnd.dirichlet([0.4, 0.3, 0.3], 50), rnd.integers(1, 300, 50)
    size = n * rnd.integers(2, 9, 50)
    targets = n.sum() * rnd.dirichlet([2, 1, 1])
    fit = mixing.fit_rates(members_of(spark, n, size, p), targets)
    r = mixing.rates_of(n, size, p, fit.steps)
    want = brute(n, size, p, targets)
    assert np.abs((n * want) @ p - targets).max() < 1e-6 * n.sum()
    assert np.allclose(r, want, atol=1e-4) and np.allclose(fit.totals, targets, atol=1e-5 * n.sum())
    assert abs(fit.size - (size * r).sum()) < 1e-6 * size.sum() and fit.passes <= 40


def test_rates_meet_reachable_targets(spark):
    rnd = np.random.default_rng(1)
    p = rnd.dirichlet([0.3, 0.3, 0.3], 500)
    n = rnd.integers(0, 500, 500)
    members = members_of(spark, n, 6 * n, p)
    for share in ([0.5, 0.3, 0.2], [0.9, 0.05, 0.05], [0.1, 0.1, 0.8]):
        targets = n.sum() * np.array(share)
        fit = mixing.fit_rates(members, targets)
        r = mixing.rates_of(n, 6 * n, p, fit.steps)
        assert (r >= 0).all() and np.abs((n * r) @ p - targets).max() < 1e-5 * n.sum()
        assert (r[n == 0] == 1).all() and fit.passes <= 40


@pytest.mark.parametrize(("targets", "want"), [([30.0, 0.0], [3.0, 0.0]), ([0.0, 0.0], [0.0, 0.0]), ([0.0, 26.0], [0.0, 1.3])])
def test_unreachable_targets_are_approached(spark, targets, want):
    """In the metric of all documents the closest totals lie on the border of the cone."""
    n, size, p = np.array([10, 20]), np.array([10, 20]), np.array([[0.5, 0.5], [0.4, 0.6]])
    fit = mixing.fit_rates(members_of(spark, n, size, p), np.array(targets))
    r = mixing.rates_of(n, size, p, fit.steps)
    assert (r >= 0).all() and fit.passes <= 60 and (np.array(want) == 0).tolist() == (r < 1e-4).tolist()
    square = p.T @ (p * (n * n / size)[:, None])
    away = lambda x: (d := (n * x) @ p - targets) @ np.linalg.solve(square, d)
    grid = [np.array([a, b]) for a in np.linspace(0, 4, 161) for b in np.linspace(0, 4, 161)]
    assert away(r) <= min(map(away, grid)) + 1e-3


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(6)
    rows, labels = [], []
    for i in range(900):
        poor = i % 4 == 0
        text = " ".join((rnd.choice(["spam", "click", "buy"]) if poor and rnd.random() < 0.4 else f"w{rnd.randint(0, 300)}")
                        for _ in range(rnd.randint(30, 120)))
        rows.append((i, text))
        if i % 2 or rnd.random() < 0.5:
            labels.append((i, int(poor), "x"))
    return rows, labels


def test_domains_and_totals(spark, table, corpus):
    rows, labels = corpus
    known = spark.createDataFrame(labels, "doc_id long, domain int, rate string")
    got = mixing.rate_table(table(rows), known, (0.95, 0.05)).collect()
    p, n, r = np.array([x.posterior for x in got]), np.array([x.n_tokens for x in got]), np.array([x.rate for x in got])
    right = np.array([(x.posterior[1] > 0.5) == (x.doc_id % 4 == 0) for x in got])
    assert len(got) == 900 and right.mean() > 0.97
    assert np.allclose((n * r) @ p / n.sum(), [0.95, 0.05], atol=1e-3)
    copies = np.array([x.copies for x in got])
    assert (np.abs(copies - r) < 1).all() and abs(((n * copies) @ p / n.sum())[0] - 0.95) < 0.05
    mixed = mixing.mixed_documents(table(rows), known, (0.95, 0.05))
    assert mixed.count() == copies.sum() and mixed.columns == table([]).columns


def test_awkward_rows(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (9, None), (5, 1), (10, 0), (7, 0)], "doc_id long, domain int")
    assert mixing.rate_table(awkward, labels, (0.7, 0.3)).count() == len(ROWS)
    none = mixing.rate_table(awkward, labels.limit(0), (0.5, 0.5)).collect()
    assert all(np.allclose(r.posterior, 0.5) and abs(r.rate - 1) < 1e-3 for r in none)
    assert mixing.rate_table(nothing, labels, (0.5, 0.5)).count() == 0
    assert mixing.mixed_documents(nothing, labels, (0.5, 0.5)).count() == 0


def test_texts_without_tokens_keep_their_rate(spark, table):
    rows = [(i, None if i % 3 else "") for i in range(30)] + [(100 + i, f"good {i}") for i in range(40)] + [(200, "poor")]
    labels = spark.createDataFrame([(100 + i, 0) for i in range(40)] + [(200, 1)], "doc_id long, domain int")
    got = {r.doc_id: r for r in mixing.rate_table(table(rows), labels, (0.6, 0.4)).collect()}
    assert all(got[i].rate == 1 and got[i].copies == 1 for i in range(30))


def test_rare_domain_reaches_its_target(spark, caplog):
    """A hundredth of the target share beside a hot source needs rates far above 16."""
    p = np.array([[0.999, 0.001]] * 400 + [[0.02, 0.98]])
    n = np.full(401, 100)
    members = members_of(spark, n, 5 * n, p)
    fit = mixing.fit_rates(members, n.sum() * np.array([0.7, 0.3]))
    r = mixing.rates_of(n, 5 * n, p, fit.steps)
    assert (r >= 0).all() and r.max() > 100 and np.allclose((n * r) @ p / n.sum(), [0.7, 0.3], atol=1e-5)
    assert not caplog.records and fit.passes <= 40
    mixing.fit_rates(members, n.sum() * np.array([1.0, 0.0]))  # no rates reach it
    assert "of targets" in caplog.text
