import warnings

import numpy as np
import pytest

from coweave import SLIM, ConvergenceWarning, NotFittedError, fit, fit_with_diagnostics
from coweave.operators.fit import objective, optimality, solve
from coweave.params import SolverParams
from coweave.sources.tables import from_coo, from_dense

from .matrices import THREE_B, TINY, ill_conditioned, violation


def weights(df, n):
    w = np.zeros((n, n))
    for r in df.collect():
        w[r.source, r.target] = r.weight
    return w


def random_matrix(users, items, density, seed, high=1.0):
    rng = np.random.default_rng(seed)
    return (rng.random((users, items)) < density) * (rng.uniform(0.5, high, (users, items)) if high > 1 else 1.0)


@pytest.mark.parametrize("strategy", ["broadcast", "blocked"])
def test_hand_computed(spark, strategy):
    x, _, items = from_dense(spark, THREE_B)
    w = weights(fit(x, 0.5, 0.5, tol=1e-12, items=items, strategy=strategy), 3)
    assert np.allclose((w[1, 0], w[0, 1], w[2, 1], w[1, 2]), (3 / 7, 9 / 31, 15 / 31, 3 / 7))


@pytest.mark.parametrize(("high", "lambd", "beta"), [(1.0, 1.0, 0.5), (5.0, 2.0, 2.0)])
def test_both_strategies_are_optimal_and_agree(spark, high, lambd, beta):
    m = random_matrix(60, 20, 0.2, 1, high)
    x, _, items = from_dense(spark, m)
    one = weights(fit(x, lambd, beta, 100_000, 1e-12, items=items, strategy="broadcast"), 20)
    two = weights(fit(x, lambd, beta, 100_000, 1e-12, items=items, strategy="blocked"), 20)
    assert violation(m, one, lambd, beta) < 1e-6 and np.allclose(one, two, atol=1e-9)
    found = optimality(x, fit(x, lambd, beta, 100_000, 1e-12, items=items), items, lambd, beta, integral=high == 1.0)
    assert found.where("violation > 1e-6").count() == 0 and found.count() == 20


@pytest.mark.parametrize(("cells", "wide"), [(1, 1), (30, 3), (200, 8), (10**6, 5)])
@pytest.mark.parametrize("high", [1.0, 5.0])
def test_blocks_of_any_size_and_wide_targets_reach_the_optimum(spark, cells, wide, high):
    """Targets of more candidates than ``wide`` are solved on a set that grows until nothing wants to enter."""
    m = random_matrix(60, 16, 0.3, 4, high)
    x, _, items = from_dense(spark, m)
    s = solve(x, SolverParams(1.0, 0.5, 100_000, 1e-12), items, "blocked", cells, wide)
    assert s.n_items == 16 and s.n_unconverged == 0
    assert violation(m, weights(s.weights, 16), 1.0, 0.5) < 1e-6
    assert np.allclose(weights(s.weights, 16), weights(fit(x, 1.0, 0.5, 100_000, 1e-12, items=items, strategy="broadcast"), 16), atol=1e-8)
    none = solve(x, SolverParams(1.0, 0.5, 0), items, "blocked", cells, wide)
    assert none.weights.count() == 0 and none.n_unconverged > 0


def test_objective(spark):
    x, _, items = from_dense(spark, TINY)
    df = fit(x, 0.3, 0.4, tol=1e-12, items=items)
    w = weights(df, 4)
    expected = 0.5 * ((TINY - TINY @ w) ** 2).sum(0) + 0.3 * w.sum(0) + 0.2 * (w**2).sum(0)
    found = {r.target: r.objective for r in objective(x, df, items, 0.3, 0.4).collect()}
    assert np.allclose([found[i] for i in range(4)], expected)


def test_partitioning_does_not_change_a_bit(spark, rows):
    x, _, items = from_dense(spark, random_matrix(120, 25, 0.15, 8, 4.0))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        results = []
        for parts in ("1", "4", "9"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            results.append(rows(fit(x.repartition(int(parts)), 1.0, 0.5, items=items)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1] == results[2]


def test_spellings_of_one_matrix(spark, rows):
    x, _, items = from_dense(spark, TINY)
    expected = rows(fit(x, 0.2, 0.2, items=items))
    user, item = np.nonzero(TINY)
    keep = user > 0
    messy = from_coo(spark, [0, 0, 0, 0, *user[keep]], [1, 0, 1, 3, *item[keep]], [0.5, 1, 0.5, 0, *np.ones(keep.sum())])
    assert rows(fit(messy, 0.2, 0.2, items=items)) == expected
    named = x.selectExpr("user as who", "item as what")
    assert rows(fit(named, 0.2, 0.2, user_col="who", item_col="what", value_col=None, items=items.toDF("what"))) == expected


@pytest.mark.parametrize("strategy", ["broadcast", "blocked"])
def test_text_keys(spark, strategy):
    x, _, _ = from_dense(spark, TINY)
    plain = weights(fit(x, 0.2, 0.2, tol=1e-10), 4)
    text = x.selectExpr("concat('u', user) as user", "concat('i', item) as item", "value")
    found = fit(text, 0.2, 0.2, tol=1e-10, strategy=strategy)
    w = np.zeros((4, 4))
    for r in found.collect():
        w[int(r.source[1:]), int(r.target[1:])] = r.weight
    assert np.allclose(w, plain)


@pytest.mark.parametrize("strategy", ["broadcast", "blocked"])
def test_dead_items_and_degenerate_shapes(spark, strategy):
    m = TINY.copy()
    m[2], m[:, 1] = 0, 0
    x, _, items = from_dense(spark, m)
    s = fit_with_diagnostics(x, 0.2, 0.2, items=items, strategy=strategy)
    assert s.n_items == 4 and s.weights.where("source = 1 or target = 1").count() == 0
    assert s.diagnostics.where("item = 1").first().converged
    for shape in ((3, 2), (1, 3)):
        x, _, items = from_dense(spark, np.zeros(shape))
        s = fit_with_diagnostics(x, items=items, strategy=strategy)
        assert s.n_items == shape[1] and s.weights.count() == 0


def test_warning_and_truncation(spark):
    x, _, items = from_dense(spark, ill_conditioned())
    with pytest.warns(ConvergenceWarning, match=r"of 4 items did not converge within max_iter=3") as caught:
        s = fit_with_diagnostics(x, 0.1, 0.5, 3, 1e-9, items=items)
    assert next(w for w in caught if w.category is ConvergenceWarning).filename == __file__
    assert s.diagnostics.where("item = 2").first().n_passes == 3
    with warnings.catch_warnings():
        warnings.simplefilter("error", ConvergenceWarning)
        assert fit(x, 1e9, 0.5, 0, items=items).count() == 0


def test_bad_input(spark):
    x = from_coo(spark, [0, 0], [0, 1], [1, -1])
    with pytest.raises(ValueError, match="non-negative"):
        fit(x)
    with pytest.raises(ValueError, match="overflow"):
        fit(from_coo(spark, [0, 0], [0, 1], [1e200, 1e200]))
    with pytest.raises(ValueError, match="not among the given items"):
        fit(from_coo(spark, [0], [3]), items=from_coo(spark, [0], [1]).select("item"))
    with pytest.raises(ValueError, match="strategy"):
        fit(from_coo(spark, [0], [3]), strategy="guess")
    with pytest.raises(TypeError, match="max_iter"):
        fit(from_coo(spark, [0], [3]), max_iter=1.5)


def test_estimator(spark, rows):
    model = SLIM(lambd=0.2, beta=0.2)
    assert repr(model) == "SLIM(lambd=0.2, beta=0.2)" and eval(repr(model)).get_params() == model.get_params()
    assert model.set_params(tol=1e-8) is model and model.get_params()["tol"] == 1e-8
    with pytest.raises(ValueError, match="no setting alpha; its settings are lambd, beta, max_iter, tol, n_threads"):
        model.set_params(alpha=1)
    x, _, items = from_dense(spark, TINY)
    for error in (NotFittedError, ValueError, AttributeError):
        with pytest.raises(error, match="not fitted"):
            model.predict(x)
    assert model.fit(x, None, items=items) is model and model.n_items == 4
    assert rows(model.weights) == rows(fit(x, 0.2, 0.2, tol=1e-8, items=items))
    assert model.recommend(x, 2).count() == 12
    assert model.predict(x).where("score = '-Infinity'").count() == 0
    assert model.converged.where("converged").count() == 4 and model.n_passes.where("n_passes >= 1").count() == 4
    model.lambd = 1e9
    assert model.fit(x).weights.count() == 0
    bad = SLIM(lambd=-1)
    with pytest.raises(ValueError, match="lambd"):
        bad.fit(x)
