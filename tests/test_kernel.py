import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from coweave.operators.fit import MatrixRows
from coweave.operators.kernel import solve
from coweave.params import SolverParams

from .matrices import THREE_A, THREE_B, ill_conditioned, small_norm, violation


def dense_fit(x, lambd, beta, max_iter=100_000, tol=1e-12):
    user, item = np.nonzero(x)
    m = MatrixRows(user, item, x[user, item], *x.shape)
    w, passes, done = np.zeros((x.shape[1],) * 2), [], []
    for i in range(x.shape[1]):
        at, values, n, ok = m.solve(i, SolverParams(lambd, beta, max_iter, tol))
        w[at, i] = values
        passes.append(n)
        done.append(ok)
    return w, passes, done


def test_three_items():
    w, _, _ = dense_fit(THREE_A, 0.1, 0.1)
    t = 1.9 / 3.1
    assert np.allclose(w, [[0, t, 0], [t, 0, t], [0, t, 0]])


@pytest.mark.parametrize(
    ("lambd", "beta", "expected"),
    [(0.5, 0.5, (3 / 7, 9 / 31, 15 / 31, 3 / 7)), (0.0, 0.5, (4 / 7, 12 / 31, 20 / 31, 4 / 7)), (0.5, 0.0, (0.5, 0.3, 0.6, 0.5))],
)
def test_three_items_with_a_lone_user(lambd, beta, expected):
    w, _, _ = dense_fit(THREE_B, lambd, beta)
    assert np.allclose((w[1, 0], w[0, 1], w[2, 1], w[1, 2]), expected)


def test_item_of_small_norm_is_solved():
    w, _, _ = dense_fit(small_norm(), 2.0, 0.5)
    assert w[1, 0] == pytest.approx(1 / 10.5)


def test_budget_and_flags():
    _, passes, done = dense_fit(ill_conditioned(), 0.1, 0.5, max_iter=3, tol=1e-9)
    assert not done[2] and passes[2] == 3
    _, passes, done = dense_fit(THREE_B, 0.5, 0.5, max_iter=7, tol=0.0)
    assert passes == [7, 7, 7] and not any(done)
    _, passes, done = dense_fit(THREE_B, 100.0, 0.5, max_iter=7, tol=0.0)
    assert passes == [0, 0, 0] and all(done)
    _, passes, done = dense_fit(THREE_B, 0.5, 0.5, max_iter=0)
    assert passes == [0, 0, 0] and not any(done)


def test_optimum_shares_twins():
    w, _, done = dense_fit(ill_conditioned(), 0.1, 0.5)
    assert all(done) and w[0, 2] == pytest.approx(w[1, 2])


def test_no_curvature_keeps_zero():
    w, _, done = dense_fit(np.array([[1e150, 1e-170]]), 0.0, 0.0)
    assert not w[:, 0].any() and all(done)


def test_entries_below_the_penalty_still_count():
    """P between two candidates may lie below lambd; the solve must see it."""
    x = np.array([[1, 1, 0], [1, 1, 0], [1, 0, 1], [1, 0, 1], [0, 1, 1]], float)
    w, _, _ = dense_fit(x, 1.5, 0.5)
    assert violation(x, w, 1.5, 0.5) < 1e-8


@settings(max_examples=40, deadline=None)
@given(
    x=st.integers(1, 7).flatmap(lambda n: st.integers(1, 6).flatmap(lambda m: st.lists(st.lists(st.sampled_from([0.0, 0.0, 0.0, 1.0, 2.0, 0.5]), min_size=m, max_size=m), min_size=n, max_size=n))),
    lambd=st.floats(0, 3),
    beta=st.floats(0.05, 3),
)
def test_any_small_matrix_is_solved_to_optimality(x, lambd, beta):
    x = np.array(x)
    w, passes, done = dense_fit(x, lambd, beta, tol=1e-10)
    assert all(done) and (w >= 0).all() and not np.diag(w).any()
    assert violation(x, w, lambd, beta) < 1e-6


def test_wide_problems_take_the_vector_path():
    rng = np.random.default_rng(3)
    x = (rng.random((80, 60)) < 0.3) * rng.uniform(0.5, 5, (80, 60))
    for lambd, beta in ((0.0, 0.5), (1.0, 2.0), (3.0, 0.5)):
        w, _, done = dense_fit(x, lambd, beta, tol=1e-10)
        assert all(done) and violation(x, w, lambd, beta) < 1e-6


def test_nothing_to_solve():
    w, passes, done = solve(np.empty(0), np.empty(0), lambda t: np.empty(0), 1.0, 1.0, 5, 1e-4)
    assert not len(w) and passes == 0 and done
