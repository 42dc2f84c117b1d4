from itertools import combinations
from math import comb, exp, log

import numpy as np
import pytest
from pyspark.sql import functions as F

from coweave.llm.overlap import contained, nearest_sets, overlaps
from coweave.llm.similar import HUB, band, depth_for, least_similarity, linked_sets, measured_depths, missed, similar_sets
from coweave.llm.surprise import cooccurrence, fit_null, log_tail, size_class


def memberships(spark, data, names="g bigint, e bigint"):
    return spark.createDataFrame(data, names)


def random_rows(seed=0, groups=60, items=25):
    rng = np.random.default_rng(seed)
    m = rng.random((groups, items)) < rng.uniform(0.05, 0.5, items)
    return [(int(a), int(b)) for a, b in zip(*np.nonzero(m), strict=True)], m


DIRTY = [(None, 1), (1, None), (None, None)]


@pytest.mark.parametrize("max_group", [256, 3])
def test_pair_counts_match_brute_force(spark, max_group):
    data, m = random_rows()
    df = memberships(spark, data + data[:50] + DIRTY).withColumn("n", F.lit(1)).withColumn("a", F.lit("clash"))
    found = cooccurrence(df, "g", "e", max_group=max_group)
    n = m.T.astype(int) @ m
    expected = {(i, j): (n[i, j], n[i, i], n[j, j]) for i, j in combinations(range(25), 2) if n[i, j]}
    got = found.pairs.collect()
    assert {(r.item_a, r.item_b): (r.n_ab, r.n_a, r.n_b) for r in got} == expected
    assert found.n_groups == (m.any(1)).sum()
    assert all(r.log_p <= 0 and 0 <= r.q_value <= 1 and r.expected > 0 for r in got)


@pytest.mark.parametrize(("least", "lift"), [(3, 0.0), (2, 1.2), (5, 1.5)])
def test_limits_drop_no_pair_that_meets_them(spark, least, lift):
    data, m = random_rows(1)
    n, groups = m.T.astype(int) @ m, m.any(1).sum()
    found = cooccurrence(memberships(spark, data), "g", "e", min_count=least, min_lift=lift).pairs
    expected = {(i, j) for i, j in combinations(range(25), 2) if n[i, j] >= least and n[i, j] * groups >= lift * n[i, i] * n[j, j]}
    assert {(r.item_a, r.item_b) for r in found.collect()} == expected


def test_empty_and_single(spark):
    assert cooccurrence(memberships(spark, []), "g", "e").pairs.count() == 0
    assert cooccurrence(memberships(spark, [(1, 1)]), "g", "e").pairs.count() == 0
    with pytest.raises(ValueError, match="min_count"):
        cooccurrence(memberships(spark, []), "g", "e", min_count=0)


def test_null_model_keeps_sizes():
    sizes = np.array([30.0, 5.0]), np.array([2.0, 9.0]), np.array([10.0, 3.0]), np.array([6.0, 15.0])
    null = fit_null(*sizes)
    p = null.chances(np.array([6, 15, 7, 35, 10**6]))
    assert null.met and not fit_null(*sizes, rounds=1).met
    assert np.allclose(10 * p[0] + 3 * p[1], [2, 9], rtol=1e-5) and np.allclose(p @ [30, 5], [6, 15, 7, 35, 35], rtol=1e-6)
    assert not fit_null(np.array([]), np.array([]), np.array([]), np.array([])).chances(np.array([])).size


def brute_surprise(m):
    """Expected counts and p-values of all pairs of columns by a plain fixed-point fit of one factor per row and column, and by convolution."""
    rows, cols = m.sum(1).astype(float), m.sum(0).astype(float)
    x, y = rows / np.sqrt(rows.sum()), cols / np.sqrt(cols.sum())
    for _ in range(20_000):
        x = rows / (y[None, :] / (1 + x[:, None] * y[None, :])).sum(1)
        y = cols / (x[:, None] / (1 + x[:, None] * y[None, :])).sum(0)
    p = x[:, None] * y[None, :] / (1 + x[:, None] * y[None, :])
    expected, tails = {}, {}
    for i, j in combinations(range(m.shape[1]), 2):
        flips, pmf = p[:, i] * p[:, j], np.ones(1)
        for f in flips:
            pmf = np.convolve(pmf, [1 - f, f])
        expected[i, j], tails[i, j] = flips.sum(), pmf[int((m[:, i] & m[:, j]).sum()) :].sum()
    return expected, tails


def test_expected_counts_and_tails_match_brute_force(spark):
    data, m = random_rows(5, 60, 14)
    m = m[m.any(1)]
    expected, tails = brute_surprise(m)
    found = cooccurrence(memberships(spark, data), "g", "e")
    assert found.fitted
    for r in found.pairs.collect():
        assert r.expected == pytest.approx(expected[r.item_a, r.item_b], rel=1e-6)
        assert r.log_p == pytest.approx(log(tails[r.item_a, r.item_b]), abs=1e-5)


def test_wide_classes_cost_little(spark, monkeypatch):
    """Classes 1 % wide from size 8 on instead of 256: far coarser than in production, where sizes are larger."""
    data, _ = random_rows(6, 300, 30)
    exact = {(r.item_a, r.item_b): r for r in cooccurrence(memberships(spark, data), "g", "e").pairs.collect()}
    monkeypatch.setattr("coweave.llm.surprise.EXACT_SIZES", 8)
    for r in cooccurrence(memberships(spark, data), "g", "e").pairs.collect():
        one = exact[r.item_a, r.item_b]
        assert r.expected == pytest.approx(one.expected, rel=1e-3) and r.log_p == pytest.approx(one.log_p, rel=2e-3, abs=2e-3)


def test_tails_match_exact_distributions():
    for n, q in ((50, 0.1), (400, 0.02), (30, 0.7)):
        for k in (0, 1, 5, 12, 30):
            exact = sum(comb(n, j) * q**j * (1 - q) ** (n - j) for j in range(k, n + 1))
            assert log_tail(np.array([float(n)]), np.array([[q]]), np.array([k]))[0] == pytest.approx(log(exact), abs=1e-6)
    sizes, q = np.array([3, 4, 2]), np.array([0.9, 0.2, 0.01])
    pmf = np.ones(1)
    for m, p in zip(sizes, q, strict=True):
        for _ in range(m):
            pmf = np.convolve(pmf, [1 - p, p])
    for k in range(1, 8):
        assert exp(log_tail(sizes.astype(float), q[None, :], np.array([k]))[0]) == pytest.approx(pmf[k:].sum(), rel=1e-6)
    assert log_tail(np.array([1000.0]), np.array([[1e-6]]), np.array([60]))[0] < -500  # far beyond what a double can hold


def test_planted_pair_is_the_most_surprising(spark):
    rng = np.random.default_rng(2)
    m = rng.random((400, 20)) < 0.05
    m[:25, 3] = m[:25, 4] = True
    data = [(int(a), int(b)) for a, b in zip(*np.nonzero(m), strict=True)]
    best = cooccurrence(memberships(spark, data), "g", "e").pairs.orderBy("log_p").first()
    assert (best.item_a, best.item_b) == (3, 4) and best.q_value < 1e-6


def test_size_classes_are_few_and_ordered(spark):
    df = spark.createDataFrame([(n,) for n in [1, 2, 256, 257, 300, 10**6, 10**12]], "n bigint")
    c = [r[0] for r in df.select(size_class(F.col("n"))).collect()]
    assert c == sorted(c) and c[:3] == [1, 2, 256] and c[-1] < 3000


@pytest.mark.parametrize("max_group", [256, 2])
@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_overlaps(spark, max_group, kind):
    rng = np.random.default_rng(3)
    sets = {f"s{k:02d}" if kind == "string" else k: set(rng.choice(80, rng.integers(1, 50), replace=False).tolist()) for k in range(12)}
    data = [(k, int(i)) for k, s in sets.items() for i in s]
    df = spark.createDataFrame(data + data[:40] + [(None, 3), (next(iter(sets)), None)], f"name {kind}, i bigint").withColumn("code", F.lit(0))
    found = overlaps(df, "name", "i", max_group=max_group)
    expected = {(a, b): (len(sets[a] & sets[b]), len(sets[a]), len(sets[b])) for a, b in combinations(sorted(sets), 2) if sets[a] & sets[b]}
    assert {(r.set_a, r.set_b): (r.shared, r.size_a, r.size_b) for r in found.collect()} == expected
    assert {(r.set_a, r.set_b) for r in contained(found, 3).collect()} == {k for k, (m, a, b) in expected.items() if 3 * m >= min(a, b)}
    near = nearest_sets(found, 2).collect()
    assert all(r.rank <= 2 for r in near) and len(near) <= 24
    assert overlaps(df.where("false"), "name", "i").count() == 0


def sets_with_copies(seed=4):
    """Random sets, noisy copies around similarity 0.6, exact copies, hubs in most sets, one set as large as all others."""
    rng = np.random.default_rng(seed)
    sets = {}
    for k in range(160):
        s = set(rng.choice(4000, rng.integers(3, 30), replace=False).tolist())
        s |= {h for h in (9001, 9002, 9003, 9004) if rng.random() < 0.5}
        sets[k] = s
    for k in range(60):
        s = set(sets[k])
        for _ in range(int(rng.integers(0, max(1, len(s) // 3) + 1))):
            s.discard(int(rng.choice(sorted(s))))
        sets[1000 + k] = s | set(rng.choice(range(5000, 8000), rng.integers(0, 3), replace=False).tolist())
    for k in range(8):
        sets[2000 + k] = set(sets[5])
    sets[3000], sets[3001] = set(range(3000)), set(range(100, 3100))
    sets[3002], sets[3003] = {9001, 9002, 9003, 9004, 1}, {9001, 9002, 9003, 9004, 2}
    return sets


@pytest.mark.parametrize("hub", [HUB, 20])
def test_similar_sets_match_brute_force(spark, hub, monkeypatch):
    sets = sets_with_copies()
    data = [(k, int(v)) for k, s in sets.items() for v in s]
    df = memberships(spark, data + data[:100] + DIRTY, "e bigint, v bigint").withColumn("n", F.lit(0))
    expected = {(a, b) for a, b in combinations(sorted(k for k, s in sets.items() if len(s) >= 5), 2) if 5 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b])}
    monkeypatch.setattr("coweave.llm.similar.TILE", 4)
    found = similar_sets(df, "e", "v", 0.6, min_size=5, hub=hub)
    assert {(r.a, r.b) for r in found.pairs().collect()} == expected
    per_set = {r.e: r for r in linked_sets(found).collect()}
    assert set(per_set) == {k for k, s in sets.items() if len(s) >= 5}
    assert all(per_set[2000 + k]["class"] == per_set[5]["class"] and per_set[2000 + k].copies == per_set[5].copies for k in range(8))
    both = {frozenset(p) for p in expected}
    for r in found.links.collect():
        assert frozenset((r.a, r.b)) in both and r.shared == len(sets[r.a] & sets[r.b])


def test_similar_sets_of_nothing(spark):
    assert similar_sets(memberships(spark, [], "e bigint, v bigint"), "e", "v").pairs().count() == 0
    assert similar_sets(memberships(spark, [(1, 1), (2, 5)], "e bigint, v bigint"), "e", "v").pairs().count() == 0


def test_depths_keep_the_recall():
    assert missed(0.6, depth_for(0.6), 40) <= 2e-4 and depth_for(0.6) == 3 and depth_for(0.05) == 0
    for n in range(5, 40):
        for hubs in range(1, n):
            s = least_similarity(n, hubs, 0.6, 5)
            for m in range(5, 2 * n):
                shared = -(-3 * (n + m) // 8)
                if shared <= min(n, m):  # a partner of size m that just reaches the threshold, all its hubs shared
                    common = min(hubs, shared)
                    rest = n + m - shared - common
                    assert not rest or s <= (shared - common) / rest + 1e-9


def test_prefixes_get_shorter_until_planted_partners_are_met():
    rng = np.random.default_rng(0)
    sets = [rng.integers(0, 2**40, 30) for _ in range(300)]
    depths = measured_depths({s: sets for s in (0.9, 0.6, 0.44, 0.3, 0.1)}, 40)
    assert depths == {0.9: 3, 0.6: 3, 0.44: 1, 0.3: 1, 0.1: 0} or depths == {0.9: 3, 0.6: 3, 0.44: 2, 0.3: 1, 0.1: 0}
    assert all(d <= depth_for(s) for s, d in depths.items())
    assert measured_depths({0.6: []}, 40) == {0.6: 3}  # nothing to measure: the formula alone
    assert band(0.6) == pytest.approx(0.6) and band(0.599) == pytest.approx(0.58)
