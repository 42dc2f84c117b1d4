from itertools import combinations

import numpy as np
import pytest

from coweave.llm.similar import similar_sets


@pytest.mark.parametrize(("threshold", "trees"), [(0.3, 40), (0.5, 40), (0.6, 10)])
def test_sets_of_popular_values_are_found_at_any_threshold(spark, threshold, trees):
    rng = np.random.default_rng(7)
    sets = {k: {*rng.choice(40, 12, replace=False).tolist(), 1000 + k} for k in range(150)}
    for k in range(60):  # near copies
        sets[500 + k] = {*rng.permutation(sorted(sets[k] - {1000 + k}))[:9].tolist(), *rng.choice(40, 2).tolist(), 2000 + k}
    df = spark.createDataFrame([(k, int(v)) for k, s in sets.items() for v in s], "e bigint, v bigint")
    expected = {(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9}
    found = {(r.a, r.b) for r in similar_sets(df, "e", "v", threshold, trees=trees, hub=20).pairs().collect()}
    assert found <= expected and len(expected - found) <= len(expected) / 5000


def test_threshold_too_low_for_the_trees_is_refused(spark):
    df = spark.createDataFrame([(1, 1), (2, 1)], "e bigint, v bigint")
    for threshold, trees in ((0.15, 40), (0.3, 5)):
        with pytest.raises(ValueError, match="too low"):
            similar_sets(df, "e", "v", threshold, trees=trees)


def test_partners_that_just_reach_the_threshold_are_found_at_any_share_of_popular_values(spark):
    rng = np.random.default_rng(3)
    popular, sets, pairs, fresh, e = np.arange(1, 61), {}, [], iter(range(10**4, 10**7)), 0
    new = lambda n: [next(fresh) for _ in range(n)]
    for share in (0.0, 0.5, 0.9):
        for size in (5, 12, 40):
            for _ in range(30):
                held = int(round(size * share))
                one = rng.choice(popular, held, replace=False).tolist() + new(size - held)
                common = -(-2 * size * 6 // 16)  # shared values of two sets of this size at similarity 0.6
                sets[e], sets[e + 1] = one, one[:common] + new(size - common)  # popular values are shared first
                pairs.append((e, e + 1))
                e += 2
    for _ in range(400):
        sets[e] = rng.choice(popular, 20, replace=False).tolist() + new(30)
        e += 1
    df = spark.createDataFrame([(k, int(v)) for k, s in sets.items() for v in s], "e bigint, v bigint")
    found = similar_sets(df, "e", "v", 0.6, min_size=5, hub=40)
    linked = {(r.a, r.b) for r in found.pairs().collect()}
    assert len(set(pairs) - linked) <= 1
