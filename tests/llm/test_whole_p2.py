import os
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from coweave.llm import plans
from coweave.llm.surprise import P_STEPS

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_surprise_covers_every_pair_with_a_common_user(spark):
    x = plans.counting_interactions(spark, FOLDER).distinct().toPandas()
    expected = Counter(p for _, items in x.groupby("user_id")["item_id"] for p in combinations(sorted(items), 2))
    found = plans.p2_surprise(spark, FOLDER).toPandas()
    assert {(r.item_a, r.item_b): r.n_ab for r in found.itertuples()} == expected
    assert found.n_ab.min() < 8
    # Benjamini-Hochberg over all pairs of items, those without a common user included
    p = np.exp(-np.floor(-found.log_p.clip(lower=-745.0) * P_STEPS) / P_STEPS)
    n = x.item_id.nunique()
    raw = p * n * (n - 1) / 2 / p.rank(method="max")
    q = np.array([min(1.0, raw[p >= one].min()) for one in p])
    assert np.allclose(found.q_value, q, rtol=1e-9)
