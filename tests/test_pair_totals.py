import itertools

import numpy as np
import pytest

from coweave.operators import pair_totals
from coweave.operators.pair_totals import totals_by_shared
from coweave.plans import core


def weight(a, b):
    return (a % 7 * 2.0) + b % 5


def by_hand(cells):
    held, out = {}, {}
    for g, e, v in cells:
        held.setdefault(e, {})[g] = v
    for a, b in itertools.combinations(sorted(held), 2):
        both = held[a].keys() & held[b].keys()
        if both:
            s = sum(held[a][g] * held[b][g] for g in both)
            old = out.get(len(both), (0, 0.0, 0.0))
            out[len(both)] = old[0] + 1, old[1] + s, old[2] + s * float(weight(np.int64(a), np.int64(b)))
    return sorted((n, *x) for n, x in out.items())


def drawn(scale, share=0.6):
    rng = np.random.default_rng(5)
    ids = rng.choice(np.arange(-400, 4000), 150, replace=False)
    return [(g * 9 - 20, int(e), float(rng.integers(0, 4) * scale)) for g in range(8) for e in ids if rng.random() < share]


@pytest.mark.parametrize("scale, chunk, band", [(1, 2048, 16), (1, 16, 3), (1, 70, 1), (500, 16, 2), (40_000, 64, 1)])
@pytest.mark.parametrize("kind", [np.float64, np.uint8])
def test_totals_are_those_of_single_pairs(spark, rows, monkeypatch, scale, chunk, band, kind):
    """One chunk and many, whole bands and cut ones, sums that fit a histogram, a short float and a long one; values of 0 count as shared."""
    monkeypatch.setattr(pair_totals, "pair_products", None)  # all of it takes the dense way
    cells = drawn(scale)
    x = spark.createDataFrame(cells, "g bigint, e bigint, v double").repartition(5)
    assert rows(totals_by_shared(x, "g", "e", "v", lambda a, b: weight(a, b).astype(kind), chunk=chunk, band=band)) == sorted(by_hand(cells), key=repr)


@pytest.mark.parametrize("change", [lambda v: v - 1, lambda v: v / 2])
def test_other_values_take_the_way_of_pairs(spark, rows, change):
    cells = [(g, e, change(v)) for g, e, v in drawn(1)]
    x = spark.createDataFrame(cells, "g bigint, e bigint, v double")
    assert rows(totals_by_shared(x, "g", "e", "v", weight)) == sorted(by_hand(cells), key=repr)


def test_rows_without_ids_and_empty_tables(spark, rows):
    cells = drawn(1)
    x = spark.createDataFrame([*cells, (None, 3, 1.0), (4, None, 1.0)], "g bigint, e bigint, v double")
    assert rows(totals_by_shared(x, "g", "e", "v", weight)) == sorted(by_hand(cells), key=repr)
    assert rows(totals_by_shared(x.where("false"), "g", "e", "v", weight)) == []


def test_mixed_weights():
    a, b = np.arange(-300, 500, dtype=np.int64)[:, None], np.arange(10**12, 10**12 + 250)[None, :]
    assert (core._mixed(a, b) == (31 * a + b) % 101).all()


def test_pairs_of_large_groups_are_not_shuffled(spark, tmp_path):
    """25 nations of which each has most of 1,500 parts: 1.1 M pairs, of which only totals leave a task."""
    n = 1500
    spark.range(n * 2).selectExpr("id as o_orderkey", "id % 50 as o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(n * 30).selectExpr(f"id % {n * 2} as l_orderkey", f"cast(rand(7) * {n} as bigint) as l_partkey", "1 as l_suppkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(50).selectExpr("id as c_custkey", "cast(id % 25 as int) as c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    store = spark.sparkContext._jsc.sc().statusStore()

    def shuffled():
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {stages.apply(k).stageId(): stages.apply(k).shuffleWriteRecords() for k in range(stages.size())}

    before = shuffled()
    pairs = sum(r["pairs"] for r in core.gram_large_groups(spark, str(tmp_path)).collect())
    assert pairs > 1_000_000
    assert sum(v for k, v in shuffled().items() if k not in before) < 300_000
