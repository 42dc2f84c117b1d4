import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from coweave.llm.packing import best_fit_decreasing, lower_bound, pack
from coweave.llm.topn import top_n


def best(data, n, positive):
    groups = {}
    for g, i, v in data:
        if g is None or i is None or v is None or not np.isfinite(v) or (positive and v <= 0):
            continue
        groups.setdefault(g, {})
        groups[g][i] = max(v, groups[g].get(i, v))
    return sorted((g, i, v, k + 1) for g, s in groups.items() for k, (i, v) in enumerate(sorted(s.items(), key=lambda x: (-x[1], x[0]))[:n]))


def weights():
    rng = np.random.default_rng(0)
    data = [(7, int(i), float(v)) for i, v in zip(rng.integers(0, 5000, 3000), rng.integers(0, 9, 3000) / 8, strict=True)]
    data += [(int(g), int(i), float(v)) for g, i, v in zip(rng.integers(100, 400, 2000), rng.integers(0, 30, 2000), rng.integers(-2, 5, 2000) / 4, strict=True)]
    return data + [(1, 1, None), (1, 2, float("nan")), (1, 3, float("inf")), (None, 1, 1.0), (2, None, 1.0), (3, 1, 0.0), (9, 1, 0.5), (9, 1, 0.25), (9, 2, 0.5)]


@pytest.mark.parametrize(("parts", "n", "positive"), [("1", 10, True), ("3", 10, True), ("11", 3, False), ("40", 1, True)])
def test_top_n_matches_brute_force(spark, rows, parts, n, positive):
    df = spark.createDataFrame(weights(), "grp bigint, item bigint, w double").withColumn("g", F.lit("clash")).withColumn("position", F.lit(1))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        assert sorted(tuple(r) for r in top_n(df, "grp", "item", "w", n, positive=positive).collect()) == best(weights(), n, positive)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_top_n_of_text_groups_and_nothing(spark, rows):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 1.0), ("b", "x", 0.5)], "g string, i string, v double")
    assert rows(top_n(df, "g", "i", "v", 1)) == [("a", "x", 1.0, 1), ("b", "x", 0.5, 1)]
    assert rows(top_n(df.where("false"), "g", "i", "v")) == []
    with pytest.raises(ValueError, match="n must be"):
        top_n(df, "g", "i", "v", 0)


def fewest(sizes, capacity):
    """Exact number of containers, by search."""
    sizes = sorted(sizes, reverse=True)
    most = [len(sizes)]

    def place(k, rooms):
        if len(rooms) >= most[0]:
            return
        if k == len(sizes):
            most[0] = len(rooms)
            return
        for r in {*rooms}:
            if r >= sizes[k]:
                left = list(rooms)
                left.remove(r)
                place(k + 1, [*left, r - sizes[k]])
        place(k + 1, [*rooms, capacity - sizes[k]])

    place(0, [])
    return most[0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=8))
def test_bound_never_exceeds_the_optimum(sizes):
    x, n = np.unique(sizes, return_counts=True)
    bins, filled = best_fit_decreasing(np.array(sizes), 20)
    assert lower_bound(x, n, 20) <= fewest(sizes, 20) <= len(filled)
    assert filled.max() <= 20 and filled.sum() == sum(sizes)
    assert all(filled[b] == sum(s for s, c in zip(sizes, bins, strict=True) if c == b) for b in range(len(filled)))


@pytest.mark.parametrize("per_part", [7, 50, 100_000])
def test_packing_keeps_every_token_once(spark, per_part):
    rng = np.random.default_rng(1)
    sizes = [int(s) for s in rng.integers(0, 90, 300)] + [0, 100, 200, 355, 10_000, 99, 1]
    df = spark.createDataFrame([(k, s) for k, s in enumerate(sizes)] + [(5, 42), (777, None), (None, 3)], "doc_id bigint, n_tokens bigint").withColumn("bin", F.lit("clash"))
    p = pack(df, capacity=100, partition_pieces=per_part)
    got = p.pieces.collect()
    assert p.pieces.columns == ["doc_id", "piece", "container", "tok_start", "tok_stop"]
    total = sum(sizes) + 42 + 3
    filled = {}
    for r in got:
        if r.container is None:
            assert r.tok_start == r.tok_stop == 0
        else:
            filled[r.container] = filled.get(r.container, 0) + r.tok_stop - r.tok_start
    assert sum(filled.values()) == total == p.tokens and max(filled.values()) <= 100
    assert len(filled) == p.containers >= p.bound
    spans = {}
    for r in got:
        spans.setdefault(r.doc_id, []).append((r.tok_start, r.tok_stop, r.piece))
    for k, s in enumerate(sizes):
        if k != 5:
            parts = sorted(spans[k])
            assert [x[2] for x in parts] == list(range(len(parts))) and parts[0][0] == 0 and parts[-1][1] == s
            assert all(a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False)) and len(parts) == max(1, -(-s // 100))
    assert len(spans[5]) == 2 and len(spans[777]) == 1
    assert p.containers <= 1.1 * p.bound + 1


def test_packing_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id bigint, n_tokens bigint")
    p = pack(df)
    assert (p.containers, p.bound, p.tokens) == (0, 0, 0) and p.pieces.count() == 0
    p = pack(spark.createDataFrame([(1, 0)], "doc_id bigint, n_tokens bigint"))
    assert p.containers == 0 and p.pieces.first().container is None
    with pytest.raises(ValueError, match="capacity"):
        pack(df, capacity=0)
