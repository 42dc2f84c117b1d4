import numpy as np
import pytest
from pyspark.sql import functions as F

from coweave.operators.gram import candidates, diagonal, gram, gram_row, off_diagonal, refuse_overflow
from coweave.operators.interactions import as_interactions, binarise, canonical, check_values, holdout_split, item_universe, settled, transpose, user_universe
from coweave.sources.tables import from_csr, from_dense, markdown, read_interactions, synthetic, write_result

from .matrices import TINY


def frame(spark, data):
    return spark.createDataFrame(data, "user bigint, item bigint, value double")


def test_cells_are_summed_and_zeros_dropped(spark, rows):
    x = canonical(frame(spark, [(0, 1, 0.6), (0, 0, 1.0), (0, 1, 0.4), (0, 3, 0.0), (1, 1, 2.0)]))
    assert rows(x) == [(0, 0, 1.0), (0, 1, 1.0), (1, 1, 2.0)]
    assert rows(canonical(frame(spark, []))) == []


def test_values_are_checked_before_they_are_summed(spark):
    with pytest.raises(ValueError, match="non-negative.*user 0 has -1.0 for item 1"):
        canonical(frame(spark, [(0, 1, -1.0), (0, 1, 2.0)]))
    with pytest.raises(ValueError, match="non-negative.*user 0 has -1.0 for item 1"):
        settled(frame(spark, [(0, 1, -1.0), (0, 1, 2.0)]))
    for bad in ("nan", "inf", "-inf"):
        for check in (check_values, settled):
            with pytest.raises(ValueError, match=f"finite values.*user 0 has {bad} for item 1"):
                check(frame(spark, [(0, 1, float(bad)), (0, 1, 1.0), (1, 1, -1.0)]))
    for check in (check_values, settled):
        for row in ((None, 1, 1.0), (1, None, 1.0), (1, 1, None)):
            with pytest.raises(ValueError, match="null ids or values, but 1 do"):
                check(frame(spark, [row, (2, 2, -1.0), (1, 1, 1.0)]))
    with pytest.raises(ValueError, match="not found"):
        as_interactions(frame(spark, []), item="thing")


def test_sums_do_not_depend_on_partitioning(spark):
    data = [(0, 0, float(np.sin(k)) + 1.5) for k in range(200)]
    sums = {canonical(frame(spark, data).repartition(n)).first().value for n in (1, 2, 7)}
    assert len(sums) == 1


@pytest.mark.parametrize("signed", [False, True])
def test_one_pass_gives_the_same_cells_and_facts(spark, rows, signed):
    rng = np.random.default_rng(3)
    for whole in (True, False):
        values = rng.integers(0, 4, 60).astype(float) if whole else np.round(rng.uniform(0, 3, 60), 3)
        values = values * rng.choice([-1, 1], 60) if signed else values
        df = frame(spark, [(int(u), int(i), float(v)) for u, i, v in zip(rng.integers(0, 6, 60), rng.integers(0, 6, 60), values, strict=True)])
        x, facts = settled(df, signed=signed)
        plain = check_values(df, signed=signed)
        assert (facts.rows, facts.integral) == (plain.rows, plain.integral) == (60, whole)
        expected = {}
        for r in df.collect():
            expected[r.user, r.item] = expected.get((r.user, r.item), 0) + r.value
        got = {(r.user, r.item): r.value for r in x.collect()}
        assert got == pytest.approx({c: v for c, v in expected.items() if c in got}) and all(abs(v) < 1e-12 for c, v in expected.items() if c not in got)
    assert settled(frame(spark, []))[0].count() == 0


def test_names_universe_and_views(spark, rows):
    df = spark.createDataFrame([("u", "i", "x")], "who string, what string, value string")
    assert rows(as_interactions(df, "who", "what", None)) == [("u", "i", 1.0)]
    x, users, items = from_dense(spark, TINY)
    assert item_universe(x, items).count() == 4 and user_universe(x, users).count() == 6
    assert rows(binarise(frame(spark, [(0, 0, 3.0), (0, 1, 0.0)]))) == [(0, 0, 1.0)]
    assert rows(transpose(x)) == rows(x)
    train, test = holdout_split(x)
    assert train.count() + test.count() == x.count()


def dense_gram(x):
    p = x.T @ x
    return sorted((i, j, p[i, j]) for i in range(len(p)) for j in range(len(p)) if p[i, j])


def test_gram_matches_dense(spark, rows):
    x, _, _ = from_dense(spark, TINY)
    assert rows(gram(x)) == dense_gram(TINY)
    assert rows(gram(x, max_group=1)) == dense_gram(TINY)  # every larger user in tiles
    assert rows(diagonal(gram(x))) == [(i, float(v)) for i, v in enumerate(TINY.sum(0))]
    assert off_diagonal(gram(x)).where("item = neighbor").count() == 0
    assert [r.neighbor for r in gram_row(gram(x), 3).collect()] == [0, 1, 2]
    assert candidates(gram(x), 2.0).where("p < 2").count() == 0


@pytest.mark.parametrize(("block", "least", "max_group"), [(2, 1, 6), (5, 4, 9), (64, 3, 1), (64, 1, 99)])
def test_tiles_of_any_size_agree(spark, rows, block, least, max_group):
    from coweave.operators.copairs import pair_products

    rng = np.random.default_rng(1)
    m = (rng.random((40, 23)) < 0.4) * rng.integers(1, 5, (40, 23))
    x, _, _ = from_dense(spark, m)
    found = pair_products(x, "user", "item", "value", diagonal=True, min_count=least, max_group=max_group, block=block)
    p, n = m.T @ m, (m > 0).T.astype(int) @ (m > 0)
    assert rows(found) == sorted(((i, j, float(p[i, j]), n[i, j]) for i in range(23) for j in range(i, 23) if n[i, j] >= least), key=repr)


@pytest.mark.parametrize(("block", "work", "dense"), [(2, 1, 1), (4, 10, 3), (64, 20, 1), (8, 10**8, 64)])
def test_divided_tiles_and_sparse_blocks_agree(spark, monkeypatch, block, work, dense):
    """A few large groups with popular elements; tiles are divided among tasks by group, fractional values included."""
    from coweave.operators import copairs

    monkeypatch.setattr(copairs, "DENSE_FROM", dense)
    rng = np.random.default_rng(2)
    m = (rng.random((50, 30)) < np.linspace(0.9, 0.05, 30)) * np.round(rng.uniform(0.1, 3, (50, 30)), 2)
    x, _, _ = from_dense(spark, m)
    p, n = m.T @ m, (m > 0).T.astype(int) @ (m > 0)
    results = []
    for parts in (1, 5):
        found = copairs.pair_products(x.repartition(parts), "user", "item", "value", integral=False, max_group=6, block=block, work=work)
        results.append({(r.a, r.b): (r.s, r.n) for r in found.collect()})
    assert results[0] == results[1]
    assert {k: v[1] for k, v in results[0].items()} == {(i, j): n[i, j] for i in range(30) for j in range(i + 1, 30) if n[i, j]}
    assert all(v[0] == pytest.approx(p[k]) for k, v in results[0].items())


def test_gram_of_unsorted_rows_with_gaps(spark, rows):
    x, users, items = from_csr(spark, [1, 2, 0.5, 1, 1, 3], [0, 1, 0, 2, 1, 0], [0, 3, 3, 5, 6], 4)
    x = canonical(x)
    assert users.count() == 4 and items.count() == 4
    assert {r.item: r.p for r in diagonal(gram(x, integral=False)).collect()} == {0: 11.25, 1: 5.0, 2: 1.0}
    assert [r.neighbor for r in gram_row(gram(x, integral=False), 0).collect()] == [1]


def test_products_that_vanish_are_not_stored(spark):
    x, _, _ = from_csr(spark, [1, 0, 2, 1, 1e-200, 1e-200, 3], [0, 1, 2, 0, 3, 4, 2], [0, 3, 6, 7], 5)
    p = off_diagonal(gram(canonical(x), integral=False))
    assert sorted((r.item, r.neighbor) for r in p.collect()) == [(0, 2), (0, 3), (0, 4), (2, 0), (3, 0), (4, 0)]


def test_overflow():
    with pytest.raises(ValueError, match="overflow"):
        refuse_overflow(float("inf"))
    refuse_overflow(1e300)
    refuse_overflow(None)


def test_sources(spark, tmp_path, rows):
    for data, indices, indptr in (([1], [0], [1, 1]), ([1], [5], [0, 1]), ([1], [0], [0, 2]), ([1, 1], [0, 0], [0, 2, 1])):
        with pytest.raises(ValueError, match="indptr|indices"):
            from_csr(spark, data, indices, indptr, 2)
    for n_items in (-1, 2**31):
        with pytest.raises(ValueError, match="outside the sizes"):
            from_csr(spark, [], [], [0], n_items)
    with pytest.raises(ValueError, match="2-D"):
        from_dense(spark, [1, 2])
    path = str(tmp_path / "x")
    write_result(frame(spark, [(0, 0, 5.0), (0, 1, 0.0)]), path)
    assert rows(read_interactions(spark, path, positive_only=True)) == [(0, 0, 1.0)]
    s = synthetic(spark, 50, 20, 5)
    assert s.count() == 250 and s.agg(F.max("item")).first()[0] < 20
    assert markdown([{"a": 1, "b": 0.5}]) == "| a | b |\n| --- | --- |\n| 1 | 0.5000 |" and markdown([]) == ""
