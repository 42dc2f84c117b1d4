import pytest
from pyspark.sql import functions as F

from coweave.functions.sums import running_offsets
from coweave.operators.skew import chunk_by_key, count_state, first_state, heavy_keys, last_state, max_state, min_state, sum_state, totals_by_key


def table(spark, data):
    return spark.createDataFrame(data, "k string, id bigint, v bigint")


def skewed():
    """One key of a third of all rows, many small ones, a null key, repeated rows."""
    data = [("hot", i, i % 7) for i in range(300)] + [(f"k{i % 200}", i, 1) for i in range(590)]
    return data + [(None, 1, 1), ("dup", 5, 2), ("dup", 5, 2), ("nulls", None, None)]


@pytest.mark.parametrize("chunk_rows", [1, 7, 100, None])
def test_totals_match_a_plain_aggregate(spark, rows, chunk_rows):
    df = table(spark, skewed()).withColumn("k2", F.lit("extra"))
    states = [count_state("n"), count_state("odd", F.col("v") % 2 == 1), sum_state("s", F.col("v")), min_state("lo", F.col("id")), max_state("hi", F.col("id"))]
    found = totals_by_key(df, "k", ["id", "v"], states, chunk_rows)
    plain = df.where("k is not null").groupBy("k").agg(F.count("*"), F.count_if(F.col("v") % 2 == 1), F.sum("v"), F.min("id"), F.max("id"))
    assert rows(found) == rows(plain)


def test_positions_are_exact_and_chunks_equal(spark):
    c = chunk_by_key(table(spark, skewed()), "k", ["id", "v"], chunk_rows=50)
    got = c.rows.collect()
    assert sorted(r._pos for r in got) == list(range(c.n_rows)) and c.n_rows == len(skewed()) - 1
    sizes = {}
    for r in got:
        sizes[r._chunk] = sizes.get(r._chunk, 0) + 1
        assert r._start <= r._pos < r._start + r._n
    assert all(n == 50 for k, n in sizes.items() if k != max(sizes))


def test_first_and_last_follow_positions(spark):
    df = table(spark, skewed())
    c = chunk_by_key(df, "k", ["id", "v"], chunk_rows=20)
    expected = {}
    for r in sorted(c.rows.collect(), key=lambda r: r._pos):
        expected.setdefault(r.k, [r.id, None])[1] = r.id
    from coweave.operators.skew import aggregate_chunks

    found = aggregate_chunks(c, [first_state("a", F.col("id")), last_state("b", F.col("id"))])
    assert {r.k: [r.a, r.b] for r in found.collect()} == expected


def test_equal_chunks_are_worked_on_as_a_whole(spark):
    """The longest run of equal values per key: runs go on over chunk borders, so states are merged in order."""
    import pyarrow as pa

    from coweave.operators.skew import apply_chunks

    df = table(spark, [("hot", i, (i // 25) % 2) for i in range(300)] + [(f"k{i % 20}", i, 1) for i in range(100)]).coalesce(1)
    c = chunk_by_key(df, "k", ["id"], chunk_rows=37)

    def runs(t):
        k, v, n = t.column("k").to_pylist(), t.column("v").to_pylist(), []
        for a, b in zip(k, v, strict=True):
            if n and n[-1][:2] == (a, b):
                n[-1] = (a, b, n[-1][2] + 1)
            else:
                n.append((a, b, 1))
        chunk = t.column("_chunk")[0].as_py()
        assert t.num_rows == 37 or chunk == 400 // 37
        return pa.table({"c": [chunk] * len(n), "i": list(range(len(n))), "k": [x[0] for x in n], "v": [x[1] for x in n], "n": [x[2] for x in n]})

    longest, last = {}, (None, None, 0)
    for r in sorted(apply_chunks(c, runs, "c bigint, i bigint, k string, v bigint, n bigint").collect(), key=lambda r: (r.c, r.i)):
        last = (r.k, r.v, r.n + (last[2] if last[:2] == (r.k, r.v) else 0))
        longest[r.k] = max(longest.get(r.k, 0), last[2])
    assert longest == {"hot": 25} | {f"k{i}": 5 for i in range(20)}


def test_heavy_keys_and_empty_tables(spark, rows):
    df = table(spark, skewed())
    assert rows(heavy_keys(df, "k", ["id", "v"], 4)) == [("hot", 300)]
    empty = table(spark, [])
    assert rows(heavy_keys(empty, "k", ["id"], 2)) == []
    assert totals_by_key(empty, "k", ["id"], [count_state("n")]).count() == 0
    with pytest.raises(ValueError, match="_pos"):
        chunk_by_key(df.withColumn("_pos", F.lit(1)), "k", ["id"])


def test_running_offsets(spark):
    df = spark.range(500).select(F.col("id").alias("a"), (F.col("id") % 3 + 1).alias("n"))
    got = sorted((r.at, r.n) for r in running_offsets(df, ["a"], "n", "at").collect())
    total = 0
    for at, n in got:
        assert at == total
        total += n
