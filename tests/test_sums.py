from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from coweave.functions.shared import shared_folder
from coweave.functions.sums import exact_sum, limbs, numbered


def test_exact_sums_are_the_rounded_true_sum_at_any_partitioning(spark):
    rng = np.random.default_rng(0)
    data = [(int(k), float(v)) for k, v in zip(rng.integers(0, 5, 400), rng.uniform(-1, 1, 400) * 10.0 ** rng.integers(-4, 4, 400), strict=True)]
    sizes = [abs(v) for _, v in data]
    layout = limbs(max(sizes), min(sizes), len(data))
    df = spark.createDataFrame(data, "k bigint, v double")
    results = [{r.k: r.s for r in exact_sum(df.repartition(n), ["k"], F.col("v"), layout, "s").collect()} for n in (1, 3, 8)]
    assert results[0] == results[1] == results[2]
    for k in range(5):
        true = sum((Fraction(v) for j, v in data if j == k), Fraction(0))
        assert results[0][k] == pytest.approx(float(true), rel=1e-15)


def test_a_single_term_comes_back_bit_for_bit(spark):
    values = [0.1, -3.7e8, 2.0**-30, 1.0, 123456.789]
    df = spark.createDataFrame(list(enumerate(values)), "k bigint, v double")
    found = exact_sum(df, ["k"], F.col("v"), limbs(3.7e8, 2.0**-30, 5), "s").collect()
    assert {r.k: r.s for r in found} == dict(enumerate(values))


def test_ranges_that_limbs_cannot_hold_are_refused():
    assert limbs(1e300, 1e-300, 10) is None and limbs(1.0, 0.0, 10) is None and limbs(1.0, 1e-3, 2**70) is None
    assert limbs(0.0, 0.0, 0) is not None


def test_numbers_ascend_over_partitions_and_ties(spark):
    df = spark.createDataFrame([(int(k % 7),) for k in range(100)] + [(None,)], "k int").repartition(6)
    got = sorted((r["no"], -1 if r["k"] is None else r["k"]) for r in numbered(df, ["k"], "no").collect())
    assert [n for n, _ in got] == list(range(101)) and [k for _, k in got] == sorted(k for _, k in got)


class Session:
    """As much of a session as `shared_folder` looks at."""

    def __init__(self, master, folder=None):
        self.settings = {"spark.checkpoint.dir": folder} if folder else {}
        self.conf, self.sparkContext, self.master = self, self, master

    def get(self, name, default):
        return self.settings.get(name, default)

    def set(self, name, value):
        self.settings[name] = value


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[3,2,1024]", "k8s://https://host"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session(master))
    assert shared_folder(Session(master, "hdfs://x/shared/")) == "hdfs://x/shared"


def test_one_machine_gets_a_folder_of_its_own():
    for master in ("local", "local[4]", "local[*]"):
        s = Session(master)
        assert shared_folder(s).startswith("file://") and s.settings["spark.checkpoint.dir"] == shared_folder(s)


def test_tables_of_a_scope_are_deleted_at_its_end(spark):
    from pathlib import Path

    from coweave.functions.shared import scope, written

    outside = written(spark.range(3), "kept")
    with scope(spark):
        inside = written(spark.range(5), "dropped")
        with scope(spark):
            inner = written(spark.range(7), "inner").inputFiles()
        assert inside.count() == 5 and inner and not any(Path(f.removeprefix("file://")).exists() for f in inner)
        files = inside.inputFiles()
    assert files and not any(Path(f.removeprefix("file://")).exists() for f in files)
    assert outside.count() == 3
