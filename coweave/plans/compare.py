"""Fits, ranks and measures on one data set, next to a matrix factorisation: ``python -m coweave.plans.compare --data synthetic``.

The table goes to stdout, progress to stderr.
"""

from __future__ import annotations

import argparse
import json
import resource
import sys
import time
from collections.abc import Callable

from pyspark.ml.recommendation import ALS
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import ship, written
from ..metrics import evaluate
from ..operators.fit import solve
from ..operators.interactions import binarise, random_split, settled
from ..operators.score import recommend, top_k, unseen
from ..params import SolverParams, setting
from ..sources.tables import markdown, synthetic
from .core import counted, counting_interactions

DATA: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "parts": lambda spark, folder: counted(spark, folder, "part"),
    "brands": lambda spark, folder: counted(spark, folder, "brand"),
    "interactions": lambda spark, folder: counting_interactions(spark, folder).select(F.col("user_id").alias("user"), F.col("item_id").alias("item"), F.lit(1.0).alias("value")),
    "synthetic": lambda spark, folder: synthetic(spark),
}


def factorised(train: DataFrame, k: int, factors: int, passes: int, seed: int) -> DataFrame:
    """(user, item, score): up to k best unseen items by implicit alternating least squares."""
    x = train.select(F.col("user").cast("int"), F.col("item").cast("int"), F.col("value").cast("float"))
    model = ALS(rank=factors, maxIter=passes, regParam=0.01, implicitPrefs=True, userCol="user", itemCol="item", ratingCol="value", seed=seed).fit(x)
    # k items remain once a user's own are taken out; users are asked for in classes of doubling history length
    sizes = written(train.groupBy("user").agg(F.ceil(F.log2(F.count(F.lit(1)))).cast("int").alias("c")), "history-sizes")
    classes = [r.c for r in sizes.select("c").distinct().orderBy("c").collect()]  # some thirty at most
    scores = None
    for c in classes:
        users = sizes.where(F.col("c") == c).select(F.col("user").cast("int"))
        found = model.recommendForUserSubset(users, k + 2**c).select("user", F.explode("recommendations").alias("r"))
        found = found.select(F.col("user").cast("bigint").alias("user"), F.col("r.item").cast("bigint").alias("item"), F.col("r.rating").cast("double").alias("score"))
        scores = found if scores is None else scores.unionByName(found)
    if scores is None:
        scores = train.select("user", "item", F.lit(0.0).alias("score"))
    return top_k(unseen(scores, train), k).drop("rank")  # scores, as a user may have fewer than k left


def _heap_peak(spark: SparkSession, reset: bool = False) -> float:
    """MB of the JVM's heap pools at their peak since the last reset; in local mode this takes in the executors."""
    pools = spark._jvm.java.lang.management.ManagementFactory.getMemoryPoolMXBeans()
    heap = [p for p in pools if p.getType().toString() == "Heap memory"]
    peak = sum(p.getPeakUsage().getUsed() for p in heap) / 2**20
    if reset:
        for p in heap:
            p.resetPeakUsage()
    return peak


def compare(x: DataFrame, params: SolverParams, k: int = 10, seed: int = 42, baseline: bool = True, factors: int = 64) -> list[dict]:
    """One row per model: seconds of fit and ranking, metrics on a fifth held out, memory, and what the fit left.

    Both models get ``params.max_iter`` passes. Every user with a held-out item counts, those without training rows included.
    """
    spark = x.sparkSession
    train, test = (written(side, "split") for side in random_split(binarise(settled(x)[0]), 0.8, seed))
    users = test.select("user").distinct()
    rows = []

    def measured(name: str, fit: Callable[[], dict], rank: Callable[[], DataFrame]) -> None:
        resident = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
        _heap_peak(spark, reset=True)
        began = time.perf_counter()
        facts = fit()
        fitted = time.perf_counter()
        ranked = written(rank(), "ranked")
        ready = time.perf_counter()
        m = evaluate(ranked, test, k).first()
        grown = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024 - resident
        memory = {"driver process MB": resident + grown, "of it grown": grown, "JVM heap peak MB": _heap_peak(spark)}
        rows.append({"model": name, "fit s": fitted - began, "rank s": ready - fitted, f"precision@{k}": m.precision_at_k, f"recall@{k}": m.recall_at_k, f"ndcg@{k}": m.ndcg_at_k} | memory | facts)
        print(f"{name}: fitted in {fitted - began:.1f} s, ranked in {ready - fitted:.1f} s", file=sys.stderr)

    held: dict = {}

    def sparse() -> dict:
        s = held["s"] = solve(train, params)
        w = s.weights.agg(F.count(F.lit(1)).alias("n")).first().n
        passes = s.diagnostics.agg(F.median("n_passes").alias("m")).first().m
        return {"weights": w, "unconverged": s.n_unconverged, "median passes": passes}

    def dense() -> dict:
        held["a"] = written(factorised(train, k, factors, params.max_iter, seed), "als")
        return {"weights": "", "unconverged": "", "median passes": params.max_iter}

    measured("sparse linear", sparse, lambda: recommend(held["s"].weights, train, k, users=users))
    if baseline:
        measured("alternating least squares", dense, lambda: held["a"])
    return rows


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--data", choices=sorted(DATA), default="synthetic")
    p.add_argument("--folder", default="/root/testdata/sf0.01", help="folder of Parquet tables")
    for name, kind, default in (("lambd", float, 2.0), ("beta", float, 2.0), ("max-iter", int, 50), ("tol", float, 1e-6), ("k", int, 10), ("seed", int, 42), ("factors", int, 64)):
        p.add_argument(f"--{name}", type=kind, default=default)
    p.add_argument("--no-baseline", action="store_true")
    p.add_argument("--threads", type=int, help="run on one machine with so many threads")
    p.add_argument("--output", choices=("markdown", "json"), default="markdown")
    o = p.parse_args(args)
    builder = SparkSession.builder
    spark = (builder.master(f"local[{setting('n_threads', o.threads)}]") if o.threads is not None else builder).getOrCreate()
    ship(spark)
    params = SolverParams(o.lambd, o.beta, o.max_iter, o.tol)
    rows = compare(DATA[o.data](spark, o.folder), params, o.k, o.seed, not o.no_baseline, o.factors)
    print(json.dumps(rows) if o.output == "json" else markdown(rows))


if __name__ == "__main__":
    main()
