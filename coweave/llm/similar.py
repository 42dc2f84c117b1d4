"""All similar pairs between set-valued records: sorted sketch forests, then an exact check.

Each set gets, in each of many independent trees, a signature of three minhash values. The signatures are sorted by
(tree, first value, second, third), so sets whose signatures begin alike lie side by side. Neighbourhoods of a common prefix
are compared along this order, those of the longest prefix first, and a set takes part down to the prefix at which its
pairs are found with the target recall. That depth is measured: partners that just reach the least similarity a true
partner can have are planted for a bounded sample of sets, and prefixes get shorter until enough of them are met.

Values that very many sets hold ("hubs") would put unrelated sets side by side. Sketches are drawn from the other values,
and a set's least similarity there follows from its size and its number of hubs; only sets so full of hubs that
nothing can be promised go to a second forest over all their values. So no value and no prefix brings more than HUB sets
together in the first forest; neighbourhoods of the second are spread over tasks in tiles. Exact copies are sketched once
and put back at the end. There is no cap on neighbourhoods or candidates, and every candidate is checked exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.joins import BROADCAST_ROWS, broadcast_if_small, spread_join
from ..functions.shared import written
from ..operators.score import parallel

TREES = 40
DEPTH = 3
RECALL = 0.9998
#: A value held by more sets than this is a hub.
HUB = 256
#: Sets of a prefix neighbourhood of the second forest beyond which it is compared in tiles.
TILE = 512
#: Sets that partners are planted for, and the most values of such a set.
SAMPLE = 2000
SAMPLE_VALUES = 400
#: Width of the bands of least similarity that depths are measured for.
BAND = 0.02


def missed(similarity: float, depth: int, trees: int) -> float:
    """Chance that no tree brings two sets of this similarity to a common prefix of this depth."""
    return (1.0 - similarity**depth) ** trees


def depth_for(similarity: float, trees: int = TREES, recall: float = RECALL) -> int:
    """Deepest prefix (up to DEPTH) that still reaches the recall; 0 if none does."""
    return max((d for d in range(1, DEPTH + 1) if missed(similarity, d, trees) <= 1.0 - recall), default=0)


@lru_cache(maxsize=100_000)
def least_similarity(n: int, hubs: int, threshold: float, min_size: int) -> float:
    """Least Jaccard similarity without hubs of a set (size ``n``, of it ``hubs`` hubs) to any set it is similar to.

    A partner of size m shares at least t/(1+t) (n+m) values, at most ``hubs`` of them hubs. The worst m is searched for small
    sets; for large ones the union is at least n, which gives a bound that rounding hardly changes.
    """
    if not hubs:
        return threshold
    if n > 200:
        return max(0.0, (threshold * n - hubs) / (n - hubs)) if n > hubs else 0.0
    worst = threshold
    for m in range(max(min_size, ceil(threshold * n - 1e-9)), int(n / threshold + 1e-9) + 1):
        shared = ceil(threshold / (1.0 + threshold) * (n + m) - 1e-9)
        if shared <= min(n, m):
            rest, union = shared - hubs, n + m - shared - hubs
            worst = min(worst, rest / union if rest > 0 else 0.0)
    return worst


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 bits of each value, well spread (the finaliser of splitmix64)."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashes(trees: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20240229)
    count = trees * DEPTH
    return draw.integers(1, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1), draw.integers(0, 2**63, count, dtype=np.uint64)


_NOTHING = np.uint32(0xFFFFFFFF)


def _minima(values: np.ndarray, use: np.ndarray, starts: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Per run of rows (``starts``) and hash, the smallest 32-bit hash of the values in use."""
    x = _mixed(values)
    out = np.empty((len(starts), len(a)), dtype=np.uint32)
    with np.errstate(over="ignore"):
        for k in range(len(a)):
            h = ((x * a[k] + b[k]) >> np.uint64(32)).astype(np.uint32)
            h[~use] = _NOTHING
            out[:, k] = np.minimum.reduceat(h, starts)
    return out


def _packed(minima: np.ndarray) -> np.ndarray:
    """Three values of a tree in 64 bits: 32 of the first, 16 of each other."""
    m = minima.reshape(len(minima), -1, DEPTH).astype(np.uint64)
    return (m[:, :, 0] << np.uint64(32)) | ((m[:, :, 1] & np.uint64(0xFFFF)) << np.uint64(16)) | (m[:, :, 2] & np.uint64(0xFFFF))


def _prefix(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Common leading values (0 to 3) of packed signatures."""
    different = x ^ y
    return (different >> np.uint64(32) == 0).astype(np.int64) * (1 + (different >> np.uint64(16) == 0) * (1 + (different == 0).astype(np.int64)))


def band(least: float) -> float:
    """The lower end of the band that a least similarity falls into."""
    return int(least / BAND + 1e-9) * BAND


def measured_depths(samples: dict[float, list[np.ndarray]], trees: int, recall: float = RECALL) -> dict[float, int]:
    """Depth per band: the deepest prefix at which planted partners are met with the target recall, never deeper than the formula allows.

    For each sampled set a partner of the same size is made up that shares as few values as the band's lower end
    allows. The share of trees in which the two agree on a prefix, less three standard errors, gives the recall of the
    forest. Starting from the whole signature the prefix gets shorter until that meets the target; 0 if it never does.
    """
    a, b = _hashes(trees)
    depths = {}
    for least, sets in samples.items():
        draw = np.random.default_rng(7)
        limit = depth_for(least, trees, recall)
        depths[least] = limit
        pairs = []
        for values in sets:
            n = len(values)
            common = ceil(2 * n * least / (1 + least) - 1e-9)
            if 0 < common <= n:
                fresh = draw.integers(-(2**62), 2**62, n - common)
                pairs.append((values, np.r_[draw.permutation(values)[:common], fresh]))
        if not limit or not pairs:
            continue
        both = []
        for side in (0, 1):
            flat = np.concatenate([p[side] for p in pairs])
            starts = np.r_[0, np.cumsum([len(p[side]) for p in pairs])[:-1]]
            both.append(_packed(_minima(flat, np.ones(len(flat), bool), starts, a, b)))
        common = _prefix(*both)
        for depth in range(DEPTH, -1, -1):
            share = float((common >= depth).mean())
            sure = max(0.0, share - 3 * np.sqrt(share * (1 - share) / common.size))
            if not depth or (depth <= limit and 1 - (1 - sure) ** trees >= recall):
                depths[least] = depth
                break
    return depths


_RAW = "e bigint, salt int, n bigint, hubs bigint, rare binary, every binary"


def _pieces(sets: DataFrame, trees: int) -> DataFrame:
    """Sketch minima per run of rows of equal (e, salt) in ``sets`` (e, salt, v, hub), read in the order they were written in: a set may give several pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _hashes(trees)
        held: tuple | None = None  # the run that may go on in the next batch

        def merged(x: tuple, y: tuple) -> tuple:
            return (x[0], x[1], x[2] + y[2], x[3] + y[3], np.minimum(x[4], y[4]), np.minimum(x[5], y[5]))

        def out(rows: list[tuple]) -> pa.RecordBatch:
            cols = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64()))]
            cols += [pa.array([r[4].tobytes() for r in rows], pa.binary()), pa.array([r[5].tobytes() if r[3] else None for r in rows], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=["e", "salt", "n", "hubs", "rare", "every"])

        for batch in batches:
            if not batch.num_rows:
                continue
            e, salt, v, hub = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            hub = hub.astype(bool)
            starts = np.r_[0, np.flatnonzero((np.diff(e) != 0) | (np.diff(salt) != 0)) + 1]
            rare = _minima(v, ~hub, starts, a, b)
            every = rare.copy()
            with_hub = np.flatnonzero(hub)
            if len(with_hub):
                of = np.searchsorted(starts, with_hub, side="right") - 1
                first = np.r_[0, np.flatnonzero(np.diff(of)) + 1]
                every[of[first]] = np.minimum(every[of[first]], _minima(v[with_hub], np.ones(len(with_hub), bool), first, a, b))
            n = np.diff(np.r_[starts, len(e)])
            hubs = np.add.reduceat(hub.astype(np.int64), starts)
            rows = [(int(e[s]), int(salt[s]), int(n[k]), int(hubs[k]), rare[k], every[k]) for k, s in enumerate(starts)]
            if held is not None:
                if held[:2] == rows[0][:2]:
                    rows[0] = merged(held, rows[0])
                else:
                    rows.insert(0, held)
            held = rows.pop()
            if rows:
                yield out(rows)
        if held is not None:
            yield out([held])

    return sets.mapInArrow(run, _RAW)


def sketches(sets: DataFrame, trees: int = TREES) -> DataFrame:
    """(e, n, hubs, rare, every) of the sets in rows (e, salt, v, hub), from written pieces; those of a set that has several are merged."""
    pieces = written(_pieces(sets, trees), "pieces")
    several = written(pieces.groupBy("e").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > 1).select("e"), "several")
    n_several = several.count()

    def merge(t: pa.Table) -> pa.Table:
        width = len(t.column("rare")[0].as_py())
        low = lambda blobs: np.frombuffer(b"".join(blobs), np.uint32).reshape(-1, width // 4).min(axis=0).tobytes()
        rare = t.column("rare").to_pylist()
        every = [x or r for x, r in zip(t.column("every").to_pylist(), rare, strict=True)]
        n, hubs = (sum(t.column(c).to_pylist()) for c in ("n", "hubs"))
        return pa.table({"e": t.column("e").slice(0, 1), "salt": pa.array([0], pa.int32()), "n": [n], "hubs": [hubs], "rare": [low(rare)], "every": [low(every) if hubs else None]}, schema=t.schema)

    if not n_several:
        return pieces.drop("salt")
    several = broadcast_if_small(several, n_several)
    joint = written(pieces.join(several, "e", "left_semi").groupBy("e").applyInArrow(merge, _RAW), "joint")
    return pieces.join(several, "e", "left_anti").unionByName(joint).drop("salt")


def _sampled_depths(found: DataFrame, sets: DataFrame, threshold: float, min_size: int, trees: int) -> dict[float, int]:
    """Measured depths of the bands of least similarity that occur, from a bounded sample of sets: those of smallest hash."""
    sizes = found.groupBy("n", "hubs").agg(F.count(F.lit(1)).alias("m"))
    kind = sizes.where(F.col("n") <= SAMPLE_VALUES).orderBy(F.xxhash64("n", "hubs")).limit(SAMPLE)  # kinds of sets, so that rare bands are met too
    some = found.join(F.broadcast(kind.select("n", "hubs")), ["n", "hubs"], "left_semi").orderBy(F.xxhash64("e"), "e").limit(SAMPLE).select("e", "n", "hubs")
    # at most SAMPLE sets of SAMPLE_VALUES values
    rows = sets.join(F.broadcast(some), "e").groupBy("e", "n", "hubs").agg(F.collect_list(F.when(~F.col("hub"), F.col("v"))).alias("v")).orderBy("e").collect()
    samples: dict[float, list[np.ndarray]] = {band(threshold): []}
    for r in rows:
        values = np.array(r.v, dtype=np.int64)
        samples[band(threshold)].append(values)
        samples.setdefault(band(least_similarity(r.n, r.hubs, threshold, min_size)), []).append(values)
    return measured_depths(samples, trees)


def _forest(found: DataFrame, depths: dict[float, int], threshold: float, min_size: int, trees: int, second: bool) -> DataFrame:
    """(k, prefix, rest, e, n, depth): a set's place in each tree of the first or the ``second`` forest. k is the tree and the first value; rest holds the other two.

    ``prefix`` is 0 in the first forest; in the second it is ``rest`` down to the depth used there, as nothing shorter is compared.
    """
    full_depth = depths[band(threshold)]
    beyond = np.uint64(2 ** (16 * (DEPTH - full_depth)) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def place(e: np.ndarray, n: np.ndarray, depth: np.ndarray, packed: np.ndarray) -> pa.RecordBatch:
            """All rows of these sets; a tree without value (a set of hubs alone) has no place for them."""
            some = (packed >> np.uint64(32)) != np.uint64(0xFFFFFFFF) if not second else np.ones(packed.shape, bool)
            tree = np.arange(trees, dtype=np.uint64)[None, :] + np.uint64(trees if second else 0)
            k = (tree << np.uint64(32)) | (packed >> np.uint64(32))
            rest = packed & np.uint64(0xFFFFFFFF)
            prefix = rest & ~beyond if second else np.zeros_like(rest)
            whole = lambda x: x[some].astype(np.uint32).view(np.int32)
            wide = lambda x: np.repeat(x, trees).reshape(len(x), trees)[some]
            cols = [k[some].view(np.int64), whole(prefix), whole(rest), wide(e), wide(n), wide(depth).astype(np.int32)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["k", "prefix", "rest", "e", "n", "depth"])

        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                e, n, hubs, rare, every = batch.slice(lo, 1000).columns
                least = [least_similarity(x, h, threshold, min_size) for x, h in zip(n.to_pylist(), hubs.to_pylist(), strict=True)]
                depth = np.array([depths[band(s)] if band(s) in depths else depth_for(band(s), trees) for s in least])
                signature = lambda blobs: _packed(np.frombuffer(b"".join(blobs), np.uint32).reshape(len(blobs), -1))
                names, sizes = e.to_numpy(), n.to_numpy()
                if not second:
                    yield place(names, sizes, np.maximum(depth, 1), signature(rare.to_pylist()))
                    continue
                lost = np.flatnonzero(depth == 0)
                if len(lost):
                    yield place(names[lost], sizes[lost], np.full(len(lost), full_depth), signature([every[int(k)].as_py() for k in lost]))

    # a set without hubs is never in the second forest
    return (found.where(F.col("hubs") > 0) if second else found).select("e", "n", "hubs", "rare", "every").mapInArrow(run, "k bigint, prefix int, rest int, e bigint, n bigint, depth int")


def _neighbours(first: DataFrame, second: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b: sets in one prefix neighbourhood of the depth that both need, of sizes that allow the threshold.

    The forests are sorted over all tasks by (tree, first value, other values); sets of one first value, or in the written ``second`` forest
    of one prefix, are in one task.
    """
    parts = parallel(first.sparkSession)
    crowded = second.groupBy("k", "prefix").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > TILE)
    crowded = written(crowded.select("k", "prefix", F.ceil(F.col("m") / TILE).cast("int").alias("tiles")), "crowded")
    n_crowded = crowded.count()
    whole = lambda rows: rows.withColumn("tile", F.lit(0)).withColumn("side", F.lit(0))
    divided = whole(second)
    if n_crowded:
        marked = second.join(broadcast_if_small(crowded, n_crowded), ["k", "prefix"], "left")
        own = F.pmod(F.xxhash64("e"), F.col("tiles")).cast("int")
        marked = marked.withColumn("own", F.coalesce(own, F.lit(0))).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("tiles"), F.lit(1)) - 1)))
        # a tile holds two blocks of about TILE sets; pairs inside a block belong to the tile of that block alone
        low, high = F.least("own", "other"), F.greatest("own", "other")
        number = low * F.coalesce("tiles", F.lit(1)) + high
        divided = marked.withColumn("tile", number.cast("int")).withColumn("side", F.when(low == high, 0).otherwise(F.when(F.col("own") == low, 1).otherwise(2)))
    columns = ("k", "prefix", "tile", "rest", "e", "n", "depth", "side")
    rows = whole(first).select(*columns).unionByName(divided.select(*columns))
    ordered = rows.repartitionByRange(parts, "k", "prefix", "tile").sortWithinPartitions("k", "prefix", "tile", "rest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None  # rows of the neighbourhood that may go on in the next batch

        def pairs(cols: list[np.ndarray], ends: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Rows at a growing distance in the order are compared, as long as they share their first value."""
            _, _, _, rest, e, n, depth, side = cols
            rest = rest.view(np.uint32)
            at, distance = np.arange(len(e)), 1
            while len(at := at[at + distance < ends[at]]):
                x, y = at, at + distance
                different = rest[x] ^ rest[y]
                common = 1 + (different < 65536) * (1 + (different == 0).astype(np.int64))
                keep = (common >= np.maximum(depth[x], depth[y])) & (n[x] >= threshold * n[y] - 1e-9) & (n[y] >= threshold * n[x] - 1e-9)
                keep &= (side[x] != side[y]) | (side[x] == 0)
                if keep.any():
                    a, b = e[x[keep]], e[y[keep]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])
                distance += 1

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy() for c in range(8)]
            if held is not None:
                cols = [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)]
            cuts = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0) | (np.diff(cols[2]) != 0)) + 1
            done = int(cuts[-1]) if len(cuts) else 0
            held = [c[done:] for c in cols]
            if done:
                starts = np.r_[0, cuts[:-1]]
                yield from pairs([c[:done] for c in cols], np.repeat(cuts, np.diff(np.r_[starts, done])))
        if held is not None and len(held[0]):
            yield from pairs(held, np.full(len(held[0]), len(held[0])))

    return ordered.mapInArrow(run, "a bigint, b bigint").distinct()


@dataclass(frozen=True)
class SimilarSets:
    """``classes``: (e, class) of every set large enough, the class being the smallest of its exact copies; ``copies``: (class, m) of classes with
    several; ``links``: (a, b, shared, similarity) between classes, a < b."""

    classes: DataFrame
    copies: DataFrame
    links: DataFrame

    def pairs(self) -> DataFrame:
        """(a, b), a < b: all similar pairs of sets, copies put back."""
        one = self.links.select(F.col("a").alias("ca"), F.col("b").alias("cb"))
        # a class and itself: its copies are similar to each other
        one = one.unionByName(self.copies.select(F.col("class").alias("ca"), F.col("class").alias("cb")))
        parts = parallel(one.sparkSession)
        hot = self.copies.where(F.col("m") > 1000)  # the members of a large class are spread over tasks
        left = self.classes.select(F.col("class").alias("ca"), F.col("e").alias("x"))
        right = self.classes.select(F.col("class").alias("cb"), F.col("e").alias("y"))
        some = spread_join(left, one, ["ca"], hot.select(F.col("class").alias("ca")), ["x"], parts)
        full = spread_join(right, some, ["cb"], hot.select(F.col("class").alias("cb")), ["y"], parts)
        full = full.where((F.col("ca") != F.col("cb")) | (F.col("x") < F.col("y")))
        return full.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def similar_sets(rows: DataFrame, element: str, value: str, threshold: float = 0.6, *, min_size: int = 1, trees: int = TREES, hub: int = HUB) -> SimilarSets:
    """Sets (``element``) whose ``value``s have Jaccard similarity of at least ``threshold``.

    Both columns are bigint; nulls in either are left out, repeated rows count once, other columns are ignored, an empty
    table gives nothing. Sets of fewer than ``min_size`` values do not take part. Every returned link is checked
    exactly; a true one is missed with a chance of at most 1 in 5,000 at the threshold itself, far less above it. A threshold
    too low for that in this number of trees (below about 0.21 in 40) is a ValueError.
    """
    if not depth_for(band(threshold), trees):
        raise ValueError(f"threshold {threshold} is too low for a recall of {RECALL} in {trees} trees")
    base = rows.select(F.col(element).alias("e"), F.col(value).alias("v")).where(F.col("e").isNotNull() & F.col("v").isNotNull())
    spark = base.sparkSession
    parts = parallel(spark)
    # one shuffle lays the values of a set side by side and drops repeated rows; the values of a hot set are spread
    counts = written(base.groupBy("e").agg(F.count(F.lit(1)).alias("m")), "row-counts")
    total = counts.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("m")).first().m
    hot = counts.where(F.col("m") > max(1000, total // (4 * parts))).select("e", F.lit(True).alias("hot"))  # at most 4 * parts sets
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("v"), F.lit(parts))).otherwise(F.lit(0)).cast("int").alias("salt")
    laid = base.join(F.broadcast(hot), "e", "left").select("e", salt, "v").repartition(parts, "e", "salt")
    base = written(laid.dropDuplicates(["e", "salt", "v"]).sortWithinPartitions("e", "salt", "v"), "memberships")
    # the copies of a set agree in size and in two 64-bit checksums
    print_ = base.groupBy("e").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("v")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "v")).alias("y"))
    print_ = written(print_.where(F.col("n") >= min_size), "prints")
    kinds = print_.groupBy("n", "x", "y").agg(F.min("e").alias("class"), F.count(F.lit(1)).alias("m"))
    several = written(kinds.where(F.col("m") > 1), "copies")
    n_several = several.count()
    if n_several <= BROADCAST_ROWS:
        marked = print_.join(F.broadcast(several), ["n", "x", "y"], "left")
    else:
        marked = spread_join(print_, several, ["n", "x", "y"], several.where(F.col("m") > 100_000), ["e"], parts, "left")
    classes = written(marked.select("e", F.coalesce("class", "e").alias("class"), "n"), "classes")
    singles = classes.where(F.col("e") == F.col("class")).select("e", "n")
    n_singles = singles.count()

    if n_singles <= BROADCAST_ROWS:
        kept = base.join(F.broadcast(singles.select("e")), "e", "left_semi")
    else:
        kept = spread_join(base, singles.select("e"), ["e"], singles.where(F.col("n") > 100_000), ["v"], parts)
    popular = written(kept.groupBy("v").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > hub), "hubs")
    n_popular = popular.count()
    flag = popular.select("v", F.lit(True).alias("hub"))
    if n_popular <= BROADCAST_ROWS:
        sets = kept.join(F.broadcast(flag), "v", "left")
    else:
        sets = spread_join(kept, flag, ["v"], popular.where(F.col("m") > 100_000), ["e"], parts, "left")
    sets = sets.select("e", "salt", "v", F.coalesce("hub", F.lit(False)).alias("hub"))
    if max(n_singles, n_popular) > BROADCAST_ROWS:  # the joins above have moved rows
        sets = sets.repartition(parts, "e", "salt").sortWithinPartitions("e", "salt")

    found = sketches(sets, trees)
    depths = _sampled_depths(found, sets, threshold, min_size, trees)
    first, second = (_forest(found, depths, threshold, min_size, trees, one) for one in (False, True))
    pairs = written(_neighbours(first, written(second, "second-forest"), threshold), "candidates")

    # exact check: the values of the smaller set, looked up in the larger one
    sized = lambda x: broadcast_if_small(singles, n_singles).select(F.col("e").alias(x), F.col("n").alias(f"n{x}"))
    todo = pairs.join(sized("a"), "a").join(sized("b"), "b")
    swap = F.col("na") > F.col("nb")
    todo = todo.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("e"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("other"), (F.col("na") + F.col("nb")).alias("sum"))
    wanted = todo.select("e").union(todo.select("other")).distinct()
    values = base.select("e", "v").join(wanted, "e", "left_semi")
    hot = singles.where(F.col("n") > 100_000).select("e")
    lookup = spread_join(values, todo, ["e"], hot, ["v"], parts).select("e", "v", "other", "sum")
    there = values.select(F.col("e").alias("other"), "v")
    shared = lookup.join(there, ["other", "v"]).groupBy("e", "other", "sum").agg(F.count(F.lit(1)).alias("shared"))
    similarity = F.col("shared") / (F.col("sum") - F.col("shared"))
    exact = F.col("shared") >= F.lit(threshold) * (F.col("sum") - F.col("shared")) - 1e-9
    links = shared.where(exact).select(F.least("e", "other").alias("a"), F.greatest("e", "other").alias("b"), "shared", similarity.alias("similarity"))
    return SimilarSets(classes.select("e", "class"), several.select("class", "m"), links)


def linked_sets(found: SimilarSets) -> DataFrame:
    """(e, class, copies, links): one row per set, with its exact copies (itself included) and its class's links to other classes."""
    ends = found.links.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("links"))
    out = found.classes.join(found.copies, "class", "left").join(ends, "class", "left")
    return out.select("e", "class", F.coalesce("m", F.lit(1)).alias("copies"), F.coalesce("links", F.lit(0)).alias("links"))
