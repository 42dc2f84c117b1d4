"""Reading level of documents: several grade estimates of the article, put on the raters' scale, their median, and cuts through it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import written
from .legibility import FORMULAS, FUNCTION_CELLS, FUNCTION_WORDS, Counts, Reader, grades, pieces_of
from .lines import LineModel, describe, learned

#: Most rated documents that the scale is fitted on, and most of them that words of articles and other matter are learned from;
#: the documents of smallest hash are taken. Words are learned from documents of at most LINE_CHARS characters.
FIT_DOCUMENTS = 20_000
LINE_DOCUMENTS = 4_000
LINE_CHARS = 20_000
#: Articles of fewer words get no level.
LEAST_WORDS = 40
LEVELS = (1, 2, 3, 4, 5)
#: Rated documents of a language from which it has a scale of its own.
OWN_SCALE = 30

_MEASURES = "language string, words bigint, sentences bigint, syllables bigint, polysyllables bigint, letters bigint"


def measures(df: DataFrame, text: str = "text", key: str = "doc_id", lines: LineModel | None = None) -> DataFrame:
    """(key, language, words, sentences, syllables, polysyllables, letters) of the article of every row. No shuffle.

    Headings, adverts, lists and rubbish are left out as ``lines`` tells them. A text that is null, empty or without article
    has zeros. Rows are kept as they are, repeated ones included; other columns are not read.
    """
    shared = df.sparkSession.sparkContext.broadcast(lines)  # one number per cell of words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for batch in batches:
            counts = reader.all_counts(batch.column(1).to_pylist())
            cols = [pa.array([getattr(c, f) for c in counts], pa.string() if f == "language" else pa.int64()) for f in Counts.__dataclass_fields__]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=[key, *Counts.__dataclass_fields__])

    slim = df.select(key, F.col(text).cast("string").alias("_text"))
    return slim.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, {_MEASURES}")


@dataclass(frozen=True)
class Scale:
    """What is fitted to ratings: ``lines``, which tells articles from other matter; per language the slope and offset that put each
    formula's grade on the raters' scale; and per language the median from which a level (2, 3, 4, 5) is reached."""

    lines: LineModel = field(default_factory=lambda: LineModel(FUNCTION_CELLS))
    slopes: dict[str, list[tuple[float, float]]] = field(default_factory=dict)
    cuts: dict[tuple[str, int], float] = field(default_factory=dict)

    def median(self, language: str, estimates: np.ndarray) -> np.ndarray:
        """Median of the grade estimates on the raters' scale; one row of estimates per article."""
        lines = np.array(self.slopes[language])
        return np.median(estimates * lines[:, 0] + lines[:, 1], axis=1)


def _divide(x: np.ndarray, above: np.ndarray) -> float:
    """The value that parts ``x`` with fewest errors; of several the middle one. Ratings of one kind are all on one side."""
    if not len(x) or above.all() or not above.any():
        return -np.inf if len(x) and above.all() else np.inf
    order = np.argsort(x, kind="stable")
    x, z = x[order], above[order]
    errors = np.r_[0, np.cumsum(z)] + np.r_[np.cumsum(~z[::-1])[::-1], 0]  # the first k lie below
    between = np.r_[True, np.diff(x) > 0, True]  # equal values are on one side
    at = np.r_[x[0] - 1, (x[1:] + x[:-1]) / 2, x[-1] + 1][between]
    best = at[errors[between] == errors[between].min()]
    return float((best.min() + best.max()) / 2)


def fit_scale(language: np.ndarray, estimates: np.ndarray, level: np.ndarray, lines: LineModel | None = None) -> Scale:
    """The scale from rated articles. A language of fewer than OWN_SCALE of them has the scale of all languages together."""
    scale = Scale(lines or LineModel(FUNCTION_CELLS))
    for g in FUNCTION_WORDS:
        own = language == g
        used = own if own.sum() >= OWN_SCALE else np.ones(len(level), dtype=bool)
        y = level[used].astype(np.float64)
        scale.slopes[g] = []
        for k in range(len(FORMULAS)):
            x = estimates[used, k]
            spread = float(((x - x.mean()) ** 2).sum()) if len(x) else 0.0
            slope = float(((x - x.mean()) * (y - y.mean())).sum()) / spread if spread > 1e-9 else 0.0
            scale.slopes[g].append((slope, float(y.mean() - slope * x.mean()) if len(x) else 0.0))
        middle = scale.median(g, estimates[used]) if len(y) else np.empty(0)
        for cut in LEVELS[1:]:
            scale.cuts[g, cut] = _divide(middle, y >= cut)
    return scale


def learn_lines(texts: list[str | None], has_article: list[bool]) -> LineModel:
    """What tells articles from other matter, from texts of which it is known whether they have an article."""
    pages = [pieces_of(t) if t else [] for t in texts]
    return learned(describe(pages, FUNCTION_CELLS), np.array(has_article, dtype=bool), FUNCTION_CELLS)


def learn_scale(documents: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", most: int = FIT_DOCUMENTS) -> Scale:
    """Fits the scale on at most ``most`` rated documents, those of smallest hash, whatever the size of the corpus.

    A null level says that a document has no article. Ratings without key, or outside 1..5, do not count; all others of a
    document do. Of a repeated document the smallest text counts. Without usable ratings no document gets a level above 1.
    """
    usable = F.col(key).isNotNull() & (F.col("level").isNull() | F.col("level").between(LEVELS[0], LEVELS[-1]))
    rated = labels.where(usable).groupBy(key, "level").agg(F.count(F.lit(1)).alias("m"))
    chosen = rated.groupBy(key).agg(F.max(F.col("level").isNotNull()).alias("has")).orderBy(F.xxhash64(key), key).limit(most)
    chosen = written(chosen, "rated")
    slim = documents.select(key, F.col(text).cast("string").alias("_text")).join(F.broadcast(chosen), key)  # at most `most` keys
    texts = written(slim.groupBy(key, "has").agg(F.min("_text").alias("_text")), "rated-texts")
    short = texts.where(F.length("_text") <= LINE_CHARS)
    few = short.select(key).orderBy(F.xxhash64(key), key).limit(LINE_DOCUMENTS)
    some = short.join(F.broadcast(few), key, "left_semi").select("_text", "has").toArrow()  # a few thousand texts of bounded length
    lines = learn_lines(some.column(0).to_pylist(), some.column(1).to_pylist())
    levels_of = rated.where(F.col("level").isNotNull()).join(F.broadcast(chosen.select(key)), key, "left_semi")  # at most 5 rows for each of `most` documents
    found = measures(texts, "_text", key, lines).where(F.col("words") >= LEAST_WORDS).join(levels_of, key).collect()  # bounded by `most`
    found.sort(key=lambda r: (r[key], r.level))  # least squares add up in one order
    language = np.array([r.language for r in found], object)
    estimates = np.array([grades(Counts(r.language, r.words, r.sentences, r.syllables, r.polysyllables, r.letters)) for r in found]).reshape(len(found), len(FORMULAS))
    times = [r.m for r in found]
    return fit_scale(np.repeat(language, times), np.repeat(estimates, times, axis=0), np.repeat(np.array([r.level for r in found], dtype=np.int64), times), lines)


def levels(documents: DataFrame, scale: Scale, text: str = "text", key: str = "doc_id", least_words: int = LEAST_WORDS) -> DataFrame:
    """(key, language, words, one column per formula, level, hard): every row once; no shuffle.

    ``level`` is 1 to 5, one more than the number of cuts below the median of the grade estimates; ``hard`` is how far that median lies
    above the cut of level 4. Both are null for articles of fewer than ``least_words`` words, which takes in null and empty texts.
    """
    shared = documents.sparkSession.sparkContext.broadcast(scale)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        reader = Reader(own.lines)
        for batch in batches:
            counts = reader.all_counts(batch.column(1).to_pylist())
            estimates = np.array([grades(c) for c in counts]).reshape(len(counts), len(FORMULAS))
            level, hard = np.ones(len(counts), np.int32), np.full(len(counts), np.nan)
            spoken, long_enough = np.array([c.language for c in counts], object), np.array([c.words >= least_words for c in counts], bool)
            for g in FUNCTION_WORDS:
                at = np.flatnonzero((spoken == g) & long_enough)
                if len(at):
                    middle = own.median(g, estimates[at])
                    level[at] += sum((middle > own.cuts[g, cut]).astype(np.int32) for cut in LEVELS[1:])
                    hard[at] = middle - own.cuts[g, 4]
            none = ~long_enough
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([c.language if c.words else None for c in counts], pa.string()),
                    pa.array([c.words for c in counts], pa.int64()),
                    *(pa.array(estimates[:, k], pa.float64(), from_pandas=True) for k in range(len(FORMULAS))),
                    pa.array(level, pa.int32(), mask=none),
                    pa.array(hard, pa.float64(), mask=none),
                ],
                names=[key, "language", "words", *FORMULAS, "level", "hard"],
            )

    slim = documents.select(key, F.col(text).cast("string").alias("_text"))
    formulas = ", ".join(f"{f} double" for f in FORMULAS)
    return slim.mapInArrow(run, f"`{key}` {documents.schema[key].dataType.simpleString()}, language string, words bigint, {formulas}, level int, hard double")


def hard_documents(documents: DataFrame, scale: Scale, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key) of documents whose article is of level 4 or 5."""
    return levels(documents, scale, text, key).where(F.col("hard") > 0).select(key)
