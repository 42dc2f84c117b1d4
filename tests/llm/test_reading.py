import os
from collections import Counter

import numpy as np
import pytest

from coweave.llm import plans
from coweave.llm.legibility import FORMULAS, LONG_PIECE, Counts, Reader, grades, joined, language_of, pieces_of, syllables
from coweave.llm.reading import fit_scale, hard_documents, learn_lines, learn_scale, levels, measures


@pytest.mark.parametrize(
    ("word", "language", "n"),
    [("the", "en", 1), ("table", "en", 2), ("walked", "en", 1), ("painted", "en", 2), ("caterpillar", "en", 4), ("administration", "en", 5), ("houses", "en", 2), ("Haus", "de", 1), ("Versammlung", "de", 3), ("blieb", "de", 1), ("porte", "fr", 1), ("responsabilité", "fr", 6), ("xyz", "en", 1), ("b", "en", 1)],
)
def test_syllables(word, language, n):
    assert syllables(word, language) == n


ARTICLE = """The cat ſaw the red dog near the mill and went
home by the road in 1891, because the rain had not
stopped all day. The man who kept the gate paid £2
for a new coat, and the USA were far away ... he
said to the boys of the town who had come to see it."""


def test_columns_are_apart_and_long_lines_are_cut():
    assert pieces_of("eins zwei   drei vier | fünf sechs\r\nsieben\racht") == ["eins zwei", "drei vier", "fünf sechs", "sieben", "acht"]
    long = pieces_of("word " * 5000)
    assert max(map(len, long)) <= LONG_PIECE and sum(len(p.split()) for p in long) == 5000
    assert "".join(pieces_of("x" * 25_000)) == "x" * 25_000 and Reader().counts("a " * 200_000).words == 200_000


def test_print_alone_tells_headings_and_price_lists():
    page = "9 THE DAILY LEAF\nTOWN NEWS.\n" + ARTICLE + "\nBUY X SOAP *** BUY X SOAP\nOATS, 4s 3d 29s\nMar 4% ........ 67 ½ 140\ni~,f1-^ «1-1·t:"
    assert Reader().articles([page]) == [pieces_of(ARTICLE)]


def test_words_of_other_matter_are_learned():
    """Notices in plain letters: nothing but their words tells them, and those are learned from pages without article."""
    notice = "Good rooms to hire at the mill, ask Mister Brown"
    assert notice in Reader().articles([ARTICLE + "\n" + notice])[0]
    other = "\n".join(f"{k}/0 BROWN 34-12-99 HILL 00{k} 12345 *** Good rooms to hire *** ask Mister Brown {k}{k}5/67 899" for k in range(6))
    lines = learn_lines([ARTICLE] * 40 + [other, "", None] * 20, [True] * 40 + [False] * 60)
    assert Reader(lines).articles([ARTICLE + "\n" + notice]) == [pieces_of(ARTICLE)]
    assert not learn_lines([], []).lexicon.any() and not learn_lines([ARTICLE], [True]).lexicon.any()


def test_broken_words_are_joined_across_columns():
    assert joined(["the comm-", "The other col", "ittee met"]) == "the committee The other col met"
    assert joined(["comm-", "One", "Two", "Three", "Four", "ittee met", "ag-", "ain"]) == "committee One Two Three Four met again "
    assert joined(["a-", "b-", "one x", "two y"]) == "abone  x two y"
    assert joined(["x-"] * 50_000).startswith("xx")  # no slower for a text of nothing but broken words
    assert joined(["end¬", "ing"]).strip() == "ending" and joined(["last-"]) == "last" and joined([]) == ""


def test_counts_do_not_depend_on_line_ends_or_letter_forms():
    reader = Reader()
    plain = reader.counts("The careless clerk carried the basket in the dark and the driver saw it. Mr. Brown said so.")
    assert (plain.words, plain.sentences, plain.language) == (18, 2, "en")
    assert reader.counts("The careleſs clerk carried the bask-\net in the dark and\r\nthe driver ſaw it. Mr. Brown said\nso.") == plain
    assert language_of(Counter("der die das the der".split())) == "de" and language_of(Counter()) == "en"
    for empty in (None, "", " \n　", "^~"):
        assert reader.counts(empty).words == 0
    assert all(np.isnan(grades(reader.counts(None))))


def test_grades_rise_with_sentence_and_word_length():
    easy, long_sentences, long_words = Counts("en", 100, 14, 120, 3, 420), Counts("en", 100, 3, 120, 3, 420), Counts("en", 100, 14, 260, 40, 700)
    for k in range(len(FORMULAS)):
        assert grades(easy)[k] < grades(long_sentences)[k] and grades(easy)[k] < grades(long_words)[k]


def pages(spark, n=240):
    """Pages whose level is known: longer sentences of longer words; with some off ratings."""
    rng = np.random.default_rng(0)
    short, long_ = ["cat", "dog", "the", "saw", "ran", "red"], ["administration", "consolidation", "the", "municipality", "of", "infrastructure"]
    docs, labels = [], []
    for k in range(n):
        level = k % 5 + 1
        words = [str(w) for w in rng.choice(short if level < 4 else long_, 120)]
        size = 4 + 4 * level
        docs.append((k, "\n".join(". ".join(" ".join(words[i : i + size]) for i in range(0, 120, size)).split(" the ")) + ".", "en"))
        labels.append((k, level if rng.random() < 0.95 else max(1, level - 1), "r1"))
    docs += [(1000, None, "en"), (1001, "", "de"), (1002, "Only a few words here.", None), (1003, "LOST, GLOVES. Reward £4.", "en"), (0, docs[0][1], "en"), (None, docs[3][1], "en")]
    labels += [(1000, None, "r2"), (3, 4, "r2"), (None, 3, "r1"), (4, 9, "r1"), (77777, 5, "r1")]
    return spark.createDataFrame(docs, "doc_id bigint, text string, language string"), spark.createDataFrame(labels, "doc_id bigint, level int, rater string")


def test_levels_and_hard_documents(spark):
    docs, labels = pages(spark)
    scale = learn_scale(docs, labels)
    got = levels(docs, scale).collect()
    assert len(got) == docs.count()
    known = [(r.level, r.doc_id % 5 + 1) for r in got if r.doc_id is not None and r.doc_id < 1000]
    assert np.mean([abs(a - b) <= 1 for a, b in known]) > 0.97
    assert all(r.level is None and r.hard is None for r in got if r.doc_id in (1000, 1001, 1002, 1003))
    hard = {r.doc_id for r in hard_documents(docs, scale).collect()}
    assert len(hard ^ ({k for k in range(240) if k % 5 >= 3} | {None})) <= 4
    assert levels(docs.where("false"), scale).count() == 0 and measures(docs).where("doc_id = 1001 and words = 0").count() == 1


def test_a_scale_without_ratings_finds_nothing(spark):
    docs, labels = pages(spark, 20)
    assert hard_documents(docs, learn_scale(docs, labels.where("false"))).count() == 0
    flat = fit_scale(np.array(["en"] * 3, object), np.ones((3, len(FORMULAS))), np.array([2, 2, 2]))
    assert flat.cuts["de", 4] == np.inf and flat.cuts["de", 2] == -np.inf and flat.median("de", np.ones((1, len(FORMULAS)))) == pytest.approx([2.0])


FOLDER = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_held_out_ratings(spark):
    """Fitted on half of the rated pages, levels of the other half: ratings themselves are off by one at times."""
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/level_labels.parquet")
    scale = learn_scale(docs, labels.where("doc_id % 2 = 0"))
    rated = labels.where("doc_id % 2 = 1").select("doc_id", (labels["level"] >= 4).alias("hard_rated"), "level")
    rows = levels(docs, scale).select("doc_id", "hard").join(rated, "doc_id").collect()
    right = [(r.hard is not None and r.hard > 0) == bool(r.hard_rated) for r in rows]
    assert len(right) > 40 and np.mean(right) > 0.93


def test_queries_are_named():
    assert {"p2_found", "p3_found", "p4_found", "p5_found", "p6_ids", "p7_packing", "p8_found"} <= set(plans.QUERIES)
