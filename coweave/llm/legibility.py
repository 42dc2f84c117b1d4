"""Readable article text in scanned pages, and what readability formulas need to know of it. Plain Python; nothing here knows of Spark.

Counts (words, sentences, syllables, letters) do not depend on the order of lines, so columns that were read across
need not be put in order: lines are cut where columns meet, each piece is kept or dropped (see `lines`), and words broken at line
ends are joined with the piece that goes on with them.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from .lines import LineModel, cells_of, describe

# Old letter forms and ligatures, and what they stand for.
LETTER_FORMS = {"ſ": "s", "ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "æ": "ae", "œ": "oe", "Æ": "Ae", "Œ": "Oe"}
# Signs that mark a word broken at a line end.
BREAK_SIGNS = "-=~¬‐­_"
# Frequent short words of each language.
FUNCTION_WORDS = {
    "en": "the a an of and in at on by to for was were is with it that which until because while".split(),
    "de": "der die das den dem des und im am ein eine einen einer zu zum zur nach mit auf bei ist war".split(),
    "fr": "le la les un une des du et au aux en de son sa ses dans sur est avec pour par car".split(),
}
FUNCTION_CELLS = cells_of([w for words in FUNCTION_WORDS.values() for w in words])
#: A piece of more characters is no scanned line; it is cut at spaces, a run without space at this length.
LONG_PIECE = 10_000
LINE = re.compile(r"\r\n|[\n\r\v\f\x85\u2028\u2029]")
COLUMN = re.compile(r" ?\| ?|\t| {3,}")
WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
STOP = re.compile(r"[.!?](?:(?<=[^\W_]{2}.)|(?<=[”\"»')].))")
# Short forms whose full stop ends no sentence.
SHORT_FORMS = ("Mr.", "Mrs.", "Dr.", "St.", "Messrs.", "Hon.", "Rev.", "Capt.", "Hr.", "Mme.")
SIGNS = re.compile(r"[·•^|*~`]+")

_VOWELS = "aeiouyäöüàâéèêëîïôùûœæáíóú"
_GROUP = {
    "en": re.compile(r"[aeiouy]+"),
    "de": re.compile(r"[aeäiouöüy]+"),
    "fr": re.compile(r"[aàâeéèêëiîïoôuùûüyœæ]+"),
}
_SPLIT = {
    "en": re.compile(r"ia(?!l\b|n\b)|io(?!n|us)|eo(?!us)|ua|uo|iu|ying|eing|[^aeiou]ier\b"),
    "de": re.compile(r"ea|eo|ia|io|iu|ua|uo|ue(?!r\b)|aio"),
    "fr": re.compile(r"éa|éo|io(?!n)|ia(?!n|it)|ué|oë|aï"),
}


def syllables(word: str, language: str) -> int:
    """Syllables of a word by rules as hyphenation uses them: vowel groups, split where two vowels are two syllables, without mute endings."""
    w = word.lower()
    n = len(_GROUP[language].findall(w)) + len(_SPLIT[language].findall(w))
    if language == "en":
        if w.endswith(("e", "es")) and not w.endswith(("le", "les", "ee", "ses", "zes", "ces", "ges", "ches", "shes", "xes", "ie", "ies")):
            n -= 1
        elif w.endswith(("le", "les")) and len(w.rstrip("s")) > 2 and w.rstrip("s")[-3] in _VOWELS:
            n -= 1
        elif w.endswith("ed") and not w.endswith(("ted", "ded", "eed", "ied")):
            n -= 1
    elif language == "fr" and len(w) > 3 and w.endswith(("e", "es", "ent")) and not w.endswith(("ment", "ée", "ées", "ie", "ue")):
        n -= 1
    return max(1, n)


def pieces_of(text: str) -> list[str]:
    """Pieces of the lines of a text, columns apart, without empty ones."""
    for form, plain in LETTER_FORMS.items():
        if form in text:
            text = text.replace(form, plain)
    out = []
    for line in LINE.split(text):
        for piece in COLUMN.split(line) if "   " in line or "|" in line or "\t" in line else (line,):
            piece = piece.strip()
            while len(piece) > LONG_PIECE:
                at = piece.rfind(" ", 1, LONG_PIECE)
                at = LONG_PIECE if at < 0 else at
                out.append(piece[:at])
                piece = piece[at:].strip()
            if piece:
                out.append(piece)
    return out


def joined(pieces: list[str]) -> str:
    """Pieces as one text; a broken word is joined with the next piece that starts in lower case and goes on with no other word."""
    pieces = list(pieces)
    # for each place the next piece that starts in lower case; pieces that have been used are passed over
    after = [len(pieces)] * (len(pieces) + 1)
    for k in range(len(pieces) - 1, -1, -1):
        after[k] = k if pieces[k][:1].islower() else after[k + 1]

    def next_free(k: int) -> int:
        path = []
        while (j := after[k]) != k and j < len(pieces):
            path.append(k)
            k = j
        for x in path:
            after[x] = j
        return j

    for k, piece in enumerate(pieces):
        end = piece.rstrip()
        if not end or end[-1] not in BREAK_SIGNS:
            continue
        head = end.rstrip(BREAK_SIGNS + " ")
        j = next_free(k + 1)
        while j < len(pieces):
            tail, _, rest = pieces[j].partition(" ")
            pieces[j], after[j] = rest, after[j + 1]
            head += tail
            if rest or tail[-1] not in BREAK_SIGNS:
                break
            head, j = head.rstrip(BREAK_SIGNS + " "), next_free(j + 1)  # the word is broken once more
        pieces[k] = head
    return " ".join(pieces)


@dataclass(frozen=True)
class Counts:
    """What formulas need of an article."""

    language: str
    words: int
    sentences: int
    syllables: int
    polysyllables: int
    letters: int


def language_of(words: Counter) -> str:
    """The language whose function words occur most; English if none does."""
    return max(FUNCTION_WORDS, key=lambda g: sum(words[w] for w in FUNCTION_WORDS[g]))


class Reader:
    """Counts of texts. ``lines`` tells article from other matter; syllables of words are remembered."""

    def __init__(self, lines: LineModel | None = None, memo_words: int = 200_000) -> None:
        self.lines = lines or LineModel(FUNCTION_CELLS)
        self.memo: dict[str, dict[str, tuple[int, int]]] = {g: {} for g in FUNCTION_WORDS}
        self.memo_words = memo_words

    def _known(self, word: str, language: str) -> tuple[int, int]:
        memo = self.memo[language]
        found = memo.get(word)
        if found is None:
            parts = [p for p in re.split(r"[-'’]", word) if p]
            found = sum(syllables(p, language) for p in parts), sum(map(len, parts))
            if len(memo) >= self.memo_words:
                memo.clear()
            if len(word) <= 40:
                memo[word] = found
        return found

    def articles(self, texts: list[str | None]) -> list[list[str]]:
        """The pieces of each text that belong to its article."""
        pages = [pieces_of(t) if t else [] for t in texts]
        keep = iter((self.lines.log_odds(describe(pages, FUNCTION_CELLS)) > 0).tolist())
        return [[p for p in page if next(keep)] for page in pages]

    def all_counts(self, texts: list[str | None]) -> list[Counts]:
        """Counts of the article in each text; zeros for a text that is null, empty or holds none."""
        return [c for lo in range(0, len(texts), 256) for c in map(self._counts, self.articles(texts[lo : lo + 256]))]

    def counts(self, text: str | None) -> Counts:
        return self.all_counts([text])[0]

    def _counts(self, pieces: list[str]) -> Counts:
        article = SIGNS.sub("", joined(pieces))
        words = Counter(WORD.findall(article.lower()))
        language = language_of(words)
        n = sum(words.values())
        stops = max(1 if n else 0, len(STOP.findall(article)) - sum(map(article.count, SHORT_FORMS)))
        total = poly = letters = 0
        for word, m in words.items():
            s, size = self._known(word, language)
            total += s * m
            letters += size * m
            if s >= 3:
                poly += m
        return Counts(language, n, stops, total, poly, letters)


FORMULAS = ("flesch_kincaid", "gunning_fog", "automated", "linsear")


def grades(c: Counts) -> tuple[float, ...]:
    """Grade estimates of classic formulas, in the order of FORMULAS; NaN without words.

    All four weigh sentence length and word length together; formulas that lean on one of them alone mistake long
    sentences of plain words, or short ones of long words, for their opposite.
    """
    if not c.words:
        return (float("nan"),) * len(FORMULAS)
    per_sentence, per_word = c.words / c.sentences, c.syllables / c.words
    return (
        0.39 * per_sentence + 11.8 * per_word - 15.59,
        0.4 * (per_sentence + 100 * c.polysyllables / c.words),
        4.71 * c.letters / c.words + 0.5 * per_sentence - 21.43,
        (c.words + 2 * c.polysyllables) / c.sentences / 2,
    )
