"""Which pieces of scanned lines belong to an article: print statistics of a piece and its neighbours, and a learned lexicon.

No phrase is known beforehand. What is true of any print is stated as weights: running text is mostly small letters and common
short words, with few capitals, figures and signs, and stands among pieces like itself. What is particular to a
collection is learned from rated pages, some of which have no article: how much likelier each word (a hash of it) is in article
pieces than in others. Pieces of a page without article that look like running text are left out of that count. Plain numpy.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: Hashes of words are counted in this many cells.
CELLS = 1 << 15
#: Characters that are described at once.
STEP_CHARS = 500_000
#: Rounds of learning; each takes pieces of article pages that look like other matter for that.
ROUNDS = 3

# Kinds of characters.
_OTHER, _SPACE, _SMALL, _CAPITAL, _DIGIT, _STOP = range(6)


def _kinds() -> np.ndarray:
    kind = np.full(0x10000, _OTHER, np.uint8)
    for c in range(0x10000):
        x = chr(c)
        if x.isspace():
            kind[c] = _SPACE
        elif x.islower():
            kind[c] = _SMALL
        elif x.isupper():
            kind[c] = _CAPITAL
        elif x.isdigit() or x.isnumeric():
            kind[c] = _DIGIT
    for x in ".,;:!?'’\"“”-":
        kind[ord(x)] = _STOP
    return kind


_KIND = _kinds()
NAMES = ("capitals", "figures", "signs", "words", "small", "named", "function", "starts", "letters")
#: Weights of a piece's statistics in the order of NAMES, then the offset: log-odds that it is running text.
WEIGHTS = (-6.0, -12.0, -4.0, 0.2, 2.0, -1.0, 3.0, 0.5, 1.0, 1.0)
#: Weights of a piece's own log-odds, of those beside it, and of those one further.
AROUND = (1.0, 0.15, 0.05)


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


@dataclass
class Pieces:
    """Statistics of pieces: ``own`` (one row each), and the cell of each word with the piece it stands in."""

    own: np.ndarray
    word_cell: np.ndarray
    word_piece: np.ndarray
    page: np.ndarray


def describe(pages: list[list[str]], function_cells: np.ndarray) -> Pieces:
    """Statistics of the pieces of several pages, STEP_CHARS characters at a time. ``function_cells`` flags the cells of frequent short words."""
    flat = [p for page in pages for p in page]
    page = np.repeat(np.arange(len(pages)), [len(p) for p in pages])
    ends = np.cumsum([len(p) for p in flat]) if flat else np.empty(0, np.int64)
    own, cell, piece, lo = [np.empty((0, len(NAMES)))], [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
    while lo < len(flat):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + STEP_CHARS, side="right")))
        o, c, i = _describe(flat[lo:hi], function_cells)
        own.append(o)
        cell.append(c)
        piece.append(i + lo)
        lo = hi
    return Pieces(np.concatenate(own), np.concatenate(cell), np.concatenate(piece), page)


def _describe(flat: list[str], function_cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes = np.frombuffer("\n".join(flat).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, flat), np.int64, len(flat))
    starts = np.r_[0, np.cumsum(lengths + 1)[:-1]]
    kind = np.where(codes < 0x10000, _KIND[np.minimum(codes, 0xFFFF)], _OTHER)
    tally = lambda flag: np.add.reduceat(flag.astype(np.int32), starts).astype(np.float64)
    small, capital = kind == _SMALL, kind == _CAPITAL
    letter = small | capital
    n_letters = tally(letter)
    first = letter & ~np.r_[False, letter[:-1]]
    after = letter & ~first
    # hash of each word without regard to capitals of its first letter: letters weighed by their place in the word
    at = np.flatnonzero(first)
    place = np.arange(len(codes)) - np.maximum.accumulate(np.where(first, np.arange(len(codes)), 0))
    factor = np.cumprod(np.full(64, 0x100000001B3, np.uint64), dtype=np.uint64)
    with np.errstate(over="ignore"):
        low = np.where(capital & first & (codes < 0x250), codes | 0x20, codes).astype(np.uint64)
        weighed = np.where(letter, _spread(low * np.uint64(0x9E3779B97F4A7C15)) * factor[np.minimum(place, 63)], np.uint64(0))
        cell = (_spread(np.add.reduceat(weighed, at)) & np.uint64(CELLS - 1)).astype(np.int64) if len(at) else np.empty(0, np.int64)
    piece = np.searchsorted(starts, at, side="right") - 1
    n_words = np.bincount(piece, minlength=len(flat)).astype(np.float64)
    some = np.maximum(n_words, 1)
    named = tally(first & capital)
    n_small = tally(first & small)
    own = np.stack(
        [
            tally(after & capital) / np.maximum(tally(after), 1),
            tally(kind == _DIGIT) / lengths,
            tally(kind == _OTHER) / lengths,
            np.log1p(n_words),
            n_small / some,
            np.maximum(named - 1, 0) / some,
            np.bincount(piece, function_cells[cell], len(flat)) / some,
            small[starts].astype(np.float64),
            np.where(n_letters * 2 < lengths, -1.0, 0.0),
        ],
        axis=1,
    )
    return own, cell, piece


def _beside(x: np.ndarray, page: np.ndarray, by: int) -> np.ndarray:
    """Rows ``by`` places further on the same page; at its ends a piece stands for its missing neighbour."""
    at = np.arange(len(x)) + by
    at = np.where((at >= 0) & (at < len(x)), at, np.arange(len(x)))
    return x[np.where(page[at] == page, at, np.arange(len(x)))]


@dataclass
class LineModel:
    """Log-odds that a piece belongs to an article. ``lexicon`` holds those of word cells, 0 before anything is learned."""

    function_cells: np.ndarray
    lexicon: np.ndarray = field(default_factory=lambda: np.zeros(CELLS))

    def log_odds(self, p: Pieces) -> np.ndarray:
        if not len(p.own):
            return np.empty(0)
        odds = p.own @ np.array(WEIGHTS[:-1]) + WEIGHTS[-1]
        if len(p.word_piece):
            # words of a piece depend on each other, so their log-odds count by the root of their number
            n = np.maximum(np.bincount(p.word_piece, minlength=len(odds)), 1)
            odds = odds + np.bincount(p.word_piece, self.lexicon[p.word_cell], len(odds)) / np.sqrt(n)
        o = np.clip(odds, -6, 6)
        return sum(w * (_beside(o, p.page, -by) + _beside(o, p.page, by) if by else o) for by, w in enumerate(AROUND))


def cells_of(words: list[str]) -> np.ndarray:
    """Flags of the cells of these words."""
    flags = np.zeros(CELLS)
    flags[describe([[w] for w in words], flags).word_cell] = 1
    return flags


def learned(p: Pieces, has_article: np.ndarray, function_cells: np.ndarray) -> LineModel:
    """The model from pages of which it is known whether they have an article; each round looks at the pieces with what the last one learned."""
    model = LineModel(function_cells)
    article_page = has_article[p.page] if len(p.own) else np.empty(0, bool)
    for _ in range(ROUNDS):
        looks = model.log_odds(p) > 0
        y = article_page & looks
        use = article_page | ~looks
        if not y.any() or y[use].all():
            break
        sure = use[p.word_piece]
        inside = np.bincount(p.word_cell[sure], y[p.word_piece[sure]], CELLS)
        outside = np.bincount(p.word_cell[sure], ~y[p.word_piece[sure]], CELLS)
        base = max(inside.sum(), 1) / max(outside.sum(), 1)
        # two occurrences are added to each word, divided as all words are
        model.lexicon = np.clip(np.log((inside + 2 * base / (1 + base)) / (outside + 2 / (1 + base)) / base), -4, 4)
    return model
