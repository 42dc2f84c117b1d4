"""Byte-level byte-pair encoding from a file of ranks. Plain Python; nothing here knows of Spark."""

from __future__ import annotations

import base64
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterable
from heapq import heapify, heappop, heappush
from itertools import chain

#: Words of more characters are encoded each time; shorter ones are remembered, up to MEMO_WORDS of them.
MEMO_CHARS = 48
MEMO_WORDS = 300_000

# The characters with the Unicode property White_Space, as a regex class.
_SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def _runs(codes: list[int]) -> str:
    """Code points as ranges of a regex class."""
    out, start = [], None
    for k, c in enumerate(codes):
        start = c if start is None else start
        if k + 1 == len(codes) or codes[k + 1] != c + 1:
            out.append(f"\\U{start:08x}" + (f"-\\U{c:08x}" if c > start else ""))
            start = None
    return "".join(out)


def word_pattern() -> re.Pattern[str]:
    """The split before merging: English contractions, letters, numbers and other signs with one leading space, white space.

    Written for `re`, whose classes below U+10000 are bitmaps: words without characters above are matched by these first,
    a lone line end or a comma or full stop before white space at once, everything else by the general alternatives.
    """

    def of(kind: str, low: int, high: int) -> str:
        return _runs([c for c in range(low, high) if unicodedata.category(chr(c))[0] == kind])

    letter, number = of("L", 0, 0x10000), of("N", 0, 0x10000)
    any_letter, any_number = (f"(?:[{x}]|[{of(kind, 0x10000, sys.maxunicode + 1)}])" for x, kind in ((letter, "L"), (number, "N")))
    alone = "(?![\\U00010000-\\U0010ffff])"
    return re.compile(
        f" [{letter}]++{alone}|[{letter}]++{alone}|\\n(?!\\s)|[,.](?=[\\n ])| ?{any_letter}+"
        f"| ?[{number}]++{alone}| ?{any_number}+|'(?:[stmd]|re|ve|ll)| ?(?:[^\\w{_SPACE}]|_)+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
    )


class BytePairs:
    """A vocabulary of byte strings whose ids are their merge ranks."""

    def __init__(self, vocabulary: list[bytes]) -> None:
        self.strings = vocabulary
        self.rank = {s: k for k, s in enumerate(vocabulary)}
        self.single = [self.rank[bytes([b])] for b in range(256)]
        self.pair_rank: dict[tuple[int, int], int | None] = {}
        self.split = word_pattern().findall
        self.memo = _Memo(self)

    @classmethod
    def load(cls, path: str) -> BytePairs:
        """From a file of lines 'base64 rank' with ranks 0, 1, ..."""
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        vocabulary = [b""] * len(pairs)
        for word, rank in pairs:
            vocabulary[int(rank)] = base64.b64decode(word)
        return cls(vocabulary)

    def _merged(self, left: int, right: int) -> int | None:
        key = (left, right)
        try:
            return self.pair_rank[key]
        except KeyError:
            found = self.rank.get(self.strings[left] + self.strings[right])
            if len(self.pair_rank) > 500_000:
                self.pair_rank.clear()
            self.pair_rank[key] = found
            return found

    def word(self, data: bytes) -> tuple[int, ...]:
        """Ids of one word: the pair of lowest rank is merged first, the leftmost among equals.

        Symbols form a doubly linked list; a heap holds the ranks of neighbouring pairs. A merge changes two pairs and
        pushes them anew; entries whose symbols have changed since are skipped when they come up. A word of n bytes
        takes O(n log n) steps.
        """
        symbol = [self.single[b] for b in data]
        n = len(symbol)
        if n < 2:
            return tuple(symbol)
        ahead, behind = list(range(1, n + 1)), list(range(-1, n - 1))
        merged = self._merged
        heap = [(m, k, symbol[k], symbol[k + 1]) for k in range(n - 1) if (m := merged(symbol[k], symbol[k + 1])) is not None]
        heapify(heap)
        while heap:
            m, k, left, right = heappop(heap)
            j = ahead[k]
            if symbol[k] != left or j == n or symbol[j] != right:
                continue  # stale
            symbol[k], symbol[j] = m, -1
            ahead[k] = after = ahead[j]
            if after < n:
                behind[after] = k
                if (up := merged(m, symbol[after])) is not None:
                    heappush(heap, (up, k, m, symbol[after]))
            before = behind[k]
            if before >= 0 and (up := merged(symbol[before], m)) is not None:
                heappush(heap, (up, before, symbol[before], m))
        return tuple(s for s in symbol if s >= 0)

    def ids(self, text: str | None) -> Iterable[int]:
        """Ids of a text without special tokens; a null or empty text has none."""
        return chain.from_iterable(map(self.memo.__getitem__, self.split(text))) if text else ()

    def encode(self, text: str | None) -> list[int]:
        return list(self.ids(text))

    def count(self, text: str | None) -> int:
        return sum(map(len, map(self.memo.__getitem__, self.split(text)))) if text else 0

    def encode_all(self, texts: Iterable[str | None]) -> tuple[array, array]:
        """(ids of all texts one after the other, offsets: one more than texts)."""
        flat, offsets = array("i"), array("i", [0])
        for text in texts:
            flat.extend(self.ids(text))
            offsets.append(len(flat))
        return flat, offsets

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ids: their strings one after the other, as UTF-8 (broken sequences become replacement signs)."""
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", errors="replace")


class _Memo(dict):
    """Ids by word, filled as words come; emptied when it holds MEMO_WORDS."""

    def __init__(self, pairs: BytePairs) -> None:
        super().__init__()
        self.pairs = pairs

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = self.pairs.word(word.encode("utf-8", errors="replace"))
        if len(word) <= MEMO_CHARS:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[word] = found
        return found
