"""Terms of texts in a task: character n-grams inside padded words, or words and pairs of neighbours, as numbers."""

from __future__ import annotations

import functools
import re
import sys
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space as Java's \s sees it.
_BLANKS = re.compile(r"[ \t\n\x0b\f\r]+")
LOW, HIGH = 2, 5


def terms(kind: str, vocabulary: list[str] | None = None) -> Grams | Words:
    """``char`` n-grams of 2 to 5 inside words padded with a blank on either side, or ``word`` n-grams of 1 and 2, where a
    word has two characters or more. With a vocabulary a term's number is its place there and other terms are passed over;
    without one it is a number that ``names`` tells the term of."""
    return Grams(vocabulary) if kind == "char" else Words(vocabulary)


class Grams:
    """Character n-grams, by arrays: characters are numbered, and an n-gram is a number whose digits they are. A text with
    characters beyond the digits there are has its n-grams looked up one by one, under numbers of their own, so sums are by
    name in the end."""

    def __init__(self, vocabulary: list[str] | None = None):
        self.digit = np.zeros(sys.maxunicode + 1, np.uint16)  # 0: of no number
        self.digit[ord(" ")] = 1
        self.characters = [" "]
        self.size = None if vocabulary is None else len(vocabulary)
        if vocabulary is None:
            self.places: dict[str, int] = defaultdict()
            self.places.default_factory = lambda: BEYOND + len(self.places)
            self.place = self.places.__getitem__
        else:
            self.places = {t: i for i, t in enumerate(vocabulary)}
            self.place = self.places.get
            codes = _codes("".join(vocabulary))
            self.numbered = self._digits(np.unique(codes)) is not None
            sizes, digits = np.fromiter(map(len, vocabulary), np.int64, len(vocabulary)), self.digit[codes].astype(np.int64)
            starts, keys = np.cumsum(sizes) - sizes, np.zeros(len(sizes), np.int64)
            for k in range(HIGH):
                some = sizes > k
                keys[some] = keys[some] * BASE + digits[starts[some] + k]
            keys[sizes > HIGH] = -1  # no text has it
            self.order = np.argsort(keys)
            self.keys = keys[self.order]

    def _digits(self, codes: np.ndarray) -> np.ndarray | None:
        """The digits of a text's characters, new ones too; none where there are not as many."""
        found = self.digit[codes]
        if not found.all():
            new = np.unique(codes[found == 0])
            if len(self.characters) + len(new) >= BASE:
                return None
            self.digit[new] = np.arange(len(new)) + len(self.characters) + 1
            self.characters += map(chr, new.tolist())
            found = self.digit[codes]
        return found

    def _one_by_one(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        found = Counter(p for w in _BLANKS.split(text) if w for n in range(LOW, HIGH + 1) for i in range(len(w) + 3 - n) if (p := self.place(f" {w} "[i:i + n])) is not None)
        numbers = sorted(found)
        return np.array(numbers, np.int64), np.array([found[n] for n in numbers], np.int64)

    def _counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        text = (text or "").lower()
        codes = _codes(f" {text} ")
        blank = _BLANK_CODES[np.minimum(codes, 33)]
        codes[blank] = 32
        kept = ~blank
        kept[1:] |= ~blank[:-1]
        kept[0] = True
        codes = codes[kept]
        digits = (self.digit[codes] if self.numbered else None) if self.size is not None else self._digits(codes)
        if digits is None:
            return self._one_by_one(text)
        digits, parts = digits.astype(np.int64), []
        inside, keys, good = codes != 32, digits, digits > 0
        for n in range(LOW, HIGH + 1):  # from the n-grams of one character less
            keys, good = keys[:-1] * BASE + digits[n - 1:], good[:-1] & (digits[n - 1:] > 0)
            if n > 2:
                good &= inside[n - 2:-1]
            parts.append(keys[good])
        numbers, counts = np.unique(np.concatenate(parts), return_counts=True)
        if self.size is None:
            return numbers, counts
        at = np.minimum(np.searchsorted(self.keys, numbers), max(0, self.size - 1))
        found = self.keys[at] == numbers if self.size else np.zeros(len(numbers), bool)
        numbers, counts = self.order[at[found]], counts[found]
        order = np.argsort(numbers)
        return numbers[order], counts[order]

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(how many different terms each text has; their numbers, in order within a text; how often each is there)."""
        found = [self._counts(t) for t in texts]
        return np.array([len(n) for n, _ in found], np.int64), *map(np.concatenate, zip(*found))

    def statistics(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(numbers, how many of the texts have each, how often each is there)."""
        _, numbers, counts = self.counts(texts)
        found, at = np.unique(numbers, return_inverse=True)
        return found, np.bincount(at, minlength=len(found)), np.bincount(at, counts, len(found)).astype(np.int64)

    def names(self, numbers: np.ndarray) -> pa.Array:
        """Terms of numbers that were given without a vocabulary."""
        numbered, characters = numbers < BEYOND, pa.array(["", *self.characters], pa.string())
        digits = [characters.take(pa.array(np.where(numbered, numbers, 0) // BASE**k % BASE)) for k in range(HIGH - 1, -1, -1)]
        others = pa.array(["", *self.places], pa.string()).take(pa.array(np.where(numbered, 0, numbers - BEYOND + 1)))
        return pc.if_else(pa.array(numbered), pc.binary_join_element_wise(*digits, ""), others)


#: Digits of a number of five characters, and what is greater than any such number.
BASE = 6200
BEYOND = BASE**HIGH
_BLANK_CODES = np.array([chr(i) in " \t\n\x0b\f\r" for i in range(34)])


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).copy()


@functools.cache
def _of_words() -> np.ndarray:
    """Whether a code point can be in a word."""
    found = np.zeros(sys.maxunicode + 1, bool)
    for first in range(0, len(found), 0x800):  # surrogates are such a range
        if first != 0xD800:
            found[[first + m.start() for m in re.finditer(r"\w", "".join(map(chr, range(first, first + 0x800))))]] = True
    return found


class Words:
    """Words and pairs of neighbours, by arrays: all words of some texts are found and numbered at once, and a pair is two
    numbers of words. Words are bytes in UTF-32."""

    def __init__(self, vocabulary: list[str] | None = None):
        self.places: dict[bytes, int] = defaultdict()
        self.places.default_factory = self.places.__len__
        self.size = None if vocabulary is None else len(vocabulary)
        if vocabulary is not None:
            parts = [[self.places[w.encode("utf-32-le")] for w in t.split(" ")] for t in vocabulary]
            self.words = pa.array(list(self.places), pa.large_binary())
            self.of_word = np.full(len(self.places) + 1, -1)  # the last one: of words that are not known
            for i, p in enumerate(parts):
                if len(p) == 1:
                    self.of_word[p[0]] = i
            pairs = [i for i, p in enumerate(parts) if len(p) == 2]
            self.of_pair = np.array([*pairs, -1], np.int64)
            self.pairs = pa.array([_pair(*parts[i]) for i in pairs], pa.int64())

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As those of ``Grams``, but without a vocabulary the numbers of a text are in no order."""
        if self.size is None:
            numbers, rows, times = self._sorted(texts)
            order = np.argsort(rows, kind="stable")
            return np.bincount(rows, minlength=len(texts)), numbers[order], times[order]
        words, row = _words([(t or "").lower() for t in texts])
        at = _place(words, self.words)
        pair = (row[1:] == row[:-1]) & (at[1:] >= 0) & (at[:-1] >= 0)
        places = self.of_word[at], self.of_pair[_place(pa.array(_pair(at[:-1][pair], at[1:][pair])), self.pairs)]
        some = [p >= 0 for p in places]
        numbers, rows = (np.concatenate([x[s] for x, s in zip(parts, some)]) for parts in (places, (row, row[1:][pair])))
        found, times = np.unique(rows * self.size + numbers, return_counts=True)
        rows, numbers = np.divmod(found, max(1, self.size))
        return np.bincount(rows, minlength=len(texts)), numbers, times

    def _sorted(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number, place of the text, how often it is there), in some order of the numbers."""
        words, row = _words([(t or "").lower() for t in texts])
        found = words.dictionary_encode()
        here, size = found.indices.to_numpy().astype(np.int64), len(found.dictionary)
        pair = row[1:] == row[:-1]
        keys = np.concatenate([here, (here[:-1][pair] + 1) * size + here[1:][pair]])
        keys, times = np.unique(keys * len(texts) + np.concatenate([row, row[1:][pair]]), return_counts=True)
        keys, rows = np.divmod(keys, len(texts))
        place = np.fromiter(map(self.places.__getitem__, found.dictionary.to_numpy(zero_copy_only=False)), np.int64, size)
        first, second = np.divmod(keys, max(1, size))
        return np.where(first == 0, place[second], _pair(place[first - 1], place[second])), rows, times

    def statistics(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As that of ``Grams``."""
        numbers, _, times = self._sorted(texts)
        starts = np.flatnonzero(np.diff(numbers, prepend=-1))
        return numbers[starts], np.diff(starts, append=len(numbers)), np.add.reduceat(times, starts) if len(starts) else times

    def names(self, numbers: np.ndarray) -> pa.Array:
        """Terms of numbers that were given without a vocabulary."""
        words, one = pa.array([w.decode("utf-32-le") for w in self.places], pa.string()), numbers < 1 << 32
        first, second = (words.take(pa.array(n)) for n in (np.where(one, numbers, (numbers >> 32) - 1), numbers & 0xFFFFFFFF))
        return pc.if_else(pa.array(one), first, pc.binary_join_element_wise(first, second, " "))


def _pair(first, second):
    """The number of a pair of words, greater than any word's."""
    return (first + 1) << 32 | second


def _place(values: pa.Array, known: pa.Array) -> np.ndarray:
    """Where each value is in ``known``, else -1."""
    return pc.fill_null(pc.index_in(values, value_set=known), -1).to_numpy().astype(np.int64)


def _words(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, ``\\w{2,}``, in order, and the place of each one's text."""
    points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), np.uint32)
    inside = np.zeros(len(points) + 2, bool)
    inside[1:-1] = _of_words()[points]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    first, last = edges[::2], edges[1::2]
    alone = last - first == 1
    inside[first[alone] + 1] = False
    first, last = first[~alone], last[~alone]
    offsets = np.concatenate([[0], np.cumsum(4 * (last - first))])
    words = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(points[inside[1:-1]])])
    until = np.searchsorted(first, np.cumsum([len(t) + 1 for t in texts]))
    return words, np.repeat(np.arange(len(texts)), np.diff(until, prepend=0))
