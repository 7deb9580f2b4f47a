"""Passages of held-out items printed in a corpus.

The words of the items form a generalised suffix automaton. The words of a page are streamed
through it: every printed word is read as each item word that it can be a scan of, alone, put
together with its neighbour, or parted, so the automaton follows several readings at once and
keeps for each the longest passage that ends there. The readings go on over what printing and
scanning do to a text: line ends, broken words, other columns and adverts between lines, and one
unreadable word. The longest matching lengths decide: a page leaks an item when they reach the
limit of words, or the limit of coverage.

Most pages leak nothing, so many pages at a time are first streamed through the automaton by array
operations that know only easy words: words that are no more than misread, or parted at a line's
end but not misread. Half of the words of a passage must be easy ones in a row, in any way through
the page; only pages that print that much of an item are read for it with all that words can be.

What is found of an item never depends on the other items: a state of the automaton stands for
every place of every item, and none is forgotten. Pages are independent of each other; the corpus
is read once per block of items and nothing is shuffled.
"""

from __future__ import annotations

import gc
import math
import re
import unicodedata
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import lru_cache
from itertools import pairwise
from types import MappingProxyType

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Item words that one automaton holds; more items are read in blocks of about that size, one after the other.
BLOCK_WORDS = 200_000
#: Words read in a row before an unreadable one may be crossed; names in a stock phrase come more often.
STEADY = 5
#: Page words, and pairs of them, that a worker remembers; it starts anew when there are more.
KNOWN = 300_000
#: Lines between two that belong together (an advert, lines of another column), and columns that a line is sought across.
JUMP = 9
#: Characters of the pages that are streamed at a time, and words that runs are followed from at a time.
AT_ONCE, STARTS = 1 << 20, 1 << 17
_WORD = re.compile(r"[^\W_]+")
#: Words of lines with signs that no print has: what a letter outside ASCII has become belongs to its word.
_GARBLED = re.compile(r"(?:[^\W_]|[^\x00-\x7f\s–—„“”«»…’‘‐¬\xad]|(?<=[ÃÂÄÅÐÑ√├┬])\S)+")
_ODD = re.compile(r"[^\x00-\x7f\w\s–—„“”«»…’‘‐¬\xad£§°·•]|[ÃÂÄÅÐÑ](?=[^\w\s])")
_GAP = re.compile(r"\t|\s\|\s|\s{2,}")
_BROKEN = "-¬\xad=‐"
#: Characters and groups that scanners take for each other, and what stands for both.
LOOKALIKES = (("rn", "m"), ("in", "m"), ("ri", "n"), ("cl", "d"), ("vv", "w"), ("ii", "u"), ("li", "h"))
_SAME = str.maketrans({"0": "o", "1": "l", "i": "l", "j": "l", "5": "s", "8": "b", "6": "b", "9": "g", "q": "g", "e": "c", "f": "s", "u": "n", "t": "l", "v": "r"})


def key(word: str) -> str:
    """Lower-case ASCII letters and digits of a word; all else is left out, garbled or not."""
    low = word.lower()
    if low.isascii() and low.isalnum():
        return low
    return "".join(c for c in low if c.isascii() and c.isalnum())


def folded(word: str) -> str:
    """Lower-case letters and digits with accents taken off."""
    low = word.lower()
    if low.isascii() and low.isalnum():
        return low
    plain = unicodedata.normalize("NFKD", low.replace("ſ", "s").replace("ı", "i"))
    return "".join(c for c in plain if c.isalnum())


def _shape(word: str) -> str:
    for group, one in LOOKALIKES:
        word = word.replace(group, one)
    return word.translate(_SAME)


def _within(a: str, b: str, most: int) -> bool:
    """Whether at most ``most`` single-character edits lie between the words."""
    if a == b:
        return True
    n, m = len(a), len(b)
    if not most or n - m > most or m - n > most:
        return False
    least = n if n < m else m
    i = 0
    while i < least and a[i] == b[i]:
        i += 1
    j = 1
    while j <= least - i and a[-j] == b[-j]:
        j += 1
    # what is left when the same beginning and end are taken off
    n, m = n - i - j + 1, m - i - j + 1
    if n <= most >= m:
        return True
    if most == 1:
        return False
    a, b = a[i : i + n], b[i : i + m]
    return _within(a[1:], b[1:], most - 1) or _within(a, b[1:], most - 1) or _within(a[1:], b, most - 1)


@lru_cache(maxsize=1 << 16)
def same_word(printed: str, word: str) -> bool:
    """Whether ``printed`` can be a scan of ``word``."""
    return _alike(folded(printed), key(printed), folded(word), key(word), printed.isascii() and word.isascii())


def _alike(a: str, short_a: str, b: str, short_b: str, plain: bool, shaped: bool = False) -> bool:
    """:func:`same_word` by the words' forms and whether both are ASCII; ``shaped``: the shapes are known to differ."""
    if a == b or (short_a == short_b != ""):
        return True
    if not a or not b or abs(len(a) - len(b)) > 3:
        return False
    longest = max(len(a), len(b))
    if longest <= 2:
        return not shaped and longest > 1 and _shape(a) == _shape(b)
    if longest > 7:
        return _within(a, b, 2) or (not plain and _within(short_a, short_b, 2)) or not shaped and _shape(a) == _shape(b)
    # words one edit apart have their first or their last letter in common
    if (a[0] == b[0] or a[-1] == b[-1]) and _within(a, b, 1):
        return True
    if not plain and _within(short_a, short_b, 1):
        return True
    return not shaped and _shape(a) == _shape(b)


@lru_cache(maxsize=1 << 16)
def near_word(printed: str, word: str) -> bool:
    """Whether a word that cannot be read may still be a bad scan of ``word``: one more edit, or a number."""
    a, b = folded(printed), folded(word)
    if b.isdigit():
        return len(a) <= 3
    return _within(a, b, 1 if len(b) <= 3 else 2 if len(b) <= 7 else 3)


def item_words(text: str) -> list[str]:
    """The words of an item, as written."""
    return _WORD.findall(text)


class Automaton:
    """Generalised suffix automaton of sequences: every passage of every sequence has one state."""

    def __init__(self, sequences: Iterable[Sequence[int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        #: sequences that have a prefix ending in the state
        self.own: list[list[int] | None] = [None]
        for n, tokens in enumerate(sequences):
            last = 0
            for token in tokens:
                last = self._extend(last, token)
                if self.own[last] is None:
                    self.own[last] = [n]
                elif self.own[last][-1] != n:
                    self.own[last].append(n)
        self.longer: dict[int, list[int]] = defaultdict(list)
        for state, shorter in enumerate(self.link):
            if shorter > 0:
                self.longer[shorter].append(state)

    def _new(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        self.own.append(None)
        return len(self.length) - 1

    def _split(self, p: int, q: int, token: int) -> int:
        """A copy of ``q`` for the shorter passages that reach it through ``p``."""
        copy = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _extend(self, last: int, token: int) -> int:
        q = self.next[last].get(token)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, token)
        state = self._new(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = state
            p = self.link[p]
        if p >= 0:
            q = self.next[p][token]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, token)
        return state

    def holders(self, state: int, known: Mapping[int, set[int]] = MappingProxyType({})) -> set[int]:
        """The sequences that hold the passages of a state; ``known``: of some states."""
        found: set[int] = set()
        todo = [state]
        while todo:
            state = todo.pop()
            if state in known:
                found |= known[state]
                continue
            if self.own[state]:
                found.update(self.own[state])
            todo += self.longer.get(state, ())
        return found

    def stream(self, tokens: Iterable[int]) -> Iterator[tuple[int, int]]:
        """``(state, length)`` of the longest passage that ends at each token (0, 0: none)."""
        state = matched = 0
        for token in tokens:
            while state and token not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            state = self.next[state].get(token, 0)
            matched = matched + 1 if state else 0
            yield state, matched


def _letters(word: str) -> int:
    """The set of a word's characters and of its neighbouring ones as bits, some of which share one; an edit changes at most three."""
    bits = 0
    for c in word:
        bits |= 1 << (ord(c) & 63)
    for a, b in pairwise(word):
        bits |= 1 << 64 + (ord(a) * 31 + ord(b) & 127)
    return bits


def _less_one(word: str) -> list[str]:
    return [word, *(word[:i] + word[i + 1 :] for i in range(len(word)))]


class Lexicon:
    """Words looked up by what is printed: exactly the numbers of those that :func:`same_word` takes it for."""

    def __init__(self, words: Sequence[str]) -> None:
        self.forms = [(folded(w), key(w), w.isascii()) for w in words]
        self.letters = [(_letters(plain), _letters(short)) for plain, short, _ in self.forms]
        self.equal: dict[str, list[int]] = defaultdict(list)  # by form
        self.shaped: dict[str, list[int]] = defaultdict(list)  # by the shape of the first form
        self.shortened: dict[str, list[int]] = defaultdict(list)  # by a form of up to 8 characters without one of them
        self.parts: dict[tuple[int, str], list[int]] = defaultdict(list)  # by a third of a form and the form's length
        self.shapes = [_shape(plain) for plain, _, _ in self.forms]
        for n, (plain, short, _) in enumerate(self.forms):
            self.shaped[self.shapes[n]].append(n)
            for form in {plain, short} - {""}:
                self.equal[form].append(n)
                if len(form) <= 8:
                    for less in _less_one(form):
                        self.shortened[less].append(n)
                for k, (at, to) in enumerate(_thirds(len(form))):
                    self.parts[4 * len(form) + k, form[at:to]].append(n)
        for index in (self.equal, self.shaped, self.shortened, self.parts):
            index.default_factory = None

    def exact(self, printed: str) -> list[int]:
        """The words that ``printed`` equals in a form."""
        plain, short = folded(printed), key(printed)
        found = self.equal.get(plain, [])
        return found if short in ("", plain) else list({*found, *self.equal.get(short, ())})

    def find(self, printed: str) -> list[int]:
        """Every word that ``printed`` can be a scan of."""
        plain, short, ascii_only = folded(printed), key(printed), printed.isascii()
        found = set(self.exact(printed))
        for n in self.shaped.get(_shape(plain), ()):
            if n not in found and abs(len(plain) - len(self.forms[n][0])) <= 3 and max(len(plain), len(self.forms[n][0])) > 1:
                found.add(n)
        maybe: set[int] = set()
        shortened, parts = self.shortened, self.parts
        for form in (plain,) if short in ("", plain) else (plain, short):
            n = len(form)
            if 1 < n <= 8:
                if form in shortened:
                    maybe.update(shortened[form])
                for i in range(n):
                    less = form[:i] + form[i + 1 :]
                    if less in shortened:
                        maybe.update(shortened[less])
            # of three parts of a word two edits leave one as it is, moved by no more than the edits allow
            low = max(5, n - 2) if n > 7 or short not in ("", plain) else 8
            for size in range(low, n + 3):
                for mark, at, to in _places(size, n - size):
                    part = mark, form[at:to]
                    if part in parts:
                        maybe.update(parts[part])
        if not maybe:
            return list(found)
        return [*found, *self._among(maybe - found, plain, short, ascii_only)]

    def _among(self, numbers: Iterable[int], plain: str, short: str, ascii_only: bool) -> Iterator[int]:
        """Those of the words that two edits, or one, turn into what is printed."""
        own = own_short = None
        size = len(plain)
        for n in numbers:
            if own is None:
                own = _letters(plain)
                own_short = own if plain == short else _letters(short)
            w, (bits, bits_short) = self.forms[n], self.letters[n]
            # two edits, or one between short words, change few characters and neighbours
            most = 3 if size <= 7 >= len(w[0]) else 6
            if (bits & ~own).bit_count() > most or (own & ~bits).bit_count() > most:
                if ascii_only and w[2] or (bits_short & ~own_short).bit_count() > most or (own_short & ~bits_short).bit_count() > most:
                    continue
            if _alike(plain, short, w[0], w[1], ascii_only and w[2], True):
                yield n

    def reads(self, n: int, plain: str, short: str) -> bool:
        """Whether something printed with these forms can be a scan of the word."""
        w = self.forms[n]
        return _alike(plain, short, w[0], w[1], plain == short and w[2])


@lru_cache(maxsize=None)
def _thirds(size: int) -> tuple[tuple[int, int], ...]:
    cuts = (0, size // 3, 2 * size // 3, size)
    return tuple(pairwise(cuts))


@lru_cache(maxsize=None)
def _places(size: int, over: int) -> tuple[tuple[int, int, int], ...]:
    """``(part's mark, from, to)``: where a part that no edit touches can stand in a word ``over`` longer and two edits away."""
    moves = [m for m in range(-2, 3) if abs(m) + abs(over - m) <= 2]
    return tuple((4 * size + k, at + m, to + m) for k, (at, to) in enumerate(_thirds(size)) for m in moves if at + m >= 0 and (k or m >= 0))


def pieces_of(text: str) -> tuple[list[tuple[int, int, list[str], bool]], int]:
    """``(line, column, words, last word broken)`` of every line, cut where a column ends, and how many lines hold words."""
    out: list[tuple[int, int, list[str], bool]] = []
    number = 0
    words_in = (_GARBLED if not text.isascii() and _ODD.search(text) else _WORD).findall
    # white space other than a blank is not printable
    columns = "  " in text or "|" in text or not text.replace("\n", "").isprintable()
    for line in text.split("\n"):
        line = line.rstrip()
        if not line:
            continue
        if not columns:
            if words := words_in(line):
                out.append((number, 0, words, line[-1] in _BROKEN or line[-2:] in ("Â\xad", "Â¬")))
            number += 1
            continue
        parts = [p for p in _GAP.split(line) if p.strip()]
        for column, part in enumerate(parts):
            part = part.rstrip()
            if words := words_in(part):
                out.append((number, column, words, part[-1] in _BROKEN or part[-2:] in ("Â\xad", "Â¬")))
        number += bool(parts)
    return out, number


def _spread(begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and position of every one of ``count`` consecutive positions from ``begin``."""
    owner = np.repeat(np.arange(len(count)), count)
    return owner, np.arange(len(owner)) + np.repeat(begin - np.cumsum(count) + count, count)


def successions(page: np.ndarray, line: np.ndarray, column: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(how many, which, wrapped)``: of each piece, those that can go on where it ends.

    They stand in the same column within :data:`JUMP` lines, in the next line, or in the same line
    further on; the last two within as many columns. From the foot of a column, or of a page's
    only one, it can also go on at the head of the next; these are marked as wrapped. So a piece
    has few that can follow. ``lines`` is how many each piece's page has.
    """
    most = (1 << 19) - 1
    keys = page << 45 | line << 19 | np.minimum(column, most)
    one = np.arange(len(keys))
    right = np.minimum(column + JUMP + 1, most)
    row = keys - np.minimum(column, most)
    ranges = [(one + 1, np.searchsorted(keys, row + right, "right"))]
    below = row + (1 << 19)
    ranges.append((np.searchsorted(keys, below + np.maximum(column - JUMP, 0)), np.searchsorted(keys, below + right - 1, "right")))
    for down in range(2, JUMP + 2):
        at = np.searchsorted(keys, keys + (down << 19))
        ranges.append((at, at + (keys[np.minimum(at, len(keys) - 1)] == keys + (down << 19))))
    foot = np.flatnonzero(line >= lines - JUMP)
    plain = len(ranges)
    for head in range(JUMP + 1):
        own = page[foot] << 45 | head << 19
        begin, end = np.zeros((2, len(keys)), dtype=np.int64)
        begin[foot] = np.searchsorted(keys, own | np.where(column[foot] == 0, 0, np.minimum(column[foot] + 1, most)))
        end[foot] = np.searchsorted(keys, own | right[foot], "right")
        ranges.append((begin, np.maximum(end, begin)))
    counts = [end - begin for begin, end in ranges]
    total = sum(counts)
    place = np.cumsum(total) - total
    which, wrapped = np.zeros(int(total.sum()), dtype=np.int64), np.zeros(int(total.sum()), dtype=bool)
    for n, ((begin, _), count) in enumerate(zip(ranges, counts)):
        some = np.flatnonzero(count)
        to = _spread(place[some], count[some])[1]
        which[to] = _spread(begin[some], count[some])[1]
        wrapped[to] = n >= plain
        place += count
    return total, which, wrapped


Runs = dict[int, int]  # by state, words of the passage × 8 + words since an unreadable one (7 at most)


def _polynomial(word: str) -> tuple[int, int]:
    """Hash of a word and what the hash of another is multiplied by when the word is put after it."""
    value, factor = 0, 1
    for c in word:
        value = (value * 0x9E3779B97F4A7C15 + ord(c)) & 0xFFFFFFFFFFFFFFFF
        factor = factor * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
    return value, factor


def _hashed(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)


@dataclass(frozen=True)
class Layout:
    """The pages of some pieces, and their :func:`successions`."""

    page: np.ndarray
    count: np.ndarray
    which: np.ndarray
    wrapped: np.ndarray

    def of(self, n: int) -> tuple[list[list[int]], list[list[int]]]:
        """What each piece of a page can follow, and from which foot it can, by the page's own numbers."""
        low, high = np.searchsorted(self.page, [n, n + 1]).tolist()
        begin = int(self.count[:low].sum())
        first = np.repeat(np.arange(high - low), self.count[low:high])
        follow: list[list[int]] = [[] for _ in range(high - low)]
        wrap: list[list[int]] = [[] for _ in range(high - low)]
        for a, b, wrapped in zip(first.tolist(), (self.which[begin : begin + len(first)] - low).tolist(), self.wrapped[begin : begin + len(first)].tolist()):
            if not wrapped:
                follow[b].append(a)
            elif a != b:
                wrap[b].append(a)
        return follow, wrap


class Items:
    """The items of one block with their automaton; :meth:`read` works on one page, :meth:`rows_of` on many."""

    def __init__(self, rows: Sequence[tuple[int, str | None]], min_words: int, min_share: float | None = None) -> None:
        self.rows, self.min_words, self.min_share = rows, min_words, min_share
        ids: dict[tuple[str, ...], list[int]] = {}
        for i, text in rows:
            ids.setdefault(tuple(item_words(text or "")), []).append(i)
        self.sequences = list(ids)
        self.ids = list(ids.values())
        #: words of each item that a page must print in a row
        self.limits = [min_words if min_share is None else max(1, min(min_words, math.ceil(min_share * len(s)))) for s in self.sequences]
        self.limit = min((n for s, n in zip(self.sequences, self.limits) if s), default=min_words)
        numbers: dict[tuple[str, str], int] = {}
        self.words: list[str] = []
        tokens = []
        self.vocabulary: list[set[int]] = []
        for sequence in self.sequences:
            row: list[int] = []
            for word in sequence:
                form = folded(word), key(word)
                if form not in numbers:
                    numbers[form] = len(self.words)
                    self.words.append(word)
                row.append(numbers[form])
            tokens.append(row)
            self.vocabulary.append(set(row))
        self.automaton = Automaton(tokens)
        self.one = Lexicon(self.words)
        self.twos = sorted({pair for row in tokens for pair in pairwise(row)})
        self.two = Lexicon([self.words[a] + self.words[b] for a, b in self.twos])
        self.known: dict[str, tuple[list[int], list[tuple[int, int]] | None, str, str, int]] = {}
        self.after: dict[int, tuple[int, dict[int, list[tuple[int, int]]]]] = {}
        self.held: dict[int, set[int]] = {}
        self.steady: dict[int, int] = {}
        self._arrays()

    def _arrays(self) -> None:
        """What the array operations need: numbers of page words, their readings, and the automaton's first steps."""
        self.numbers: dict[str, int] = {}
        self.read_as, self.read_from = array("q"), array("q", [0])
        self.easy = max(1, self.limit // 2)
        steps = [(state, word, to) for state, following in enumerate(self.automaton.next) if state == 0 or self.automaton.length[self.automaton.link[state]] + 1 < self.easy for word, to in following.items()]
        states, words, self.step_to = (np.array(c, dtype=np.int64) for c in (zip(*steps) if steps else ((), (), ())))
        keys = states * max(1, len(self.words)) + words
        order = np.argsort(keys)
        self.step_keys, self.step_to = keys[order], self.step_to[order]
        bits = max(10, int(len(keys) * 32).bit_length())
        self.sieve = np.zeros(1 << bits, dtype=bool)
        self.sieve[_hashed(keys, bits)] = True
        self.printed = array("Q")  # four numbers of each page word: hash and factor of both forms
        self.whole = np.unique(np.array([_polynomial(form)[0] for form in self.one.equal], dtype=np.uint64))
        self.root = np.zeros(max(1, len(self.words)), dtype=np.int64)
        for word, to in self.automaton.next[0].items():
            self.root[word] = to

    def _number(self, printed: str) -> int:
        self.numbers[printed] = n = len(self.numbers)
        reading = self.known[printed] if printed in self.known else self._reading(printed)
        self.read_as.extend(reading[0])
        self.read_from.append(len(self.read_as))
        own = _polynomial(reading[2])
        self.printed.extend(own + (own if reading[3] == reading[2] else _polynomial(reading[3])))
        return n

    def _whole(self, printed: np.ndarray, heads: np.ndarray, rests: np.ndarray) -> np.ndarray:
        """Which heads and rests (numbers of page words) may put together be a word of the items, as printed."""
        found = np.zeros(len(heads), dtype=bool)
        for form in (0, 2):
            joined = printed[heads, form] * printed[rests, form + 1] + printed[rests, form]
            at = np.minimum(np.searchsorted(self.whole, joined), len(self.whole) - 1)
            found |= self.whole[at] == joined
        return np.flatnonzero(found)

    def _steps(self, states: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the states go on with the word, and where to."""
        keys = states * len(self.words) + words
        maybe = np.flatnonzero(self.sieve[_hashed(keys, len(self.sieve).bit_length() - 1)])
        keys = keys[maybe]
        at = np.minimum(np.searchsorted(self.step_keys, keys), len(self.step_keys) - 1)
        there = self.step_keys[at] == keys
        return maybe[there], self.step_to[at[there]]

    def promising(self, pages: Sequence[tuple[list[tuple[int, int, list[str], bool]], int]]) -> tuple[dict[int, set[int]], "Layout"]:
        """Items of which a page prints enough easy words in a row, by page number; and how the pieces stand."""
        if len(self.numbers) >= KNOWN:
            self.numbers.clear()
            self.read_as, self.read_from, self.printed = array("q"), array("q", [0]), array("Q")
        numbers, number = self.numbers, self._number
        pieces = [(n, lines, *piece, len(piece[2])) for n, (own, lines) in enumerate(pages) for piece in own]
        token = np.array([numbers[w] if w in numbers else number(w) for p in pieces for w in p[4]], dtype=np.int64)
        page, lines, line, column, size = (np.fromiter((p[k] for p in pieces), np.int64, len(pieces)) for k in (0, 1, 2, 3, 6))
        layout = Layout(page, *successions(page, line, column, lines))
        if not len(token) or not len(self.step_keys):
            return {}, layout
        stop = np.cumsum(size)
        start = stop - size
        first, second = np.repeat(np.arange(len(pieces)), layout.count), layout.which
        # where a run goes on from each word: to the next of its piece, or to the first of those that can follow
        count = np.ones(len(token), dtype=np.int64)
        count[stop - 1] = layout.count
        begin = np.cumsum(count) - count
        target = np.zeros(int(count.sum()), dtype=np.int64)
        inner = np.ones(len(token), dtype=bool)
        inner[stop - 1] = False
        target[begin[inner]] = np.flatnonzero(inner) + 1
        target[_spread(begin[stop - 1], layout.count)[1]] = start[second]
        # to words that are none of the items' nothing goes on
        kept = (np.diff(np.frombuffer(self.read_from, dtype=np.int64)) > 0)[token[target]]
        before = np.concatenate([[0], np.cumsum(kept)])
        count = before[begin + count] - before[begin]
        begin, target = before[begin], target[kept]
        # words parted at the end of a piece: from the word before, with the word that the parts are, to the rest's place
        equal, known = self.one.equal, self.known
        parted = np.flatnonzero(np.array([p[5] for p in pieces])[first])
        printed = np.frombuffer(self.printed, dtype=np.uint64).reshape(-1, 4)
        parted = parted[self._whole(printed, token[stop[first[parted]] - 1], token[start[second[parted]]])]
        joins = []
        for a, b in zip(first[parted].tolist(), second[parted].tolist()):
            head, rest = known.get(pieces[a][4][-1]) or self._reading(pieces[a][4][-1]), known.get(pieces[b][4][0]) or self._reading(pieces[b][4][0])
            plain, short = head[2] + rest[2], head[3] + rest[3]
            if plain in equal or short in equal:
                joins += [(a, b, w) for w in {*equal.get(plain, ()), *equal.get(short, ())}]
        joined, rest, word = (np.array(c, dtype=np.int64) for c in (zip(*joins) if joins else ((), (), ())))
        alone = size[joined] == 1  # the word before a head that is its piece's only word ends another piece
        back = np.argsort(second, kind="stable")
        before = np.searchsorted(second[back], joined[alone])
        owner, at = _spread(before, np.searchsorted(second[back], joined[alone], "right") - before)
        source = np.concatenate([stop[joined[~alone]] - 2, stop[first[back][at]] - 1])
        through = np.concatenate([word[~alone], word[alone][owner]])
        arrive = np.concatenate([start[rest[~alone]], start[rest[alone]][owner]])
        order = np.argsort(source, kind="stable")
        source, through, arrive = source[order], through[order], arrive[order]

        read_as, read_from = np.frombuffer(self.read_as, dtype=np.int64) if len(self.read_as) else np.zeros(0, dtype=np.int64), np.frombuffer(self.read_from, dtype=np.int64)
        found: dict[int, set[int]] = {}
        width = np.int64(len(self.automaton.next))
        owner_of = np.repeat(np.arange(len(size)), size)
        for low in range(0, len(token), STARTS):
            own = np.arange(low, min(low + STARTS, len(token)))
            owner, at = _spread(read_from[token[own]], read_from[token[own] + 1] - read_from[token[own]])
            here = (start[rest] >= low) & (start[rest] < low + STARTS)
            place, state = np.concatenate([own[owner], start[rest][here]]), np.concatenate([self.root[read_as[at]], self.root[word[here]]])
            for _ in range(self.easy - 1):
                owner, at = _spread(begin[place], count[place])
                place_to, state_of = target[at], state[owner]
                owner, at = _spread(read_from[token[place_to]], read_from[token[place_to] + 1] - read_from[token[place_to]])
                went, to = self._steps(state_of[owner], read_as[at])
                marks = [place_to[owner[went]] * width + to]
                if len(source):
                    by = np.searchsorted(source, place)
                    owner, at = _spread(by, np.searchsorted(source, place, "right") - by)
                    went, to = self._steps(state[owner], through[at])
                    marks.append(arrive[at[went]] * width + to)
                place, state = np.divmod(np.unique(np.concatenate(marks)), width)
                if not len(place):
                    break
            for n, s in set(zip(page[owner_of[place]].tolist(), state.tolist())):
                found.setdefault(n, set()).update(self._holders(s))
        return found, layout

    def _holders(self, state: int) -> set[int]:
        if len(self.held) >= KNOWN:
            self.held.clear()
        if state not in self.held:
            self.held[state] = self.automaton.holders(state, self.held)
        return self.held[state]

    def __reduce__(self):
        return Items, (self.rows, self.min_words, self.min_share)

    def _reading(self, printed: str) -> tuple[list[int], None, str, str, int]:
        """The words that a page word can be a scan of, room for the pairs of words, and its forms and letters."""
        if len(self.known) >= KNOWN:
            self.known.clear()
        plain, short = folded(printed), key(printed)
        self.known[printed] = made = self.one.find(printed), None, plain, short, _letters(plain)
        return made

    def _reading_of_two(self, printed: str) -> tuple[list[int], list[tuple[int, int]], str, str, int]:
        """:meth:`_reading` with the pairs of words, which few pages need."""
        one, _, plain, short, letters = self.known.get(printed) or self._reading(printed)
        self.known[printed] = made = one, [self.twos[n] for n in self.two.find(printed)] if len(printed) > 2 else [], plain, short, letters
        return made

    def _following(self, state: int) -> tuple[int, dict[int, list[tuple[int, int]]]]:
        """What follows the last two words of a state: lengths (bits) that it can be printed in, and the words with their letters by such a length."""
        link, length = self.automaton.link, self.automaton.length
        top, passed = state, [state]
        while length[link[top]] >= 2 and top not in self.after:
            top = link[top]
            passed.append(top)
        if top not in self.after:
            words: dict[int, dict[int, int]] = defaultdict(dict)
            for word in self.automaton.next[top]:
                for form, letters in zip(self.one.forms[word][:2], self.one.letters[word]):
                    for size in range(len(form) - 2, len(form) + 3) if form else ():
                        words[size][word] = letters
            self.after[top] = sum(1 << size for size in words if size >= 0), {size: list(at.items()) for size, at in words.items()}
        for state in passed:
            self.after[state] = self.after[top]
        return self.after[top]

    def _shortest(self, state: int) -> int:
        """The state of the shortest end, of :data:`STEADY` words or more, of a state's passages; all that follows them follows it."""
        link, length = self.automaton.link, self.automaton.length
        top, passed = state, []
        while top not in self.steady and length[link[top]] >= STEADY:
            passed.append(top)
            top = link[top]
        top = self.steady.get(top, top)
        for state in passed:
            self.steady[state] = top
        return top

    def read(self, pieces: Sequence[tuple[int, int, list[str], bool]], follow: list[list[int]], wrap: list[list[int]], wanted: set[int] | None = None) -> dict[int, int]:
        """Longest run of consecutive words that the page prints, by item number, of the (wanted) items that reach their limit.

        A run may start anywhere and goes from a word to the next of its piece or, from the end of
        a piece, to the start of one that can follow. A word printed as two, or broken at a
        piece's end, may also be misread if two words were read before it. One unreadable word may
        be crossed after :data:`STEADY` read ones, never at the ends of a run.
        """
        nxt, link, length = self.automaton.next, self.automaton.link, self.automaton.length
        known, after, words_of = self.known, self.after, self.words
        root, full = nxt[0], self.limit << 3
        fresh = True  # whether runs may start
        allowed = set(range(len(self.words))) if wanted is None else set().union(*(self.vocabulary[item] for item in wanted))
        best: Runs = {}

        def merge(entering: Runs, parted: list, runs: Runs, head: tuple[str, Runs] | None) -> None:
            for state, run in runs.items():
                if run > entering.get(state, 0):
                    entering[state] = run
            if head is not None:
                parted.append(head)

        def grow(now: Runs, before: Runs, word: int, least: int = 0) -> bool:
            """Runs of at least ``least`` words, or the longest ends of them that are followed by ``word``, go on to it."""
            went = False
            for state, run in before.items():
                to = nxt[state].get(word)
                while to is None:
                    state = link[state]
                    n = length[state]
                    if state <= 0 or n < least:
                        break
                    run = n << 3 | min(run & 7, n)
                    to = nxt[state].get(word)
                if to is None or run < least << 3:
                    continue
                went = True
                run += 9 if run & 7 < 7 else 8
                if run > now.get(to, 0):
                    now[to] = run
            return went

        def cross(now: Runs, before: Runs, printed: str) -> None:
            """Steady runs pass a word that may be a bad scan of the next; only the word after it can end them.

            A word is passed from the longest end of a run that it can follow; shorter ends are ends of that.
            """
            for state, run in before.items():
                if run & 7 < STEADY:
                    continue
                left = [w for w in nxt[self._shortest(state)] if w in allowed and near_word(printed, words_of[w])]
                while left and run & 7 >= STEADY:
                    following, n = nxt[state], run & ~7
                    for word in left:
                        if word in following and n + 8 > now.get(following[word], 0):
                            now[following[word]] = n + 8
                    left = [w for w in left if w not in following]
                    state = link[state]
                    run = length[state] << 3 | min(run & 7, length[state]) if state > 0 else 0

        def walk(piece: list[str], before: Runs, heads: Sequence[tuple[str, Runs]]) -> tuple[Runs, Runs]:
            """The runs at the last word of a piece, and those before it; unless ``fresh`` no run starts in it."""
            before2: Runs = {}
            last = None
            top, top2 = max(before.values(), default=0), 0
            for word in piece:
                reading = known.get(word)
                if reading is None or reading[1] is None:
                    reading = self._reading_of_two(word)
                now: Runs = {}
                for w in reading[0]:
                    if w not in allowed:
                        continue
                    went = False
                    for state, run in before.items():  # as in grow
                        to = nxt[state].get(w)
                        while to is None:
                            state = link[state]
                            if state <= 0:
                                break
                            n = length[state]
                            run = n << 3 | min(run & 7, n)
                            to = nxt[state].get(w)
                        if to is not None:
                            went = True
                            run += 9 if run & 7 < 7 else 8
                            if run > now.get(to, 0):
                                now[to] = run
                    if not went and fresh:
                        now.setdefault(root[w], 9)
                for a, b in reading[1]:
                    if a not in allowed or b not in allowed:
                        continue
                    middle: Runs = {}
                    if not (before and grow(middle, before, a)) and fresh:
                        middle[root[a]] = 9
                    if middle:
                        grow(now, middle, b)
                if last is None:
                    for head, runs in heads:
                        put_together(now, runs, max(runs.values(), default=0), known[head] if head in known else self._reading(head), reading)
                elif before2 or fresh:
                    put_together(now, before2, top2, last, reading)
                if now:
                    top2, new_top = top, max(now.values())
                    if new_top >= full:
                        for state, run in now.items():
                            if run >= full and run > best.get(state, 0):
                                best[state] = run
                elif not (fresh or before):
                    return {}, {}
                else:
                    top2, new_top = top, 0
                if top >= STEADY << 3:
                    cross(now, before, word)
                    new_top = max(now.values(), default=0)
                before, before2, last, top = now, before, reading, new_top
            return before, before2

        one_word, equal = self.one, self.one.equal

        def put_together(now: Runs, runs: Runs, top: int, first: tuple, second: tuple) -> None:
            plain, short = first[2] + second[2], first[3] + second[3]
            found = equal.get(plain, ())
            if short != plain and short in equal:
                found = {*found, *equal[short]}
            for w in found:
                if w in allowed and not (runs and grow(now, runs, w)) and fresh and root[w] not in now:
                    now[root[w]] = 9
            if top < 16:
                return
            letters = 0
            for state, run in runs.items():
                if run < 16:
                    continue
                bits, words = after[state] if state in after else self._following(state)
                for form in (plain,) if plain == short else (plain, short):
                    if bits >> len(form) & 1:
                        if form is short and short != plain:
                            letters = _letters(short)
                        elif not letters:
                            letters = first[4] | second[4] | _letters(first[2][-1:] + second[2][:1])
                        most = 6 if len(form) > 5 else 3
                        for w, other in words[len(form)]:
                            if w in allowed and (other & ~letters).bit_count() <= most and (letters & ~other).bit_count() <= most and w not in found and one_word.reads(w, plain, short):
                                grow(now, {state: run}, w, 2)

        ends: list[Runs] = []
        heads: list[tuple[str, Runs] | None] = []
        for b, (_, _, piece, broken) in enumerate(pieces):
            entering: Runs = {}
            parted: list[tuple[str, Runs]] = []
            for a in follow[b]:
                merge(entering, parted, ends[a], heads[a])
            end, earlier = walk(piece, entering, parted)
            ends.append(end)
            heads.append((piece[-1], earlier if len(piece) > 1 else entering) if broken else None)
        # from the foot of a column to the head of the next, which may have been passed before
        fresh = False
        added: dict[int, tuple[Runs, tuple[str, Runs] | None]] = {}  # what came to a piece's end only this way
        for b, (_, _, piece, broken) in enumerate(pieces):
            entering, parted = {}, []
            for a in wrap[b]:
                merge(entering, parted, ends[a], heads[a])
            if added:
                for a in follow[b]:
                    if a in added:
                        merge(entering, parted, *added[a])
            if entering or parted:
                end, earlier = walk(piece, entering, parted)
                earlier = earlier if len(piece) > 1 else entering
                if end or broken and earlier:
                    added[b] = end, (piece[-1], earlier) if broken and earlier else None
        return self._found(best, wanted)

    def _found(self, best: Runs, wanted: set[int] | None) -> dict[int, int]:
        """Longest run by item number: a passage is held by the items of its state, its ends also by those of shorter ones."""
        link, length = self.automaton.link, self.automaton.length
        longest: Runs = {}
        for state, run in best.items():
            n = run >> 3
            while state > 0 and n >= self.limit and n > longest.get(state, 0):
                longest[state] = n
                state = link[state]
                n = length[state]
        out: dict[int, int] = {}
        # longer passages first, so that those of shorter ones are found from theirs
        for state, n in sorted(longest.items(), key=lambda found: -length[found[0]]):
            for item in self._holders(state) if wanted is None else self._holders(state) & wanted:
                if n >= self.limits[item] and n > out.get(item, 0):
                    out[item] = n
        return out

    def rows_of(self, texts: Sequence[str]) -> list[tuple[int, int, int, float]]:
        """``(page number, item_id, words, share)`` of every item found on the pages."""
        tidy = gc.isenabled()
        gc.disable()  # nothing made here refers to itself, and looking for that takes a tenth of the time
        try:
            return self._rows_of(texts)
        finally:
            if tidy:
                gc.enable()

    def _rows_of(self, texts: Sequence[str]) -> list[tuple[int, int, int, float]]:
        pages = [pieces_of(t) for t in texts]
        wanted, layout = self.promising(pages)
        out = []
        for n, items in sorted(wanted.items()):
            for item, words in sorted(self.read(pages[n][0], *layout.of(n), items).items()):
                out += [(n, i, words, words / len(self.sequences[item])) for i in self.ids[item]]
        return out


def _blocks(items: DataFrame, item_id: str, item_text: str) -> Iterator[list[tuple[int, str]]]:
    """The distinct items with words in blocks of about :data:`BLOCK_WORDS` words, by the hash of their text."""
    known = items.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).cast("bigint").alias("i"), F.col(item_text).alias("t")).distinct()
    words = known.agg(F.sum(F.size(F.split("t", r"[\s\p{Punct}]+")).cast("bigint"))).first()[0] or 0
    number = max(1, math.ceil(words / BLOCK_WORDS))
    for block in range(number):
        rows = known.where(F.pmod(F.xxhash64("t"), F.lit(number)) == block) if number > 1 else known
        yield sorted((r[0], r[1]) for r in rows.collect())


def leaks(
    documents: DataFrame, items: DataFrame, *, min_words: int = 12, min_share: float | None = None, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "item_text"
) -> DataFrame:
    """``(doc_id, item_id, words, share)``: every page that prints enough consecutive words of an item.

    Enough are ``min_words``, or where ``min_share`` is given that share of the item's words, if
    these are fewer. ``words`` is the longest run, ``share`` its part of the item. Case,
    punctuation, accents and what is listed above do not matter. Items that are null, empty or
    too short are never found; null and empty pages print nothing; pages of any length are read
    whole. Repeated pages are reported each, repeated items by every id.

    Any number of items is taken: they are split into blocks of about :data:`BLOCK_WORDS` words,
    of which each is sent to the tasks in turn and the results are put together. One item must fit
    into a task.
    """
    pages = documents.where(F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(doc_id).cast("bigint").alias(doc_id), text)
    found = None
    for rows in _blocks(items, item_id, item_text):
        part = _read_pages(pages, Items(rows, min_words, min_share), doc_id, item_id)
        found = part if found is None else found.unionByName(part)
    return found


def _read_pages(pages: DataFrame, block: Items, doc_id: str, item_id: str) -> DataFrame:
    shared = pages.sparkSession.sparkContext.broadcast(block)

    def some(known: Items, docs: list[int | None], texts: list[str]) -> pa.RecordBatch:
        columns = list(zip(*((docs[n], *row) for n, *row in known.rows_of(texts)))) or [[]] * 4
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds)], names=[doc_id, item_id, "words", "share"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Items = shared.value
        for batch in batches:
            docs, texts, size = [], [], 0
            for doc, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                docs.append(doc)
                texts.append(page)
                size += len(page)
                if size >= AT_ONCE:
                    yield some(known, docs, texts)
                    docs, texts, size = [], [], 0
            if docs:
                yield some(known, docs, texts)

    return pages.mapInArrow(run, f"{doc_id} bigint, {item_id} bigint, words int, share double")
