"""Lines that were decoded with a wrong character encoding, found and restored.

A hidden Markov model has one clean state and one state per pair of encodings. Only characters
outside ASCII are observed (ASCII reads the same under every pair), each with a little context.
The emissions are learned from all pages: as they are for the clean state, and garbled by the
pair for its state. The most likely path labels every character; a labelled span
gets the inverse transform of its state. Pages are labelled many at a time with array operations
and independently of each other, so no shuffle is needed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values: (name, encoding the bytes were written in, encoding they were read in).
PAIRS = (
    ("utf-8 as windows-1252", "utf-8", "cp1252"),
    ("utf-8 as latin-1", "utf-8", "latin-1"),
    ("utf-8 twice as windows-1252", "utf-8*2", "cp1252"),
    ("utf-8 as mac-roman", "utf-8", "mac_roman"),
    ("utf-8 as cp437", "utf-8", "cp437"),
    ("utf-8 as cp850", "utf-8", "cp850"),
    ("utf-8 as windows-1251", "utf-8", "cp1251"),
    ("utf-8 as windows-1250", "utf-8", "cp1250"),
    ("utf-8 as koi8-r", "utf-8", "koi8-r"),
    ("utf-8 as cp866", "utf-8", "cp866"),
    ("windows-1251 as windows-1252", "cp1251", "cp1252"),
    ("windows-1250 as windows-1252", "cp1250", "cp1252"),
    ("latin-2 as latin-1", "iso8859-2", "latin-1"),
    ("koi8-r as windows-1251", "koi8-r", "cp1251"),
    ("windows-1251 as koi8-r", "cp1251", "koi8-r"),
    ("koi8-r as windows-1252", "koi8-r", "cp1252"),
    ("cp866 as windows-1251", "cp866", "cp1251"),
    ("windows-1252 as mac-roman", "cp1252", "mac_roman"),
    ("mac-roman as windows-1252", "mac_roman", "cp1252"),
    ("windows-1252 as cp437", "cp1252", "cp437"),
    ("windows-1252 as cp850", "cp1252", "cp850"),
    ("windows-1252 as windows-1251", "cp1252", "cp1251"),
    ("windows-1252 as windows-1250", "cp1252", "cp1250"),
)
#: Characters of a text that are labelled as one sequence, and of all texts that are labelled at a time.
PIECE, AT_ONCE = 1 << 17, 1 << 20
#: Characters outside ASCII, times texts, that one array of the labelling holds (each with a number per state).
CELLS = 1 << 17
LOST = "bytes lost"  # what was read became U+FFFD
STATES = tuple(p[0] for p in PAIRS) + (LOST,)
#: Pages of the training sample of :func:`fit` (those with the smallest hash of their id), and the length of the pieces that training takes of longer ones.
TRAIN_PAGES, TRAIN_CHARS = 2000, 20_000
_WIDE = 1 << 16
#: Log probability of a letter pair that was never seen, and the least of any other.
UNSEEN = -12.0
#: Keys that a task holds before it sums or sends them.
KEYS = 1 << 20
_CODES, _SHIFT = 0x110000, 21  # code points; bits of one in a key
_FIRST, _BOTH, _TEXTS = range(len(PAIRS) + 1, len(PAIRS) + 4)  # kinds of counts; the lower ones are of observations
#: Log chances of entering each state and of leaving one; chosen, not fitted, since the pages are unlabelled:
#: one character outside ASCII in fifty begins or ends a garbled span, which is what one garbled word a
#: page comes to. What UTF-8 sequences become decodes back or does not, so those states cost less than pairs
#: of single-byte encodings, where all decodes and a few letters must not make a span.
ENTER = np.array([np.log(2e-2 if p[1].startswith("utf-8") else 1e-5) for p in PAIRS] + [np.log(2e-2)], dtype=np.float32)
LEAVE = float(np.log(2e-2))
_REPLACEMENT = "�"


@cache
def _to_byte(encoding: str) -> dict[str, int]:
    """Characters a byte can have become when it was read in ``encoding``; undefined bytes pass as C1."""
    made: dict[str, int] = {}
    for b in range(128, 256):
        try:
            made[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            made.setdefault(chr(b), b)
    if encoding == "cp1252":
        for b in range(128, 160):
            made.setdefault(chr(b), b)
    return made


@cache
def _from_byte(encoding: str) -> dict[int, str]:
    out = {b: bytes([b]).decode(encoding, errors="replace") for b in range(128)}
    for b in range(128, 256):
        c = bytes([b]).decode(encoding, errors="replace")
        out[b] = chr(b) if c == _REPLACEMENT else c
    return out


@cache
def _garbled(c: str, written: str, read: str) -> str:
    """What a character outside ASCII becomes; "?" when it cannot be written."""
    try:
        return "".join(_from_byte(read)[b] for b in c.encode(written))
    except UnicodeEncodeError:
        return "?"


def garble(text: str, written: str, read: str) -> str:
    """``text`` written in one encoding and read in another; "?" stands for what cannot be written."""
    for _ in range(2 if written.endswith("*2") else 1):
        text = text.translate({ord(c): _garbled(c, written.removesuffix("*2"), read) for c in set(text) if not c.isascii()})
    return text


@cache
def _back(written: str, read: str):
    """Single-byte pairs: the character each character was."""
    return {c: bytes([b]).decode(written, errors="replace") for c, b in _to_byte(read).items()}


def _decode_run(run: str, read: str) -> str | None:
    """Inverse of reading UTF-8 in ``read``, for a run of characters outside ASCII."""
    table = _to_byte(read)
    raw = bytearray()
    for c in run:
        b = table.get(c)
        if b is None:
            return None
        raw.append(b)
    try:
        return bytes(raw).decode("utf-8")
    except UnicodeDecodeError:
        return None


def _restore_utf8(run: str, read: str) -> str:
    """As much of a run as decodes; characters that are no part of a sequence stay as they are."""
    whole = _decode_run(run, read)
    if whole is not None:
        return whole
    table, out, i = _to_byte(read), [], 0
    while i < len(run):
        lead = table.get(run[i], 0)
        need = 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 0
        piece = _decode_run(run[i : i + need], read) if need and i + need <= len(run) else None
        out.append(run[i] if piece is None else piece)
        i += 1 if piece is None else need
    return "".join(out)


def restore(span: str, state: str) -> str:
    """The span before it was read wrongly, as far as the state's inverse transform is defined."""
    if state == LOST:
        return span
    _, written, read = PAIRS[STATES.index(state)]
    times = 1
    if written.endswith("*2"):
        written, times = written[:-2], 2
    for _ in range(times):
        if written != "utf-8":
            back = _back(written, read)
            span = "".join(c if c.isascii() else back.get(c, c) for c in span)
            continue
        out, start = [], None
        for i, c in enumerate(span + " "):
            if c.isascii():
                if start is not None:
                    out.append(_restore_utf8(span[start:i], read))
                    start = None
                out.append(c)
            elif start is None:
                start = i
        span = "".join(out)[:-1]
    return span


@cache
def _classes() -> np.ndarray:
    """Per code point below 65 536: 1 letter, 2 upper-case letter (also a letter), 0 other."""
    kinds = np.zeros(_WIDE, dtype=np.uint8)
    for i in range(_WIDE):
        c = chr(i)
        if c.isalpha():
            kinds[i] = 2 if c.isupper() else 1
    return kinds


def observe(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the characters outside ASCII and what is observed there.

    An observation is the code point and one bit of context: for an upper-case letter, whether
    the character before is one too; for any other character that is no letter, whether it
    stands between two letters. Code points beyond the basic plane are observed as U+FFFF.
    """
    at = np.flatnonzero(codes >= 128)
    before = np.where(at > 0, codes[at - 1], 0)
    after = np.where(at + 1 < len(codes), codes[np.minimum(at + 1, len(codes) - 1)], 0)
    return at, _seen(codes[at], before, after)


def _seen(codes: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """What is observed of characters between those before and after them."""
    low = np.minimum(codes, _WIDE - 1)
    own, left, right = (_classes()[x] for x in (low, np.minimum(before, _WIDE - 1), np.minimum(after, _WIDE - 1)))
    context = np.where(own == 2, left == 2, (own == 0) & (left > 0) & (right > 0))
    return low.astype(np.int64) + _WIDE * context


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


@dataclass(frozen=True)
class Model:
    """Log odds of every pair's state against the clean state, by observation; and letter pairs of clean text."""

    rows: np.ndarray  # observations that have odds of their own
    values: np.ndarray  # (rows, states), float32
    rest: np.ndarray  # of any other observation
    pairs: dict[str, float]  # log probability of a character after another, without case

    @cached_property
    def odds(self) -> np.ndarray:
        full = np.repeat(self.rest[None, :], 2 * _WIDE, axis=0)
        full[self.rows] = self.values
        return full

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "odds"}

    def likelihood(self, text: str) -> float:
        """Log probability of the text by its character pairs."""
        low = f" {text.lower()} "
        return sum(self.pairs.get(low[i : i + 2], UNSEEN) for i in range(len(low) - 1) if low[i] > "\x7f" or low[i + 1] > "\x7f" or low[i : i + 2].isalpha())


@cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """ASCII and the characters that a pair of single-byte encodings changes or makes, without case; and the number there of every code point, or -1.

    A letter pair of none of them weighs the same before and after the inverse of such a pair, so it is not kept.
    """
    made = set(map(chr, range(128)))
    for _, written, read in PAIRS:
        if not written.startswith("utf-8"):
            made.update(*_back(written, read).items())
    codes = np.array(sorted({ord(x) for c in made for x in c + ("a" + c).lower()}), dtype=np.int64)
    number = np.full(_CODES, -1, dtype=np.int32)
    number[codes] = np.arange(len(codes))
    return codes, number


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Every key once, with the sum of its numbers unless that is zero."""
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    n = np.bincount(at, weights=np.concatenate([n for _, n in parts]), minlength=len(keys)).astype(np.int64)
    return keys[n != 0], n[n != 0]


class _Counts:
    """What a model is made of: whole numbers whose sums are the same however the texts are split."""

    def __init__(self) -> None:
        self.texts = 0
        self.seen = np.zeros((len(PAIRS) + 1, 2 * _WIDE), dtype=np.int64)  # observations of the texts as they are, then garbled by each pair
        self.first = np.zeros(_CODES, dtype=np.int64)  # characters that another follows, without case
        self.both = np.zeros(len(_letters()[0]) ** 2, dtype=np.int64)  # pairs of the letters
        none = np.zeros(0, dtype=np.int64)
        self.mixed = [(none, none)]  # pairs of a letter and any other character
        self.near = [(none, none)]  # characters outside ASCII between their neighbours, not garbled yet

    def add(self, texts: list[str]) -> None:
        self.texts += len(texts)
        codes = _codes("\n".join(["", *texts, ""]))
        at = np.flatnonzero(codes >= 128)
        if len(at):
            # of an ASCII neighbour only its class is observed
            like = np.array([ord("\n"), ord("a"), ord("A")])[_classes()[:128]]
            before, after = (np.where(x < 128, like[np.minimum(x, 127)], x) for x in (codes[at - 1], codes[at + 1]))
            self.near.append(np.unique(((before << _SHIFT | codes[at]) << _SHIFT) | after, return_counts=True))
        if sum(len(k) for k, _ in self.near) > KEYS:
            self.garble()
        words = " ".join(" ".join(texts).lower().split())
        if words:
            codes = _codes(f" {words} ")
            self.first += np.bincount(codes[:-1], minlength=_CODES)
            letters, number = _letters()
            own = number[codes]
            is_letter = own >= 0
            two, one = is_letter[:-1] & is_letter[1:], is_letter[:-1] ^ is_letter[1:]
            self.both += np.bincount(own[:-1][two] * len(letters) + own[1:][two], minlength=len(self.both))
            if one.any():
                self.mixed.append(np.unique(codes[:-1][one].astype(np.int64) << _SHIFT | codes[1:][one], return_counts=True))
                if sum(len(k) for k, _ in self.mixed) > KEYS:
                    self.mixed = [_summed(self.mixed)]

    def garble(self) -> None:
        """Count the observations of the texts, and of what each pair makes of them."""
        keys, n = _summed(self.near)
        self.near = self.near[:1]
        mask = (1 << _SHIFT) - 1
        chars, at = np.unique(np.concatenate([keys >> 2 * _SHIFT, keys >> _SHIFT & mask, keys & mask]), return_inverse=True)
        before, own, after = at.reshape(3, -1)
        for k, made in enumerate([[chr(c) for c in chars], *([garble(chr(c), written, read) for c in chars] for _, written, read in PAIRS)]):
            lengths = np.array([len(m) for m in made], dtype=np.int64)
            table = np.zeros((len(chars), max(lengths, default=0)), dtype=np.int64)
            table[np.arange(table.shape[1]) < lengths[:, None]] = _codes("".join(made))
            last = table[np.arange(len(chars)), lengths - 1]
            for j in range(table.shape[1]):
                some = np.flatnonzero((lengths[own] > j) & (table[own, j] >= 128))
                o = own[some]
                left = table[o, j - 1] if j else last[before[some]]
                right = np.where(lengths[o] > j + 1, table[o, min(j + 1, table.shape[1] - 1)], table[after[some], 0])
                self.seen[k] += np.bincount(_seen(table[o, j], left, right), weights=n[some], minlength=2 * _WIDE).astype(np.int64)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        letters, _ = _letters()
        at = np.flatnonzero(self.both)
        return _summed([*self.mixed, (letters[at // len(letters)] << _SHIFT | letters[at % len(letters)], self.both[at])])

    def rows(self) -> pa.RecordBatch:
        """The counts as ``(kind, key, n)``."""
        self.garble()
        kinds, keys = np.nonzero(self.seen)
        first = np.flatnonzero(self.first)
        pairs, numbers = self.pairs()
        columns = (
            np.concatenate([kinds, np.full(len(first), _FIRST), np.full(len(pairs), _BOTH), [_TEXTS]]),
            np.concatenate([keys, first, pairs, [0]]),
            np.concatenate([self.seen[kinds, keys], self.first[first], numbers, [self.texts]]),
        )
        return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns], names=["kind", "key", "n"])

    @classmethod
    def of_rows(cls, rows: pa.Table | pa.RecordBatch) -> _Counts:
        """The counts of rows whose keys are all different."""
        made = cls()
        kinds, keys, n = (rows.column(c).to_numpy() for c in ("kind", "key", "n"))
        low = kinds < _FIRST
        made.seen[kinds[low], keys[low]] = n[low]
        made.first[keys[kinds == _FIRST]] = n[kinds == _FIRST]
        made.mixed.append((keys[kinds == _BOTH], n[kinds == _BOTH]))
        made.texts = int(n[kinds == _TEXTS].sum())
        return made

    def without(self, other: _Counts) -> _Counts:
        """The counts of the texts that ``other`` has not counted."""
        made = _Counts()
        self.garble()
        other.garble()
        made.texts, made.seen, made.first = self.texts - other.texts, self.seen - other.seen, self.first - other.first
        keys, n = other.pairs()
        made.mixed.append(_summed([self.pairs(), (keys, -n)]))
        return made

    def model(self) -> Model:
        self.garble()
        unseen = 0.05  # added to every observation's count
        clean = self.seen[0]
        base = np.log((clean + unseen) / (clean.sum() + 2000 * unseen))
        odds = np.zeros((2 * _WIDE, len(STATES)), dtype=np.float32)
        for k, (_, _, read) in enumerate(PAIRS):
            seen = self.seen[k + 1]
            # what the encoding cannot write is missing, so that characters it keeps are no evidence for it
            odds[:, k] = np.log((seen + unseen * 0.02) / (max(seen.sum(), clean.sum()) + 2000 * unseen)) - base
            if read in ("cp1252", "cp1250", "cp1251"):
                odds[ord(_REPLACEMENT), k] = 0.0
        odds[:, -1] = -12.0
        odds[[ord(_REPLACEMENT), ord(_REPLACEMENT) + _WIDE], -1] = 12.0
        rest = odds[-1].copy()
        rows = np.flatnonzero((odds != rest).any(axis=1))
        keys, n = self.pairs()
        chance = np.log(n / self.first[keys >> _SHIFT])
        known = chance > UNSEEN
        pairs = {chr(p >> _SHIFT) + chr(p & (1 << _SHIFT) - 1): c for p, c in zip(keys[known].tolist(), chance[known].tolist())}
        return Model(rows, odds[rows], rest, pairs)


def train(pages: list[str], rounds: int = 2) -> Model:
    """Fit the emissions to pages; pages that the fitted model finds garbled leave the next round."""
    kept = pages
    model = None
    for _ in range(rounds):
        counts = _Counts()
        for k in range(0, len(kept), 50):
            counts.add(kept[k : k + 50])
        model = counts.model()
        labelled = (spans for k in range(0, len(kept), 50) for spans in label(kept[k : k + 50], model))
        kept = [p for p, spans in zip(kept, labelled) if not garbled_lines(p, spans, model)] or kept
    return model


def label(texts: list[str], model: Model) -> list[list[tuple[int, int, int]]]:
    """Per text, spans ``(first, last, state)`` of character positions labelled with a pair's state."""
    result: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    codes = _codes("\n\n".join(texts))
    ends = np.cumsum([len(t) + 2 for t in texts])
    at, seen = observe(codes)
    if not len(at):
        return result
    owner = np.searchsorted(ends, at, side="right")
    starts = np.flatnonzero(np.diff(owner, prepend=-1))
    stops = np.append(starts[1:], len(at))
    # what a path can gain outside the clean state at most; without any the text is clean (a span at the end leaves for nothing)
    reach = np.empty(len(starts), dtype=np.float32)
    low = 0
    while low < len(starts):
        high = max(low + 1, int(np.searchsorted(stops, starts[low] + CELLS, "right")))
        gain = model.odds[seen[starts[low] : stops[high - 1]]]
        reach[low:high] = (np.add.reduceat(np.maximum(gain, 0, out=gain), starts[low:high] - starts[low], axis=0) + ENTER).max(axis=1)
        low = high
    todo = np.flatnonzero(reach > 0)
    if not len(todo):
        return result
    todo = todo[np.argsort((stops - starts)[todo], kind="stable")]
    for some in _alike(todo, (stops - starts)[todo]):
        lengths = (stops - starts)[some]
        steps, states = int(lengths.max()), model.odds.shape[1]
        filled = np.zeros((steps, len(some), states), dtype=np.float32)
        for j, p in enumerate(some):
            filled[: lengths[j], j] = model.odds[seen[starts[p] : stops[p]]]
        clean = np.zeros(len(some), dtype=np.float32)
        paths = ENTER[None, :] + filled[0]
        came_clean = np.zeros((steps, len(some), states), dtype=bool)  # the state was entered here
        came_from = np.full((steps, len(some)), -1, dtype=np.int8)  # the state the clean state came from
        for t in range(1, steps):
            best = paths.argmax(axis=1)
            top = paths[np.arange(len(some)), best] + LEAVE
            entered = clean[:, None] + ENTER[None, :]
            came_clean[t] = entered > paths
            paths = np.maximum(paths, entered) + filled[t]
            came_from[t] = np.where(top > clean, best, -1)
            clean = np.maximum(clean, top)
        came_clean[0] = True
        now = np.where(paths.max(axis=1) > clean, paths.argmax(axis=1), -1)
        path = np.full((steps, len(some)), -1, dtype=np.int8)
        for t in range(steps - 1, -1, -1):
            path[t] = now
            in_pair = now >= 0
            back = came_clean[t][np.arange(len(some)), np.maximum(now, 0)]
            now = np.where(in_pair, np.where(back, -1, now), came_from[t])
        for j, p in enumerate(some):
            states_of = path[: lengths[j], j]
            cuts = np.flatnonzero(np.diff(states_of, prepend=-2))
            offset = ends[owner[starts[p]]] - len(texts[owner[starts[p]]]) - 2
            for a, b in zip(cuts, np.append(cuts[1:], len(states_of))):
                if states_of[a] >= 0:
                    result[owner[starts[p]]].append((int(at[starts[p] + a] - offset), int(at[starts[p] + b - 1] - offset), int(states_of[a])))
    return result


def _alike(texts: np.ndarray, lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Texts, from the shortest, in groups whose longest times their number is at most :data:`CELLS`; a longer one is alone."""
    start = 0
    while start < len(texts):
        fits = lengths[start:] * np.arange(1, len(texts) - start + 1) <= CELLS
        end = start + max(1, int(fits.argmin()) if not fits.all() else len(fits))
        yield texts[start:end]
        start = end


def _inverse(piece: str, state: str) -> tuple[str, str]:
    """The piece by its state's inverse; where that changes nothing, by another reading of UTF-8."""
    new = restore(piece, state)
    if new == piece and (state == LOST or PAIRS[STATES.index(state)][1].startswith("utf-8")):
        for other, written, _ in PAIRS:
            if written == "utf-8" and (tried := restore(piece, other)) != piece:
                return tried, other
    return new, state


def garbled_lines(text: str, spans: list[tuple[int, int, int]], model: Model) -> list[tuple[int, str, str, str]]:
    """``(line_no, line, restored, state)`` of every line that a labelled span changes.

    Spans grow to whole words. A span of a pair of single-byte encodings, of which every text is
    the inverse of something, counts only if its restored text is the likelier one.
    """
    grown = []
    for first, last, state in spans:
        while first > 0 and not text[first - 1].isspace():
            first -= 1
        while last + 1 < len(text) and not text[last + 1].isspace():
            last += 1
        name = STATES[state]
        if name != LOST and not PAIRS[state][1].startswith("utf-8"):
            piece = text[first : last + 1]
            if model.likelihood(restore(piece, name)) <= model.likelihood(piece):
                continue
        grown.append((first, last + 1, name))
    if not grown:
        return []
    out, begin, k = [], 0, 0
    for number, line in enumerate(text.split("\n")):
        end, made, done, used = begin + len(line), [], 0, None
        while k < len(grown) and grown[k][1] <= begin:
            k += 1
        j = k
        while j < len(grown) and grown[j][0] < end:
            a, b = max(grown[j][0] - begin, done), min(grown[j][1] - begin, len(line))
            if a < b:
                piece = line[a:b]
                new, name = _inverse(piece, grown[j][2])
                if new != piece or _REPLACEMENT in piece:
                    used = name
                made += [line[done:a], new]
                done = b
            j += 1
        if used is not None:
            out.append((number, line, "".join(made) + line[done:], used))
        begin = end + 1
    return out


def _counted(documents: DataFrame, text: str, model: Model | None = None) -> _Counts:
    """The counts of all texts; with a model, of those that it finds garbled. Longer texts are cut to :data:`TRAIN_CHARS`, each part on its own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, size = _Counts(), [], 0

        def count() -> None:
            counts.add(held if model is None else [t for t, spans in zip(held, label(held, model)) if garbled_lines(t, spans, model)])

        for batch in batches:
            for whole in batch.column(0).to_pylist():
                for _, piece in pieces(whole, TRAIN_CHARS):
                    held.append(piece)
                    size += len(piece) + 1  # empty texts are held too
                    if size >= AT_ONCE:
                        count()
                        held, size = [], 0
                        if len(counts.mixed) == 1 and len(counts.mixed[0][0]) > KEYS:
                            yield counts.rows()
                            counts = _Counts()
        count()
        yield counts.rows()

    rows = documents.where(F.col(text).isNotNull()).select(text).mapInArrow(run, "kind bigint, key bigint, n bigint")
    return _Counts.of_rows(rows.groupBy("kind", "key").agg(F.sum("n").alias("n")).toArrow())


def learn(documents: DataFrame, text: str = "text") -> Model:
    """Train on all texts, as :func:`train` does: every text is counted, and those that the model of these counts finds garbled are taken out again.

    Tasks send sums, of which there are as many as observations and letter pairs, however long the table is.
    """
    total = _counted(documents, text)
    model = total.model()
    kept = total.without(_counted(documents, text, model))
    return kept.model() if kept.texts else model


def fit(documents: DataFrame, id_column: str = "doc_id", text: str = "text", pages: int = TRAIN_PAGES) -> Model:
    """Train on at most ``pages`` pages, chosen by the hash of their id; for a quick look, since the queries :func:`learn` from all.

    A text of over :data:`TRAIN_CHARS` characters takes part in pieces of that length, each cut to
    whole lines, as if they were pages.
    """
    texts = documents.where(F.col(text).isNotNull()).withColumn("_pieces", F.greatest(F.lit(1), F.ceil(F.length(text) / TRAIN_CHARS)).cast("int"))
    number = texts.agg(F.sum("_pieces")).first()[0] or 0
    # few more pages than needed pass the bound on the hash, so no task sends a full sample to the driver
    bound = min(1.0, 1.5 * pages / max(1, number))
    each = texts.select(text, id_column, "_pieces", F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1)).alias("_piece"))
    hashed = each.withColumn("h", F.shiftrightunsigned(F.when(F.col("_piece") == 0, F.xxhash64(id_column)).otherwise(F.xxhash64(id_column, "_piece")), 12)).where(F.col("h") < int(bound * (1 << 52)))
    cut = F.substring(F.col(text), F.col("_piece") * TRAIN_CHARS + 1, F.lit(TRAIN_CHARS))
    rows = hashed.select(cut.alias("t"), "_piece", "_pieces", "h", id_column).orderBy("h", id_column).limit(pages).select("t", "_piece", "_pieces").collect()
    if number and not rows:
        raise ValueError("the training sample is empty though there are texts")
    return train([_whole_lines(t, n > 0, n + 1 < of) for t, n, of in rows])


def _whole_lines(piece: str, cut_before: bool, cut_after: bool) -> str:
    """The piece without lines that were cut; as it is when it has no other."""
    lines = piece.split("\n")
    return "\n".join(lines[cut_before : len(lines) - cut_after]) or piece


def pieces(text: str, length: int | None = None) -> Iterator[tuple[int, str]]:
    """A text in pieces (of :data:`PIECE` unless told) with their place, cut at a line's end, else at white space, else anywhere; short texts are one piece."""
    start, length = 0, length or PIECE
    while len(text) - start > length:
        end = start + length
        cut = text.rfind("\n", start + 1, end)
        cut = cut if cut > 0 else text.rfind(" ", start + 1, end)
        end = cut if cut > 0 else end
        yield start, text[start:end]
        start = end
    yield start, text[start:]


class _Held:
    """Texts whose pieces are being labelled."""

    def __init__(self, model: Model, id_column: str) -> None:
        self.model, self.id_column = model, id_column
        self.texts: list[tuple[object, str, list[tuple[int, int, int]]]] = []
        self.waiting: list[tuple[int, int, str]] = []  # text, place, piece
        self.size = 0

    def add(self, i: object, text: str) -> None:
        self.texts.append((i, text, []))
        for place, piece in pieces(text):
            self.waiting.append((len(self.texts) - 1, place, piece))
            self.size += len(piece)
            if self.size >= AT_ONCE:
                self.label()

    def label(self) -> None:
        for (n, place, _), spans in zip(self.waiting, label([p for _, _, p in self.waiting], self.model)):
            self.texts[n][2].extend((a + place, b + place, state) for a, b, state in spans)
        self.waiting, self.size = [], 0

    def rows(self) -> pa.RecordBatch:
        self.label()
        found = [(i, *row) for i, text, spans in self.texts if spans for row in garbled_lines(text, spans, self.model)]
        columns = list(zip(*found)) if found else [[]] * 5
        kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds)], names=[self.id_column, "line_no", "line", "restored", "pair"])


def wrong_decoding(documents: DataFrame, model: Model, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, line_no, line, restored, pair)``: every wrongly decoded line.

    ``restored`` equals what the scan gave where the bytes survive; U+FFFD stays where they do
    not. Null and empty texts have no lines; all of a text is labelled, one longer than
    :data:`PIECE` in pieces of that length, so memory does not grow with it; repeated rows are reported each. Lines that read the same after wrong decoding are not reported.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = _Held(model, id_column), 0
            for i, whole in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.add(i, whole)
                size += len(whole)
                if size >= AT_ONCE:
                    yield held.rows()
                    held, size = _Held(model, id_column), 0
            yield held.rows()

    rows = documents.where(F.col(text).isNotNull()).select(F.col(id_column).cast("bigint").alias(id_column), text)
    return rows.mapInArrow(run, f"{id_column} bigint, line_no int, line string, restored string, pair string")
