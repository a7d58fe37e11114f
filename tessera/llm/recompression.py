"""The recompression kernel: words of a batch of texts, their symbols, and windows' cores.

Recompression shortens a word sequence in rounds. A round first names each run
of one symbol, then deals all symbols to a left and a right side and names each
adjacent (left, right) pair. Names and sides are hashes of content, so all
tasks name equal runs and pairs equally without an exchange, and equal
substrings get equal symbols but for a few at either end: the *core* of a
window, which its content alone determines. A window that occurs in two
documents has the same core in both, so all of its core symbols occur in both,
and a window is known by its core's symbols and the words left over on either side.

Every name has two halves of 64 bits from independent halves of a 128-bit hash
of each word. Sides, and the symbols that documents are compared by, go by the
first half; windows are compared by both.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Words of a window.
WINDOW = 50
#: Rounds, and those which name runs: at 50 words more would leave many windows without a core.
ROUNDS = 7
RUN_ROUNDS = (0, 4)

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20_240_501))
#: Bases of the rolling hashes of both halves, 3 modulo 8. Spans are at most WINDOW names long, too short for sequences that collide under every base.
_BASES = [int(x) * 8 + 3 for x in _rng.integers(1 << 59, 1 << 60, 2, dtype=np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads them."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


class Powers:
    """Powers of a base and of its inverse, as far as they were asked for."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            with np.errstate(over="ignore"):
                k = np.full(1 << (n - 1).bit_length(), self.base, np.uint64)
                k[0] = 1
                self.up = np.multiply.accumulate(k)
                k[1:] = self.inverse
                self.down = np.multiply.accumulate(k)
        return self.up[:n], self.down[:n]


_POWERS = [Powers(b) for b in _BASES]


class _Spans:
    """Rolling hashes of values[start:end] for spans of one array."""

    def __init__(self, values: np.ndarray, powers: Powers):
        up, self.down = powers.get(len(values) + 1)
        self.total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[:-1], out=self.total[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.total[ends] - self.total[starts]) * self.down[starts]


class Words:
    """Words of texts that lie one after another in ``data`` (uint8), bounded by ``offsets``.

    first[d] is the first word of text d in starts, ends and names; first has
    one entry more than there are texts. names holds both halves of each name.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(data)
        space = (data == 32) | ((data >= 9) & (data <= 13))
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        word = ~space
        before = np.ones(n, bool)
        before[1:] = space[:-1]
        after = np.ones(n, bool)
        after[:-1] = space[1:]
        self.starts = np.flatnonzero(word & (before | edge[:-1]))
        self.ends = np.flatnonzero(word & (after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.names = _hashed(data, self.starts, self.ends)
        self.text = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))


def _hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Both halves of the 128-bit hash of every word; each distinct word is hashed once."""
    import pyarrow as pa
    import xxhash

    if not len(starts):
        return np.empty((2, 0), np.uint64)
    lengths = ends - starts
    bounds = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(lengths, out=bounds[1:])
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    joined = data[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
    coded = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(joined))]).dictionary_encode()
    digest = xxhash.xxh3_128_digest
    known = np.frombuffer(b"".join(digest(w) for w in coded.dictionary.to_pylist()), np.uint64).reshape(-1, 2)
    return np.ascontiguousarray(known[coded.indices.to_numpy()].T)


@dataclass
class Parsed:
    """Symbols after all rounds: names (both halves), the first word of each (and the number of words), the first symbol of
    each text; and of every window the first word, and its core symbols lo up to hi (none if lo >= hi)."""

    names: np.ndarray
    begin: np.ndarray
    first: np.ndarray
    starts: np.ndarray
    lo: np.ndarray
    hi: np.ndarray


def parse(words: Words) -> Parsed:
    names, text = words.names, words.text
    begin = np.arange(names.shape[1])
    starts = window_starts(words)
    lo, hi = starts.copy(), starts + WINDOW
    for r in range(ROUNDS):
        if not len(text):
            break
        if r in RUN_ROUNDS:
            new = np.ones(len(text), bool)
            new[1:] = (names[0, 1:] != names[0, :-1]) | (text[1:] != text[:-1])
            at = np.flatnonzero(new)
            # The outermost runs of a core may go on outside the window.
            ids = np.cumsum(new) - 1
            some = lo < hi
            lo, hi = np.where(some, ids[np.minimum(lo, len(ids) - 1)] + 1, 1), np.where(some, ids[np.maximum(hi, 1) - 1], 0)
            length = np.diff(np.append(at, len(text))).astype(np.uint64)
            names = np.where(length == 1, names[:, at], mix(names[:, at] + length * _U(0x9E3779B97F4A7C15)))
            text, begin = text[at], begin[at]
        right = (mix(names[0] ^ _U(0xA5A5 + r)) >> _U(63)).astype(bool)
        pair = np.zeros(len(text), bool)
        pair[:-1] = ~right[:-1] & right[1:] & (text[1:] == text[:-1])
        keep = np.ones(len(text), bool)
        keep[1:] = ~pair[:-1]
        # A right symbol at the start may belong to a symbol outside the window, and so a left one at the end.
        ids = np.cumsum(keep) - 1
        some = lo < hi
        a, z = np.minimum(lo, len(ids) - 1), np.maximum(hi, 1) - 1
        lo, hi = np.where(some, ids[a] + right[a], 1), np.where(some, ids[z] + right[z], 0)
        at = np.flatnonzero(pair)
        new = names.copy()
        new[:, at] = mix(names[:, at] * _U(0xD6E8FEB86659FD93) + mix(names[:, at + 1]) + _U(r))
        names, text, begin = new[:, keep], text[keep], begin[keep]
    return Parsed(names, np.append(begin, words.names.shape[1]), np.searchsorted(text, np.arange(len(words.first))), starts, lo, hi)


def window_starts(words: Words) -> np.ndarray:
    """First word of every window that lies in one text."""
    n = words.names.shape[1]
    if n < WINDOW:
        return np.empty(0, np.int64)
    at = np.arange(n - WINDOW + 1)
    return at[words.text[: n - WINDOW + 1] == words.text[WINDOW - 1 :]]


def window_names(words: Words, parsed: Parsed, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of the names of windows: of their core's symbols and the words on either side, or of all words where there is no core."""
    starts, lo, hi = parsed.starts[which], parsed.lo[which], parsed.hi[which]
    cored = lo < hi
    left, right = np.where(cored, parsed.begin[np.where(cored, lo, 0)], starts + WINDOW), np.where(cored, parsed.begin[np.where(cored, hi, 0)], starts + WINDOW)
    lo, hi = np.where(cored, lo, 0), np.where(cored, hi, 0)
    shape = ((left - starts) * 64 + (starts + WINDOW - right)).astype(np.uint64)
    out = []
    for half, powers in enumerate(_POWERS):
        of_words, of_symbols = _Spans(words.names[half], powers), _Spans(parsed.names[half], powers)
        parts = of_words(starts, left) + mix(of_symbols(lo, hi) + _U(1)) * _U(0xD6E8FEB86659FD93) + mix(of_words(right, starts + WINDOW) + _U(2)) * _U(0x9E3779B97F4A7C15)
        out.append(mix(parts + shape * _U(0xA0761D6478BD642F)))
    return out[0], out[1]


def chunks(array, most: int = 1 << 20, rows: int | None = None):
    """(first row, data, offsets) of runs of rows of a pyarrow string array, of about ``most`` bytes or one row, and of up to ``rows`` rows; a null is an empty text."""
    import pyarrow as pa

    array = array.cast(pa.large_string()).fill_null("")
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    row = 0
    while row < len(array):
        end = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
        end = min(end, row + (rows or end))
        yield row, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end
