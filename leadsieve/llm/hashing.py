"""Hashes of words, word shingles and character shingles, computed over whole arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes that are hashed at a time, so that the work stays in the processor's cache.
STEP = 1 << 15

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so powers can be divided away again
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_CODES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_PLACES = np.random.default_rng(21).integers(1, 1 << 63, 64, dtype=np.uint64) | _U(1)

#: Bytes that separate words: space and \x09-\x0D.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True

#: Bytes outside 0-9, a-z and the non-ASCII range.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

_powers = {_BASE: np.ones(1, np.uint64), _INVERSE: np.ones(1, np.uint64)}


def powers(base: int, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2 ** 64."""
    known = _powers[base]
    if len(known) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        known = _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return known[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Every input bit spread over all output bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Words:
    """The words of a run of documents.

    ``first[d]:first[d + 1]`` are the words of document ``d``; ``start`` and ``end`` are
    places in ``data``, ``hash`` is a 64-bit hash of each word's bytes.
    """

    def __init__(self, docs: list[bytes], separators: np.ndarray):
        gap = bytes([int(np.flatnonzero(separators)[-1])])
        self.data = gap.join([b"", *docs, b""])
        codes = np.frombuffer(self.data, np.uint8)
        inside = ~separators[codes]
        turns = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.start, self.end = turns[0::2], turns[1::2]
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(_BYTE_CODES[codes] * powers(_BASE, len(codes)), out=sums[1:])
        spans = sums[self.end] - sums[self.start]
        self.hash = mixed(spans * powers(_INVERSE, len(codes))[self.start])
        sizes = np.fromiter(map(len, docs), np.int64, len(docs))
        edges = np.concatenate(([1], 1 + np.cumsum(sizes + 1)))
        self.first = np.searchsorted(self.start, edges)

    def shingles(self, width: int) -> np.ndarray:
        """Hash of the ``width`` words from each word on; only the places that have so many count."""
        n = len(self.hash) - width + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        out = np.zeros(n, np.uint64)
        for i in range(width):
            out += self.hash[i : i + n] * _PLACES[i]
        return mixed(out + _U(width))

    def shingle_sets(self, width: int) -> list[np.ndarray]:
        """Per document the distinct hashes of its ``width``-word shingles, sorted, below 2 ** 63.

        Fewer words than ``width`` are one shingle; none give an empty set.
        """
        all_of = {width: self.shingles(width) >> _U(1)}
        out = []
        for a, b in zip(self.first[:-1].tolist(), self.first[1:].tolist(), strict=True):
            n = b - a
            if n >= width:
                out.append(np.unique(all_of[width][a : b - width + 1]))
            elif n:
                if n not in all_of:
                    all_of[n] = self.shingles(n) >> _U(1)
                out.append(all_of[n][a : a + 1])
            else:
                out.append(np.zeros(0, np.uint64))
        return out


def char_shingles(lines: list[bytes], width: int) -> np.ndarray:
    """Hash of the ``width`` bytes from each byte of the joined lines on."""
    return _char_hashes(*_char_sums(lines), 0, width)


def _char_sums(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    joined = np.frombuffer(b"".join(lines), np.uint8)
    sums = np.zeros(len(joined) + 1, np.uint64)
    np.cumsum(_BYTE_CODES[joined] * powers(_BASE, len(joined)), out=sums[1:])
    return sums, powers(_INVERSE, len(sums))


def _char_hashes(sums: np.ndarray, back: np.ndarray, at: int, width: int) -> np.ndarray:
    n = max(0, len(sums) - width - at)
    return mixed((sums[at + width : at + width + n] - sums[at : at + n]) * back[at : at + n])


def runs(lines: list[bytes], limit: int = STEP) -> Iterator[list[bytes]]:
    """The lines in runs of at most ``limit`` bytes, or one line."""
    at = 0
    while at < len(lines):
        end, total = at, 0
        while end < len(lines) and (end == at or total + len(lines[end]) <= limit):
            total += len(lines[end])
            end += 1
        yield lines[at:end]
        at = end


def char_shingle_sets(lines: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The sets of the lines' ``width``-byte shingles, one after another and each in order, and their sizes.

    A shorter line is one shingle. Shingles are known by 43 bits, so that a line's number and a
    shingle fit one number and a single sort makes the sets of a run of lines.
    """
    found = [_shingle_sets(run, width) for run in runs(lines)] or [_shingle_sets([], width)]
    return np.concatenate([v for v, _ in found]), np.concatenate([n for _, n in found])


def _shingle_sets(lines: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(lines), dtype=np.uint64), sizes)
    whole = char_shingles(lines, width)
    inside = np.arange(len(owner)) + width <= np.repeat(ends, sizes)
    keys = (owner[inside] << _U(43)) | (whole[inside[: len(whole)]] >> _U(21))
    short = np.flatnonzero(sizes < width)
    alone = [int(mixed(char_shingles([lines[i]], len(lines[i])))[0]) >> 21 if lines[i] else 0 for i in short.tolist()]
    extra = (short.astype(np.uint64) << _U(43)) | np.array(alone, np.uint64)
    keys = np.sort(np.concatenate((keys, extra)))
    keys = keys[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(keys) else keys
    counts = np.bincount((keys >> _U(43)).astype(np.int64), minlength=len(lines))
    return keys & _U((1 << 43) - 1), counts


def held(known: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Which of ``asked`` are among ``known``, both 64-bit numbers in any order."""
    if not len(known):
        return np.zeros(len(asked), bool)
    bits = max(4, int(4 * len(known)).bit_length())
    odd, shift = _U(_BASE), _U(64 - bits)
    table, crowded = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, bool)
    table[0] = 1  # 0 belongs to this slot and 1 does not, so an empty slot equals nothing that is looked up in it
    at = (known * odd) >> shift
    table[at] = known
    lost = table[at] != known  # others stand in their slots
    slots = (asked * odd) >> shift
    out = table[slots] == asked
    if lost.any():
        crowded[at[lost]] = True
        more = np.flatnonzero(crowded[slots] & ~out)
        rest = np.sort(known[lost])
        place = np.searchsorted(rest, asked[more])
        place[place == len(rest)] = 0
        out[more] = rest[place] == asked[more]
    return out


class HashTable:
    """Places of known keys in an array, looked up for whole arrays at a time."""

    def __init__(self, keys: np.ndarray):
        """``keys``: distinct 64-bit numbers."""
        size = 1 << max(4, int(4 * len(keys)).bit_length())
        self.mask = np.uint64(size - 1)
        self.slots = np.full(size, -1, np.int32)
        self.keys = keys.astype(np.uint64)
        left = np.arange(len(keys), dtype=np.int32)
        at = mixed(self.keys) & self.mask
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]  # of several for one slot the last one stays
            lost = self.slots[at] != left
            left, at = left[lost], (at[lost] + _U(1)) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 for unknown ones."""
        out = np.full(len(keys), -1, np.int32)
        if not len(self.keys) or not len(keys):
            return out
        at = mixed(keys) & self.mask
        found = self.slots[at]
        open_ = np.flatnonzero(found >= 0)
        same = self.keys[found[open_]] == keys[open_]
        out[open_[same]] = found[open_[same]]
        left = open_[~same]
        at = at[left]
        while len(left):
            at = (at + _U(1)) & self.mask
            found = self.slots[at]
            some = found >= 0
            left, at, found = left[some], at[some], found[some]
            same = self.keys[found] == keys[left]
            out[left[same]] = found[same]
            left, at = left[~same], at[~same]
        return out
