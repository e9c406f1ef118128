"""Prediction by partial matching over bytes, from counted n-grams.

The trie holds contexts of up to ``order`` bytes with the symbols seen after them. A symbol is coded in the
longest context of the trie that ends where it stands; if it was not seen there, an escape
is coded and the context loses its first byte. Symbols of the longer context cannot occur then
and are excluded from the shorter one. Of ``n`` occurrences of a symbol half a one goes to
the escape. After the empty context the symbols left are equally likely.

Every symbol that follows a context also follows the shorter ones, so the excluded symbols are
those of the context just left, and what an exclusion leaves is a property of that context: it is
worked out once per context and coding a text is table look-ups over whole arrays.
"""

from __future__ import annotations

import numpy as np

from leadsieve.llm.hashing import HashTable

#: Stands before a text, ``order`` times, and after it once; no byte of UTF-8.
EDGE = 0xFF


def grams_of(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``order`` bytes before each symbol with the symbol, as numbers, and where each text's begin."""
    pad = bytes([EDGE]) * order
    data = np.frombuffer(b"".join(pad + t + b"\xff" for t in texts) or pad, np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    keys = np.zeros(max(0, len(data) - order), np.uint64)
    for j in range(order + 1):
        keys <<= np.uint64(8)
        keys |= data[j : j + len(keys)]
    ends = np.cumsum(sizes + order)
    inside = np.ones(len(data), bool)
    for j in range(order):
        inside[ends - sizes - order + j] = False
    return keys[inside[order:]], np.concatenate(([0], np.cumsum(sizes)))


def tagged(keys: np.ndarray, length: int) -> np.ndarray:
    return keys | np.uint64(length << 56)


class Trie:
    """Contexts and symbols with their log10 shares.

    ``grams[m]``: context of m bytes with its symbol as a number, ``counts[m]`` how often. With a
    gram its suffixes must be there too, which a common least count of all lengths ensures. Where
    rare symbols were left out, a context's own count tells how often; they go to the escape.
    """

    def __init__(self, grams: list[np.ndarray], counts: list[np.ndarray]):
        self.order = len(grams) - 1
        contexts, entries, symbols, direct = [], [], [], []
        total, left, escape, escape_left = [], [], [], []
        shorter: tuple | None = None
        for m, (g, n) in enumerate(zip(grams, counts, strict=True)):
            sort = np.argsort(g)
            g, n = g[sort].astype(np.uint64), n[sort].astype(np.float64)
            context, first, which = np.unique(g >> np.uint64(8), return_index=True, return_inverse=True)
            kinds = np.bincount(which, minlength=len(context))
            kept = np.bincount(which, n, len(context))
            size, rest, kinds_left, hidden_left = kept, np.zeros(len(context)), np.zeros(len(context)), np.zeros(len(context))
            if shorter is not None and len(g):
                size = np.maximum(kept, _looked_up(shorter[0], shorter[1], context))
                common = np.bincount(which, _looked_up(shorter[0], shorter[1], g & _low(m)), len(context))
                parent = np.searchsorted(shorter[2], context & _low(m - 1))
                rest = shorter[3][parent] - common
                kinds_left, hidden_left = shorter[4][parent] - kinds, shorter[5][parent]
            hidden = size - kept
            total.append(np.log10(size))
            escape.append(np.log10((kinds / 2 + hidden) / size))
            some = rest > 0.25
            left.append(np.log10(np.where(some, rest, 1)))
            escape_left.append(np.log10(np.where(some, (kinds_left / 2 + hidden_left) / np.where(some, rest, 1), 1)))
            contexts.append(tagged(context, m))
            entries.append(tagged(g, m + 1))
            symbols.append(np.log10(n - 0.5))
            direct.append(symbols[-1] - total[-1][which])
            shorter = (g, n, context, size, kinds, hidden)
        self.contexts, self.entries = HashTable(np.concatenate(contexts)), HashTable(np.concatenate(entries))
        self.symbols, self.direct = np.concatenate(symbols), np.concatenate(direct)
        self.total, self.left = np.concatenate(total), np.concatenate(left)
        self.escape, self.escape_left = np.concatenate(escape), np.concatenate(escape_left)
        self.unseen = -np.log10(max(1, 256 - len(grams[0])))

    def log_shares(self, keys: np.ndarray) -> np.ndarray:
        """log10 of the probability of the last byte of each key after the bytes before it."""
        found = self.entries.find(tagged(keys, self.order + 1))
        out = self.direct[found] if len(self.direct) else np.zeros(len(keys))
        todo = np.flatnonzero(found < 0)
        out[todo] = self._escaped(keys[todo])
        return out

    def _escaped(self, keys: np.ndarray) -> np.ndarray:
        out, child = np.zeros(len(keys)), np.full(len(keys), -1, np.int32)
        todo = np.arange(len(keys))
        for m in range(self.order, -1, -1):
            gram = keys[todo] & _low(m + 1)
            context = self.contexts.find(tagged(gram >> np.uint64(8), m))
            here = context >= 0
            rows, gram, context = todo[here], gram[here], context[here]
            longer = child[rows]
            fresh = longer < 0
            symbol = self.entries.find(tagged(gram, m + 1))
            hit = symbol >= 0
            room = np.where(fresh, self.total[context], self.left[longer])
            miss = np.where(fresh, self.escape[context], self.escape_left[longer])
            out[rows] += np.where(hit, self.symbols[symbol] - np.where(hit, room, 0), miss)
            child[rows] = context
            done = np.zeros(len(keys), bool)
            done[rows[hit]] = True
            todo = todo[~done[todo]]
        out[todo] += self.unseen
        return out


def _low(symbols: int) -> np.uint64:
    return np.uint64((1 << 8 * symbols) - 1)


def _looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The values of ``wanted`` in a sorted table, 0 for what it lacks."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


def empty_trie(order: int) -> Trie:
    none = [np.zeros(0, np.uint64) for _ in range(order + 1)]
    return Trie(none, [np.zeros(0) for _ in none])
