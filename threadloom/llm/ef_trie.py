"""Elias-Fano sequences and a three-level n-gram trie over them, in numpy, for one shard of a model.

A trie holds the n-grams whose last context word ``u`` belongs to the shard. Level one has the words u; each points to
its successors w (level two, with p(w | u)) and to the words v seen before it (with the weight that is left for unseen
w); each pair (v, u) points to its successors (level three, with p(w | v, u)). Successors on level three are stored
as ranks in u's own list, which is shorter than the vocabulary by far. All pointers are monotone, and so are the ids of
a level once each range starts from the last value of the one before; both are Elias-Fano coded. A look-up is a successor
search from the base of its context's range. Values are log probabilities quantised to 16 bits with one step for the model.
"""

from __future__ import annotations

from pathlib import Path

import numpy as np

_ONE = np.uint64(1)


def _word_select(x: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th one (from 0) in each 64-bit word."""
    place = np.zeros(len(x), np.int64)
    for s in (32, 16, 8, 4, 2, 1):
        n = np.bitwise_count(x & np.uint64((1 << s) - 1)).astype(np.int64)
        up = k >= n
        k = k - n * up
        place += s * up
        x = x >> (up * s).astype(np.uint64)
    return place


def _gather(out: np.ndarray, word: np.ndarray, bits: np.ndarray) -> None:
    """out[word] |= bits for words that never fall."""
    if len(word):
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        out[word[first]] |= np.bitwise_or.reduceat(bits, first)


class EliasFano:
    """A non-decreasing sequence of integers below 2**62."""

    PARTS = ("low", "high", "ones", "gaps")

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.bits, self.low, self.high, self.ones = n, bits, low, high, ones
        self.gaps = np.arange(len(ones), dtype=np.int64) * 64 - ones

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n, top = len(v), int(v[-1]) + 1 if len(v) else 1
        bits = max(0, (top // max(1, n)).bit_length() - 1)
        low = np.zeros((n * bits + 63) // 64 + 1, np.uint64)
        if bits and n:
            part, at = v & np.uint64((1 << bits) - 1), np.arange(n, dtype=np.int64) * bits
            word, shift = at >> 6, (at & 63).astype(np.uint64)
            _gather(low, word, part << shift)
            over = (at & 63) + bits > 64
            _gather(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        places = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        length = int(places[-1]) + 2 if n else 1
        high = np.zeros((length + 63) // 64, np.uint64)
        _gather(high, places >> 6, _ONE << (places & 63).astype(np.uint64))
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)])
        return cls(n, bits, low, high, ones)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.int64)
        at = i * self.bits
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        x = self.low[word] >> shift
        over = (at & 63) + self.bits > 64
        x[over] |= self.low[word[over] + 1] << (np.uint64(64) - shift[over])
        return (x & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, i, "right") - 1
        place = word * 64 + _word_select(self.high[word], i - self.ones[word])
        return (place - i << self.bits) | self._low(i)

    def _below(self, h: np.ndarray) -> np.ndarray:
        """How many values have high parts below h: ones before the h-th gap."""
        out = np.zeros(len(h), np.int64)
        some = h > 0
        k = h[some] - 1
        word = np.searchsorted(self.gaps, k, "right") - 1
        beyond = word >= len(self.high)
        word = np.minimum(word, len(self.high) - 1)
        place = word * 64 + _word_select(~self.high[word], k - self.gaps[word])
        out[some] = np.where(beyond, self.n, np.minimum(place - k, self.n))
        return out

    def successor(self, target: np.ndarray) -> np.ndarray:
        """Index of the first value >= target (n if there is none)."""
        h = target >> self.bits
        lo, hi = self._below(h), self._below(h + 1)
        want = target & ((1 << self.bits) - 1)
        while (open_ := lo < hi).any():
            at = np.flatnonzero(open_)
            mid = lo[at] + hi[at] >> 1
            less = self._low(mid) < want[at]
            lo[at[less]], hi[at[~less]] = mid[less] + 1, mid[~less]
        return lo


class Ranges:
    """Sorted ids in consecutive ranges: monotone pointers to them, and ids that go on from the range before."""

    def __init__(self, starts: EliasFano, ids: EliasFano):
        self.starts, self.ids = starts, ids

    @classmethod
    def of(cls, owner: np.ndarray, ids: np.ndarray, n: int) -> Ranges:
        """``owner`` (sorted) is the range of each id; ids rise within a range."""
        sizes = np.bincount(owner, minlength=n)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        tops = np.zeros(n, np.int64)
        last = starts[1:] - 1
        tops[sizes > 0] = ids[last[sizes > 0]] + 1
        base = np.concatenate([[0], np.cumsum(tops)[:-1]]) if n else np.zeros(0, np.int64)
        return cls(EliasFano.of(starts), EliasFano.of(ids + 1 + base[owner] if len(ids) else ids))

    def find(self, owner: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Index of each id (below 2**32) in its owner's range, -1 if it is not there; owners or ids below 0 have none.

        Each question is asked once, in order, and each range is looked up once.
        """
        out = np.full(len(owner), -1, np.int64)
        ok = np.flatnonzero((owner >= 0) & (ids >= 0))
        if not self.ids.n or not len(ok):
            return out
        keys = owner[ok] << 32 | ids[ok]
        order = np.argsort(keys)
        keys = keys[order]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        back = np.cumsum(new) - 1
        keys = keys[new]
        who = keys >> 32
        head = np.ones(len(who), bool)
        head[1:] = who[1:] != who[:-1]
        run, only = np.cumsum(head) - 1, who[head]
        a, b = self.starts[only], self.starts[only + 1]
        base = np.zeros(len(only), np.int64)
        base[a > 0] = self.ids[a[a > 0] - 1]
        want = base[run] + (keys & 0xFFFFFFFF) + 1
        at = self.ids.successor(want)
        inside = (at >= a[run]) & (at < b[run])
        hit = np.zeros(len(at), bool)
        hit[inside] = self.ids[at[inside]] == want[inside]
        out[ok[order]] = np.where(hit, at, -1)[back]
        return out

    def first(self, owner: np.ndarray) -> np.ndarray:
        return self.starts[owner]


def quantised(log_p: np.ndarray, step: float) -> np.ndarray:
    """Log probabilities (none above 0) as 16-bit multiples of ``-step``. The step is the same for all shards and levels, so
    codes add up exactly, in any order."""
    return np.minimum(np.rint(log_p / -step), 65535).astype(np.uint16)


class Trie:
    """Built by ``build``; ``mapped`` puts its arrays in files and maps them."""

    def __init__(self, words, successors, befores, thirds, p2, left2, p3, left3):
        self.words, self.successors, self.befores, self.thirds = words, successors, befores, thirds
        self.p2, self.left2, self.p3, self.left3 = p2, left2, p3, left3

    @classmethod
    def build(cls, u: np.ndarray, v: np.ndarray, w: np.ndarray, count: np.ndarray, low: np.ndarray, given: np.ndarray, step: float) -> Trie:
        """From training n-grams (v, u, w) with their counts (one may stand there several times). ``low`` is the code of p(w | u)
        where that is ``given``, and of p(w) where p(w | u) is made here.

        Witten-Bell: a context keeps the share types / (types + tokens) for the order below it.
        """
        order = np.argsort(u << 32 | w)
        u, v, w, count, low, given = u[order], v[order], w[order], count[order], low[order], given[order]
        n = len(u)
        new_u = np.ones(n, bool)
        new_u[1:] = u[1:] != u[:-1]
        iu = np.cumsum(new_u) - 1  # index of u
        words, k = u[new_u], int(new_u.sum())
        new_w = new_u.copy()
        new_w[1:] |= w[1:] != w[:-1]
        iw = np.cumsum(new_w) - 1  # index of (u, w)
        at = np.flatnonzero(new_w)
        owner = iu[at]
        c_u, c_uw = np.bincount(iu, count, k), np.bincount(iw, count, len(at))
        types = np.bincount(owner, minlength=k)
        below = 10.0 ** (low[at] * -step)
        single = ~given[np.flatnonzero(new_u)] if n else np.zeros(0, bool)
        p2 = np.where(single[owner], (c_uw + types[owner] * below) / (c_u + types)[owner], below)
        p2 = 10.0 ** (np.rint(np.log10(p2) / -step) * -step)  # as it is stored, and as it is given: a word that grows frequent changes nothing
        left2 = np.where(single, np.log10(types / np.maximum(1, types + c_u)), 0.0)
        successors = Ranges.of(owner, w[at], k)
        rank = iw - np.concatenate([[0], np.cumsum(types)])[iu]  # of w in u's list
        pair = np.argsort(iu << 32 | v)
        turn = np.ones(n, bool)
        turn[1:] = (iu[pair][1:] != iu[pair][:-1]) | (v[pair][1:] != v[pair][:-1])
        of_pair = np.empty(n, np.int64)
        of_pair[pair] = np.cumsum(turn) - 1
        order = np.argsort(of_pair << 32 | rank)
        iu3, v3, r3, iw3, iv, count = iu[order], v[order], rank[order], iw[order], of_pair[order], count[order]  # iv: index of (u, v)
        new_v = np.ones(n, bool)
        new_v[1:] = iv[1:] != iv[:-1]
        new_3 = new_v.copy()
        new_3[1:] |= r3[1:] != r3[:-1]
        at_v, at_3 = np.flatnonzero(new_v), np.flatnonzero(new_3)
        befores = Ranges.of(iu3[at_v], v3[at_v], k)
        c_v, owner3 = np.bincount(iv, count, len(at_v)), iv[at_3]
        c_3 = np.bincount(np.cumsum(new_3) - 1, count, len(at_3))
        types3 = np.bincount(owner3, minlength=len(at_v))
        p3 = (c_3 + types3[owner3] * p2[iw3[at_3]]) / (c_v + types3)[owner3]
        left3 = np.log10(types3 / np.maximum(1, types3 + c_v))
        thirds = Ranges.of(owner3, r3[at_3], len(at_v))
        return cls(EliasFano.of(words), successors, befores, thirds, *(quantised(x, step) for x in (np.log10(p2), left2, np.log10(p3), left3)))

    def mapped(self, folder: str) -> Trie:
        n = 0

        def put(x: np.ndarray) -> np.ndarray:
            nonlocal n
            n += 1
            path = Path(folder) / f"{n}.npy"
            np.save(path, x)
            return np.asarray(np.load(path, mmap_mode="r"))

        for s in (self.words, *(e for r in (self.successors, self.befores, self.thirds) for e in (r.starts, r.ids))):
            for part in EliasFano.PARTS:
                setattr(s, part, put(getattr(s, part)))
        for name in ("p2", "left2", "p3", "left3"):
            setattr(self, name, put(getattr(self, name)))
        return self

    def score(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The code of p(w | v, u) of each n-gram, ``low`` being as in ``build``; a word or pair that was never a context leaves
        the order below as it is."""
        only, back = np.unique(u, return_inverse=True)
        iu = self.words.successor(only)
        there = iu < self.words.n
        there[there] = self.words[iu[there]] == only[there]
        iu = np.where(there, iu, -1)[back]
        out = low.astype(np.int64)
        known = np.flatnonzero(iu >= 0)
        if not len(known):
            return out
        iw, iv = self.successors.find(iu[known], w[known]), self.befores.find(iu[known], v[known])
        code = out[known] + self.left2[iu[known]]
        code[iw >= 0] = self.p2[iw[iw >= 0]]
        rank = np.where(iw >= 0, iw - self.successors.first(iu[known]), -1)
        i3 = self.thirds.find(iv, rank)
        ctx = iv >= 0
        code[ctx] += self.left3[iv[ctx]]
        code[i3 >= 0] = self.p3[i3[i3 >= 0]]
        out[known] = code
        return out
