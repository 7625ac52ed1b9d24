"""Byte-level BPE by batched merge rounds in numpy.

The symbols of many words lie in one flat array. Each round looks the ids of all neighbouring pairs up in the sorted
array of mergeable pairs by binary search, finds the lowest rank of every word, merges all places of that pair and
closes the gaps; words without a mergeable pair leave the array. Words are cached by their bytes.
"""

from __future__ import annotations

import functools
import heapq
import json

import numpy as np
import regex

#: fixed values: how byte-level vocabularies split text into words
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: words longer than this many bytes are merged one by one, as their rounds would be too many
LONG_WORD = 2_048
#: distinct words kept by a worker before its cache starts anew
CACHE_WORDS = 400_000

_NO_RANK = np.iinfo(np.int64).max


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes: visible Latin-1 stands for itself, the rest follows from 256 on."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class BytePairEncoder:
    """Encodes texts with the vocabulary and merges of a tokenizer file (its JSON text)."""

    def __init__(self, definition: str):
        model = json.loads(definition)["model"]
        vocab: dict[str, int] = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.size = max(vocab.values()) + 1
        self.byte_ids = np.zeros(256, dtype=np.int64)
        for char, byte in _byte_alphabet().items():
            self.byte_ids[byte] = vocab[char]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        self.split = regex.compile(WORDS)
        self._forget()

    @functools.cached_property
    def rank_of(self) -> dict[int, int]:
        """The rank of each mergeable pair, for words that are merged one by one."""
        return dict(zip(self.keys.tolist(), self.ranks.tolist()))

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, dtype=np.int32)
        self.starts = np.zeros(1 << 14, dtype=np.int64)
        self.used = 0

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], _NO_RANK)

    def _merge_long(self, word: bytes) -> np.ndarray:
        """One word with a queue of its pairs, lowest rank first and leftmost among equals."""
        symbols = self.byte_ids[np.frombuffer(word, dtype=np.uint8)].tolist()
        size = len(symbols)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        rank_of = self.rank_of
        queue = [(r, i, symbols[i], symbols[i + 1]) for i in range(size - 1) if (r := rank_of.get(symbols[i] * self.size + symbols[i + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            rank, i, left, right = heapq.heappop(queue)
            j = after[i]
            if j >= size or symbols[i] != left or symbols[j] != right:
                continue
            symbols[i], symbols[j] = int(self.merged[rank]), -1
            after[i] = after[j]
            if after[i] < size:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < size and (r := rank_of.get(symbols[k] * self.size + symbols[after[k]])) is not None:
                    heapq.heappush(queue, (r, k, symbols[k], symbols[after[k]]))
        return np.array([s for s in symbols if s >= 0], dtype=np.int64)

    def _merge(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of every (non-empty) word, in rounds over all of them."""
        done: list[np.ndarray] = [np.empty(0, np.int64)] * len(words)
        short = [i for i, w in enumerate(words) if len(w) <= LONG_WORD]
        for i in set(range(len(words))) - set(short):
            done[i] = self._merge_long(words[i])
        if not short:
            return done
        symbols = self.byte_ids[np.frombuffer(b"".join(words[i] for i in short), dtype=np.uint8)]
        word = np.repeat(np.array(short), [len(words[i]) for i in short])
        while len(symbols):
            rank = np.full(len(symbols), _NO_RANK)
            if len(symbols) > 1:
                rank[:-1] = np.where(word[:-1] == word[1:], self._rank(symbols[:-1], symbols[1:]), _NO_RANK)
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            length = np.diff(np.r_[first, len(word)])
            best = np.minimum.reduceat(rank, first)
            over = best == _NO_RANK
            for at, n in zip(first[over], length[over]):
                done[word[at]] = symbols[at : at + n]
            if over.all():
                break
            stay = np.repeat(~over, length)
            symbols, word, rank, best = symbols[stay], word[stay], rank[stay], np.repeat(best[~over], length[~over])
            chosen = rank == best
            # a pair of equal symbols can overlap itself: of a run of places every other one counts, from the left
            at = np.flatnonzero(chosen)
            run = np.r_[True, (np.diff(at) != 1) | (word[at[1:]] != word[at[:-1]])]
            in_run = np.arange(len(at)) - np.flatnonzero(run)[np.cumsum(run) - 1]
            at = at[in_run % 2 == 0]
            symbols[at] = self.merged[rank[at]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[at + 1] = False
            symbols, word = symbols[keep], word[keep]
        return done

    def _learn(self, words: list[str]) -> None:
        encoded = self._merge([w.encode("utf-8", "surrogatepass") for w in words])
        n = len(self.known)
        sizes = np.array([len(e) for e in encoded])
        total = int(sizes.sum())
        while n + len(words) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + total] = np.concatenate(encoded)
        self.starts[n + 1 : n + 1 + len(words)] = self.used + np.cumsum(sizes)
        self.used += total
        self.known.update(zip(words, range(n, n + len(words))))

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and the offsets of the texts in it; null and empty texts have no ids."""
        if len(self.known) > CACHE_WORDS:
            self._forget()
        split = self.split.findall
        parts = [split(t) if t else [] for t in texts]
        new = list({w for p in parts for w in p} - self.known.keys())
        if new:
            self._learn(new)
        known = self.known
        codes = np.fromiter((known[w] for p in parts for w in p), dtype=np.int64)
        counts = np.fromiter((len(p) for p in parts), dtype=np.int64, count=len(parts))
        begin = self.starts[codes]
        sizes = self.starts[codes + 1] - begin
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.ids[np.arange(total) + np.repeat(begin - (ends - sizes), sizes)]
        offsets = np.r_[0, ends][np.r_[0, np.cumsum(counts)]]
        return flat, offsets.astype(np.int64)
