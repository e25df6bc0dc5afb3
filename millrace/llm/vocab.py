"""Byte-level BPE vocabularies read from ``tokenizers`` JSON files, with vectorised pair lookup."""

from __future__ import annotations

import json
import os
from functools import cached_property

import numpy as np

#: No pair: larger than any rank.
NONE = np.int64(1) << 40


def vocabulary_bytes(path_or_name: str) -> bytes:
    """The file's content, read where this is called (the driver); a bare name is looked up in ``public_tokenizers``."""
    if not os.path.exists(path_or_name):
        import public_tokenizers

        path_or_name = public_tokenizers.path(path_or_name)
    with open(path_or_name, "rb") as f:
        return f.read()


def byte_chars() -> list[str]:
    """The printable stand-in of each byte: itself if printable Latin-1, else the next code point from 256 on."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b if b in keep else spare))
        spare += b not in keep
    return out


class PairTable:
    """(left id, right id) -> rank, merged id by open addressing in numpy arrays; built once, read in batches."""

    def __init__(self, left, right, merged):
        left, right = np.asarray(left, np.int64), np.asarray(right, np.int64)
        self.merged = np.asarray(merged, np.int64)
        self.bits = max(4, int(len(left) * 5).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.rank = np.full(1 << self.bits, NONE, np.int64)
        key = left << 20 | right
        todo, at = np.arange(len(key)), self._slot(key)
        while len(todo):
            free = self.keys[at[todo]] == -1
            first = todo[free]
            _, once = np.unique(at[first], return_index=True)
            put = first[once]
            self.keys[at[put]], self.rank[at[put]] = key[put], put
            placed = np.zeros(len(key), bool)
            placed[put] = True
            todo = todo[~placed[todo]]
            moved = todo[self.keys[at[todo]] != key[todo]]
            at[moved] = (at[moved] + 1) & ((1 << self.bits) - 1)
        self._left, self._right = left, right

    @cached_property
    def scalar(self) -> dict[tuple[int, int], int]:
        """The same table for one pair at a time."""
        return {(int(a), int(b)): i for i, (a, b) in enumerate(zip(self._left, self._right, strict=True))}

    def _slot(self, key):
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left, right):
        """Rank of each pair, ``NONE`` where there is no merge."""
        key = left.astype(np.int64) << 20 | right
        at = self._slot(key)
        found = self.keys[at]
        out = np.where(found == key, self.rank[at], NONE)
        todo = np.flatnonzero((found != key) & (found != -1))
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[todo]]
            hit = found == key[todo]
            out[todo[hit]] = self.rank[at[todo[hit]]]
            todo = todo[~hit & (found != -1)]
        return out


class Vocabulary:
    """Tokens, merges and special tokens of a BPE file."""

    def __init__(self, data: bytes):
        spec = json.loads(data)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        n = 1 + max([*self.ids.values(), *self.special.values()])
        self.tokens = [""] * n
        for token, i in [*self.ids.items(), *self.special.items()]:
            self.tokens[i] = token
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.pairs = PairTable([self.ids[a] for a, _ in pairs], [self.ids[b] for _, b in pairs], [self.ids[a + b] for a, b in pairs])
        chars = byte_chars()
        self.of_byte = np.array([self.ids[c] for c in chars], np.int64)
        #: The last byte of a word, where words have an end mark.
        self.of_last_byte = np.array([self.ids[c + self.suffix] for c in chars], np.int64)

    def symbols(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Byte symbols of non-empty words, one after another, and the words' lengths."""
        flat = np.frombuffer(b"".join(words), np.uint8)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        out = self.of_byte[flat]
        if self.suffix:
            last = np.cumsum(lengths) - 1
            out[last] = self.of_last_byte[flat[last]]
        return out, lengths
