"""The public word-punctuation tokenizer and 64-bit hashes of words."""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: Runs of letters, digits and underscores, or runs of other characters that are not white space.
TOKEN = re.compile(r"\w+|[^\w\s]+")
#: Runs of letters and digits.
WORD = re.compile(r"[^\W_]+")
#: Runs of characters other than space, tab, CR and LF.
PLAIN = re.compile(r"[^ \t\r\n]+")


class WordHash(dict):
    """word -> 64-bit hash, remembered until the memory bound ``most`` is reached."""

    def __init__(self, most: int = 500_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))
