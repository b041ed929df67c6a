"""Word hashes and hashes of word runs, for whole batches of texts at once."""

from __future__ import annotations

import numpy as np
import xxhash

from plumbline.llm.common import keeps

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MOST = 150_000
_known: dict[bytes, int] = {}


def _forget() -> None:
    global _known
    _known = {}


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words (runs of anything but space and tab to carriage return, unchanged), and the place in
    them where each text starts, with the end."""
    keeps("words' hashes", _forget)
    words = [x.encode().split() if x else [] for x in texts]  # bytes split at just those characters
    if len(_known) > _MOST:
        _forget()
    for w in set().union(*words).difference(_known):
        _known[w] = xxhash.xxh3_64_intdigest(w)
    starts = np.cumsum([0, *map(len, words)])
    return np.fromiter((_known[w] for part in words for w in part), np.uint64, int(starts[-1])), starts


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


class RunHash:
    """Hashes of any runs of a word sequence in constant time each: differences of prefix sums."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mixed(words) * _powers(_BASE, n), out=self.sums[1:])
        self.back = _powers(_INVERSE, n + 1)

    def __call__(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return mixed((self.sums[start + length] - self.sums[start]) * self.back[start] + np.asarray(length).astype(np.uint64))


def run_starts(starts: np.ndarray, length: int) -> np.ndarray:
    """Where runs of `length` words start that lie in one text."""
    total = int(starts[-1])
    ends = np.repeat(starts[1:], np.diff(starts))
    at = np.arange(total)
    return at[at + length <= ends]
