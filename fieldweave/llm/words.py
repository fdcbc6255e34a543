"""Hashes of the words of many texts at once, without making the words."""

from __future__ import annotations

import numpy as np

_FACTOR = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True  # what stands between words; no other letter's UTF-8 has these bytes


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def rolling(words: np.ndarray, window: int) -> np.ndarray:
    """Hashes of all runs of so many words."""
    rolled = np.zeros(max(len(words) - window + 1, 0), dtype=np.uint64)
    for k in range(window):
        rolled = rolled * np.uint64(_FACTOR) + words[k : k + len(rolled)]
    return mixed(rolled)


class Words:
    """64-bit hashes of words: differences of prefix sums of a polynomial over the bytes, mixed.

    Equal words have equal hashes wherever they stand. Powers are kept for the longest block so far.
    """

    def __init__(self) -> None:
        self.power = self.inverse = np.ones(1, dtype=np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            n = 1 << n.bit_length()
            steps = np.full(n, _FACTOR, dtype=np.uint64)
            steps[0] = 1
            self.power = np.cumprod(steps)
            steps[1:] = pow(_FACTOR, -1, 1 << 64)
            self.inverse = np.cumprod(steps)

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words of all texts, one text behind another, and the number of words of each text."""
        raw = [t.encode() if t else b"" for t in texts]
        data = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
        self._powers(len(data))
        change = np.diff((~_SPACE[data]).astype(np.int8), prepend=0)
        starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[: len(data)], out=sums[1:])
        hashes = mixed((sums[ends] - sums[starts]) * self.inverse[starts])
        bounds = np.searchsorted(starts, np.cumsum([len(r) + 1 for r in raw]))
        return hashes, np.diff(bounds, prepend=0)

    def one(self, text: str | None) -> np.ndarray:
        return self.of([text])[0]


def blocks(texts: list[str | None], chars: int = 400_000):
    """(begin, texts) of consecutive texts of about so many characters together."""
    begin, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= chars:
            yield begin, texts[begin : i + 1]
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, texts[begin:]
