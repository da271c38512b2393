"""Whole batches of texts as one byte array: word limits and word hashes without a Python loop per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``_BASE ** i`` and its inverse modulo 2^64, for i below at least ``n``."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 21)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, np.uint64(base))
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def chunks(texts: list[bytes], limit: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about ``limit`` bytes, with the number of the first; a longer text stands alone."""
    at, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield at, texts[at:i]
            at, size = i, 0
        size += len(text) + 1
    if at < len(texts):
        yield at, texts[at:]


class Words:
    """Words of several texts: ``starts``/``ends`` in ``data``, ``doc`` the text's number, ``hash`` of the bytes.

    ``inside`` says for each byte value whether it belongs to words; byte 0 must not.
    """

    def __init__(self, texts: list[bytes], inside: np.ndarray):
        self.data = b"\0".join(texts) + b"\0"
        codes = np.frombuffer(self.data, np.uint8)
        member = inside[codes].view(np.int8)
        change = np.diff(member, prepend=np.int8(0))
        self.starts = np.flatnonzero(change == 1)
        self.ends = np.flatnonzero(change == -1)
        limits = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
        self.doc = np.searchsorted(limits, self.starts, side="right")
        self.count = np.bincount(self.doc, minlength=len(texts))
        self.first = np.cumsum(self.count) - self.count
        self._codes = codes

    def hashes(self) -> np.ndarray:
        up, down = _powers(len(self._codes))
        sums = np.cumsum(_BYTE[self._codes] * up[: len(self._codes)])
        before = np.where(self.starts > 0, sums[self.starts - 1], np.uint64(0))
        return mix((sums[self.ends - 1] - before) * down[self.starts])

    def words(self, low: int, high: int) -> bytes:
        return b" ".join(self.data[s:e] for s, e in zip(self.starts[low:high], self.ends[low:high]))
