"""Word shingles as sets of 64-bit hashes, hashed for many texts at once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MUL = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values, so that near values get unrelated ones."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, _MUL | np.uint64(1))]))
    return _POWERS


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of each word of the bytes. A word's length is that of its run of other than white space."""
    buf = np.frombuffer(raw, np.uint8)
    space = _SPACE[buf]
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    lengths = np.diff(np.append(starts, len(buf)))
    place = np.arange(starts[0], len(buf)) - np.repeat(starts, lengths)
    value = buf[starts[0] :].astype(np.uint64) + np.uint64(1)
    value[space[starts[0] :]] = 0
    place[space[starts[0] :]] = 0
    return mixed(np.add.reduceat(value * _powers(int(place.max()) + 1)[place], starts - starts[0])), starts


def shingle_sets(texts: Iterable[str], size: int, chunk: int = 1 << 20) -> Iterator[np.ndarray]:
    """Of each text, the sorted distinct hashes of its runs of `size` words; of a text with fewer words, the one of all of them; without words, none. Texts are whole; a chunk holds one at least."""

    def of(part: list[bytes]) -> Iterator[np.ndarray]:
        hashes, starts = word_hashes(b" ".join(t.lower() for t in part) + b" ")  # of bytes, so only A-Z change
        owner = np.searchsorted(np.cumsum([len(t) + 1 for t in part]), starts, "right")
        bounds = np.searchsorted(owner, np.arange(len(part) + 1))
        run = np.zeros(max(0, len(hashes) - size + 1), np.uint64)
        for k in range(size):
            run = run * _MUL + hashes[k : k + len(run)]
        run = mixed(run)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= size:
                yield np.unique(run[a : b - size + 1])
            elif b > a:
                one = np.uint64(b - a)
                for h in hashes[a:b]:
                    one = one * _MUL + h
                yield mixed(np.array([one], np.uint64))
            else:
                yield np.zeros(0, np.uint64)

    part, held = [], 0
    with np.errstate(over="ignore"):
        for text in texts:
            part.append(raw := text.encode("utf-8"))
            held += len(raw)
            if held >= chunk:
                yield from of(part)
                part, held = [], 0
        if part:
            yield from of(part)


class MinHash:
    """Signatures of `width` 32-bit minima; two sets agree in a place with a chance near their Jaccard similarity."""

    def __init__(self, width: int, seed: int = 4):
        draw = np.random.default_rng(seed)
        self.width, self.a, self.b = width, draw.integers(0, 1 << 63, width, np.uint64) * np.uint64(2) + np.uint64(1), draw.integers(0, 1 << 63, width, np.uint64)

    def __call__(self, hashes: np.ndarray) -> bytes:
        least = np.full(self.width, 0xFFFFFFFF, np.uint32)
        with np.errstate(over="ignore"):
            for at in range(0, len(hashes), 4096):
                values = (hashes[at : at + 4096, None] * self.a + self.b) >> np.uint64(32)
                least = np.minimum(least, values.min(axis=0).astype(np.uint32))
        return least.tobytes()
