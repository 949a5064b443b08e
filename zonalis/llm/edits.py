"""Edit distances of many pairs of lines at once, in bit-parallel columns (Myers) over a band of blocks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: A group of pairs holds this many at most, and a table of places of this many numbers; up to FULL pairs take hardly longer than one.
GROUP, TABLE, FULL = 4096, 1 << 22, 512
_ALL, _ONE, _TOP = np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(1), np.uint64(63)


def _distances(places: np.ndarray, chars: np.ndarray, m: np.ndarray, n: np.ndarray, most: int) -> np.ndarray:
    """Of each pair the edit distance, or more than `most` where it is more. places (block, n) tells where a pattern holds a character, 64 places a block; chars (column, pair) which number of it
    a text's characters have; m and n are the lengths of patterns and texts, no more than `most` apart, the longest text first.

    A column of the distance table is held as steps down it, a bit each: up where a step adds one, down where it takes one off. Only blocks within `most` of the diagonal are worked out; what lies outside counts
    as one more a step, which is never too little."""
    blocks, pairs = len(places), len(m)
    up, down = np.full((blocks, pairs), _ALL), np.zeros((blocks, pairs), np.uint64)
    foot = np.repeat(np.arange(64, 64 * blocks + 1, 64, dtype=np.uint64)[:, None], pairs, axis=1)  # the distance at a block's last place
    buffers = np.empty((6, pairs), np.uint64)
    rest = np.searchsorted(-n, -np.arange(int(n[0]) + 1), "left").tolist()  # pairs whose text goes beyond a column
    out, past = np.empty(pairs, np.int64), min(blocks - 1, most // 64)
    for j in range(int(n[0])):
        k = rest[j]
        same, across, rises, falls, more, less = (b[:k] for b in buffers)
        low, high = max(0, j - most) // 64, min(blocks - 1, (j + most) // 64)
        if high > past:
            np.add(foot[high - 1], np.uint64(64), out=foot[high])
            past = high
        more[:] = 1
        less[:] = 0
        at = chars[j, :k]
        for b in range(low, high + 1):
            u, d, f = up[b, :k], down[b, :k], foot[b, :k]
            np.take(places[b], at, out=same, mode="clip")
            np.bitwise_or(d, same, out=falls)  # kept for the new steps down
            np.bitwise_or(same, less, out=same)
            np.bitwise_and(same, u, out=across)
            np.add(across, u, out=across)
            np.bitwise_xor(across, u, out=across)
            np.bitwise_or(across, same, out=across)
            np.bitwise_or(across, u, out=rises)
            np.invert(rises, out=rises)
            np.bitwise_or(rises, d, out=rises)
            np.bitwise_and(across, u, out=across)  # falls from here on
            np.right_shift(rises, _TOP, out=same)
            np.left_shift(rises, _ONE, out=rises)
            np.bitwise_or(rises, more, out=rises)
            more[:] = same
            np.right_shift(across, _TOP, out=same)
            np.left_shift(across, _ONE, out=across)
            np.bitwise_or(across, less, out=across)
            less[:] = same
            np.bitwise_and(rises, falls, out=d)
            np.bitwise_or(rises, falls, out=u)
            np.invert(u, out=u)
            np.bitwise_or(u, across, out=u)
            np.add(f, more, out=f)
            np.subtract(f, less, out=f)
        ended = np.arange(rest[j + 1], k)
        if len(ended):
            last, beyond = (m[ended] - 1) // 64, _ALL << ((m[ended] - 1) % 64).astype(np.uint64) << _ONE
            steps = np.bitwise_count(up[last, ended] & beyond).astype(np.int64) - np.bitwise_count(down[last, ended] & beyond)
            out[ended] = foot[last, ended].astype(np.int64) - steps
    return out


def all_within(lines: list[str], one: np.ndarray, two: np.ndarray, most: np.ndarray, single: Callable[[str, str, int], bool]) -> np.ndarray:
    """Of pairs of places in lines, whether the edit distance is within the pair's `most`. Pairs of like length go together, where few do with shorter ones down to half; where still few do, each is judged by `single`."""
    raw = [x.encode("utf-32-le") for x in lines]
    size = np.array([len(x) // 4 for x in raw], np.int64)
    out = np.abs(size[one] - size[two]) <= most
    out[out] = (np.minimum(size[one[out]], size[two[out]]) > 0) | (np.maximum(size[one[out]], size[two[out]]) <= most[out])
    left = np.flatnonzero(out & (np.minimum(size[one], size[two]) > 0))
    codes, start = np.frombuffer(b"".join(raw), np.uint32), np.cumsum(size) - size
    seen = np.zeros(0x110000, np.int32)
    seen[codes] = 1
    kinds = int(seen.sum()) + 1  # number 0 is no character's
    number = np.cumsum(seen, dtype=np.int32)[codes]
    long = np.where(size[one] >= size[two], one, two)
    short = one + two - long
    left = left[np.argsort(-size[long[left]], kind="stable")]
    at = 0
    while at < len(left):
        blocks = int(-(-size[long[left[at]]] // 64))
        longest = int(size[long[left[at]]])
        alike, half = (int(np.searchsorted(-size[long[left]], -max(int(x * longest), 32), "right")) for x in (0.85, 0.5))
        alike = max(alike, min(half, at + FULL))
        own = left[at : min(max(alike, at + 1), at + GROUP, at + max(1, TABLE // (kinds * blocks)))]
        at += len(own)
        bound = int(most[own].max())
        if len(own) < 16 * min(blocks, 2 * bound // 64 + 2):
            out[own] = [single(lines[p], lines[q], t) for p, q, t in zip(one[own].tolist(), two[own].tolist(), most[own].tolist(), strict=True)]
            continue
        own = own[np.argsort(-size[short[own]], kind="stable")]
        pattern, which = np.unique(long[own], return_inverse=True)
        length = size[pattern]
        owner = np.repeat(np.arange(len(pattern)), length)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(length) - length, length)
        places = np.zeros((blocks, len(pattern) * kinds), np.uint64)
        np.bitwise_or.at(places.reshape(-1), place // 64 * places.shape[1] + owner * kinds + number[start[pattern][owner] + place], _ONE << (place % 64).astype(np.uint64))
        n = size[short[own]]
        column = np.arange(int(n[0]))[:, None]
        chars = np.where(column < n, number[np.minimum(start[short[own]] + column, len(number) - 1)], 0) + which * kinds
        out[own] = _distances(places, chars, size[long[own]], n, bound) <= most[own]
    return out
