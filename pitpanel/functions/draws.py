"""Hash draws of a bootstrap in numpy, for tasks that make many of them: the words of md5("seed:block:key") for whole arrays of keys.

One hash gives the draws of four replicates.  The numbers equal those of the SQL function ``md5``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np

CHUNK = 1 << 14  # keys hashed at once: the arrays of a round stay in the cache
_SHIFT = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_SINE = [int(abs(math.sin(i + 1)) * 2 ** 32) & 0xFFFFFFFF for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_PLACE = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]


def md5_words(block: list, m: int) -> list[np.ndarray]:
    """The four words of the md5 of ``m`` one-block messages, each read as eight hexadecimal digits; a word of the block is an array or one number for all."""
    a, b, c, d = (np.full(m, v, np.uint32) for v in _START)
    f, t = np.empty(m, np.uint32), np.empty(m, np.uint32)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f); np.bitwise_and(f, b, out=f); np.bitwise_xor(f, d, out=f)
        elif i < 32:
            np.bitwise_xor(b, c, out=f); np.bitwise_and(f, d, out=f); np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f); np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f); np.bitwise_or(f, b, out=f); np.bitwise_xor(f, c, out=f)
        w = block[_PLACE[i]]
        if isinstance(w, np.ndarray):
            f += w
            f += np.uint32(_SINE[i])
        else:
            f += np.uint32(_SINE[i] + int(w) & 0xFFFFFFFF)
        f += a
        np.left_shift(f, np.uint32(_SHIFT[i]), out=t); np.right_shift(f, np.uint32(32 - _SHIFT[i]), out=f); np.bitwise_or(f, t, out=f)
        f += b
        a, d, c, b, f = d, c, b, f, a
    return [(x + np.uint32(v)).byteswap() for x, v in zip((a, b, c, d), _START)]


def blocks_of_four(seed: int, keys: np.ndarray, lengths: np.ndarray, iterations: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(block, four arrays of draws below 2**32) for every block of four replicates; ``keys`` is a matrix of bytes, one key (":" first) in a row."""
    m, width = keys.shape
    messages, before = None, -1
    for four in range((iterations + 3) // 4):
        prefix = f"{seed}:{four}".encode()
        p = len(prefix)
        if p + width > 55:  # more than one block of md5
            digests = b"".join(hashlib.md5(prefix + k[:n].tobytes()).digest() for k, n in zip(keys, lengths))
            yield four, list(np.frombuffer(digests, ">u4").astype(np.uint32).reshape(m, 4).T)
            continue
        if p != before:
            before, body = p, np.zeros((m, 64), np.uint8)
            body[:, p:p + width] = keys
            body[np.arange(m), p + lengths] = 0x80
            messages = list(np.ascontiguousarray(body.view("<u4").T))
            messages[14] = (8 * (p + lengths)).astype(np.uint32)
            used = (p + width) // 4
            messages[used + 1:14], messages[15] = [0] * (13 - used), 0
        start = np.frombuffer(prefix.ljust(-(-p // 4) * 4, b"\0"), "<u4")
        yield four, md5_words([messages[i] | start[i] if i < len(start) else messages[i] for i in range(16)], m)


def number_keys(lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """":" and the digits of the numbers from ``lo`` below ``hi`` as a matrix of bytes, and their lengths."""
    digits = np.arange(lo, hi).astype("S20")
    lengths = np.char.str_len(digits)
    return text_matrix(digits.view(np.uint8).reshape(hi - lo, 20), lengths)


def text_matrix(rows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    out = np.zeros((len(rows), 1 + int(lengths.max(initial=0))), np.uint8)
    out[:, 0] = ord(":")
    out[:, 1:] = rows[:, :out.shape[1] - 1]
    return out, lengths + 1


def string_keys(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys (with their ":", empty for a missing one) as a matrix of bytes, and their lengths."""
    lengths = np.array([len(v) for v in values], np.int64)
    width = max(1, int(lengths.max(initial=0)))
    joined = b"".join(v.ljust(width, b"\0") for v in values)
    return np.frombuffer(joined, np.uint8).reshape(len(values), width), lengths


def poisson_table(edges: list[int]) -> np.ndarray:
    """Variate by the upper half of a draw: the number of sorted ``edges`` at or below it, 255 where the lower half decides."""
    ends = np.searchsorted(edges, np.arange(1, (1 << 16) + 1) * (1 << 16) - 1, "right")
    starts = np.searchsorted(edges, np.arange(1 << 16) * (1 << 16), "right")
    return np.where(starts == ends, starts, 255).astype(np.uint8)


def poisson_weights(draws: np.ndarray, edges: list[int], table: np.ndarray) -> np.ndarray:
    """Poisson(1) variates: the number of sorted ``edges`` at or below each draw."""
    out = table.take(draws >> np.uint32(16))
    open_ = np.flatnonzero(out == 255)
    out[open_] = np.searchsorted(edges, draws[open_].astype(np.int64), "right")
    return out
