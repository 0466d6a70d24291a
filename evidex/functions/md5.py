"""`semantics.uniform` for many short texts at once: MD5 in NumPy, a seventh of the time of hashing them one by one."""

from __future__ import annotations

import hashlib

import numpy as np

_SHIFTS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_SINES = [int(abs(np.sin(i + 1.0)) * 2**32) for i in range(64)]
_START = tuple(map(np.uint32, (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)))
#: A text that fits one block of 64 bytes has this many at most.
ONE_BLOCK = 55


def _first_words(blocks: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The first 8 bytes of each digest, as two words. blocks: a padded text of that length a row, 64 bytes."""
    words = [np.ascontiguousarray(blocks[:, 4 * k : 4 * k + 4]).view("<u4")[:, 0] for k in range(length // 4 + 1)]
    fixed = [0] * 16
    fixed[14] = 8 * length
    a, b, c, d = (np.full(len(blocks), x) for x in _START)
    f, g = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:
            k = i
            np.bitwise_xor(d, np.bitwise_and(b, np.bitwise_xor(c, d, out=f), out=f), out=f)
        elif i < 32:
            k = (5 * i + 1) % 16
            np.bitwise_xor(c, np.bitwise_and(d, np.bitwise_xor(b, c, out=f), out=f), out=f)
        elif i < 48:
            k = (3 * i + 5) % 16
            np.bitwise_xor(d, np.bitwise_xor(b, c, out=f), out=f)
        else:
            k = 7 * i % 16
            np.bitwise_xor(c, np.bitwise_or(b, np.invert(d, out=f), out=f), out=f)
        f += a
        if k < len(words):
            f += words[k]
        f += np.uint32((_SINES[i] + (fixed[k] if k >= len(words) else 0)) & 0xFFFFFFFF)
        np.left_shift(f, _SHIFTS[i], out=g)
        f >>= 32 - _SHIFTS[i]
        f |= g
        f += b
        a, d, c, b, f = d, c, b, f, a
    return a + _START[0], b + _START[1]


def uniforms(heads: np.ndarray, middles: np.ndarray, tails: np.ndarray) -> np.ndarray:
    """A row for each pair of head and tail, a column for each middle: the draw in [0, 1) that the text head + middle + tail
    names. Each is a matrix of bytes, a text a row; heads and tails have as many rows."""
    h, m, t = heads.shape[1], middles.shape[1], tails.shape[1]
    n, length = (len(heads), len(middles)), h + m + t
    blocks = np.zeros((*n, max(64, length)), np.uint8)
    blocks[:, :, :h] = heads[:, None]
    blocks[:, :, h : h + m] = middles[None]
    blocks[:, :, h + m : length] = tails[:, None]
    blocks = blocks.reshape(-1, blocks.shape[2])
    if length > ONE_BLOCK:
        first = b"".join(hashlib.md5(x[:length].tobytes(), usedforsecurity=False).digest()[:8] for x in blocks)
        bits = np.frombuffer(first, ">u8").astype(np.uint64)
    else:
        blocks[:, length] = 0x80
        a, b = _first_words(blocks, length)
        bits = a.byteswap().astype(np.uint64) << np.uint64(32) | b.byteswap()
    return ((bits >> np.uint64(12)) / float(1 << 52)).reshape(n)
