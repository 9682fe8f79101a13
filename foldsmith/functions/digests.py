"""MD5 digests of many texts at once, in NumPy: the digests of ``hash_key``."""

from __future__ import annotations

import math

import numpy as np

_SHIFTS = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_PLACES = [(i, (5 * i + 1) % 16, (3 * i + 5) % 16, 7 * i % 16)[i // 16] for i in range(64)]


def _round(state: np.ndarray, words: list) -> np.ndarray:
    """The state after one block of 16 words, each as wide as the state or a row of it."""
    a, b, c, d = state.copy()
    f = np.empty_like(a)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        f += words[_PLACES[i]] + np.uint32(_SINES[i])
        np.left_shift(f, np.uint32(_SHIFTS[i]), out=a)
        f >>= np.uint32(32 - _SHIFTS[i])
        f |= a
        np.add(f, b, out=a)
        a, b, c, d = d, a, b, c
    return state + np.stack([a, b, c, d])


def md5_words(prefixes: list[bytes], texts: list[bytes]) -> np.ndarray:
    """Digests of every prefix before every text: prefixes x texts x 4 little-endian words."""
    out = np.empty((len(prefixes), len(texts), 4), np.uint32)
    heads, sizes = np.array([len(p) for p in prefixes]), np.array([len(t) for t in texts])
    for head in np.unique(heads):
        rows = np.flatnonzero(heads == head)
        blocks = (head + sizes + 8) // 64 + 1  # a byte that ends the text and eight of its length
        for count in np.unique(blocks):
            columns = np.flatnonzero(blocks == count)
            size = 64 * int(count)
            tails = b"".join((bytes(head) + texts[j] + b"\x80").ljust(size, b"\0") for j in columns)
            tail = np.frombuffer(tails, "<u4").reshape(len(columns), -1).T.copy()
            bits = 8 * (head + sizes[columns])
            tail[-2], tail[-1] = bits & 0xFFFFFFFF, bits >> 32
            width = -(-int(head) // 4)
            starts = b"".join(prefixes[i].ljust(4 * width, b"\0") for i in rows)
            start = np.frombuffer(starts, "<u4").reshape(len(rows), width)
            words = [tail[w][None] | start[:, w, None] if w < width else tail[w][None] for w in range(len(tail))]
            state = np.empty((4, len(rows), len(columns)), np.uint32)
            state[:] = np.array(_START, np.uint32)[:, None, None]
            for at in range(0, len(words), 16):
                state = _round(state, words[at : at + 16])
            out[np.ix_(rows, columns)] = np.moveaxis(state, 0, -1)
    return out
