"""Reproducible randomness: numbers from a hash of the row's keys, the same under any partitioning."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def hashed(*keys: Column) -> Column:
    """An integer in [0, 2^32) from the md5 of the keys, joined by |."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[k.cast("string") for k in keys]).cast("binary")), 1, 8), 16, 10).cast("long")


def uniform(*keys: Column) -> Column:
    return hashed(*keys) / F.lit(4294967296.0)


#: The constants and rotations of MD5 (RFC 1321).
SINES = np.array([int(abs(math.sin(i + 1)) * 2**32) for i in range(64)], np.uint32)
TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4


def md5_starts(words: list[np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """The first four bytes of the MD5 of messages of one padded block, whose 16 words broadcast to ``shape``."""
    a, b, c, d = (np.full(shape, v, np.uint32) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    for i in range(64):
        if i < 16:
            f, m = c ^ d, i
            f &= b
            f ^= d
        elif i < 32:
            f, m = b ^ c, (5 * i + 1) % 16
            f &= d
            f ^= c
        elif i < 48:
            f, m = b ^ c, (3 * i + 5) % 16
            f ^= d
        else:
            f, m = ~d, 7 * i % 16
            f |= b
            f ^= c
        a += f
        a += words[m] + SINES[i]
        f = a >> (32 - TURNS[i])
        a <<= TURNS[i]
        a |= f
        a += b
        a, d, c, b = d, c, b, a
    return (a + np.uint32(0x67452301)).byteswap()


def hashed_rows(prefixes: list[bytes], n: int) -> np.ndarray:
    """``hashed`` in a task: a row a prefix (the keys before the last, joined by |), with 1 to ``n`` as the last key.

    Messages of one length are hashed together, in pieces that a cache holds; those too long for one block, one by one.
    """
    out = np.empty((len(prefixes), n), np.uint32)
    for size in sorted({len(p) for p in prefixes}):
        rows = np.array([i for i, p in enumerate(prefixes) if len(p) == size])
        for digits in range(1, len(str(n)) + 1):
            i = np.arange(10 ** (digits - 1), min(n + 1, 10**digits))
            at, length = size + 1, size + 1 + digits
            if length > 55:
                for row in rows:
                    out[row, i - 1] = [int.from_bytes(hashlib.md5(b"%s|%d" % (prefixes[row], k), usedforsecurity=False).digest()[:4]) for k in i.tolist()]
                continue
            tail = b"|" + bytes(digits) + b"\x80" + bytes(55 - length) + (8 * length).to_bytes(8, "little")
            fixed = np.frombuffer(b"".join(prefixes[row] + tail for row in rows), "<u4").reshape(len(rows), 16).astype(np.uint32)
            ends = np.array([(i // 10**k % 10 + 48).astype(np.uint32) << 8 * ((length - 1 - k) % 4) for k in range(digits)], np.uint32)
            wide = min(len(i), 8192)
            high = max(1, 8192 // wide)
            for top in range(0, len(rows), high):
                for left in range(0, len(i), wide):
                    words = [fixed[top : top + high, k : k + 1] for k in range(16)]
                    for k in range(digits):
                        word = (length - 1 - k) // 4
                        words[word] = words[word] | ends[k, left : left + wide]
                    shape = (len(words[0]), len(i[left : left + wide]))
                    out[rows[top : top + high, None], i[left : left + wide] - 1] = md5_starts(words, shape)
    return out


def hashed_items(prefix: bytes, items: list[tuple[np.ndarray, np.ndarray]], suffix: bytes, n: int) -> np.ndarray:
    """``hashed`` in a task of keys whose text is ``prefix``, an item and ``suffix``, for the ``n`` items that ``by_length`` has dealt."""
    out = np.empty(n, np.uint32)
    for rows, text in items:
        at, size = len(prefix), text.shape[1]
        length = at + size + len(suffix)
        if length > 55:
            out[rows] = [int.from_bytes(hashlib.md5(prefix + t.tobytes() + suffix, usedforsecurity=False).digest()[:4]) for t in text]
            continue
        fixed = np.frombuffer(prefix + bytes(size) + suffix + b"\x80" + bytes(55 - length) + (8 * length).to_bytes(8, "little"), "<u4").astype(np.uint32)
        first, last = at // 4, (at + size - 1) // 4 + 1 if size else at // 4
        for left in range(0, len(rows), 8192):  # in pieces that a cache holds
            piece = text[left : left + 8192]
            wide = np.zeros((len(piece), 4 * (last - first)), np.uint8)
            wide[:, at - 4 * first : at - 4 * first + size] = piece
            own = np.ascontiguousarray(wide.view("<u4").T)
            words = [own[k - first] | fixed[k] if first <= k < last else fixed[k : k + 1] for k in range(16)]
            out[rows[left : left + 8192]] = md5_starts(words, (len(piece),))
    return out


def by_length(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Texts dealt by their number of bytes: where they stand, and their bytes, a row a text."""
    texts = texts.cast(pa.large_binary())
    ends, data = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1], np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    sizes = np.diff(ends)
    return [(rows, data[ends[rows][:, None] + np.arange(size)]) for size in np.unique(sizes) for rows in [np.nonzero(sizes == size)[0]]]
