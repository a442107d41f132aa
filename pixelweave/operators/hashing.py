"""The hash of ``features.hash52`` for whole batches: md5 in array operations.

A message that fits one md5 block is hashed for all rows of a batch at once; the
values equal those of ``conv(substring(md5(text), 1, 13), 16, 10)``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa

_TURNS = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
_ADDED = [int(abs(math.sin(i + 1)) * (1 << 32)) for i in range(64)]
_BLOCK = 55      # bytes of a message that fits one block
_MASK = (1 << 32) - 1


def _first_words(words: list) -> tuple[np.ndarray, np.ndarray]:
    """The first two words of md5 of one block each; a word is an array or one number for all."""
    n = next(len(w) for w in words if isinstance(w, np.ndarray))
    start = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
    a, b, c, d = (np.full(n, s, np.uint32) for s in start)
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        if i < 16:
            g = i
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:
            g = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            g = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            g = 7 * i % 16
            np.bitwise_not(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f)
        w = words[g]
        if isinstance(w, np.ndarray):
            np.add(f, w, out=f)
            w = 0
        np.add(f, np.uint32((_ADDED[i] + w) & _MASK), out=f)
        np.left_shift(f, np.uint32(_TURNS[i]), out=t)
        np.right_shift(f, np.uint32(32 - _TURNS[i]), out=f)
        np.bitwise_or(f, t, out=f)
        # the old a is free: it takes the new b
        np.add(f, b, out=a)
        a, b, c, d = d, a, b, c
    return a + np.uint32(start[0]), b + np.uint32(start[1])


def hashes52(texts: pa.Array, endings: Sequence[str]) -> np.ndarray:
    """(endings x rows): the hash below 2**52 of each text with each ending, as double."""
    ends = [e.encode() for e in endings]
    out = np.empty((len(ends), len(texts)))
    if not len(texts):
        return out
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    size = np.diff(offsets)
    for length in np.unique(size).tolist():
        rows = np.flatnonzero(size == length)
        if length + max(map(len, ends)) > _BLOCK:
            plain = [bytes(data[offsets[r]:offsets[r] + length]) for r in rows.tolist()]
            for i, e in enumerate(ends):
                out[i, rows] = [int(hashlib.md5(p + e).hexdigest()[:13], 16) for p in plain]
            continue
        block = np.zeros((len(rows), -(-length // 4) * 4), np.uint8)
        block[:, :length] = data[offsets[rows][:, None] + np.arange(length)]
        head = [np.ascontiguousarray(c) for c in block.view("<u4").T]
        for i, e in enumerate(ends):
            tail = bytearray(64)
            tail[length:length + len(e) + 1] = e + b"\x80"
            tail[56:] = ((length + len(e)) * 8).to_bytes(8, "little")
            fixed = np.frombuffer(bytes(tail), "<u4").tolist()
            words = [head[j] | np.uint32(w) if j < len(head) else w for j, w in enumerate(fixed)]
            if not head:
                words[0] = np.full(len(rows), words[0], np.uint32)
            one, two = _first_words(words)
            out[i, rows] = (one.byteswap().astype(np.uint64) << np.uint64(20) | two.byteswap() >> np.uint32(12)).astype(float)
    return out
