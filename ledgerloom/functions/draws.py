"""Draws by hash: the MD5 of many short texts at once, in numpy."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np

_INIT = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_ADD = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_TURN = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
_WORD = [*range(16), *[(5 * i + 1) % 16 for i in range(16)], *[(3 * i + 5) % 16 for i in range(16)], *[7 * i % 16 for i in range(16)]]
#: Bytes of a text that fit into one block of MD5.
BLOCK = 55
#: Texts that are worked on at once, about: their words stay in the processor's cache.
AT_ONCE = 16_384


def md5_start(words: list[np.ndarray | None]) -> tuple[np.ndarray, np.ndarray]:
    """The first two words of the MD5 of padded blocks, given as sixteen arrays of words; None is all zero."""
    shape = next(w.shape for w in words if w is not None)
    a, b, c, d = (np.full(shape, v, np.uint32) for v in _INIT)
    f, t = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.bitwise_not(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        a += f
        if (w := words[_WORD[i]]) is not None:
            a += w
        a += _ADD[i]
        np.left_shift(a, np.uint32(_TURN[i]), out=t)
        np.right_shift(a, np.uint32(32 - _TURN[i]), out=a)
        a |= t
        a += b
        a, b, c, d = d, a, b, c
    a += np.uint32(_INIT[0])
    b += np.uint32(_INIT[1])
    return a, b


def places(seed: str, rounds: range, slots: range, size: int) -> Iterator[tuple[list[int], np.ndarray]]:
    """Some of the rounds, and the place below size that each of the slots draws in them, until all rounds have come.

    A place is the first 13 hex digits of the MD5 of seed:round:slot, modulo size.
    """
    tails = np.array([b"%d\x80" % s for s in slots])
    width = tails.itemsize
    digits = np.char.str_len(tails).astype(np.uint32) - np.uint32(1)
    heads: dict[int, list[tuple[int, bytes]]] = {}
    for r in rounds:
        heads.setdefault(len(h := f"{seed}:{r}:".encode()), []).append((r, h))
    for length, some in heads.items():
        if length + width - 1 > BLOCK:
            for r, h in some:
                yield [r], np.array([[int(hashlib.md5(h + b"%d" % s).hexdigest()[:13], 16) % size for s in slots]])
            continue
        used = -(-(length + width) // 4)
        back = np.zeros((len(slots), 4 * used), np.uint8)
        back[:, length : length + width] = tails.view(np.uint8).reshape(len(slots), width)
        back = np.ascontiguousarray(back.view("<u4").T)
        bits = (digits + np.uint32(length)) * np.uint32(8)
        step = max(1, AT_ONCE // len(slots))
        for i in range(0, len(some), step):
            front = np.zeros((len(some[i : i + step]), 4 * used), np.uint8)
            front[:, :length] = np.frombuffer(b"".join(h for _, h in some[i : i + step]), np.uint8).reshape(-1, length)
            front = front.view("<u4")
            words: list[np.ndarray | None] = [front[:, j, None] | back[j] for j in range(used)] + [None] * (16 - used)
            words[14] = np.broadcast_to(bits, words[0].shape) if words[14] is None else words[14] + bits
            a, b = md5_start(words)
            h = (a.byteswap().astype(np.uint64) << np.uint64(20)) | (b.byteswap() >> np.uint32(12))
            h -= h // np.uint64(size) * np.uint64(size)
            yield [r for r, _ in some[i : i + step]], h.view(np.int64)
