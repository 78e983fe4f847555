"""Words and their hashes for whole batches of texts, in numpy.

A word is a maximal run of bytes other than the six ASCII white-space characters. All words of a slice
of text are hashed at once: a polynomial over the bytes, taken as differences of one running sum. Words
of more than ``LONG_WORD`` bytes are hashed one by one, as such a polynomial modulo a power of two can
be made to collide by long words. Texts of any length are worked through in slices of about ``SLICE``
bytes, so that what is held besides the texts are their words' hashes.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = 0x9E3779B97F4A7C15
SLICE, LONG_WORD = 1 << 18, 64
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.zeros(256, np.int8)
_LETTER[65:91], _LETTER[97:123] = 1, 2


def _grow(n: int) -> None:
    """Powers of the base and of its inverse modulo 2**64, up to the n-th."""
    global _powers, _inverse
    if len(_powers) < n:
        size = 1 << (n - 1).bit_length()

        def powers(base: int) -> np.ndarray:
            out = np.ones(size, np.uint64)
            have = 1
            while have < size:
                out[have : 2 * have] = out[:have] * np.uint64(pow(base, have, 1 << 64))
                have *= 2
            return out

        _powers, _inverse = powers(_BASE), powers(pow(_BASE, -1, 1 << 64))


class Words(NamedTuple):
    """All words of some texts, one after another."""

    hashes: np.ndarray
    bounds: np.ndarray  # where each text's words begin, and the end of the last
    lengths: np.ndarray  # in bytes
    shouted: np.ndarray  # with capitals A-Z and without small letters a-z


def slices(data: np.ndarray, size: int = SLICE):
    """(from, to) of consecutive parts of about ``size`` bytes that end behind white space."""
    at = 0
    while at < len(data):
        to = min(at + size, len(data))
        while to < len(data):
            gap = np.flatnonzero(_SPACE[data[to : to + 4096]])
            if len(gap):
                to += int(gap[0]) + 1
                break
            to += 4096
        to = min(to, len(data))
        yield at, to
        at = to


def _edges(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(~_SPACE[data], prepend=False, append=False))
    return edge[::2], edge[1::2]


def _within(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many flags are set between each start and end."""
    sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int32)))
    return sums[ends] - sums[starts]


def _hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    long = np.flatnonzero(ends - starts > LONG_WORD)
    own = [int.from_bytes(hashlib.blake2b(data[a:b].tobytes(), digest_size=8).digest(), "little") for a, b in zip(starts[long], ends[long])]
    if len(long):  # a letter stands for each of them
        keep = np.ones(len(data), bool)
        for a, b in zip(starts[long], ends[long]):
            keep[a + 1 : b] = False
        data = data[keep]
        starts, ends = _edges(data)
    _grow(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers[: len(data)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * _inverse[starts])
    hashes[long] = np.array(own, np.uint64)
    return hashes


def words_of(texts: list[bytes], shape: bool = False) -> Words:
    """The words of all texts; lengths and capitals only if ``shape``. Texts are hashed as they are: lower them first if case doesn't count."""
    blob = b"\n".join(texts) + b"\n"
    data = np.frombuffer(blob, np.uint8)
    parts: list[tuple] = []
    for at, to in slices(data):
        part = data[at:to]
        starts, ends = _edges(part)
        row = [_hashed(part, starts, ends), starts + at]
        if shape:
            case = _LETTER[part]
            row += [(ends - starts).astype(np.int32), (_within(case == 1, starts, ends) > 0) & (_within(case == 2, starts, ends) == 0)]
        parts.append(tuple(row))
    hashes, starts, *more = [np.concatenate(x) for x in zip(*parts)]
    bounds = np.searchsorted(starts, np.cumsum([0] + [len(x) + 1 for x in texts]))
    return Words(hashes, bounds, *(more or (np.zeros(0, np.int32), np.zeros(0, bool))))


def small(batches, rows: int = 512, size: int = 4 << 20):
    """The same rows in batches of ``rows`` rows and about ``size`` bytes of the last column, so that few texts are Python objects at a time."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False)
        at, held = 0, 0
        for k, n in enumerate(sizes.tolist()):
            if k > at and (k - at == rows or held + n > size):
                yield batch.slice(at, k - at)
                at, held = k, 0
            held += n
        if batch.num_rows > at:
            yield batch.slice(at)
        del batch
    pa.default_memory_pool().release_unused()  # the worker goes on to other tasks


def chunks(texts: list[bytes], size: int = SLICE):
    """(first, last) of consecutive texts that together have about ``size`` bytes, one at least."""
    a, held = 0, 0
    for k, x in enumerate(texts):
        if held and held + len(x) > size:
            yield a, k
            a, held = k, 0
        held += len(x) + 1
    if a < len(texts):
        yield a, len(texts)


def shingle_hashes(hashes: np.ndarray, bounds: np.ndarray, words: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its runs of ``words`` words; a shorter text is one run."""
    n = max(len(hashes) - words + 1, 0)
    total = np.zeros(n, np.uint64)
    for at in range(0, n, SLICE):
        part = total[at : at + SLICE]
        for j in range(words):
            part += hashes[at + j : at + j + len(part)] * np.uint64(pow(_BASE, 2 * j + 3, 1 << 64) | 1)
        part[:] = mix(part)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= words:
            own = np.sort(total[a : b - words + 1])
            out.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
        elif b > a:
            own = np.uint64(b - a)
            for h in hashes[a:b]:
                own = mix(np.array([own]) * np.uint64(_BASE) + h)[0]
            out.append(np.array([own], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
