"""Words of many texts at once, over their UTF-8 bytes."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: UTF-8 bytes of text that a task works on at once, or one longer text.
CHUNK = 1 << 20
ROW_BYTES = 64
ODD = np.uint64(0x9E3779B97F4A7C15)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True
#: All bytes but ASCII white space.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as keep it apart from ``taken`` in either case."""
    used, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(NamedTuple):
    data: np.ndarray  #: all texts' bytes with A-Z lower-cased, a line break after each text
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    counts: np.ndarray  #: words per text
    heads: tuple[np.ndarray, ...] = ()  #: hashes of the words' first bytes, for each length asked for


def scan(texts: list[bytes], heads: tuple[int, ...] = (), is_word: np.ndarray = IS_WORD) -> Words:
    """The words (runs of the bytes ``is_word``: ASCII letters, digits and non-ASCII bytes) of ``texts``, one text after the other.

    ``heads``: lengths in bytes for which the words' beginnings are hashed as well.
    """
    data = LOWER[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
    inside = np.r_[False, is_word[data], False]
    starts = np.flatnonzero(inside[1:] & ~inside[:-1])
    ends = np.flatnonzero(~inside[1:] & inside[:-1])
    # A sum of byte values weighted by powers of an odd number, shifted back to the word's start.
    power = np.cumprod(np.full(len(data) + 1, ODD))
    inverse = np.cumprod(np.full(len(data) + 1, np.uint64(pow(int(ODD), -1, 1 << 64))))
    value = mix(np.arange(1, 257, dtype=np.uint64) * ODD)
    prefix = np.r_[np.uint64(0), np.cumsum(value[data] * power[: len(data)])]

    def hashed(to: np.ndarray) -> np.ndarray:
        return mix((prefix[to] - prefix[starts]) * inverse[starts] + (to - starts).astype(np.uint64))

    bounds = np.cumsum([len(t) + 1 for t in texts])
    return Words(data, starts, ends, hashed(ends), np.diff(np.r_[0, np.searchsorted(starts, bounds)]), tuple(hashed(np.minimum(starts + n, ends)) for n in heads))


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of ``k`` neighbouring word hashes."""
    out = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for j in range(k):
        out = mix(out * ODD + words[j : j + len(out)])
    return out


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[slice, list[str | None]]]:
    """Rows of a text column about ``size`` bytes at a time, so that a batch is never whole in Python's own strings."""
    # A row counts for some bytes of its own, so that there are never too many of them.
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + ROW_BYTES)
    at = 0
    while at < len(column):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + size, "right")))
        yield slice(at, to), column.slice(at, to - at).to_pylist()
        at = to


def lean(run):
    """A batch function that gives memory back when its task is over: idle Python workers count against the executor."""

    @functools.wraps(run)
    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return wrapped
