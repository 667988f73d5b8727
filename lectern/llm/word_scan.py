"""Words of many texts at once, as hashes, places and sizes: the words of ``word_model.words_of``.

A text is read as an array of code points. A word begins where a letter follows none, and at
every character that is a word of its own. Its hash is the sum of a number for each letter
times a power for its place, modulo 2 ** 64, mixed with its language.
"""

from __future__ import annotations

import contextlib
import ctypes
import re
import sys
import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

from lectern.llm.word_model import _UNSPACED

#: Characters read at a time, about; texts are cut at white space only.
CHUNK = 1 << 18
_CODES = 0x110000
_BASE = 0x9E3779B97F4A7C15
_ALONE, _JOINED = 1, 2
_BLANK = re.compile(r"\s")


def _mixed(x: np.ndarray) -> np.ndarray:
    """Whole numbers below 2 ** 64, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    powers = np.full(n, base, np.uint64)
    powers[:1] = 1
    return np.cumprod(powers, out=powers)


def cut(text: str) -> Iterator[str]:
    """A text in parts of CHUNK characters, about, of which none ends within a word."""
    at = 0
    while len(text) - at > 2 * CHUNK and (blank := _BLANK.search(text, at + CHUNK)):
        yield text[at : blank.start()]
        at = blank.start()
    yield text[at:] if at else text


def kinds() -> bytes:
    """Of every character, whether it is a word of its own, part of one or neither; packed, to be sent to the tasks."""
    every = "".join(map(chr, range(_CODES)))
    found = np.zeros(_CODES, np.uint8)
    for kind, like in ((_ALONE, rf"(?:[{_UNSPACED}]|[^\w\s]|_)+"), (_JOINED, rf"[^\W_{_UNSPACED}]+")):
        for run in re.finditer(like, every):
            found[run.start() : run.end()] = kind
    return zlib.compress(found.tobytes())


class Scanner:
    """Reads words; made once in a task."""

    def __init__(self, packed: bytes):
        self.kinds = np.frombuffer(zlib.decompress(packed), np.uint8)
        self.numbers = _mixed(np.arange(1, _CODES + 1, dtype=np.uint64) * np.uint64(_BASE))
        self.numbers[self.kinds == 0] = 0
        self._places(CHUNK + (CHUNK >> 1))

    def _places(self, n: int) -> None:
        self.powers, self.inverse = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)

    def _summed(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        if len(codes) > len(self.powers):
            self._places(len(codes))
        numbers = self.numbers[codes]
        numbers *= self.powers[: len(codes)]
        sums = np.add.reduceat(numbers, starts) if len(starts) else np.zeros(0, np.uint64)
        return sums * self.inverse[starts]

    @staticmethod
    def _seed(lang: str | None) -> np.uint64:
        said = f"{lang is None}\0{lang or ''}".encode("utf-8", "surrogatepass")
        return np.uint64(int.from_bytes(blake2b(said, digest_size=8).digest(), "little"))

    def words(self, lang: str | None, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes, places and sizes of the words of a text in lower case."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = self.kinds[codes]
        alone, joined = kinds == _ALONE, kinds == _JOINED
        starts = np.concatenate([[True], ~joined[:-1]])[: len(codes)]
        starts &= joined
        starts |= alone
        ends = np.concatenate([~joined[1:], [True]])[: len(codes)]
        ends &= joined
        ends |= alone
        starts, ends = np.flatnonzero(starts), np.flatnonzero(ends)
        return _mixed(self._summed(codes, starts) ^ self._seed(lang)).view(np.int64), starts, ends - starts + 1

    def hashed(self, lang: str | None, words: list[str]) -> np.ndarray:
        """The hashes of given words; the border, a line's end, has one too."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        return _mixed(self._summed(codes, np.cumsum(sizes) - sizes) ^ self._seed(lang)).view(np.int64)


def chunks(texts: list[str]) -> Iterator[tuple[str, list[int], list[int]]]:
    """Texts in lower case put together up to CHUNK characters, with the numbers of the texts and where each ends."""
    held, numbers, ends, size = [], [], [], 0
    for i, text in enumerate(texts):
        for part in cut(text.lower()):
            if size and size + len(part) > CHUNK:
                yield "\n".join(held), numbers, ends
                held, numbers, ends, size = [], [], [], 0
            held.append(part)
            size += len(part) + 1
            numbers.append(i)
            ends.append(size)
    if held:
        yield "\n".join(held), numbers, ends


def give_back() -> None:
    """Freed memory goes back to the system: Python workers wait for their next task with what their heap still holds."""
    pa.default_memory_pool().release_unused()
    # Other C libraries than glibc have no such call.
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


# Functions of this module travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
