"""Whole texts as byte arrays: tokens, their 64-bit hashes and runs of them, vectorised inside tasks.

Texts reach Python as UTF-8 bytes.  ``chunks`` packs several of them into one
array, a newline after each, so that no token spans two texts.  A chunk holds
about a megabyte, or one longer text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import xxhash

CHUNK_BYTES = 1 << 20
# Tokens longer than this are hashed one by one: a polynomial modulo 2**64 has known collisions on long, regular strings.
LONG_TOKEN = 512

_RNG = np.random.default_rng(20240531)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_STEP_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
ODD = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
LETTER = np.zeros(256, bool)
LETTER[0x41:0x5B] = LETTER[0x61:0x7B] = LETTER[0x80:] = True
DIGIT = np.zeros(256, bool)
DIGIT[0x30:0x3A] = True


class Chunk:
    """Some texts in one byte array; text i lies at ``starts[i]:ends[i]``."""

    def __init__(self, rows: list[int], texts: list[bytes]):
        self.rows = np.array(rows, np.int64)
        self.bytes = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(sizes + 1) - 1
        self.starts = self.ends - sizes


def chunks(texts: Iterable[bytes | None]) -> Iterator[Chunk]:
    """All texts in order, null as empty."""
    rows: list[int] = []
    held: list[bytes] = []
    size = 0
    for i, t in enumerate(texts):
        t = t or b""
        if held and size + len(t) > CHUNK_BYTES:
            yield Chunk(rows, held)
            rows, held, size = [], [], 0
        rows.append(i)
        held.append(t)
        size += len(t) + 1
    if held:
        yield Chunk(rows, held)


def lower_latin(b: np.ndarray) -> np.ndarray:
    """A-Z and the capitals of Latin-1 (two bytes in UTF-8) in lower case."""
    out = LOWER[b]
    after = np.flatnonzero(b[:-1] == 0xC3) + 1
    high = b[after]
    after = after[(high >= 0x80) & (high <= 0x9E) & (high != 0x97)]
    out[after] += 0x20
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes, so that any of their bits may serve as a bucket."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        n = max(n, 2 * CHUNK_BYTES)
        for k, step in enumerate((_STEP, _STEP_INVERSE)):
            p = np.full(n, step, np.uint64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


class Tokens:
    """Maximal runs of bytes with one label other than 0, with hashes; those of text i are ``first[i]:first[i+1]``."""

    def __init__(self, chunk: Chunk, b: np.ndarray, label: np.ndarray):
        label = label.view(np.int8)
        turn = np.flatnonzero(np.diff(label, prepend=np.int8(0), append=np.int8(0)))
        before = np.append(label, np.int8(0))[turn - 1]  # at 0 this reads the 0 just appended
        self.starts = turn[np.append(label, np.int8(0))[turn] != 0]
        self.ends = turn[before != 0]
        up, down = _powers(len(b) + 1)
        total = np.empty(len(b) + 1, np.uint64)
        total[0] = 0
        np.cumsum(_BYTE[b] * up[: len(b)], out=total[1:])
        self.hash = mix((total[self.ends] - total[self.starts]) * down[self.starts])
        for i in np.flatnonzero(self.ends - self.starts > LONG_TOKEN):
            self.hash[i] = xxhash.xxh3_64_intdigest(b[self.starts[i] : self.ends[i]].tobytes())
        self.first = np.append(np.searchsorted(self.starts, chunk.starts), len(self.starts))
        self.n = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.starts)


def words(chunk: Chunk, lower: bool = True) -> Tokens:
    """Runs of ``[^\\x20\\x09-\\x0D]``, A-Z in lower case where asked."""
    return Tokens(chunk, LOWER[chunk.bytes] if lower else chunk.bytes, ~SEPARATOR[chunk.bytes])


def letters(chunk: Chunk) -> Tokens:
    """Runs of letters in lower case; every byte beyond ASCII counts as a letter."""
    b = lower_latin(chunk.bytes)
    return Tokens(chunk, b, LETTER[b])


def runs(h: np.ndarray, offsets: tuple[int, ...]) -> np.ndarray:
    """Hash of the tokens at *offsets* from each place where all of them exist."""
    n = len(h) - offsets[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k, o in enumerate(offsets):
        out += h[o : o + n] * ODD[(8 * len(offsets) + 3 * k + offsets[-1]) % len(ODD)]
    return mix(out)


def shingles(t: Tokens, width: int = 5) -> list[np.ndarray]:
    """Each text's distinct *width*-word shingles as sorted hashes; a shorter text is one shingle, no words none."""
    h = runs(t.hash, tuple(range(width)))
    out = []
    for a, z in zip(t.first[:-1].tolist(), t.first[1:].tolist(), strict=True):
        if z - a >= width:
            out.append(np.unique(h[a : z - width + 1]))
        elif z > a:
            out.append(mix(np.sum(t.hash[a:z] * ODD[: z - a], dtype=np.uint64, keepdims=True) + np.uint64(z - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
