"""Vectorised word scanning over the UTF-8 bytes of Arrow string columns.

Everything here runs inside a Spark task, on one slice of a batch at a time. A word has
two 64-bit digests: of up to 7 bytes, each is a one-to-one image of the bytes and their
number; up to 32 bytes, both come from a state of 128 bits that takes 8 bytes a step;
longer words are digested by BLAKE2b. The digest of a window of words is folded from the
digests of its halves. No step is linear, so that no pattern of bytes or words makes
different windows alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES = 1 << 20

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: Word bytes are ASCII letters and digits and every byte of a non-ASCII character.
_PLAIN = np.ones(256, bool)
_PLAIN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
SEPARATORS = {"white": _WHITE, "plain": _PLAIN}

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z lower-cased; other bytes are unchanged."""
    return _LOWER[data]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (a finaliser of multiplications and shifts)."""
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(32))


class Rolling:
    """Prefix sums of values times powers of an odd base, modulo 2**64.

    For places to cut, not for equality: long patterned stretches may share a sum.
    """

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(1, 2**63, 256, dtype=U64) * U64(2) + U64(1)
        self.base = int(rng.integers(2**61, 2**62)) * 4 + 3
        self.inverse = pow(self.base, -1, 2**64)
        self._powers = self._inverses = np.ones(1, U64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._powers) < n:
            n = max(n, 2 * len(self._powers))
            for name, base in (("_powers", self.base), ("_inverses", self.inverse)):
                x = np.full(n, base & (2**64 - 1), U64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))
        return self._powers, self._inverses

    def prefix(self, values: np.ndarray) -> np.ndarray:
        power, _ = self.powers(len(values) + 1)
        out = np.zeros(len(values) + 1, U64)
        np.cumsum(values * power[: len(values)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the spans; equal values in equal order give equal hashes."""
        _, inverse = self.powers(len(prefix))
        return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(U64))


BYTES = Rolling(11)
_SEEDS = np.random.default_rng(12).integers(1, 2**63, (2, 4), dtype=U64) * U64(2) + U64(1)
#: Bytes of a word that stand in its digest one to one, and bytes up to which words are digested by columns.
SHORT, MIDDLE = 7, 32
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def folded(h: np.ndarray, n: int, check: bool = False) -> np.ndarray:
    """Digests of all runs of n neighbours on the last axis, from the digests of single ones."""
    seed = _SEEDS[int(check)]
    size = 1
    while size < n:
        step = min(size, n - size)
        h = mix(h[..., : h.shape[-1] - step if h.shape[-1] > step else 0] * seed[2] + h[..., step:] + U64(int(seed[3]) * (size + step) % 2**64))
        size += step
    return h


def text_slices(column: pa.Array | pa.ChunkedArray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets in these bytes) of consecutive rows.

    A slice holds one row or at most ``most`` bytes. Null reads as empty.
    """
    at = 0
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if not len(chunk):
            continue
        chunk = chunk.fill_null("") if chunk.null_count else chunk
        chunk = chunk.cast(pa.large_string())
        offsets = np.frombuffer(chunk.buffers()[1], np.int64)[chunk.offset : chunk.offset + len(chunk) + 1]
        data = chunk.buffers()[2]
        data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        i = 0
        while i < len(chunk):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
            yield at + i, at + j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            i = j
        at += len(chunk)


class Words:
    """The words of a slice: byte spans, and per row the range of words it owns."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: str = "white", lower: bool = False):
        self.data = lower_ascii(data) if lower else data
        self.offsets = offsets
        inside = ~SEPARATORS[separators][data]
        starts, ends = inside.copy(), inside.copy()
        if len(data):
            starts[1:] &= ~inside[:-1]
            ends[:-1] &= ~inside[1:]
            edge = offsets[(offsets > 0) & (offsets < len(data))]
            starts[edge] = inside[edge]
            ends[edge - 1] = inside[edge - 1]
        self.start = np.flatnonzero(starts)
        self.end = np.flatnonzero(ends) + 1
        self.rows = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.rows)
        self._digests: np.ndarray | None = None

    def digests(self, check: bool = False) -> np.ndarray:
        """A 64-bit digest of each word; check asks for the second one."""
        if self._digests is None:
            n, size = len(self.start), self.end - self.start
            padded = np.concatenate([self.data, np.zeros(MIDDLE, np.uint8)])
            lanes = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
            first = lanes[self.start] & _MASK[np.minimum(size, SHORT)] | size.astype(U64) << U64(56)
            out = np.stack([mix(first * seed[0] ^ seed[1]) for seed in _SEEDS]) if n else np.zeros((2, 0), U64)
            far = np.flatnonzero((size > SHORT) & (size <= MIDDLE))
            if len(far):
                at, left, state = self.start[far], size[far], out[:, far]
                for k in range(SHORT, MIDDLE, 8):
                    own = np.flatnonzero(left > k)
                    lane = lanes[at[own] + k] & _MASK[np.minimum(left[own] - k, 8)]
                    for half, seed in zip(state, _SEEDS):
                        half[own] = mix(half[own] * seed[0] + lane)
                out[:, far] = [mix(half * seed[2] + other) for half, other, seed in zip(state, state[::-1], _SEEDS)]
            far = np.flatnonzero(size > MIDDLE)
            if len(far):
                raw = memoryview(self.data.tobytes())
                known = b"".join(hashlib.blake2b(raw[i:j], digest_size=16).digest() for i, j in zip(self.start[far].tolist(), self.end[far].tolist()))
                out[:, far] = np.frombuffer(known, U64).reshape(-1, 2).T
            self._digests = out
        return self._digests[int(check)]

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def windows(self, n: int, check: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(first word of each window of n words inside one row, digest of the window)."""
        last = np.repeat(self.rows[1:], self.count) - n
        first = np.flatnonzero(np.arange(len(self.start)) <= last)
        return first, folded(self.digests(check), n, check)[first]

    def whole(self, rows: np.ndarray, n: int) -> np.ndarray:
        """Digests of the whole sequences of rows that have n words each."""
        return folded(self.digests()[self.rows[rows][:, None] + np.arange(n)], n).reshape(len(rows))


def shingle_sets(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingles per row: (hashes in order of row and value, offsets per row).

    A row with fewer than n words, but at least one, has its whole sequence as one shingle.
    """
    first, h = words.windows(n)
    row = np.searchsorted(words.rows, first, "right") - 1
    for size in range(1, n):
        short = np.flatnonzero(words.count == size)
        if len(short):
            h = np.concatenate([h, words.whole(short, size)])
            row = np.concatenate([row, short])
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    if len(h):
        keep = np.ones(len(h), bool)
        keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        h, row = h[keep], row[keep]
    return h, np.searchsorted(row, np.arange(len(words.count) + 1))


def binary(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())
