"""Vectorised views of text columns: bytes, words and rolling hashes.

Everything here works on the flat UTF-8 buffer of an Arrow string column, so a
chunk of documents costs a handful of numpy passes and no per-word Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text handled at once; the arrays below need about 40 bytes for each.
CHUNK = 1 << 21


def _separators(*spans: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for a, b in spans:
        table[a : b + 1] = True
    return table


#: Separators of words `[^\x20\x09-\x0D]+`.
SPACE = _separators((0x20, 0x20), (0x09, 0x0D))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
#: Multipliers that combine the words of a window; one row for each family of windows.
_WORD = _rng.integers(1, 2**63, (4, 64), dtype=np.uint64) * U64(2) + U64(1)
_R = 0x9E3779B97F4A7C15 | 1
_RI = pow(_R, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> list[np.ndarray]:
    """R**i and R**-i for i below n, modulo 2**64."""
    if len(_powers[0]) < n:
        for k, r in enumerate((_R, _RI)):
            p = np.full(max(n, CHUNK + 1024), r, U64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    out = [p[:n] for p in _powers]
    if n > 2 * CHUNK:  # those of one very long text are not kept
        forget()
    return out


def forget() -> None:
    _powers[:] = [np.ones(1, U64), np.ones(1, U64)]


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective finaliser, so that every bit depends on every bit."""
    h = h + U64(salt * 0x9E3779B97F4A7C15 % 2**64)
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


class Texts:
    """Consecutive texts as one buffer: text k is buf[offs[k]:offs[k + 1]]."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        self.buf, self.offs = buf, offs

    def __len__(self) -> int:
        return len(self.offs) - 1

    def bytes(self, k: int) -> bytes:
        return self.buf[self.offs[k] : self.offs[k + 1]].tobytes()

    @staticmethod
    def of(column: pa.Array | pa.ChunkedArray) -> Texts:
        """Null texts count as empty."""
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
        if column.null_count:
            column = column.fill_null("")
        big = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
        if not len(column):
            return Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))
        offs = np.frombuffer(column.buffers()[1], np.int64 if big else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        data = column.buffers()[2]
        buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
        return Texts(buf, offs - offs[0])

    def chunks(self, size: int = CHUNK) -> Iterator[tuple[int, int, Texts]]:
        """(first, last + 1, texts) in runs of about `size` bytes; a longer text is a run of its own."""
        k, n = 0, len(self)
        while k < n:
            end = max(k + 1, int(np.searchsorted(self.offs, self.offs[k] + size, "right")) - 1)
            end = min(end, n)
            yield k, end, Texts(self.buf[self.offs[k] : self.offs[end]], self.offs[k : end + 1] - self.offs[k])
            k = end


class Words:
    """The words of texts: where they begin and end, and first[k], the first word of text k."""

    def __init__(self, texts: Texts, sep: np.ndarray = SPACE, lower: bool = False):
        buf, offs = texts.buf, texts.offs
        self.texts = texts
        self.buf = LOWER[buf] if lower else buf
        inside = ~sep[buf]
        begin, end = inside.copy(), inside.copy()
        if len(buf):
            begin[1:] &= ~inside[:-1]
            end[:-1] &= ~inside[1:]
            at = offs[:-1][offs[:-1] < len(buf)]
            begin[at] = inside[at]
            at = offs[1:][offs[1:] > 0] - 1
            end[at] = inside[at]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.start, offs)
        self.count = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.start)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self) -> np.ndarray:
        """A 64-bit polynomial hash of each word, from prefix sums."""
        total, inverse = prefix_sums(self.buf), powers(len(self.buf) + 1)[1]
        return mix((total[self.end] - total[self.start]) * inverse[self.start])

    def windows(self, h: np.ndarray, n: int, family: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of n words from each word on, and whether those words lie in one text."""
        out = np.zeros(len(h), U64)
        m = len(h) - n + 1
        ok = np.zeros(len(h), bool)
        if m > 0:
            acc = out[:m]
            for k in range(n):
                acc += h[k : k + m] * _WORD[family, k]
            out[:m] = mix(acc, family + 1)
            ok[:m] = True
            for back in range(1, n):
                at = self.first[1:] - back
                at = at[(at >= 0) & (at >= self.first[:-1])]
                ok[at] = False
        return out, ok


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    total = np.zeros(len(buf) + 1, U64)
    np.cumsum(_BYTE[buf] * powers(len(buf) + 1)[0][: len(buf)], out=total[1:])
    return total


def grams(buf: np.ndarray, m: int) -> np.ndarray:
    """A hash of the m bytes from each position on, for the first len(buf) - m + 1 positions."""
    n = len(buf) - m + 1
    if n <= 0:
        return np.zeros(0, U64)
    total, inverse = prefix_sums(buf), powers(len(buf) + 1)[1]
    return mix((total[m:] - total[:n]) * inverse[:n])
