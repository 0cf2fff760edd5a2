"""Substring dedup by difference-cover anchors.

Positions of words are taken modulo PERIOD. COVER is a difference cover: for any
two positions there is a shift below PERIOD that brings both onto the cover. So
two equal windows of WINDOW words share an equal stretch of ANCHOR words that
begins at a cover position of either text, and hashing only those stretches
(three positions in seven) finds every repeat. A stretch that another text has
too is extended, to the left and to the right, to all windows that hold it; those
are compared by two independent 64-bit hashes of their words.
"""

from __future__ import annotations

import hashlib
import math
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _exchange as X
from ._bytes import Texts, Words

PERIOD, COVER = 7, (0, 1, 3)
WINDOW = 13
_ON = np.isin(np.arange(PERIOD), COVER)


def _parts(table: pa.Table):
    """(first row, words, hashes) of a block, a chunk at a time."""
    for a, _, texts in Texts.of(table.column(X.TEXT)).chunks():
        w = Words(texts)
        yield a, w, w.hashes()


def _anchors(w: Words, h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Word indexes and hashes of the anchors."""
    g, ok = w.windows(h, window - PERIOD + 1, 1)
    at = np.flatnonzero(ok & _ON[(np.arange(len(h)) - np.repeat(w.first[:-1], w.count)) % PERIOD])
    return at, g[at]


class Distinct:
    """The distinct 128-bit keys (a, b) in the order in which a block asks for them: by shard, then by key."""

    def __init__(self, a: np.ndarray, b: np.ndarray, n: int = 1):
        order = np.lexsort((b, a))
        x, y = a[order], b[order]
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        self.inverse = np.empty(len(x), np.int64)
        self.inverse[order] = np.cumsum(new) - 1
        self.a, self.b, self.n = x[new], y[new], n
        self.edges = np.searchsorted(X.shard_of(self.a, n), np.arange(n + 1))

    def bodies(self):
        for s in range(self.n):
            i, j = self.edges[s], self.edges[s + 1]
            if j > i:
                yield s, b"".join(np.ascontiguousarray(x[i:j].view(np.uint8).reshape(-1, 8).T).tobytes() for x in (self.a, self.b))

    def bits(self, given: dict[int, bytes]) -> np.ndarray:
        out = np.zeros(len(self.a), bool)
        for s, body in given.items():
            i, j = self.edges[s], self.edges[s + 1]
            out[i:j] = np.unpackbits(np.frombuffer(body, np.uint8), count=int(j - i))
        return out[self.inverse]


def _answer_earlier(rows: list[tuple[int, bytes]]) -> list[bytes]:
    """A bit for each key of each block, which come in order: whether an earlier block has it too."""
    sizes = [len(body) // 16 for _, body in rows]
    a, b = (np.concatenate([X.unpacked(body, n, 8, 8 * n * k) for (_, body), n in zip(rows, sizes, strict=True)]) for k in (0, 1))
    block = np.repeat([x for x, _ in rows], sizes)
    inverse = Distinct(a, b).inverse
    least = np.full(int(inverse.max(initial=-1)) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, inverse, block)
    return [np.packbits(x).tobytes() for x in np.split(least[inverse] < block, np.cumsum(sizes)[:-1])]


def _around(w: Words, h: np.ndarray, window: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that hold an anchor at one of the places `at`: word indexes and two hashes of each."""
    mark = np.zeros(len(h) + PERIOD + 1, np.int32)
    mark[at + 1] = 1
    total = np.cumsum(mark)
    g, ok = w.windows(h, window, 2)
    ok &= total[PERIOD : PERIOD + len(h)] > total[: len(h)]
    where = np.flatnonzero(ok)
    return where, g[where], w.windows(h, window, 3)[0][where] if len(where) else g[where]


class _Block:
    """Words of one block's documents with the places of anchors and windows in the whole block."""

    def __init__(self, table: pa.Table, window: int):
        self.window = window
        self.parts = []
        anchors, base = [], 0
        for first, w, h in _parts(table):
            at, key = _anchors(w, h, window)
            self.parts.append((first, base, w, h, at))
            anchors.append(key)
            base += len(h)
        self.anchors = np.concatenate(anchors) if anchors else np.zeros(0, np.uint64)

    def windows(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Windows around the anchors for which `wanted` holds: places, documents and two hashes of each."""
        places, owners, keys, checks, k = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], 0
        for first, base, w, h, at in self.parts:
            where, key, check = _around(w, h, self.window, at[wanted[k : k + len(at)]])
            k += len(at)
            places.append(where + base)
            owners.append(first + np.searchsorted(w.first, where, "right") - 1)
            keys.append(key)
            checks.append(check)
        return np.concatenate(places), np.concatenate(owners), np.concatenate(keys), np.concatenate(checks)


def substring_dedup(docs: DataFrame, window: int = WINDOW, block_bytes: int = 1 << 21, shard_keys: int = 1 << 20) -> DataFrame:
    """Words that a window repeats from a document with a smaller doc_id, removed.

    Returns doc_id, n_words, n_removed, kept_sha256 and kept_text (kept words joined by one space), a row for each input row.

    Null and empty texts have no words and keep an empty text. Rows with equal doc_id never remove from each other; rows
    without doc_id are returned whole and remove nothing. Other columns of docs are ignored.
    """
    if window < PERIOD:
        raise ValueError(f"window must be at least {PERIOD}")
    _, total = X.volume(docs)
    blocks, _ = X.ordered_blocks(docs, total, block_bytes)
    n_anchor = max(1, math.ceil(total / 14 / shard_keys))
    n_window = max(1, math.ceil(total / 12 / shard_keys))

    def ask_anchors(b: int, table: pa.Table) -> pa.Table:
        if b < 0:
            return X.asks([])
        return X.asks([(s, b, x.tobytes()) for s, x in X.Keys(_Block(table, window).anchors, n_anchor, 4).bodies()])

    def ask_windows(b: int | None, table: pa.Table, got: dict[int, bytes]) -> pa.Table:
        if b is None or b < 0:
            return X.asks([])
        block = _Block(table, window)
        elsewhere = X.Keys(block.anchors, n_anchor, 4).bits(got)
        _, _, *keys = block.windows(elsewhere)
        return X.asks([(s, b, x) for s, x in Distinct(*keys, n_window).bodies()] + [(-1 - b, b, np.packbits(elsewhere).tobytes())])

    def cut(b: int | None, table: pa.Table, got: dict[int, bytes]) -> pa.Table:
        n = table.num_rows
        words = np.zeros(n, np.int64)
        gone_of: dict[int, np.ndarray] = {}
        texts = Texts.of(table.column(X.TEXT))
        if n:
            block = _Block(table, window)
            for first, _, w, _, _ in block.parts:
                words[first : first + len(w.count)] = w.count
            if b >= 0:
                elsewhere = np.unpackbits(np.frombuffer(got.pop(-1 - b, b""), np.uint8))[: len(block.anchors)].astype(bool)
                if len(elsewhere) < len(block.anchors):
                    elsewhere = np.zeros(len(block.anchors), bool)
                at, _, *keys = block.windows(elsewhere)
                hit = at[Distinct(*keys, n_window).bits(got)]
                own = X.Keys(block.anchors, n_anchor, 4)
                at, owner, *keys = block.windows((own.counts > 1)[own.inverse])
                ids = table.column(X.DOC).to_numpy()[owner] if len(owner) else np.zeros(0, np.int64)
                inverse = Distinct(*keys).inverse
                least = np.full(len(inverse), np.iinfo(np.int64).max)
                np.minimum.at(least, inverse, ids)
                hit = np.concatenate([hit, at[ids > least[inverse]]])
                mark = np.zeros(int(words.sum()) + window + 1, np.int32)
                np.add.at(mark, hit, 1)
                np.add.at(mark, hit + window, -1)
                gone = np.cumsum(mark) > 0
                edges = np.concatenate([[0], np.cumsum(words)])
                total = np.concatenate([[0], np.cumsum(gone)])
                for k in np.flatnonzero(total[edges[1:]] > total[edges[:-1]]):
                    gone_of[k] = gone[edges[k] : edges[k + 1]]
        kept = []
        for k in range(n):
            found = texts.bytes(k).split()
            kept.append(b" ".join(compress(found, (~gone_of[k]).tolist()) if k in gone_of else found))
        return pa.table({"doc_id": table.column(X.DOC), "n_words": pa.array(words), "n_removed": pa.array([int(gone_of[k].sum()) if k in gone_of else 0 for k in range(n)], pa.int64()), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()), "kept_text": pa.array(kept, pa.binary()).cast(pa.string())})

    asked = X.by_block(blocks, ask_anchors, X.ASK)
    asked = X.with_answers(blocks, X.serve(asked, n_anchor, X.answer_elsewhere), ask_windows, X.ASK)
    return X.with_answers(blocks, X.serve(asked, n_window, _answer_earlier), cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
