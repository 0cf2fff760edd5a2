"""Suffix-array dedup by column-wise construction of a multi-string BWT with common prefixes.

`Columns` builds the Burrows-Wheeler transform of a collection and the array of
longest common prefixes by inserting, each round, one symbol of every string:
round j adds the suffixes of length j at places that the transform of round
j - 1 gives. Every round reads and writes its arrays once from front to back.

Whole documents would need as many rounds as the longest one has bytes, each
over the whole corpus. Only matches of `window` bytes matter, so the collection
is cut where no match can be lost: all windows that share a minimiser (the least
hash of MINI bytes in the window) go to one shard as strings of at most
2 * window - MINI bytes. Equal windows have equal minimisers, so each shard's
transform sees every copy, the rounds are bounded, and shards are independent.
Minimisers that only one place holds are not sent, and a string that is the only
one with its minimiser has no other to be sorted against.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import _exchange as X
from ._bytes import Texts, grams, mix

WINDOW, MINI = 50, 24


class Columns:
    """Sorted suffixes of strings: `owner` and `length` of each, and `lcp` with the suffix before it.

    symbols: the strings' bytes, concatenated; ends: where each ends. No string may be longer than 254 bytes.
    The arrays play the part of the sequential files of the external-memory method: a shard is of bounded
    size, so they stay in memory and nothing is left on an executor's disk.
    """

    def __init__(self, symbols: np.ndarray, ends: np.ndarray):
        starts = np.concatenate([[0], ends[:-1]])
        sizes, count = ends - starts, len(ends)
        shifted = np.zeros(len(symbols) + 1, np.uint8)
        shifted[1:] = symbols
        shifted[1:] += 1  # 0 marks the start of a string
        before = lambda who, size: np.where(size < sizes[who], shifted[ends[who] - size], 0).astype(np.uint8)
        self.owner = np.arange(count, dtype=np.uint32)
        self.length = np.zeros(count, np.uint8)
        self.lcp = np.zeros(count, np.uint8)
        self.bwt = before(np.arange(count), np.zeros(count, np.int64))
        fresh = np.arange(count)
        for size in range(1, int(sizes.max(initial=0)) + 1):
            fresh = self._insert(fresh, size, count, before)

    def _insert(self, fresh: np.ndarray, size: int, count: int, before) -> np.ndarray:
        """Adds the suffixes of `size` symbols; fresh: where those with one symbol less stand."""
        n = len(self.bwt)
        is_fresh = np.zeros(n, bool)
        is_fresh[fresh] = True
        order = np.argsort(self.bwt, kind="stable")
        symbol = self.bwt[order]
        done = int(np.searchsorted(symbol, 1))
        rank = done + np.flatnonzero(is_fresh[order[done:]])
        if not len(rank):
            return rank
        # A new suffix and the one after it have new neighbours; their common prefix is one more than the least
        # one between the places that they extend.
        touched = np.repeat(rank, 2)
        touched[1::2] += 1
        touched = touched[np.concatenate([[True], touched[1:] > touched[:-1]]) & (touched < n)]
        same = (touched > done) & (symbol[touched] == symbol[touched - 1])
        lows, highs = order[touched[same] - 1][::-1] + 1, order[touched[same]][::-1] + 1
        common = np.zeros(len(touched), np.uint8)
        if same.any():
            pairs = np.empty(2 * len(lows), np.int64)
            pairs[::2], pairs[1::2] = lows, highs
            common[same] = np.minimum.reduceat(np.append(self.lcp, np.uint8(0)), pairs)[::2][::-1] + 1
        place = count + rank - done
        old = np.ones(n + len(rank), bool)
        old[place] = False
        who = self.owner[order[rank]]

        def grown(values, added):
            out = np.empty(len(old), values.dtype)
            out[old], out[place] = values, added
            return out

        self.bwt = grown(self.bwt, before(who, size))
        self.owner, self.length = grown(self.owner, who), grown(self.length, size)
        self.lcp = grown(self.lcp, 0)
        self.lcp[count + touched - done] = common
        return place

    def least(self, window: int, value: np.ndarray, ends: np.ndarray, base: np.ndarray) -> np.ndarray:
        """For each window of each string, the least `value` of a string that holds it; base: each string's first place."""
        long = self.length >= window
        group = np.cumsum(self.lcp < window)[long]
        out = np.zeros(int(base[-1]), value.dtype)
        if len(group):
            owner, length = self.owner[long], self.length[long].astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            least = np.repeat(np.minimum.reduceat(value[owner], first), np.diff(np.append(first, len(group))))
            sizes = np.diff(np.concatenate([[0], ends]))
            out[base[owner] + sizes[owner] - length] = least
        return out


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    rows = -(-len(x) // w)
    padded = np.full(rows * w, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    grid = padded.reshape(rows, w)
    front = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], front[w - 1 : w - 1 + n])


class _Runs:
    """Runs of windows of a block that share a minimiser: place in the block's bytes, number of windows, document, minimiser."""

    def __init__(self, texts: Texts, window: int, mini: int):
        self.texts = texts
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))]
        reach = window - mini + 1
        for a, _, t in texts.chunks():
            least = _sliding_min(grams(t.buf, mini), reach)
            if not len(least):
                continue
            doc = np.repeat(np.arange(len(t)), np.diff(t.offs))[: len(least)]
            ok = np.arange(len(least)) + window <= t.offs[1:][doc]
            new = np.ones(len(least), bool)
            new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1]) | ~ok[:-1]
            begin = np.flatnonzero(new)
            size = np.diff(np.append(begin, len(least)))
            cut = np.flatnonzero(size > reach)  # repetitive text: keep the strings short
            if len(cut):
                pieces = -(-size[cut] // reach)
                more = np.concatenate([b + reach * np.arange(1, p) for b, p in zip(begin[cut], pieces, strict=True)])
                begin = np.sort(np.concatenate([begin, more]))
            total = np.concatenate([[0], np.cumsum(ok)])
            windows = total[np.append(begin[1:], len(least))] - total[begin]
            keep = windows > 0
            begin, windows = begin[keep], windows[keep]
            parts.append((begin + texts.offs[a], windows, doc[begin] + a, mix(least[begin], 5)))
        self.place, self.windows, self.doc, self.key = (np.concatenate(x) for x in zip(*parts, strict=True))


class _Strings:
    """The distinct strings of the runs `at`, by shard: what a block sends and how its runs find the answers."""

    def __init__(self, runs: _Runs, at: np.ndarray, rank: np.ndarray, n: int, window: int):
        self.at = at
        whole, seen = runs.texts.buf.tobytes(), {}
        place, sizes = runs.place[at], runs.windows[at] + window - 1
        shard = X.shard_of(runs.key[at], n)
        which = np.fromiter((seen.setdefault(whole[p : p + k], len(seen)) for p, k in zip(place.tolist(), sizes.tolist(), strict=True)), np.int64, len(at))
        self.strings = list(seen)
        least = np.full(len(seen), np.iinfo(np.int64).max)
        np.minimum.at(least, which, rank[runs.doc[at]])
        home = np.zeros(len(seen), np.int64)
        home[which] = shard
        self.tag = np.zeros(len(seen), np.uint32)
        self.tag[which] = runs.key[at].astype(np.uint32)
        order = np.argsort(home, kind="stable")
        self.order, self.least, self.edges = order, least, np.searchsorted(home[order], np.arange(n + 1))
        length = np.fromiter(map(len, self.strings), np.int64, len(seen))
        base = np.zeros(len(seen) + 1, np.int64)
        np.cumsum(length[order] - window + 1, out=base[1:])
        self.base = base
        first = np.zeros(len(seen), np.int64)
        first[order] = base[:-1]
        self.first = first[which]
        self.length = length

    def bodies(self):
        for s in range(len(self.edges) - 1):
            of = self.order[self.edges[s] : self.edges[s + 1]]
            if len(of):
                yield s, np.int64(len(of)).tobytes() + self.length[of].astype(np.uint8).tobytes() + self.least[of].astype(np.uint32).tobytes() + self.tag[of].tobytes() + b"".join(self.strings[k] for k in of)

    def answers(self, got: dict[int, bytes]) -> np.ndarray:
        """0 for a window that an earlier block holds, else 1 + the least rank in this block."""
        out = np.zeros(int(self.base[-1]), np.int64)
        for s, body in got.items():
            k = int(np.frombuffer(body, np.int64, 1)[0])
            out[self.base[self.edges[s]] : self.base[self.edges[s + 1]]] = np.repeat(np.frombuffer(body, np.uint32, k, 8), np.frombuffer(body, np.uint8, k, 8 + 4 * k).astype(np.int64))
        return out


def _serve_strings(rows: list[tuple[int, bytes]], window: int) -> list[bytes]:
    seen: dict[bytes, int] = {}
    which, order_of, counts, tags = [], [], [], []
    for b, body in rows:
        k = int(np.frombuffer(body, np.int64, 1)[0])
        sizes = np.frombuffer(body, np.uint8, k, 8).astype(np.int64)
        order_of.append(np.frombuffer(body, np.uint32, k, 8 + k).astype(np.int64) + (b << 32))
        tags.append(np.frombuffer(body, np.uint32, k, 8 + 5 * k))
        data, at = body[8 + 9 * k :], np.concatenate([[0], np.cumsum(sizes)]).tolist()
        which.append(np.fromiter((seen.setdefault(data[i:j], len(seen)) for i, j in zip(at[:-1], at[1:], strict=True)), np.int64, k))
        counts.append(sizes - window + 1)
    strings = list(seen)
    value, tag = np.full(len(strings), np.iinfo(np.int64).max), np.zeros(len(strings), np.uint32)
    for w, o, t in zip(which, order_of, tags, strict=True):
        np.minimum.at(value, w, o)
        tag[w] = t
    windows = np.fromiter(map(len, strings), np.int64, len(strings)) - window + 1
    base = np.concatenate([[0], np.cumsum(windows)])
    least = np.repeat(value, windows)
    _, group, sharing = np.unique(tag, return_inverse=True, return_counts=True)
    company = np.flatnonzero((sharing > 1)[group])
    if len(company):
        ends = np.cumsum(windows[company] + window - 1)
        inner = np.concatenate([[0], np.cumsum(windows[company])])
        found = Columns(np.frombuffer(b"".join(strings[k] for k in company.tolist()), np.uint8), ends).least(window, value[company], ends, inner)
        least[np.repeat(base[company] - inner[:-1], windows[company]) + np.arange(len(found))] = found
    out = []
    for (b, _), w, n in zip(rows, which, counts, strict=True):
        at = np.repeat(base[w] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
        mine = least[at]
        code = np.where(mine >> 32 < b, 0, 1 + (mine & 0xFFFFFFFF)).astype(np.uint32)
        edge = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        size = np.diff(np.append(edge, len(code)))
        more = -(-size // 255)  # run lengths fit a byte
        last = np.cumsum(more) - 1
        runs = np.full(int(more.sum()), 255, np.uint8)
        runs[last] = size - 255 * (more - 1)
        out.append(np.int64(len(runs)).tobytes() + np.repeat(code[edge], more).tobytes() + runs.tobytes())
    return out


def _ranks(table: pa.Table) -> np.ndarray:
    return np.unique(table.column(X.DOC).to_numpy(), return_inverse=True)[1].astype(np.int64)


def suffix_dedup(docs: DataFrame, window: int = WINDOW, mini: int = MINI, carry: tuple[str, ...] = (), with_text: bool = False, block_bytes: int = 1 << 21, shard_bytes: int = 1 << 22) -> DataFrame:
    """Bytes that a window repeats from a document with a smaller doc_id, removed.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes), a row for each input row;
    with_text adds kept_text, without bytes of characters that were cut through. The columns named in carry come along as
    one struct, `__carry`, so that their names may be any.

    Null and empty texts have no bytes. Rows with equal doc_id never remove from each other; rows without doc_id are
    returned whole and remove nothing. What is kept can begin or end within a character. Other columns are ignored.
    """
    if not mini < window <= 127:
        raise ValueError("window must be above mini and at most 127")
    _, total = X.volume(docs)
    blocks, _ = X.ordered_blocks(docs, total, block_bytes, carry)
    n_mini = max(1, math.ceil(total / 18 / (1 << 20)))
    n_text = max(1, math.ceil(total / shard_bytes))

    def ask_minimisers(b: int, table: pa.Table) -> pa.Table:
        if b < 0:
            return X.asks([])
        runs = _Runs(Texts.of(table.column(X.TEXT)), window, mini)
        return X.asks([(s, b, x.tobytes()) for s, x in X.Keys(runs.key, n_mini, 4).bodies()])

    def wanted(keys: X.Keys, elsewhere: np.ndarray) -> np.ndarray:
        return np.flatnonzero(elsewhere | (keys.counts > 1)[keys.inverse])

    def ask_strings(b: int | None, table: pa.Table, got: dict[int, bytes]) -> pa.Table:
        if b is None or b < 0:
            return X.asks([])
        runs = _Runs(Texts.of(table.column(X.TEXT)), window, mini)
        keys = X.Keys(runs.key, n_mini, 4)
        elsewhere = keys.bits(got)
        strings = _Strings(runs, wanted(keys, elsewhere), _ranks(table), n_text, window)
        return X.asks([(s, b, x) for s, x in strings.bodies()] + [(-1 - b, b, np.packbits(elsewhere).tobytes())])

    def cut(b: int | None, table: pa.Table, got: dict[int, bytes]) -> pa.Table:
        texts = Texts.of(table.column(X.TEXT))
        gone = np.zeros(len(texts.buf), bool)
        if len(gone) and b >= 0:
            runs, rank = _Runs(texts, window, mini), _ranks(table)
            echo = np.unpackbits(np.frombuffer(got.pop(-1 - b, b""), np.uint8), count=len(runs.key)).astype(bool)
            strings = _Strings(runs, wanted(X.Keys(runs.key, n_mini, 4), echo), rank, n_text, window)
            code, n = strings.answers(got), runs.windows[strings.at]
            step = np.arange(int(n.sum())) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n) if len(n) else np.zeros(0, np.int64)
            hit = code[np.repeat(strings.first, n) + step] <= np.repeat(rank[runs.doc[strings.at]], n)
            at = (np.repeat(runs.place[strings.at], n) + step)[hit]
            mark = np.zeros(len(gone) + window + 1, np.int32)
            np.add.at(mark, at, 1)
            np.add.at(mark, at + window, -1)
            gone = np.cumsum(mark)[: len(gone)] > 0
        total = np.concatenate([[0], np.cumsum(gone)])
        begins = gone.copy()
        if len(gone):
            begins[1:] &= ~gone[:-1]
            at = texts.offs[:-1][texts.offs[:-1] < len(gone)]
            begins[at] = gone[at]
        spans = np.concatenate([[0], np.cumsum(begins)])
        a, z = texts.offs[:-1], texts.offs[1:]
        kept = [texts.buf[i:j][~gone[i:j]].tobytes() if total[j] > total[i] else texts.buf[i:j].tobytes() for i, j in zip(a.tolist(), z.tolist(), strict=True)]
        more = {X.CARRY: table.column(X.CARRY)} if carry else {}
        if with_text:
            more["kept_text"] = pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string())
        return pa.table(more | {"doc_id": table.column(X.DOC), "n_bytes": z - a, "n_removed": total[z] - total[a], "n_spans": spans[z] - spans[a], "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()), "kept": pa.array(kept, pa.binary())})

    asked = X.by_block(blocks, ask_minimisers, X.ASK)
    asked = X.with_answers(blocks, X.serve(asked, n_mini, X.answer_elsewhere), ask_strings, X.ASK)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    head = T.StructType()
    if carry:
        head.add(X.CARRY, blocks.schema[X.CARRY].dataType)
    if with_text:
        head.add("kept_text", "string")
    schema = T.StructType(head.fields + T._parse_datatype_string(schema).fields)
    out = X.with_answers(blocks, X.serve(asked, n_text, lambda rows: _serve_strings(rows, window)), cut, schema)
    return out.select(*names, *(["kept_text"] if with_text else []), *([X.CARRY] if carry else []))
