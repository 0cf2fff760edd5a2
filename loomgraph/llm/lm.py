"""Language-model scoring by a weighted backoff automaton.

States are histories of up to order - 1 tokens. A seen n-gram is an arc from its
history that carries its smoothed log probability and leads to the longest
history that is a state; a failure arc leads from a history to the one that is a
word shorter and carries the weight that its seen arcs leave. A text is read once
from left to right: the traversal carries the state, takes the arc of the next
token or else failure arcs until one has it, and adds up their weights. Smoothing
is by a Dirichlet prior on the shorter history,

    p(w | h) = (c(h w) + m p(w | h')) / (c(h) + m),

so a failure arc weighs m / (c(h) + m) and every state's weights sum to one. The
whole automaton grows with the corpus and is never in one place: its counts lie
in shards, and a block of documents fetches those of its own n-grams, which are
all that its traversals can touch, and compiles them.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from . import _exchange as X
from ._bytes import Texts, Words, mix

START, END = np.uint64(0x5354415254), np.uint64(0x454E44)
_ORDER = np.random.default_rng(8).integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Log weights are multiples of this, so that sums do not depend on their order.
GRAIN = 2.0**-32
#: With fewer texts than this left, they are read one after the other.
FEW = 48
ROOT, BEGIN = 0, 1


def pack(body: bytes) -> bytes:
    """Planes of sorted keys and of counts, most of them 0 and 1, are far from random: half of a message is not sent."""
    return zstandard.ZstdCompressor(level=1).compress(body)


def unpack(body: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(body)


def grained(p: np.ndarray) -> np.ndarray:
    return np.floor(np.log10(p) / GRAIN + 0.5) * GRAIN


class _Tokens:
    """Tokens of a block's documents with a start before and an end after each; grams[k - 1] are the k-grams that end there."""

    def __init__(self, texts: Texts, order: int):
        flows, sizes = [], []
        for _, _, t in texts.chunks():
            w = Words(t, lower=True)
            h = w.hashes()
            first = w.first + 2 * np.arange(len(w.first))
            flow = np.empty(len(h) + 2 * len(w.count), np.uint64)
            inner = np.ones(len(flow), bool)
            inner[first[:-1]] = inner[first[1:] - 1] = False
            flow[inner], flow[first[:-1]], flow[first[1:] - 1] = h, START, END
            flows.append(flow)
            sizes.append(w.count + 2)
        flow = np.concatenate(flows) if flows else np.zeros(0, np.uint64)
        self.size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.size)]).astype(np.int64)
        self.step = np.arange(len(flow)) - np.repeat(self.first[:-1], self.size)
        self.at = [np.flatnonzero(self.step >= 1)]
        self.grams = [mix(flow[self.at[0]], 11)]
        history = flow * _ORDER[0]
        for k in range(2, order + 1):
            history[1:] = mix(history[:-1], k) + flow[1:] * _ORDER[k - 1]
            at = np.flatnonzero(self.step >= k - 1)
            self.at.append(at)
            self.grams.append(mix(history[at], 20 + k))


class Automaton:
    """The states and arcs that a block's tokens can touch.

    which[k - 1] gives for each place the index of the distinct k-gram that ends there, counts[k - 1] the training count of each.
    arc[k][t] is the arc by which a state of length k, standing before place t, reads the token there, or -1 where it has none;
    an arc has a weight and the state that it leads to, a state its length, its failure arc's state and that arc's weight."""

    def __init__(self, tokens: _Tokens, which: list[np.ndarray], counts: list[np.ndarray], prior: float, n_train: int, n_words: int):
        self.tokens, last = tokens, len(counts)
        one = (counts[0] + 0.5) / (n_train + 0.5 * (n_words + 1))
        self.base = grained(one)
        unknown = float(grained(np.array(0.5 / (n_train + 0.5 * (n_words + 1)))))
        texts = int(counts[0][which[0][tokens.first[1:] - 1]].max(initial=0))  # as many starts as ends
        self.begin = BEGIN if last > 1 else ROOT
        held, fail, length = [np.array([0, texts])], [np.zeros(2, np.int64)], [np.array([0, min(1, last - 1)])]
        self.arc, weight, to = [], [], []
        arcs, states, p, shorter = 0, 2, one, np.zeros(0, np.int64)
        for k in range(1, last + 1):
            seen = counts[k - 1] > 0
            n, suffix = int(seen.sum()), np.zeros(len(seen), np.int64)
            if k > 1:
                at = tokens.at[k - 1]
                place = np.zeros(len(seen), np.int64)
                place[which[k - 1][at]] = at  # where one of its occurrences ends
                suffix = which[k - 2][place]
                of = np.where(tokens.step[place - 1] == 0, texts, counts[k - 2][which[k - 2][place - 1]])
                p = (counts[k - 1] + prior * p[suffix]) / (of + prior)
            state = np.where(seen, states + np.cumsum(seen) - 1, ROOT)
            target = shorter[suffix] if k > 1 else np.zeros(len(seen), np.int64)
            arc = np.full(len(tokens.step), -1, np.int64)
            index = np.where(seen, arcs + np.cumsum(seen) - 1, -1)
            arc[tokens.at[k - 1]] = index[which[k - 1][tokens.at[k - 1]]]
            self.arc.append(arc)
            weight.append(grained(p[seen]))
            to.append((state if k < last else target)[seen])
            arcs += n
            if k < last:
                held.append(counts[k - 1][seen])
                fail.append(target[seen])
                length.append(np.full(n, k))
                states += n
                shorter = state
        self.weight, self.to = np.concatenate(weight), np.concatenate(to)
        self.fail, self.length = np.concatenate(fail), np.concatenate(length)
        self.loss = grained(prior / (np.concatenate(held) + prior))
        self.loss[ROOT] = unknown  # at the root an unknown token is read by the failure itself

    def read(self) -> np.ndarray:
        """The weight of each text."""
        first, size = self.tokens.first[:-1] + 1, self.tokens.size - 1
        order = np.argsort(-size, kind="stable")
        begin, ends, total, state = first[order], size[order], np.zeros(len(order)), np.full(len(order), self.begin)
        table, wide = np.stack(self.arc).ravel(), len(self.arc[0])
        step = 0
        while step < (ends[0] if len(ends) else 0):
            n = int(np.searchsorted(-ends, -step, "left"))  # texts that have this token
            if n < FEW:
                break
            left = np.arange(n)
            while len(left):
                s = state[left]
                a = table[self.length[s] * wide + begin[left] + step]
                hit = a >= 0
                took, missed, s = left[hit], left[~hit], s[~hit]
                total[took] += self.weight[a[hit]]
                state[took] = self.to[a[hit]]
                total[missed] += self.loss[s]
                state[missed] = self.fail[s]
                left = missed[s != ROOT]
            step += 1
        rest = int(np.searchsorted(-ends, -step, "left"))
        if rest:
            weight, to, fail, length, loss = (x.tolist() for x in (self.weight, self.to, self.fail, self.length, self.loss))
            for k in range(rest):
                s, sum_ = int(state[k]), float(total[k])
                for arcs in zip(*(x[begin[k] + step : begin[k] + ends[k]].tolist() for x in self.arc), strict=True):
                    while (a := arcs[length[s]]) < 0:
                        sum_ += loss[s]
                        if s == ROOT:
                            break
                        s = fail[s]
                    else:
                        sum_ += weight[a]
                        s = to[a]
                total[k] = sum_
        out = np.zeros(len(order))
        out[order] = total
        return out


def backoff_scores(docs: DataFrame, order: int = 3, prior: float = 50.0, fold: int = 5, held: int = 1, block_bytes: int = 5 << 20, shard_keys: int = 1 << 21) -> DataFrame:
    """log10 probability of each text under a model learned from all documents outside the held-out fold.

    Tokens are lower-cased words and one end; a document is held out if crc32(doc_id as text) mod `fold` is `held`.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-half unigrams) and score, a row for each
    input row; a token's weights are rounded to multiples of GRAIN. Null and empty texts are the end token alone. Rows without
    doc_id are held out. Repeated rows count as often as they stand. Without any training text every token is unknown:
    base_score and score then come from counts of zero. N-grams of two and more tokens are told apart by a hash of 40 bits in
    a shard; a shard holds some shard_keys of them, so that one in a million shares its count with another.
    """
    if not 1 <= order <= 8:
        raise ValueError("order must be from 1 to 8")
    _, total = X.volume(docs)
    blocks, _ = X.hashed_blocks(docs, total, block_bytes)
    n = max(1, math.ceil(order * total / 8 / shard_keys))

    def width(k: int) -> int:
        return 5 if k else 8

    def held_out(table: pa.Table) -> np.ndarray:
        return np.array([i is None or zlib.crc32(str(i).encode()) % fold == held for i in table.column(X.DOC).to_pylist()], bool)

    def ask(b: int, table: pa.Table) -> pa.Table:
        tokens = _Tokens(Texts.of(table.column(X.TEXT)), order)
        train = np.repeat(~held_out(table), tokens.size)
        parts: list[list[bytes]] = [[] for _ in range(n)]
        for k, (at, grams) in enumerate(zip(tokens.at, tokens.grams, strict=True)):
            keys = X.Keys(grams, n, width(k))
            counts = np.bincount(keys.inverse, train[at], len(keys.sorted)).astype(np.int64)
            for s in range(n):
                i, j = keys.edges[s], keys.edges[s + 1]
                parts[s] += [np.int64(j - i).tobytes(), keys.body(s), X.packed_counts(counts[i:j])]
        return X.asks([(s, b, pack(b"".join(p))) for s, p in enumerate(parts)])

    def count(rows: list[tuple[int, bytes]]) -> list[bytes]:
        place, out = [0] * len(rows), [[] for _ in rows]
        bodies = [unpack(body) for _, body in rows]
        for k in range(order):
            keys, counts = [], []
            for r, body in enumerate(bodies):
                m = int(np.frombuffer(body, np.int64, 1, place[r])[0])
                keys.append(X.unpacked(body, m, width(k), place[r] + 8))
                c, place[r] = X.unpacked_counts(body, m, place[r] + 8 + width(k) * m)
                counts.append(c)
            distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            sums = np.bincount(inverse, np.concatenate(counts), len(distinct)).astype(np.int64)
            if k == 0:
                head = np.array([sums.sum(), np.count_nonzero(sums)], np.int64).tobytes()
                out = [[head] for _ in rows]
            for r, x in enumerate(np.split(sums[inverse], np.cumsum([len(p) for p in keys])[:-1])):
                out[r].append(X.packed_counts(x))
        return [pack(b"".join(x)) for x in out]

    def walk(b: int, table: pa.Table, got: dict[int, bytes]) -> pa.Table:
        tokens = _Tokens(Texts.of(table.column(X.TEXT)), order)
        got = {s: unpack(x) for s, x in got.items()}
        head = np.array([np.frombuffer(x, np.int64, 2) for x in got.values()])
        n_train, n_words = (head.sum(axis=0) if len(head) else np.zeros(2)).astype(np.int64).tolist()
        place, which, counts = dict.fromkeys(got, 16), [], []
        for k, (at, grams) in enumerate(zip(tokens.at, tokens.grams, strict=True)):
            keys = X.Keys(grams, n, width(k))
            sizes = np.diff(keys.edges)
            c = np.zeros(len(keys.sorted), np.int64)
            for s, x in got.items():
                c[keys.edges[s] : keys.edges[s + 1]], place[s] = X.unpacked_counts(x, int(sizes[s]), place[s])
            index = np.full(len(tokens.step), -1, np.int64)
            index[at] = keys.inverse
            which.append(index)
            counts.append(c)
        texts, real = len(tokens.size), tokens.step >= 1
        if texts:
            automaton = Automaton(tokens, which, counts, prior, n_train, n_words)
            score = automaton.read()
            sums = lambda x: np.add.reduceat(np.where(real, x, 0), tokens.first[:-1])
            base, known = sums(automaton.base[which[0]]), sums(counts[0][which[0]] > 0).astype(np.int64)
        else:
            score, base, known = np.zeros(0), np.zeros(0), np.zeros(0, np.int64)
        return pa.table({"doc_id": table.column(X.DOC), "held_out": pa.array(held_out(table)), "n_tokens": pa.array(tokens.size - 1, pa.int64()), "n_known": pa.array(known), "train_tokens": pa.array(np.full(texts, n_train, np.int64)), "base_score": pa.array(base), "score": pa.array(score)})

    answers = X.serve(X.by_block(blocks, ask, X.ASK), n, count)
    return X.with_answers(blocks, answers, walk, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
