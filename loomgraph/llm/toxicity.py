"""Toxicity by a weighted finite-state grammar over clauses.

A lexical transducer reads a word's letters and writes its class: insult, threat,
target, negation, reported speech or other. Machines for negation, reported
speech, targets, insults and threats, each of which reads what the one before it
writes, are composed into one, which reads classes and writes, at
the end of each clause, what the clause does: insults or threatens a target, or
nobody in particular, denies it, or reports it. A text's score is a logistic
function of its weighted clauses.

Fixed word lists give targets, negations, reporting verbs, threats and some
insults; further insults are learned as stems, with their log odds, from labelled
texts, and so are the weights of the kinds of clause.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _exchange as X
from ._bytes import LOWER, Texts, Words, mix, powers, prefix_sums

OTHER, TARGET, NEGATION, REPORT, INSULT, THREAT, END = range(7)
WORDS = {
    TARGET: "you your yours yourself he she they them him her his their we us people everyone this that du dich dir euch sie er ihr tu toi vous ils elles il elle lui vosotros ustedes ellos ellas te usted",
    NEGATION: "not no never isn aren wasn weren don doesn didn won nicht kein keine keinen nie niemals ne pas jamais aucun nunca jamás tampoco",
    REPORT: "said says say saying called calls wrote writes quoted reported claimed sagte sagt schrieb berichtete dit disait écrit dijo dice escribió según",
    THREAT: "kill hurt destroy beat punish töten schlagen vernichten tuer frapper détruire matar golpear destruir",
    INSULT: "idiot stupid moron loser scum trash pathetic worthless disgusting clown dumb jerk dumm trottel abschaum connard imbécile ordure estúpido imbécil basura",
}
LETTERS = np.ones(256, bool)  # separators: all of ASCII but letters
LETTERS[128:] = LETTERS[65:91] = LETTERS[97:123] = False
STOPS = np.zeros(256, bool)
STOPS[[10, 33, 46, 59, 63]] = True  # \n ! . ; ?
#: Kinds of clause that the composed machine writes.
KINDS = ("insult", "insult at target", "denied", "reported", "threat", "threat at target")
STEMS = range(3, 13)


class Machine:
    """A sequential transducer: step(state, symbol) -> (state, symbol written), from `start`."""

    def __init__(self, start, step):
        self.start, self.step = start, step

    def __rshift__(self, then: Machine) -> Machine:
        """Composition: what this one writes, the next one reads."""

        def step(state, symbol):
            a, out = self.step(state[0], symbol)
            b, out = then.step(state[1], out)
            return (a, b), out

        return Machine((self.start, then.start), step)

    def table(self, symbols) -> tuple[np.ndarray, list[list]]:
        """The reachable states as arrays: the next state, and what is written."""
        index, todo, to, out = {self.start: 0}, [self.start], [], []
        for state in todo:
            row, written = [], []
            for s in symbols:
                nxt, w = self.step(state, s)
                if nxt not in index:
                    index[nxt] = len(todo)
                    todo.append(nxt)
                row.append(index[nxt])
                written.append(w)
            to.append(row)
            out.append(written)
        return np.array(to), out


def negation(reach: int = 3) -> Machine:
    """Marks insults and threats up to `reach` words after a negation."""

    def step(left, symbol):
        if symbol == END:
            return 0, END
        if symbol == NEGATION:
            return reach, OTHER
        if left and symbol in (INSULT, THREAT):
            return left - 1, ("denied",)
        return max(0, left - 1), symbol

    return Machine(0, step)


def reported() -> Machine:
    """Marks insults and threats after a reporting verb in the same clause."""

    def step(open_, symbol):
        if symbol == END:
            return False, END
        if symbol == REPORT:
            return True, OTHER
        if open_ and symbol in (INSULT, THREAT):
            return True, ("reported",)
        return open_, symbol

    return Machine(False, step)


def target() -> Machine:
    """Takes targets out and says at the end of a clause whether it had one."""

    def step(aimed, symbol):
        if symbol == END:
            return False, (END, aimed)
        return (True, OTHER) if symbol == TARGET else (aimed, symbol)

    return Machine(False, step)


def insult() -> Machine:
    """Takes insults out, marked ones too, and adds the gravest of them to the end of the clause."""
    grave = {("denied",): 1, ("reported",): 2, INSULT: 3}

    def step(worst, symbol):
        if isinstance(symbol, tuple) and symbol[0] == END:
            return 0, (*symbol, worst)
        return (max(worst, grave[symbol]), OTHER) if symbol in grave else (worst, symbol)

    return Machine(0, step)


def threat() -> Machine:
    """Takes threats out and writes at the end of a clause its kind, or None."""

    def step(seen, symbol):
        if isinstance(symbol, tuple) and symbol[0] == END:
            _, aimed, worst = symbol
            return False, (5 if aimed else 4) if seen else (None, 2, 3, 1 if aimed else 0)[worst]
        return seen or symbol == THREAT, None

    return Machine(False, step)


GRAMMAR = negation() >> reported() >> target() >> insult() >> threat()
_TO, _OUT = GRAMMAR.table(range(7))
_KIND = np.array([[-1 if x is None else x for x in row] for row in _OUT])


def _hash(word: bytes) -> int:
    return int(Words(Texts(np.frombuffer(word, np.uint8), np.array([0, len(word)])), LETTERS, True).hashes()[0])


@dataclass
class Grammar:
    """stems: insult stems (lower-case UTF-8) with weights; weight: of the features, the constant first."""

    stems: dict[bytes, float] = field(default_factory=dict)
    weight: np.ndarray = field(default_factory=lambda: np.array([-3.0, 1.5, 2.5, 0.2, 0.4, 1.0, 2.5, 0.5, 0.3]))

    def __post_init__(self):
        found = {_hash(w.encode()): c for c, ws in WORDS.items() for w in ws.split()}
        self.known = np.array(sorted(found), np.uint64)
        self.known_class = np.array([found[int(h)] for h in self.known])
        self.by_size = {}
        for n in sorted({len(s) for s in self.stems}):
            at = {_hash(s): w for s, w in self.stems.items() if len(s) == n}
            keys = np.array(sorted(at), np.uint64)
            self.by_size[n] = keys, np.array([at[int(h)] for h in keys])

    def classes(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Class and insult weight of each word."""
        total, inverse = prefix_sums(w.buf), powers(len(w.buf) + 1)[1]
        size = w.end - w.start
        out, weight = np.zeros(len(w), np.int64), np.zeros(len(w))
        short = np.flatnonzero(size <= 16)
        h = mix((total[w.end[short]] - total[w.start[short]]) * inverse[w.start[short]])
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        hit = self.known[at] == h
        out[short[hit]] = self.known_class[at[hit]]
        weight[out == INSULT] = 1
        for n, (keys, values) in self.by_size.items():
            long = np.flatnonzero(size >= n)
            a = w.start[long]
            h = mix((total[a + n] - total[a]) * inverse[a])
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[at] == h
            out[long[hit]] = INSULT
            weight[long[hit]] = np.maximum(weight[long[hit]], values[at[hit]])
        return out, weight

    def features(self, texts: Texts) -> np.ndarray:
        """One row for each text: 1, log counts of each kind of clause, the weight of open insults, and their share."""
        out = np.zeros((len(texts), 3 + len(KINDS)))
        out[:, 0] = 1
        for a, _, t in texts.chunks():
            w = Words(t, LETTERS, True)
            if not len(w):
                continue
            cls, weight = self.classes(w)
            stop = np.cumsum(STOPS[t.buf])
            doc = w.doc()
            sentence = stop[w.start]
            new = np.concatenate([[True], (sentence[1:] != sentence[:-1]) | (doc[1:] != doc[:-1])])
            number = np.cumsum(new) - 1
            first = np.append(np.flatnonzero(new), len(w))
            hot = np.unique(number[(cls == INSULT) | (cls == THREAT)])
            counts = np.zeros((len(t), len(KINDS)))
            for k in hot.tolist():
                i, j = first[k], first[k + 1]
                state = 0
                for c in cls[i:j].tolist():
                    state = _TO[state, c]
                kind = _KIND[state, END]
                if kind >= 0:
                    counts[doc[i], kind] += 1
                    if kind not in (2, 3):
                        out[a + doc[i], -2] += weight[i:j].sum()
            out[a : a + len(t), 1 : 1 + len(KINDS)] = np.log1p(counts)
            out[a : a + len(t), -1] = out[a : a + len(t), -2] / np.sqrt(np.maximum(w.count, 1))
        out[:, -2] = np.log1p(out[:, -2])
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weight, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    w = np.zeros(x.shape[1])
    pull = ridge * np.eye(len(w))
    pull[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull, x.T @ (y - p) - pull @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _stems_of(batches):
    """stem, texts labelled 1 and 0 that have a word with it; whole words end in a blank."""
    for batch in batches:
        counts = (Counter(), Counter())
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            buf = LOWER[np.frombuffer((text or "").encode(), np.uint8)]
            w = Words(Texts(buf, np.array([0, len(buf)])), LETTERS)
            whole = buf.tobytes()
            words = {whole[a:b] for a, b in zip(w.start.tolist(), w.end.tolist(), strict=True)}
            counts[int(bool(label))].update({word[:n] for word in words for n in STEMS if n <= len(word)})
        keys = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([counts[1][k] for k in keys], pa.int64()), pa.array([counts[0][k] for k in keys], pa.int64())], names=["stem", "bad", "good"])


def fit_grammar(docs: DataFrame, labels: DataFrame, sample: int = 4000, support: int = 5, precise: float = 0.8, most_stems: int = 2000) -> Grammar:
    """A grammar learned from at most `sample` labelled documents of each class, those with the least hash of the id.

    A stem is an insult if at least `support` distinct texts labelled 1 have it and it is `precise`; of stems that begin
    alike the shortest is taken, lengthened while nearly all texts with it share the next letter. Without texts of both
    classes the fixed word lists and weights remain.
    """
    of = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("label"))
    parts = [of.where(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for v in (0, 1)]
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").join(F.broadcast(parts[0].unionByName(parts[1])), "doc_id")
    chosen = X.settle(chosen.groupBy(F.xxhash64("text").alias("h"), F.length("text").alias("n")).agg(F.first("text").alias("text"), F.max("label").alias("label")).select("text", "label"))
    table = chosen.mapInArrow(X.tidy(_stems_of), "stem binary, bad long, good long").groupBy("stem").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    rows = table.where((F.col("bad") >= support) & (F.col("bad") >= precise * (F.col("bad") + F.col("good") + 1))).orderBy(F.desc("bad"), "stem").limit(20 * most_stems).collect()
    seen = {bytes(r.stem): (r.bad, r.good) for r in rows}
    stems: dict[bytes, float] = {}
    for s in sorted(seen, key=lambda s: (len(s), s)):
        if any(s[:n] in seen for n in range(min(STEMS), len(s))):
            continue
        t = s
        while longer := [u for u in seen if len(u) == len(t) + 1 and u.startswith(t) and seen[u][0] >= 0.95 * seen[s][0]]:
            t = longer[0]
        bad, good = seen[t]
        if len(stems) < most_stems:
            stems[t] = math.log((bad + 0.5) / (good + 0.5))
    grammar = Grammar(stems)

    def rows_of(batches):
        for batch in batches:
            x = grammar.features(Texts.of(batch.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column(1).cast(pa.int32())], names=["x", "label"])

    got = chosen.mapInArrow(X.tidy(rows_of), "x array<double>, label int").collect()
    y = np.array([r.label > 0 for r in got], float)
    if 0 < y.sum() < len(y):
        grammar.weight = logistic(np.array([r.x for r in got]), y)
    return grammar


def toxicity_scores(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 if score >= 0.5), a row for each input row.

    Null and empty texts have no clauses and get the grammar's constant. Other columns are ignored.
    """

    def run(batches):
        for batch in batches:
            score = grammar.score(grammar.features(Texts.of(batch.column(1))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(X.tidy(run), "doc_id long, score double, predicted int")


def without_toxic(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """The rows of docs whose text scores below 0.5, with all their columns."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(grammar.score(grammar.features(Texts.of(batch.column(at)))) < 0.5))

    return docs.mapInArrow(X.tidy(run), docs.schema)
