"""Quality rules, lines first.

Each line that has a word is judged: by its punctuation (symbols, runs of ! and
?), as navigation (menus and trails of short entries, lines of links) and as
boilerplate (a line that the text has already had, a short line with a phrase of a
list, which is a parameter). Lines that fail are removed, and a document that
loses too much of its text, or fails the base rules on words, is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import LOWER, Texts, Words, mix, powers, prefix_sums
from ._exchange import tidy

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
LOUD = np.zeros(256, bool)
LOUD[list(b"!?")] = True
#: Phrases of licence, notice and consent lines.
BOILERPLATE = ("all rights reserved", "licensed under the", "released under the", "this work is licensed", "terms of use", "terms of service", "privacy policy", "cookie policy", "we use cookies", "enable javascript", "copyright (c)", "©", "redistribution and use in source", "permission is hereby granted")
#: What stands between the entries of a menu or a trail, and what a link begins with or has inside.
SEPARATORS = ("|", ">", "»", "·", "•")
LINKS = ("://", "www.")


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    repeat_per_cent: int = 50
    #: Of the words of a line: symbols, and runs of ! or ?, that a line may have.
    symbols_per_word: float = 0.3
    loud_per_word: float = 0.3
    #: Navigation and boilerplate lines are short.
    boilerplate_words: int = 30
    #: A menu has so many separators at least, and so many words for each entry at most.
    menu_separators: int = 2
    menu_words: int = 3
    #: Of the words of a line, the per cent that are links above which it fails.
    link_per_cent: int = 50
    boilerplate: tuple[str, ...] = BOILERPLATE
    #: Of a document's words, the share in failed lines above which it is rejected.
    lost_per_cent: int = 50


def _per(doc: np.ndarray, values, n: int) -> np.ndarray:
    return np.bincount(doc, values, n).astype(np.int64)


def _same_earlier(keys: np.ndarray) -> np.ndarray:
    """Whether an equal key comes earlier."""
    out = np.ones(len(keys), bool)
    out[np.unique(keys, return_index=True)[1]] = False
    return out


def _phrases(text: bytes, phrases: tuple[str, ...]) -> np.ndarray:
    at = []
    for p in phrases:
        b, k = p.encode(), -1
        while (k := text.find(b, k + 1)) >= 0:
            at.append(k)
    return np.array(at, np.int64)


def measure(texts: Texts, rules: Rules) -> dict[str, np.ndarray]:
    """The base counts of each text, and of its words those in failed lines; `failed_lines`: byte spans that are removed."""
    n, buf = len(texts), texts.buf
    w = Words(texts)
    doc, h = w.doc(), w.hashes()
    out = {"n_words": w.count.astype(np.int64)}
    inside = np.zeros(len(buf) + 1, np.int64)
    inside[1:] = np.cumsum((buf & 0xC0) != 0x80)
    out["word_chars"] = _per(doc, inside[w.end] - inside[w.start], n)
    totals = lambda mask: np.concatenate([[0], np.cumsum(mask)])
    symbols = totals(SYMBOLS[buf])
    out["n_symbols"] = symbols[texts.offs[1:]] - symbols[texts.offs[:-1]]
    # words in windows of three that the text has twice
    g, ok = w.windows(h, 3, 3)
    at = np.flatnonzero(ok)
    _, inverse, counts = np.unique(mix(g[at] ^ mix(doc[at].astype(np.uint64), 9), 2), return_inverse=True, return_counts=True)
    twice = np.zeros(len(h) + 3, np.int64)
    start = at[(counts > 1)[inverse]]
    np.add.at(twice, start, 1)
    np.add.at(twice, start + 3, -1)
    out["n_repeat_words"] = _per(doc[np.cumsum(twice)[: len(h)] > 0], None, n)
    # lines: by the number of line ends before each word
    ends = totals(buf == 10)
    line = ends[w.start]
    new = np.ones(len(line), bool)
    new[1:] = (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    words = np.diff(np.append(first, len(line)))
    owner = doc[first]
    cuts = np.unique(np.concatenate([texts.offs, np.flatnonzero(buf == 10) + 1]))
    a = cuts[np.searchsorted(cuts, w.start[first], "right") - 1]
    last = np.append(first[1:], len(line)) - 1
    nl = np.append(np.flatnonzero(buf == 10), len(buf))
    z = np.minimum(nl[np.searchsorted(nl, w.end[last] - 1, "left")], texts.offs[1:][owner])
    total, back = prefix_sums(buf), powers(len(buf) + 1)[1]
    whole = mix((total[z] - total[a]) * back[a]) + mix((z - a).astype(np.uint64), 4)
    again = _same_earlier(mix(whole ^ mix(owner.astype(np.uint64), 9), 6))
    out["n_dup_lines"] = _per(owner[again], None, n)
    # rules on lines
    loud = LOUD[buf]
    runs = loud.copy()
    if len(buf):
        runs[1:] &= loud[:-1]
        runs[0] = False
    runs = totals(runs)
    failed = (symbols[z] - symbols[a] > rules.symbols_per_word * words) | (runs[z] - runs[a] > rules.loud_per_word * words)
    low = LOWER[buf].tobytes()
    within = lambda at: np.searchsorted(at, z) - np.searchsorted(at, a)
    few = words <= rules.boilerplate_words
    failed |= few & (within(np.sort(_phrases(low, rules.boilerplate))) > 0)
    marks = within(np.sort(_phrases(low, SEPARATORS)))
    failed |= few & (marks >= rules.menu_separators) & (words <= rules.menu_words * (marks + 1))
    at = _phrases(low, LINKS)
    linked = np.unique(np.searchsorted(w.start, at, "right") - 1) if len(w) else np.zeros(0, np.int64)
    links = np.bincount(np.searchsorted(first, linked, "right") - 1, minlength=len(first)) if len(linked) else np.zeros(len(first), np.int64)
    failed |= 100 * links > rules.link_per_cent * words
    failed |= again
    out["lost_words"] = _per(owner[failed], words[failed], n)
    out["failed_lines"] = np.stack([a[failed], z[failed]], axis=1)
    return out


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, lost_words long"


def quality_rules(docs: DataFrame, rules: Rules = Rules(), with_text: bool = False) -> DataFrame:
    """Base counts, base_failed, lost_words and kept of each text; with_text adds `cleaned`, the text without failed lines.

    A row for each input row. Null and empty texts have no words and fail the base rules. Lines without a word are never
    judged; equal lines after the first of a text fail. Other columns are ignored.
    """

    def run(batches):
        for batch in batches:
            texts = Texts.of(batch.column(1))
            for i, j, t in texts.chunks():
                m = measure(t, rules)
                bad = (m["n_words"] < rules.min_words) | (100 * m["n_repeat_words"] > rules.repeat_per_cent * m["n_words"])
                kept = ~bad & (100 * m["lost_words"] <= rules.lost_per_cent * m["n_words"])
                columns = [batch.column(0).slice(i, j - i), *(pa.array(m[k], pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), pa.array(bad), pa.array(kept), pa.array(m["lost_words"])]
                names = [x.split()[0] for x in SCHEMA.split(", ")]
                if with_text:
                    keep = np.ones(len(t.buf), bool)
                    for a, z in m["failed_lines"].tolist():
                        keep[a : z + 1 if z < len(t.buf) and t.buf[z] == 10 else z] = False
                    edges = t.offs.tolist()
                    columns.append(pa.array([t.buf[a:z][keep[a:z]].tobytes() for a, z in zip(edges[:-1], edges[1:], strict=True)], pa.binary()).cast(pa.string()))
                    names.append("cleaned")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(tidy(run), SCHEMA + ", cleaned string" * with_text)
