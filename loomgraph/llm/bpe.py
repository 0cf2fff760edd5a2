"""Byte-level BPE encoding and decoding.

Bytes are read as Latin-1 characters, so that an Aho-Corasick automaton over the
vocabulary finds, in one pass, the longest token from each position on. Encoding
goes from left to right with the longest token that may stand beside the one
before it; where none may, it steps back and shortens. Two tokens may be
neighbours if undoing their merges meets no earlier merge across the seam; that
answer is remembered. Positions that proved dead are not tried again, so the work
is linear, and the result is the one that the merges give.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._exchange import tidy

#: White space as the Unicode property has it; regex's \s also takes U+001C to U+001F.
WHITE = r"\t-\r\x20\x85\xa0  -     　"


#: Texts with these need the careful pattern; for others the two agree and the plain one is faster.
ODD = regex.compile("[\x1c-\x1f]")


def splitter(pattern: str) -> regex.Pattern:
    return regex.compile(pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]"))


class Bpe:
    """ranks: the vocabulary; a token's id is its rank. Pieces and neighbours seen are kept in tables of bounded size."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, pieces: int = 120_000, neighbours: int = 200_000):
        self.ranks, self.careful, self.plain = ranks, splitter(pattern), regex.compile(pattern)
        self.token = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.token[r] = t
        self.size = list(map(len, self.token))
        self.flat = np.frombuffer(b"".join(self.token), np.uint8)
        self.length = np.array(self.size, np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.pair: dict[tuple[int, int], int] = {}
        self.halves: list[tuple[int, int]] = [(i, i) for i in range(len(self.token))]
        self.verdict: dict[tuple[int, int], bool] = {}
        self.most_pieces, self.most_neighbours = pieces, neighbours
        self.shorter = [-1] * len(self.token)
        self.words = ahocorasick.Automaton()
        for r, t in enumerate(self.token):
            if not t:
                continue
            made = len(t) == 1
            for cut in range(len(t) - 1, 0, -1):
                a = ranks.get(t[:cut])
                if a is None:
                    continue
                if self.shorter[r] < 0:
                    self.shorter[r] = a
                b = ranks.get(t[cut:])
                if not made and b is not None and a < r and b < r and self._may_stand(a, b):
                    self.pair[a, b], self.halves[r], made = r, (a, b), True
            if made:  # a token that no merges make can only be a whole piece
                self.words.add_word(t.decode("latin-1"), r)
        self.words.make_automaton()
        self.seen = _Pieces(self)

    def _may_stand(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b leaves exactly these two tokens."""
        most = len(self.token)
        while True:
            if self.pair.get((a, b), most) < most:
                return False
            # Undo the later of the two merges; both sides whole again down to bytes means no merge could cross.
            for left in (a > b, a <= b):
                t = a if left else b
                x, y = self.halves[t]
                if x != y or self.size[t] > 1:
                    if left:
                        most, a = t, y
                    else:
                        most, b = t + 1, x
                    break
            else:
                return True

    def forget(self) -> None:
        self.seen.clear()
        self.verdict.clear()

    def neighbours(self, a: int, b: int) -> bool:
        known = self.verdict.get((a, b))
        if known is None:
            if len(self.verdict) >= self.most_neighbours:
                self.verdict.clear()
            known = self.verdict[a, b] = self._may_stand(a, b)
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n, size, shorter = len(piece), self.size, self.shorter
        longest = [-1] * n
        for end, t in self.words.iter(piece.decode("latin-1")):
            longest[end + 1 - size[t]] = t
        dead = bytearray(n + 1)
        out: list[int] = []
        at, t = 0, longest[0]
        while at < n:
            while t >= 0:
                if not dead[at + size[t]] and (not out or self.neighbours(out[-1], t)):
                    break
                t = shorter[t]
            if t >= 0:
                out.append(t)
                at += size[t]
                t = longest[at] if at < n else -1
            else:
                dead[at] = 1
                t = out.pop()
                at -= size[t]
        return out

    def encode(self, text: str) -> np.ndarray:
        split = self.careful if ODD.search(text) else self.plain
        return np.frombuffer(b"".join(map(self.seen.__getitem__, split.findall(text))), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        length = self.length[ids]
        ends = np.cumsum(length)
        return self.flat[np.repeat(self.start[ids] - ends + length, length) + np.arange(int(length.sum()))].tobytes()


class _Pieces(dict):
    """Pieces of text with their ids as bytes."""

    def __init__(self, bpe: Bpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, piece: str) -> bytes:
        ids = array("I", self.bpe.encode_piece(piece.encode())).tobytes()
        if len(piece) <= 48:
            if len(self) >= self.bpe.most_pieces:
                self.clear()
            self[piece] = ids
        return ids


def read_ranks(blob: bytes) -> dict[bytes, int]:
    return {base64.b64decode(t): int(r) for t, r in (line.split() for line in blob.splitlines() if line)}


@lru_cache(1)
def _loaded(blob: bytes, pattern: str) -> Bpe:
    return Bpe(read_ranks(blob), pattern)


def bpe_round_trip(docs: DataFrame, ranks_file: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Each text's token ids, and what they decode to.

    Returns doc_id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers), decoded_sha256 and, if asked for,
    ids, a row for each input row. Null and empty texts have no tokens. Special tokens are ordinary text. The vocabulary, a
    file of fixed size, is read by the driver and broadcast. Other columns are ignored.
    """
    with open(ranks_file, "rb") as f:
        blob = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        bpe = _loaded(blob.value, pattern)
        yield from encoded(bpe, batches)
        bpe.forget()  # the vocabulary stays for the worker's next task, what was seen in this one goes

    def encoded(bpe, batches):
        for batch in batches:
            n, ids_sha, text_sha, flat = [], [], [], []
            for text in batch.column(1):
                ids = bpe.encode(text.as_py() or "")
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(ids.tobytes()).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                if with_ids:
                    flat.append(ids.astype(np.int32))
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(flat, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
