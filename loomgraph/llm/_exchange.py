"""Blocks and shards: lookups of packed keys between documents and all others.

Documents are dealt into *blocks* of bounded size. A block sends each distinct
key once, packed as numbers in one row for each *shard* of the key space; a
shard sees the keys of all blocks and answers each block in the order asked.
So a key that a third of all documents hold costs one number for each block,
and what crosses the network is a few bytes a key instead of a row.
"""

from __future__ import annotations

import ctypes
import functools
import gc
import math
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _bytes

U64 = np.uint64
ASK = "shard int, block int, body binary"
#: Columns of a block's rows; callers' own columns never reach them.
DOC, TEXT, BLOCK, CARRY = "doc_id", "text", "__block", "__carry"


#: What to call when a task ends: each empties a table that its module keeps between calls.
FORGET: list[Callable[[], None]] = [_bytes.forget]


@functools.cache
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:  # another C library has no malloc_trim either
        return None


def release() -> None:
    """Hands freed memory back to the system. Python workers outlive their tasks, and several wait beside each executor."""
    pa.default_memory_pool().release_unused()
    if _libc() is not None:
        _libc().malloc_trim(0)


def tidy(f: Callable) -> Callable:
    """f, a function of a task's batches, that leaves no tables and no freed memory behind in its worker."""

    def run(batches):
        try:
            yield from f(batches)
        finally:
            for g in FORGET:
                g()
            gc.collect()
            release()

    return run


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names. Where none is set, as in tests, one of our own, but never on a cluster: other
    machines do not see it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="loomgraph-checkpoint-"))
    return sc.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def volume(docs: DataFrame, text: str = TEXT) -> tuple[int, int]:
    """(rows, bytes of text), by one scan."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text)).alias("b")).first()
    return row.n or 0, int(row.b or 0)


def _dealt(placed: DataFrame, n: int) -> DataFrame:
    return placed.repartition(min(n, 4 * partitions(placed.sparkSession)) if n > 1 else 1, BLOCK)


def hashed_blocks(docs: DataFrame, total: int, block_bytes: int) -> tuple[DataFrame, int]:
    """(block, doc_id, text): blocks of about block_bytes by a hash of the row. Rows alike share a block."""
    n = max(1, math.ceil(total / block_bytes))
    key = F.pmod(F.xxhash64(DOC, TEXT), F.lit(n)).cast("int")
    return _dealt(docs.select(key.alias(BLOCK), F.col(DOC).cast("long").alias(DOC), TEXT), n), n


def _place(bounds: np.ndarray):
    """A column function: how many of the sorted bounds lie below a number; null: -1."""

    @F.pandas_udf(T.IntegerType())
    def place(s):
        out = np.searchsorted(bounds, s.fillna(0).to_numpy().astype(np.int64), "left")
        return __import__("pandas").Series(np.where(s.notna().to_numpy(), out, -1)).astype("int32")

    return place


def block_bounds(ids: DataFrame, block_bytes: int) -> np.ndarray:
    """The last id of each block but the last one: blocks in the order of ids, of about block_bytes of text each.

    Bytes are summed over ranges of ids, some four for each block, and ranges that hold more than a block are divided again
    until none does or it is a single id, whose rows stay together. The driver sees one number for each range.
    """
    size = F.coalesce(F.octet_length(TEXT), F.lit(0))
    whole = ids.where(F.col(DOC).isNotNull()).agg(F.min(DOC).alias("lo"), F.max(DOC).alias("hi"), F.sum(size).alias("bytes")).first()
    if whole.lo is None or whole.bytes <= block_bytes:
        return np.zeros(0, np.int64)
    # cells: [first, last] with their bytes; Python's integers, as a range of ids can exceed 2**63
    light, heavy = [], [(whole.lo, whole.hi, whole.bytes)]
    while heavy:
        ends, firsts = [], []
        for a, b, n in heavy:
            k = min(b - a + 1, max(2, math.ceil(4 * n / block_bytes)))
            cuts = [a + (b - a + 1) * i // k for i in range(k + 1)]
            firsts += cuts[:-1]
            ends += [c - 1 for c in cuts[1:]]
        # ids between two heavy ranges belong to light ones: ranges without end there take them and are passed over
        marks = np.unique(np.array([x for a, b in zip(firsts, ends, strict=True) for x in (a - 1, b) if x >= -(2**63)], np.int64))
        at = ids.where(F.col(DOC).isNotNull()).select(_place(marks)(DOC).alias("cell"), size.alias("size")).groupBy("cell").agg(F.sum("size").alias("bytes"))
        by_mark = {int(marks[r.cell]): r.bytes for r in at.collect() if 0 <= r.cell < len(marks)}
        cells = [(a, b, by_mark.get(b, 0)) for a, b in zip(firsts, ends, strict=True)]
        heavy = [c for c in cells if c[2] > block_bytes and c[1] > c[0]]
        light += [c for c in cells if not (c[2] > block_bytes and c[1] > c[0])]
    bounds, held = [], 0
    for a, _, n in sorted(light):
        if held and held + n > block_bytes:
            bounds.append(a - 1)
            held = 0
        held += n
    return np.array(bounds, np.int64)


def ordered_blocks(docs: DataFrame, total: int, block_bytes: int, carry: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """(block, doc_id, text, and what is to be carried along as one column): all ids of a block are smaller than those of the next one.

    Blocks are cut by bytes of text (see block_bounds). Rows without an id get blocks of their own, below 0.
    """
    ids = docs.select(F.col(DOC).cast("long").alias(DOC), TEXT, *([F.struct(*[F.col(f"`{c}`") for c in carry]).alias(CARRY)] if carry else []))
    n = max(1, math.ceil(total / block_bytes))
    bounds = block_bounds(ids, block_bytes)
    placed = ids.withColumn(BLOCK, F.when(F.col(DOC).isNull(), -1 - F.pmod(F.xxhash64(TEXT), F.lit(n)).cast("int")).otherwise(_place(bounds)(DOC)))
    return _dealt(placed.select(BLOCK, DOC, TEXT, *([CARRY] if carry else [])), n), n


def shard_of(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> U64(40)) * U64(n) >> U64(24)).astype(np.int64)


class Keys:
    """The distinct keys of a block in the order in which it asks: by shard, then by the bytes that are sent.

    width: bytes sent, below 8 the low ones; the shard stands for the high ones. Four serve where an answer only proposes
    candidates; with five, one key in some 10**6 of a shard of 2**20 meets another. Shards too many for that are an error.
    Bytes go plane by plane: the high ones of sorted keys are runs, which the shuffle's compression takes out.
    """

    def __init__(self, keys: np.ndarray, n: int, width: int = 8):
        if width < 8 and n > 1 << (64 - 8 * width):
            raise ValueError("more shards than the bits that keys leave for them")
        self.n, self.width = n, width
        if width < 8:
            bits = U64(8 * width)
            keys = (shard_of(keys, n).astype(U64) << bits) | (keys & ((U64(1) << bits) - U64(1)))
        self.sorted, self.inverse, self.counts = np.unique(keys, return_inverse=True, return_counts=True)
        shards = (self.sorted >> bits).astype(np.int64) if width < 8 else shard_of(self.sorted, n)
        self.edges = np.searchsorted(shards, np.arange(n + 1))

    def body(self, s: int) -> bytes:
        part = self.sorted[self.edges[s] : self.edges[s + 1]]
        return np.ascontiguousarray(part.view(np.uint8).reshape(-1, 8)[:, : self.width].T).tobytes()

    def bodies(self) -> Iterator[tuple[int, np.ndarray]]:
        for s in range(self.n):
            a, b = self.edges[s], self.edges[s + 1]
            if b > a:
                yield s, self.sorted[a:b].astype(np.uint32 if self.width == 4 else np.uint64)

    def answers(self, given: dict[int, np.ndarray], dtype, empty=0) -> np.ndarray:
        """One answer for each key that was passed in, from those of the shards."""
        out = np.full(len(self.sorted), empty, dtype)
        for s, x in given.items():
            out[self.edges[s] : self.edges[s + 1]] = x
        return out[self.inverse]

    def bits(self, given: dict[int, bytes]) -> np.ndarray:
        return self.answers({s: np.unpackbits(np.frombuffer(b, np.uint8), count=int(self.edges[s + 1] - self.edges[s])) for s, b in given.items()}, bool)


def unpacked(body: bytes, count: int, width: int, at: int = 0) -> np.ndarray:
    """Keys of `width` planes of bytes as numbers."""
    out = np.zeros((count, 8), np.uint8)
    out[:, :width] = np.frombuffer(body, np.uint8, count * width, at).reshape(width, count).T
    return out.view(U64).ravel()


def packed_counts(x: np.ndarray) -> bytes:
    """Counts, most of them small: a byte each, and those of 255 and more behind."""
    small = np.minimum(x, 255).astype(np.uint8)
    return small.tobytes() + x[small == 255].astype(np.int64).tobytes()


def unpacked_counts(body: bytes, count: int, at: int = 0) -> tuple[np.ndarray, int]:
    """(counts, where they end)."""
    out = np.frombuffer(body, np.uint8, count, at).astype(np.int64)
    large = np.flatnonzero(out == 255)
    out[large] = np.frombuffer(body, np.int64, len(large), at + count)
    return out, at + count + 8 * len(large)


def asks(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.table({"shard": pa.array([r[0] for r in rows], pa.int32()), "block": pa.array([r[1] for r in rows], pa.int32()), "body": pa.array([r[2] for r in rows], pa.binary())})


def rows_of(table: pa.Table) -> list[tuple[int, int, bytes]]:
    return list(zip(*(table.column(c).to_pylist() for c in ("shard", "block", "body")), strict=True))


def serve(asked: DataFrame, n_shards: int, answer: Callable[[list[tuple[int, bytes]]], list[bytes]]) -> DataFrame:
    """What `answer` gives each block that asked a shard; a shard below 0 hands a block its own row back."""

    def one(table: pa.Table) -> pa.Table:
        rows = rows_of(table)
        if not rows or rows[0][0] < 0:
            return table.select(["shard", "block", "body"])
        rows.sort(key=lambda r: r[1])
        out = asks([(s, b, x) for (s, b, _), x in zip(rows, answer([(b, x) for _, b, x in rows]), strict=True)])
        del rows
        release()
        return out

    spark = asked.sparkSession
    return asked.repartition(max(partitions(spark), n_shards // 2), "shard").groupBy("shard").applyInArrow(one, ASK)


def in_order(docs: pa.Table) -> pa.Table:
    """A block's rows in an order of their own: that in which a shuffle delivers them differs from read to read."""
    docs = docs.combine_chunks()
    return docs.take(pc.sort_indices(docs, [(DOC, "ascending"), (TEXT, "ascending")])) if docs.num_rows > 1 else docs


def with_answers(blocks: DataFrame, answers: DataFrame, f: Callable[[int, pa.Table, dict[int, bytes]], pa.Table], schema: str) -> DataFrame:
    """f(block, its documents, answers by shard) for each block that has documents."""

    def one(docs: pa.Table, got: pa.Table) -> pa.Table:
        b = docs.column(BLOCK)[0].as_py() if docs.num_rows else None
        out = f(b, in_order(docs), {s: x for s, _, x in rows_of(got)})
        release()
        return out

    return blocks.groupBy(BLOCK).cogroup(answers.withColumnRenamed("block", BLOCK).groupBy(BLOCK)).applyInArrow(lambda a, g: one(a, g.rename_columns(["block" if c == BLOCK else c for c in g.column_names])), schema)


def by_block(blocks: DataFrame, f: Callable[[int, pa.Table], pa.Table], schema: str) -> DataFrame:

    def one(docs: pa.Table) -> pa.Table:
        out = f(docs.column(BLOCK)[0].as_py(), in_order(docs))
        release()
        return out

    return blocks.groupBy(BLOCK).applyInArrow(one, schema)


def answer_elsewhere(rows: list[tuple[int, bytes]]) -> list[bytes]:
    """A bit for each 4-byte key: whether another block has it too."""
    parts = [np.frombuffer(x, np.uint32) for _, x in rows]
    keys = np.concatenate(parts)
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    many = (counts > 1)[inverse]
    return [np.packbits(x).tobytes() for x in np.split(many, np.cumsum([len(p) for p in parts])[:-1])]

