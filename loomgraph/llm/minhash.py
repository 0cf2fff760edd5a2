"""Near-duplicate detection by HyperMinHash.

A document's shingles are dealt into BUCKETS by the leading bits of one hash.
A bucket keeps its least hash compressed to a count of leading zeros and
MANTISSA bits after them, 16 bits in all. Bands of ROWS registers propose pairs:
at a similarity of 0.75 a pair misses all 32 bands five times in a million. Sets
of up to SMALL shingles, where most registers are empty, also propose by their
least hashes, as many as prefix filtering needs to miss nothing. The share of
equal registers, less what chance collisions of compressed registers add,
estimates the similarity; pairs that can pass are verified on full
sets.

Texts with equal sets are one class before any pair is looked at. Classes that
are estimated to be near in a bucket form groups; a bucket or
a group of any size is dealt into tiles of about TILE
classes, and tasks compare pairs of tiles and return a spanning forest of the
links found there, never the pairs: a tile's own, and between two tiles only
edges from component to component.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _exchange as X
from ._bytes import Texts, Words, mix
from .components import connected_components

SHINGLE, BUCKETS, ROWS, MANTISSA, SMALL, TILE, VOLUME, SLACK = 5, 128, 4, 10, 24, 768, 400_000, 0.2
EMPTY = 0xFFFF
_BITS = 7


def shingle_sets(texts: Texts, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of each text, concatenated; where each text's begin)."""
    parts, sizes = [], []
    for _, _, t in texts.chunks():
        w = Words(t, lower=True)
        h = w.hashes()
        g, ok = w.windows(h, n)
        short = np.flatnonzero((w.count > 0) & (w.count < n))
        for k in short:  # the whole sequence is the one shingle
            at = w.first[k]
            g[at] = mix(np.array([sum((int(x) * (2 * i + 3) for i, x in enumerate(h[at : at + w.count[k]])), int(w.count[k])) % 2**64], np.uint64), 99)[0]
            ok[at] = True
        total = np.concatenate([[0], np.cumsum(ok)])
        edge = total[w.first]
        g = g[ok]
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            g[a:b].sort()
        doc = np.repeat(np.arange(len(w.count)), np.diff(edge))
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
        parts.append(g[new])
        sizes.append(np.bincount(doc[new], minlength=len(w.count)))
    values = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return values, np.concatenate([[0], *[np.cumsum(np.concatenate(sizes))]] if sizes else [[0]]).astype(np.int64)


def registers(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Compressed registers of each set, one row each."""
    n = len(first) - 1
    out = np.full((n, BUCKETS), EMPTY, np.uint16)
    doc = np.repeat(np.arange(n), np.diff(first))
    bucket = (values >> np.uint64(64 - _BITS)).astype(np.int64)
    lead = np.ones(len(values), bool)
    lead[1:] = (bucket[1:] != bucket[:-1]) | (doc[1:] != doc[:-1])
    rest = (values[lead] << np.uint64(_BITS)) | np.uint64((1 << _BITS) - 1)
    top = np.frexp((rest >> np.uint64(11) | np.uint64(1)).astype(np.float64))[1].astype(np.int64) + 10  # 53 bits are exact
    mantissa = (rest << (np.uint64(64) - top.astype(np.uint64)) >> np.uint64(64 - MANTISSA)).astype(np.int64)
    out[doc[lead], bucket[lead]] = ((63 - top) << MANTISSA) | mantissa
    return out


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity from rows of registers and set sizes, corrected for chance collisions."""
    used = (a != EMPTY) | (b != EMPTY)
    same = ((a == b) & used).sum(axis=-1)
    big, small = np.maximum(n, m), np.maximum(np.minimum(n, m), 1)
    chance = 0.1699195 * BUCKETS * 2.0**-MANTISSA * 4 * (big / small) / (1 + big / small) ** 2
    filled = used.sum(axis=-1)
    return np.clip((same - chance) / np.maximum(filled - chance, 1), 0, 1)


def _sketch(batches):
    for batch in batches:
        table = pa.Table.from_batches([batch])
        texts = Texts.of(table.column(X.TEXT))
        for a, b, part in texts.chunks(1 << 21):
            values, first = shingle_sets(part)
            size = np.diff(first)
            reg = registers(values, first)
            sums = [np.array([], np.int64)] * 2
            for k in range(2):
                total = np.concatenate([[0], np.cumsum(mix(values, 40 + k))]).astype(np.uint64)
                sums[k] = (total[first[1:]] - total[first[:-1]]).view(np.int64)
            bands = reg.reshape(len(reg), -1, ROWS)
            empty = (bands == EMPTY).all(axis=2)
            keys = mix(np.ascontiguousarray(bands).view(np.uint64).reshape(len(reg), -1) ^ mix(np.arange(bands.shape[1], dtype=np.uint64), 7)[None, :], 3)
            lists = []
            for k in range(len(reg)):
                own = keys[k][~empty[k]]
                if 0 < size[k] <= SMALL:
                    own = np.concatenate([own, mix(values[first[k] : first[k] + size[k] - math.ceil(0.75 * size[k]) + 1], 55)])
                lists.append(own.view(np.int64))
            flat = np.concatenate(lists) if lists else np.zeros(0, np.int64)
            offs = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(size), pa.array(sums[0]), pa.array(sums[1]), pa.ListArray.from_arrays(pa.array(offs), pa.array(flat)), pa.array([r.tobytes() for r in reg], pa.binary())], names=["doc_id", "n_shingles", "s0", "s1", "keys", "reg"])


def shared(values: np.ndarray, owner: np.ndarray, n: int, i: np.ndarray, j: np.ndarray, width: int = 1 << 15) -> np.ndarray:
    """Exact sizes of the intersections of sets i[k] and j[k], from bit rows over the values that two sets have."""
    _, inverse, counts = np.unique(values, return_inverse=True, return_counts=True)
    keep = (counts > 1)[inverse]
    col, row = (np.cumsum(counts > 1) - 1)[inverse[keep]], owner[keep]
    out, last = np.zeros(len(i), np.int64), int(col.max(initial=-1)) + 1
    for low in range(0, last, width):
        span = min(width, -(-(last - low) // 64) * 64)
        here = (col >= low) & (col < low + span)
        dense = np.zeros((n, span), bool)
        dense[row[here], col[here] - low] = True
        bits = np.packbits(dense, axis=1).view(np.uint64)
        step = max(1, (1 << 21) // bits.shape[1])
        for k in range(0, len(i), step):
            out[k : k + step] += np.bitwise_count(bits[i[k : k + step]] & bits[j[k : k + step]]).sum(axis=1, dtype=np.int64)
    return out


def near_pairs(reg: np.ndarray, size: np.ndarray, per_cent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose sizes allow a link and whose estimate lies less than SLACK below it.

    An estimate from full registers strays by 0.04; pairs with a set of up to SMALL shingles, whose registers are few, pass.
    """
    n = len(size)
    rows, cols = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    step = max(1, (1 << 23) // (BUCKETS * max(n, 1)))
    for a in range(0, n, step):
        i, j = np.meshgrid(np.arange(a, min(n, a + step)), np.arange(n), indexing="ij")
        ok = (j > i) & (100 * np.minimum(size[i], size[j]) >= per_cent * np.maximum(size[i], size[j]))
        i, j = i[ok], j[ok]
        near = estimate(reg[i], reg[j], size[i], size[j]) >= per_cent / 100 - SLACK
        near |= np.minimum(size[i], size[j]) <= SMALL
        rows.append(i[near])
        cols.append(j[near])
    return np.concatenate(rows), np.concatenate(cols)


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least index of each index's component under the pairs (i, j)."""
    label = np.arange(n)
    while True:
        was = label.copy()
        np.minimum.at(label, i, label[j])
        np.minimum.at(label, j, label[i])
        label = label[label]
        if (label == was).all():
            return label


def forest(ids: np.ndarray, tile: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (id, id) that join what the pairs (i, j) join. Of one tile, an edge from each index to the least of its component; of
    two, only edges between components of the tiles, as the task of each tile alone gives the rest."""
    whole, n = roots(len(ids), i, j), len(ids)
    if n and (tile != tile[0]).any():
        inner = tile[i] == tile[j]
        member = np.unique(roots(n, i[inner], j[inner]))
        member = member[whole[member] != member]
    else:
        member = np.flatnonzero(whole != np.arange(n))
    return ids[member], ids[whole[member]]


def estimated_links(table: pa.Table, per_cent: int) -> tuple[np.ndarray, np.ndarray]:
    reg = np.frombuffer(b"".join(table.column("reg").to_pylist()), np.uint16).reshape(-1, BUCKETS)
    return forest(table.column(X.DOC).to_numpy(), table.column("tile").to_numpy(), *near_pairs(reg, table.column("n_shingles").to_numpy(), per_cent))


def verified_links(table: pa.Table, per_cent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links on full sets."""
    values, first = shingle_sets(Texts.of(table.column(X.TEXT)))
    size = np.diff(first)
    i, j = near_pairs(registers(values, first), size, per_cent)
    both = shared(values, np.repeat(np.arange(len(size)), size), len(size), i, j)
    link = 100 * both >= per_cent * (size[i] + size[j] - both)
    return forest(table.column(X.DOC).to_numpy(), table.column("tile").to_numpy(), i[link], j[link])


def _groups(links, keys: list[str], per_cent: int):
    """links() of each group of rows with equal keys. Rows come sorted by them; a group can go over several batches."""

    def run(batches):
        open_key, held = None, []

        def flush():
            a, b = links(pa.Table.from_batches(held).combine_chunks(), per_cent)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            at = list(zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in keys), strict=True))
            edges = [k for k in range(len(at)) if k == 0 or at[k] != at[k - 1]] + [len(at)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if at[a] != open_key:
                    if held:
                        yield flush()
                    open_key, held = at[a], []
                held.append(batch.slice(a, b - a))
        if held:
            yield flush()

    return run


def _tiled(rows: DataFrame) -> DataFrame:
    """rows with tile, and copies for each pair (x, y) of tiles that they take part in; `members` and `volume` are the number of
    classes and of shingles in their group: a tile has about TILE classes and VOLUME shingles at most."""
    tiles = F.ceil(F.greatest(F.col("members") / F.lit(TILE), F.col("volume") / F.lit(VOLUME))).cast("int")
    out = rows.withColumn("tiles", F.least(tiles, F.col("members").cast("int"))).withColumn("tile", F.pmod(F.xxhash64(X.DOC), F.col("tiles")).cast("int"))
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return out.select(X.DOC, "key", "tile", F.least("tile", "other").alias("x"), F.greatest("tile", "other").alias("y"))


def _linked(rows: DataFrame, links, keys: list[str], per_cent: int) -> DataFrame:
    dealt = rows.repartition(4 * X.partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(X.tidy(_groups(links, keys, per_cent)), "a long, b long")


def near_duplicates(docs: DataFrame, per_cent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (doc_id = component_id), a row for each doc_id.

    Documents are linked if 100 * shared shingles >= per_cent * all shingles of the two; component_id is the smallest
    doc_id that links reach. per_cent below 75 finds fewer of its pairs, as the bands are made for 75.

    Null and empty texts, and texts without words, have 0 shingles and are linked with nothing. Rows that repeat a doc_id
    count as one document with the least (text) of them; rows without doc_id are left out. Other columns are ignored.
    """
    spark = docs.sparkSession
    one = docs.select(F.col("doc_id").cast("long").alias(X.DOC), F.col("text").alias(X.TEXT)).where(F.col("doc_id").isNotNull())
    if not one.groupBy(X.DOC).count().where("count > 1").isEmpty():
        one = one.groupBy(X.DOC).agg(F.min(X.TEXT).alias(X.TEXT))
    sketch = X.settle(one.mapInArrow(X.tidy(_sketch), "doc_id long, n_shingles long, s0 long, s1 long, keys array<long>, reg binary"))
    classes = sketch.where("n_shingles > 0").groupBy("n_shingles", "s0", "s1").agg(F.min("doc_id").alias("class_id"))
    firsts = sketch.join(classes.select(F.col("class_id").alias("doc_id")), "doc_id", "left_semi")
    bands = firsts.select(F.col("doc_id").alias("a"), F.explode("keys").alias("key"))
    # buckets with the same members are one: what is left of a group of copies is mostly one bucket
    buckets = bands.groupBy("key").agg(F.min("a").alias("lo"), F.max("a").alias("hi"), F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a").cast("decimal(20,0)")).alias("h")).where("lo != hi")
    distinct = buckets.groupBy("lo", "hi", "n", "h").agg(F.min("key").alias("key")).select("key", F.col("n").alias("members"), F.lit(0).alias("volume"))
    placed = _tiled(bands.join(distinct, "key").select(F.col("a").alias(X.DOC), "key", "members", "volume"))
    near = _linked(placed.join(firsts.select(X.DOC, "n_shingles", "reg"), X.DOC), estimated_links, ["key", "x", "y"], per_cent)
    groups = connected_components(near).select(F.col("id").alias(X.DOC), F.col("component").alias("key"))
    sized = groups.join(firsts.select(X.DOC, "n_shingles"), X.DOC)
    placed = _tiled(sized.join(sized.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.sum("n_shingles").alias("volume")), "key"))
    links = _linked(one.join(placed, X.DOC), verified_links, ["key", "x", "y"], per_cent)
    linked = connected_components(links)
    of_class = classes.join(linked, classes.class_id == linked.id, "left").select("n_shingles", "s0", "s1", F.coalesce("component", "class_id").alias("root"))
    # rows without words are in no class: they stay out of the join, where they would be one key
    some = sketch.where("n_shingles > 0").select("doc_id", "n_shingles", "s0", "s1").join(of_class, ["n_shingles", "s0", "s1"], "left").select("doc_id", "n_shingles", "root")
    out = some.unionByName(sketch.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("root")))
    component = F.coalesce("root", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
