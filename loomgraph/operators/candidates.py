"""Merge candidates: bounded approximate self-joins. All return (i, j, score, source) with i < j."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import mixed, settled
from ..graph import neighbours, ranked
from .linalg import columns, row_sum

SOURCES = ("onehop", "twohop", "bucket", "ann", "anchor", "footprint", "response", "relation", "fallback")


def _pairs(df: DataFrame, source: str) -> DataFrame:
    lo, hi = F.least("i", "j"), F.greatest("i", "j")
    # numbers alone are aggregated by hash; with a string among them all pairs would be sorted
    best = df.where("i != j").select(lo.alias("i"), hi.alias("j"), "score").groupBy("i", "j").agg(F.min("score").alias("score"))
    return best.withColumn("source", F.lit(source))


def with_distance(pairs: DataFrame, x: DataFrame) -> DataFrame:
    """pairs with score set to the squared distance of their rows of x; absent rows are zero."""
    names = columns(x)
    side = lambda end, mark: x.select(F.col("node_id").alias(end), *[F.col(c).alias(f"__{mark}{c}") for c in names])
    both = pairs.drop("score").join(side("i", "a"), "i", "left").join(side("j", "b"), "j", "left")
    diffs = [F.coalesce(f"__a{c}", F.lit(0.0)) - F.coalesce(f"__b{c}", F.lit(0.0)) for c in names]
    return both.withColumn("score", row_sum([d * d for d in diffs])).drop(*[f"__{m}{c}" for c in names for m in "ab"])


def onehop(edges: DataFrame, nodes: DataFrame, x: DataFrame | None = None) -> DataFrame:
    """Ends of edges that have one type and one partition."""
    a = nodes.select(F.col("node_id").alias("src"), F.col("type_id").alias("ta"), F.col("part_id").alias("pa"))
    b = nodes.select(F.col("node_id").alias("dst"), F.col("type_id").alias("tb"), F.col("part_id").alias("pb"))
    same = edges.join(a, "src").join(b, "dst").where("ta = tb AND pa = pb").select(F.col("src").alias("i"), F.col("dst").alias("j"), F.lit(0.0).alias("score"))
    out = _pairs(same, "onehop")
    return with_distance(out, x).select("i", "j", "score", "source") if x is not None else out


def incident_index(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(middle, type_id, endpoint): the distinct neighbours of each node, in both directions."""
    both = edges.select(F.col("src").alias("middle"), F.col("dst").alias("endpoint")).unionByName(edges.select(F.col("dst").alias("middle"), F.col("src").alias("endpoint")))
    return both.distinct().join(nodes.select(F.col("node_id").alias("endpoint"), "type_id"), "endpoint").select("middle", "type_id", "endpoint")


def degree_cap(index: DataFrame, share: float = 0.99) -> DataFrame:
    """(cap): a percentile of the neighbour lists longer than 1, floored, at least 1."""
    sizes = index.groupBy("middle", "type_id").count().where("count > 1")
    return sizes.agg(F.greatest(F.lit(1).cast("long"), F.floor(F.percentile("count", F.lit(share)))).alias("cap"))


def twohop(edges: DataFrame, nodes: DataFrame, cap: int, pair_cap: int, seed: int = 0, settle=settled) -> DataFrame:
    """Pairs of neighbours of a node, of one type and partition: at most `cap` neighbours, those that come first in a hash
    order, and of their pairs at most pair_cap for each (middle, type, partition). Both caps bound the work of hubs by
    contract; a hub is first cut with a map-side aggregate, never gathered whole. The neighbours that are left are settled, so that
    what found them is given back before they are paired."""
    index = incident_index(edges, nodes).join(nodes.select(F.col("node_id").alias("endpoint"), "part_id"), "endpoint").where("middle != endpoint")
    key = ["middle", "type_id", "part_id"]
    order = mixed(F.col("endpoint") + F.col("middle"), 0, seed)
    few = index.withColumn("h", order).withColumn("r", F.row_number().over(W.partitionBy(*key).orderBy("h", "endpoint"))).where(F.col("r") <= cap)
    few = settle(few.select(*key, "endpoint"))
    a = few.select(*key, F.col("endpoint").alias("i"))
    b = few.select(*key, F.col("endpoint").alias("j"))
    pairs = a.join(b, key).where("i < j").withColumn("h", mixed(F.col("i") + F.col("j") + F.col("middle"), 1, seed))
    pairs = pairs.withColumn("r", F.row_number().over(W.partitionBy(*key).orderBy("h", "i", "j"))).where(F.col("r") <= pair_cap)
    return _pairs(pairs.select("i", "j", F.lit(0.0).alias("score")), "twohop")


def bucket_pairs(buckets: DataFrame, per_bucket: int, probe_bits: int = 0) -> DataFrame:
    """Neighbours in the order of ids within a hash bucket, up to per_bucket places apart, and with probe_bits the same-rank
    nodes of the buckets that differ in one of so many bits. Ranks meet by equality joins, so no bucket is one task."""
    placed = settled_ranks(buckets)
    ahead = placed.select(F.col("node_id").alias("i"), "bucket", F.explode(F.sequence(F.col("rank") + 1, F.col("rank") + per_bucket)).alias("rank"))
    pairs = ahead.join(placed.select(F.col("node_id").alias("j"), "bucket", "rank"), ["bucket", "rank"]).select("i", "j", F.lit(0.0).alias("score"))
    if probe_bits:
        first = placed.where(F.col("rank") <= per_bucket)
        a = first.select(F.col("node_id").alias("i"), "rank", F.explode(hamming_neighbours(F.col("bucket"), probe_bits)).alias("bucket"))
        b = first.select(F.col("node_id").alias("j"), "rank", "bucket")
        pairs = pairs.unionByName(a.join(b, ["bucket", "rank"]).where("i < j").select("i", "j", F.lit(0.0).alias("score")))
    return _pairs(pairs, "bucket")


def settled_ranks(buckets: DataFrame) -> DataFrame:
    """(node_id, bucket, rank): places by id within buckets, of which there can be very many or a few very large ones."""
    return ranked(buckets.select("node_id", "bucket"), ["bucket"], "node_id", 16)


def ann_window(values: DataFrame, nodes: DataFrame, window: int, projections: list[str] | None = None) -> DataFrame:
    """Nodes that stand at most `window` places apart in the order of a projection, within type and partition, by each of the
    columns of values (node_id, ...); the score is the least squared difference."""
    rows = values.join(nodes.select("node_id", "type_id", "part_id"), "node_id")
    out = None
    for p in projections or [c for c in values.columns if c != "node_id"]:
        near = neighbours(rows.select("node_id", "type_id", "part_id", p), ["type_id", "part_id"], [p, "node_id"], window, [p])
        d = F.col(f"{p}_i") - F.col(f"{p}_j")
        found = near.select("i", "j", (d * d).alias("score"))
        out = found if out is None else out.unionByName(found)
    return _pairs(out, "ann")


def fallback(nodes: DataFrame, penalty: float = 1e6) -> DataFrame:
    """Consecutive ids of a type and partition, paired off."""
    placed = ranked(nodes.select("node_id", "type_id", "part_id"), ["type_id", "part_id"], "node_id").withColumn("g", F.floor((F.col("rank") - 1) / 2))
    pairs = placed.groupBy("type_id", "part_id", "g").agg(F.min("node_id").alias("i"), F.max("node_id").alias("j")).where("i != j")
    return pairs.select("i", "j", F.lit(penalty).alias("score"), F.lit("fallback").alias("source"))


def retain(candidates: DataFrame, k: int, per_source: dict[str, int] | None = None, priority: dict[str, float] | None = None, settle=settled) -> DataFrame:
    """The least score of each pair, kept where it is among the k best of both ends (by score, source, other end).

    per_source bounds the pairs of a source at each end before that; priority is added to the scores of a source, as for
    sources that are to go before or after all others. A node's pairs are cut to k before its ranks are taken."""
    score = F.round("score", 9)
    for s, p in (priority or {}).items():
        score = F.when(F.col("source") == s, score + p).otherwise(score)
    order = F.array_position(F.array(*[F.lit(s) for s in SOURCES]), F.col("source"))
    best = candidates.groupBy("i", "j").agg(F.min(F.struct(score.alias("score"), order.alias("o"), "source")).alias("m")).select("i", "j", "m.score", "m.source", "m.o")
    best = settle(best)
    for s, most in (per_source or {}).items():
        own = _among(best.where(F.col("source") == s), most)
        best = best.where(F.col("source") != s).unionByName(own)
    return _among(best, k).select("i", "j", "score", "source")


def _among(best: DataFrame, k: int) -> DataFrame:
    side = lambda a, b: best.select(F.col(a).alias("n"), "i", "j", "score", "o", F.col(b).alias("other"))
    both = side("i", "j").unionByName(side("j", "i"))
    place = F.row_number().over(W.partitionBy("n").orderBy("score", "o", "other"))
    good = both.withColumn("r", place).where(F.col("r") <= k).groupBy("i", "j").count().where("count = 2")
    return best.join(good.select("i", "j"), ["i", "j"], "left_semi")


def merged(*stores: DataFrame) -> DataFrame:
    """Candidate tables as one: the least score of each pair, with its source."""
    out = stores[0]
    for s in stores[1:]:
        out = out.unionByName(s)
    order = F.array_position(F.array(*[F.lit(s) for s in SOURCES]), F.col("source"))
    return out.groupBy("i", "j").agg(F.min(F.struct("score", order.alias("o"), "source")).alias("m")).select("i", "j", "m.score", "m.source")


def source_counts(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def node_coverage(candidates: DataFrame) -> DataFrame:
    """(source, covered): how many nodes have a pair from each source."""
    ends = candidates.select("source", F.col("i").alias("n")).unionByName(candidates.select("source", F.col("j").alias("n")))
    return ends.distinct().groupBy("source").agg(F.count(F.lit(1)).alias("covered"))


def hamming_neighbours(bucket: Column, bits: int) -> Column:
    """The keys that differ from a bucket in one of its low bits."""
    return F.array(*[bucket.bitwiseXOR(F.lit(1 << b)) for b in range(bits)])
