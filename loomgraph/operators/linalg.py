"""Message passing: sparse matrices are edge tables, dense ones have a row for each node, (node_id, v0, v1, ...).

An edge then meets its node's whole row in one join, and sums are columns of one aggregate; rows that are absent are zero."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import EPS, dropped, gaussian, one_of, settled, sign, union


def columns(x: DataFrame) -> list[str]:
    return [c for c in x.columns if re.fullmatch(r"v\d+", c)]


def width(q: int) -> list[str]:
    return [f"v{j}" for j in range(q)]


def probe(nodes: DataFrame, q: int, seed: int = 0, kind: str = "rademacher", keep: tuple[str, ...] = ()) -> DataFrame:
    """q columns of +1 and -1, or Gaussian ones, beside the columns to keep."""
    draw = {"rademacher": sign, "gaussian": gaussian}[kind]
    return nodes.select("node_id", *keep, *[draw(F.col("node_id"), j, seed).alias(c) for j, c in enumerate(width(q))])


def long(x: DataFrame) -> DataFrame:
    """(node_id, j, v): an entry a row."""
    return x.select("node_id", F.posexplode(F.array(*columns(x))).alias("j", "v"))


def wide(x: DataFrame, q: int) -> DataFrame:
    """The rows of a table (node_id, j, v) of entries."""
    return x.groupBy("node_id").agg(*[F.sum(F.when(F.col("j") == j, F.col("v")).otherwise(0.0)).alias(c) for j, c in enumerate(width(q))])


def row_sum(terms: list[Column]) -> Column:
    return functools.reduce(lambda a, b: a + b, terms, F.lit(0.0))


def square_norm(x: DataFrame) -> float:
    """The sum of all squares."""
    return x.agg(F.sum(row_sum([F.col(c) * F.col(c) for c in columns(x)]))).first()[0] or 0.0


def relation_degrees(edges: DataFrame) -> DataFrame:
    """(rel_id, node_id, src_degree, dst_degree): weighted degrees of each relation."""
    out = edges.select("rel_id", F.col("src").alias("node_id"), F.col("w").alias("s"), F.lit(0.0).alias("d"))
    into = edges.select("rel_id", F.col("dst").alias("node_id"), F.lit(0.0).alias("s"), F.col("w").alias("d"))
    return out.unionByName(into).groupBy("rel_id", "node_id").agg(F.sum("s").alias("src_degree"), F.sum("d").alias("dst_degree"))


def normalized(edges: DataFrame, by: tuple[str, ...] = ("rel_id",)) -> DataFrame:
    """edges with w divided by the root of both ends' degrees, within each relation, or over all with by=().

    Degrees are aggregated and joined back: a hub's edges can then be split over tasks, which a window would keep in one.
    """
    s = edges.groupBy(*by, "src").agg(F.sum("w").alias("__s"))
    d = edges.groupBy(*by, "dst").agg(F.sum("w").alias("__d"))
    out = edges.join(s, [*by, "src"]).join(d, [*by, "dst"])
    return out.select("rel_id", "src", "dst", (F.col("w") / F.greatest(F.sqrt(F.col("__s") * F.col("__d")), F.lit(EPS))).alias("w"))


def ends(edges: DataFrame) -> DataFrame:
    """(dim, node_id, to, w): each edge from both of its ends; dim is 2 rel_id + side, the side that of node_id, 0 at the source."""
    side = lambda a, b, k: edges.select((2 * F.col("rel_id") + k).cast("int").alias("dim"), F.col(a).alias("node_id"), F.col(b).alias("to"), "w")
    return side("src", "dst", 0).unionByName(side("dst", "src", 1))


def portions(edges: DataFrame, most: int = 16_000_000) -> list[tuple[list[int], int]]:
    """(dims, slices): in which portions ends are shuffled, so that what a step shuffles is small beside the edges: one for each dim
    with over a quarter of `most` edges, in up to 8 slices of at most `most`, and one for all others."""
    sizes = {r.rel_id: r["count"] for r in edges.groupBy("rel_id").count().collect()}
    if 2 * sum(sizes.values()) <= most:
        return [(sorted(2 * r + s for r in sizes for s in (0, 1)), 1)]
    large = {r: n for r, n in sizes.items() if 4 * n > most}
    out = [([2 * r + s], min(8, -(-n // most))) for r, n in sorted(large.items()) for s in (0, 1)]
    rest = sorted(2 * r + s for r in sizes if r not in large for s in (0, 1))
    return out + ([(rest, 1)] if rest else [])


def end_degrees(edges: DataFrame, parts: list[tuple[list[int], int]], settle=settled) -> list[DataFrame]:
    """Settled tables (dim, node_id, m), portion by portion: m is the weight of a node's edges of one relation on one side."""
    of = ends(edges)
    return [settle(of.where(F.col("dim").isin(dims)).groupBy("dim", "node_id").agg(F.sum("w").alias("m"))) for dims, _ in parts]


def degree_root(m: Column) -> Column:
    """One over the root of a degree, 0 for a degree of 0."""
    return F.when(m != 0, 1.0 / F.sqrt(F.abs(m))).otherwise(0.0)


def normalized_messages(edges: DataFrame, x: DataFrame, parts: list[tuple[list[int], int]], also: dict[str, Column] | None = None, settle=settled) -> list[DataFrame]:
    """Settled tables (dim, node_id, v0...), portion by portion: for each dim and node the sum, over its edges there, of w times x of
    the other end over the root of the other end's degree. x(node_id, by, v0...) has degrees as a map over dims; `also` names
    further sums, of columns of an edge and of x."""
    names, of, out = columns(x), ends(edges), []
    for dims, slices in parts:
        # a row of x goes only to portions in which the node has edges
        if len(dims) == 1:
            key, state = ["node_id"], x.where(F.array_contains(F.map_keys("by"), dims[0])).withColumn("__f", degree_root(F.try_element_at("by", F.lit(dims[0]))))
        else:
            each = x.select("*", F.explode("by").alias("dim", "__m")).where(F.col("dim").isin(dims))
            key, state = ["dim", "node_id"], each.withColumn("__f", degree_root(F.col("__m"))).drop("__m")
        state = state.drop("by").hint("shuffle_hash")
        for k in range(slices):
            near = of.where(F.col("dim").isin(dims) & one_of("to", slices, k))
            sums = near.join(state, key).groupBy(F.col("dim").bitwiseXOR(F.lit(1)).alias("dim"), F.col("to").alias("node_id"))
            out.append(settle(sums.agg(*[F.sum(F.col("w") * F.col("__f") * F.col(c)).alias(c) for c in names], *[c.alias(n) for n, c in (also or {}).items()])))
    return out


def normalized_fused(messages: list[DataFrame], table: DataFrame, alpha: dict[int, float], also: dict[str, Column] | None = None, beside: DataFrame | None = None, scale: float = 0.5, slices: int = 1, settle=settled) -> DataFrame:
    """table(node_id, by, ...) with v0...: fused(normalized(edges), x, alpha), put together from its messages, which are dropped;
    null where a node gets none. It is settled in slices of the nodes. The roots of both degrees are multiplied one after the
    other, so a product of degrees below EPS**2 is not raised to that. `also` has further aggregates of messages, `beside` is a
    table whose columns are put beside those by node_id."""
    got = union(messages)
    weight = F.coalesce(F.element_at(F.create_map(*[F.lit(y) for r, a in alpha.items() for s in (0, 1) for y in (2 * r + s, float(a) * scale)]), F.col("dim")), F.lit(0.0))
    out = []
    for k in range(slices):
        roots = table.select("node_id", "by").where(one_of("node_id", slices, k))
        met = got.where(one_of("node_id", slices, k)).join(roots.hint("shuffle_hash"), "node_id")
        f = weight * degree_root(F.try_element_at("by", F.col("dim")))
        sums = met.groupBy("node_id").agg(*[F.sum(f * F.col(c)).alias(c) for c in columns(got)], *[c.alias(n) for n, c in (also or {}).items()])
        rows = table.where(one_of("node_id", slices, k)).join(sums, "node_id", "left")
        out.append(settle(rows if beside is None else rows.join(beside.where(one_of("node_id", slices, k)), "node_id", "left")))
    dropped(*messages)
    return union(out)


def row_normalized(edges: DataFrame, side: str = "src") -> DataFrame:
    """w over the sum of its source (or destination) in the relation."""
    total = edges.groupBy("rel_id", side).agg(F.sum("w").alias("__t"))
    return edges.join(total, ["rel_id", side]).select("rel_id", "src", "dst", (F.col("w") / F.greatest("__t", F.lit(EPS))).alias("w"))


def spmm(edges: DataFrame, x: DataFrame, direction: str = "forward", scale: float = 0.5) -> DataFrame:
    """(rel_id, node_id, v0...): forward adds x at the source to the destination, backward the other way, symmetric scale times both."""
    forward = edges.select("rel_id", F.col("src").alias("node_id"), F.col("dst").alias("to"), "w")
    backward = edges.select("rel_id", F.col("dst").alias("node_id"), F.col("src").alias("to"), "w")
    if direction == "symmetric":
        steps = forward.unionByName(backward).withColumn("w", F.col("w") * scale)
    else:
        steps = {"forward": forward, "backward": backward}[direction]
    return steps.join(x, "node_id").groupBy("rel_id", F.col("to").alias("node_id")).agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in columns(x)])


def fused(edges: DataFrame, x: DataFrame, alpha: dict[int, float] | DataFrame, direction: str = "symmetric", scale: float = 0.5) -> DataFrame:
    """The sum of the relations' products, weighted by alpha, a dictionary or a table (rel_id, alpha) of few rows. One join and
    one aggregate for all relations."""
    if isinstance(alpha, DataFrame):
        weighted = edges.join(F.broadcast(alpha.select("rel_id", "alpha")), "rel_id").select("rel_id", "src", "dst", (F.col("w") * F.col("alpha")).alias("w"))
    else:
        weight = F.coalesce(F.element_at(F.create_map(*[F.lit(y) for k, v in alpha.items() for y in (k, float(v))]), F.col("rel_id")), F.lit(0.0))
        weighted = edges.withColumn("w", F.col("w") * weight)
    return spmm(weighted.withColumn("rel_id", F.lit(0)), x, direction, scale).drop("rel_id")


def combine(*parts: tuple[float, DataFrame]) -> DataFrame:
    """The weighted sum of dense tables."""
    names = columns(parts[0][1])
    rows = [df.select("node_id", *[(F.col(n) * c).alias(n) for n in names]) for c, df in parts]
    return functools.reduce(DataFrame.unionByName, rows).groupBy("node_id").agg(*[F.sum(n).alias(n) for n in names])


def laplacian(edges: DataFrame, x: DataFrame, alpha: dict[int, float]) -> DataFrame:
    return combine((1.0, x), (-1.0, fused(edges, x, alpha)))


def lazy_smoothing(edges: DataFrame, x: DataFrame, alpha: dict[int, float]) -> DataFrame:
    """Half of x and half of the forward products, by the sum of |alpha|."""
    total = sum(abs(a) for a in alpha.values()) or 1.0
    return combine((0.5, x), (0.5 / total, fused(edges, x, alpha, "forward")))


def metapath(edges: DataFrame, x: DataFrame, steps: list[tuple[int, str]]) -> DataFrame:
    """x carried along a chain of (relation, direction)."""
    for rel, direction in steps:
        x = spmm(edges.where(F.col("rel_id") == rel), x, direction).drop("rel_id")
    return x


def incident_mass(edges: DataFrame) -> DataFrame:
    """(node_id, mass): the weight of all edges at a node, a loop counting twice."""
    ends = edges.select(F.col("src").alias("node_id"), "w").unionByName(edges.select(F.col("dst").alias("node_id"), "w"))
    return ends.groupBy("node_id").agg(F.sum("w").alias("mass"))


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 20, settle=settled) -> DataFrame:
    """(node_id, rank) on undirected weights; the mass of nodes without edges is spread over all; ranks sum to 1."""
    both = edges.select("src", "dst", "w").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    share = both.join(both.groupBy("src").agg(F.sum("w").alias("t")), "src").select("src", "dst", (F.col("w") / F.col("t")).alias("p"))
    n = nodes.count()
    linked = share.select(F.col("src").alias("node_id")).distinct().withColumn("linked", F.lit(1))
    rank = settle(nodes.select("node_id").join(linked, "node_id", "left").withColumn("rank", F.lit(1.0 / n)))
    for _ in range(rounds):
        lost = rank.where("linked is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        got = share.join(rank.select(F.col("node_id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("node_id")).agg(F.sum(F.col("p") * F.col("rank")).alias("g"))
        rank = settle(rank.drop("rank").join(got, "node_id", "left").withColumn("rank", (1 - damping) / n + damping * (F.coalesce("g", F.lit(0.0)) + lost / n)).drop("g"))
    total = rank.agg(F.sum("rank")).first()[0]
    return rank.select("node_id", (F.col("rank") / total).alias("rank"))


def is_reverse(a: DataFrame, b: DataFrame) -> bool:
    """Whether b holds exactly the edges of a turned round."""
    turned = a.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    other = b.select("src", "dst", "w")
    return turned.exceptAll(other).isEmpty() and other.exceptAll(turned).isEmpty()


def drop_reverse(edges: DataFrame, alpha: dict[int, float], pairs: list[tuple[int, int]], policy: str = "auto") -> dict[int, float]:
    """Relation weights under a policy on reverse relations: include_all keeps them; drop_detected_reverse takes the second of
    each pair out whose edges are those of the first turned round; auto does so only where every pair is such. What is left is
    scaled to the same total."""
    if policy == "include_all":
        return alpha
    exact = [b for a, b in pairs if is_reverse(edges.where(F.col("rel_id") == a), edges.where(F.col("rel_id") == b))]
    if not exact or policy == "auto" and len(exact) < len(pairs):
        return alpha
    kept = {r: a for r, a in alpha.items() if r not in exact}
    total, left = sum(alpha.values()), sum(kept.values())
    return {r: a * total / left for r, a in kept.items()} if left else alpha


def operator_norm(nodes: DataFrame, edges: DataFrame, alpha: dict[int, float], rounds: int = 8, q: int = 4, settle=settled) -> float:
    """The fused operator's norm by power iteration on a block of probes."""
    x, norm = probe(nodes, q, 7), 0.0
    for _ in range(rounds):
        y = settle(fused(edges, x, alpha))
        size, grown = square_norm(x) ** 0.5, square_norm(y) ** 0.5
        norm = grown / size if size else 0.0
        x = y.select("node_id", *[(F.col(c) / (grown or 1.0)).alias(c) for c in columns(y)])
    return norm


def transition_probe(edges: DataFrame, x: DataFrame, steps: list[tuple[int, str]], keep: int | None = None) -> DataFrame:
    """x carried along a path by row-normalised transitions: each step gives a node the mean of x over what it leads to. With
    `keep` only so many rows of the largest norm, ties by id, go on after each step."""
    for rel, direction in steps:
        part = edges.where(F.col("rel_id") == rel)
        if direction == "backward":
            part = part.select("rel_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
        x = spmm(row_normalized(part), x, "backward").drop("rel_id")
        if keep is not None:
            norm = F.round(row_sum([F.col(c) * F.col(c) for c in columns(x)]), 12)
            x = x.orderBy(norm.desc(), "node_id").limit(keep)
    return x


def smoothing_ends(edges: DataFrame) -> DataFrame:
    """(node_id, to, w, n): what neighbour_smoothing reads of the edges, to be settled where it is done more than once. Edges that
    join the same two nodes, as those of a relation and its reverse, are one row, n their number."""
    share = row_normalized(edges)
    ends = share.select(F.col("src").alias("node_id"), F.col("dst").alias("to"), "w").unionByName(share.select(F.col("dst").alias("node_id"), F.col("src").alias("to"), "w"))
    return ends.groupBy("node_id", "to").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n"))


def neighbour_smoothing(edges: DataFrame, x: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """A node's row plus those of its neighbours in both directions, times the edge's share of its source's weight, over one plus
    the number of edges at the node. ends are the edges' smoothing_ends, if they are there already."""
    ends = smoothing_ends(edges) if ends is None else ends
    names = columns(x)
    got = ends.join(x, "node_id").groupBy(F.col("to").alias("node_id")).agg(F.sum("n").alias("__n"), *[F.sum(F.col("w") * F.col(c)).alias(f"__{c}") for c in names])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return x.join(got, "node_id", "left").select("node_id", *[((F.col(c) + zero(f"__{c}")) / (1.0 + zero("__n"))).alias(c) for c in names])


def masked(x: DataFrame, nodes: DataFrame, type_id: int) -> DataFrame:
    """x with the rows of other types zero."""
    kinds = nodes.select("node_id", "type_id")
    return x.join(kinds, "node_id").select("node_id", *[F.when(F.col("type_id") == type_id, F.col(c)).otherwise(0.0).alias(c) for c in columns(x)])
