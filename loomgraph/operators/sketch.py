"""Low-pass sketches, relation and metapath weights, and hash signatures."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import EPS, gaussian, settled, sign
from .linalg import columns, combine, fused, lazy_smoothing, masked, operator_norm, probe, row_sum, spmm, square_norm, width

#: Guards the energies that weights are made of.
SMOOTH = 1e-8


def chebyshev_coefficients(order: int, t: float, points: int = 128) -> list[float]:
    """Coefficients of exp(-t (x + 1)) on [-1, 1] by Chebyshev quadrature."""
    m = max(points, 128, 8 * order)
    nodes = [math.pi * (j + 0.5) / m for j in range(m)]
    f = [math.exp(-t * (math.cos(a) + 1)) for a in nodes]
    return [(1 if k == 0 else 2) / m * sum(y * math.cos(k * a) for y, a in zip(f, nodes, strict=True)) for k in range(order + 1)]


def row_normalize(x: DataFrame) -> DataFrame:
    names = columns(x)
    norm = F.greatest(F.sqrt(row_sum([F.col(c) * F.col(c) for c in names])), F.lit(EPS))
    return x.select("node_id", *[(F.col(c) / norm).alias(c) for c in names])


def side_by_side(*parts: DataFrame) -> DataFrame:
    """Dense tables of the same nodes as one, columns numbered on."""
    out, n = None, 0
    for x in parts:
        names = columns(x)
        named = x.select("node_id", *[F.col(c).alias(f"v{n + k}") for k, c in enumerate(names)])
        n += len(names)
        out = named if out is None else out.join(named, "node_id", "full")
    return out.na.fill(0.0, width(n))


def heat_filter(edges: DataFrame, x: DataFrame, alpha: dict[int, float], order: int, t: float, scale: float = 1.0, settle=settled) -> DataFrame:
    """The heat kernel of the fused Laplacian applied to x by the Chebyshev recurrence on -scale * S."""
    c = chebyshev_coefficients(order, t)
    before, now = x, settle(combine((-scale, fused(edges, x, alpha))))
    out = [(c[0], x), (c[1], now)] if order else [(c[0], x)]
    for k in range(2, order + 1):
        before, now = now, settle(combine((-2.0 * scale, fused(edges, now, alpha)), (-1.0, before)))
        out.append((c[k], now))
    return combine(*out)


def heat_sketch(edges: DataFrame, x: DataFrame, alpha: dict[int, float], order: int, t: float, settle=settled) -> DataFrame:
    return row_normalize(heat_filter(edges, x, alpha, order, t, settle=settle))


def heat_scale(nodes: DataFrame, edges: DataFrame, alpha: dict[int, float], tolerance: float = 1e-3, settle=settled) -> float:
    """What the operator is multiplied by: 1 over its norm where that is above 1 by more than the tolerance, else 1."""
    norm = operator_norm(nodes, edges, alpha, settle=settle)
    return 1.0 / norm if norm > 1.0 + tolerance else 1.0


def heat_sketches(edges: DataFrame, nodes: DataFrame, alpha: dict[int, float], dim: int, order: int, times: list[float], scale: float = 1.0, seed: int = 0, settle=settled) -> DataFrame:
    """One sketch of `dim` columns dealt out over several heat times, each from a probe of its own, then rows normalised."""
    shares = [dim // len(times) + (k < dim % len(times)) for k in range(len(times))]
    parts = [heat_filter(edges, probe(nodes, q, seed + 101 * (k + 1)), alpha, order, t, scale, settle) for k, (t, q) in enumerate(zip(times, shares, strict=True)) if q]
    return row_normalize(side_by_side(*parts))


def lazy_sketch(edges: DataFrame, x: DataFrame, alpha: dict[int, float], steps: int, last: int = 1, settle=settled) -> DataFrame:
    """The mean of the last smoothing steps, its columns centred, then its rows normalised."""
    kept, names = [], columns(x)
    for k in range(steps):
        x = settle(lazy_smoothing(edges, x, alpha))
        if k >= steps - last:
            kept.append((1.0 / last, x))
    mean = combine(*kept)
    centre = mean.agg(*[F.avg(c).alias(f"__{c}") for c in names])
    return row_normalize(mean.join(F.broadcast(centre)).select("node_id", *[(F.col(c) - F.col(f"__{c}")).alias(c) for c in names]))


def lowpass_sketch(edges: DataFrame, nodes: DataFrame, alpha: dict[int, float], method: str = "lazy", dim: int = 16, order: int = 5, times: tuple[float, ...] = (1.0,), last: int = 1, seed: int = 0, settle=settled) -> DataFrame:
    """The sketch of a method: `lazy` (order smoothing steps) or `chebyshev_heat`."""
    if method == "lazy":
        return lazy_sketch(edges, probe(nodes, dim, seed), alpha, order, last, settle)
    if method == "chebyshev_heat":
        return heat_sketches(edges, nodes, alpha, dim, order, list(times), seed=seed, settle=settle)
    raise ValueError(f"no sketch method {method}")


def feature_basis(nodes: DataFrame, features: DataFrame, most: int = 32, seed: int = 0) -> DataFrame:
    """A dense table of the nodes' features: those of a type that is too wide times a Gaussian matrix, others filled up with
    zeros; nodes without features are zero. Its width is that of the widest type, at most `most`."""
    q = min(most, features.agg(F.max(F.size("x"))).first()[0] or 1)
    at = lambda j: F.coalesce(F.get("x", F.lit(j)), F.lit(0.0))
    drawn = lambda j: F.aggregate(F.transform("x", lambda v, i: v * gaussian(i.cast("long"), j, seed)), F.lit(0.0), lambda s, v: s + v) / float(q) ** 0.5
    rows = features.select("node_id", *[F.when(F.size("x") <= q, at(j)).otherwise(drawn(j)).alias(c) for j, c in enumerate(width(q))])
    return nodes.select("node_id").join(rows, "node_id", "left").na.fill(0.0, width(q))


def relation_energy(edges: DataFrame, x: DataFrame, eps: float = SMOOTH, share: float | None = None, seed: int = 0) -> DataFrame:
    """(rel_id, volume, energy): weight, and the degree-scaled Dirichlet energy of x over its square norm. With a share only
    so many of the edges, by a hash, are looked at, and the sum is scaled up."""
    from ..functions import mixed

    s = edges.groupBy("rel_id", "src").agg(F.sum("w").alias("ds"))
    d = edges.groupBy("rel_id", "dst").agg(F.sum("w").alias("dd"))
    names = columns(x)
    a = x.select(F.col("node_id").alias("src"), *[F.col(c).alias(f"a{c}") for c in names])
    b = x.select(F.col("node_id").alias("dst"), *[F.col(c).alias(f"b{c}") for c in names])
    seen = edges if share is None else edges.where(mixed(F.col("src") * 31 + F.col("dst"), F.col("rel_id"), seed) < int(share * 2147483647))
    diffs = [F.col(f"a{c}") / F.sqrt(F.col("ds") + eps) - F.col(f"b{c}") / F.sqrt(F.col("dd") + eps) for c in names]
    t = F.lit(square_norm(x) + eps)
    energy = seen.join(s, ["rel_id", "src"]).join(d, ["rel_id", "dst"]).join(a, "src").join(b, "dst").groupBy("rel_id").agg((F.sum(F.col("w") * row_sum([e * e for e in diffs])) / t).alias("energy"), F.count(F.lit(1)).alias("seen"))
    whole = edges.groupBy("rel_id").agg(F.sum("w").alias("volume"), F.count(F.lit(1)).alias("n"))
    return whole.join(energy, "rel_id", "left").select("rel_id", "volume", F.coalesce(F.col("energy") * F.col("n") / F.col("seen"), F.lit(0.0)).alias("energy"))


def relation_weights(energy: DataFrame, method: str = "inverse_energy", eta: float = 0.5, gamma: float | None = None, eps: float = SMOOTH, low: float | None = None, high: float | None = None, temperature: float = 1.0, mix: float = 0.0, smoothing: float | None = None) -> DataFrame:
    """(rel_id, alpha) that sum to 1, from relation_energy; a total of zero gives equal weights.

    volume ** eta, over energy ** gamma but for the first two methods; gamma is 1, in the methods of the root 0.5. Weights are
    cut to [low, high], by default [0, 0.5] and [0, 0.75] in the clipped and the capped method, and scaled again. `smoothed`
    is the softmax of the logarithms over a temperature, mixed with equal weights. feature_smoothness is inverse_energy on an
    energy of feature_basis(). The table has one row for each relation, so its windows are over a handful of rows.
    """
    gamma = gamma if gamma is not None else 0.5 if method in ("inverse_sqrt", "capped_inverse_sqrt") else 1.0
    one = W.partitionBy(F.lit(0))
    vol, e = F.col("volume") + eps, F.col("energy") + eps
    over = lambda c: F.sum(c).over(one)
    inverse = F.pow(vol, eta) / F.pow(e, gamma)
    logs = (eta * F.log(vol) - gamma * F.log(F.col("energy") + (eps if smoothing is None else smoothing) + eps)) / max(temperature, 1e-6)
    raw = {"uniform": F.lit(1.0), "volume": F.pow(vol, eta), "smoothed": logs}.get(method, inverse)
    if method not in ("uniform", "volume", "smoothed", "inverse_energy", "inverse_energy_clipped", "inverse_sqrt", "capped_inverse_sqrt", "feature_smoothness"):
        raise ValueError(f"no weighting {method}")
    out = energy.withColumn("r", raw)
    count = F.count(F.lit(1)).over(one)
    share = lambda c: F.when(over(c) > 0, c / over(c)).otherwise(1.0 / count)
    if method == "smoothed":
        out = out.withColumn("r", F.exp(F.col("r") - F.max("r").over(one)))
    out = out.withColumn("alpha", share(F.col("r")))
    if method == "smoothed" and mix:
        out = out.withColumn("alpha", (1 - mix) * F.col("alpha") + mix / count)
    if method in ("inverse_energy_clipped", "capped_inverse_sqrt"):
        low, high = low or 0.0, high if high is not None else 0.75 if method == "capped_inverse_sqrt" else 0.5
    if low is not None or high is not None:
        cut = F.greatest("alpha", F.lit(float(low))) if low is not None else F.col("alpha")
        out = out.withColumn("r", F.least(cut, F.lit(float(high))) if high is not None else cut).withColumn("alpha", share(F.col("r")))
    return out.select("rel_id", "alpha")


def simhash(x: DataFrame, nodes: DataFrame, bits: int = 8, seed: int = 1) -> DataFrame:
    """(node_id, bucket): bit b is 1 where the row's product with plane b is not negative; keys hold type and partition too."""
    planes = [row_sum([F.col(c) * sign(F.lit(j).cast("long"), b, seed) for j, c in enumerate(columns(x))]) for b in range(bits)]
    value = row_sum([F.when(F.round(p, 9) >= 0, float(1 << b)).otherwise(0.0) for b, p in enumerate(planes)]).cast("long")
    key = F.shiftleft(F.col("type_id").cast("long"), 48).bitwiseOR(F.shiftleft(F.col("part_id").cast("long"), bits)).bitwiseOR(F.col("hash"))
    return x.select("node_id", value.alias("hash")).join(nodes, "node_id").select("node_id", key.alias("bucket"))


# --- metapaths: a path is (name, start type, steps), steps a list of (relation, direction)


def closed_paths(relations: list, most: int = 3) -> list[tuple[str, int, list[tuple[int, str]]]]:
    """Paths from a type over one relation and back, of relations (rel_id, name, src_type, dst_type) between two types in the
    order of their ids, both ways; of graphs with none such, loops over relations within a type."""
    out = []
    for r in sorted(relations, key=lambda r: r.rel_id):
        if r.src_type != r.dst_type:
            there, back = (r.rel_id, "forward"), (r.rel_id, "backward")
            out += [(f"{r.name}:source", r.src_type, [there, back]), (f"{r.name}:target", r.dst_type, [back, there])]
    out = out or [(f"{r.name}:loop", r.src_type, [(r.rel_id, "forward")]) for r in sorted(relations, key=lambda r: r.rel_id)]
    return out[:most]


def metapath_step(edges: DataFrame, nodes: DataFrame, x: DataFrame, path) -> DataFrame:
    """x of the start type carried along a path."""
    _, start, steps = path
    x = masked(x, nodes, start)
    for rel, direction in steps:
        x = spmm(edges.where(F.col("rel_id") == rel), x, direction).drop("rel_id")
    return x


def metapath_energy(edges: DataFrame, x: DataFrame, steps: list[tuple[int, str]], eps: float = 0.0) -> DataFrame:
    """(energy): <x, (I - S_m) x> over <x, x> for a closed path of relation steps."""
    y = x
    for rel, direction in steps:
        y = spmm(edges.where(F.col("rel_id") == rel), y, direction).drop("rel_id")
    names = columns(x)
    both = x.join(y.select("node_id", *[F.col(c).alias(f"y{c}") for c in names]), "node_id", "left")
    rest = row_sum([F.col(c) * (F.col(c) - F.coalesce(f"y{c}", F.lit(0.0))) for c in names])
    norm = row_sum([F.col(c) * F.col(c) for c in names])
    return both.agg((F.sum(rest) / F.greatest(F.sum(norm) + eps, F.lit(EPS))).alias("energy"))


def metapath_weights(edges: DataFrame, raw_edges: DataFrame, nodes: DataFrame, x: DataFrame, paths: list, method: str = "inverse_energy", eta: float = 0.5, gamma: float = 1.0, eps: float = SMOOTH, manual: dict[str, float] | None = None) -> dict[str, float]:
    """Path name -> weight; the weights sum to 1. A path's volume is the geometric mean of its relations' weight, its energy
    that of x on its start type, not below 0. One row for each path reaches the driver."""
    volume = {r.rel_id: r.v for r in raw_edges.groupBy("rel_id").agg(F.sum("w").alias("v")).collect()}
    raw = {}
    for name, start, steps in paths:
        vol = math.exp(sum(math.log(max(volume.get(r, 0.0), 0.0) + eps) for r, _ in steps) / len(steps))
        if method == "manual":
            raw[name] = (manual or {}).get(name, 1.0)
        elif method == "uniform":
            raw[name] = 1.0
        elif method == "volume":
            raw[name] = (vol + eps) ** eta
        else:
            own = x.join(nodes.where(F.col("type_id") == start).select("node_id"), "node_id", "left_semi")
            energy = max(metapath_energy(edges, own, steps, eps).first()[0] or 0.0, 0.0)
            raw[name] = (vol + eps) ** eta / (energy + eps) ** gamma
    total = sum(max(v, 0.0) for v in raw.values())
    return {k: max(v, 0.0) / total if total > 0 else 1.0 / len(raw) for k, v in raw.items()}


def metapath_sketch(edges: DataFrame, nodes: DataFrame, paths: list, dim: int, seed: int = 0) -> DataFrame:
    """`dim` columns dealt out over the paths: each path carries a probe of its own; rows are normalised within a path."""
    shares = [dim // len(paths) + (k < dim % len(paths)) for k in range(len(paths))]
    base = nodes.select("node_id")
    parts = []
    for k, (path, q) in enumerate(zip(paths, shares, strict=True)):
        if q:
            y = metapath_step(edges, nodes, probe(nodes, q, seed + 101 * (k + 1)), path)
            parts.append(row_normalize(base.join(y, "node_id", "left").na.fill(0.0, width(q))))
    return side_by_side(*parts)


def fused_with_paths(edges: DataFrame, nodes: DataFrame, x: DataFrame, alpha: dict[int, float], paths: list, beta: dict[str, float], share: float) -> DataFrame:
    """The fused operator of relations and paths: relation weights are scaled by 1 - share, path weights by share."""
    parts = [(1.0, fused(edges, x, {r: a * (1.0 - share) for r, a in alpha.items()}))]
    return combine(*parts, *[(share * beta[p[0]], metapath_step(edges, nodes, x, p)) for p in paths])
