"""The queries over the canonical graph: name -> (DataFrame of (spark, sf_dir), DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import oracle as O
from .functions import mixed, rounded, settled
from .graph import HeteroGraph, from_tables, neighbours
from .operators import candidates as C
from .operators import classify as K
from .operators import coarsen as A
from .operators import linalg as L
from .operators import matching as M
from .operators import metrics as D
from .operators import prune as P
from .operators import scoring as S
from .operators import sketch as Z
from .operators import support as T

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}
EQUAL = {r: 1.0 / 11 for r in range(11)}
Q = 2


_WC = f"wc AS MATERIALIZED (SELECT *, ({O.mixed('i + j', '2')} % 1000) / 1000.0::DOUBLE AS cost FROM (SELECT type_id, part_id, node_id AS i, unnest([lead(node_id, 1) OVER w, lead(node_id, 2) OVER w]) AS j FROM nodes WINDOW w AS (PARTITION BY type_id, part_id ORDER BY node_id)) WHERE j IS NOT NULL)"
# window pairs with a source that a hash gives, so that guards have something to do
_HS = f"(CASE WHEN {O.mixed('i + j', '5')} % 10 < 6 THEN 'onehop' ELSE 'bucket' END)"
_GC = f"gc AS MATERIALIZED (SELECT i, j, type_id, {_HS} AS source, ({O.mixed('i + j', '7')} % 1000) / 1000.0::DOUBLE * (CASE WHEN {_HS} = 'onehop' THEN 9 ELSE 1 END) AS spec, cost FROM wc)"


def query(body: str | None = None):
    def add(f):
        text = body and body.replace("{wc}", _WC).replace("{gc}", _GC)
        REGISTRY[f.__name__] = (lambda spark, sf_dir: f(from_tables(spark, sf_dir)), O.sql(text) if text else None)
        return f

    return add


def kept(g: HeteroGraph) -> HeteroGraph:
    """g with its nodes and edges settled, for queries that read them many times."""
    return HeteroGraph(settled(g.nodes), settled(g.edges), g.relations, g.features)


def x_of(g: HeteroGraph) -> DataFrame:
    return L.probe(g.nodes, Q)


def sx_of(g: HeteroGraph) -> DataFrame:
    return L.fused(L.normalized(g.edges), x_of(g), EQUAL)


def pairs_of(g: HeteroGraph) -> DataFrame:
    return C.fallback(g.nodes).select("i", "j").join(g.nodes.select(F.col("node_id").alias("i"), "type_id", "part_id"), "i")


def assignment_of(g: HeteroGraph) -> DataFrame:
    return M.from_matching(pairs_of(g).select("i", "j"), g.nodes)


def coarse_of(g: HeteroGraph) -> DataFrame:
    return A.coarse_edges(g.edges, assignment_of(g))


def table_of(g: HeteroGraph) -> DataFrame:
    """What pair terms need of each node: the sketch is one product of a probe, the conv response one of the sketch."""
    g = kept(g)
    e = settled(L.normalized(g.edges))
    z = settled(L.fused(e, x_of(g), EQUAL))
    return S.node_table(g.nodes, g.edges, list(EQUAL), g.features, z, L.fused(e, z, EQUAL))


def scored_of(g: HeteroGraph) -> DataFrame:
    return S.pair_terms(pairs_of(g).select("i", "j"), table_of(g))


def costs_of(g: HeteroGraph) -> DataFrame:
    return S.cost(scored_of(g)).withColumn("cost", rounded(F.col("cost"), 9))


def logits_of(g: HeteroGraph) -> DataFrame:
    """(node_id, label, scores): products of embeddings with the class centroids, over 8."""
    long = g.features.where("type_id = 8").select("node_id", F.posexplode("x").alias("j", "v")).join(g.nodes.select("node_id", "label"), "node_id")
    centres = long.groupBy("label", "j").agg(F.avg("v").alias("c")).withColumnRenamed("label", "k")
    s = long.join(F.broadcast(centres), "j").groupBy("node_id", "label", "k").agg(F.round(F.sum(F.col("v") * F.col("c")) / 8, 6).alias("s"))
    packed = s.groupBy("node_id", "label").agg(F.array_sort(F.collect_list(F.struct("k", "s"))).alias("a"))
    return packed.select("node_id", "label", F.transform("a", lambda e: e["s"]).alias("scores"))


def importance_of(g: HeteroGraph) -> DataFrame:
    f = settled(T.support_features(g.edges, g.nodes, 0))
    return T.importance(f, {"degree": 0.5, "anchors": 0.25, "purity": 0.25}).join(f.select("node_id", "type_id", "degree"), "node_id").withColumn("importance", F.round("importance", 9))


def dense(df: DataFrame, digits: int = 6) -> DataFrame:
    return L.long(df).select("node_id", F.col("j").cast("int").alias("j"), rounded(F.col("v"), digits).alias("v"))


DENSE = "SELECT node_id, j, " + O.r("sum(v)") + " AS v FROM ({}) GROUP BY 1, 2"


# --- sources, model, validation


@query("SELECT rel_id, src, dst, sum(w) AS w FROM coarse GROUP BY 1, 2, 3")
def coarse_edges(g):
    return coarse_of(g)


@query("SELECT node_id, type_id, label, part_id FROM nodes")
def graph_nodes(g):
    return g.nodes


@query("SELECT rel_id, src, dst, w FROM edges")
def graph_edges(g):
    return g.edges


@query("SELECT type_id, count(*) AS n, sum((label >= 0)::BIGINT)::BIGINT AS labelled FROM nodes GROUP BY 1")
def node_count_by_type(g):
    return g.nodes.groupBy("type_id").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("label") >= 0).cast("long")).alias("labelled"))


@query("SELECT rel_id, m AS n, vol AS volume FROM ecount")
def edge_count_by_relation(g):
    return g.edges.groupBy("rel_id").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("volume"))



@query("SELECT node_id, type_id, row_number() OVER (PARTITION BY type_id ORDER BY node_id) - 1 AS local_id FROM nodes")
def type_local_index(g):
    return g.type_local_index().select("node_id", "type_id", "local_id")


@query("SELECT rel_id, count(*) AS n FROM edges WHERE src // 10000000000 IN (0, 1, 4) AND dst // 10000000000 IN (0, 1, 4) GROUP BY 1")
def induced_subgraph(g):
    return g.induced(g.nodes.where("type_id IN (0, 1, 4)")).edges.groupBy("rel_id").agg(F.count(F.lit(1)).alias("n"))


# --- message passing


@query("SELECT rel_id, node_id, " + O.r("sum(s)") + " AS src_degree, " + O.r("sum(d)") + " AS dst_degree FROM (SELECT rel_id, src AS node_id, w AS s, 0.0::DOUBLE AS d FROM edges UNION ALL SELECT rel_id, dst, 0.0::DOUBLE, w FROM edges) GROUP BY 1, 2")
def relation_degrees(g):
    return L.relation_degrees(g.edges)


@query("SELECT rel_id, src, dst, " + O.r("w") + " AS w FROM ne")
def normalized_edge_weights(g):
    return L.normalized(g.edges).withColumn("w", rounded(F.col("w")))


@query("SELECT rel_id, src, dst, " + O.r("w / sum(w) OVER (PARTITION BY rel_id, src)", 9) + " AS w FROM edges")
def row_normalized_transition(g):
    return L.row_normalized(g.edges).withColumn("w", rounded(F.col("w"), 9))


@query("SELECT rel_id, src, dst, " + O.r("w / sum(w) OVER (PARTITION BY rel_id, dst)", 9) + " AS w FROM edges")
def dst_normalized_step(g):
    return L.row_normalized(g.edges, "dst").withColumn("w", rounded(F.col("w"), 9))


def _spmm(direction):
    def f(g):
        y = L.spmm(L.normalized(g.edges), x_of(g), direction)
        return y.select("rel_id", "node_id", F.posexplode(F.array(*L.columns(y))).alias("j", "v")).select("rel_id", "node_id", "j", rounded(F.col("v")).alias("v"))

    return f


_FWD, _BWD = "SELECT rel_id, dst AS node_id, j, w * v AS v FROM ne JOIN x ON node_id = src", "SELECT rel_id, src AS node_id, j, w * v AS v FROM ne JOIN x ON node_id = dst"
for _name, _dir, _body in (("spmm_forward", "forward", _FWD), ("spmm_transpose", "backward", _BWD), ("spmm_symmetric", "symmetric", f"SELECT rel_id, node_id, j, 0.5::DOUBLE * v AS v FROM ({_FWD} UNION ALL {_BWD})")):
    _f = _spmm(_dir)
    _f.__name__ = _name
    query(f"SELECT rel_id, node_id, j, {O.r('sum(v)')} AS v FROM ({_body}) GROUP BY 1, 2, 3")(_f)


@query(DENSE.format("SELECT node_id, j, v FROM sx"))
def fused_operator(g):
    return dense(sx_of(g))


@query(DENSE.format("SELECT b AS node_id, j, 0.5::DOUBLE * w * v AS v FROM (SELECT src AS a, dst AS b, w FROM ne1 UNION ALL SELECT dst, src, w FROM ne1) JOIN x ON node_id = a"))
def single_relation_sum_operator(g):
    return dense(L.fused(L.normalized(g.edges, ()), x_of(g), dict.fromkeys(range(11), 1.0)))


@query(DENSE.format("SELECT node_id, j, v FROM x UNION ALL SELECT node_id, j, -v FROM sx"))
def fused_laplacian(g):
    return dense(L.laplacian(L.normalized(g.edges), x_of(g), EQUAL))


@query(DENSE.format("SELECT node_id, j, 0.5::DOUBLE * v AS v FROM x UNION ALL SELECT dst, j, 0.5::DOUBLE * w * v / 11 FROM ne JOIN x ON node_id = src"))
def lazy_smoothing(g):
    return dense(L.lazy_smoothing(L.normalized(g.edges), x_of(g), EQUAL))


@query(DENSE.format("SELECT e.dst AS node_id, j, e.w * m.v AS v FROM (SELECT dst AS node_id, j, sum(w * v) AS v FROM ne JOIN x ON node_id = src WHERE rel_id = 0 GROUP BY 1, 2) m JOIN (SELECT * FROM ne WHERE rel_id = 2) e ON e.src = m.node_id"))
def metapath_operator(g):
    return dense(L.metapath(L.normalized(g.edges), x_of(g), [(0, "forward"), (2, "forward")]))


@query("SELECT node_id, mass FROM mass")
def incident_weight_mass(g):
    return L.incident_mass(g.edges)


_PR = "WITH share AS MATERIALIZED (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM (SELECT src, dst, w FROM edges UNION ALL SELECT dst, src, w FROM edges)), cnt AS (SELECT count(*)::DOUBLE AS n FROM nodes), r0 AS MATERIALIZED (SELECT node_id, 1.0 / n AS rank, node_id IN (SELECT src FROM share) AS linked FROM nodes, cnt)"
for _k in range(3):
    _PR += f", r{_k + 1} AS MATERIALIZED (SELECT r{_k}.node_id, 0.15::DOUBLE / n + 0.85::DOUBLE * (coalesce(got, 0) + lost / n) AS rank, linked FROM r{_k} LEFT JOIN (SELECT dst AS node_id, sum(p * rank) AS got FROM share JOIN r{_k} ON node_id = src GROUP BY 1) q ON q.node_id = r{_k}.node_id, cnt, (SELECT coalesce(sum(rank) FILTER (NOT linked), 0) AS lost FROM r{_k}))"


@query(_PR + f" SELECT node_id, {O.r('rank / sum(rank) OVER ()', 9)} AS rank FROM r3")
def pagerank_3iter(g):
    return L.pagerank(g.nodes, g.edges, rounds=3).withColumn("rank", rounded(F.col("rank"), 9))


@query("SELECT a AS rel_a, b AS rel_b, true AS is_reverse FROM (VALUES (0, 1), (2, 3), (4, 5)) t(a, b)")
def reverse_relation_check(g):
    spark = g.edges.sparkSession
    flag = lambda a, b: str(L.is_reverse(g.edges.where(F.col("rel_id") == a), g.edges.where(F.col("rel_id") == b))).lower()
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"({a}, {b}, {flag(a, b)})" for a, b in ((0, 1), (2, 3), (4, 5))) + " AS t(rel_a, rel_b, is_reverse)")


# --- sketches


@query("SELECT node_id, j, v FROM x")
def rademacher_probe(g):
    return dense(x_of(g))


@query("SELECT k::INTEGER AS k, " + O.r("(CASE WHEN k = 0 THEN 1 ELSE 2 END) / 128.0::DOUBLE * sum(exp(-0.5::DOUBLE * (cos(pi() * (m + 0.5::DOUBLE) / 128) + 1)) * cos(k * pi() * (m + 0.5::DOUBLE) / 128))", 9) + " AS c FROM range(6) a(k), range(128) b(m) GROUP BY k")
def chebyshev_coefficients(g):
    c = Z.chebyshev_coefficients(5, 0.5)
    return g.nodes.sparkSession.sql("SELECT * FROM VALUES " + ", ".join(f"({k}, CAST({v!r} AS DOUBLE))" for k, v in enumerate(c)) + " AS t(k, c)").withColumn("c", rounded(F.col("c"), 9))


_C = Z.chebyshev_coefficients(2, 0.5)
_HEAT = (
    "WITH ssx AS (SELECT b AS node_id, j, sum(0.5::DOUBLE * turned.w * v) / 11 AS v FROM turned JOIN sx ON node_id = a GROUP BY 1, 2), "
    f"h AS (SELECT node_id, j, sum(v) AS v FROM (SELECT node_id, j, {_C[0] - _C[2]!r}::DOUBLE * v AS v FROM x UNION ALL SELECT node_id, j, {-_C[1]!r}::DOUBLE * v FROM sx UNION ALL SELECT node_id, j, {2 * _C[2]!r}::DOUBLE * v FROM ssx) GROUP BY 1, 2) "
)


@query(_HEAT + f"SELECT node_id, j, {O.r('v / greatest(sqrt(sum(v * v) OVER (PARTITION BY node_id)), 1e-12)')} AS v FROM h")
def chebyshev_heat_sketch(g):
    return dense(Z.heat_sketch(L.normalized(g.edges), x_of(g), EQUAL, 2, 0.5))


@query(
    "WITH l1 AS (SELECT node_id, j, sum(v) AS v FROM (SELECT node_id, j, 0.5::DOUBLE * v AS v FROM x UNION ALL SELECT dst, j, 0.5::DOUBLE * w * v / 11 FROM ne JOIN x ON node_id = src) GROUP BY 1, 2), "
    "l2 AS (SELECT node_id, j, sum(v) AS v FROM (SELECT node_id, j, 0.5::DOUBLE * v AS v FROM l1 UNION ALL SELECT dst, j, 0.5::DOUBLE * w * v / 11 FROM ne JOIN l1 ON node_id = src) GROUP BY 1, 2), "
    "c AS (SELECT node_id, j, v - avg(v) OVER (PARTITION BY j) AS v FROM l2) "
    f"SELECT node_id, j, {O.r('v / greatest(sqrt(sum(v * v) OVER (PARTITION BY node_id)), 1e-12)')} AS v FROM c"
)
def lazy_sketch(g):
    return dense(Z.lazy_sketch(L.normalized(g.edges), x_of(g), EQUAL, 2))


_ENERGY = "SELECT rel_id, sum(e.w) / 1 AS volume, sum(e.w * (a.v / sqrt(ds + 1e-8) - b.v / sqrt(dd + 1e-8)) ** 2) / (SELECT sum(v * v) + 1e-8 FROM x) AS energy FROM (SELECT *, sum(w) OVER (PARTITION BY rel_id, src) AS ds, sum(w) OVER (PARTITION BY rel_id, dst) AS dd FROM edges) e JOIN x a ON a.node_id = src JOIN x b ON b.node_id = dst AND b.j = a.j GROUP BY rel_id"


@query(f"SELECT rel_id, {O.r('volume / 2')} AS volume, {O.r('energy')} AS energy FROM ({_ENERGY})")
def relation_energy(g):
    e = Z.relation_energy(g.edges, x_of(g))
    return e.select("rel_id", rounded(F.col("volume")).alias("volume"), rounded(F.col("energy")).alias("energy"))


_V, _E = "(volume / 2 + 1e-8)", "(energy + 1e-8)"
_RAW = {"uniform": "1.0::DOUBLE", "volume": f"sqrt({_V})", "inverse_energy": f"sqrt({_V}) / {_E}", "inverse_energy_clipped": f"sqrt({_V}) / {_E}", "inverse_sqrt": f"sqrt({_V}) / sqrt({_E})", "capped_inverse_sqrt": f"sqrt({_V}) / sqrt({_E})", "smoothed": f"exp(0.5::DOUBLE * ln({_V}) - ln(energy + 2e-8))", "feature_smoothness": f"sqrt({_V}) / {_E}"}
_THEN = {"inverse_energy_clipped": "least(alpha, 0.5::DOUBLE)", "capped_inverse_sqrt": "least(alpha, 0.75::DOUBLE)"}
# features as a dense table: eight columns, wider ones times a Gaussian matrix
_U = lambda s: f"(({O.mixed('(k - 1)', 'j', s)} + 0.5::DOUBLE) / 2147483647.0::DOUBLE)"
_BASIS = f"fb AS MATERIALIZED (SELECT n.node_id, j::INTEGER AS j, coalesce(CASE WHEN len(x) <= 8 THEN x[j + 1] ELSE list_sum(list_transform(generate_series(1, len(x)), lambda k: x[k] * sqrt(-2.0::DOUBLE * ln({_U(0)})) * cos(2.0::DOUBLE * pi() * {_U(1)}))) / sqrt(8.0::DOUBLE) END, 0) AS v FROM nodes n LEFT JOIN feats f ON f.node_id = n.node_id, range(8) t(j))"
for _m, _raw in _RAW.items():

    def _weights(g, m=_m):
        x = Z.feature_basis(g.nodes, g.features, 8) if m == "feature_smoothness" else x_of(g)
        return Z.relation_weights(Z.relation_energy(g.edges, x), m).withColumn("alpha", rounded(F.col("alpha")))

    _weights.__name__ = f"relation_weights_{_m}"
    _energy, _with = (_ENERGY.replace("FROM x)", "FROM fb)").replace("JOIN x a", "JOIN fb a").replace("JOIN x b", "JOIN fb b").replace("sum(e.w) / 1 AS volume", "2 * sum(e.w) / 8 AS volume"), f"WITH {_BASIS} ") if _m == "feature_smoothness" else (_ENERGY, "")
    _body = f"SELECT rel_id, raw / sum(raw) OVER () AS alpha FROM (SELECT rel_id, {_raw} AS raw FROM ({_energy}))"
    if _m in _THEN:
        _body = f"SELECT rel_id, r / sum(r) OVER () AS alpha FROM (SELECT rel_id, {_THEN[_m]} AS r FROM ({_body}))"
    query(f"{_with}SELECT rel_id, {O.r('alpha')} AS alpha FROM ({_body})")(_weights)

_BUCKETS = f"SELECT node_id, (n.type_id::BIGINT << 48) | (n.part_id::BIGINT << 4) | sum(CASE WHEN p >= 0 THEN (1 << b) ELSE 0 END)::BIGINT AS bucket FROM (SELECT node_id, b, round(sum(v * ({O.sign('j', 'b', 1)})), 9) AS p FROM sx, range(4) t(b) GROUP BY 1, 2) JOIN nodes n USING (node_id) GROUP BY node_id, n.type_id, n.part_id"


def buckets_of(g):
    return Z.simhash(sx_of(g), g.nodes, 4)


@query(_BUCKETS)
def simhash_buckets(g):
    return buckets_of(g)


@query("SELECT " + O.r("sum(x.v * (x.v - coalesce(y.v, 0))) / greatest(sum(x.v * x.v), 1e-12)") + " AS energy FROM x LEFT JOIN (SELECT e.dst AS node_id, j, sum(e.w * m.v) AS v FROM (SELECT dst AS node_id, j, sum(w * v) AS v FROM ne JOIN x ON node_id = src WHERE rel_id = 0 GROUP BY 1, 2) m JOIN (SELECT * FROM ne WHERE rel_id = 1) e ON e.src = m.node_id GROUP BY 1, 2) y ON y.node_id = x.node_id AND y.j = x.j")
def metapath_energy(g):
    return Z.metapath_energy(L.normalized(g.edges), x_of(g), [(0, "forward"), (1, "forward")]).withColumn("energy", rounded(F.col("energy")))


# --- candidates

_ONE = "SELECT DISTINCT least(src, dst) AS i, greatest(src, dst) AS j FROM edges JOIN nodes a ON a.node_id = src JOIN nodes b ON b.node_id = dst WHERE a.type_id = b.type_id AND a.part_id = b.part_id AND src <> dst"
_INC = "SELECT DISTINCT middle, n.type_id, n.part_id, endpoint FROM (SELECT src AS middle, dst AS endpoint FROM edges UNION SELECT dst, src FROM edges) JOIN nodes n ON n.node_id = endpoint"
_TWO = f"SELECT DISTINCT i, j FROM (SELECT a.endpoint AS i, b.endpoint AS j, row_number() OVER (PARTITION BY a.middle, a.type_id, a.part_id ORDER BY {O.mixed('a.endpoint + b.endpoint + a.middle', '1')}, a.endpoint, b.endpoint) AS r FROM few a JOIN few b ON a.middle = b.middle AND a.type_id = b.type_id AND a.part_id = b.part_id AND a.endpoint < b.endpoint) WHERE r <= 20"
_FEW = f"few AS MATERIALIZED (SELECT * FROM ({_INC}) WHERE middle <> endpoint QUALIFY row_number() OVER (PARTITION BY middle, type_id, part_id ORDER BY {O.mixed('endpoint + middle')}, endpoint) <= 8)"
_BP = "SELECT node_id AS i, unnest([lead(node_id, 1) OVER w, lead(node_id, 2) OVER w]) AS j FROM bk WINDOW w AS (PARTITION BY bucket ORDER BY node_id)"
_BK = f"bk AS MATERIALIZED ({_BUCKETS})"


def onehop_of(g):
    return C.onehop(g.edges, g.nodes)


def twohop_of(g):
    return C.twohop(g.edges, g.nodes, 8, 20)


def all_candidates(g):
    return onehop_of(g).unionByName(twohop_of(g)).unionByName(C.bucket_pairs(buckets_of(g), 2)).unionByName(C.fallback(g.nodes))


def settled_candidates(g):
    """all_candidates, one source after the other, so that each gives back what it shuffled."""
    g = kept(g)
    buckets = settled(buckets_of(g))
    parts = [settled(p) for p in (onehop_of(g), twohop_of(g), C.bucket_pairs(buckets, 2), C.fallback(g.nodes))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


_ALLC = f"SELECT i, j, 0.0::DOUBLE AS score, 1 AS o, 'onehop' AS source FROM ({_ONE}) UNION ALL SELECT i, j, 0.0::DOUBLE, 2, 'twohop' FROM ({_TWO}) UNION ALL SELECT i, j, 0.0::DOUBLE, 3, 'bucket' FROM ({_BP}) WHERE j IS NOT NULL UNION ALL SELECT i, j, 1e6::DOUBLE, 5, 'fallback' FROM pairs"
_CANDS = f"WITH {_FEW}, {_BK}, cands AS MATERIALIZED ({_ALLC})"


@query(f"SELECT i, j, 'onehop' AS source FROM ({_ONE})")
def cand_onehop(g):
    return onehop_of(g).select("i", "j", "source")


@query(f"SELECT middle, type_id, endpoint FROM ({_INC})")
def incident_index(g):
    return C.incident_index(g.edges, g.nodes)


@query(f"SELECT greatest(1, floor(quantile_cont(c, 0.99)))::BIGINT AS cap FROM (SELECT count(*) AS c FROM ({_INC}) GROUP BY middle, type_id HAVING count(*) > 1)")
def degree_cap(g):
    return C.degree_cap(C.incident_index(g.edges, g.nodes))


@query(f"WITH {_FEW} SELECT i, j FROM ({_TWO})")
def cand_twohop_capped(g):
    return twohop_of(g).select("i", "j")


@query(f"WITH {_BK} SELECT i, j FROM ({_BP}) WHERE j IS NOT NULL")
def cand_bucket(g):
    return C.bucket_pairs(buckets_of(g), 2).select("i", "j")


@query(f"WITH {_BK}, pl AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY node_id) AS r FROM bk) SELECT i, j FROM ({_BP}) WHERE j IS NOT NULL UNION SELECT a.node_id, b.node_id FROM pl a, range(4) t(k) JOIN pl b ON b.bucket = xor(a.bucket, (1 << k)) AND a.r = b.r WHERE a.r <= 2 AND a.node_id < b.node_id")
def cand_bucket_multiprobe(g):
    return C.bucket_pairs(buckets_of(g), 2, 4).select("i", "j")


_RP = f"SELECT node_id, k::INTEGER AS j, round(sum(v * ({O.sign('j', 'k', 3)})) / sqrt(2.0::DOUBLE), 6) AS v FROM flat, range(2) t(k) GROUP BY 1, 2"


@query(f"SELECT DISTINCT least(i, j) AS i, greatest(i, j) AS j FROM (SELECT node_id AS i, unnest([lead(node_id, 1) OVER w, lead(node_id, 2) OVER w]) AS j FROM ({_RP}) r JOIN nodes n USING (node_id) WINDOW w AS (PARTITION BY r.j, n.type_id, n.part_id ORDER BY r.v, node_id)) WHERE j IS NOT NULL")
def cand_ann_window(g):
    p = P.random_projection(g.features, 2)
    return C.ann_window(p.select("node_id", *[F.round(c, 6).alias(c) for c in L.columns(p)]), g.nodes, 2).select("i", "j")


@query("SELECT i, j, 1e6::DOUBLE AS score, 'fallback' AS source FROM pairs")
def cand_fallback(g):
    return C.fallback(g.nodes)


@query(f"{_CANDS}, best AS MATERIALIZED (SELECT i, j, min(score) AS score, arg_min(o, score * 10 + o) AS o, arg_min(source, score * 10 + o) AS source FROM cands GROUP BY 1, 2) SELECT b.i, b.j, b.score, b.source FROM best b JOIN (SELECT i, j FROM (SELECT i, j, row_number() OVER (PARTITION BY n ORDER BY score, o, other) AS r FROM (SELECT i AS n, j AS other, * FROM best UNION ALL SELECT j, i, * FROM best)) WHERE r <= 3 GROUP BY i, j HAVING count(*) = 2) k ON k.i = b.i AND k.j = b.j")
def cand_retained_topk(g):
    return C.retain(settled_candidates(g), 3)


@query(f"{_CANDS} SELECT source, count(*) AS n FROM cands GROUP BY 1")
def cand_source_counts(g):
    return C.source_counts(all_candidates(g))


@query(f"{_CANDS} SELECT source, count(DISTINCT n) AS covered FROM (SELECT source, i AS n FROM cands UNION ALL SELECT source, j FROM cands) GROUP BY 1")
def cand_node_coverage(g):
    return C.node_coverage(settled_candidates(g))


# --- scoring


def _term(df, name, digits=6):
    return df.select("i", "j", rounded(F.col(name), digits).alias(name))


@query("SELECT node_id, dim, " + O.r("p") + " AS p FROM profiles")
def relation_profiles(g):
    return S.relation_profiles(g.edges).withColumn("p", rounded(F.col("p")))


@query("SELECT i, j, " + O.r("rel") + " AS rel FROM jsd")
def pair_jsd(g):
    return _term(S.profile_distance(pairs_of(g), S.relation_profiles(g.edges)), "rel")


@query("SELECT i, j, " + O.r("coalesce(l, 0)") + " AS rel FROM pairs LEFT JOIN (SELECT i, j, sum((p - q) ** 2) AS l FROM pp GROUP BY 1, 2) USING (i, j)")
def pair_l2(g):
    return _term(S.profile_distance(pairs_of(g), S.relation_profiles(g.edges), "l2"), "rel")


@query("SELECT i, j, " + O.r("spec") + " AS spec FROM spec")
def pair_spec(g):
    return _term(S.spectral_cost(pairs_of(g), sx_of(g), L.incident_mass(g.edges)), "spec")


@query("SELECT i, j, " + O.r("feat") + " AS feat FROM feat")
def pair_feat(g):
    return _term(S.feature_distance(pairs_of(g), g.features), "feat")


@query("SELECT i, j, " + O.r("boundary") + " AS boundary FROM scored")
def pair_boundary(g):
    return _term(S.boundary_cost(pairs_of(g), S.boundary_risk(g.edges, g.nodes), g.nodes), "boundary")


@query("SELECT i, j, " + O.r("conv") + " AS conv FROM scored")
def pair_conv(g):
    return _term(scored_of(g), "conv")


@query("SELECT i, j, type_id, " + ", ".join(f"{O.r(t)} AS {t}" for t in S.LAMBDAS) + " FROM scored")
def pair_terms(g):
    return scored_of(g).select("i", "j", "type_id", *[rounded(F.col(t)).alias(t) for t in S.LAMBDAS])


@query("SELECT i, j, " + O.r("spec / s") + " AS spec FROM scored, (SELECT CASE WHEN abs(quantile_cont(spec, 0.95)) > 1e-12 THEN abs(quantile_cont(spec, 0.95)) ELSE coalesce(quantile_cont(abs(spec), 0.95) FILTER (abs(spec) > 1e-12), 1e-12) END AS s FROM scored)")
def term_p95(g):
    return _term(S.normalize(scored_of(g), "spec", "p95"), "spec")


@query("SELECT i, j, " + O.r("rel / s") + " AS rel FROM scored, (SELECT greatest(max(m) + 1.4826::DOUBLE * median(abs(rel - m)), 1e-12) AS s FROM scored, (SELECT median(rel) AS m FROM scored))")
def term_median_mad(g):
    return _term(S.normalize(settled(scored_of(g)), "rel", "median_mad"), "rel")


@query("SELECT i, j, " + O.r("(row_number() OVER (ORDER BY round(feat, 9), i, j) - 1) / greatest(count(*) OVER () - 1, 1)") + " AS feat FROM scored")
def term_rank(g):
    return _term(S.normalize(scored_of(g).withColumn("feat", F.round("feat", 9)), "feat", "rank"), "feat")


@query("SELECT i, j, " + O.r("cost") + " AS cost FROM costs")
def pair_cost(g):
    return _term(costs_of(g), "cost")


@query("SELECT i, j, " + O.r("cost + 10 * greatest(rel - (m + 0.02::DOUBLE), 0)") + " AS cost FROM costs, (SELECT min(rel) AS m FROM costs)")
def relation_guard(g):
    return _term(S.relation_guard(costs_of(g)), "cost")


def guarded_costs(g):
    rows = window_costs(g)
    source = F.when(mixed(F.col("i") + F.col("j"), 5) % 10 < 6, "onehop").otherwise("bucket")
    spec = (mixed(F.col("i") + F.col("j"), 7) % 1000) / 1000.0 * F.when(F.col("source") == "onehop", 9).otherwise(1)
    return rows.withColumn("source", source).withColumn("spec", spec)


@query("WITH {wc}, {gc}, t AS (SELECT *, spec > lim + 1e-12 AS high FROM gc JOIN (SELECT type_id, CASE WHEN count(*) FILTER (source = 'bucket') = 0 THEN CASE WHEN count(*) < 8 THEN max(spec) ELSE quantile_cont(spec, 0.95) END WHEN count(*) FILTER (source = 'bucket') < 8 THEN max(spec) FILTER (source = 'bucket') ELSE quantile_cont(spec, 0.95) FILTER (source = 'bucket') END AS lim FROM gc GROUP BY 1) USING (type_id)), e AS (SELECT i AS n, * FROM t UNION ALL SELECT j, * FROM t), have AS (SELECT n, count(*) FILTER (NOT high) AS have FROM e GROUP BY 1), back AS (SELECT DISTINCT i, j FROM (SELECT n, i, j, row_number() OVER (PARTITION BY n ORDER BY spec, i, j) AS r FROM e WHERE high) JOIN have USING (n) WHERE r <= 2 - have) SELECT i, j FROM t WHERE NOT high UNION SELECT i, j FROM back")
def spectral_guard(g):
    return S.spectral_guard(guarded_costs(g)).select("i", "j")


@query("WITH {wc}, {gc} SELECT i, j, " + O.r("cost + greatest(spec - lim, 0)") + " AS cost FROM gc JOIN (SELECT type_id, CASE WHEN count(*) FILTER (source = 'bucket') = 0 THEN CASE WHEN count(*) < 8 THEN max(spec) ELSE quantile_cont(spec, 0.95) END WHEN count(*) FILTER (source = 'bucket') < 8 THEN max(spec) FILTER (source = 'bucket') ELSE quantile_cont(spec, 0.95) FILTER (source = 'bucket') END AS lim FROM gc GROUP BY 1) USING (type_id)")
def spectral_guard_downrank(g):
    return _term(S.spectral_guard(guarded_costs(g), downrank=True), "cost")


@query("WITH {wc}, {gc}, q AS (SELECT quantile_cont(spec, 0.95) FILTER (source = 'bucket') AS q95, avg(spec) FILTER (source = 'onehop') / avg(spec) FILTER (source = 'bucket') AS ratio, avg((source = 'onehop')::INTEGER) AS share, quantile_cont(spec, 0.95) FILTER (source = 'onehop') AS tail FROM gc), k AS (SELECT gc.* FROM gc, q WHERE NOT (source = 'onehop' AND share > 0.3 AND ratio > 4 AND tail > q95 AND spec > q95)), o AS (SELECT i, j FROM (SELECT i, j, row_number() OVER (PARTITION BY n ORDER BY spec, cost, i, j) AS r FROM (SELECT i AS n, * FROM k WHERE source = 'onehop' UNION ALL SELECT j, * FROM k WHERE source = 'onehop')) WHERE r > 1) SELECT k.i, k.j FROM k LEFT JOIN (SELECT DISTINCT i, j, 1 AS gone FROM o) g ON g.i = k.i AND g.j = k.j, q WHERE gone IS NULL OR NOT (share > 0.3 AND ratio > 4 AND tail > q95)")
def source_aware_guard(g):
    return S.source_guard(guarded_costs(g), topk=1).select("i", "j")


@query("WITH {wc}, {gc} SELECT i, j FROM gc, (SELECT quantile_cont(spec, 0.95) FILTER (source = 'bucket') AS q95 FROM gc) WHERE source <> 'onehop' OR spec <= q95 + 1e-12")
def source_policy_filter(g):
    return S.source_policy(guarded_costs(g)).select("i", "j")


@query("SELECT term, count(x) AS n, " + ", ".join(f"{O.r(e)} AS {n}" for e, n in (("avg(x)", "mean"), ("quantile_cont(x, 0.5)", "p50"), ("quantile_cont(x, 0.95)", "p95"), ("quantile_cont(x, 0.99)", "p99"))) + " FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS term, {w}::DOUBLE * {t} AS x FROM scored" for t, w in S.LAMBDAS.items()) + ") GROUP BY 1")
def score_term_contributions(g):
    s = S.term_contributions(scored_of(g))
    return s.select("term", "n", *[rounded(F.col(c)).alias(c) for c in ("mean", "p50", "p95", "p99")])


@query("SELECT term, count(x) AS n, " + ", ".join(f"{O.r(e)} AS {n}" for e, n in (("avg(x)", "mean"), ("quantile_cont(x, 0.5)", "p50"), ("quantile_cont(x, 0.95)", "p95"), ("quantile_cont(x, 0.99)", "p99"))) + " FROM (SELECT 'spec' AS term, spec AS x FROM scored UNION ALL SELECT 'rel', rel FROM scored) GROUP BY 1")
def score_term_summary(g):
    s = S.term_summary(scored_of(g), ("spec", "rel"))
    return s.select("term", "n", *[rounded(F.col(c)).alias(c) for c in ("mean", "p50", "p95", "p99")])


# --- matching

_CHAIN = "SELECT i, j, cost FROM costs"


def window_costs(g):
    """Pairs with up to two neighbours in the order of ids, so that matchers have a choice; the cost is a hash."""
    rows = neighbours(g.nodes.select("node_id", "type_id", "part_id"), ["type_id", "part_id"], "node_id", 2)
    return rows.withColumn("cost", (mixed(F.col("i") + F.col("j"), 2) % 1000) / 1000.0)




@query(f"WITH {_WC}, b AS MATERIALIZED (SELECT n, other, cost FROM (SELECT i AS n, j AS other, cost FROM wc UNION ALL SELECT j, i, cost FROM wc) QUALIFY row_number() OVER (PARTITION BY n ORDER BY cost, other) = 1) SELECT a.n AS i, a.other AS j, a.cost FROM b a JOIN b c ON a.other = c.n AND c.other = a.n WHERE a.n < a.other")
def match_mutual_best(g):
    return M.mutual_best(window_costs(g))



@query()
def match_greedy_cluster(g):
    return M.greedy_cluster(window_costs(g), ["type_id", "part_id"])


@query("SELECT min(node_id) AS i, max(node_id) AS j FROM (SELECT node_id, n.type_id, n.part_id, row_number() OVER (PARTITION BY n.type_id, n.part_id ORDER BY coalesce(m.mass, 0), node_id) AS r FROM nodes n LEFT JOIN mass m USING (node_id)) GROUP BY type_id, part_id, (r - 1) // 2 HAVING count(*) = 2")
def baseline_degree_order(g):
    rows = g.nodes.join(L.incident_mass(g.edges), "node_id", "left").na.fill(0.0, ["mass"])
    return M.paired_by(rows, "mass")


@query(f"SELECT min(node_id) AS i, max(node_id) AS j FROM (SELECT node_id, type_id, part_id, row_number() OVER (PARTITION BY type_id, part_id ORDER BY {O.mixed('node_id', '0', 5)}, node_id) AS r FROM nodes) GROUP BY type_id, part_id, (r - 1) // 2 HAVING count(*) = 2")
def baseline_random(g):
    return M.paired_by(g.nodes.withColumn("h", mixed(F.col("node_id"), 0, 5)), "h")


@query(f"WITH {_BK} SELECT node_id, min(node_id) OVER (PARTITION BY bucket, (r - 1) // 4) AS super_id FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY node_id) AS r FROM bk)")
def typed_hash_lsh(g):
    return M.typed_hash_clusters(buckets_of(g))


@query("SELECT node_id, CASE WHEN type_id = 0 THEN node_id ELSE min(node_id) OVER (PARTITION BY type_id, super_id, CASE WHEN type_id = 0 THEN node_id END) END AS super_id FROM asg JOIN nodes USING (node_id)")
def target_preserving_assignment(g):
    return M.target_preserving(assignment_of(g), g.nodes, 0)


@query("WITH e AS MATERIALIZED (SELECT rel_id, src AS node_id FROM edges UNION ALL SELECT rel_id, dst FROM edges), d AS (SELECT node_id, count(*) AS deg FROM e GROUP BY 1), few AS (SELECT rel_id FROM ecount WHERE m < 0.05 * (SELECT sum(m) FROM ecount)) SELECT n.node_id, coalesce(deg > (SELECT quantile_cont(deg, 0.99) FROM d), false) OR n.node_id IN (SELECT node_id FROM e WHERE rel_id IN (SELECT rel_id FROM few)) AS protected FROM nodes n LEFT JOIN d USING (node_id)")
def terminal_guard_flags(g):
    return M.terminal_flags(g.edges, g.nodes)


# --- coarse graphs and their metrics


def _packed(df, digits=9):
    return df.select("node_id", F.posexplode("x").alias("j", "v")).select("node_id", F.col("j").cast("int").alias("j"), rounded(F.col("v"), digits).alias("v"))


@query("SELECT super_id AS node_id, j, " + O.r("avg(v)", 9) + " AS v FROM flat JOIN asg USING (node_id) GROUP BY 1, 2")
def coarse_features_mean(g):
    return _packed(A.coarse_features(g.features, assignment_of(g)))


@query("SELECT super_id AS node_id, j, " + O.r("CASE WHEN sum(coalesce(mass, 0)) > 0 THEN sum(coalesce(mass, 0) * v) / sum(coalesce(mass, 0)) ELSE avg(v) END") + " AS v FROM flat JOIN asg USING (node_id) LEFT JOIN mass USING (node_id) GROUP BY 1, 2")
def coarse_features_degree(g):
    return _packed(A.coarse_features(g.features, assignment_of(g), A.feature_weights(g, "degree")), 6)


@query("SELECT s.super_id, coalesce(label, -1)::INTEGER AS label FROM (SELECT DISTINCT super_id FROM asg) s LEFT JOIN (SELECT super_id, label FROM asg JOIN nodes USING (node_id) WHERE label >= 0 GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY super_id ORDER BY count(*) DESC, label) = 1) USING (super_id)")
def coarse_labels_majority(g):
    return A.coarse_labels(g.nodes, assignment_of(g))


@query("SELECT a.node_id, b.super_id FROM asg a JOIN (SELECT node_id, min(node_id) OVER (PARTITION BY n.type_id, n.part_id, (rk - 1) // 4) AS super_id FROM placed n) b ON b.node_id = a.super_id")
def compose_assignments(g):
    placed = C.ranked(g.nodes.select("node_id", "type_id", "part_id"), ["type_id", "part_id"], "node_id").withColumn("k", F.floor((F.col("rank") - 1) / 4))
    then = placed.withColumn("super_id", F.min("node_id").over(W.partitionBy("type_id", "part_id", "k"))).select("node_id", "super_id")
    return A.compose(assignment_of(g), then)


@query("SELECT rel_id, b.v AS before, a.v AS after, abs(b.v - a.v) AS error FROM (SELECT rel_id, sum(w) AS v FROM edges GROUP BY 1) b JOIN (SELECT rel_id, sum(w) AS v FROM coarse GROUP BY 1) a USING (rel_id)")
def relation_weight_preservation(g):
    return A.weight_preservation(g.edges, coarse_of(g))


@query("SELECT size, count(*) AS n FROM (SELECT count(*) AS size FROM asg GROUP BY super_id) GROUP BY 1")
def cluster_size_histogram(g):
    return D.cluster_sizes(assignment_of(g))


@query("SELECT " + O.r("avg(h)") + " AS mean_entropy, count(*) AS clusters FROM (SELECT super_id, sum(-(c::DOUBLE / t) * ln(c::DOUBLE / t)) AS h FROM (SELECT super_id, count(*) AS c, sum(count(*)) OVER (PARTITION BY super_id) AS t FROM asg JOIN nodes USING (node_id) WHERE label >= 0 GROUP BY super_id, label) GROUP BY 1)")
def cluster_label_entropy(g):
    return D.label_entropy(g.nodes, assignment_of(g)).withColumn("mean_entropy", rounded(F.col("mean_entropy")))


@query("SELECT " + O.r("avg(s)") + " AS mean_spread, " + O.r("quantile_cont(s, 0.95)") + " AS p95 FROM (SELECT super_id, sum(s) AS s FROM (SELECT super_id, j, var_pop(v) AS s FROM x JOIN asg USING (node_id) GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1)")
def cluster_spread(g):
    return D.cluster_spread(x_of(g), assignment_of(g)).select(rounded(F.col("mean_spread")).alias("mean_spread"), rounded(F.col("p95")).alias("p95"))


@query("SELECT n AS nodes, c AS coarse_nodes, m AS edges, k AS coarse_edges, " + O.r("c / n") + " AS node_ratio, " + O.r("(c + k) / (n + m)") + " AS storage_ratio, " + O.r("s") + " AS singleton_ratio FROM (SELECT count(*) AS n FROM nodes), (SELECT count(*) AS c, avg((z = 1)::INTEGER) AS s FROM (SELECT count(*) AS z FROM asg GROUP BY super_id)), (SELECT count(*) AS m FROM edges), (SELECT count(*) AS k FROM coarse)")
def compression_summary(g):
    c = D.compression(g.nodes, g.edges, assignment_of(g), coarse_of(g))
    return c.select("nodes", "coarse_nodes", "edges", "coarse_edges", *[rounded(F.col(n)).alias(n) for n in ("node_ratio", "storage_ratio", "singleton_ratio")])


_DE = "SELECT rel_id, sum(e.w * (a.v - b.v) ** 2) AS energy FROM {e} e JOIN {x} a ON a.node_id = src JOIN {x} b ON b.node_id = dst AND b.j = a.j GROUP BY 1"
_MEANS = "xm AS MATERIALIZED (SELECT super_id AS node_id, j, avg(v) AS v FROM x JOIN asg USING (node_id) GROUP BY 1, 2)"


@query(f"SELECT rel_id, {O.r('energy')} AS energy FROM ({_DE.format(e='edges', x='x')})")
def dirichlet_energy(g):
    return D.dirichlet_energy(g.edges, x_of(g)).withColumn("energy", rounded(F.col("energy")))


@query(f"WITH {_MEANS} SELECT rel_id, {O.r('a.energy')} AS before, {O.r('coalesce(b.energy, 0)')} AS after, {O.r('abs(coalesce(b.energy, 0) - a.energy) / greatest(abs(a.energy), 1e-12)')} AS error FROM ({_DE.format(e='edges', x='x')}) a LEFT JOIN ({_DE.format(e='coarse', x='xm')}) b USING (rel_id)")
def spectral_errors(g):
    e = D.energy_errors(g.edges, coarse_of(g), x_of(g), assignment_of(g))
    return e.select("rel_id", *[rounded(F.col(c)).alias(c) for c in ("before", "after", "error")])


@query(f"WITH {_MEANS}, lift AS MATERIALIZED (SELECT asg.node_id, j, v FROM asg JOIN xm ON xm.node_id = super_id) SELECT {O.r('sqrt(sum((g - h) ** 2)) / greatest(sqrt(sum(g * g)), 1e-12)')} AS error FROM (SELECT a.j, b.j AS k, sum(a.v * b.v) AS g FROM x a JOIN x b USING (node_id) GROUP BY 1, 2) JOIN (SELECT a.j, b.j AS k, sum(a.v * b.v) AS h FROM lift a JOIN lift b USING (node_id) GROUP BY 1, 2) USING (j, k)")
def gram_error(g):
    return D.gram_error(x_of(g), assignment_of(g)).withColumn("error", rounded(F.col("error")))


@query("WITH a AS (SELECT rel_id, sum(w) / (SELECT sum(w) FROM edges) AS p FROM edges WHERE rel_id <> 9 OR src % 2 = 0 GROUP BY 1), s AS (SELECT rel_id, p FROM (SELECT rel_id, sum(w) / (SELECT sum(w) FROM edges) AS p FROM edges GROUP BY 1)), t AS (SELECT rel_id, sum(w) / (SELECT sum(w) FROM edges WHERE w < 10) AS q FROM edges WHERE w < 10 GROUP BY 1), u AS (SELECT coalesce(p, 0) AS p, coalesce(q, 0) AS q FROM s FULL JOIN t USING (rel_id)) SELECT " + O.r("sum(abs(p - q))") + " AS l1, " + O.r("sum(((CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END) + (CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END)) / 2)") + " AS js FROM u")
def relation_drift(g):
    return D.relation_drift(g.edges, g.edges.where("w < 10")).select(rounded(F.col("l1")).alias("l1"), rounded(F.col("js")).alias("js"))


@query("SELECT rel_id, m AS edges, k AS coarse_edges, " + O.r("k / m") + " AS kept, " + O.r("l") + " AS loop_share FROM ecount JOIN (SELECT rel_id, count(*) AS k, sum(CASE WHEN src = dst THEN w ELSE 0 END) / sum(w) AS l FROM coarse GROUP BY 1) USING (rel_id)")
def edge_collapse(g):
    c = D.edge_collapse(g.edges, coarse_of(g))
    return c.select("rel_id", "edges", "coarse_edges", rounded(F.col("kept")).alias("kept"), rounded(F.col("loop_share")).alias("loop_share"))


@query("SELECT " + O.r("avg(c)") + " AS mean_reach, count(*) AS starts FROM (SELECT a.src, count(DISTINCT b.dst) AS c FROM edges a JOIN edges b ON a.dst = b.src WHERE a.rel_id = 0 AND b.rel_id = 2 GROUP BY 1)")
def metapath_connectivity(g):
    return D.continuations(g.edges, 0, 2).withColumn("mean_reach", rounded(F.col("mean_reach")))


@query("SELECT e.rel_id AS step, count(*) AS paths, sum((c.w IS NOT NULL)::INTEGER)::BIGINT AS kept, sum((a.super_id = b.super_id)::INTEGER)::BIGINT AS collapsed FROM edges e JOIN asg a ON a.node_id = e.src JOIN asg b ON b.node_id = e.dst LEFT JOIN coarse c ON c.rel_id = e.rel_id AND c.src = a.super_id AND c.dst = b.super_id WHERE e.rel_id IN (0, 2, 9) GROUP BY 1")
def path_retention(g):
    return D.path_retention(g.edges, coarse_of(g), assignment_of(g), [0, 2, 9])


@query("SELECT " + ", ".join(f"{O.r(e)} AS {n}" for e, n in (("avg((x.v - coalesce(s.v, 0)) ** 2)", "mse"), ("avg(abs(x.v - coalesce(s.v, 0)))", "mae"), ("corr(x.v, coalesce(s.v, 0))", "corr"))) + " FROM x LEFT JOIN sx s ON s.node_id = x.node_id AND s.j = x.j")
def lowpass_reconstruction(g):
    return D.reconstruction(x_of(g), sx_of(g)).select(*[rounded(F.col(c)).alias(c) for c in ("mse", "mae", "corr")])


@query("SELECT type_id, " + O.r("max(c) / avg(c)") + " AS imbalance FROM (SELECT type_id, count(*) AS c FROM nodes GROUP BY type_id, part_id) GROUP BY 1")
def partition_imbalance(g):
    return D.partition_imbalance(g.nodes).withColumn("imbalance", rounded(F.col("imbalance")))


# --- classification


@query("SELECT label, pred, count(*) AS n FROM pred GROUP BY 1, 2")
def confusion(g):
    return K.confusion(K.predicted(logits_of(g)))


_PRF = "SELECT c AS label, sum(t)::BIGINT AS support, CASE WHEN sum(p) > 0 THEN sum(h) / sum(p) ELSE 0 END AS precision, CASE WHEN sum(t) > 0 THEN sum(h) / sum(t) ELSE 0 END AS recall, CASE WHEN sum(p) + sum(t) > 0 THEN 2 * sum(h) / (sum(p) + sum(t)) ELSE 0 END AS f1 FROM (SELECT label AS c, 1 AS t, 0 AS p, (label = pred)::INTEGER AS h FROM pred UNION ALL SELECT pred, 0, 1, 0 FROM pred) GROUP BY 1"


@query(f"SELECT label, support, {O.r('precision')} AS precision, {O.r('recall')} AS recall, {O.r('f1')} AS f1 FROM ({_PRF})")
def per_class_prf(g):
    return K.per_class(K.predicted(logits_of(g))).select("label", "support", *[rounded(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


@query(f"SELECT {O.r('micro')} AS micro, {O.r('macro')} AS macro FROM (SELECT avg((label = pred)::INTEGER) AS micro FROM pred), (SELECT avg(f1) AS macro FROM ({_PRF}))")
def f1_scores(g):
    return K.f1_scores(K.predicted(logits_of(g))).select(rounded(F.col("micro")).alias("micro"), rounded(F.col("macro")).alias("macro"))


@query("WITH t AS (SELECT node_id, label, max(p) AS top, max(CASE WHEN k = label THEN p END) AS own, sum((p - (k = label)::INTEGER) ** 2) AS b FROM probs GROUP BY 1, 2), u AS (SELECT t.*, (pred = t.label)::INTEGER AS hit, least(floor(round(top, 12) * 10), 9) AS bin FROM t JOIN pred USING (node_id)) SELECT (SELECT " + O.r("sum(n * abs(c - a)) / sum(n)") + " FROM (SELECT count(*) AS n, avg(top) AS c, avg(hit) AS a FROM u GROUP BY bin)) AS ece, (SELECT " + O.r("avg(-ln(greatest(own, 1e-12)))") + " FROM u) AS nll, (SELECT " + O.r("avg(b)") + " FROM u) AS brier")
def ece_nll_brier(g):
    return K.calibration(logits_of(g)).select(*[rounded(F.col(c)).alias(c) for c in ("ece", "nll", "brier")])


@query("SELECT t::DOUBLE AS temperature, " + O.r("avg(z)") + " AS nll FROM (SELECT node_id, t, ln(sum(exp((s - m) / t))) - max(CASE WHEN k = label THEN (s - m) / t END) AS z FROM (SELECT *, max(s) OVER (PARTITION BY node_id) AS m FROM logits), (VALUES (0.5), (1.0), (2.0)) g(t) GROUP BY 1, 2) GROUP BY 1")
def temperature_grid(g):
    return K.temperature_grid(logits_of(g), [0.5, 1.0, 2.0]).withColumn("nll", rounded(F.col("nll")))


@query("SELECT b::DOUBLE AS bias, " + O.r("avg((label = k)::INTEGER)") + " AS accuracy FROM (SELECT node_id, label, k, b FROM (SELECT *, CASE WHEN k = 0 THEN s + b::DOUBLE ELSE s END AS z FROM logits, (VALUES (-0.5), (0.0), (0.5)) g(b)) QUALIFY row_number() OVER (PARTITION BY node_id, b ORDER BY z DESC, k) = 1) GROUP BY 1")
def bias_grid(g):
    return K.bias_grid(logits_of(g), 0, [-0.5, 0.0, 0.5]).withColumn("accuracy", rounded(F.col("accuracy")))


@query("SELECT t::DOUBLE AS weight, " + O.r("avg((label = k)::INTEGER)") + " AS accuracy FROM (SELECT node_id, label, k, t FROM (SELECT *, round(t::DOUBLE * s + (1 - t::DOUBLE) * (-k), 9) AS z FROM logits, (VALUES (0.25), (0.5), (0.75)) g(t)) QUALIFY row_number() OVER (PARTITION BY node_id, t ORDER BY z DESC, k) = 1) GROUP BY 1")
def ensemble_grid(g):
    a = logits_of(g)
    b = a.select("node_id", F.transform("scores", lambda s, i: -i.cast("double")).alias("scores"))
    return K.ensemble_grid(a, b, [0.25, 0.5, 0.75]).withColumn("accuracy", rounded(F.col("accuracy")))


@query(f"SELECT node_id, label, CASE WHEN r <= greatest(1, floor(n * 0.6)) THEN 'train' WHEN r <= greatest(1, floor(n * 0.6)) + floor(n * 0.2) THEN 'valid' ELSE 'test' END AS split FROM (SELECT node_id, label, row_number() OVER (PARTITION BY label ORDER BY {O.mixed('node_id')}, node_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM nodes WHERE label >= 0)")
def stratified_split(g):
    return K.stratified_split(g.nodes)


@query("SELECT n.node_id, n.label, l.label AS pred FROM nodes n JOIN asg USING (node_id) JOIN (SELECT super_id, label FROM asg JOIN nodes USING (node_id) WHERE label >= 0 GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY super_id ORDER BY count(*) DESC, label) = 1) l USING (super_id) WHERE n.label >= 0")
def label_projection_task(g):
    a = assignment_of(g)
    return K.label_projection(g.nodes, a, A.coarse_labels(g.nodes, a))


# --- support





@query("SELECT target_id, rel_id, node_id, w FROM anchors3")
def anchor_topk(g):
    return T.anchor_topk(g.edges, g.nodes, 0, 3)


@query("WITH own AS MATERIALIZED (SELECT DISTINCT target_id, node_id, n.type_id, n.part_id FROM anchors3 JOIN nodes n USING (node_id)), sz AS (SELECT node_id, count(*) AS n FROM own GROUP BY 1), fw AS (SELECT * FROM own QUALIFY row_number() OVER (PARTITION BY target_id, type_id, part_id ORDER BY node_id) <= 16) SELECT i, j, " + O.r("1 - c / (a.n + b.n - c)") + " AS score FROM (SELECT p.node_id AS i, q.node_id AS j, count(*) AS c FROM fw p JOIN fw q ON p.target_id = q.target_id AND p.type_id = q.type_id AND p.part_id = q.part_id AND p.node_id < q.node_id GROUP BY 1, 2) JOIN sz a ON a.node_id = i JOIN sz b ON b.node_id = j")
def anchor_co_support(g):
    return T.anchor_co_support(T.anchor_topk(g.edges, g.nodes, 0, 3), g.nodes, 16).withColumn("score", rounded(F.col("score")))






@query("SELECT node_id, " + O.r("importance") + " AS importance FROM imp")
def support_importance(g):
    return importance_of(g).select("node_id", rounded(F.col("importance")).alias("importance"))


@query("SELECT node_id FROM imp ORDER BY importance DESC, node_id LIMIT (SELECT greatest(1, ceil(count(*) * 0.25))::BIGINT FROM imp)")
def support_topk(g):
    return T.select_top(importance_of(g), 0.25)




@query("SELECT node_id, min(node_id) OVER (PARTITION BY type_id, (r - 1) // 4) AS prototype FROM (SELECT node_id, type_id, row_number() OVER (PARTITION BY type_id ORDER BY degree DESC, node_id) AS r FROM imp)")
def prototype_groups(g):
    return T.prototypes(importance_of(g), ["type_id"], 4, "degree")


@query("SELECT s.super_id AS unit, members, coalesce(mass, 0) AS mass, coalesce(anchors, 0) AS anchors, coalesce(relations, 0) AS relations FROM (SELECT super_id, count(DISTINCT node_id) AS members FROM asg GROUP BY 1) s LEFT JOIN (SELECT super_id, sum(w) AS mass, count(DISTINCT target_id) AS anchors, count(DISTINCT rel_id) AS relations FROM touch JOIN asg USING (node_id) GROUP BY 1) USING (super_id)")
def unit_stats(g):
    return T.unit_stats(assignment_of(g).withColumnRenamed("super_id", "unit"), g.edges, g.nodes, 0)


@query("WITH k AS (SELECT node_id FROM nodes WHERE type_id IN (0, 1)) SELECT " + O.r("((SELECT count(*) FROM k) + (SELECT count(*) FROM edges WHERE src IN (SELECT node_id FROM k) AND dst IN (SELECT node_id FROM k))) / ((SELECT count(*) FROM nodes) + (SELECT count(*) FROM edges))") + " AS ratio")
def storage_ratio(g):
    return T.storage_ratio(g.nodes, g.edges, g.nodes.where("type_id IN (0, 1)")).withColumn("ratio", rounded(F.col("ratio")))


# --- pruning, plans, reports


def _scores(g, how, **more):
    return P.edge_scores(g.edges, g.relations, how, **more).select("rel_id", "src", "dst", rounded(F.col("score")).alias("score"))


def known_of(g):
    """Customers whose labels may be seen: four fifths of them."""
    return g.nodes.where("type_id = 0 AND label >= 0 AND node_id % 5 != 0")


_ES = "FROM escore JOIN rels USING (rel_id) LEFT JOIN (SELECT node_id, 1 AS k FROM nodes WHERE type_id = 0 AND label >= 0 AND node_id % 5 <> 0) a ON a.node_id = src LEFT JOIN (SELECT node_id, 1 AS k FROM nodes WHERE type_id = 0 AND label >= 0 AND node_id % 5 <> 0) b ON b.node_id = dst"
_KNOWN = "greatest(coalesce(a.k, 0), coalesce(b.k, 0))"


@query("SELECT rel_id, src, dst, " + O.r("score") + " AS score FROM escore")
def edge_scores_degree(g):
    return _scores(g, "degree")


@query("SELECT rel_id, src, dst, " + O.r("(src_type = 0 OR dst_type = 0)::INTEGER + 0.25::DOUBLE / ds + 0.25::DOUBLE / dd") + " AS score FROM escore JOIN rels USING (rel_id)")
def edge_scores_current(g):
    return _scores(g, "current")


@query("SELECT rel_id, src, dst, " + O.r(f"score + (src_type = 0 OR dst_type = 0)::INTEGER + 0.8::DOUBLE * {_KNOWN} + (CASE rel_id WHEN 0 THEN 0.8::DOUBLE WHEN 1 THEN 0.8::DOUBLE ELSE 0 END) * (coalesce(a.k, 0) + coalesce(b.k, 0)) + (CASE WHEN rel_id IN (0, 1) THEN 0.2::DOUBLE ELSE 0.1::DOUBLE END) * (src_type IN (0, 1, 2, 3, 8, 9) AND dst_type IN (0, 1, 2, 3, 8, 9))::INTEGER + (xor(src * 1000003, dst * 9176) % 997) * 1e-9::DOUBLE", 9) + f" AS score {_ES}")
def edge_scores_path_aware(g):
    s = P.edge_scores(g.edges, g.relations, "path_aware", known=known_of(g), feature_types=(0, 1, 2, 3, 8, 9), bonus={0: 0.8, 1: 0.8}, strong=(0, 1))
    return s.select("rel_id", "src", "dst", rounded(F.col("score"), 9).alias("score"))


@query("SELECT rel_id, src, dst, " + O.r(f"(src_type = 0 OR dst_type = 0)::INTEGER + (src_type IN (0, 1, 2, 3, 8, 9) OR dst_type IN (0, 1, 2, 3, 8, 9))::INTEGER + {_KNOWN} + 1 - 0.25::DOUBLE * least(sqrt(ds * dd), 8) / 8 - 0.10::DOUBLE * least(ds + dd, 16) / 16.0::DOUBLE") + f" AS score {_ES}")
def edge_scores_path_aware_v2(g):
    return _scores(g, "path_aware_v2", known=known_of(g), feature_types=(0, 1, 2, 3, 8, 9))


def budget_plan(g):
    """5000 edges of the six large relations, which hold more than their share of them at any size."""
    return P.budgets(g.edges.where("rel_id < 6"), 5000, 10)


@query("SELECT rel_id, m AS edges, budget::BIGINT AS budget FROM plan")
def relation_budget_allocation(g):
    return budget_plan(g)


@query("SELECT rel_id, src, dst FROM (SELECT *, row_number() OVER (PARTITION BY rel_id ORDER BY round(score, 9) DESC, src, dst) AS r FROM escore) JOIN plan USING (rel_id) WHERE r <= budget")
def prune_relationwise(g):
    return P.keep_top(P.edge_scores(g.edges, g.relations), budget_plan(g)).select("rel_id", "src", "dst")


@query("SELECT rel_id, src, dst FROM (SELECT DISTINCT m.rel_id, m.src, m.dst FROM (SELECT t, min(struct_pack(rel_id := rel_id, src := src, dst := dst)) AS m FROM (SELECT type_id AS t, max(node_id) AS n FROM nodes GROUP BY 1) JOIN edges ON src = n OR dst = n GROUP BY 1))")
def mandatory_edges(g):
    return P.mandatory(g.edges, g.nodes)


@query("SELECT * FROM (VALUES ('APPA30-PTTP05', 'APPA', 30), ('APPA30-PTTP05', 'PTTP', 5)) t(spec, channel, per_cent)")
def channel_spec(g):
    return P.channel_spec(g.nodes.sparkSession.sql("SELECT 'APPA30-PTTP05' AS spec"))


@query("SELECT rel_id, " + O.r("s") + " AS share, (CASE WHEN s <= 0.2 THEN 1.0 ELSE 0.5 END)::DOUBLE AS keep, " + O.r("1 - s") + " AS utility FROM (SELECT rel_id, m / sum(m) OVER () AS s FROM ecount)")
def cost_share_plan(g):
    return P.cost_share_plan(g.edges).select("rel_id", rounded(F.col("share")).alias("share"), "keep", rounded(F.col("utility")).alias("utility"))


@query(f"SELECT rel_id, src, dst, w FROM edges WHERE {O.mixed('src * 31 + dst', 'rel_id')} % 100 < 20")
def random_edge_sample(g):
    return P.random_sample(g.edges, 20)


@query("SELECT rel_id, src, dst FROM escore QUALIFY row_number() OVER (PARTITION BY rel_id, src ORDER BY round(score, 9) DESC, dst) <= 5 AND row_number() OVER (PARTITION BY rel_id, dst ORDER BY round(score, 9) DESC, src) <= 5")
def hub_capped_edges(g):
    return P.hub_capped(P.edge_scores(g.edges, g.relations), 5).select("rel_id", "src", "dst")


@query("WITH b AS MATERIALIZED (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges), s0 AS (SELECT node_id AS n FROM nodes WHERE type_id = 5), s1 AS MATERIALIZED (SELECT n FROM s0 UNION SELECT b FROM b JOIN s0 ON a = n), s2 AS MATERIALIZED (SELECT n FROM s1 UNION SELECT b FROM b JOIN s1 ON a = n), s3 AS (SELECT n FROM s2 UNION SELECT b FROM b JOIN s2 ON a = n) SELECT 0 AS hop, count(*) AS reached FROM s0 UNION ALL SELECT 1, count(*) FROM s1 UNION ALL SELECT 2, count(*) FROM s2 UNION ALL SELECT 3, count(*) FROM s3")
def coverage_reachability(g):
    return P.reachability(g.edges, g.nodes, 5, 3)


_ROWS = "SELECT rel_id, m AS cost, vol AS gain, vol / m AS density FROM ecount"


def report_rows(g):
    return g.edges.groupBy("rel_id").agg(F.count(F.lit(1)).alias("cost"), F.sum("w").alias("gain"), (F.sum("w") / F.count(F.lit(1))).alias("density"))


@query(f"WITH z AS ({_ROWS}) SELECT rel_id, cost, gain FROM z a WHERE NOT EXISTS (SELECT 1 FROM z b WHERE b.cost <= a.cost AND b.gain >= a.gain AND (b.cost < a.cost OR b.gain > a.gain))")
def pareto_frontier(g):
    return P.pareto(report_rows(g), "cost", ["gain"]).select("rel_id", "cost", "gain")


@query("SELECT src_type, rel_id, m AS cost FROM ecount JOIN rels USING (rel_id) QUALIFY row_number() OVER (PARTITION BY src_type ORDER BY vol DESC, m, rel_id) = 1")
def representative_selection(g):
    rows = report_rows(g).join(F.broadcast(g.relations), "rel_id")
    return P.representative(rows, ["src_type"], [F.desc("gain"), F.col("cost"), F.col("rel_id")]).select("src_type", "rel_id", "cost")


@query("SELECT rel_id, count(w) AS n, " + O.r("avg(w)") + " AS mean, " + O.r("coalesce(stddev_samp(w), 0)") + " AS std_sample, " + O.r("stddev_pop(w)") + " AS std_population FROM edges GROUP BY 1")
def run_mean_std(g):
    s = P.run_statistics(g.edges, ["rel_id"], "w")
    return s.select("rel_id", "n", *[rounded(F.col(c)).alias(c) for c in ("mean", "std_sample", "std_population")])


@query("SELECT node_id, j, floor(round((v - lo) / (CASE WHEN hi > lo THEN (hi - lo) / 255.0::DOUBLE ELSE 1 END), 6) + 0.5)::INTEGER AS q FROM flat JOIN (SELECT type_id, j, min(v) AS lo, max(v) AS hi FROM flat GROUP BY 1, 2) USING (type_id, j)")
def feature_int8(g):
    return P.int8_features(g.features)


@query(f"SELECT node_id, k::INTEGER AS j, {O.r('sum(v * (' + O.sign('j', 'k', 3) + ')) / 2', 9)} AS v FROM flat, range(4) t(k) GROUP BY 1, 2")
def feature_random_projection(g):
    return dense(P.random_projection(g.features, 4), 9)


@query("SELECT bool_and(vol >= m) AS passed, coalesce(sum((NOT vol >= m)::INTEGER), 0)::BIGINT AS failed_rows FROM ecount")
def decision_gate(g):
    return P.rollup_gate(report_rows(g).withColumn("ok", F.col("gain") >= F.col("cost")), ["ok"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import queries_more  # noqa: F401  registers the others

    return {k: f for k, (f, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    queries()
    return {k: s for k, (_, s) in REGISTRY.items() if s}
