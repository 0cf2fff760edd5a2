"""More queries over the canonical graph: reports, paths, task-first terms, selection, units, pruning and calibration."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import oracle as O
from . import plans, sources
from .config import load_config
from .functions import checkpoint_folder, mixed, rounded, settled
from .graph import HeteroGraph
from .operators import candidates as C
from .operators import classify as K
from .operators import coarsen as A
from .operators import diagnostics as G
from .operators import linalg as L
from .operators import matching as M
from .operators import metrics as D
from .operators import paths as H
from .operators import prune as P
from .operators import response as R
from .operators import scoring as S
from .operators import selection as N
from .operators import sketch as Z
from .operators import support as T
from .sources import load_graph, read_text_graph, save_graph, summary, write_text_graph
from .queries import _BK, _WC, EQUAL, assignment_of, buckets_of, coarse_of, dense, guarded_costs, kept, known_of, logits_of, onehop_of, pairs_of, query, report_rows, scored_of, sx_of, window_costs, x_of

RELS = list(EQUAL)
ONES = dict.fromkeys(RELS, 1.0)


def r(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """df with the named columns rounded."""
    for n in names:
        df = df.withColumn(n, rounded(F.col(n), digits))
    return df


def rs(*pairs: tuple[str, str], digits: int = 6) -> str:
    return ", ".join(f"{O.r(e, digits)} AS {n}" for n, e in pairs)


def known(g):
    return known_of(g).select("node_id", "label")


def one_row(g, **values) -> DataFrame:
    """A row of the driver's numbers, rounded."""
    cells = ", ".join(f"CAST({v!r} AS {'DOUBLE' if isinstance(v, float) else 'STRING' if isinstance(v, str) else 'BIGINT'}) AS {k}" for k, v in values.items())
    return g.nodes.sparkSession.sql("SELECT " + cells)


# --- model and validation

_BAD = "(99, 1, 2, 1.0), (0, -5, 10000000000, 1.0), (0, 3, -7, 1.0), (0, 10000000001, 10000000002, 1.0), (0, 1, 2, -1.0)"
_BADE = f"be AS MATERIALIZED (SELECT rel_id, src, dst, w FROM edges UNION ALL SELECT * FROM (VALUES {_BAD}) t(rel_id, src, dst, w)), bn AS MATERIALIZED (SELECT node_id, type_id FROM nodes UNION ALL SELECT * FROM (VALUES (0, 0), (-9, -1)) t(node_id, type_id))"
_BADJ = "be LEFT JOIN rels USING (rel_id) LEFT JOIN (SELECT node_id AS src, type_id AS st FROM bn WHERE node_id <> 0 OR type_id = 0) a USING (src) LEFT JOIN (SELECT node_id AS dst, type_id AS dt FROM bn WHERE node_id <> 0 OR type_id = 0) b USING (dst)"


def broken(g) -> HeteroGraph:
    spark = g.nodes.sparkSession
    edges = g.edges.unionByName(spark.sql(f"SELECT rel_id, CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst, CAST(w AS DOUBLE) AS w FROM VALUES {_BAD} AS t(rel_id, src, dst, w)"))
    nodes = g.nodes.unionByName(spark.sql("SELECT CAST(node_id AS BIGINT) AS node_id, type_id, -1 AS label, 0 AS part_id FROM VALUES (-9, -1) AS t(node_id, type_id)"))
    return HeteroGraph(nodes, edges, g.relations, g.features)


@query("WITH " + _BADE.replace("(0, 0), ", "") + ", c AS (SELECT " + ", ".join(f"coalesce(sum(({c})::INTEGER), 0)::BIGINT AS {n}" for n, c in (("unknown_relation", "src_type IS NULL"), ("dangling_src", "st IS NULL"), ("dangling_dst", "dt IS NULL"), ("src_type", "st <> src_type"), ("dst_type", "dt <> dst_type"), ("weight", "w IS NULL OR w < 0"))) + " FROM " + _BADJ.replace(" WHERE node_id <> 0 OR type_id = 0", "") + "), d AS (SELECT sum((n > 1)::INTEGER)::BIGINT AS duplicate_node, sum((t < 0)::INTEGER)::BIGINT AS negative_type FROM (SELECT node_id, count(*) AS n, min(type_id) AS t FROM bn GROUP BY 1)) " + " UNION ALL ".join(f"SELECT '{n}' AS rule, {n} AS n FROM {'c' if k < 6 else 'd'}" for k, n in enumerate(("unknown_relation", "dangling_src", "dangling_dst", "src_type", "dst_type", "weight", "duplicate_node", "negative_type"))))
def schema_violations_broken(g):
    return broken(g).violations()


@query("WITH " + _BADE.replace("(0, 0), ", "") + " SELECT count(DISTINCT rel_id) FILTER (src_type IS NULL) AS no_relation, 0::BIGINT AS unused_relation, " + ", ".join(f"sum(({c})::INTEGER)::BIGINT AS {n}" for n, c in (("dangling", "st IS NULL OR dt IS NULL"), ("src_type", "coalesce(st <> src_type, false)"), ("dst_type", "coalesce(dt <> dst_type, false)"))) + " FROM " + _BADJ.replace(" WHERE node_id <> 0 OR type_id = 0", ""))
def relation_violations(g):
    return G.relation_violations(broken(g))


@query("SELECT 1::BIGINT AS unmapped, 1::BIGINT AS repeated, 1::BIGINT AS unknown_cluster, count(*) FILTER (type_id <> 0) AS type_change FROM nodes WHERE node_id = 10000000002")
def invalid_assignments(g):
    """An assignment with a node left out, one twice, one in a cluster that is not there, and an order in a customer's cluster."""
    a = g.nodes.select("node_id", F.when(F.col("node_id") == 10000000002, 5).when(F.col("node_id") == 3, -77).otherwise(F.col("node_id")).cast("long").alias("super_id")).where("node_id != 4")
    a = a.unionByName(a.where("node_id = 6"))
    return G.invalid_assignments(g.nodes, a, g.nodes)


@query("SELECT 0::BIGINT AS schema_violations, 0::BIGINT AS invalid_assignments, 0::BIGINT AS relation_violations, 0.0::DOUBLE AS weight_error, 0::BIGINT AS missing_relations, (SELECT (count(*) > (SELECT count(*) FROM nodes))::BIGINT FROM asg WHERE node_id = super_id) AS node_count_violation, 0::BIGINT AS weight_violation")
def level_invariants(g):
    a = settled(assignment_of(g))
    return r(G.level_invariants(g, A.coarse_graph(g, a), a), "weight_error")


_SPACED = "(n <= k OR (k > 1 AND floor(ceil(p * (k - 1) / greatest(n - 1, 1)::DOUBLE) * (n - 1) / greatest(k - 1, 1)::DOUBLE) = p) OR p = 0)"


@query(f"SELECT node_id FROM (SELECT node_id, row_number() OVER (PARTITION BY type_id ORDER BY node_id) - 1 AS p, count(*) OVER (PARTITION BY type_id) AS n, greatest(1, floor(200 * count(*) OVER (PARTITION BY type_id) / (SELECT count(*) FROM nodes)))::BIGINT AS k FROM nodes) WHERE {_SPACED}")
def stratified_node_sample(g):
    return G.node_sample(g, 200).nodes.select("node_id")


@query(f"SELECT rel_id, src, dst FROM (SELECT *, row_number() OVER (PARTITION BY rel_id ORDER BY src, dst) - 1 AS p, count(*) OVER (PARTITION BY rel_id) AS n, 100 AS k FROM edges) WHERE {_SPACED}")
def spaced_edge_sample(g):
    return G.edge_sample(g.edges, 100).select("rel_id", "src", "dst")


@query("SELECT x.node_id, j, CASE WHEN type_id = 1 THEN v ELSE 0.0::DOUBLE END + 0.0 AS v FROM x JOIN nodes USING (node_id)")
def mask_to_type(g):
    return dense(L.masked(x_of(g), g.nodes, 1))


@query("SELECT rel_id, split_part(name, '__', 1) AS src_name, split_part(name, '__', 2) AS verb, split_part(name, '__', 3) AS dst_name, least(split_part(name, '__', 1), split_part(name, '__', 3)) || '-' || greatest(split_part(name, '__', 1), split_part(name, '__', 3)) AS pair FROM rels")
def relation_pair_names(g):
    part = lambda k: F.element_at(F.split("name", "__"), k)
    return g.relations.select("rel_id", part(1).alias("src_name"), part(2).alias("verb"), part(3).alias("dst_name"), F.concat_ws("-", F.least(part(1), part(3)), F.greatest(part(1), part(3))).alias("pair"))


# --- message passing and sketches


@query(f"SELECT node_id, j::INTEGER AS j, {O.r('sqrt(-2.0::DOUBLE * ln(u)) * cos(2.0::DOUBLE * pi() * t)')} AS v FROM (SELECT node_id, j, ({O.mixed('node_id', 'j', 0)} + 0.5::DOUBLE) / 2147483647.0::DOUBLE AS u, ({O.mixed('node_id', 'j', 1)} + 0.5::DOUBLE) / 2147483647.0::DOUBLE AS t FROM nodes, range(2) q(j))")
def gaussian_probe(g):
    return dense(L.probe(g.nodes, 2, 0, "gaussian"))


_STEP = "SELECT rel_id, src, dst, w / greatest(sum(w) OVER (PARTITION BY rel_id, src), 1e-12) AS w FROM edges"


@query(f"WITH st AS MATERIALIZED ({_STEP}), y AS (SELECT src AS node_id, j, sum(w * v) AS v FROM st JOIN x ON node_id = dst WHERE rel_id = 2 GROUP BY 1, 2) SELECT st.src AS node_id, j, {O.r('sum(st.w * y.v)')} AS v FROM st JOIN y ON y.node_id = st.dst WHERE rel_id = 0 GROUP BY 1, 2")
def sequential_metapath_probe(g):
    return dense(L.transition_probe(g.edges, x_of(g), [(2, "forward"), (0, "forward")]))


@query(f"WITH st AS MATERIALIZED ({_STEP}), e AS MATERIALIZED (SELECT src AS a, dst AS b, w FROM st UNION ALL SELECT dst, src, w FROM st) SELECT x.node_id, x.j, {O.r('(x.v + coalesce(s, 0)) / (1 + coalesce(n, 0))')} AS v FROM x LEFT JOIN (SELECT b AS node_id, j, sum(e.w * x.v) AS s, count(*) AS n FROM e JOIN x ON x.node_id = a GROUP BY 1, 2) y ON y.node_id = x.node_id AND y.j = x.j")
def bidirectional_smoothing(g):
    return dense(L.neighbour_smoothing(g.edges, x_of(g)))


@query(f"WITH p AS MATERIALIZED (SELECT node_id, j, {O.sign('node_id', 'j', 7)} AS v FROM nodes, range(2) t(j)), s1 AS MATERIALIZED (SELECT b AS node_id, j, sum(0.5::DOUBLE * turned.w * v) / 11 AS v FROM turned JOIN p ON node_id = a GROUP BY 1, 2), s2 AS (SELECT b AS node_id, j, sum(0.5::DOUBLE * turned.w * v) / 11 AS v FROM turned JOIN s1 ON node_id = a GROUP BY 1, 2) SELECT {O.r('sqrt((SELECT sum(v * v) FROM s2)) / sqrt((SELECT sum(v * v) FROM s1))', 5)} AS norm")
def operator_norm(g):
    return one_row(g, norm=round(L.operator_norm(g.nodes, L.normalized(g.edges), EQUAL, 2, 2, settled), 5))


@query("SELECT * FROM (VALUES " + ", ".join(f"({k}, {(0.0 if k in (1, 3, 5) else 1 / 8)}::DOUBLE)" for k in RELS) + ") t(rel_id, alpha)")
def reverse_policy_weights(g):
    a = L.drop_reverse(g.edges, EQUAL, [(0, 1), (2, 3), (4, 5)])
    return g.nodes.sparkSession.createDataFrame([(k, round(a.get(k, 0.0), 9)) for k in RELS], "rel_id int, alpha double")


_CT = [Z.chebyshev_coefficients(2, t) for t in (0.5, 2.0)]


def _heat_sql(k: int) -> str:
    c, p = _CT[k], f"p{k}"
    return f"{p} AS MATERIALIZED (SELECT node_id, {O.sign('node_id', '0', 101 * (k + 1))} AS v FROM nodes), a{k} AS MATERIALIZED (SELECT b AS node_id, sum(0.5::DOUBLE * turned.w * v) / 11 AS v FROM turned JOIN {p} ON node_id = a GROUP BY 1), b{k} AS MATERIALIZED (SELECT b AS node_id, sum(0.5::DOUBLE * turned.w * v) / 11 AS v FROM turned JOIN a{k} ON node_id = a GROUP BY 1), h{k} AS MATERIALIZED (SELECT node_id, sum(v) AS v FROM (SELECT node_id, {c[0] - c[2]!r}::DOUBLE * v AS v FROM {p} UNION ALL SELECT node_id, {-c[1]!r}::DOUBLE * v FROM a{k} UNION ALL SELECT node_id, {2 * c[2]!r}::DOUBLE * v FROM b{k}) GROUP BY 1)"


@query(f"WITH {_heat_sql(0)}, {_heat_sql(1)}, z AS (SELECT node_id, 0 AS j, v FROM h0 UNION ALL SELECT node_id, 1, v FROM h1) SELECT node_id, j::INTEGER AS j, {O.r('v / greatest(sqrt(sum(v * v) OVER (PARTITION BY node_id)), 1e-12)')} AS v FROM z")
def lowpass_sketch(g):
    return dense(Z.lowpass_sketch(L.normalized(g.edges), g.nodes, EQUAL, "chebyshev_heat", 2, 2, (0.5, 2.0)))


_MP = [("customer__places__orders:source", 0, [(0, "forward"), (0, "backward")]), ("customer__places__orders:target", 1, [(0, "backward"), (0, "forward")])]
_VOL0 = "(SELECT sum(w) FROM edges WHERE rel_id = 0)"


def _closed_sql(k: int, probe: str) -> str:
    """The product of path k with a probe of its start type."""
    there, back = ("src", "dst") if k == 0 else ("dst", "src")
    return f"SELECT e.{there} AS node_id, j, sum(e.w * m.v) AS v FROM (SELECT {back} AS node_id, j, sum(w * v) AS v FROM ne JOIN ({probe}) q ON q.node_id = {there} WHERE rel_id = 0 GROUP BY 1, 2) m JOIN (SELECT * FROM ne WHERE rel_id = 0) e ON e.{back} = m.node_id GROUP BY 1, 2"


def _mpe_sql(k: int) -> str:
    own = f"SELECT x.* FROM x JOIN nodes USING (node_id) WHERE type_id = {k}"
    return f"greatest((SELECT sum(a.v * (a.v - coalesce(b.v, 0))) / (sum(a.v * a.v) + 1e-8) FROM ({own}) a LEFT JOIN ({_closed_sql(k, own)}) b ON b.node_id = a.node_id AND b.j = a.j), 0)"


@query(f"WITH z AS MATERIALIZED (SELECT 'customer__places__orders:source' AS path, sqrt(({_VOL0} + 1e-8)) / ({_mpe_sql(0)} + 1e-8) AS raw UNION ALL SELECT 'customer__places__orders:target', sqrt(({_VOL0} + 1e-8)) / ({_mpe_sql(1)} + 1e-8)) SELECT path, {O.r('raw / sum(raw) OVER ()')} AS beta FROM z")
def metapath_weights(g):
    paths = Z.closed_paths(g.relations.collect(), 2)
    w = Z.metapath_weights(L.normalized(g.edges), g.edges, g.nodes, x_of(g), paths)
    return r(g.nodes.sparkSession.createDataFrame(list(w.items()), "path string, beta double"), "beta")


_MPS = _closed_sql(0, f"SELECT node_id, j, {O.sign('node_id', 'j', 101)} AS v FROM nodes, range(3) t(j) WHERE type_id = 0")


@query(f"WITH y AS MATERIALIZED ({_MPS}), z AS (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY node_id)) AS n FROM y) SELECT node_id, j::INTEGER AS j, {O.r('v / n')} AS v FROM z WHERE n > 1e-6")
def metapath_sketch(g):
    """Rows of customers whose products do not cancel out."""
    e = L.normalized(g.edges)
    raw = Z.metapath_step(e, g.nodes, L.probe(g.nodes, 3, 101), _MP[0])
    some = raw.where(L.row_sum([F.col(c) * F.col(c) for c in L.columns(raw)]) > 1e-12).select("node_id")
    return dense(Z.metapath_sketch(e, g.nodes, _MP[:1], 3).join(some, "node_id", "left_semi"))


@query("SELECT node_id, j, " + O.r("sum(v)") + f" AS v FROM (SELECT node_id, j, 0.75::DOUBLE * v AS v FROM sx UNION ALL SELECT node_id, j, 0.125::DOUBLE * v FROM ({_closed_sql(0, 'SELECT x.* FROM x JOIN nodes USING (node_id) WHERE type_id = 0')}) UNION ALL SELECT node_id, j, 0.125::DOUBLE * v FROM ({_closed_sql(1, 'SELECT x.* FROM x JOIN nodes USING (node_id) WHERE type_id = 1')})) GROUP BY 1, 2")
def fused_with_metapaths(g):
    return dense(Z.fused_with_paths(L.normalized(g.edges), g.nodes, x_of(g), EQUAL, _MP, {p[0]: 0.5 for p in _MP}, 0.25))


# --- candidates and scores

_INC = "SELECT DISTINCT middle, n.type_id, n.part_id, endpoint FROM (SELECT src AS middle, dst AS endpoint FROM edges UNION SELECT dst, src FROM edges) JOIN nodes n ON n.node_id = endpoint"


@query(f"WITH inc AS MATERIALIZED ({_INC}), cap AS MATERIALIZED (SELECT greatest(1, floor(quantile_cont(c, 0.9)))::BIGINT AS cap FROM (SELECT count(*) AS c FROM inc GROUP BY middle, type_id HAVING count(*) > 1)), few AS MATERIALIZED (SELECT * FROM (SELECT inc.*, row_number() OVER (PARTITION BY middle, type_id, part_id ORDER BY {O.mixed('endpoint + middle')}, endpoint) AS r FROM inc WHERE middle <> endpoint), cap WHERE r <= cap) SELECT DISTINCT i, j FROM (SELECT a.endpoint AS i, b.endpoint AS j, row_number() OVER (PARTITION BY a.middle, a.type_id, a.part_id ORDER BY {O.mixed('a.endpoint + b.endpoint + a.middle', '1')}, a.endpoint, b.endpoint) AS r FROM few a JOIN few b ON a.middle = b.middle AND a.type_id = b.type_id AND a.part_id = b.part_id AND a.endpoint < b.endpoint) WHERE r <= 20")
def cand_twohop_degree_capped(g):
    cap = C.degree_cap(C.incident_index(g.edges, g.nodes), 0.9).first().cap
    return C.twohop(g.edges, g.nodes, cap, 20).select("i", "j")


@query("WITH b AS MATERIALIZED (SELECT i, j, min(CASE source WHEN 'onehop' THEN 0.0 ELSE 1e6 END) AS score, min(CASE source WHEN 'onehop' THEN 1 ELSE 9 END) AS o FROM cands GROUP BY 1, 2), e AS (SELECT i AS n, j AS other, * FROM b UNION ALL SELECT j, i, * FROM b), s AS (SELECT i, j, count(*) FILTER (r <= 1) AS ok, any_value(o) AS o FROM (SELECT *, row_number() OVER (PARTITION BY n, o ORDER BY score, other) AS r FROM e) GROUP BY 1, 2), k AS (SELECT b.* FROM b JOIN s USING (i, j) WHERE b.o = 9 OR ok = 2), ke AS (SELECT i AS n, j AS other, * FROM k UNION ALL SELECT j, i, * FROM k) SELECT i, j FROM (SELECT i, j, row_number() OVER (PARTITION BY n ORDER BY score, o, other) AS r FROM ke) WHERE r <= 2 GROUP BY 1, 2 HAVING count(*) = 2")
def cand_retained_by_source(g):
    return C.retain(onehop_of(g).unionByName(C.fallback(g.nodes)), 2, {"onehop": 1}).select("i", "j")


@query("SELECT i, j, min(CASE source WHEN 'onehop' THEN 0.0 ELSE 1e6 END)::DOUBLE AS score, CASE WHEN min(CASE source WHEN 'onehop' THEN 0 ELSE 1 END) = 0 THEN 'onehop' ELSE 'fallback' END AS source FROM cands GROUP BY 1, 2")
def cand_merged_stores(g):
    return C.merged(onehop_of(g), C.fallback(g.nodes))


def _p95(t: str) -> str:
    return f"{t} / (SELECT CASE WHEN abs(quantile_cont({t}, 0.95)) > 1e-12 THEN abs(quantile_cont({t}, 0.95)) ELSE greatest(coalesce(quantile_cont(abs({t}), 0.95) FILTER (abs({t}) > 1e-12), 1e-12), 1e-12) END FROM scored)"


@query("SELECT i, j, " + O.r(" + ".join(f"{w}::DOUBLE * {_p95(t)}" for t, w in S.LAMBDAS.items())) + " AS cost FROM scored")
def score_candidate_pairs(g):
    g = replace(g, nodes=settled(g.nodes))
    table, slices = S.product_table(g, EQUAL, 2)
    out = S.score_pairs(C.fallback(g.nodes).select("i", "j"), table, normalization="p95", slices=slices)
    return r(out.select("i", "j", "cost"), "cost")


@query("WITH f AS MATERIALIZED (SELECT node_id, x[1] AS a, x[2] AS b FROM feats WHERE type_id = 0), m AS (SELECT avg(a) AS ma, avg(b) AS mb, 0.5::DOUBLE * atan2(2 * covar_pop(a, b), var_pop(a) - var_pop(b)) AS t FROM f) SELECT node_id, 0::INTEGER AS j, " + O.r("((a - ma) * cos(t) + (b - mb) * sin(t)) * sign(CASE WHEN abs(cos(t)) >= abs(sin(t)) THEN cos(t) ELSE sin(t) END)") + " AS v FROM f, m")
def feature_pca(g):
    return dense(S.pca_projection(g.features, 0, 1))


@query("WITH {wc}, {gc}, b AS MATERIALIZED (SELECT n, other FROM (SELECT i AS n, j AS other, cost FROM wc UNION ALL SELECT j, i, cost FROM wc) QUALIFY row_number() OVER (PARTITION BY n ORDER BY cost, other) = 1), m AS (SELECT a.n AS i, a.other AS j FROM b a JOIN b c ON a.other = c.n AND c.other = a.n WHERE a.n < a.other) SELECT source, count(*) AS n, " + rs(("mean_cost", "avg(cost)"), ("mean_spec", "avg(spec)"), ("mean_conv", "avg(spec)"), ("mean_size", "2.0::DOUBLE")) + " FROM gc JOIN m USING (i, j) GROUP BY 1")
def selected_source_breakdown(g):
    c = settled(guarded_costs(g))
    m = settled(M.mutual_best(c))
    rows = c.join(m.select("i", "j"), ["i", "j"], "left_semi").withColumn("conv", F.col("spec"))
    return r(S.selected_by_source(rows, M.from_matching(m, g.nodes)), "mean_cost", "mean_spec", "mean_conv", "mean_size")


# --- matching


def _greedy_sql(rounds: int = 40) -> str:
    """The greedy matching by rounds in SQL; more rounds than the tables need change nothing."""
    parts = [_WC, "l0 AS MATERIALIZED (SELECT i, j, cost FROM wc)"]
    for k in range(rounds):
        parts.append(f"w{k} AS MATERIALIZED (SELECT i, j, cost FROM (SELECT i, j, cost, row_number() OVER (PARTITION BY n ORDER BY cost, i, j) AS q FROM (SELECT i AS n, * FROM l{k} UNION ALL SELECT j, * FROM l{k})) WHERE q = 1 GROUP BY 1, 2, 3 HAVING count(*) = 2)")
        parts.append(f"l{k + 1} AS MATERIALIZED (SELECT l.* FROM l{k} l ANTI JOIN (SELECT i AS u FROM w{k} UNION ALL SELECT j FROM w{k}) a ON a.u = l.i ANTI JOIN (SELECT i AS u FROM w{k} UNION ALL SELECT j FROM w{k}) b ON b.u = l.j)")
    return "WITH " + ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT i, j, cost FROM w{k}" for k in range(rounds))


@query(_greedy_sql())
def match_greedy(g):
    return M.greedy_grouped(window_costs(g), ["type_id", "part_id"])


@query(_greedy_sql())
def match_greedy_rounds(g):
    return M.greedy(window_costs(g), settled)


@query()
def match_greedy_cluster_guarded(g):
    flags = M.terminal_flags(g.edges, g.nodes).join(g.nodes.select("node_id", "label"), "node_id")
    side = lambda e: flags.select(F.col("node_id").alias(e), F.col("protected").alias(f"guard_{e}"), F.col("label").alias(f"label_{e}"))
    return M.greedy_cluster(window_costs(g).join(side("i"), "i").join(side("j"), "j"), ["type_id", "part_id"])


@query()
def match_quota(g):
    rows = guarded_costs(g)
    return M.quota_matching(rows, 600, 0.5, {"onehop": 0.25}, settled).select("i", "j", "cost", "source")


@query("SELECT n, t AS target, greatest(0, n - greatest(t, ceil(n * greatest(0.55, t / n))))::BIGINT AS merges FROM (SELECT count(*) AS n, greatest(1, ceil(count(*) * 0.5))::BIGINT AS t FROM nodes)")
def level_target(g):
    n = g.nodes.count()
    t = max(1, -(-n // 2))
    return one_row(g, n=n, target=t, merges=M.level_budget(n, t))


_HEAVY = "SELECT least(src, dst) AS i, greatest(src, dst) AS j, -sum(w) AS cost FROM edges JOIN nodes a ON a.node_id = src JOIN nodes b ON b.node_id = dst WHERE a.type_id = b.type_id AND a.part_id = b.part_id AND src <> dst GROUP BY 1, 2"


@query(f"WITH he AS MATERIALIZED ({_HEAVY}), b AS MATERIALIZED (SELECT n, other FROM (SELECT i AS n, j AS other, cost FROM he UNION ALL SELECT j, i, cost FROM he) QUALIFY row_number() OVER (PARTITION BY n ORDER BY cost, other) = 1) SELECT a.n AS i, a.other AS j FROM b a JOIN b c ON a.other = c.n AND c.other = a.n WHERE a.n < a.other")
def baseline_heavy_edge(g):
    return G.baseline_pairs(g, "heavy_edge")


@query("SELECT min(node_id) AS i, max(node_id) AS j FROM (SELECT n.node_id, n.type_id, n.part_id, row_number() OVER (PARTITION BY n.type_id, n.part_id ORDER BY coalesce(round(v, 9), 0), n.node_id) AS r FROM nodes n LEFT JOIN (SELECT * FROM sx WHERE j = 0) s USING (node_id)) GROUP BY type_id, part_id, (r - 1) // 2 HAVING count(*) = 2")
def baseline_embedding(g):
    return G.baseline_pairs(g, "embedding", sx_of(g))


@query()
def baseline_target_matched(g):
    return G.matched_to_ratio(g, "random", 0.4, settle=settled)


@query(f"WITH {_BK}, pl AS (SELECT *, (row_number() OVER (PARTITION BY bucket ORDER BY node_id) - 1) AS p FROM bk), ch AS MATERIALIZED (SELECT bucket, p // 4 AS g, min(node_id) AS s, count(*) - 1 AS c, coalesce(sum(count(*) - 1) OVER (ORDER BY bucket, p // 4 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM pl GROUP BY 1, 2) SELECT node_id, CASE WHEN p % 4 = 0 OR before + p % 4 <= 1000 THEN s ELSE node_id END AS super_id FROM pl JOIN ch ON ch.bucket = pl.bucket AND ch.g = pl.p // 4")
def typed_hash_budget(g):
    return M.budgeted_hash_clusters(buckets_of(g), 1000)


def four_of(g) -> DataFrame:
    """Clusters of four in the order of ids."""
    from .graph import ranked

    placed = ranked(g.nodes.select("node_id", "type_id", "part_id"), ["type_id", "part_id"], "node_id").withColumn("k", F.floor((F.col("rank") - 1) / 4))
    first = placed.groupBy("type_id", "part_id", "k").agg(F.min("node_id").alias("super_id"))
    return placed.join(first, ["type_id", "part_id", "k"]).select("node_id", "super_id")


_FOUR = "four AS MATERIALIZED (SELECT node_id, min(node_id) OVER (PARTITION BY type_id, part_id, (rk - 1) // 4) AS super_id FROM placed)"


@query(f"WITH {_FOUR}, m AS MATERIALIZED (SELECT super_id, any_value(c) AS c, sum(s) AS s FROM (SELECT super_id, j, count(*) AS c, var_pop(v) AS s FROM sx JOIN four USING (node_id) GROUP BY 1, 2) GROUP BY 1), q AS (SELECT quantile_cont(round(s, 9), 0.75) AS q FROM m WHERE c > 2), bad AS MATERIALIZED (SELECT super_id FROM m, q WHERE c > 2 AND s > 0 AND round(s, 9) >= q), ctr AS MATERIALIZED (SELECT super_id, j, avg(v) AS m FROM sx JOIN four USING (node_id) JOIN bad USING (super_id) GROUP BY 1, 2), far AS MATERIALIZED (SELECT s.node_id, f.super_id, sum((s.v - c.m) ** 2) AS d, max(CASE WHEN s.j = 0 THEN s.v END) AS a FROM sx s JOIN four f USING (node_id) JOIN ctr c ON c.super_id = f.super_id AND c.j = s.j GROUP BY 1, 2), pr AS MATERIALIZED (SELECT node_id, super_id, (row_number() OVER (PARTITION BY super_id ORDER BY round(a, 9), round(d, 9), node_id) - 1) // 2 AS g FROM far), nw AS MATERIALIZED (SELECT node_id, min(node_id) OVER (PARTITION BY super_id, g) AS super_id FROM pr UNION ALL SELECT node_id, super_id FROM four WHERE super_id NOT IN (SELECT super_id FROM bad) AND node_id IN (SELECT node_id FROM sx)), m2 AS (SELECT super_id, any_value(c) AS c, sum(s) AS s FROM (SELECT super_id, j, count(*) AS c, var_pop(v) AS s FROM sx JOIN nw USING (node_id) GROUP BY 1, 2) GROUP BY 1), ok AS (SELECT (SELECT avg(s) FROM m2 WHERE c > 1) < (SELECT avg(s) FROM m WHERE c > 1) AS ok) SELECT f.node_id, CASE WHEN ok THEN coalesce(n.super_id, f.super_id) ELSE f.super_id END AS super_id, ok AS repaired FROM four f LEFT JOIN nw n USING (node_id), ok")
def cluster_repair(g):
    return M.repair_clusters(settled(four_of(g)), settled(sx_of(g)), g.nodes)


# --- reports


@query("WITH c AS (SELECT n.node_id, count(p.i) AS c FROM nodes n LEFT JOIN (SELECT i, i AS n FROM cands UNION ALL SELECT i, j FROM cands) p ON p.n = n.node_id GROUP BY 1), s AS (SELECT count(*) AS s FROM asg GROUP BY super_id) SELECT a.*, e.*, k.*, d.*, f.*, " + O.r("coarse_nodes / original_nodes") + " AS compression_ratio, original_nodes - coarse_nodes AS node_reduction FROM (SELECT sum(s)::BIGINT AS original_nodes, count(*) AS coarse_nodes, count(*) FILTER (s = 2) AS matched_pairs, sum(s - 1)::BIGINT AS matched_merges, count(*) FILTER (s > 1) AS non_singleton_clusters, " + rs(("singleton_ratio", "avg((s = 1)::INTEGER)"), ("cluster_size_mean", "avg(s)"), ("cluster_size_p50", "quantile_cont(s, 0.5)"), ("cluster_size_p95", "quantile_cont(s, 0.95)"), ("cluster_size_p99", "quantile_cont(s, 0.99)")) + ", max(s) AS max_cluster_size FROM s) a, (SELECT count(*) AS original_edges FROM edges) e, (SELECT count(*) AS coarse_edges FROM coarse) k, (SELECT sum(c)::BIGINT AS candidate_total, max(c) AS candidate_max, " + rs(("candidate_mean", "avg(c)"), ("candidate_coverage", "avg((c > 0)::INTEGER)"), ("candidate_p50", "quantile_cont(c, 0.5)"), ("candidate_p95", "quantile_cont(c, 0.95)"), ("candidate_p99", "quantile_cont(c, 0.99)")) + " FROM c) d, (SELECT count(*) AS retained_pairs FROM cands) f")
def level_report(g):
    a = settled(assignment_of(g))
    out = G.level_report(g.nodes, g.edges, A.coarse_edges(g.edges, a), a, onehop_of(g).unionByName(C.fallback(g.nodes)))
    return r(out, "singleton_ratio", "cluster_size_mean", "cluster_size_p50", "cluster_size_p95", "cluster_size_p99", "candidate_mean", "candidate_coverage", "candidate_p50", "candidate_p95", "candidate_p99", "compression_ratio")


@query("SELECT type_id, count(*) AS before, count(DISTINCT super_id) AS after, count(*) - count(DISTINCT super_id) AS reduction FROM nodes JOIN asg USING (node_id) GROUP BY 1")
def node_reduction_by_type(g):
    return G.reduction_by_type(g.nodes, assignment_of(g))


@query(f"WITH {_FOUR} SELECT type_id, size, count(*) AS clusters FROM (SELECT super_id, min(type_id) AS type_id, count(*) AS size FROM four JOIN nodes USING (node_id) GROUP BY 1) GROUP BY 1, 2")
def cluster_sizes_by_type(g):
    return G.sizes_by_type(g.nodes, four_of(g))


@query("SELECT rel_id, m AS edges, k AS coarse_edges, vol AS weight, cv AS coarse_weight, " + O.r("abs(vol - cv)") + " AS weight_error FROM ecount JOIN (SELECT rel_id, count(*) AS k, sum(w) AS cv FROM coarse GROUP BY 1) USING (rel_id)")
def relation_report(g):
    return r(G.relation_report(g.edges, coarse_of(g)), "weight_error")


_SPREAD = "SELECT super_id, sum(s) AS s FROM (SELECT super_id, j, var_pop(v) AS s FROM {x} JOIN four USING (node_id) GROUP BY 1, 2) GROUP BY 1"
_PDIM = "pd AS MATERIALIZED (SELECT n.node_id, d AS j, coalesce(p, 0) AS v FROM nodes n CROSS JOIN range(22) t(d) LEFT JOIN profiles q ON q.node_id = n.node_id AND q.dim = d)"
_FULL = lambda t, n: f"{n} AS MATERIALIZED (SELECT n.node_id, c AS j, coalesce(v, 0) AS v FROM nodes n CROSS JOIN range(2) q(c) LEFT JOIN {t} s ON s.node_id = n.node_id AND s.j = c)"


@query(f"WITH {_FOUR}, {_PDIM}, {_FULL('sx', 'f1')}, {_FULL('ssx', 'f2')}, b AS (SELECT super_id, count(*) AS c, count(DISTINCT type_id) AS k FROM four JOIN nodes USING (node_id) GROUP BY 1), h AS (SELECT super_id, sum(-(c::DOUBLE / t) * ln(c::DOUBLE / t)) AS e FROM (SELECT super_id, count(*) AS c, sum(count(*)) OVER (PARTITION BY super_id) AS t FROM four JOIN nodes USING (node_id) WHERE label >= 0 GROUP BY super_id, label) GROUP BY 1), z AS (SELECT b.*, u.s AS a1, v.s / 22 AS a2, w.s AS a3, coalesce(e, 0) AS a4 FROM b JOIN ({_SPREAD.format(x='f1')}) u USING (super_id) JOIN ({_SPREAD.format(x='pd')}) v USING (super_id) JOIN ({_SPREAD.format(x='f2')}) w USING (super_id) LEFT JOIN h USING (super_id)) SELECT " + rs(*[(f"{n}_{m}", f"avg({c})" if m == "mean" else f"quantile_cont({c}, 0.95)") for c, n in (("a1", "sketch"), ("a2", "profile"), ("a3", "conv"), ("a4", "entropy")) for m in ("mean", "p95")]) + ", count(*) FILTER (k > 1 OR c > 3) AS bad_clusters, " + O.r("avg((k > 1 OR c > 3)::INTEGER)") + " AS bad_share FROM z")
def cluster_quality(g):
    e = settled(L.normalized(g.edges))
    z = settled(L.fused(e, x_of(g), EQUAL))
    every = lambda x: g.nodes.select("node_id").join(x, "node_id", "left").na.fill(0.0)
    p = S.relation_profiles(g.edges).select("node_id", F.col("dim").alias("j"), F.col("p").alias("v"))
    q = G.cluster_quality(g, settled(four_of(g)), every(z), every(L.wide(p, 22)), every(L.fused(e, z, EQUAL)), 3)
    return r(q, *[f"{n}_{m}" for n in ("sketch", "profile", "conv", "entropy") for m in ("mean", "p95")], "bad_share")


@query(f"WITH s AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rel_id ORDER BY src, dst) - 1 AS p, count(*) OVER (PARTITION BY rel_id) AS n, 256 AS k FROM edges) WHERE {_SPACED}) SELECT rel_id, any_value(n) AS edges, count(*) AS sampled, sum(w) AS weight, " + O.r("avg(w)") + " AS mean, count(*) FILTER (src = dst) AS loops, count(DISTINCT src) AS sources, count(DISTINCT dst) AS destinations, (SELECT count(*) * 116 FROM nodes) AS candidate_bytes, 'scoring' AS slowest FROM s GROUP BY 1")
def large_graph_envelope(g):
    return r(G.envelope(g, 256, 8, {"sketch": 1.0, "scoring": 2.0}), "mean")


_SM = "SELECT node_id, j, sum(v) AS v FROM (SELECT node_id, j, 0.5::DOUBLE * v AS v FROM {x} UNION ALL SELECT dst, j, 0.5::DOUBLE * w * v / 11 FROM {e} JOIN {x} ON node_id = src) GROUP BY 1, 2"
_EN = "SELECT rel_id, sum(e.w * (a.v - b.v) ** 2) AS energy FROM {e} e JOIN {x} a ON a.node_id = src JOIN {x} b ON b.node_id = dst AND b.j = a.j GROUP BY 1"
_FE = "(SELECT sum(x.v * (x.v - coalesce(y.v, 0))) FROM {x} x LEFT JOIN (SELECT b AS node_id, j, sum(0.5::DOUBLE * t.w * v) / 11 AS v FROM (SELECT src AS a, dst AS b, w FROM {e} UNION ALL SELECT dst, src, w FROM {e}) t JOIN {x} ON node_id = a GROUP BY 1, 2) y ON y.node_id = x.node_id AND y.j = x.j)"


@query(f"WITH s0 AS MATERIALIZED ({_SM.format(x='x', e='ne')}), s1 AS MATERIALIZED ({_SM.format(x='xm', e='cne')}), be AS ({_EN.format(e='edges', x='s0')}), ae AS ({_EN.format(e='coarse', x='s1')}), r AS MATERIALIZED (SELECT b.energy AS p, a.energy AS q, abs(a.energy - b.energy) / greatest(abs(b.energy), 1e-12) AS z FROM be b JOIN ae a USING (rel_id)), gr AS (SELECT g, h FROM (SELECT a.j, b.j AS k, sum(a.v * b.v) AS g FROM s0 a JOIN s0 b USING (node_id) GROUP BY 1, 2) JOIN (SELECT a.j, b.j AS k, sum(a.v * b.v) AS h FROM s1 a JOIN s1 b USING (node_id) GROUP BY 1, 2) USING (j, k)), fe AS (SELECT {_FE.format(x='s0', e='ne')} AS a, {_FE.format(x='s1', e='cne')} AS b) SELECT " + rs(("dee", "abs(sum(q) - sum(p)) / greatest(abs(sum(p)), 1e-12)"), ("fse", "(SELECT abs(b - a) / greatest(abs(a), 1e-12) FROM fe)"), ("wfe", "abs(sum(q) - sum(p)) / greatest(abs(sum(p)), 1e-12)"), ("ree_mean", "avg(z)"), ("ree_max", "max(z)"), ("ree_p95", "quantile_cont(z, 0.95)"), ("sipe", "(SELECT sqrt(sum((g - h) ** 2)) / greatest(sqrt(sum(g * g)), 1e-12) FROM gr)")) + " FROM r")
def spectral_report(g):
    a = settled(assignment_of(g))
    out = G.spectral_report(g, settled(A.coarse_edges(g.edges, a)), a, x_of(g), EQUAL, settle=settled)
    return r(out, *out.columns)


@query(f"SELECT {O.r(_FE.format(x='x', e='ne'))} AS energy")
def fused_energy(g):
    return r(G.fused_energy(g.edges, x_of(g), EQUAL), "energy")


@query("SELECT " + rs(("mean", "avg(error)"), ("largest", "max(error)"), ("p95", "quantile_cont(error, 0.95)")) + f" FROM (SELECT abs(b.energy - a.energy) / greatest(abs(a.energy), 1e-12) AS error FROM ({_EN.format(e='edges', x='x')}) a JOIN ({_EN.format(e='coarse', x='xm')}) b USING (rel_id))")
def relation_energy_error(g):
    e = D.energy_errors(g.edges, coarse_of(g), x_of(g), assignment_of(g))
    return r(e.agg(F.avg("error").alias("mean"), F.max("error").alias("largest"), F.percentile("error", F.lit(0.95)).alias("p95")), "mean", "largest", "p95")


@query()
def eigenvalue_sanity(g):
    return g.nodes.sparkSession.createDataFrame([(k, round(v, 6)) for k, v in enumerate(G.eigenvalues(small(g), EQUAL, 64))], "k int, value double")


def _base_sql(name: str, order: str) -> str:
    return f"{name} AS MATERIALIZED (SELECT n.node_id, CASE WHEN c = 2 THEN s ELSE n.node_id END AS super_id FROM (SELECT node_id, min(node_id) OVER w AS s, count(*) OVER w AS c FROM (SELECT n.node_id, n.type_id, n.part_id, (row_number() OVER (PARTITION BY n.type_id, n.part_id ORDER BY {order}, n.node_id) - 1) // 2 AS q FROM nodes n LEFT JOIN mass m USING (node_id)) WINDOW w AS (PARTITION BY type_id, part_id, q)) n)"


def _base_row(name: str, label: str) -> str:
    return f"SELECT '{label}' AS method, (SELECT {O.r('count(DISTINCT super_id) / count(*)')} FROM {name}) AS ratio, {O.r('avg(error)')} AS energy_error_mean, {O.r('max(error)')} AS energy_error_max FROM (SELECT abs(b.energy - a.energy) / greatest(abs(a.energy), 1e-12) AS error FROM ({_EN.format(e='edges', x='x')}) a JOIN ({_EN.format(e=name + 'e', x=name + 'x')}) b USING (rel_id))"


def _base_more(n: str) -> str:
    return f"{n}e AS MATERIALIZED (SELECT rel_id, a.super_id AS src, b.super_id AS dst, sum(w) AS w FROM edges e JOIN {n} a ON a.node_id = src JOIN {n} b ON b.node_id = dst GROUP BY 1, 2, 3), {n}x AS MATERIALIZED (SELECT super_id AS node_id, j, avg(v) AS v FROM x JOIN {n} USING (node_id) GROUP BY 1, 2)"


@query(f"WITH {_base_sql('b0', O.mixed('n.node_id', '0', 5))}, {_base_sql('b1', 'coalesce(m.mass, 0)')}, {_base_more('b0')}, {_base_more('b1')} {_base_row('b0', 'random')} UNION ALL {_base_row('b1', 'degree')}")
def baseline_comparison(g):
    return r(G.baseline_report(g, x_of(g), ("random", "degree")), "ratio", "energy_error_mean", "energy_error_max")


@query("WITH s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rel_id ORDER BY src, dst) - 1 AS p, count(*) OVER (PARTITION BY rel_id) AS n, 512 AS k FROM edges WHERE rel_id = 0) WHERE " + _SPACED + ") SELECT count(*) AS sampled, " + rs(("before", "avg(coalesce(b.c, 0))"), ("after", "avg(coalesce(a.c, 0))"), ("error", "abs(avg(coalesce(a.c, 0)) - avg(coalesce(b.c, 0))) / greatest(abs(avg(coalesce(b.c, 0))), 1e-12)")) + " FROM s LEFT JOIN (SELECT src AS m, count(DISTINCT dst) AS c FROM edges WHERE rel_id = 2 GROUP BY 1) b ON b.m = s.dst JOIN asg ON asg.node_id = s.dst LEFT JOIN (SELECT src AS m, count(DISTINCT dst) AS c FROM coarse WHERE rel_id = 2 GROUP BY 1) a ON a.m = asg.super_id")
def two_step_connectivity(g):
    return r(G.two_step_connectivity(g.edges, coarse_of(g), assignment_of(g), 0, 2), "before", "after", "error")


@query(f"WITH {_FOUR} SELECT s.super_id, coalesce(label, -1)::INTEGER AS label, coalesce(t, 0)::BIGINT AS labelled, " + O.r("coalesce(e, 0)") + " AS entropy FROM (SELECT DISTINCT super_id FROM four) s LEFT JOIN (SELECT super_id, arg_max(label, c * 1000 - label) AS label, any_value(t) AS t, sum(-(c::DOUBLE / t) * ln(c::DOUBLE / t)) AS e FROM (SELECT super_id, k.label, count(*) AS c, sum(count(*)) OVER (PARTITION BY super_id) AS t FROM four JOIN known k USING (node_id) GROUP BY 1, 2) GROUP BY 1) q USING (super_id)")
def train_only_labels(g):
    return r(G.train_labels(g.nodes, four_of(g), known(g)), "entropy")


# --- sources and the whole plan


def scratch(g) -> str:
    """A folder of its own in the shared checkpoint folder."""
    return f"{checkpoint_folder(g.nodes.sparkSession)}/query-{uuid.uuid4().hex}"


@query("SELECT rel_id, m AS n, vol AS volume FROM ecount")
def graph_round_trip(g):
    path = scratch(g)
    save_graph(g, path)
    return load_graph(g.nodes.sparkSession, path).edges.groupBy("rel_id").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("volume"))


@query("SELECT rel_id, name, m AS edges, vol AS weight FROM ecount JOIN rels USING (rel_id)")
def graph_summary(g):
    return summary(g)


@query("SELECT 'type' AS kind, type_id::BIGINT AS key, count(*) AS n FROM nodes GROUP BY 2 UNION ALL SELECT 'relation', rel_id, m FROM ecount WHERE rel_id IN (0, 2, 9) UNION ALL SELECT 'class', label, count(*) FROM known GROUP BY 2")
def text_graph_audit(g):
    """Written as text with three relations and the known labels, read again and counted."""
    path = scratch(g)
    write_text_graph(g, path, known(g), g.nodes_of_type(0).where("node_id % 5 = 0"), [9, 0, 2])
    t = read_text_graph(g.nodes.sparkSession, path)
    back = F.element_at(F.array(F.lit(9), F.lit(0), F.lit(2)), F.col("key") + 1)
    out = sources.text_graph_audit(t)
    return out.select("kind", F.when(F.col("kind") == "relation", back).otherwise(F.col("key")).cast("long").alias("key"), "n")


@query("SELECT rel_id, count(*) AS n, sum(s)::BIGINT AS sources, sum(d)::BIGINT AS destinations FROM (SELECT rel_id, (row_number() OVER (PARTITION BY rel_id, src) = 1)::INTEGER AS s, (row_number() OVER (PARTITION BY rel_id, dst) = 1)::INTEGER AS d FROM edges) GROUP BY 1")
def export_package(g):
    path = scratch(g)
    sources.export_package(g, path, 0, {"train": known(g), "test": g.nodes_of_type(0).where("node_id % 5 = 0")})
    e = g.nodes.sparkSession.read.parquet(f"{path}/edges")
    return e.groupBy(F.col("rel_id").cast("int").alias("rel_id")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("destinations"))


_SY = "SELECT {r}::INTEGER AS rel_id, s AS src, {to} + ((" + O.mixed("s", "1") + ") + c * ({m} // {k})) % {m} AS dst FROM range({a}, {b}) t(s), range({k}) u(c)"
_SYN = f"sy AS MATERIALIZED ({_SY.format(r=0, to=60, m=30, k=3, a=0, b=60)} UNION ALL {_SY.format(r=2, to=90, m=12, k=2, a=60, b=90)}), sz AS MATERIALIZED (SELECT * FROM sy UNION ALL SELECT rel_id + 1, dst, src FROM sy UNION ALL SELECT 4, s, (s + 1) % 60 FROM range(60) t(s))"


@query(f"WITH {_SYN} SELECT rel_id::INTEGER AS rel_id, src, dst FROM sz")
def synthetic_graph(g):
    return sources.synthetic_graph(g.nodes.sparkSession, 60, 30, 12).edges.select("rel_id", "src", "dst")


@query("SELECT n.node_id, CASE type_id WHEN 0 THEN node_id WHEN 1 THEN node_id - 10000000000 + (SELECT count(*) FROM nodes WHERE type_id = 0) END AS new_id FROM nodes n WHERE type_id IN (0, 1)")
def typed_import(g):
    """Customers and orders as tables by type, imported and told by their new ids."""
    part = lambda t: g.nodes_of_type(t).select((F.col("node_id") - t * 10_000_000_000).alias("local_id"))
    made = sources.from_typed_tables({"customer": part(0), "orders": part(1)}, {("customer", "places", "orders"): g.edges.where("rel_id = 0").select("src", (F.col("dst") - 10_000_000_000).alias("dst"), "w")})
    first = g.nodes_of_type(0).agg((F.max("node_id") + 1).alias("n"))
    return made.nodes.join(F.broadcast(first)).select(F.when(F.col("type_id") == 0, F.col("node_id")).otherwise(F.col("node_id") - F.col("n") + 10_000_000_000).alias("node_id"), F.col("node_id").alias("new_id"))


def small(g) -> HeteroGraph:
    """Customers, orders and nations, whose levels are made in a query's time. All edges between them are of four relations, which
    Spark can tell before it makes the others."""
    rels = "rel_id IN (0, 1, 6, 9)"
    part = HeteroGraph(g.nodes, g.edges.where(rels), g.relations, g.features).induced(settled(g.nodes.where("type_id IN (0, 1, 4)")))
    return HeteroGraph(settled(part.nodes), settled(part.edges), g.relations.where(rels), settled(part.features))


def level_of(g, **over) -> tuple[HeteroGraph, plans.Level]:
    h = small(g)
    c = load_config(**({"sketch": {"dim": 4, "order": 2}, "candidates": {"keep": 4, "hub_cap": 8, "pair_cap": 16}} | over))
    n = h.nodes.count()
    return h, plans.one_level(h, c, M.level_budget(n, plans.level_target(n, 0.5)))


@query("SELECT count(*) AS nodes, (n - greatest(ceil(n * 0.5), ceil(n * greatest(0.55, ceil(n * 0.5) / n))))::BIGINT AS merges_allowed, true AS within_budget, true AS sound FROM (SELECT count(*) AS n FROM nodes WHERE type_id IN (0, 1, 4)), nodes WHERE type_id IN (0, 1, 4) GROUP BY n")
def one_level_metrics(g):
    """One whole level: candidates of four sources, scored pairs, clusters and the coarse graph, and whether it keeps its rules."""
    h, level = level_of(g)
    n = h.nodes.count()
    allowed = M.level_budget(n, plans.level_target(n, 0.5))
    merged = n - level.assignment.select("super_id").distinct().count()
    bad = G.level_invariants(h, A.coarse_graph(h, level.assignment), level.assignment).first()
    sound = not any(bad[k] for k in ("schema_violations", "invalid_assignments", "relation_violations", "missing_relations", "node_count_violation", "weight_violation"))
    return g.nodes.sparkSession.createDataFrame([(n, allowed, 0 < merged <= allowed, sound)], "nodes long, merges_allowed long, within_budget boolean, sound boolean")


@query()
def one_level_assignment(g):
    return level_of(g)[1].assignment


@query()
def one_level_mutual_best(g):
    return level_of(g, matching={"method": "mutual_best"})[1].assignment


@query("SELECT k::INTEGER AS level, true AS smaller, true AS weight_kept FROM range(2) t(k)")
def multilevel_ratio(g):
    """Two levels of the plan, written and read again: each is smaller and keeps all weight."""
    h = small(g)
    levels = plans.coarsen(h, scratch(g), {"levels": 2, "target_ratio": 0.3, "sketch": {"dim": 4, "order": 1}, "candidates": {"keep": 4, "hub_cap": 8, "pair_cap": 16}})
    rows, n, w = [], h.nodes.count(), h.edges.agg(F.sum("w")).first()[0]
    for k, level in enumerate(levels):
        m = level.nodes.count()
        rows.append((k, m < n, abs(level.edges.agg(F.sum("w")).first()[0] - w) < 1e-6 * w))
        n = m
    return g.nodes.sparkSession.createDataFrame(rows, "level int, smaller boolean, weight_kept boolean")


# --- paths


@query()
def schema_paths(g):
    rows = H.schema_paths(g.relations.collect(), 0)
    return g.nodes.sparkSession.createDataFrame([(n, s, e, ",".join(map(str, p))) for n, s, e, p in rows], "name string, start_type int, end_type int, steps string")


def _walk(steps: list[int], most: int) -> str:
    parts = [f"k0 AS MATERIALIZED (SELECT node_id AS start, node_id AS n0 FROM nodes WHERE type_id = 0 AND node_id IN (SELECT src FROM edges WHERE rel_id = {steps[0]}) ORDER BY {O.mixed('node_id')}, node_id LIMIT {most})"]
    for k, rel in enumerate(steps):
        names = ", ".join(["start", *[f"n{i}" for i in range(k + 1)]])
        parts.append(f"k{k + 1} AS MATERIALIZED (SELECT {names}, dst AS n{k + 1} FROM k{k} JOIN edges ON src = n{k} AND rel_id = {rel} QUALIFY row_number() OVER (PARTITION BY {names} ORDER BY {O.mixed('start + dst', str(k + 1))}, dst) = 1)")
    return ", ".join(parts)


@query(f"WITH {_walk([0, 2], 500)} SELECT * FROM k2")
def typed_path_sample(g):
    return H.sample_paths(g, [0, 2], 500)


_PS = f"{_walk([0, 2], 500)}, cl AS (SELECT k2.*, a.super_id AS c0, b.super_id AS c1, c.super_id AS c2 FROM k2 JOIN asg a ON a.node_id = n0 JOIN asg b ON b.node_id = n1 JOIN asg c ON c.node_id = n2), ps AS MATERIALIZED (SELECT start, (w0 IS NOT NULL)::INTEGER + (w1 IS NOT NULL)::INTEGER AS t, (u0 IS NOT NULL)::INTEGER + (u1 IS NOT NULL)::INTEGER AS u, c0, c1, c2, w0, w1, (SELECT count(*) FROM (SELECT DISTINCT src, dst FROM edges WHERE rel_id = 0 AND src = n0) p JOIN (SELECT DISTINCT src, dst FROM edges WHERE rel_id = 2 AND dst = n2) q ON q.src = p.dst) AS bef, (SELECT count(*) FROM (SELECT DISTINCT src, dst FROM coarse WHERE rel_id = 0 AND src = c0) p JOIN (SELECT DISTINCT src, dst FROM coarse WHERE rel_id = 2 AND dst = c2) q ON q.src = p.dst) AS aft FROM cl LEFT JOIN (SELECT src, dst, w AS w0 FROM coarse WHERE rel_id = 0) x0 ON x0.src = c0 AND x0.dst = c1 LEFT JOIN (SELECT src, dst, w AS w1 FROM coarse WHERE rel_id = 2) x1 ON x1.src = c1 AND x1.dst = c2 LEFT JOIN (SELECT DISTINCT src, dst, 1 AS u0 FROM coarse) y0 ON y0.src = c0 AND y0.dst = c1 LEFT JOIN (SELECT DISTINCT src, dst, 1 AS u1 FROM coarse) y1 ON y1.src = c1 AND y1.dst = c2)"


@query(f"WITH {_PS} SELECT count(*) AS samples, " + rs(("typed", "avg(t / 2)"), ("untyped", "avg(u / 2)"), ("gap", "avg((u - t) / 2)"), ("ends_collapse", "avg((c0 = c2)::INTEGER)"), ("step_collapse", "avg((c0 = c1 OR c1 = c2)::INTEGER)"), ("unique_share", "avg(len(list_distinct([c0, c1, c2])) / 3)"), ("length", "avg(3 - (c0 = c1)::INTEGER - (c1 = c2)::INTEGER)"), ("before", "avg(least(bef, 4096))"), ("after", "avg(least(aft, 4096))"), ("log_count_error", "avg(abs(ln(1 + least(aft, 4096)) - ln(1 + least(bef, 4096))))"), ("log_weight", "avg(CASE WHEN t > 0 THEN (coalesce(ln(1 + w0), 0) + coalesce(ln(1 + w1), 0)) / t END)"), ("missing", "avg((2 - t) / 2)")) + " FROM ps")
def path_survival_summary(g):
    a = settled(assignment_of(g))
    rows = H.path_survival(settled(H.sample_paths(g, [0, 2], 500)), [0, 2], g, settled(A.coarse_edges(g.edges, a)), a)
    out = H.survival_summary(rows)
    return r(out, *[c for c in out.columns if c != "samples"])


def _gauss(seed: int, of: str) -> str:
    return f"SELECT node_id, type_id, j, sqrt(-2.0::DOUBLE * ln(({O.mixed('node_id', 'j', seed)} + 0.5::DOUBLE) / 2147483647.0::DOUBLE)) * cos(2.0::DOUBLE * pi() * (({O.mixed('node_id', 'j', seed + 1)} + 0.5::DOUBLE) / 2147483647.0::DOUBLE)) AS v FROM ({of}), range(2) q(j)"


_TM = f"tp AS MATERIALIZED (SELECT node_id, j, CASE WHEN type_id = 2 THEN v ELSE 0 END AS v FROM ({_gauss(0, 'SELECT node_id, type_id FROM nodes')})), tc AS MATERIALIZED (SELECT super_id AS node_id, j, avg(v) AS v FROM tp JOIN asg USING (node_id) GROUP BY 1, 2)"


def _back(edges: str, x: str, y: str) -> str:
    st = f"(SELECT rel_id, src, dst, w / greatest(sum(w) OVER (PARTITION BY rel_id, src), 1e-12) AS w FROM {edges})"
    return f"{y}1 AS MATERIALIZED (SELECT src AS node_id, j, sum(w * v) AS v FROM {st} JOIN {x} ON node_id = dst WHERE rel_id = 2 GROUP BY 1, 2), {y} AS MATERIALIZED (SELECT src AS node_id, j, sum(w * v) AS v FROM {st} JOIN {y}1 ON node_id = dst WHERE rel_id = 0 GROUP BY 1, 2)"


@query(f"WITH {_TM}, {_back('edges', 'tp', 'ya')}, {_back('coarse', 'tc', 'yb')}, z AS MATERIALIZED (SELECT n.node_id, q.j, coalesce(a.v, 0) AS a, coalesce(b.v, 0) AS b FROM nodes n JOIN asg USING (node_id) CROSS JOIN range(2) q(j) LEFT JOIN ya a ON a.node_id = n.node_id AND a.j = q.j LEFT JOIN yb b ON b.node_id = asg.super_id AND b.j = q.j WHERE n.type_id = 0), m AS MATERIALIZED (SELECT node_id, sqrt(sum(a * a)) AS na, sqrt(sum(b * b)) AS nb FROM z GROUP BY 1), k AS (SELECT greatest(1, count(*) // 10) AS k FROM m) SELECT " + rs(("relative_error", "sqrt(sum((a - b) ** 2)) / greatest(sqrt(sum(a * a)), 1e-12)"), ("rmse", "sqrt(avg((a - b) ** 2))"), ("mae", "avg(abs(a - b))"), ("cosine", "sum(a * b) / greatest(sqrt(sum(a * a) * sum(b * b)), 1e-12)"), ("correlation", "corr(a, b)"), ("energy_error", "abs(sum(b * b) - sum(a * a)) / greatest(sum(a * a), 1e-12)"), ("mass_error", "abs(sum(abs(b)) - sum(abs(a))) / greatest(sum(abs(a)), 1e-12)"), ("mass_l1", "(SELECT sum(abs(na / (SELECT sum(na) FROM m) - nb / (SELECT sum(nb) FROM m))) FROM m)"), ("top_overlap", "(SELECT count(*) / any_value(k) FROM (SELECT node_id, row_number() OVER (ORDER BY round(na, 9) DESC, node_id) AS p, row_number() OVER (ORDER BY round(nb, 9) DESC, node_id) AS q FROM m), k WHERE p <= k AND q <= k)")) + " FROM z")
def path_transition_mass(g):
    a = settled(assignment_of(g))
    out = H.transition_mass(g, settled(A.coarse_edges(g.edges, a)), a, ("p", 0, 2, [0, 2]), 2)
    return r(out, *out.columns)


_HC = Z.chebyshev_coefficients(2, 1.0)


def _hf(x: str, e: str, y: str) -> str:
    t = f"(SELECT src AS a, dst AS b, w FROM {e} UNION ALL SELECT dst, src, w FROM {e})"
    return f"{y}a AS MATERIALIZED (SELECT b AS node_id, j, sum(0.5::DOUBLE * t.w * v) / 11 AS v FROM {t} t JOIN {x} ON node_id = a GROUP BY 1, 2), {y}b AS MATERIALIZED (SELECT b AS node_id, j, sum(0.5::DOUBLE * t.w * v) / 11 AS v FROM {t} t JOIN {y}a ON node_id = a GROUP BY 1, 2), {y} AS MATERIALIZED (SELECT node_id, j, sum(v) AS v FROM (SELECT node_id, j, {_HC[0] - _HC[2]!r}::DOUBLE * v AS v FROM {x} UNION ALL SELECT node_id, j, {-_HC[1]!r}::DOUBLE * v FROM {y}a UNION ALL SELECT node_id, j, {2 * _HC[2]!r}::DOUBLE * v FROM {y}b) GROUP BY 1, 2)"


@query(f"WITH hp AS MATERIALIZED (SELECT node_id, j, CASE WHEN s > 1e-12 THEN (v - m) / s ELSE 0 END AS v FROM (SELECT *, avg(v) OVER w AS m, stddev_pop(v) OVER w AS s FROM ({_gauss(3, 'SELECT node_id, type_id FROM nodes')}) WINDOW w AS (PARTITION BY type_id, j))), hc AS MATERIALIZED (SELECT super_id AS node_id, j, avg(v) AS v FROM hp JOIN asg USING (node_id) GROUP BY 1, 2), {_hf('hp', 'ne', 'ha')}, {_hf('hc', 'cne', 'hb')}, hm AS MATERIALIZED (SELECT super_id AS node_id, j, avg(v) AS v FROM ha JOIN asg USING (node_id) GROUP BY 1, 2), up AS MATERIALIZED (SELECT asg.node_id, j, v FROM asg JOIN hb ON hb.node_id = super_id), o AS (SELECT sqrt(sum((a.v - b.v) ** 2)) / greatest(sqrt(sum(a.v * a.v)), 1e-12) AS r, sum(a.v * b.v) / greatest(sqrt(sum(a.v * a.v) * sum(b.v * b.v)), 1e-12) AS c, abs(sum(b.v * b.v) - sum(a.v * a.v)) / greatest(sum(a.v * a.v), 1e-12) AS e FROM hm a JOIN hb b ON b.node_id = a.node_id AND b.j = a.j), tw AS (SELECT n.type_id, sum((a.v - b.v) ** 2) AS d, sum(a.v * a.v) AS n FROM ha a JOIN up b ON b.node_id = a.node_id AND b.j = a.j JOIN nodes n ON n.node_id = a.node_id GROUP BY 1), d AS (SELECT (SELECT sum(energy) FROM ({_EN.format(e='edges', x='ha')})) AS p, (SELECT sum(energy) FROM ({_EN.format(e='edges', x='up')})) AS q), f AS (SELECT avg(abs(b.energy - a.energy) / greatest(abs(a.energy), 1e-12)) AS f FROM ({_EN.format(e='coarse', x='hm')}) a JOIN ({_EN.format(e='coarse', x='hb')}) b USING (rel_id)) SELECT " + rs(("relative_error", "r"), ("cosine", "c"), ("energy_error", "e"), ("lifted_error", "(SELECT sqrt(sum(d)) / sqrt(sum(n)) FROM tw)"), ("dirichlet_error", "(SELECT abs(q - p) / greatest(abs(p), 1e-12) FROM d)"), ("relation_error", "(SELECT f FROM f)"), ("worst_type_error", "(SELECT max(sqrt(d) / greatest(sqrt(n), 1e-12)) FROM tw)")) + " FROM o")
def holdout_probe_errors(g):
    g = kept(g)
    a = settled(assignment_of(g))
    coarse = settled(A.coarse_edges(g.edges, a))
    out = H.holdout_errors(g, settled(L.normalized(g.edges)), coarse, settled(L.normalized(coarse)), a, RELS, 2, 2, 1.0, 3, settled)
    return r(out, *out.columns)


@query()
def label_propagation_curve(g):
    g = kept(g)
    return r(G.label_propagation(g, settled(assignment_of(g)), 3, settle=settled), "accuracy", digits=4)


# --- task-first terms


def state_of(g) -> R.State:
    top = settled(T.anchor_topk(g.edges, g.nodes, 0, 3))
    s = R.build_state(g, 0, known(g), top, 5)
    return R.State(settled(s.table), 5)


def support_pairs(g) -> DataFrame:
    return pairs_of(g).where("type_id != 0").select("i", "j")


def _long(table: str, dim: str) -> str:
    return f"SELECT i, j, d, sum(a) AS a, sum(b) AS b FROM (SELECT i, j, {dim} AS d, p AS a, 0.0::DOUBLE AS b FROM spairs JOIN {table} ON node_id = i UNION ALL SELECT i, j, {dim}, 0.0::DOUBLE, p FROM spairs JOIN {table} ON node_id = j) GROUP BY 1, 2, 3"


def _rowdist(table: str, dim: str, eps: str = "1e-12") -> str:
    return f"SELECT i, j, sum((a - b) ** 2) / greatest(sum(a * a) + sum(b * b), {eps}) AS d FROM ({_long(table, dim)}) GROUP BY 1, 2"


def _js(table: str = "cfoot", dim: str = "label") -> str:
    return f"SELECT i, j, sum(((CASE WHEN a > 0 THEN a * ln(a / ((a + b) / 2)) ELSE 0 END) + (CASE WHEN b > 0 THEN b * ln(b / ((a + b) / 2)) ELSE 0 END)) / 2) AS d FROM ({_long(table, dim)}) GROUP BY 1, 2"


@query("SELECT node_id, j, v + 0.0 AS v FROM seed")
def target_seed(g):
    return dense(R.seeds(g.nodes, known(g), 5))


def _bank(x: str, e: str, n: int, name: str) -> str:
    parts, now = [], x
    for k in range(n):
        parts.append(f"{name}{k + 1} AS MATERIALIZED ({_SM.format(x=now, e=e)})")
        now = f"{name}{k + 1}"
    return ", ".join(parts)


@query(f"WITH {_bank('seed', 'ne', 2, 'fb')} SELECT node_id, j, {O.r('v')} AS v FROM fb2 JOIN nodes USING (node_id) WHERE type_id = 0")
def target_filter_bank(g):
    bank = R.filter_bank(g.edges, R.seeds(g.nodes, known(g), 5), RELS, (0.25, 1.0), settled)
    return dense(bank[1.0].join(g.nodes_of_type(0).select("node_id"), "node_id", "left_semi"))


_CSEED = "cs AS MATERIALIZED (SELECT super_id AS node_id, j, avg(v) AS v FROM seed JOIN asg USING (node_id) GROUP BY 1, 2)"


def _err(a: str, b: str) -> str:
    """|a - b|^2 over |a|^2 on the targets; b is of clusters."""
    return f"(SELECT sum((coalesce(a.v, 0) - coalesce(b.v, 0)) ** 2) / greatest(sum(coalesce(a.v, 0) ** 2), 1e-12) FROM nodes n JOIN asg USING (node_id) CROSS JOIN range(5) q(j) LEFT JOIN {a} a ON a.node_id = n.node_id AND a.j = q.j LEFT JOIN {b} b ON b.node_id = asg.super_id AND b.j = q.j WHERE n.type_id = 0)"


@query(f"WITH {_CSEED}, {_bank('seed', 'ne', 8, 'fa')}, {_bank('cs', 'cne', 8, 'fc')} SELECT {O.r('(' + _err('fa2', 'fc2') + ' * 2 + ' + _err('fa8', 'fc8') + ') / 3')} AS error")
def target_response_error(g):
    g = kept(g)
    e = R.response_error(g, settled(assignment_of(g)), settled(R.seeds(g.nodes, known(g), 5)), 0, RELS, settle=settled)
    return one_row(g, error=round(e, 6))


def _there(edges: str, x: str, rel: int, first: str, name: str) -> str:
    a, b = ("src", "dst") if first == "forward" else ("dst", "src")
    return f"{name}m AS MATERIALIZED (SELECT {b} AS node_id, j, sum(w * v) AS v FROM {edges} JOIN {x} ON node_id = {a} WHERE rel_id = {rel} GROUP BY 1, 2), {name} AS MATERIALIZED (SELECT {a} AS node_id, j, sum(w * v) AS v FROM {edges} JOIN {name}m ON node_id = {b} WHERE rel_id = {rel} GROUP BY 1, 2)"


@query(f"WITH {_CSEED}, " + ", ".join(f"{_there('ne', 'seed', k, d, f'ra{k}')}, {_there('cne', 'cs', k, d, f'rc{k}')}" for k, d in ((0, "forward"), (1, "backward"), (6, "forward"))) + " " + " UNION ALL ".join(f"SELECT {k}::INTEGER AS rel_id, {O.r(_err(f'ra{k}', f'rc{k}'))} AS error" for k in (0, 1, 6)))
def relation_response_errors(g):
    e = R.relation_response_errors(g, settled(assignment_of(g)), settled(R.seeds(g.nodes, known(g), 5)), 0)
    return r(g.nodes.sparkSession.createDataFrame(list(e.items()), "rel_id int, error double"), "error")


@query(f"SELECT node_id, dim, {O.r('p')} AS p FROM rfoot")
def support_relation_footprint(g):
    return r(R.relation_footprints(g.edges, g.relations, 0), "p")


@query(f"SELECT node_id, label, {O.r('p')} AS p FROM cfoot")
def class_footprint_onehop(g):
    return r(R.class_footprints(g.edges, g.relations, 0, known(g)), "p")


@query(f"SELECT node_id, label, {O.r('m / greatest(sum(m) OVER (PARTITION BY node_id), 1e-12)')} AS p FROM ctwo")
def class_footprint_twohop(g):
    return r(R.class_footprints(g.edges, g.relations, 0, known(g), "twohop"), "p")


@query(f"SELECT node_id, label, {O.r('m / greatest(sum(m) OVER (PARTITION BY node_id), 1e-12)')} AS p FROM (SELECT node_id, label, sum(m) AS m FROM (SELECT * FROM cmass UNION ALL SELECT node_id, label, 0.5::DOUBLE * m FROM ctwo) GROUP BY 1, 2)")
def class_footprint_hybrid(g):
    return r(R.class_footprints(g.edges, g.relations, 0, known(g), "hybrid"), "p")


_STATE = "fs AS MATERIALIZED (SELECT n.node_id, CASE WHEN c.node_id IS NOT NULL THEN 'known' WHEN q.node_id IS NOT NULL OR a.node_id IS NOT NULL THEN 'connected' ELSE 'weak' END AS state FROM nodes n LEFT JOIN (SELECT DISTINCT node_id FROM cfoot) c ON c.node_id = n.node_id LEFT JOIN (SELECT DISTINCT node_id FROM rfoot) q ON q.node_id = n.node_id LEFT JOIN (SELECT DISTINCT node_id FROM anch) a ON a.node_id = n.node_id WHERE n.type_id <> 0)"


@query(f"WITH {_STATE} SELECT node_id, state FROM fs")
def footprint_state(g):
    return state_of(g).table.select("node_id", "state")


_PURE = f"WITH {_STATE}, js AS MATERIALIZED ({_js()}), rd AS MATERIALIZED ({_rowdist('rfoot', 'dim')}), pp0 AS MATERIALIZED (SELECT p.i, p.j, round(coalesce(js.d, 0), 9) AS js, round(coalesce(rd.d, 0), 9) AS rd, a.state = 'known' AS ka, b.state = 'known' AS kb FROM spairs p JOIN fs a ON a.node_id = p.i JOIN fs b ON b.node_id = p.j LEFT JOIN js ON js.i = p.i AND js.j = p.j LEFT JOIN rd ON rd.i = p.i AND rd.j = p.j)"
_POLICY = {"zero_as_no_conflict": "js <= 0.35", "purity_v2": "CASE WHEN ka AND kb THEN js <= 0.35 WHEN ka OR kb THEN false ELSE rd <= 0.35 END", "unknown_blocks_known": "CASE WHEN ka AND kb THEN js <= 0.35 ELSE NOT (ka OR kb) END", "unknown_propagated": "CASE WHEN ka AND kb THEN js <= 0.35 WHEN ka OR kb THEN rd <= 0.35 ELSE true END"}
for _p, _cond in _POLICY.items():

    def _gate(g, p=_p):
        return R.allowed(R.with_state(support_pairs(g), state_of(g)), 0, policy=p).select("i", "j")

    _gate.__name__ = "purity_gate" if _p == "zero_as_no_conflict" else f"purity_gate_{_p}"
    query(f"{_PURE} SELECT i, j FROM pp0 WHERE {_cond}")(_gate)


@query(f"{_PURE}, sq AS (SELECT i, j, sum((a - b) ** 2) / 4 AS d FROM ({_long('cfoot', 'label')}) GROUP BY 1, 2) SELECT i, j, " + O.r("CASE WHEN ka AND kb THEN coalesce(d, 0) WHEN ka OR kb THEN 1 ELSE 0.25::DOUBLE * rd END") + " AS pur FROM pp0 LEFT JOIN sq USING (i, j)")
def purity_delta(g):
    both = R.with_state(support_pairs(g), state_of(g))
    return r(both.select("i", "j", R.purity_delta(both, "purity_v2").alias("pur")), "pur")


_COV = f"js AS MATERIALIZED ({_js()}), nrm AS MATERIALIZED (SELECT *, greatest(sum(w * w) OVER (PARTITION BY target_id, rel_id), 1e-12) AS norm FROM anchors3), sa AS MATERIALIZED (SELECT p.i, p.j, avg((a.w * a.w + b.w * b.w) / a.norm) AS s FROM apairs p JOIN nrm a ON a.node_id = p.i JOIN nrm b ON b.node_id = p.j AND b.target_id = a.target_id AND b.rel_id = a.rel_id GROUP BY 1, 2), na AS (SELECT node_id, count(*) AS n FROM anch GROUP BY 1), jd AS MATERIALIZED (SELECT p.i, p.j, CASE WHEN coalesce(x.n, 0) + coalesce(y.n, 0) = 0 THEN 0 ELSE 1 - coalesce(c, 0) / (coalesce(x.n, 0) + coalesce(y.n, 0) - coalesce(c, 0)) END AS jac FROM apairs p LEFT JOIN na x ON x.node_id = p.i LEFT JOIN na y ON y.node_id = p.j LEFT JOIN (SELECT p.i, p.j, count(*) AS c FROM apairs p JOIN anch a ON a.node_id = p.i JOIN anch b ON b.node_id = p.j AND b.target_id = a.target_id GROUP BY 1, 2) k ON k.i = p.i AND k.j = p.j)"


def anchor_mates(g) -> DataFrame:
    """Support pairs, and pairs of nodes that share an anchor."""
    top = T.anchor_topk(g.edges, g.nodes, 0, 3)
    return support_pairs(g).unionByName(T.anchor_co_support(top, g.nodes, 8).select("i", "j")).distinct()


_AP = "apairs AS MATERIALIZED (SELECT i, j FROM spairs UNION SELECT p.node_id, q.node_id FROM (SELECT * FROM (SELECT a.target_id, a.node_id, type_id, part_id, row_number() OVER (PARTITION BY a.target_id, type_id, part_id ORDER BY a.node_id) AS r FROM anch a JOIN nodes USING (node_id)) WHERE r <= 8) p JOIN (SELECT * FROM (SELECT a.target_id, a.node_id, type_id, part_id, row_number() OVER (PARTITION BY a.target_id, type_id, part_id ORDER BY a.node_id) AS r FROM anch a JOIN nodes USING (node_id)) WHERE r <= 8) q ON p.target_id = q.target_id AND p.type_id = q.type_id AND p.part_id = q.part_id AND p.node_id < q.node_id)"


@query(f"WITH {_AP}, {_COV.replace('spairs', 'apairs')} SELECT p.i, p.j, " + rs(("same_anchor", "coalesce(s, 0)"), ("class_context", "coalesce(js.d, 0)"), ("cross_anchor", "jac * coalesce(js.d, 0)"), ("combined", "coalesce(s, 0) + jac * coalesce(js.d, 0) + coalesce(js.d, 0)"), ("coverage_v2", "jac + coalesce(js.d, 0) + jac * coalesce(js.d, 0)")) + " FROM apairs p LEFT JOIN sa ON sa.i = p.i AND sa.j = p.j LEFT JOIN js ON js.i = p.i AND js.j = p.j JOIN jd ON jd.i = p.i AND jd.j = p.j")
def coverage_components(g):
    both = R.with_state(anchor_mates(g), state_of(g))
    modes = ("same_anchor", "class_context", "cross_anchor", "combined", "coverage_v2")
    return r(both.select("i", "j", *[R.coverage(both, m).alias(m) for m in modes]), *modes)


_XD = "xd AS MATERIALIZED (SELECT p.i AS i, p.j AS j, sum((a.v - b.v) ** 2) / greatest(sum(a.v * a.v) + sum(b.v * b.v), 1e-8) AS d FROM spairs p JOIN flat a ON a.node_id = p.i JOIN flat b ON b.node_id = p.j AND b.j = a.j GROUP BY 1, 2)"
_TD = f"WITH {_COV.replace('apairs', 'spairs')}, {_XD}, cd AS MATERIALIZED ({_rowdist('cfoot', 'label', '1e-8')}), rd AS MATERIALIZED ({_rowdist('rfoot', 'dim', '1e-8')}), sq AS MATERIALIZED (SELECT i, j, sum((a - b) ** 2) / 4 AS d FROM ({_long('cfoot', 'label')}) GROUP BY 1, 2), td AS MATERIALIZED (SELECT p.i, p.j, coalesce(cd.d, 0) AS spec, coalesce(rd.d, 0) AS rel, coalesce(s, 0) AS cov, coalesce(sq.d, 0) AS pur, coalesce(xd.d, 0) AS feat FROM spairs p LEFT JOIN cd ON cd.i = p.i AND cd.j = p.j LEFT JOIN rd ON rd.i = p.i AND rd.j = p.j LEFT JOIN sa ON sa.i = p.i AND sa.j = p.j LEFT JOIN sq ON sq.i = p.i AND sq.j = p.j LEFT JOIN xd ON xd.i = p.i AND xd.j = p.j)"


def _tp95(t: str) -> str:
    return _p95(t).replace("FROM scored", "FROM td")


_TC = " + ".join(f"{w}::DOUBLE * {{{t}}}" for t, w in R.LAMBDAS.items())
_RAW_TC, _NORM_TC = _TC.format(**{t: t for t in R.LAMBDAS}), _TC.format(**{t: _tp95(t) for t in R.LAMBDAS})


def deltas_of(g):
    return R.pair_deltas(R.with_state(support_pairs(g), state_of(g)))


@query(f"{_TD} SELECT i, j, " + rs(*[(t, t) for t in R.LAMBDAS], ("cost", _RAW_TC)) + " FROM td")
def task_first_score(g):
    return r(R.task_cost(deltas_of(g)), *R.LAMBDAS, "cost")


@query(f"{_TD} SELECT i, j, {O.r(_NORM_TC)} AS cost FROM td")
def task_first_score_p95(g):
    return r(R.task_cost(deltas_of(g), normalization="p95").select("i", "j", "cost"), "cost")


@query(f"{_TD}, z AS (SELECT *, {_RAW_TC} AS cost FROM td) " + " UNION ALL ".join(f"SELECT '{t}' AS term, " + rs(("p50", f"quantile_cont({t}, 0.5)"), ("p95", f"quantile_cont({t}, 0.95)"), ("max", f"max({t})")) + " FROM z" for t in (*R.LAMBDAS, "cost")))
def task_delta_distribution(g):
    return r(R.delta_distribution(R.task_cost(deltas_of(g))), "p50", "p95", "max")


@query("SELECT n - t AS support_nodes, ceil((n - t) * 0.6 - 1e-12)::BIGINT AS desired_support_nodes, t + ceil((n - t) * 0.6 - 1e-12)::BIGINT AS desired_total_nodes, (n - t - ceil((n - t) * 0.6 - 1e-12))::BIGINT AS max_merges FROM (SELECT count(*) AS n, count(*) FILTER (type_id = 0) AS t FROM nodes)")
def support_budget(g):
    b = R.support_budget(g.nodes.count(), g.nodes_of_type(0).count(), 0.6)
    return one_row(g, **{k: b[k] for k in ("support_nodes", "desired_support_nodes", "desired_total_nodes", "max_merges")})


@query()
def task_first_assignment(g):
    g = kept(g)
    return R.task_first_level(g, 0, known(g), 5, 0.7, settle=settled)[0]


@query(f"WITH sg AS MATERIALIZED (SELECT node_id, type_id, round(sum(p * (1 + label / 4.0::DOUBLE)), 9) AS k FROM (SELECT n.node_id, n.type_id, l::INTEGER AS label, coalesce(p, 0) AS p FROM nodes n CROSS JOIN range(5) q(l) LEFT JOIN cfoot c ON c.node_id = n.node_id AND c.label = l WHERE n.type_id <> 0) GROUP BY 1, 2) SELECT DISTINCT least(i, j) AS i, greatest(i, j) AS j FROM (SELECT node_id AS i, unnest([lead(node_id, 1) OVER w, lead(node_id, 2) OVER w]) AS j FROM sg WINDOW w AS (PARTITION BY type_id ORDER BY k, node_id)) WHERE j IS NOT NULL")
def cand_footprint_window(g):
    return R.row_window(state_of(g), "cls", 2, "footprint").select("i", "j").distinct()


@query()
def cand_task_hybrid(g):
    s = state_of(g)
    return R.hybrid_candidates(s, T.anchor_topk(g.edges, g.nodes, 0, 3), g.nodes, 2).select("i", "j", rounded(F.col("score")).alias("score"), "source")


# --- selection

_SEL = "an AS MATERIALIZED (SELECT node_id, count(DISTINCT target_id) / (SELECT greatest(count(*), 1) FROM nodes WHERE type_id = 0)::DOUBLE AS a0, sum(w) AS a1, max(w) AS a2 FROM anchors3 GROUP BY 1), sf AS MATERIALIZED (SELECT n.node_id, n.type_id, coalesce(cm, 0) AS cm, coalesce(cn, 0) AS cn, coalesce(top, 0) - coalesce(sec, 0) AS margin, coalesce(cls, -1) AS cls, coalesce(rm, 0) AS rm, coalesce(rn, 0) AS rn, coalesce(rel, -1) AS rel, coalesce((a0 + a1 + a2) / sqrt(a0 * a0 + a1 * a1 + a2 * a2), 0) AS am, (a0 IS NOT NULL)::INTEGER AS an, CASE WHEN a0 IS NULL THEN -1 WHEN round(a0, 9) >= round(a1, 9) THEN 0 WHEN a1 >= a2 THEN 1 ELSE 2 END AS anc FROM nodes n LEFT JOIN (SELECT node_id, sum(p) AS cm, sqrt(sum(p * p)) AS cn, max(p) AS top, arg_max(label, round(p, 9) * 1000 - label) AS cls, (list(p ORDER BY p DESC))[2] AS sec FROM cfoot GROUP BY 1) c ON c.node_id = n.node_id LEFT JOIN (SELECT node_id, sum(p) AS rm, sqrt(sum(p * p)) AS rn, arg_max(dim, round(p, 9) * 1000 - dim) AS rel FROM rfoot GROUP BY 1) q ON q.node_id = n.node_id LEFT JOIN an ON an.node_id = n.node_id WHERE n.type_id <> 0)"


def _sc(c: str) -> str:
    return f"(CASE WHEN max({c}) OVER () - min({c}) OVER () > 1e-12 THEN ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) WHEN max({c}) OVER () > 0 THEN 1.0 ELSE 0.0 END)"


_TEACH = f"(0.35::DOUBLE * {_sc('cm')} + 0.25::DOUBLE * {_sc('am')} + 0.20::DOUBLE * {_sc('rm')})"
_RESP = f"(0.65::DOUBLE * {_sc('cn')} + 0.35::DOUBLE * {_sc('rn')})"
_KINDS = {"teacher": _TEACH, "response": _RESP, "occlusion": f"0.75::DOUBLE * {_TEACH} + 0.25::DOUBLE * {_sc('an')}", "hybrid": f"0.95::DOUBLE * {_TEACH} + 0.05::DOUBLE * {_RESP}", "sensitivity": f"{_TEACH} + 0.2::DOUBLE * {_sc('rm')} + 0.2::DOUBLE * {_sc('margin')} + 0.1::DOUBLE * {_sc('(an + am)')}"}


def features_of(g):
    top = settled(T.anchor_topk(g.edges, g.nodes, 0, 3))
    return settled(N.selection_features(g, state_of(g), top, g.nodes_of_type(0).count()))


for _k, _e in _KINDS.items():

    def _imp(g, k=_k):
        return r(N.importance(features_of(g), k), "importance")

    _imp.__name__ = f"importance_{_k}"
    _sql = f"SELECT node_id, {_e} AS s FROM sf"
    query(f"WITH {_SEL} SELECT node_id, {O.r(_sc('s') if _k == 'sensitivity' else 's')} AS importance FROM ({_sql})")(_imp)

_IMP = f"im AS MATERIALIZED (SELECT node_id, type_id, rel, anc, cls, round({_TEACH}, 9) AS s FROM sf)"


def scored_features(g):
    f = features_of(g)
    return settled(N.block_keys(f).join(N.importance(f).withColumn("importance", F.round("importance", 9)), "node_id"))


@query(f"WITH {_SEL} SELECT node_id, type_id, rel::INTEGER AS rel_block, anc::INTEGER AS anchor_block, cls::INTEGER AS class_block FROM sf")
def support_block_keys(g):
    return N.block_keys(features_of(g))


@query(f"WITH {_SEL}, fs AS MATERIALIZED (SELECT node_id, CASE WHEN cm > 1e-12 THEN 'known' WHEN rm > 1e-12 OR an = 1 THEN 'connected' ELSE 'weak' END AS s, cm, rm FROM sf) SELECT " + rs(("zero", "avg((cm <= 1e-12)::INTEGER)"), ("known", "avg((s = 'known')::INTEGER)"), ("connected", "avg((s = 'connected')::INTEGER)"), ("weak", "avg((s = 'weak')::INTEGER)"), ("with_relations", "avg((rm > 1e-12)::INTEGER)")) + " FROM fs")
def footprint_shares(g):
    out = N.footprint_shares(features_of(g))
    return r(out, *out.columns)


@query(f"WITH {_SEL}, {_IMP}, b AS (SELECT type_id, rel, anc, cls, round(sum(s), 9) AS t FROM im GROUP BY 1, 2, 3, 4) SELECT node_id FROM im JOIN b USING (type_id, rel, anc, cls) ORDER BY t DESC, type_id, rel, anc, cls, s DESC, node_id LIMIT 500")
def block_select(g):
    return N.select_blocks(scored_features(g), N.BLOCK, 500)


@query(f"WITH RECURSIVE {_SEL}, {_IMP}, pk AS (SELECT 0 AS step, []::BIGINT[] AS ids, []::INTEGER[] AS cs, []::INTEGER[] AS ans UNION ALL SELECT step + 1, list_append(any_value(ids), max(k).n), list_append(any_value(cs), max(k).c), list_append(any_value(ans), max(k).a) FROM (SELECT step, ids, cs, ans, struct_pack(v := round(s + (CASE WHEN cls < 0 THEN 0 WHEN list_contains(cs, cls) THEN -0.03 ELSE 0.15 END) + (CASE WHEN anc < 0 THEN 0 WHEN list_contains(ans, anc) THEN -0.02 ELSE 0.10 END), 9), m := -node_id, n := node_id, c := cls::INTEGER, a := anc::INTEGER) AS k FROM pk, hd WHERE step < 25 AND NOT list_contains(ids, node_id)) GROUP BY step) SELECT unnest(ids) AS node_id, unnest(generate_series(1, 25))::INTEGER AS place FROM pk WHERE step = 25".replace("pk AS (SELECT 0", "hd AS MATERIALIZED (SELECT * FROM im QUALIFY row_number() OVER (PARTITION BY cls, anc ORDER BY s DESC, node_id) <= 30), pk AS (SELECT 0"))
def diverse_select(g):
    return N.diverse_select(scored_features(g), 25)


@query("WITH kp AS (SELECT node_id FROM nodes WHERE type_id IN (0, 4)) SELECT rel_id, count(*) AS n FROM edges WHERE src IN (SELECT node_id FROM kp) AND dst IN (SELECT node_id FROM kp) GROUP BY 1")
def selected_graph(g):
    return N.selected_graph(g, 0, g.nodes_of_type(4)).edges.groupBy("rel_id").agg(F.count(F.lit(1)).alias("n"))


_UN = f"{_FOUR}, un AS MATERIALIZED (SELECT 'h6:' || super_id AS unit, 'h6' AS source, f.node_id FROM four f JOIN nodes n USING (node_id) WHERE type_id <> 0)"


def units_of(g):
    return N.extract_units(four_of(g), g.nodes, 0, "h6")


@query(f"WITH {_UN} SELECT unit, source, node_id FROM un")
def unit_extraction(g):
    return units_of(g)


def _ent(col: str, by: str, of: str) -> str:
    return f"(SELECT {by}, CASE WHEN count(*) <= 1 THEN 0 ELSE -sum({col} / t * log2({col} / t)) / greatest(log2(count(*)), 1) END AS e FROM (SELECT *, sum({col}) OVER (PARTITION BY {by}) AS t FROM ({of})) GROUP BY 1)"


_UP = f"ue AS MATERIALIZED (SELECT DISTINCT unit, rel_id, src, dst, w FROM (SELECT unit, e.* FROM edges e JOIN un ON un.node_id = src UNION ALL SELECT unit, e.* FROM edges e JOIN un ON un.node_id = dst)), ur AS MATERIALIZED (SELECT unit, rel_id, sum(w) AS m FROM ue GROUP BY 1, 2), ua AS MATERIALIZED (SELECT DISTINCT unit, t AS node_id FROM un JOIN links USING (node_id)), ul AS MATERIALIZED (SELECT unit, label, count(*)::DOUBLE AS c FROM (SELECT unit, node_id FROM ua UNION ALL SELECT unit, node_id FROM un) JOIN nodes USING (node_id) WHERE label >= 0 GROUP BY 1, 2), up AS MATERIALIZED (SELECT u.unit, u.source, members, coalesce(em, 0) AS edge_mass, coalesce(ch, 0) AS channels, coalesce(x.e, 0) AS relation_entropy, coalesce(an, 0) AS anchors, coalesce(an, 0) / (SELECT count(*) FROM nodes WHERE type_id = 0)::DOUBLE AS coverage, coalesce(y.e, 0) AS class_balance FROM (SELECT unit, source, count(*) AS members FROM un GROUP BY 1, 2) u LEFT JOIN (SELECT unit, sum(m) AS em, count(*) AS ch FROM ur GROUP BY 1) r ON r.unit = u.unit LEFT JOIN {_ent('m', 'unit', 'SELECT * FROM ur')} x ON x.unit = u.unit LEFT JOIN (SELECT unit, count(*) AS an FROM ua GROUP BY 1) a ON a.unit = u.unit LEFT JOIN {_ent('c', 'unit', 'SELECT * FROM ul')} y ON y.unit = u.unit)"
_PROF = ("edge_mass", "relation_entropy", "coverage", "class_balance")


def profiles_of(g):
    return N.unit_profiles(units_of(g), g.edges, g.relations, g.nodes, 0)


@query(f"WITH {_UN}, {_UP} SELECT unit, source, members, channels, anchors, " + rs(*[(c, c) for c in _PROF]) + " FROM up")
def unit_profiles(g):
    return r(profiles_of(g), *_PROF)


_US = "us AS MATERIALIZED (SELECT *, round(0.1::DOUBLE * edge_mass / (SELECT greatest(max(edge_mass), 1) FROM up) + 0.1::DOUBLE * coverage + 0.1::DOUBLE * relation_entropy + 0.1::DOUBLE * class_balance, 9) AS score FROM up)"


@query(f"WITH {_UN}, {_UP}, {_US} SELECT unit, {O.r('score')} AS score FROM us")
def unit_scores(g):
    return r(N.unit_scores(profiles_of(g)).select("unit", F.round("score", 9).alias("score")), "score")


@query(f"WITH {_UN}, {_UP}, {_US}, o AS (SELECT *, coalesce(sum(members) OVER (ORDER BY score DESC, members DESC, unit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT unit, members, score - 0.05::DOUBLE AS score FROM us) WHERE score >= -0.0005) SELECT unit, members, CASE WHEN score >= 0.0001 THEN 'positive' WHEN score >= -0.0001 THEN 'neutral' ELSE 'negative' END AS pass FROM o WHERE before < (SELECT ceil(count(*) * 0.1 - 1e-12) FROM nodes WHERE type_id <> 0)")
def cluster_selection(g):
    u = settled(N.unit_scores(profiles_of(g)).select("unit", "members", (F.round("score", 9) - 0.05).alias("gain")))
    return N.select_clusters(u, g.nodes.where("type_id != 0").count(), 0.1)


@query()
def units_under_budget(g):
    u = settled(N.unit_scores(profiles_of(g)))
    return N.under_budget(u, g.nodes.where("type_id != 0").count(), 0.1, settled).select("unit", "members")


@query("WITH m AS (SELECT rel_id AS k, rel_id::DOUBLE / 10 AS ratio, rel_id::DOUBLE AS v FROM rels), b AS (SELECT DISTINCT rel_id % 4 AS k, (rel_id % 4)::DOUBLE / 3 + 0.01 AS ratio, (rel_id % 4)::DOUBLE AS v FROM rels) SELECT 'd' AS dataset, 1::BIGINT AS seed, 'm' || m.k AS method, 'base' AS baseline, m.ratio, b.ratio AS b_ratio, " + O.r("abs(m.ratio - b.ratio)", 9) + " AS gap, CASE WHEN round(abs(m.ratio - b.ratio), 12) <= 0.035 THEN 'matched' ELSE 'nearest_flagged' END AS status, m.v - b.v AS delta_macro, m.v - b.v AS delta_acc FROM m, b QUALIFY row_number() OVER (PARTITION BY m.k ORDER BY round(abs(m.ratio - b.ratio), 12), b.ratio) = 1")
def ratio_matched_gaps(g):
    n = F.col("rel_id")
    rows = g.relations.select(F.lit("d").alias("dataset"), F.lit(1).cast("long").alias("seed"), F.concat(F.lit("m"), n).alias("method"), (n.cast("double") / 10).alias("ratio"), n.cast("double").alias("macro"), n.cast("double").alias("acc"))
    base = g.relations.select(F.lit("d").alias("dataset"), F.lit(1).cast("long").alias("seed"), F.lit("base").alias("baseline"), ((n % 4).cast("double") / 3 + 0.01).alias("ratio"), (n % 4).cast("double").alias("macro"), (n % 4).cast("double").alias("acc")).distinct()
    return r(N.ratio_gaps(rows, base), "gap", digits=9)


def tree_of(g):
    paths = N.target_paths(g.relations.where("rel_id in (0, 1, 9)").collect(), 0, 2)
    small = HeteroGraph(g.nodes, g.edges, g.relations, g.features.where("type_id in (0, 1)"))
    return settled(N.semantic_tree(small, 0, paths, list(range(10)), settled))


_RAWB = "rb AS MATERIALIZED (SELECT n.node_id, d::INTEGER AS j, CASE WHEN d < 2 THEN coalesce(f.x[d + 1], 0) ELSE (n.type_id = d - 2)::INTEGER END::DOUBLE AS v FROM nodes n CROSS JOIN range(12) q(d) LEFT JOIN (SELECT * FROM feats WHERE type_id IN (0, 1)) f ON f.node_id = n.node_id)"


def _dn(x: str, rel: int) -> str:
    return f"SELECT dst AS node_id, j, sum(w * v) AS v FROM (SELECT rel_id, src, dst, w / greatest(sum(w) OVER (PARTITION BY rel_id, dst), 1e-12) AS w FROM edges) JOIN {x} ON node_id = src WHERE rel_id = {rel} GROUP BY 1, 2"


_TREE = f"{_RAWB}, t1 AS MATERIALIZED ({_dn('rb', 1)}), t9 AS MATERIALIZED ({_dn('rb', 9)}), t0 AS MATERIALIZED ({_dn('rb', 0)}), t91 AS MATERIALIZED ({_dn('t9', 1)}), t01 AS MATERIALIZED ({_dn('t0', 1)}), tr AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT n.node_id, '{p}' AS path, q.j::INTEGER AS j, coalesce(t.v, 0) AS v FROM (SELECT node_id FROM nodes WHERE type_id = 0) n CROSS JOIN range(12) q(j) LEFT JOIN {t} t ON t.node_id = n.node_id AND t.j = q.j" for p, t in (("", "rb"), ("1", "t1"), ("0>1", "t01"), ("9>1", "t91"))) + ")"


@query(f"WITH {_TREE} SELECT node_id, path, j, {O.r('v')} AS v FROM tr")
def semantic_tree(g):
    return r(tree_of(g).select("node_id", "path", F.posexplode("a").alias("j", "v")), "v")


@query(f"WITH {_TREE} SELECT path, {O.r('avg(v * v)')} AS energy FROM tr GROUP BY 1")
def semantic_path_energy(g):
    return r(N.path_energy(tree_of(g)), "energy")


@query(f"WITH {_TREE}, e AS (SELECT path, round(avg(v * v), 9) AS e FROM tr GROUP BY 1 ORDER BY e DESC, path LIMIT 2) SELECT path, count(DISTINCT node_id) AS n FROM tr JOIN e USING (path) GROUP BY 1")
def semantic_path_prune(g):
    return N.prune_paths(tree_of(g), 0.5).groupBy("path").agg(F.countDistinct("node_id").alias("n"))


_PROTO = f"{_TREE}, pm AS MATERIALIZED (SELECT path, j, label, avg(v) AS m FROM tr JOIN known USING (node_id) GROUP BY 1, 2, 3), dd AS (SELECT node_id, label, round(sum((v - m) ** 2), 9) AS d FROM tr JOIN pm USING (path, j) GROUP BY 1, 2), nn AS MATERIALIZED (SELECT node_id, label FROM dd QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY d, label) = 1)"


@query(f"WITH {_PROTO} SELECT node_id, label AS cls FROM nn")
def class_path_prototypes(g):
    return N.class_prototypes(tree_of(g), known(g)).select("node_id", "cls").distinct()


@query(f"WITH {_PROTO} SELECT {O.r('sqrt(avg((v - m) ** 2))')} AS rmse FROM tr JOIN nn USING (node_id) JOIN pm ON pm.path = tr.path AND pm.j = tr.j AND pm.label = nn.label")
def target_tree_error(g):
    t = tree_of(g)
    return r(N.tree_error(t, N.class_prototypes(t, known(g))), "rmse")


@query(f"WITH {_TREE} SELECT node_id, path, j, floor(round((v - lo) / (greatest(hi - lo, 1e-6) / 255), 6) + 0.5)::INTEGER AS q FROM tr JOIN (SELECT path, min(v) AS lo, max(v) AS hi FROM tr GROUP BY 1) USING (path)")
def cache_quantised(g):
    return N.quantised(tree_of(g)).select("node_id", "path", F.posexplode("q").alias("j", "q"))


# --- pruning and planning


def spaced_scores(g) -> DataFrame:
    """Edges with a score that a hash gives."""
    return g.edges.select("rel_id", "src", "dst", "w", ((mixed(F.col("src") * 31 + F.col("dst"), F.col("rel_id"), 4) % 100000) / 100000.0).alias("score"))


@query()
def coverage_sample(g):
    return P.coverage_sample(spaced_scores(g).where("rel_id < 6"), P.budgets(g.edges.where("rel_id < 6"), 2000, 10), 3, settled).select("rel_id", "src", "dst", "rescued")


@query("WITH d AS (SELECT rel_id, count(*) AS d FROM edges GROUP BY rel_id, src UNION ALL SELECT rel_id, count(*) FROM edges GROUP BY rel_id, dst) SELECT rel_id, " + O.r("2 * sum(r * d) / (count(*) * sum(d)) - (count(*) + 1) / count(*)") + " AS gini FROM (SELECT *, row_number() OVER (PARTITION BY rel_id ORDER BY d) AS r FROM d) GROUP BY 1")
def degree_gini(g):
    d = g.edges.groupBy("rel_id", "src").agg(F.count(F.lit(1)).alias("d")).select("rel_id", "d").unionByName(g.edges.groupBy("rel_id", "dst").agg(F.count(F.lit(1)).alias("d")).select("rel_id", "d"))
    return r(P.gini(d, ["rel_id"], "d"), "gini")


@query("SELECT rel_id, count(DISTINCT src) AS sources, count(DISTINCT dst) AS destinations, count(DISTINCT src) FILTER (k) AS kept_sources, count(DISTINCT dst) FILTER (k) AS kept_destinations FROM (SELECT *, " + f"{O.mixed('src * 31 + dst', 'rel_id')} % 100 < 20 AS k FROM edges) GROUP BY 1")
def sample_coverage(g):
    out = P.sample_report(g.edges, P.random_sample(g.edges, 20))
    return out.select("rel_id", "sources", "destinations", "kept_sources", "kept_destinations")


_SHARES = {0: 0.3, 1: 0.3, 2: 0.05, 9: 0.5}


@query("WITH p AS (SELECT rel_id, m, least(m, greatest(round_even(m * (CASE rel_id WHEN 0 THEN 0.3::DOUBLE WHEN 1 THEN 0.3::DOUBLE WHEN 2 THEN 0.05::DOUBLE WHEN 9 THEN 0.5::DOUBLE ELSE 1 END), 0), least(m, 1))) AS b FROM ecount) SELECT rel_id, src, dst FROM (SELECT *, row_number() OVER (PARTITION BY rel_id ORDER BY " + f"round({O.mixed('src * 31 + dst', 'rel_id')} / 2147483647.0::DOUBLE, 9) DESC, src, dst) AS q FROM edges) JOIN p USING (rel_id) WHERE q <= b")
def relation_skeleton(g):
    return P.skeleton(g.edges, P.parse_spec("places30-placed30-contains05-next50", {"places": 0, "placed": 1, "contains": 2, "next": 9}) | {k: 1.0 for k in RELS if k not in _SHARES}).select("rel_id", "src", "dst")


@query()
def schema_stable_graph(g):
    return P.schema_stable(g, 0, g.nodes.where("type_id in (1, 4, 5) AND part_id < 2"), storage=0.6).edges.select("rel_id", "src", "dst")


@query("WITH t AS (SELECT type_id, min(node_id) AS lo, CASE WHEN type_id = 0 THEN max(node_id) ELSE min(node_id) END AS hi FROM nodes GROUP BY 1) SELECT DISTINCT rel_id, src, dst FROM (SELECT rel_id, s.lo AS src, d.lo AS dst FROM rels JOIN t s ON s.type_id = src_type JOIN t d ON d.type_id = dst_type UNION ALL SELECT rel_id, s.hi, d.lo FROM rels JOIN t s ON s.type_id = src_type JOIN t d ON d.type_id = dst_type UNION ALL SELECT rel_id, s.lo, d.hi FROM rels JOIN t s ON s.type_id = src_type JOIN t d ON d.type_id = dst_type)")
def schema_stub(g):
    return P.schema_stub(g, 0).edges.select("rel_id", "src", "dst")


@query("WITH c AS (SELECT rel_id AS channel, m::DOUBLE / sum(m) OVER () AS cost, vol / sum(vol) OVER () AS reach, (rel_id % 3) / 3.0::DOUBLE AS purity FROM ecount) SELECT channel, " + rs(("utility", "2 * cost + reach + 0.7::DOUBLE * purity - 0.25::DOUBLE"), ("density", "(2 * cost + reach + 0.7::DOUBLE * purity - 0.25::DOUBLE) / greatest(cost, 1e-12)")) + " FROM c")
def channel_utility(g):
    from pyspark.sql import Window as W

    one = W.partitionBy(F.lit(0))
    c = g.edges.groupBy(F.col("rel_id").alias("channel")).agg(F.count(F.lit(1)).alias("m"), F.sum("w").alias("vol"))
    c = c.select("channel", (F.col("m") / F.sum("m").over(one)).alias("cost"), (F.col("vol") / F.sum("vol").over(one)).alias("reach"), ((F.col("channel") % 3) / 3.0).alias("purity")).withColumn("removal", F.col("cost")).withColumn("saturation", F.lit(0.0)).withColumn("redundancy", F.lit(0.0)).withColumn("hub", F.lit(0.5))
    return r(P.channel_utilities(c).select("channel", "utility", "density"), "utility", "density")


@query("WITH k AS (SELECT dst AS key, count(*) AS n FROM edges WHERE rel_id = 2 GROUP BY 1), s AS MATERIALIZED (SELECT key FROM k ORDER BY n DESC, key LIMIT (SELECT greatest(1, round_even(count(*) * 0.1, 0))::BIGINT FROM k)), o AS MATERIALIZED (SELECT DISTINCT src AS node_id, dst AS key FROM edges JOIN s ON key = dst WHERE rel_id = 2) SELECT node_id, key, 1.0::DOUBLE AS v FROM (SELECT node_id, key FROM o UNION SELECT e.src, key FROM edges e JOIN o ON o.node_id = e.dst WHERE rel_id = 0)")
def closure_features(g):
    return P.closure_compress(g.edges, 2, 3, 0.1, [0])[1]


@query("WITH p AS (SELECT rel_id, m, least(m, greatest(round_even(m * (CASE rel_id WHEN 2 THEN 0.2::DOUBLE ELSE 1 END), 0), 1)) AS b FROM ecount WHERE rel_id IN (0, 2)), c AS MATERIALIZED (SELECT rel_id, src, dst, w FROM (SELECT *, row_number() OVER (PARTITION BY rel_id ORDER BY " + f"round({O.mixed('src * 31 + dst', 'rel_id')} / 2147483647.0::DOUBLE, 9) DESC, src, dst) AS q FROM edges WHERE rel_id IN (0, 2)) JOIN p USING (rel_id) WHERE q <= b), x AS (SELECT e.rel_id, min(e.src) AS src, e.dst, NULL AS w FROM edges e JOIN (SELECT rel_id, max(dst) AS dst FROM edges WHERE rel_id IN (0, 2) GROUP BY 1) l ON l.rel_id = e.rel_id AND l.dst = e.dst GROUP BY 1, 3), a AS MATERIALIZED (SELECT rel_id, src, dst FROM c UNION ALL SELECT x.rel_id, x.src, x.dst FROM x WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.rel_id = x.rel_id AND c.dst = x.dst)) SELECT rel_id, src, dst FROM a UNION ALL SELECT CASE rel_id WHEN 0 THEN 1 ELSE 3 END, dst, src FROM a UNION ALL SELECT rel_id, src, dst FROM edges WHERE rel_id NOT IN (0, 1, 2, 3)")
def channel_compressed(g):
    return P.channel_compress(g.edges, {2: 0.2}, {0: 1, 2: 3}).select("rel_id", "src", "dst")


@query()
def score_selector(g):
    return P.score_selector(g, 0.16, {0: 0.34, 1: 0.16, 2: 0.02, 3: 0.02}, 0, (0, 4), (1, 5)).select("rel_id", "src", "dst")


@query("WITH b AS MATERIALIZED (SELECT DISTINCT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges), s AS MATERIALIZED (SELECT b.* FROM b JOIN nodes n ON n.node_id = a WHERE type_id <> 0), t AS MATERIALIZED (SELECT s.* FROM s JOIN nodes n ON n.node_id = s.b WHERE type_id = 0) SELECT n.node_id, coalesce(c, 0) AS targets, coalesce(d, 0) AS two_steps FROM nodes n LEFT JOIN (SELECT a, count(*) AS c FROM t GROUP BY 1) u ON u.a = n.node_id LEFT JOIN (SELECT s.a, count(DISTINCT t.b) AS d FROM s JOIN t ON t.a = s.b GROUP BY 1) v ON v.a = n.node_id WHERE n.type_id <> 0")
def support_proxies(g):
    return P.support_proxies(g, 0, known(g)).select("node_id", "targets", "two_steps")


@query(f"SELECT node_id FROM nodes WHERE type_id <> 0 ORDER BY {O.mixed('node_id', '1')}, node_id LIMIT (SELECT round_even(count(*) * 0.1, 0)::BIGINT FROM nodes WHERE type_id <> 0)")
def random_support(g):
    return P.random_support(g.nodes, 0, 0.1)


@query("WITH o1 AS MATERIALIZED (SELECT DISTINCT src AS a, dst AS b FROM edges WHERE rel_id = 0), n1 AS MATERIALIZED (SELECT a, b FROM o1 UNION SELECT dst, src FROM edges WHERE rel_id = 1), o2 AS MATERIALIZED (SELECT DISTINCT src AS a, dst AS b FROM edges WHERE rel_id = 2), n2 AS MATERIALIZED (SELECT a, b FROM o2 UNION SELECT dst, src FROM edges WHERE rel_id = 3), dg AS (SELECT node_id, count(o1.b) AS d FROM nodes LEFT JOIN o1 ON a = node_id WHERE type_id = 0 GROUP BY 1) SELECT count(*) AS targets, count(*) FILTER (d > 0) AS with_edge, " + rs(("degree_mean", "avg(d)"), ("degree_p50", "quantile_cont(d, 0.5)"), ("degree_p10", "quantile_cont(d, 0.1)"), ("degree_p90", "quantile_cont(d, 0.9)")) + ", (SELECT count(DISTINCT a) FROM n1) AS reaching, (SELECT count(DISTINCT b) FROM n1) AS reached, (SELECT count(DISTINCT o1.a) FROM o1 JOIN o2 ON o2.a = o1.b) AS reaching_far_forward, (SELECT count(DISTINCT n1.a) FROM n1 JOIN n2 ON n2.a = n1.b) AS reaching_far, (SELECT count(DISTINCT n2.b) FROM n1 JOIN n2 ON n2.a = n1.b) AS reached_far, count(*) - (SELECT count(DISTINCT a) FROM n1) AS isolated FROM dg")
def coverage_report(g):
    return r(P.reach_report(g, 0, (0, 1), (2, 3)), "degree_mean", "degree_p50", "degree_p10", "degree_p90")


@query("SELECT node_id, j, " + O.r("CASE WHEN v = 0 THEN 0 ELSE greatest(least(round_even(v / pow(2.0::DOUBLE, e - 10), 0) * pow(2.0::DOUBLE, e - 10), 65504), -65504) END", 9) + " AS v FROM (SELECT *, CASE WHEN v = 0 THEN 0 ELSE greatest(floor(log2(abs(v))), -14) END AS e FROM flat)")
def feature_half(g):
    h = P.half_precision(g.features).select("node_id", F.posexplode("x").alias("j", "v"))
    return r(h, "v", digits=9)


@query("SELECT node_id, j, CASE WHEN type_id = 1 THEN 0.0 ELSE " + O.r("v", 9) + " END::DOUBLE AS v FROM flat")
def feature_zero(g):
    return r(P.transform_features(g.features, "zero", (1,)).select("node_id", F.posexplode("x").alias("j", "v")), "v", digits=9)


@query("SELECT node_id, j, CASE WHEN type_id IN (1, 2) THEN type_id + 1.0 ELSE " + O.r("v", 9) + " END::DOUBLE AS v FROM flat")
def feature_type_constant(g):
    return r(P.transform_features(g.features, "constant", (1, 2)).select("node_id", F.posexplode("x").alias("j", "v")), "v", digits=9)


@query("SELECT node_id, j, CASE WHEN type_id <> 0 THEN 0.0 ELSE " + O.r("v", 9) + " END::DOUBLE AS v FROM flat")
def feature_only_type(g):
    return r(P.transform_features(g.features, "only", (0,)).select("node_id", F.posexplode("x").alias("j", "v")), "v", digits=9)


@query("WITH z AS (SELECT rel_id, CASE rel_id % 4 WHEN 0 THEN 'edge' WHEN 1 THEN 'node' WHEN 2 THEN 'bytes' ELSE NULL END AS k, CASE WHEN rel_id = 5 THEN NULL ELSE 0.5 END AS req, rel_id / 20.0::DOUBLE AS e, CASE WHEN rel_id = 9 THEN NULL ELSE 0.52 END AS n FROM rels) SELECT rel_id, CASE WHEN k IS NULL THEN 'missing_requested_budget_type' WHEN req IS NULL THEN 'missing_requested_budget' WHEN k = 'bytes' THEN 'unsupported_budget_type' WHEN (CASE k WHEN 'edge' THEN e ELSE n END) IS NULL THEN 'metric_missing' WHEN (CASE k WHEN 'edge' THEN e ELSE n END) > req + 0.03 THEN 'budget_mismatch' ELSE '' END AS fault FROM z")
def budget_truth(g):
    n = F.col("rel_id")
    rows = g.relations.select("rel_id", F.when(n % 4 == 0, "edge").when(n % 4 == 1, "node").when(n % 4 == 2, "bytes").alias("budget_type"), F.when(n != 5, 0.5).alias("requested"), (n / 20.0).alias("edge_ratio"), F.when(n != 9, 0.52).alias("node_ratio"))
    return P.budget_truth(rows, {"edge": "edge_ratio", "node": "node_ratio"}).select("rel_id", "fault")


@query("SELECT rel_id, " + O.r("(10 + m) / (20 + 2 * m)") + " AS ratio, rel_id % 2 = 0 AS consistent FROM ecount")
def storage_audit(g):
    rows = report_rows(g).select("rel_id", F.lit(10).alias("nodes"), F.col("cost").alias("edges"), F.lit(20).alias("nodes0"), (2 * F.col("cost")).alias("edges0"), ((10 + F.col("cost")) / (20 + 2 * F.col("cost")) + (F.col("rel_id") % 2)).alias("reported"))
    return r(P.ratio_audit(rows).select("rel_id", "ratio", "consistent"), "ratio")


@query("WITH z AS (SELECT src_type, 'r' || rel_id AS method, m AS cost, vol / m AS vm, 1.0 / m AS vx FROM ecount JOIN rels USING (rel_id)) SELECT src_type, method, 'validated' AS kind FROM z QUALIFY row_number() OVER (PARTITION BY src_type ORDER BY vm DESC, vx DESC, cost, method) = 1 UNION ALL SELECT src_type, method, 'test_oracle' FROM z QUALIFY row_number() OVER (PARTITION BY src_type ORDER BY vx DESC, vm DESC, cost, method) = 1")
def representatives(g):
    rows = report_rows(g).join(F.broadcast(g.relations), "rel_id").select("src_type", F.concat(F.lit("r"), "rel_id").alias("method"), "cost", F.col("density").alias("val_micro"), (1.0 / F.col("cost")).alias("val_macro"), (1.0 / F.col("cost")).alias("test_micro"), F.col("density").alias("test_macro"))
    return P.representative_rows(rows, ["src_type"]).select("src_type", "method", "kind")


# --- classification


@query("SELECT " + rs(("micro", "avg((label = pred)::INTEGER)"), ("macro", "(SELECT avg(CASE WHEN p + t > 0 THEN 2 * h / (p + t) ELSE 0 END) FROM (SELECT c, sum(t) AS t, sum(p) AS p, sum(h) AS h FROM (SELECT label AS c, 1 AS t, 0 AS p, (label = pred)::INTEGER AS h FROM pred UNION ALL SELECT pred, 0, 1, 0 FROM pred) GROUP BY 1) WHERE t > 0)")) + " FROM pred")
def f1_present_classes(g):
    return r(K.f1_scores(K.predicted(logits_of(g)), True), "micro", "macro")


@query(f"WITH l AS (SELECT node_id, row_number() OVER (ORDER BY {O.mixed('node_id', '2')}, node_id) AS q, count(*) OVER () AS n FROM nodes WHERE label >= 0) SELECT node_id, CASE WHEN q <= (CASE WHEN greatest(1, round_even(n * 0.6, 0)) >= n AND n > 1 THEN n - 1 ELSE greatest(1, round_even(n * 0.6, 0)) END) THEN 'train' ELSE 'test' END AS split FROM l")
def random_split(g):
    return K.random_split(g.nodes)


@query(f"WITH l AS (SELECT node_id, label, row_number() OVER (PARTITION BY label ORDER BY {O.mixed('node_id')}, node_id) AS q, count(*) OVER (PARTITION BY label) AS n FROM nodes WHERE label >= 0), a AS (SELECT *, CASE WHEN n = 1 THEN 1 ELSE least(greatest(1, floor(n * 0.6)), n - 1) END AS t FROM l), b AS (SELECT *, CASE WHEN n > 1 AND n - t >= 2 THEN least(greatest(1, floor(n * 0.2)), n - t - 1) ELSE 0 END AS v FROM a) SELECT node_id, label, CASE WHEN q <= t THEN 'train' WHEN q <= t + v THEN 'valid' ELSE 'test' END AS split FROM b")
def three_way_split(g):
    return K.three_way_split(g.nodes)


@query(f"WITH l AS (SELECT node_id, label, row_number() OVER (PARTITION BY label ORDER BY {O.mixed('node_id', '3')}, node_id) AS q, count(*) OVER (PARTITION BY label) AS n FROM nodes WHERE label >= 0) SELECT node_id, CASE WHEN n > 1 AND q <= greatest(1, n // 2) THEN 'calibrate' ELSE 'select' END AS part FROM l")
def calibration_split(g):
    return K.calibration_split(g.nodes.where("label >= 0"))


def second_logits(g):
    """Other scores for the same nodes: the first ones turned by one class."""
    a = logits_of(g)
    return a.withColumn("scores", F.concat(F.slice("scores", 2, 9), F.slice("scores", 1, 1)))


_L2 = "l2 AS MATERIALIZED (SELECT node_id, label, (k + 9) % 10 AS k, s FROM logits)"


def _gridq(z: str, params: str) -> str:
    """Accuracy and macro F1 for each setting in z(params, node_id, label, k, s)."""
    return f"pz AS MATERIALIZED (SELECT {params}, node_id, label, k AS pred FROM ({z}) QUALIFY row_number() OVER (PARTITION BY {params}, node_id ORDER BY round(s, 9) DESC, k) = 1), cz AS (SELECT {params}, c, sum(nt) AS nt, sum(np) AS np, sum(nh) AS nh FROM (SELECT {params}, label AS c, 1 AS nt, 0 AS np, (label = pred)::INTEGER AS nh FROM pz UNION ALL SELECT {params}, pred, 0, 1, 0 FROM pz) GROUP BY ALL), sz AS MATERIALIZED (SELECT {params}, sum(nh) / sum(nt) AS accuracy, avg(2 * nh / (np + nt)) AS macro FROM cz GROUP BY ALL)"


@query("WITH " + _gridq("SELECT t, node_id, label, k, s / t::DOUBLE AS s FROM logits, (VALUES (0.5), (0.75), (1.0), (2.0)) q(t)", "t") + " SELECT t::DOUBLE AS temperature, " + rs(("accuracy", "accuracy"), ("macro", "macro")) + " FROM sz ORDER BY round(accuracy, 12) DESC, round(macro, 12) DESC, abs(t - 1.0) LIMIT 1")
def temperature_choice(g):
    return r(K.choose_calibration(logits_of(g), [0.5, 0.75, 1.0, 2.0], [[0.0] * 10]).select("temperature", "accuracy", "macro"), "accuracy", "macro")


@query("WITH g AS (SELECT -1 AS c, 0.0 AS v UNION ALL SELECT c, v FROM range(10) a(c), (VALUES (-0.25), (0.25)) b(v)), " + _gridq("SELECT g.c AS bc, g.v AS bv, node_id, label, k, s + CASE WHEN k = g.c THEN g.v ELSE 0 END::DOUBLE AS s FROM logits, g", "bc, bv") + " SELECT " + rs(("accuracy", "accuracy"), ("macro", "macro")) + " FROM sz ORDER BY round(accuracy, 12) DESC, round(macro, 12) DESC, abs(bv) LIMIT 1")
def class_bias_choice(g):
    return r(K.choose_calibration(logits_of(g), [1.0], K.biases(10, [-0.25, 0.0, 0.25])).select("accuracy", "macro"), "accuracy", "macro")


@query("WITH g AS (SELECT -1 AS c, 0.0 AS v UNION ALL SELECT c, v FROM range(10) a(c), (VALUES (-0.25), (0.25)) b(v)), " + _gridq("SELECT t, g.c AS bc, g.v AS bv, node_id, label, k, s / t::DOUBLE + CASE WHEN k = g.c THEN g.v ELSE 0 END::DOUBLE AS s FROM logits, g, (VALUES (0.5), (1.0)) q(t)", "t, bc, bv") + ", fl AS (SELECT round(macro - 0.005, 12) AS f FROM sz WHERE t = 1.0 AND bc = -1) SELECT " + rs(("accuracy", "accuracy"), ("macro", "macro")) + ", round(macro, 12) >= f AS ok FROM sz, fl ORDER BY ok DESC, round(accuracy, 12) DESC, round(macro, 12) DESC, abs(t - 1.0), abs(bv) LIMIT 1")
def macro_constrained_choice(g):
    return r(K.macro_constrained(logits_of(g), [0.5, 1.0], K.biases(10, [-0.25, 0.0, 0.25])).select("accuracy", "macro", "ok"), "accuracy", "macro")


@query(f"WITH {_L2}, " + _gridq("SELECT a, l.node_id, l.label, l.k, l.s * a / 10 + m.s * (10 - a) / 10 AS s FROM logits l JOIN l2 m ON m.node_id = l.node_id AND m.k = l.k, range(11) q(a)", "a") + " SELECT " + rs(("w0", "a / 10"), ("accuracy", "accuracy"), ("macro", "macro")) + " FROM sz ORDER BY round(accuracy, 12) DESC, round(macro, 12) DESC, round((a / 10) ** 2 + (1 - a / 10) ** 2, 12), a LIMIT 1")
def convex_ensemble_choice(g):
    c = K.choose_convex([logits_of(g), second_logits(g)])
    return r(c.select(F.col("weights")[0].alias("w0"), "accuracy", "macro"), "w0", "accuracy", "macro")


@query(f"WITH {_L2}, sm AS (SELECT node_id, round(max(p), 9) AS top FROM probs GROUP BY 1), " + _gridq("SELECT a, l.node_id, l.label, l.k, CASE WHEN top >= a THEN l.s ELSE l.s * 0.5 + m.s * 0.5 END AS s FROM logits l JOIN l2 m ON m.node_id = l.node_id AND m.k = l.k JOIN sm ON sm.node_id = l.node_id, (VALUES (0.5), (0.6), (0.7), (0.8), (0.9)) q(a)", "a") + " SELECT a::DOUBLE AS threshold, " + rs(("accuracy", "accuracy"), ("macro", "macro")) + " FROM sz ORDER BY round(accuracy, 12) DESC, round(macro, 12) DESC, round(abs(a - 0.7), 9), a LIMIT 1")
def gated_ensemble_choice(g):
    return r(K.choose_gate([logits_of(g), second_logits(g)]).select("threshold", "accuracy", "macro"), "accuracy", "macro")


def three_classes(df):
    return df.where("label < 3").withColumn("scores", F.slice("scores", 1, 3))


@query("WITH l1 AS MATERIALIZED (SELECT node_id, label, k, s FROM logits WHERE label < 3 AND k < 3), lx AS MATERIALIZED (SELECT node_id, label, k2 AS k, s FROM (SELECT node_id, label, (k + 9) % 10 AS k2, s FROM logits) WHERE label < 3 AND k2 < 3), " + _gridq("SELECT a, l.node_id, l.label, l.k, CASE WHEN (a >> l.k) & 1 = 1 THEN m.s ELSE l.s END AS s FROM l1 l JOIN lx m ON m.node_id = l.node_id AND m.k = l.k, range(8) q(a)", "a") + " SELECT " + rs(("accuracy", "accuracy"), ("macro", "macro")) + " FROM sz ORDER BY round(accuracy, 12) DESC, round(macro, 12) DESC LIMIT 1")
def per_class_ensemble_choice(g):
    c = K.choose_per_class([three_classes(logits_of(g)), three_classes(second_logits(g))], 3)
    return r(c.select("accuracy", "macro"), "accuracy", "macro")


@query(f"WITH {_L2}, q AS (SELECT *, exp(s / 2 - max(s / 2) OVER w) AS e FROM l2 WINDOW w AS (PARTITION BY node_id)), p AS (SELECT *, exp(s / 2 - max(s / 2) OVER w) AS e FROM logits WINDOW w AS (PARTITION BY node_id)) SELECT {O.r('avg(d)')} AS kl FROM (SELECT node_id, sum(pt * (ln(pt) - ln(ps))) AS d FROM (SELECT p.node_id, p.k, p.e / sum(p.e) OVER (PARTITION BY p.node_id) AS pt FROM p) JOIN (SELECT node_id, k, e / sum(e) OVER (PARTITION BY node_id) AS ps FROM q) USING (node_id, k) GROUP BY 1)")
def distillation_divergence(g):
    return r(K.distillation_loss(second_logits(g), logits_of(g), 2.0), "kl")


@query(f"SELECT node_id, k::INTEGER AS k, {O.r('sum(v * sqrt(-2.0::DOUBLE * ln(u)) * cos(2.0::DOUBLE * pi() * t))')} AS s FROM (SELECT node_id, k, v, ({O.mixed('j', 'k', 0)} + 0.5::DOUBLE) / 2147483647.0::DOUBLE AS u, ({O.mixed('j', 'k', 1)} + 0.5::DOUBLE) / 2147483647.0::DOUBLE AS t FROM flat, range(3) q(k) WHERE type_id = 8) GROUP BY 1, 2")
def deterministic_teacher(g):
    t = K.fixed_teacher(g.features.where("type_id = 8"), 3)
    return r(t.select("node_id", F.posexplode("scores").alias("k", "s")), "s")


@query("SELECT target_id, count(*) AS covered FROM (SELECT DISTINCT t AS target_id, node_id FROM links) GROUP BY 1")
def anchor_coverage(g):
    return K.anchor_coverage(g.edges, g.relations, 0).groupBy("target_id").agg(F.count(F.lit(1)).alias("covered"))


@query()
def target_anchors(g):
    train = g.nodes_of_type(0).where("node_id % 50 = 0")
    return K.select_anchors(g.nodes, g.edges, g.relations, 0, train, train.count() + 10, 5, settle=settled)


@query("SELECT type_id, count(*) AS before, count(DISTINCT super_id) AS after, " + O.r("count(DISTINCT super_id) / count(*)") + " AS ratio, type_id = 0 AS is_target FROM nodes JOIN asg USING (node_id) GROUP BY 1")
def type_budget_report(g):
    a = assignment_of(g)
    kinds = g.nodes.join(a, "node_id").select(F.col("super_id").alias("node_id"), "type_id").distinct()
    return r(K.type_budgets(g.nodes, kinds, 0), "ratio")


@query("SELECT label, " + rs(("precision", "0.0"), ("recall", "0.0"), ("f1", "0.0")) + " FROM (SELECT label FROM pred UNION SELECT pred FROM pred)")
def per_class_deltas(g):
    p = K.predicted(logits_of(g))
    return r(K.per_class_change(p, p), "precision", "recall", "f1")


@query("SELECT i, j, " + O.r("0.25::DOUBLE * spec + 0.1::DOUBLE * feat + 0.5::DOUBLE * rel") + " AS cost FROM scored")
def task_aligned_score(g):
    s = scored_of(g).select("i", "j", "spec", "feat", F.col("rel").alias("anchor"), F.lit(0.0).alias("context"), F.lit(0.0).alias("meta"), F.lit(0.0).alias("teacher"))
    return r(K.task_aligned_cost(s).select("i", "j", "cost"), "cost")


@query("SELECT 1.0::DOUBLE AS best, 3.0::DOUBLE AS best_x, " + O.r("(0.25 + 0.75 + 2 * 0.75 + 0.75) / 5") + " AS area")
def refine_curve(g):
    points = g.nodes.sparkSession.sql("SELECT CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM VALUES (0, 0.0), (1, 0.5), (3, 1.0), (5, 0.5) AS t(x, y)").where("x != 1 OR y = 0.5")
    return r(K.curve_summary(points), "area")
