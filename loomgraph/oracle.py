"""DuckDB SQL of the queries: common table expressions, put in front of a query as far as it needs them."""

from __future__ import annotations

import re

from .graph import BASE, RELATIONS

P = 2147483647


def mixed(id_: str, j: str = "0", seed: int = 0) -> str:
    h1 = f"(({id_}) * 48271::BIGINT + ({j})::BIGINT * 69621 + {seed}) % {P}"
    h2 = f"(({h1}) * ({h1}) + ({j})::BIGINT * 7919 + {seed}) % {P}"
    return f"((({h2}) * ({h2}) + ({h1})) % {P})"


def sign(id_: str, j: str = "0", seed: int = 0) -> str:
    return f"CASE WHEN {mixed(id_, j, seed)} < 1073741824 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END"


def g(type_id: int, key: str) -> str:
    return f"({type_id * BASE}::BIGINT + {key}::BIGINT)"


def r(expr: str, digits: int = 6) -> str:
    return f"(round({expr}, {digits}) + 0.0)::DOUBLE"


def _node(type_id, key, table, label="-1") -> str:
    return f"SELECT {g(type_id, key)} AS node_id, {type_id}::INTEGER AS type_id, ({label})::INTEGER AS label, ({key} % 4)::INTEGER AS part_id FROM {table}"


CTE = {
    "rels": "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}', {s}, {d})" for i, n, s, d in RELATIONS) + ") t(rel_id, name, src_type, dst_type)",
    "kinds": "SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS code FROM (SELECT DISTINCT event_type FROM events)",
    "nodes": " UNION ALL ".join([
        _node(0, "c_custkey", "(SELECT *, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS code FROM customer)", "code"),
        _node(1, "o_orderkey", "(SELECT *, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS code FROM orders)", "code"),
        _node(2, "p_partkey", "part"), _node(3, "s_suppkey", "supplier"), _node(4, "n_nationkey", "nation"), _node(5, "r_regionkey", "region"),
        _node(6, "user_id", "(SELECT DISTINCT user_id FROM events)"), _node(7, "code", "kinds"), _node(8, "vec_id", "embeddings", "label"),
        _node(9, "doc_id", "(SELECT d.doc_id, q.quality FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) q USING (doc_id))", "coalesce(quality, -1)"),
    ]),
    "contains": f"SELECT {g(1, 'l_orderkey')} AS a, {g(2, 'l_partkey')} AS b, sum(l_quantity) AS w FROM lineitem GROUP BY l_orderkey, l_partkey",
    "supplied": f"SELECT {g(2, 'l_partkey')} AS a, {g(3, 'l_suppkey')} AS b, count(*) AS w FROM lineitem GROUP BY l_partkey, l_suppkey",
    "following": "SELECT o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nxt FROM orders",
    "did": f"SELECT {g(6, 'user_id')} AS a, {g(7, 'code')} AS b, count(*) AS w FROM events JOIN kinds USING (event_type) GROUP BY user_id, code",
    "edges": "SELECT rel_id::INTEGER AS rel_id, a AS src, b AS dst, w::DOUBLE AS w FROM (" + " UNION ALL ".join([
        f"SELECT 0 AS rel_id, {g(0, 'o_custkey')} AS a, {g(1, 'o_orderkey')} AS b, 1.0::DOUBLE AS w FROM orders",
        f"SELECT 1, {g(1, 'o_orderkey')}, {g(0, 'o_custkey')}, 1.0::DOUBLE FROM orders",
        "SELECT 2, a, b, w::DOUBLE FROM contains", "SELECT 3, b, a, w::DOUBLE FROM contains",
        "SELECT 4, a, b, w::DOUBLE FROM supplied", "SELECT 5, b, a, w::DOUBLE FROM supplied",
        f"SELECT 6, {g(0, 'c_custkey')}, {g(4, 'c_nationkey')}, 1.0::DOUBLE FROM customer",
        f"SELECT 7, {g(3, 's_suppkey')}, {g(4, 's_nationkey')}, 1.0::DOUBLE FROM supplier",
        f"SELECT 8, {g(4, 'n_nationkey')}, {g(5, 'n_regionkey')}, 1.0::DOUBLE FROM nation",
        f"SELECT 9, {g(1, 'o_orderkey')}, {g(1, 'nxt')}, 1.0::DOUBLE FROM following WHERE nxt IS NOT NULL",
        "SELECT 10, a, b, w::DOUBLE FROM did",
    ]) + ")",
    "feats": " UNION ALL ".join([
        f"SELECT {g(0, 'c_custkey')} AS node_id, 0 AS type_id, [c_acctbal / 10000, c_nationkey / 25.0::DOUBLE] AS x FROM customer",
        f"SELECT {g(1, 'o_orderkey')}, 1, [o_totalprice / 100000] FROM orders",
        f"SELECT {g(2, 'p_partkey')}, 2, [p_size / 50.0::DOUBLE, p_retailprice / 1000] FROM part",
        f"SELECT {g(3, 's_suppkey')}, 3, [s_acctbal / 10000] FROM supplier",
        f"SELECT {g(8, 'vec_id')}, 8, embedding::DOUBLE[] FROM embeddings",
        f"SELECT {g(9, 'doc_id')}, 9, [n_chars::DOUBLE] FROM documents",
    ]),
    "flat": "SELECT node_id, type_id, (unnest(generate_series(1, len(x))) - 1)::INTEGER AS j, unnest(x) AS v FROM feats",
    "ne": "SELECT rel_id, src, dst, w / greatest(sqrt(sum(w) OVER (PARTITION BY rel_id, src) * sum(w) OVER (PARTITION BY rel_id, dst)), 1e-12) AS w FROM edges",
    "ne1": "SELECT rel_id, src, dst, w / greatest(sqrt(sum(w) OVER (PARTITION BY src) * sum(w) OVER (PARTITION BY dst)), 1e-12) AS w FROM edges",
    "turned": "SELECT rel_id, src AS a, dst AS b, w FROM ne UNION ALL SELECT rel_id, dst, src, w FROM ne",
    "x": f"SELECT node_id, j::INTEGER AS j, {sign('node_id', 'j')} AS v FROM nodes, range(2) t(j)",
    # S x of the symmetric fused operator with equal weights
    "sx": "SELECT b AS node_id, j, sum(0.5::DOUBLE * turned.w * v) / 11 AS v FROM turned JOIN x ON node_id = a GROUP BY 1, 2",
    "mass": "SELECT node_id, sum(w) AS mass FROM (SELECT src AS node_id, w FROM edges UNION ALL SELECT dst, w FROM edges) GROUP BY 1",
    "placed": "SELECT *, row_number() OVER (PARTITION BY type_id, part_id ORDER BY node_id) AS rk FROM nodes",
    "pairs": "SELECT min(node_id) AS i, max(node_id) AS j, min(type_id) AS type_id FROM placed GROUP BY placed.type_id, part_id, (rk - 1) // 2 HAVING count(*) = 2",
    "asg": "SELECT n.node_id, coalesce(p.i, n.node_id) AS super_id FROM nodes n LEFT JOIN pairs p ON p.j = n.node_id",
    "coarse": "SELECT rel_id, a.super_id AS src, b.super_id AS dst, sum(w) AS w FROM edges e JOIN asg a ON a.node_id = src JOIN asg b ON b.node_id = dst GROUP BY 1, 2, 3",
    "profiles": "SELECT node_id, dim, m / sum(m) OVER (PARTITION BY node_id) AS p FROM (SELECT src AS node_id, 2 * rel_id AS dim, sum(w) AS m FROM edges GROUP BY 1, 2 UNION ALL SELECT dst, 2 * rel_id + 1, sum(w) FROM edges GROUP BY 1, 2)",
    "pp": "SELECT i, j, dim, sum(a) AS p, sum(b) AS q FROM (SELECT i, j, dim, p AS a, 0.0::DOUBLE AS b FROM pairs JOIN profiles ON node_id = i UNION ALL SELECT i, j, dim, 0.0::DOUBLE, p FROM pairs JOIN profiles ON node_id = j) GROUP BY 1, 2, 3",
    "jsd": "SELECT i, j, coalesce(rel, 0) AS rel FROM pairs LEFT JOIN (SELECT i, j, sum(((CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END) + (CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END)) / 2) AS rel FROM pp GROUP BY 1, 2) USING (i, j)",
    "dist": "SELECT p.i AS i, p.j AS j, sum((coalesce(a.v, 0) - coalesce(b.v, 0)) ** 2) AS d FROM (SELECT i, j, c FROM pairs, range(2) t(c)) p LEFT JOIN sx a ON a.node_id = p.i AND a.j = c LEFT JOIN sx b ON b.node_id = p.j AND b.j = c GROUP BY 1, 2",
    "spec": "SELECT i, j, d * coalesce(a.mass, 0) * coalesce(b.mass, 0) / greatest(coalesce(a.mass, 0) + coalesce(b.mass, 0), 1e-12) AS spec FROM dist LEFT JOIN mass a ON a.node_id = i LEFT JOIN mass b ON b.node_id = j",
    "feat": "SELECT i, j, coalesce(f, 0) AS feat FROM pairs LEFT JOIN (SELECT p.i AS i, p.j AS j, sum((a.v - b.v) ** 2) AS f FROM pairs p JOIN flat a ON a.node_id = p.i JOIN flat b ON b.node_id = p.j AND b.j = a.j GROUP BY 1, 2) USING (i, j)",
    "ssx": "SELECT b AS node_id, j, sum(0.5::DOUBLE * turned.w * v) / 11 AS v FROM turned JOIN sx ON node_id = a GROUP BY 1, 2",
    "conv": "SELECT p.i AS i, p.j AS j, sum((coalesce(a.v, 0) - coalesce(b.v, 0)) ** 2) AS conv FROM (SELECT i, j, c FROM pairs, range(2) t(c)) p LEFT JOIN ssx a ON a.node_id = p.i AND a.j = c LEFT JOIN ssx b ON b.node_id = p.j AND b.j = c GROUP BY 1, 2",
    "risk": "SELECT n.node_id, n.part_id, coalesce(cut, 0) + 0.05::DOUBLE * ln(1 + coalesce(mass, 0)) + (CASE WHEN coalesce(mass, 0) <= 1 THEN 1 ELSE 0 END) AS risk FROM nodes n LEFT JOIN (SELECT e.a AS node_id, max((p.part_id <> q.part_id)::INTEGER) AS cut, sum(w) AS mass FROM (SELECT src AS a, dst AS b, w FROM edges UNION ALL SELECT dst, src, w FROM edges) e JOIN nodes p ON p.node_id = e.a JOIN nodes q ON q.node_id = e.b GROUP BY 1) c ON c.node_id = n.node_id",
    "bound": "SELECT p.i, p.j, greatest(a.risk, b.risk, (a.part_id <> b.part_id)::INTEGER) AS boundary FROM pairs p JOIN risk a ON a.node_id = i JOIN risk b ON b.node_id = j",
    "scored": "SELECT p.i, p.j, p.type_id, spec, rel, feat, conv, boundary FROM pairs p JOIN spec USING (i, j) JOIN jsd USING (i, j) JOIN feat USING (i, j) JOIN conv USING (i, j) JOIN bound USING (i, j)",
    "costs": f"SELECT i, j, type_id, spec, rel, feat, {r('1.0::DOUBLE * spec + 0.2::DOUBLE * rel + 0.1::DOUBLE * feat + 0.5::DOUBLE * conv + 0.1::DOUBLE * boundary', 9)} AS cost FROM scored",
    "centroids": "SELECT label, j, avg(v) AS c FROM flat JOIN nodes USING (node_id) WHERE flat.type_id = 8 GROUP BY 1, 2",
    "logits": "SELECT node_id, n.label AS label, c.label AS k, round(sum(v * c.c) / 8, 6) AS s FROM flat f JOIN nodes n USING (node_id) JOIN centroids c ON c.j = f.j WHERE f.type_id = 8 GROUP BY 1, 2, 3",
    "probs": "SELECT *, exp(s - max(s) OVER w) / sum(exp(s - m)) OVER w AS p FROM (SELECT *, max(s) OVER (PARTITION BY node_id) AS m FROM logits) WINDOW w AS (PARTITION BY node_id)",
    "pred": "SELECT node_id, label, k::INTEGER AS pred FROM logits QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY s DESC, k) = 1",
    "touch": "SELECT rel_id, 0 AS side, src AS target_id, dst AS node_id, w FROM edges JOIN nodes a ON a.node_id = src JOIN nodes b ON b.node_id = dst WHERE a.type_id = 0 AND b.type_id <> 0 UNION ALL SELECT rel_id, 1, dst, src, w FROM edges JOIN nodes a ON a.node_id = src JOIN nodes b ON b.node_id = dst WHERE b.type_id = 0 AND a.type_id <> 0",
    "foot": "SELECT node_id, label, m / greatest(sum(m) OVER (PARTITION BY node_id), 1e-12) AS p FROM (SELECT t.node_id, n.label, sum(w) AS m FROM touch t JOIN nodes n ON n.node_id = target_id WHERE n.label >= 0 GROUP BY 1, 2)",
    "support": "SELECT t.node_id, n.type_id, sum(w) AS degree, count(DISTINCT target_id) AS anchors, count(DISTINCT rel_id * 2 + side) AS relations, max(coalesce(p, 0)) AS purity FROM touch t JOIN nodes n USING (node_id) LEFT JOIN (SELECT node_id, max(p) AS p FROM foot GROUP BY 1) q ON q.node_id = t.node_id GROUP BY 1, 2",
    "ends": "SELECT max(degree) AS dh, min(degree) AS dl, max(anchors) AS ah, min(anchors) AS al, max(purity) AS ph, min(purity) AS pl FROM support",
    "imp": "SELECT node_id, type_id, degree, round(0.5::DOUBLE * (CASE WHEN dh > dl THEN (degree - dl) / (dh - dl) ELSE 0 END) + 0.25::DOUBLE * (CASE WHEN ah > al THEN (anchors - al)::DOUBLE / (ah - al) ELSE 0 END) + 0.25::DOUBLE * (CASE WHEN ph > pl THEN (purity - pl) / (ph - pl) ELSE 0 END), 9) AS importance FROM support, ends",
    "anchors3": "SELECT target_id, rel_id, node_id, w FROM (SELECT target_id, rel_id, node_id, sum(w) AS w FROM touch GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY target_id, rel_id ORDER BY w DESC, node_id) <= 3",
    # the task-first view: customers are the target, four fifths of their labels are known
    "known": "SELECT node_id, label FROM nodes WHERE type_id = 0 AND label >= 0 AND node_id % 5 <> 0",
    "links": "SELECT src AS t, dst AS node_id, w FROM edges JOIN rels USING (rel_id) WHERE src_type = 0 AND dst_type <> 0 UNION ALL SELECT dst, src, w FROM edges JOIN rels USING (rel_id) WHERE dst_type = 0 AND src_type <> 0",
    "cmass": "SELECT l.node_id, k.label, sum(w) AS m FROM links l JOIN known k ON k.node_id = l.t GROUP BY 1, 2",
    "cfoot": "SELECT node_id, label, m / greatest(sum(m) OVER (PARTITION BY node_id), 1e-12) AS p FROM cmass",
    "ctwo": "SELECT node_id, label, sum(m) AS m FROM (SELECT node_id, label, m FROM cmass UNION ALL SELECT l.node_id, c.label, l.w * c.m FROM links l JOIN (SELECT t, label, sum(w * m) AS m FROM links JOIN cmass USING (node_id) GROUP BY 1, 2) c ON c.t = l.t) GROUP BY 1, 2",
    "rfoot": "SELECT node_id, dim, m / greatest(sum(m) OVER (PARTITION BY node_id), 1e-12) AS p FROM (SELECT node_id, dim, sum(w) AS m FROM (SELECT src AS node_id, 2 * rel_id AS dim, w FROM edges JOIN rels USING (rel_id) WHERE src_type <> 0 AND dst_type = 0 UNION ALL SELECT dst, 2 * rel_id + 1, w FROM edges JOIN rels USING (rel_id) WHERE dst_type <> 0 AND src_type = 0) GROUP BY 1, 2)",
    "spairs": "SELECT i, j FROM pairs WHERE type_id <> 0",
    "anch": "SELECT DISTINCT target_id, node_id FROM anchors3",
    "seed": "SELECT n.node_id, c::INTEGER AS j, (CASE WHEN k.label = c THEN 1.0 ELSE 0.0 END)::DOUBLE AS v FROM nodes n LEFT JOIN known k ON k.node_id = n.node_id, range(5) t(c)",
    "xm": "SELECT super_id AS node_id, j, avg(v) AS v FROM x JOIN asg USING (node_id) GROUP BY 1, 2",
    "cne": "SELECT rel_id, src, dst, w / greatest(sqrt(sum(w) OVER (PARTITION BY rel_id, src) * sum(w) OVER (PARTITION BY rel_id, dst)), 1e-12) AS w FROM coarse",
    "cands": "SELECT i, j, 'onehop' AS source FROM (SELECT DISTINCT least(src, dst) AS i, greatest(src, dst) AS j FROM edges JOIN nodes a ON a.node_id = src JOIN nodes b ON b.node_id = dst WHERE a.type_id = b.type_id AND a.part_id = b.part_id AND src <> dst) UNION ALL SELECT i, j, 'fallback' FROM pairs",
    "ecount": "SELECT rel_id, count(*) AS m, sum(w) AS vol FROM edges GROUP BY 1",
    "escore": "SELECT rel_id, src, dst, w, 1.0::DOUBLE / sqrt(count(*) OVER (PARTITION BY rel_id, src) * count(*) OVER (PARTITION BY rel_id, dst)) AS score, count(*) OVER (PARTITION BY rel_id, src) AS ds, count(*) OVER (PARTITION BY rel_id, dst) AS dd FROM edges",
    "plan": "SELECT rel_id, m, least(m, low + whole + CASE WHEN row_number() OVER (ORDER BY round(share - whole, 9) DESC, rel_id::VARCHAR DESC) <= rest - sum(whole) OVER () THEN 1 ELSE 0 END) AS budget FROM (SELECT *, floor(share) AS whole FROM (SELECT *, rest * (m::DOUBLE / sum(m) OVER ()) AS share FROM (SELECT *, least(10, m) AS low, greatest(0, 5000 - sum(least(10, m)) OVER ()) AS rest FROM ecount WHERE rel_id < 6)))",
}


def needed(body: str) -> list[str]:
    """Names of the expressions that a query uses, in the order of CTE's own dependencies. Those that it defines itself are its own."""
    found: list[str] = []
    own = set(re.findall(r"\b(\w+)(?:\([a-z, ]+\))? AS (?:MATERIALIZED )?\(", body))

    def visit(text: str) -> None:
        for name in CTE:
            if name not in found and name not in own and re.search(rf"(FROM|JOIN|,)\s+\(?{name}\b", text):
                visit(CTE[name])
                if name not in found:
                    found.append(name)

    visit(body)
    return found


def sql(body: str) -> str:
    names = needed(body)
    parts = ", ".join(f"{n} AS MATERIALIZED ({CTE[n]})" for n in names)
    if body.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {parts}, {body[15:]}" if names else body
    if body.startswith("WITH "):
        return f"WITH {parts}, {body[5:]}" if names else body
    return f"WITH {parts} {body}" if names else body
