"""What large tables need: tables that are read often are settled once, as compressed columns, and plans carry no more than they must."""

import os

from pyspark.sql import functions as F

from loomgraph import functions as U
from loomgraph.graph import HeteroGraph
from loomgraph.operators import candidates as C
from loomgraph.operators import diagnostics as G
from loomgraph.operators import linalg as L
from loomgraph.operators import matching as M
from loomgraph.operators import metrics as D
from loomgraph.operators import response as R
from loomgraph.operators import scoring as S
from loomgraph.operators import selection as N

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().toString()


def edges(spark):
    return spark.createDataFrame([(0, 1, 11, 1.0), (0, 2, 11, 2.0), (1, 11, 1, 1.0), (1, 11, 2, 2.0), (2, 1, 2, 3.0)], "rel_id int, src long, dst long, w double")


def counted(calls):
    def settle(df):
        calls.append(df)
        return df

    return settle


def test_settled_tables_are_compressed_columns(spark):
    df = spark.range(1000).select("id", (F.col("id") / 7).alias("v"), F.array("id").alias("a"))
    s = U.settled(df)
    assert s.inputFiles() and all(f.endswith(".zstd.parquet") for f in s.inputFiles())
    assert sorted(s.collect()) == sorted(df.collect()) and s.dtypes == df.dtypes
    U.dropped(s)
    assert not os.path.exists(s._settled.removeprefix("file:"))


def test_settled_tables_are_as_large_as_their_rows(spark):
    s = U.settled(spark.range(3_000_000).select("id", F.lit(1).alias("t")))
    assert sum(os.path.getsize(f.removeprefix("file:")) for f in s.inputFiles()) < 10_000_000
    big = spark.range(9_000_000).select("id", (F.col("id") * 2).alias("v"))
    assert "BroadcastHashJoin" not in plan(big.join(s.select("id"), "id"))
    assert "BroadcastHashJoin" in plan(big.join(U.settled(spark.range(9)), "id"))
    assert s.where("id < 2 or id > 2999998").count() == 3 and s.sparkSession is spark


def test_settled_keeps_what_parquet_cannot(spark):
    df = spark.range(3).select(F.lit(None).alias("n"), F.col("id").alias("x"), F.col("id").alias("X"))
    assert sorted(r[1] for r in U.settled(df).collect()) == [0, 1, 2]
    assert U.settled(spark.range(5).where("id < 0")).count() == 0


def test_propagation_makes_the_edges_once(spark):
    nodes = spark.createDataFrame([(1, 0, 0, 0), (2, 0, 1, 0), (11, 1, -1, 0)], "node_id long, type_id int, label int, part_id int")
    calls = []
    a = nodes.select("node_id", F.col("node_id").alias("super_id"))
    rows = G.label_propagation(HeteroGraph(nodes, edges(spark), None, None), a, settle=counted(calls)).collect()
    assert [r.step for r in sorted(rows)] == [0, 1, 3, 5]
    assert [c.columns for c in calls].count(["node_id", "to", "w", "n"]) == 1


def test_smoothing_ends_join_an_edge_and_its_reverse(spark):
    x = L.probe(spark.createDataFrame([(1,), (2,), (11,)], "node_id long"), 2, 0, "gaussian")
    ends = L.smoothing_ends(edges(spark))
    assert ends.count() == 6 and ends.agg(F.sum("n")).first()[0] == 10
    rows = {r.node_id: (r.v0, r.v1) for r in x.collect()}
    want = {k: list(v) for k, v in rows.items()}
    share = {(0, 1, 11): 1, (0, 2, 11): 1, (1, 11, 1): 1 / 3, (1, 11, 2): 2 / 3, (2, 1, 2): 1}
    n = dict.fromkeys(rows, 0)
    for (_, s, d), w in share.items():
        for a, b in ((s, d), (d, s)):
            n[b] += 1
            for j in (0, 1):
                want[b][j] += w * rows[a][j]
    for r in L.neighbour_smoothing(edges(spark), x).collect():
        for j, v in enumerate((r.v0, r.v1)):
            assert abs(v - want[r.node_id][j] / (1 + n[r.node_id])) < 1e-12


def test_pairs_are_not_sorted(spark):
    nodes = spark.createDataFrame([(1, 0, 0, 0), (2, 0, 1, 0), (11, 1, -1, 0)], "node_id long, type_id int, label int, part_id int")
    for found in (C.onehop(edges(spark), nodes), C.twohop(edges(spark), nodes, 8, 20)):
        assert found.collect() == [(1, 2, 0.0, found.first().source)]
        assert "SortAggregate" not in plan(found)


def test_retained_candidates_are_made_once(spark, monkeypatch):
    from loomgraph import queries as Q
    from loomgraph.graph import from_tables

    calls = []
    monkeypatch.setattr(Q, "settled", counted(calls))
    Q.cand_retained_topk(from_tables(spark, SF))
    assert [c.columns for c in calls].count(["i", "j", "score", "source"]) == 4


def test_scales_of_a_term_read_settled_pairs(spark, monkeypatch):
    from loomgraph import queries as Q
    from loomgraph.graph import from_tables

    calls = []

    def settle(df):
        calls.append(df.columns)
        return U.settled(df)

    monkeypatch.setattr(Q, "settled", settle)
    assert Q.term_median_mad(from_tables(spark, SF)).count() > 0
    assert sum("rel" in c and "feat" in c for c in calls) == 1


def test_a_small_graph_reads_no_other_relations(spark, monkeypatch):
    from loomgraph import queries_more as Q
    from loomgraph.graph import from_tables

    monkeypatch.setattr(Q, "settled", lambda df: df)
    g = from_tables(spark, SF)
    h = Q.small(g)
    assert "l_partkey" not in h.edges._jdf.queryExecution().optimizedPlan().toString()
    want = g.induced(g.nodes.where("type_id IN (0, 1, 4)")).edges
    assert sorted(h.edges.collect()) == sorted(want.collect())


def test_task_first_level_makes_its_terms_once(spark):
    from loomgraph import queries_more as Q
    from loomgraph.graph import from_tables

    calls = []

    def settle(df):
        calls.append(df.columns)
        return U.settled(df)

    g = from_tables(spark, SF)
    assert R.task_first_level(g, 0, Q.known(g), 5, 0.7, settle=settle)[0].count() == g.nodes.count()
    assert calls.count(["i", "j", "spec", "rel", "cov", "pur", "feat"]) == 1


def test_scales_read_settled_terms(spark):
    calls = []
    x = spark.createDataFrame([(1, 0.5), (2, 0.25), (11, 1.0)], "node_id long, v0 double")
    nodes = spark.createDataFrame([(1, 0, 0, 0), (2, 0, 1, 0), (11, 1, -1, 0)], "node_id long, type_id int, label int, part_id int")
    features = spark.createDataFrame([(1, 0, [1.0]), (2, 0, [3.0])], "node_id long, type_id int, x array<double>")
    table = S.node_table(nodes, edges(spark), [0, 1, 2], features, x, x)
    p = {r.node_id: r.p for r in table.collect()}
    assert p[1] == [1 / 5, 0, 0, 1 / 5, 3 / 5, 0] and p[2] == [2 / 7, 0, 0, 2 / 7, 0, 3 / 7]
    out = S.score_pairs(spark.createDataFrame([(1, 2)], "i long, j long"), table, normalization="p95", settle=counted(calls))
    assert len(calls) == 1 and abs(out.first().cost - sum(S.LAMBDAS.values())) < 1e-9


def test_filter_bank_normalizes_once(spark):
    calls = []
    seed = spark.createDataFrame([(1, 1.0), (2, 0.0), (11, 0.0)], "node_id long, v0 double")
    bank = R.filter_bank(edges(spark), seed, [0, 1, 2], settle=counted(calls))
    assert sorted(bank) == sorted(R.TIMES)
    assert [c.columns for c in calls].count(["rel_id", "src", "dst", "w"]) == 1


def test_portions_of_a_product_equal_the_whole(spark):
    calls = []

    def settle(df):
        calls.append(df.columns)
        return U.settled(df)

    # 15 links and their reverse, chains within a type, a node without edges (9) and an edge to what is no node (99)
    links = [(p, 10 + p * k % 4, float(1 + p + k)) for p in range(1, 6) for k in range(3)] + [(2, 99, 3.0)]
    rows = [(0, a, b, w) for a, b, w in links] + [(1, b, a, w) for a, b, w in links] + [(2, p, p + 1, 1.0) for p in range(1, 5)]
    nodes = spark.createDataFrame([(n, int(n >= 10), -1, n % 2) for n in [*range(1, 7), 9, 10, 11, 12, 13]], "node_id long, type_id int, label int, part_id int")
    features = spark.createDataFrame([(n, 0, [n / 3]) for n in range(1, 6)], "node_id long, type_id int, x array<double>")
    g = HeteroGraph(nodes, spark.createDataFrame(rows, "rel_id int, src long, dst long, w double"), None, features, {1: 0})
    alpha = {0: 0.5, 1: 0.25, 2: 0.25}
    table, slices = S.product_table(g, alpha, 2, 12, settle)
    assert slices == 4 and sum(c[:4] == ["dim", "node_id", "v0", "v1"] for c in calls) == 2 * 6
    # no table of edges carries normalized weights
    assert [c for c in calls if "src" in c] == [["rel_id", "src", "dst", "w"]]
    e = L.normalized(g.edges)
    z = L.fused(e, L.probe(nodes, 2), alpha)
    whole = S.node_table(nodes, g.edges, list(alpha), features, z, L.fused(e, z, alpha))
    pairs = spark.createDataFrame([(1, 2), (1, 9), (3, 5), (4, 6), (10, 11), (11, 13), (5, 12)], "i long, j long")
    want = {(r.i, r.j): r for r in S.pair_terms(pairs, whole).collect()}
    got = S.pair_terms(pairs, table, slices=slices).collect()
    assert len(got) == len(want) == 6
    for r in got:
        assert all(abs(r[t] - want[r.i, r.j][t]) < 1e-9 for t in S.LAMBDAS)


def test_quantile_of_many_rows_is_exact(spark):
    for x in (F.col("id") * F.col("id") % 10007 / 7.0, F.lit(3.0), F.when(F.col("id") % 3 > 0, F.col("id") % 5 * 1.0)):
        rows = spark.range(5000).select(x.alias("x"))
        for q in (0.0, 0.5, 0.95, 1.0):
            assert abs(S.quantile(rows, F.col("x"), q, 100) - rows.agg(F.percentile("x", F.lit(q))).first()[0]) < 1e-9
    assert S.quantile(spark.range(0).select(F.col("id").alias("x")), F.col("x"), 0.95) is None


def test_block_keys_lead_as_in_the_sql(spark):
    none, row = [0.0] * 3, "node_id long, type_id int, rel array<double>, anchor array<double>, cls array<double>"
    df = spark.createDataFrame([(1, 3, none, none, [0.3004, 0.3001, 0.0, 0.3995]), (2, 3, [0.0, 0.4996, 0.5004], [0.1, 0.9, 0.2], [0.2, 0.2004, 0.2, 0.2]), (3, 3, [0.2, 0.3, 0.5], none, [0.0, 0.0, 0.0, 0.002])], row)
    got = {r.node_id: (r.rel_block, r.anchor_block, r.class_block) for r in N.block_keys(df).collect()}
    assert got == {1: (-1, -1, 3), 2: (1, 1, 0), 3: (2, -1, 3)}


def test_cheapest_merges_go_by_cost_and_ids(spark):
    pairs = [(k, 500 + k, (k * 7 % 5) / 4) for k in range(300)]
    df = spark.createDataFrame(pairs, "i long, j long, cost double").repartition(3)
    for most in (0, 1, 97, 300, 400):
        got = M.cheapest(df, most)
        assert sorted((r.cost, r.i, r.j) for r in got.collect()) == sorted((c, i, j) for i, j, c in pairs)[:most]
        assert "TakeOrderedAndProject" not in plan(got) and "GlobalLimit" not in plan(got)


def test_a_scan_of_clusters_gets_no_more_columns_than_it_reads(spark):
    df = spark.createDataFrame([(1, 2, 0.5, 7, "onehop"), (2, 3, 0.1, 7, "bucket")], "i long, j long, cost double, g int, source string")
    out = M.greedy_cluster(df, ["g"], 2)
    assert "source" not in out._jdf.queryExecution().optimizedPlan().toString().split("LogicalRDD")[0] and [(r.i, r.j) for r in out.collect()] == [(2, 3)]


def test_energies_of_several_signals_come_from_one_pass(spark):
    x = L.probe(spark.createDataFrame([(1,), (2,), (11,)], "node_id long"), 3, 0, "gaussian")
    got = {r.rel_id: (r.p, r.q) for r in D.dirichlet_energies(edges(spark), x, {"p": ["v0", "v1"], "q": ["v2"]}).collect()}
    one = lambda *c: {r.rel_id: r.energy for r in D.dirichlet_energy(edges(spark), x.select("node_id", *c)).collect()}
    p, q = one("v0", "v1"), one("v2")
    assert got.keys() == p.keys() and all(abs(got[r][0] - p[r]) < 1e-12 and abs(got[r][1] - q[r]) < 1e-12 for r in p)
