"""Folders, the plan with its resumption, the command line and streams."""

import json

import pytest
from pyspark.sql import functions as F

from loomgraph import cli, plans, sources, streaming
from loomgraph.config import DEFAULTS, deep_update, fingerprint, load_config


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def shop(spark):
    return sources.synthetic_graph(spark, 60, 30, 12)


def test_round_trips(spark, shop, tmp_path):
    sources.save_graph(shop, f"{tmp_path}/g")
    back = sources.load_graph(spark, f"{tmp_path}/g")
    for name in ("nodes", "edges", "relations", "features"):
        assert rows(getattr(back, name)) == rows(getattr(shop, name).select(getattr(back, name).columns))
    users = shop.nodes_of_type(0)
    ids = sources.write_text_graph(shop, f"{tmp_path}/t", users.where("node_id < 40"), users.where("node_id >= 40"), [4, 0, 1])
    assert ids.count() == 102 and [r.new_id for r in ids.orderBy("new_id").collect()] == list(range(102))
    t = sources.read_text_graph(spark, f"{tmp_path}/t")
    links = [(r.rel_id, r.src, r.dst) for r in t["edges"].collect()]
    assert len(links) == 60 + 180 + 180 and links == sorted(links)
    s = sources.text_graph_summary(t).first()
    assert json.loads(s.type_id) == {"0": 60, "1": 30, "2": 12} and (s.labelled, s["shape"]) == (40, "single")
    again = sources.graph_of_text(spark, f"{tmp_path}/t")
    assert again.nodes.where("label >= 0").count() == 40 and again.features.count() == 102
    with pytest.raises(ValueError):
        sources.write_text_graph(shop, f"{tmp_path}/u", users, users)


def test_package(spark, shop, tmp_path):
    users = shop.nodes_of_type(0)
    m = sources.export_package(shop, f"{tmp_path}/p", 0, {"train": users.where("node_id < 30"), "test": users.where("node_id >= 30")})
    assert m["splits"] == {"test": 30, "train": 30} and m == json.loads(json.dumps(sources.read_json(spark, f"{tmp_path}/p/manifest.json")))
    e = spark.read.parquet(f"{tmp_path}/p/edges").where("rel_id = 2")
    assert e.agg(F.max("src"), F.max("dst")).first() == (29, 11)
    with pytest.raises(ValueError):
        sources.export_package(shop, f"{tmp_path}/q", 0, {"a": users, "b": users})
    with pytest.raises(ValueError):
        sources.export_package(shop, f"{tmp_path}/q", 0, {"a": shop.nodes_of_type(1)})


def test_typed_tables(spark):
    a = spark.createDataFrame([(0, [1.0]), (2, [2.0])], "local_id long, x array<double>")
    b = spark.createDataFrame([(0,), (1,)], "local_id long")
    labels = {"a": spark.createDataFrame([(0, [0, 1, 1]), (2, [0, 0, 0])], "local_id long, label array<int>")}
    g = sources.from_typed_tables({"a": a, "b": b}, {("a", "to", "b"): spark.createDataFrame([(2, 1)], "src long, dst long")}, labels)
    assert rows(g.nodes.select("node_id", "type_id", "label")) == [(0, 0, 1), (2, 0, -1), (3, 1, -1), (4, 1, -1)]
    assert rows(g.edges) == [(0, 2, 4, 1.0)] and rows(g.relations) == [(0, "a__to__b", 0, 1)]
    assert g.violations().agg(F.sum("n")).first()[0] == 0


def test_config(tmp_path):
    assert deep_update({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    (tmp_path / "c.json").write_text('{"levels": 2, "candidates": {"keep": 3}}')
    c = load_config(str(tmp_path / "c.json"))
    assert c["levels"] == 2 and c["candidates"]["keep"] == 3 and c["candidates"]["hub_cap"] == DEFAULTS["candidates"]["hub_cap"]
    assert fingerprint(c) != fingerprint(load_config())
    with pytest.raises(ValueError, match="candidates.kep"):
        load_config(candidates={"kep": 1})


def test_plan_goes_on_and_refuses_another(spark, shop, tmp_path, monkeypatch):
    folder, own = f"{tmp_path}/run", {"levels": 2, "target_ratio": 0.3, "sketch": {"dim": 2, "order": 1}, "guards": {"spectral": 0.95, "source": True, "relation": True}, "matching": {"protect": True, "repair": "energy"}}
    real, made = plans.one_level, []

    def counted(*a, **k):
        made.append(1)
        if len(made) == 2:
            raise RuntimeError("the driver is lost")
        return real(*a, **k)

    monkeypatch.setattr(plans, "one_level", counted)
    with pytest.raises(RuntimeError):
        plans.coarsen(shop, folder, own)
    levels = plans.coarsen(shop, folder, own)
    assert len(made) == 3 and len(levels) == 2  # the first level was read
    assert [r["level"] for r in plans.reports(spark, folder)] == [0, 1]
    n = shop.nodes.count()
    for g in levels:
        assert g.nodes.count() < n and g.violations().agg(F.sum("n")).first()[0] == 0
        assert g.edges.agg(F.sum("w")).first()[0] == pytest.approx(shop.edges.agg(F.sum("w")).first()[0])
        n = g.nodes.count()
    whole = spark.read.parquet(f"{folder}/level_1/cumulative")
    assert whole.count() == 102 and whole.select("super_id").distinct().count() == n
    assert len(plans.coarsen(shop, folder, own)) == 2 and len(made) == 3
    with pytest.raises(ValueError, match="another"):
        plans.coarsen(shop, folder, own | {"levels": 3})


@pytest.mark.parametrize("method", ["mutual_best", "greedy"])
def test_other_matchers(shop, method):
    level = plans.one_level(shop, load_config(sketch={"dim": 2, "order": 1, "method": "chebyshev_heat"}, matching={"method": method}, weights={"method": "inverse_energy"}, candidates={"sources": ["onehop", "ann", "bucket", "fallback"]}), 20)
    sizes = [r.c for r in level.assignment.groupBy("super_id").agg(F.count("*").alias("c")).collect()]
    assert max(sizes) == 2 and 0 < sizes.count(2) <= 20 and set(level.merged.columns) >= {"source", "conv", "cost"}


def test_command_line(spark, tmp_path):
    do = lambda *a: cli.run(cli.parser().parse_args(list(a)), spark)
    made = json.loads(do("generate-synthetic", f"{tmp_path}/g", "--users", "40", "--items", "20", "--tags", "10"))
    assert made["nodes"] == {"0": 40, "1": 20, "2": 10}
    (tmp_path / "c.json").write_text('{"levels": 1, "sketch": {"dim": 2, "order": 1}}')
    levels = json.loads(do("coarsen", f"{tmp_path}/g", f"{tmp_path}/o", "--config", f"{tmp_path}/c.json"))
    assert len(levels) == 1 and json.loads(do("diagnose", f"{tmp_path}/o"))[0]["original_nodes"] == 70
    assert len(json.loads(do("summary", f"{tmp_path}/g"))) == 5
    assert json.loads(do("aggregate", f"{tmp_path}/g", f"{tmp_path}/o/level_0/assignment", f"{tmp_path}/a")) == levels[0]
    assert do("export-text", f"{tmp_path}/g", f"{tmp_path}/x") == f"{tmp_path}/x"
    assert json.loads(do("import-text", f"{tmp_path}/x", f"{tmp_path}/y"))["edges"] == made["edges"]


def drained(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_streams(spark, tmp_path):
    pairs = [[(1, 2, 0.5), (2, 3, 0.4)], [(1, 3, 0.1)], [(3, 4, 0.1)]]
    for k, part in enumerate(pairs):
        spark.createDataFrame(part, "i long, j long, cost double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/p")
    stream = spark.readStream.schema("i long, j long, cost double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/p")
    got = drained(streaming.running_best(stream), "best", "update").groupBy("node").agg(F.min(F.struct("cost", "other")).alias("b")).select("node", "b.other", "b.cost")
    assert rows(got) == [(1, 3, 0.1), (2, 3, 0.4), (3, 1, 0.1), (4, 3, 0.1)]
    assert rows(streaming.mutual_of(got)) == [(1, 3, 0.1)]
    spark.sql("SELECT timestamp'2024-01-01 01:00:00' AS ts, 1L AS user_id, 'view' AS event_type UNION ALL SELECT timestamp'2024-01-01 02:00:00', 1L, 'view' UNION ALL SELECT timestamp'2024-01-05 02:00:00', 2L, 'click'").write.parquet(f"{tmp_path}/e")
    events = spark.readStream.schema("ts timestamp, user_id long, event_type string").parquet(f"{tmp_path}/e")
    out = drained(streaming.event_edges(events), "edges", "complete")
    assert rows(out.select("user_id", "event_type", "w")) == [(1, "view", 2), (2, "click", 1)]
    assert drained(streaming.event_degrees(events), "degrees", "complete").where("side = 'user'").agg(F.sum("degree")).first()[0] == 3
    assert streaming.pair_blocks(spark.createDataFrame(pairs[0] + pairs[1], "i long, j long, cost double"), 2).select("block").distinct().count() <= 2
