"""Graphs on disk: partitioned Parquet with a schema file, tab-separated text folders and packages by type; small reports."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import mixed, uniform
from ..graph import HeteroGraph, ranked


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def write_json(spark: SparkSession, path: str, value: Any) -> None:
    """One small value, written beside its place and moved there whole, on whatever store the path names."""
    beside, fs = _path(spark, path + ".part")
    out = fs.create(beside, True)
    try:
        out.write(bytearray(json.dumps(value, indent=1, sort_keys=True, default=str).encode()))
    finally:
        out.close()
    place, _ = _path(spark, path)
    fs.delete(place, False)
    if not fs.rename(beside, place):
        raise OSError(f"could not move {path}.part")


def read_json(spark: SparkSession, path: str) -> Any:
    return json.loads("\n".join(r.value for r in spark.read.option("wholetext", True).text(path).collect()))


def write_rows(df: DataFrame, path: str, kind: str = "csv") -> None:
    """A report table as one CSV file with a header, or as JSON lines."""
    one = df.coalesce(1).write.mode("overwrite")
    if kind == "csv":
        one.option("header", True).csv(path)
    else:
        one.json(path)


def save_graph(graph: HeteroGraph, path: str) -> None:
    """Edges partitioned by relation, nodes and features by type, so that scans prune what they do not need."""
    graph.nodes.write.mode("overwrite").partitionBy("type_id").parquet(f"{path}/nodes")
    graph.edges.write.mode("overwrite").partitionBy("rel_id").parquet(f"{path}/edges")
    graph.features.write.mode("overwrite").partitionBy("type_id").parquet(f"{path}/features")
    graph.relations.coalesce(1).write.mode("overwrite").json(f"{path}/relations")


def load_graph(spark: SparkSession, path: str) -> HeteroGraph:
    nodes = spark.read.schema("node_id long, label int, part_id int, type_id int").parquet(f"{path}/nodes").select("node_id", "type_id", "label", "part_id")
    edges = spark.read.schema("src long, dst long, w double, rel_id int").parquet(f"{path}/edges").select("rel_id", "src", "dst", "w")
    features = spark.read.schema("node_id long, x array<double>, type_id int").parquet(f"{path}/features").select("node_id", "type_id", "x")
    return HeteroGraph(nodes, edges, spark.read.schema("rel_id int, name string, src_type int, dst_type int").json(f"{path}/relations"), features)


def summary(graph: HeteroGraph) -> DataFrame:
    """(rel_id, name, edges, weight)."""
    return graph.edges.groupBy("rel_id").agg(F.count(F.lit(1)).alias("edges"), F.sum("w").alias("weight")).join(F.broadcast(graph.relations.select("rel_id", "name")), "rel_id")


def read_text_graph(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A folder of node.dat (id, name, type, features), link.dat (src, dst, relation, weight), label.dat (id, name, type, classes)."""
    read = lambda name, schema: spark.read.schema(schema).csv(f"{path}/{name}", sep="\t")
    nodes = read("node.dat", "node_id long, name string, type_id int, x string")
    nodes = nodes.withColumn("x", F.split("x", ",").cast("array<double>"))
    labels = read("label.dat", "node_id long, name string, type_id int, classes string").withColumn("classes", F.split("classes", ",").cast("array<int>"))
    return {"nodes": nodes, "edges": read("link.dat", "src long, dst long, rel_id int, w double"), "labels": labels}


def text_graph_audit(tables: dict[str, DataFrame]) -> DataFrame:
    """(kind, key, n): nodes by type, edges by relation, labels by class."""
    of = lambda df, kind, c: df.groupBy(F.col(c).alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "key", "n")
    return of(tables["nodes"], "type", "type_id").unionByName(of(tables["edges"], "relation", "rel_id")).unionByName(of(tables["labels"].select(F.explode("classes").alias("c")), "class", "c"))


def write_text_graph(graph: HeteroGraph, path: str, train: DataFrame, test: DataFrame, relation_order: list[int] | None = None) -> DataFrame:
    """The text folder with ids renumbered type by type from 0, and relations by their place in relation_order (those that it lacks
    are left out) if there is one; links are sorted by relation and ends. Returns (node_id, new_id). Labels of -1 are left out;
    two splits that share a node are an error."""
    if not train.select("node_id").join(test.select("node_id"), "node_id", "left_semi").isEmpty():
        raise ValueError("a node is in both splits")
    ids = type_major_ids(graph)
    name = F.concat(F.lit("n"), F.col("new_id"))
    nodes = ids.join(graph.features.select("node_id", "x"), "node_id", "left").select("new_id", name, "type_id", F.coalesce(F.concat_ws(",", F.col("x").cast("array<string>")), F.lit("")))
    s, d = ids.select(F.col("node_id").alias("src"), F.col("new_id").alias("s")), ids.select(F.col("node_id").alias("dst"), F.col("new_id").alias("d"))
    links = graph.edges.join(s, "src").join(d, "dst")
    if relation_order is not None:
        place = F.array_position(F.array(*[F.lit(r) for r in relation_order]), F.col("rel_id")).cast("int") - 1
        links = links.where(F.col("rel_id").isin(relation_order)).withColumn("rel_id", place)
    links = links.select("s", "d", "rel_id", "w").orderBy("rel_id", "s", "d")
    write = lambda df, file: df.write.mode("overwrite").csv(f"{path}/{file}", sep="\t")
    write(nodes.orderBy("new_id"), "node.dat")
    write(links, "link.dat")
    for file, part in (("label.dat", train), ("label.dat.test", test)):
        of = graph.nodes.where("label >= 0").join(part.select("node_id"), "node_id", "left_semi").join(ids.select("node_id", "new_id"), "node_id")
        write(of.select("new_id", name, "type_id", "label").orderBy("new_id"), file)
    return ids.select("node_id", "new_id")


def type_major_ids(graph: HeteroGraph) -> DataFrame:
    """(node_id, type_id, local_id, new_id): places within the type, and over all types in the order of their ids."""
    order = ranked(graph.nodes.select("node_id", "type_id"), ["type_id"], "node_id")
    sizes = graph.nodes.groupBy("type_id").count()
    # one row for each type
    before = sizes.alias("a").join(F.broadcast(sizes.alias("b")), F.col("b.type_id") < F.col("a.type_id"), "left").groupBy(F.col("a.type_id").alias("type_id")).agg(F.coalesce(F.sum("b.count"), F.lit(0)).alias("before"))
    return order.join(F.broadcast(before), "type_id").select("node_id", "type_id", (F.col("rank") - 1).alias("local_id"), (F.col("before") + F.col("rank") - 1).alias("new_id"))


def export_package(graph: HeteroGraph, path: str, target: int, splits: dict[str, DataFrame]) -> dict:
    """A folder by type and relation with type-local ids: features/type_id=t (local_id, x), edges/rel_id=r (src, dst, w), labels
    (local_id, label) and splits/<name> (local_id) of the target, and manifest.json, which is returned. Splits that share a node
    or hold one of another type are an error."""
    spark = graph.nodes.sparkSession
    ids = type_major_ids(graph).select("node_id", "type_id", "local_id")
    names = sorted(splits)
    for i, a in enumerate(names):
        if not splits[a].join(graph.nodes_of_type(target), "node_id", "left_anti").isEmpty():
            raise ValueError(f"split {a} holds nodes of another type")
        for b in names[:i]:
            if not splits[a].select("node_id").join(splits[b].select("node_id"), "node_id", "left_semi").isEmpty():
                raise ValueError(f"splits {b} and {a} share a node")
    graph.features.select("node_id", "x").join(ids, "node_id").select("type_id", "local_id", "x").write.mode("overwrite").partitionBy("type_id").parquet(f"{path}/features")
    s, d = ids.select(F.col("node_id").alias("src"), F.col("local_id").alias("s")), ids.select(F.col("node_id").alias("dst"), F.col("local_id").alias("d"))
    graph.edges.join(s, "src").join(d, "dst").select("rel_id", F.col("s").alias("src"), F.col("d").alias("dst"), "w").write.mode("overwrite").partitionBy("rel_id").parquet(f"{path}/edges")
    local = ids.where(F.col("type_id") == target)
    graph.nodes_of_type(target).select("node_id", "label").join(local, "node_id").select("local_id", "label").write.mode("overwrite").parquet(f"{path}/labels")
    for n in names:
        splits[n].select("node_id").join(local, "node_id").select("local_id").write.mode("overwrite").parquet(f"{path}/splits/{n}")
    manifest = {
        "target_type": target,
        "nodes": {str(r.type_id): r.n for r in graph.nodes.groupBy("type_id").agg(F.count(F.lit(1)).alias("n")).collect()},
        "edges": {str(r.rel_id): r.n for r in graph.edges.groupBy("rel_id").agg(F.count(F.lit(1)).alias("n")).collect()},
        "relations": [r.asDict() for r in graph.relations.orderBy("rel_id").collect()],
        "splits": {n: splits[n].count() for n in names},
    }
    write_json(spark, f"{path}/manifest.json", manifest)
    return manifest


def from_typed_tables(nodes: dict[str, DataFrame], edges: dict[tuple[str, str, str], DataFrame], labels: dict[str, DataFrame] | None = None) -> HeteroGraph:
    """A graph of tables by type name (local_id and, if there are any, x) and by (source type, verb, destination type) (src, dst and,
    if there is one, w). Types and relations are numbered in the order of the dictionaries; node ids are local ids offset type by
    type. labels by type: (local_id, label), a number or an array of zeros and ones, of which the first one is the label; -1
    without any. Ids may have gaps; an offset is the largest id of the types before."""
    kinds, offset, at = list(nodes), {}, 0
    for k in kinds:
        offset[k] = at
        at += 1 + (nodes[k].agg(F.max("local_id")).first()[0] if not nodes[k].isEmpty() else -1)
    all_nodes = all_features = all_edges = None
    for t, k in enumerate(kinds):
        rows = nodes[k].select("local_id").withColumn("__l", F.lit(-1))
        if labels and k in labels:
            raw = labels[k]
            value = F.col("label")
            if raw.schema["label"].dataType.typeName() == "array":
                value = F.coalesce(F.nullif(F.array_position(F.transform("label", lambda v: (v > 0).cast("int")), 1), F.lit(0)) - 1, F.lit(-1))
            rows = nodes[k].select("local_id").join(raw.select("local_id", value.alias("__l")), "local_id", "left")
        part = rows.select((F.col("local_id") + offset[k]).cast("long").alias("node_id"), F.lit(t).alias("type_id"), F.coalesce(F.col("__l"), F.lit(-1)).cast("int").alias("label"), F.lit(0).alias("part_id"))
        all_nodes = part if all_nodes is None else all_nodes.unionByName(part)
        if "x" in nodes[k].columns:
            x = nodes[k].select((F.col("local_id") + offset[k]).cast("long").alias("node_id"), F.lit(t).alias("type_id"), F.col("x").cast("array<double>").alias("x"))
            all_features = x if all_features is None else all_features.unionByName(x)
    specs = []
    for r, ((a, verb, b), e) in enumerate(edges.items()):
        specs.append((r, f"{a}__{verb}__{b}", kinds.index(a), kinds.index(b)))
        w = F.col("w").cast("double") if "w" in e.columns else F.lit(1.0)
        part = e.select(F.lit(r).alias("rel_id"), (F.col("src") + offset[a]).cast("long").alias("src"), (F.col("dst") + offset[b]).cast("long").alias("dst"), w.alias("w"))
        all_edges = part if all_edges is None else all_edges.unionByName(part)
    spark = all_nodes.sparkSession
    none = lambda schema: spark.createDataFrame([], schema)
    return HeteroGraph(all_nodes, all_edges if all_edges is not None else none("rel_id int, src long, dst long, w double"), spark.createDataFrame(specs, "rel_id int, name string, src_type int, dst_type int"), all_features if all_features is not None else none("node_id long, type_id int, x array<double>"))


def text_graph_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """One row: nodes by type and links by relation as JSON maps, labelled nodes, classes, and whether a node has several."""
    count = lambda df, c: df.groupBy(c).agg(F.count(F.lit(1)).alias("n")).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(c).cast("string"), "n"))))).alias(c))
    of = tables["labels"].agg(F.count(F.lit(1)).alias("labelled"), (F.coalesce(F.max(F.array_max("classes")), F.lit(-1)) + 1).alias("classes"), F.when(F.max(F.size("classes")) > 1, "multi").otherwise("single").alias("shape"))
    return count(tables["nodes"], "type_id").join(F.broadcast(count(tables["edges"], "rel_id"))).join(F.broadcast(of))


def synthetic_graph(spark: SparkSession, users: int = 1000, items: int = 500, tags: int = 100, seed: int = 0) -> HeteroGraph:
    """Users, items and tags: three items for each user, two tags for each item, their reverses and a ring of users."""
    kinds = [(0, users, 0), (1, items, users), (2, tags, users + items)]
    nodes = None
    for t, n, first in kinds:
        label = (mixed(F.col("id"), 3, seed) % 3).cast("int") if t == 0 else F.lit(-1)
        part = spark.range(first, first + n).select(F.col("id").alias("node_id"), F.lit(t).alias("type_id"), label.alias("label"), F.lit(0).alias("part_id"))
        nodes = part if nodes is None else nodes.unionByName(part)

    def choose(first, n, to, m, k):
        """k different targets: steps of a hash from a hash, apart by construction."""
        at = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("c")
        return spark.range(first, first + n).select(F.col("id").alias("src"), at).select("src", (F.lit(to) + (mixed(F.col("src"), 1, seed) + F.col("c") * (m // k)) % m).alias("dst"))

    ui, it = choose(0, users, users, items, 3), choose(users, items, users + items, tags, 2)
    ring = spark.range(users).select(F.col("id").alias("src"), ((F.col("id") + 1) % users).alias("dst"))
    turn = lambda e: e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    edges = None
    for r, e in enumerate((ui, turn(ui), it, turn(it), ring)):
        part = e.select(F.lit(r).alias("rel_id"), "src", "dst", F.lit(1.0).alias("w"))
        edges = part if edges is None else edges.unionByName(part)
    relations = spark.sql("SELECT * FROM VALUES (0, 'user_to_item', 0, 1), (1, 'item_to_user', 1, 0), (2, 'item_to_tag', 1, 2), (3, 'tag_to_item', 2, 1), (4, 'user_to_user', 0, 0) AS t(rel_id, name, src_type, dst_type)")
    x = F.array(*[uniform(F.col("node_id"), j, seed) for j in range(8)])
    return HeteroGraph(nodes, edges, relations, nodes.select("node_id", "type_id", x.alias("x")))


def graph_of_text(spark: SparkSession, path: str) -> HeteroGraph:
    """The graph of a text folder: a node's label is its first class, a relation's types are those of its first link."""
    t = read_text_graph(spark, path)
    label = t["labels"].select("node_id", F.get("classes", F.lit(0)).alias("label"))
    nodes = t["nodes"].join(label, "node_id", "left").select("node_id", "type_id", F.coalesce("label", F.lit(-1)).alias("label"), F.lit(0).alias("part_id"))
    edges = t["edges"].select("rel_id", "src", "dst", "w")
    kinds = t["nodes"].select("node_id", "type_id")
    first = edges.groupBy("rel_id").agg(F.min(F.struct("src", "dst")).alias("e")).select("rel_id", "e.src", "e.dst")
    of = first.join(kinds.withColumnsRenamed({"node_id": "src", "type_id": "src_type"}), "src").join(kinds.withColumnsRenamed({"node_id": "dst", "type_id": "dst_type"}), "dst")
    relations = of.select("rel_id", F.concat(F.lit("r"), "rel_id").alias("name"), "src_type", "dst_type")
    return HeteroGraph(nodes, edges, relations, t["nodes"].where("x is not null and size(x) > 0").select("node_id", "type_id", "x"))
