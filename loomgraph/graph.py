"""The heterogeneous graph: four DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Global id = type_id * BASE + key.
BASE = 10_000_000_000
TYPES = ("customer", "orders", "part", "supplier", "nation", "region", "user", "event_type", "vec", "document")
RELATIONS = ((0, "customer__places__orders", 0, 1), (1, "orders__placed_by__customer", 1, 0), (2, "orders__contains__part", 1, 2), (3, "part__in__orders", 2, 1), (4, "part__from__supplier", 2, 3), (5, "supplier__supplies__part", 3, 2), (6, "customer__in__nation", 0, 4), (7, "supplier__in__nation", 3, 4), (8, "nation__in__region", 4, 5), (9, "orders__next__orders", 1, 1), (10, "user__did__event_type", 6, 7))


@dataclass
class HeteroGraph:
    """nodes(node_id, type_id, label, part_id), edges(rel_id, src, dst, w), relations(rel_id, name, src_type, dst_type),
    features(node_id, type_id, x). label -1: unlabelled. Ids need not be dense. turned: relations that hold the edges of another
    one turned round, as their source makes them."""

    nodes: DataFrame
    edges: DataFrame
    relations: DataFrame
    features: DataFrame
    turned: dict[int, int] = field(default_factory=dict)

    def nodes_of_type(self, type_id: int) -> DataFrame:
        return self.nodes.where(F.col("type_id") == type_id)

    def type_local_index(self) -> DataFrame:
        """(node_id, type_id, local_id): the position among the ids of a type, by a range count so that no type is one task."""
        return ranked(self.nodes.select("node_id", "type_id"), ["type_id"], "node_id").withColumnRenamed("rank", "local_id").withColumn("local_id", F.col("local_id") - 1)

    def induced(self, keep: DataFrame) -> HeteroGraph:
        """The graph on the nodes of keep(node_id)."""
        k = keep.select("node_id").distinct()
        ends = self.edges.join(k.withColumnRenamed("node_id", "src"), "src", "left_semi").join(k.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
        return HeteroGraph(self.nodes.join(k, "node_id", "left_semi"), ends.select("rel_id", "src", "dst", "w"), self.relations, self.features.join(k, "node_id", "left_semi"))

    def violations(self) -> DataFrame:
        """(rule, n): how many rows break each rule of the schema."""
        n, e, r = self.nodes, self.edges, self.relations
        ends = e.join(F.broadcast(r.select("rel_id", "src_type", "dst_type")), "rel_id", "left")
        s = n.select(F.col("node_id").alias("src"), F.col("type_id").alias("st"))
        d = n.select(F.col("node_id").alias("dst"), F.col("type_id").alias("dt"))
        checked = ends.join(s, "src", "left").join(d, "dst", "left")
        count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
        of_edges = checked.agg(count(F.col("src_type").isNull()).alias("unknown_relation"), count(F.col("st").isNull()).alias("dangling_src"), count(F.col("dt").isNull()).alias("dangling_dst"), count(F.col("st") != F.col("src_type")).alias("src_type"), count(F.col("dt") != F.col("dst_type")).alias("dst_type"), count(F.col("w").isNull() | (F.col("w") < 0)).alias("weight"))
        of_nodes = n.groupBy("node_id").agg(F.count(F.lit(1)).alias("c"), F.min("type_id").alias("t")).agg(count(F.col("c") > 1).alias("duplicate_node"), count(F.col("t") < 0).alias("negative_type"))
        unpivot = lambda df: df.unpivot([], df.columns, "rule", "n")
        return unpivot(of_edges).unionByName(unpivot(of_nodes))


def ranges(df: DataFrame) -> int:
    """Into how many ranges large groups are cut: some for each shuffle partition, so that they grow with the cluster."""
    return max(2, min(4096, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def in_range(bounds: str, value) -> Column:
    """How many of the sorted numbers in the array column `bounds` lie below a value, by binary search."""
    steps = F.array(*[F.lit(1 << k) for k in range(12, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get(F.col(bounds), at + s - 1) < value, at + s).otherwise(at))


def ranked(df: DataFrame, by: list[str], order: str | list[str], buckets: int | None = None, descending: bool = False) -> DataFrame:
    """df with `rank`, the 1-based place by `order` (the first column a number, the others break ties) within `by`.

    Ranks are taken within ranges between quantiles of the first column and offset by the sizes of the ranges before, so a
    large group is spread over tasks. Only quantiles and range sizes, some for each group and range, are broadcast."""
    order = [order] if isinstance(order, str) else order
    n = buckets or ranges(df)
    value = -F.col(order[0]) if descending else F.col(order[0])
    bounds = df.groupBy(*by).agg(F.array_distinct(F.percentile_approx(value, [k / n for k in range(1, n)], 8 * n)).alias("__q"))
    placed = df.join(F.broadcast(bounds), by).withColumn("__b", in_range("__q", value)).drop("__q")
    sizes = placed.groupBy(*by, "__b").count()
    before = sizes.withColumn("__before", F.coalesce(F.sum("count").over(W.partitionBy(*by).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("count")
    place = F.row_number().over(W.partitionBy(*by, "__b").orderBy(value, *order[1:]))
    return placed.withColumn("__r", place).join(F.broadcast(before), [*by, "__b"]).withColumn("rank", (F.col("__r") + F.col("__before")).cast("long")).drop("__b", "__r", "__before")


def neighbours(df: DataFrame, by: list[str], order: str | list[str], k: int, keep: list[str] | None = None) -> DataFrame:
    """(by, i, j, and of each column c in keep c_i and c_j): nodes up to k places apart within `by`. Ranks meet by an
    equality join, so no group is one task."""
    keep = keep or []
    placed = ranked(df, by, order)
    a = placed.select(*by, F.col("node_id").alias("i"), *[F.col(c).alias(f"{c}_i") for c in keep], "rank", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("__d"))
    b = placed.select(*by, F.col("node_id").alias("j"), *[F.col(c).alias(f"{c}_j") for c in keep], F.col("rank").alias("__at"))
    return a.withColumn("__at", F.col("rank") + F.col("__d")).join(b, [*by, "__at"]).drop("__at", "__d", "rank")


def relation_table(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"({i}, '{n}', {s}, {d})" for i, n, s, d in RELATIONS)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(rel_id, name, src_type, dst_type)")


def from_tables(spark: SparkSession, sf_dir: str) -> HeteroGraph:
    """The canonical graph over the star-schema, event, embedding and document tables."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    gid = lambda type_id, key: (F.lit(type_id * BASE) + F.col(key).cast("long"))

    def codes(df: DataFrame, column: str) -> DataFrame:
        """Codes of the few distinct values of a category column."""
        return df.select(column).distinct().select(column, (F.row_number().over(W.orderBy(column)) - 1).alias("code"))

    customer, orders, lineitem, events = t("customer"), t("orders"), t("lineitem"), t("events")
    segments, priorities, kinds = codes(customer, "c_mktsegment"), codes(orders, "o_orderpriority"), codes(events, "event_type")
    quality = t("labels").groupBy("doc_id").agg(F.max("quality").alias("label"))

    def node(df: DataFrame, type_id: int, key: str, label) -> DataFrame:
        return df.select(gid(type_id, key).alias("node_id"), F.lit(type_id).alias("type_id"), label.cast("int").alias("label"), (F.col(key) % 4).cast("int").alias("part_id"))

    none = F.lit(-1)
    nodes = [
        node(customer.join(F.broadcast(segments), "c_mktsegment"), 0, "c_custkey", F.col("code")),
        node(orders.join(F.broadcast(priorities), "o_orderpriority"), 1, "o_orderkey", F.col("code")),
        node(t("part"), 2, "p_partkey", none),
        node(t("supplier"), 3, "s_suppkey", none),
        node(t("nation"), 4, "n_nationkey", none),
        node(t("region"), 5, "r_regionkey", none),
        node(events.select("user_id").distinct(), 6, "user_id", none),
        node(kinds, 7, "code", none),
        node(t("embeddings"), 8, "vec_id", F.col("label")),
        node(t("documents").join(quality, "doc_id", "left"), 9, "doc_id", F.coalesce("label", none)),
    ]
    all_nodes = nodes[0]
    for n in nodes[1:]:
        all_nodes = all_nodes.unionByName(n)

    def edge(df: DataFrame, rel: int, src, dst, w=None) -> DataFrame:
        return df.select(F.lit(rel).alias("rel_id"), src.alias("src"), dst.alias("dst"), (F.lit(1.0) if w is None else w.cast("double")).alias("w"))

    places = orders.select(gid(0, "o_custkey").alias("a"), gid(1, "o_orderkey").alias("b"))
    contains = lineitem.groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").alias("w")).select(gid(1, "l_orderkey").alias("a"), gid(2, "l_partkey").alias("b"), "w")
    supplied = lineitem.groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("w")).select(gid(2, "l_partkey").alias("a"), gid(3, "l_suppkey").alias("b"), "w")
    following = orders.withColumn("nxt", F.lead("o_orderkey").over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))).where("nxt is not null")
    did = events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("w")).join(F.broadcast(kinds), "event_type")
    a, b, w = F.col("a"), F.col("b"), F.col("w")
    edges = [edge(places, 0, a, b), edge(places, 1, b, a), edge(contains, 2, a, b, w), edge(contains, 3, b, a, w), edge(supplied, 4, a, b, w), edge(supplied, 5, b, a, w)]
    edges += [edge(customer, 6, gid(0, "c_custkey"), gid(4, "c_nationkey")), edge(t("supplier"), 7, gid(3, "s_suppkey"), gid(4, "s_nationkey")), edge(t("nation"), 8, gid(4, "n_nationkey"), gid(5, "n_regionkey"))]
    edges += [edge(following, 9, gid(1, "o_orderkey"), gid(1, "nxt")), edge(did, 10, gid(6, "user_id"), gid(7, "code"), w)]
    all_edges = edges[0]
    for e in edges[1:]:
        all_edges = all_edges.unionByName(e)

    def feature(df: DataFrame, type_id: int, key: str, *xs) -> DataFrame:
        x = xs[0].cast("array<double>") if type_id == 8 else F.array(*[c.cast("double") for c in xs])
        return df.select(gid(type_id, key).alias("node_id"), F.lit(type_id).alias("type_id"), x.alias("x"))

    features = [
        feature(customer, 0, "c_custkey", F.col("c_acctbal") / 10000, F.col("c_nationkey") / 25),
        feature(orders, 1, "o_orderkey", F.col("o_totalprice") / 100000),
        feature(t("part"), 2, "p_partkey", F.col("p_size") / 50, F.col("p_retailprice") / 1000),
        feature(t("supplier"), 3, "s_suppkey", F.col("s_acctbal") / 10000),
        feature(t("embeddings"), 8, "vec_id", F.col("embedding")),
        feature(t("documents"), 9, "doc_id", F.col("n_chars")),
    ]
    all_features = features[0]
    for f in features[1:]:
        all_features = all_features.unionByName(f)
    return HeteroGraph(all_nodes, all_edges, relation_table(spark), all_features, {1: 0, 3: 2, 5: 4})
