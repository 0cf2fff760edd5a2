"""Command line: python -m loomgraph.cli COMMAND ..."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from . import attach
from .config import load_config


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomgraph")
    sub = p.add_subparsers(dest="command", required=True)
    g = sub.add_parser("generate-synthetic", help="write a graph of users, items and tags")
    g.add_argument("output")
    g.add_argument("--users", type=int, default=1000)
    g.add_argument("--items", type=int, default=500)
    g.add_argument("--tags", type=int, default=100)
    g.add_argument("--seed", type=int, default=0)
    i = sub.add_parser("import-tables", help="write the graph over a folder of star-schema tables")
    i.add_argument("tables")
    i.add_argument("output")
    t = sub.add_parser("import-text", help="write the graph of a folder of node.dat, link.dat and label.dat")
    t.add_argument("text")
    t.add_argument("output")
    c = sub.add_parser("coarsen", help="all levels of a graph; goes on with a run that was interrupted")
    c.add_argument("graph")
    c.add_argument("output")
    c.add_argument("--config")
    d = sub.add_parser("diagnose", help="the reports of a run's levels")
    d.add_argument("output")
    s = sub.add_parser("summary", help="edges and weight of each relation")
    s.add_argument("graph")
    a = sub.add_parser("aggregate", help="the coarse graph of an assignment")
    a.add_argument("graph")
    a.add_argument("assignment")
    a.add_argument("output")
    e = sub.add_parser("export-text", help="write a graph as a text folder")
    e.add_argument("graph")
    e.add_argument("output")
    e.add_argument("--target", type=int, default=0)
    return p


def run(args: argparse.Namespace, spark: SparkSession) -> str:
    """What the command prints."""
    from . import plans, sources
    from .graph import HeteroGraph, from_tables
    from .operators import classify, coarsen

    if args.command == "generate-synthetic":
        graph = sources.synthetic_graph(spark, args.users, args.items, args.tags, args.seed)
        sources.save_graph(graph, args.output)
        return plans.describe(graph)
    if args.command == "import-tables":
        sources.save_graph(from_tables(spark, args.tables), args.output)
        return plans.describe(sources.load_graph(spark, args.output))
    if args.command == "import-text":
        sources.save_graph(sources.graph_of_text(spark, args.text), args.output)
        return plans.describe(sources.load_graph(spark, args.output))
    if args.command == "coarsen":
        levels = plans.coarsen(sources.load_graph(spark, args.graph), args.output, load_config(args.config))
        return json.dumps([json.loads(plans.describe(g)) for g in levels])
    if args.command == "diagnose":
        return json.dumps(plans.reports(spark, args.output), default=str)
    graph = sources.load_graph(spark, args.graph)
    if args.command == "summary":
        return json.dumps([r.asDict() for r in sources.summary(graph).orderBy("rel_id").collect()])
    if args.command == "aggregate":
        made: HeteroGraph = coarsen.coarse_graph(graph, spark.read.parquet(args.assignment))
        sources.save_graph(made, args.output)
        return plans.describe(made)
    splits = classify.random_split(graph.nodes_of_type(args.target))
    sources.write_text_graph(graph, args.output, splits.where("split = 'train'"), splits.where("split = 'test'"))
    return args.output


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    print(run(args, attach(SparkSession.builder.appName("loomgraph").getOrCreate())))


if __name__ == "__main__":
    main()
