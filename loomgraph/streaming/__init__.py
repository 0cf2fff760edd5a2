"""Streams: edges and degrees from events, and a running mutual-best state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_edges(events: DataFrame, late: str = "1 day", window: str = "1 day") -> DataFrame:
    """(window, user_id, event_type, w): edge weights of an event stream by window, with a watermark for late rows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "user_id", "event_type").agg(F.count(F.lit(1)).alias("w"))


def event_degrees(events: DataFrame, late: str = "1 day", window: str = "1 day") -> DataFrame:
    """(window, node, side, degree): how many events each user and each kind has in a window."""
    ends = events.select("ts", F.explode(F.array(F.struct(F.col("user_id").cast("string").alias("node"), F.lit("user").alias("side")), F.struct(F.col("event_type").alias("node"), F.lit("event_type").alias("side")))).alias("e"))
    return ends.select("ts", "e.node", "e.side").withWatermark("ts", late).groupBy(F.window("ts", window), "node", "side").agg(F.count(F.lit(1)).alias("degree"))


def _best(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = [f.sort_values(["cost", "other"]).iloc[0] for f in frames if len(f)]
    found = [(float(r["cost"]), int(r["other"])) for r in rows] + ([state.get] if state.exists else [])
    cost, other = min(tuple(x) for x in found)
    state.update((cost, other))
    yield pd.DataFrame({"node": [key[0]], "other": [other], "cost": [cost]})


def running_best(pairs: DataFrame) -> DataFrame:
    """(node, other, cost): each node's best pair by (cost, other) so far, from a stream of pairs (i, j, cost)."""
    ends = pairs.select(F.explode(F.array(F.struct(F.col("i").alias("node"), F.col("j").alias("other")), F.struct(F.col("j").alias("node"), F.col("i").alias("other")))).alias("e"), "cost").select("e.node", "e.other", "cost")
    return ends.groupBy("node").applyInPandasWithState(_best, "node long, other long, cost double", "cost double, other long", "update", GroupStateTimeout.NoTimeout)


def mutual_of(best: DataFrame) -> DataFrame:
    """(i, j, cost) of the latest state of running_best: nodes that are each other's best."""
    back = best.select(F.col("node").alias("other"), F.col("other").alias("node"))
    return best.join(back, ["node", "other"]).where("node < other").select(F.col("node").alias("i"), F.col("other").alias("j"), "cost")


def pair_blocks(pairs: DataFrame, size: int) -> DataFrame:
    """pairs with `block`, a number below which a block holds about `size` of them, by a hash of the pair: what foreachBatch or
    a partitioned write hands on at once."""
    n = max(1, -(-pairs.count() // size))
    return pairs.withColumn("block", F.pmod(F.xxhash64("i", "j"), F.lit(n)).cast("int"))
