"""Splits, classification metrics, calibration and ensembles over (node_id, label, scores)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import EPS, gaussian, mixed, settled
from ..graph import ranked


def softmax(scores: Column, temperature: float = 1.0) -> Column:
    top = F.array_max(scores)
    e = F.transform(scores, lambda s: F.exp((s - top) / temperature))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def argmax(scores: Column) -> Column:
    """The first place of the largest value."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def predicted(logits: DataFrame) -> DataFrame:
    return logits.where("label >= 0").select("node_id", "label", argmax(F.col("scores")).alias("pred"))


def confusion(pred: DataFrame) -> DataFrame:
    return pred.groupBy("label", "pred").agg(F.count(F.lit(1)).alias("n"))


def per_class(pred: DataFrame) -> DataFrame:
    """(label, support, precision, recall, f1), over classes of the truth or of a prediction."""
    one = F.lit(1)
    rows = pred.select(F.col("label").alias("c"), one.alias("t"), F.lit(0).alias("p"), (F.col("label") == F.col("pred")).cast("int").alias("h")).unionByName(pred.select(F.col("pred").alias("c"), F.lit(0).alias("t"), one.alias("p"), F.lit(0).alias("h")))
    s = rows.groupBy("c").agg(F.sum("t").alias("t"), F.sum("p").alias("p"), F.sum("h").alias("h"))
    div = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    h, p, t = F.col("h"), F.col("p"), F.col("t")
    return s.select(F.col("c").alias("label"), t.alias("support"), div(h, p).alias("precision"), div(h, t).alias("recall"), div(2 * h, p + t).alias("f1"))


def f1_scores(pred: DataFrame, present_only: bool = False) -> DataFrame:
    """(micro, macro): accuracy, and the mean F1 over the classes of truth and prediction, or only over those of the truth."""
    classes = per_class(pred)
    macro = (classes.where("support > 0") if present_only else classes).agg(F.avg("f1").alias("macro")).withColumn("k", F.lit(0))
    micro = pred.agg(F.avg((F.col("label") == F.col("pred")).cast("double")).alias("micro")).withColumn("k", F.lit(0))
    return micro.join(F.broadcast(macro), "k").select("micro", "macro")


def calibration(logits: DataFrame, bins: int = 10) -> DataFrame:
    """(ece, nll, brier): expected calibration error on the top probability, log loss and squared error."""
    p = logits.where("label >= 0").select("label", softmax(F.col("scores")).alias("p"))
    p = p.select("label", "p", F.array_max("p").alias("top"), argmax(F.col("p")).alias("pred"))
    rows = p.select("top", (F.col("label") == F.col("pred")).cast("double").alias("hit"), F.least(F.floor(F.col("top") * bins), F.lit(bins - 1)).alias("bin"), (-F.log(F.greatest(F.element_at("p", F.col("label") + 1), F.lit(EPS)))).alias("nll"), F.aggregate(F.transform("p", lambda v, i: (v - (i == F.col("label")).cast("double")) * (v - (i == F.col("label")).cast("double"))), F.lit(0.0), lambda a, b: a + b).alias("brier"))
    each = rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("top").alias("conf"), F.avg("hit").alias("acc"), F.sum("nll").alias("nll"), F.sum("brier").alias("brier"))
    n = F.sum("n")
    return each.agg((F.sum(F.col("n") * F.abs(F.col("conf") - F.col("acc"))) / n).alias("ece"), (F.sum("nll") / n).alias("nll"), (F.sum("brier") / n).alias("brier"))


def temperature_grid(logits: DataFrame, grid: list[float]) -> DataFrame:
    """(temperature, nll): the log loss for each temperature; the grid rides along in each row."""
    rows = logits.where("label >= 0").select("label", "scores", F.explode(F.array(*[F.lit(t) for t in grid])).alias("temperature"))
    top = F.array_max("scores")
    total = F.aggregate(F.transform("scores", lambda s: F.exp((s - top) / F.col("temperature"))), F.lit(0.0), lambda a, b: a + b)
    nll = F.log(total) - (F.element_at("scores", F.col("label") + 1) - top) / F.col("temperature")
    return rows.groupBy("temperature").agg(F.avg(nll).alias("nll"))


def bias_grid(logits: DataFrame, cls: int, grid: list[float]) -> DataFrame:
    """(bias, accuracy): accuracy with a bias added to one class."""
    rows = logits.where("label >= 0").select("label", "scores", F.explode(F.array(*[F.lit(t) for t in grid])).alias("bias"))
    shifted = F.transform("scores", lambda s, i: F.when(i == cls, s + F.col("bias")).otherwise(s))
    return rows.select("bias", "label", argmax(shifted).alias("pred")).groupBy("bias").agg(F.avg((F.col("label") == F.col("pred")).cast("double")).alias("accuracy"))


def ensemble_grid(a: DataFrame, b: DataFrame, grid: list[float]) -> DataFrame:
    """(weight, accuracy): accuracy of the mix weight * a + (1 - weight) * b of two score tables."""
    both = a.where("label >= 0").join(b.select("node_id", F.col("scores").alias("other")), "node_id").select("label", "scores", "other", F.explode(F.array(*[F.lit(t) for t in grid])).alias("weight"))
    mix = F.zip_with("scores", "other", lambda x, y: F.col("weight") * x + (1 - F.col("weight")) * y)
    mix = F.transform(mix, lambda v: F.round(v, 9))
    return both.select("weight", "label", argmax(mix).alias("pred")).groupBy("weight").agg(F.avg((F.col("label") == F.col("pred")).cast("double")).alias("accuracy"))



def stratified_split(nodes: DataFrame, train: float = 0.6, valid: float = 0.2, seed: int = 0) -> DataFrame:
    """(node_id, label, split): by hash order within each label, floor(n f) rows each and at least one for training."""
    rows = nodes.where("label >= 0").select("node_id", "label", mixed(F.col("node_id"), 0, seed).alias("h"))
    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    placed = ranked(rows, ["label"], ["h", "node_id"]).withColumnRenamed("rank", "r").join(F.broadcast(counts), "label")
    n_train = F.greatest(F.lit(1).cast("long"), F.floor(F.col("n") * train))
    n_valid = F.floor(F.col("n") * valid)
    split = F.when(F.col("r") <= n_train, "train").when(F.col("r") <= n_train + n_valid, "valid").otherwise("test")
    return placed.select("node_id", "label", split.alias("split"))


def label_projection(nodes: DataFrame, assignment: DataFrame, labels: DataFrame) -> DataFrame:
    """(node_id, label, pred): each labelled node with its cluster's label."""
    return nodes.where("label >= 0").join(assignment, "node_id").join(labels.withColumnRenamed("label", "pred"), "super_id").select("node_id", "label", "pred")


def curve_area(points: DataFrame) -> DataFrame:
    """(area): the trapezoid area under (x, y), over the range of x; y itself of one point."""
    w = W.partitionBy(F.lit(0)).orderBy("x")
    d = points.select("x", "y", (F.col("x") - F.lag("x").over(w)).alias("dx"), ((F.col("y") + F.lag("y").over(w)) / 2).alias("m"))
    span = F.max("x") - F.min("x")
    return d.agg(F.when(span > 0, F.sum(F.col("dx") * F.col("m")) / span).otherwise(F.max("y")).alias("area"))


def curve_summary(points: DataFrame) -> DataFrame:
    """(best, best_x, area) of a curve (x, y): the largest y, the first x where it stands, and the area."""
    best = points.agg(F.max(F.struct("y", (-F.col("x")).alias("nx"))).alias("m")).select(F.col("m.y").alias("best"), (-F.col("m.nx")).alias("best_x"))
    return best.join(F.broadcast(curve_area(points)))


def per_class_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """(label, precision, recall, f1): how much each changes from one prediction table to another; absent classes count as 0."""
    names = ("precision", "recall", "f1")
    a, b = per_class(before), per_class(after)
    both = a.select("label", *[F.col(n).alias(f"a_{n}") for n in names]).join(b.select("label", *[F.col(n).alias(f"b_{n}") for n in names]), "label", "full").na.fill(0.0)
    return both.select("label", *[(F.col(f"b_{n}") - F.col(f"a_{n}")).alias(n) for n in names])


def random_split(nodes: DataFrame, train: float = 0.6, seed: int = 0) -> DataFrame:
    """(node_id, split): round(n train) labelled nodes for training, at least one and not all, by a hash; the others for the test."""
    rows = nodes.where("label >= 0").select("node_id", mixed(F.col("node_id"), 2, seed).alias("h"))
    n = rows.count()
    k = max(1, round(n * train))
    k = n - 1 if k >= n > 1 else k
    first = rows.orderBy("h", "node_id").limit(k).select("node_id")
    return first.withColumn("split", F.lit("train")).unionByName(rows.join(first, "node_id", "left_anti").select("node_id", F.lit("test").alias("split")))


def three_way_split(nodes: DataFrame, train: float = 0.6, valid: float = 0.2, seed: int = 0) -> DataFrame:
    """(node_id, label, split): as stratified_split, but a label with two nodes or more keeps one out of training, and one with two
    left over has at least one for validation and one for the test."""
    rows = nodes.where("label >= 0").select("node_id", "label", "type_id", mixed(F.col("node_id"), 0, seed).alias("h"))
    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    placed = ranked(rows, ["label"], ["h", "node_id"]).join(F.broadcast(counts), "label")
    n = F.col("n")
    a = F.when(n == 1, 1).otherwise(F.least(F.greatest(F.lit(1), F.floor(n * train)), n - 1))
    left = n - a
    b = F.when((n > 1) & (left >= 2) & F.lit(valid > 0), F.least(F.greatest(F.lit(1), F.floor(n * valid)), left - 1)).otherwise(0)
    return placed.select("node_id", "label", F.when(F.col("rank") <= a, "train").when(F.col("rank") <= a + b, "valid").otherwise("test").alias("split"))


def calibration_split(valid: DataFrame, seed: int = 0) -> DataFrame:
    """(node_id, part): each label's nodes in two halves by a hash, `calibrate` the smaller one; nodes alone in their label are
    dealt out in turn. valid: (node_id, label)."""
    rows = valid.where("label >= 0").select("node_id", "label", mixed(F.col("node_id"), 3, seed).alias("h"))
    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    placed = ranked(rows, ["label"], ["h", "node_id"]).join(F.broadcast(counts), "label")
    # one row for each label that has a single node
    single = counts.where("n = 1").withColumn("turn", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("label")) % 2).select("label", "turn")
    part = F.when(F.col("n") == 1, F.col("turn") == 1).otherwise(F.col("rank") <= F.greatest(F.lit(1), F.floor(F.col("n") / 2)))
    return placed.join(F.broadcast(single), "label", "left").select("node_id", F.when(part, "calibrate").otherwise("select").alias("part"))


def grid_scores(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, accuracy, macro) of predictions (keys, label, pred): classes are those of truth or prediction."""
    one = F.lit(1)
    hit = (F.col("label") == F.col("pred")).cast("int")
    each = rows.select(*keys, F.col("label").alias("c"), one.alias("t"), F.lit(0).alias("p"), hit.alias("h")).unionByName(rows.select(*keys, F.col("pred").alias("c"), F.lit(0).alias("t"), one.alias("p"), F.lit(0).alias("h")))
    s = each.groupBy(*keys, "c").agg(F.sum("t").alias("t"), F.sum("p").alias("p"), F.sum("h").alias("h"))
    return s.groupBy(*keys).agg((F.sum("h") / F.sum("t")).alias("accuracy"), F.avg(2 * F.col("h") / (F.col("p") + F.col("t"))).alias("macro"))


def biases(classes: int, values: list[float]) -> list[list[float]]:
    """All combinations of up to four classes, else none and one class at a time."""
    import itertools

    if classes <= 4:
        return [list(c) for c in itertools.product(values, repeat=classes)]
    return [[0.0] * classes] + [[v if k == c else 0.0 for k in range(classes)] for c in range(classes) for v in values if abs(v) > EPS]


def choose_calibration(logits: DataFrame, temperatures: list[float], bias: list[list[float]], macro_floor: float | None = None) -> DataFrame:
    """(temperature, bias, accuracy, macro, ok): of the grid the best by (macro at least the floor, accuracy, macro, least
    |temperature - 1|, least norm of the bias). The grid rides along in each row and is aggregated before one row is chosen."""
    grid = F.array(*[F.struct(F.lit(t).alias("t"), F.array(*[F.lit(float(b)) for b in bs]).alias("b")) for t in temperatures for bs in bias])
    rows = logits.where("label >= 0").select("label", "scores", F.explode(grid).alias("g"))
    moved = F.zip_with(F.transform("scores", lambda s: s / F.col("g.t")), F.col("g.b"), lambda s, b: F.round(s + b, 9))
    scored = grid_scores(rows.select("g", "label", argmax(moved).alias("pred")), ["g"])
    ok = F.lit(True) if macro_floor is None else F.round("macro", 12) >= macro_floor
    far = F.sqrt(F.aggregate(F.col("g.b"), F.lit(0.0), lambda s, b: s + b * b))
    best = scored.withColumn("ok", ok).orderBy(F.desc("ok"), F.desc(F.round("accuracy", 12)), F.desc(F.round("macro", 12)), F.abs(F.col("g.t") - 1.0), far, "g.t", "g.b").limit(1)
    return best.select(F.col("g.t").alias("temperature"), F.col("g.b").alias("bias"), "accuracy", "macro", "ok")


def macro_constrained(logits: DataFrame, temperatures: list[float], bias: list[list[float]], slack: float = 0.005, baseline: float | None = None) -> DataFrame:
    """choose_calibration with a macro F1 at most `slack` below the baseline's, by default that of the scores as they are."""
    base = f1_scores(predicted(logits)).first().macro if baseline is None else baseline
    return choose_calibration(logits, temperatures, bias, round(base - slack, 12))


def apply_calibration(logits: DataFrame, temperature: float, bias: list[float]) -> DataFrame:
    b = F.array(*[F.lit(float(x)) for x in bias])
    return logits.withColumn("scores", F.zip_with(F.transform("scores", lambda s: s / temperature), b, lambda s, x: s + x))


def _together(sources: list[DataFrame]) -> DataFrame:
    """(node_id, label, s0, s1, ...): the scores of several tables."""
    out = sources[0].where("label >= 0").select("node_id", "label", F.col("scores").alias("s0"))
    for k, s in enumerate(sources[1:], 1):
        out = out.join(s.select("node_id", F.col("scores").alias(f"s{k}")), "node_id")
    return out


def _times(weight):
    return lambda v: v * weight


def _mixed_scores(n: int, weight) -> Column:
    """The sum over tables of weight(k) times their scores, rounded so that engines agree on ties."""
    total = F.transform("s0", lambda v: v * weight(0))
    for k in range(1, n):
        total = F.zip_with(total, F.transform(f"s{k}", _times(weight(k))), lambda a, v: a + v)
    return F.transform(total, lambda v: F.round(v, 9))


def weight_grid(n: int, step: float) -> list[list[float]]:
    """Weights of n tables that are multiples of the step and sum to 1."""
    m = round(1 / step)

    def parts(k, left):
        return [[left]] if k == 1 else [[a, *rest] for a in range(left + 1) for rest in parts(k - 1, left - a)]

    return [[x / m for x in p] for p in parts(n, m)]


def choose_convex(sources: list[DataFrame], step: float = 0.1, macro_floor: float = 0.0) -> DataFrame:
    """(weights, accuracy, macro, ok): the best global weights by (floor, accuracy, macro, least norm of the weights)."""
    n = len(sources)
    grid = F.array(*[F.array(*[F.lit(x) for x in w]) for w in weight_grid(n, step)])
    rows = _together(sources).select("*", F.explode(grid).alias("g"))
    scored = grid_scores(rows.select("g", "label", argmax(_mixed_scores(n, lambda k: F.get("g", F.lit(k)))).alias("pred")), ["g"])
    size = F.round(F.aggregate("g", F.lit(0.0), lambda s, v: s + v * v), 12)
    best = scored.withColumn("ok", F.round("macro", 12) >= macro_floor).orderBy(F.desc("ok"), F.desc(F.round("accuracy", 12)), F.desc(F.round("macro", 12)), size, "g").limit(1)
    return best.select(F.col("g").alias("weights"), "accuracy", "macro", "ok")


def choose_per_class(sources: list[DataFrame], classes: int, macro_floor: float = 0.0, most: int = 20_000) -> DataFrame:
    """(source_of, accuracy, macro, ok): for each class the table whose scores count, the best of all assignments by (floor,
    accuracy, macro, the assignment). More than `most` assignments are refused."""
    import itertools

    n = len(sources)
    if n**classes > most:
        raise ValueError(f"{n ** classes} assignments; choose_convex has none so many")
    grid = F.array(*[F.array(*[F.lit(x) for x in p]) for p in itertools.product(range(n), repeat=classes)])
    rows = _together(sources).select("*", F.explode(grid).alias("g"))
    every = F.array(*[F.col(f"s{k}") for k in range(n)])
    mine = F.transform("g", lambda k, c: F.round(F.get(F.get(every, k), c), 9))
    scored = grid_scores(rows.select("g", "label", argmax(mine).alias("pred")), ["g"])
    best = scored.withColumn("ok", F.round("macro", 12) >= macro_floor).orderBy(F.desc("ok"), F.desc(F.round("accuracy", 12)), F.desc(F.round("macro", 12)), "g").limit(1)
    return best.select(F.col("g").alias("source_of"), "accuracy", "macro", "ok")


def choose_gate(sources: list[DataFrame], thresholds: tuple[float, ...] = (0.5, 0.6, 0.7, 0.8, 0.9), macro_floor: float = 0.0) -> DataFrame:
    """(threshold, accuracy, macro, ok): the first table's answer where its top probability reaches the threshold, else that of the
    mean; the best threshold by (floor, accuracy, macro, nearness to 0.7)."""
    n = len(sources)
    rows = _together(sources).withColumn("sure", F.round(F.array_max(softmax(F.col("s0"))), 9)).select("*", F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("g"))
    alone = argmax(F.transform("s0", lambda v: F.round(v, 9)))
    pred = F.when(F.col("sure") >= F.col("g"), alone).otherwise(argmax(_mixed_scores(n, lambda k: F.lit(1.0 / n))))
    scored = grid_scores(rows.select("g", "label", pred.alias("pred")), ["g"])
    best = scored.withColumn("ok", F.round("macro", 12) >= macro_floor).orderBy(F.desc("ok"), F.desc(F.round("accuracy", 12)), F.desc(F.round("macro", 12)), F.abs(F.col("g") - 0.7), "g").limit(1)
    return best.select(F.col("g").alias("threshold"), "accuracy", "macro", "ok")


def distillation_loss(student: DataFrame, teacher: DataFrame, temperature: float = 1.0) -> DataFrame:
    """(kl): the mean divergence of the student's softmax from the teacher's at a temperature."""
    both = teacher.select("node_id", softmax(F.col("scores"), temperature).alias("t")).join(student.select("node_id", softmax(F.col("scores"), temperature).alias("s")), "node_id")
    each = F.zip_with("t", "s", lambda t, s: t * (F.log(F.greatest(t, F.lit(EPS))) - F.log(F.greatest(s, F.lit(EPS)))))
    return both.agg(F.avg(F.aggregate(each, F.lit(0.0), lambda a, b: a + b)).alias("kl"))


def fixed_teacher(features: DataFrame, classes: int, seed: int = 0) -> DataFrame:
    """(node_id, scores): features times a Gaussian matrix that the seed gives."""
    one = lambda k: F.aggregate(F.transform("x", lambda v, j: v * gaussian(j.cast("long"), k, seed)), F.lit(0.0), lambda s, v: s + v)
    return features.select("node_id", F.array(*[one(k) for k in range(classes)]).alias("scores"))


def task_aligned_cost(deltas: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """deltas (spec, feat, anchor, context, meta, teacher) with their weighted sum."""
    w = weights or {"spec": 0.25, "feat": 0.1, "anchor": 0.5, "context": 0.25, "meta": 0.25, "teacher": 0.1}
    total = F.lit(0.0)
    for c, x in w.items():
        total = total + x * F.coalesce(F.col(c), F.lit(0.0))
    return deltas.withColumn("cost", total)


def type_budgets(nodes: DataFrame, coarse_nodes: DataFrame, target: int) -> DataFrame:
    """(type_id, before, after, ratio, is_target)."""
    a = nodes.groupBy("type_id").agg(F.count(F.lit(1)).alias("before"))
    b = coarse_nodes.groupBy("type_id").agg(F.count(F.lit(1)).alias("after"))
    out = a.join(b, "type_id", "full").na.fill(0)
    return out.select("type_id", "before", "after", (F.col("after") / F.greatest("before", F.lit(1))).alias("ratio"), (F.col("type_id") == target).alias("is_target"))


def anchor_budget(targets: int, train: int, nodes: int, ratio: float, accuracy_first: bool = True, extra: float = 0.1) -> int:
    """How many target anchors: the training nodes and `extra` of all targets, or half the nodes that a ratio of the graph allows,
    but never fewer than the training nodes or more than the targets."""
    wanted = train + round(targets * extra) if accuracy_first else round(max(1, round(nodes * ratio)) * 0.5)
    return min(targets, max(train, wanted))


def anchor_coverage(edges: DataFrame, relations: DataFrame, target: int) -> DataFrame:
    """(target_id, node_id): the distinct neighbours of each target, over all relations at its type."""
    e = edges.join(F.broadcast(relations.select("rel_id", "src_type", "dst_type")), "rel_id")
    a = e.where(F.col("src_type") == target).select(F.col("src").alias("target_id"), F.col("dst").alias("node_id"))
    return a.unionByName(e.where(F.col("dst_type") == target).select(F.col("dst").alias("target_id"), F.col("src").alias("node_id"))).distinct()


def select_anchors(nodes: DataFrame, edges: DataFrame, relations: DataFrame, target: int, train: DataFrame, budget: int, per_round: int = 1, weights: dict[str, float] | None = None, settle=settled) -> DataFrame:
    """(node_id): the training targets, and by rounds those of the highest sum of confidence (weight at the node over the largest),
    margin (1 - 2 |confidence - 1/2|), share of neighbours that no pick has, distance to the nearest pick by place among the
    targets, and 1 / (1 + picks of its label), ties by id. per_round picks are made at once: 1 is the sequential choice, more trade
    its exactness for fewer passes over the targets; a round is a few joins, and only its picks are kept apart."""
    w = {"confidence": 0.35, "margin": 0.10, "coverage": 0.25, "diversity": 0.20, "balance": 0.10} | (weights or {})
    t = ranked(nodes.where(F.col("type_id") == target), ["type_id"], "node_id").select("node_id", "label", (F.col("rank") - 1).alias("place"))
    n = t.count()
    classes = max(2, t.agg(F.max("label")).first()[0] or 0) + 1
    ends = edges.select(F.col("src").alias("node_id"), "w").unionByName(edges.select(F.col("dst").alias("node_id"), "w"))
    mass = t.join(ends, "node_id", "left").groupBy("node_id", "label", "place").agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("m"))
    top = max(mass.agg(F.max("m")).first()[0] or 0.0, 1.0)
    cover = settle(anchor_coverage(edges, relations, target))
    rows = mass.select("node_id", "place", F.when(F.col("label") >= 0, F.col("label")).otherwise((F.col("node_id") % classes).cast("int")).alias("cls"), (F.col("m") / top).alias("conf"))
    rows = settle(rows)
    chosen = settle(rows.join(train.select("node_id").distinct(), "node_id", "left_semi"))
    have = chosen.count()
    want = min(n, max(budget, have))
    left = settle(rows.join(chosen.select("node_id"), "node_id", "left_anti"))
    largest = max(left.join(cover.select(F.col("target_id").alias("node_id"), F.col("node_id").alias("x")), "node_id").groupBy("node_id").count().agg(F.max("count")).first()[0] or 1, 1) if have < want else 1
    while have < want:
        covered = cover.join(chosen.select(F.col("node_id").alias("target_id")), "target_id", "left_semi").select("node_id").distinct()
        fresh = cover.join(covered, "node_id", "left_anti").groupBy(F.col("target_id").alias("node_id")).agg(F.count(F.lit(1)).alias("gain"))
        per_class = chosen.groupBy("cls").agg(F.count(F.lit(1)).alias("k"))
        # the picks are as many as the budget; each target finds the nearest on either side of its place
        picks = chosen.agg(F.array_sort(F.collect_list("place")).alias("picks"))
        score = left.join(fresh, "node_id", "left").join(F.broadcast(per_class), "cls", "left").join(F.broadcast(picks))
        near = F.aggregate("picks", F.lit(n).cast("long"), lambda a, p: F.least(a, F.abs(p - F.col("place"))))
        gap = F.when(F.size("picks") > 0, near / max(n - 1, 1)).otherwise(0.0)
        total = w["confidence"] * F.col("conf") + w["margin"] * (1 - F.abs(F.col("conf") - 0.5) * 2) + w["coverage"] * F.coalesce("gain", F.lit(0)) / largest + w["diversity"] * gap + w["balance"] / (1 + F.coalesce("k", F.lit(0)))
        step = min(per_round, want - have)
        best = settle(score.select("node_id", "place", "cls", "conf", F.round(total, 9).alias("s")).orderBy(F.desc("s"), "node_id").limit(step).drop("s"))
        chosen = settle(chosen.unionByName(best.select(chosen.columns)))
        left = settle(left.join(best.select("node_id"), "node_id", "left_anti"))
        have += step
    return chosen.select("node_id")
