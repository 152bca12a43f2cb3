"""Layered scores of predicted against gold graphs, given a matching of propositions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from disputa.functions import vocab
from disputa.functions.graph import distance_band, family, precision_recall
from disputa.operators.fold import illocutions, locution_order, relations
from disputa.operators.passes import both_sides, match_in_passes

KEY = "graph_id"


def instances(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, inst, type, src, dst): relations by premise, numbered in input order."""
    each = relations(nodes, edges).select(KEY, "pos", "snode_id", "type", F.posexplode("src_ids").alias("k", "src"), F.col("dst_id").alias("dst"))
    return each.withColumn("inst", F.row_number().over(W.partitionBy(KEY).orderBy("pos", "snode_id", "k"))).select(KEY, "inst", "type", "src", "dst")


def relation_outcomes(pred: DataFrame, gold: DataFrame, matching: DataFrame) -> DataFrame:
    """(graph_id, inst, type, src, dst, outcome, gold_inst, gold_type) of predicted instances.

    Three passes: same pair and type, same pair, swapped pair. In the first two the i-th of one side takes the i-th of the
    other; in the last each in turn takes the first one left of its own type, else of any.
    """
    to = lambda end: matching.select(KEY, F.col("a").alias(end), F.col("b").alias(f"m_{end}"))
    p = pred.join(to("src"), [KEY, "src"], "left").join(to("dst"), [KEY, "dst"], "left")
    ends = lambda a, b: F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.concat_ws("\x1e", a, b))
    shape = lambda df, a, b: df.select(KEY, F.col("inst").cast("long").alias("id"), F.col("inst").alias("pos"), "type", "src", "dst", ends(a, b).alias("ends"), ends(b, a).alias("turned"))
    rows = both_sides(shape(p, "m_src", "m_dst"), shape(gold, "src", "dst"))
    found = match_in_passes(rows, KEY, [("correct", False, True), ("mistyped", False, False)])
    mine = found.filter("side = 0").join(_turned(found), [KEY, "id"], "left")
    outcome = F.coalesce("outcome", F.when(F.col("t_partner").isNotNull(), "reversed"), F.lit("spurious"))
    return mine.select(KEY, F.col("id").alias("inst"), "type", "src", "dst", outcome.alias("outcome"), F.coalesce("partner", "t_partner").alias("gold_inst"), F.coalesce("partner_type", "t_type").alias("gold_type"))


def _turned(found: DataFrame) -> DataFrame:
    """(graph_id, id, t_partner, t_type) of what is left after the passes, each in turn taking a relation of the swapped pair. A pair of propositions is one row's arrays."""
    ends = F.when(F.col("side") == 1, F.col("turned")).otherwise(F.col("ends"))
    item = lambda side: F.sort_array(F.collect_list(F.when(F.col("side") == side, F.struct("id", "type"))))
    pairs = found.filter("outcome IS NULL").withColumn("_ends", ends).filter("_ends IS NOT NULL").groupBy(KEY, "_ends").agg(item(0).alias("mine"), item(1).alias("others")).filter("size(mine) > 0 AND size(others) > 0")
    begin = F.struct(F.col("others").alias("left"), F.array().cast("array<struct<id:bigint,t_partner:bigint,t_type:string>>").alias("out"))

    def take(state, x):
        pick = F.coalesce(F.get(F.filter(state["left"], lambda g: g["type"] == x["type"]), F.lit(0)), F.get(state["left"], F.lit(0)))
        taken = F.struct(x["id"].alias("id"), pick["id"].alias("t_partner"), pick["type"].alias("t_type"))
        return F.struct(F.filter(state["left"], lambda g: g["id"] != pick["id"]).alias("left"), F.when(pick.isNull(), state["out"]).otherwise(F.concat(state["out"], F.array(taken))).alias("out"))

    return pairs.select(KEY, F.explode(F.aggregate("mine", begin, take)["out"]).alias("x")).select(KEY, "x.*")


def relation_counts(outcomes: DataFrame, gold: DataFrame) -> DataFrame:
    """(graph_id, correct, mistyped, reversed, spurious, pred_total, gold_total)."""
    n = lambda name: F.count_if(F.col("outcome") == name).alias(name)
    counted = outcomes.groupBy(KEY).agg(*(n(x) for x in ("correct", "mistyped", "reversed", "spurious")), F.count("*").alias("pred_total"))
    return counted.join(gold.groupBy(KEY).agg(F.count("*").alias("gold_total")), KEY, "full_outer").fillna(0)


def relation_scores(counts: DataFrame) -> DataFrame:
    """Typed, untyped (direction only) and undirected precision, recall and f1."""
    p, g, c, m, r = (F.col(x) for x in ("pred_total", "gold_total", "correct", "mistyped", "reversed"))
    return counts.select("*", *precision_recall(c, p, g, "typed_"), *precision_recall(c + m, p, g, "untyped_"), *precision_recall(c + m + r, p, g, "undirected_"))


def _banded(inst: DataFrame, order: DataFrame) -> DataFrame:
    at = lambda end: order.select(KEY, F.col("node_id").alias(end), F.col("idx").alias(f"i_{end}"))
    return inst.join(at("src"), [KEY, "src"]).join(at("dst"), [KEY, "dst"]).withColumn("band", distance_band(F.abs(F.col("i_src") - F.col("i_dst"))))


def distance_buckets(outcomes: DataFrame, gold: DataFrame, pred_order: DataFrame, gold_order: DataFrame) -> DataFrame:
    """(graph_id, band, pred_total, gold_total, tp_pred, tp_gold): hits by the predicted and by the gold band; all bands are there."""
    p = _banded(outcomes, pred_order).groupBy(KEY, "band").agg(F.count("*").alias("pred_total"), F.count_if(F.col("outcome") == "correct").alias("tp_pred"))
    hit = outcomes.filter("outcome = 'correct'").select(KEY, F.col("gold_inst").alias("inst"), F.lit(1).alias("hit"))
    g = _banded(gold, gold_order).join(hit, [KEY, "inst"], "left").groupBy(KEY, "band").agg(F.count("*").alias("gold_total"), F.count("hit").alias("tp_gold"))
    bands = outcomes.select(KEY).unionByName(gold.select(KEY)).distinct().select(KEY, F.explode(F.array(*(F.lit(b) for b in vocab.BANDS))).alias("band"))
    return bands.join(p, [KEY, "band"], "left").join(g, [KEY, "band"], "left").fillna(0)


def type_confusion(outcomes: DataFrame) -> DataFrame:
    """(pred_type, gold_type, n) over matched instances of the same direction."""
    return outcomes.filter("outcome IN ('correct', 'mistyped')").groupBy(F.col("type").alias("pred_type"), "gold_type").agg(F.count("*").alias("n"))


def evidence(outcomes: DataFrame, gold: DataFrame, limit: int = 8) -> DataFrame:
    """(graph_id, list, rank, src, dst, type): the first ``limit`` instances of each outcome, and of gold ones that were missed."""
    missed = gold.join(outcomes.filter("gold_inst IS NOT NULL").select(KEY, F.col("gold_inst").alias("inst")), [KEY, "inst"], "left_anti")
    both = outcomes.select(KEY, F.col("outcome").alias("list"), "inst", "src", "dst", "type").unionByName(missed.select(KEY, F.lit("missed").alias("list"), "inst", "src", "dst", "type"))
    return both.withColumn("rank", F.row_number().over(W.partitionBy(KEY, "list").orderBy("inst"))).filter(F.col("rank") <= limit).select(KEY, "list", F.col("rank").cast("long").alias("rank"), "src", "dst", "type")


def pair_similarity(outcomes: DataFrame, gold: DataFrame, pred_cos: DataFrame, gold_cos: DataFrame) -> DataFrame:
    """(graph_id, list, n, mean_cos) of the ends of correct, spurious and missed relations; cosines: (graph_id, src, dst, cos)."""
    kept = outcomes.filter("outcome IN ('correct', 'spurious')").select(KEY, F.col("outcome").alias("list"), "src", "dst").join(pred_cos, [KEY, "src", "dst"], "left")
    missed = gold.join(outcomes.filter("gold_inst IS NOT NULL").select(KEY, F.col("gold_inst").alias("inst")), [KEY, "inst"], "left_anti").select(KEY, F.lit("missed").alias("list"), "src", "dst").join(gold_cos, [KEY, "src", "dst"], "left")
    return kept.unionByName(missed).groupBy(KEY, "list").agg(F.count("*").alias("n"), F.avg(F.coalesce("cos", F.lit(0.0))).alias("mean_cos"))


def best_and_worst(matching: DataFrame, k: int) -> DataFrame:
    """(graph_id, list, rank, a, b, cos): k best pairs by cosine, then k worst of the others; none are worst among k or fewer."""
    w = W.partitionBy(KEY)
    ranked = matching.withColumn("up", F.row_number().over(w.orderBy(F.desc("cos"), "a"))).withColumn("down", F.row_number().over(w.orderBy("cos", F.desc("a"))))
    best = ranked.filter(F.col("up") <= k).select(KEY, F.lit("best").alias("list"), F.col("up").cast("long").alias("rank"), "a", "b", "cos")
    worst = ranked.filter((F.col("down") <= k) & (F.col("up") > k)).select(KEY, F.lit("worst").alias("list"), F.col("down").cast("long").alias("rank"), "a", "b", "cos")
    return best.unionByName(worst)


def forces(nodes: DataFrame, edges: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """(graph_id, node_id, force): of each proposition, by its earliest locution, then by input."""
    order = locution_order(nodes, edges) if order is None else order
    spoken = illocutions(nodes, edges).filter("anchor_type = 'L' AND target_type = 'I'").join(order.select(KEY, F.col("node_id").alias("anchor_id"), "idx"), [KEY, "anchor_id"])
    return spoken.groupBy(KEY, F.col("target_id").alias("node_id")).agg(F.min_by("force", F.struct("idx", "pos")).alias("force"))


def force_pairs(pred: DataFrame, gold: DataFrame, matching: DataFrame) -> DataFrame:
    """(graph_id, pred_force, gold_force, exact, same_family) of matched propositions with forces on both sides."""
    p, g = pred.select(KEY, F.col("node_id").alias("a"), F.col("force").alias("pred_force")), gold.select(KEY, F.col("node_id").alias("b"), F.col("force").alias("gold_force"))
    both = matching.join(p, [KEY, "a"]).join(g, [KEY, "b"])
    return both.select(KEY, "pred_force", "gold_force", (F.col("pred_force") == F.col("gold_force")).alias("exact"), (family(F.col("pred_force")) == family(F.col("gold_force"))).alias("same_family"))


def alignment(matching: DataFrame, sizes: DataFrame, above: DataFrame, threshold: float = vocab.MIN_SIMILARITY) -> DataFrame:
    """(graph_id, aligned, above_threshold, mean_cos, count_ratio, tp, precision, recall, f1).

    matching: (graph_id, a, b, cos); sizes: (graph_id, n_pred, n_gold); above: (graph_id, threshold, tp) of ``matched_above``.
    """
    m = matching.groupBy(KEY).agg(F.count("*").alias("aligned"), F.count_if(F.col("cos") >= threshold).alias("above_threshold"), F.avg("cos").alias("mean_cos"))
    t = above.filter(F.col("threshold") == threshold).select(KEY, "tp")
    out = sizes.join(m, KEY, "left").join(t, KEY, "left").fillna(0)
    return out.select(KEY, "aligned", "above_threshold", "mean_cos", F.when(F.col("n_gold") > 0, F.col("n_pred") / F.col("n_gold")).otherwise(0.0).alias("count_ratio"), "tp", *precision_recall(F.col("tp"), F.col("n_pred"), F.col("n_gold")))


def threshold_curve(sizes: DataFrame, above: DataFrame) -> DataFrame:
    """(graph_id, threshold, tp, precision, recall, f1)."""
    return sizes.join(above, KEY).select(KEY, "threshold", "tp", *precision_recall(F.col("tp"), F.col("n_pred"), F.col("n_gold")))
