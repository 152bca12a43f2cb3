"""Typed edges, normalisation, metamodel checks and folded views of argument graphs.

Graphs are two DataFrames, nodes(graph_id, pos, node_id, type, text, scheme, speaker, timestamp, confidence) and
edges(graph_id, pos, from_id, to_id). ``pos`` carries input order, which decides what "first" means. Everything is keyed
by graph_id, so all steps shuffle on it or on (graph_id, id) alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from disputa.functions import vocab
from disputa.functions.graph import allowed_edge, edge_kind, is_relation, relation_kind


def index(nodes: DataFrame) -> DataFrame:
    """One row for each id: the last of repeated ids wins."""
    return nodes.groupBy("graph_id", "node_id").agg(F.max_by("type", "pos").alias("type"), F.max_by("scheme", "pos").alias("scheme"), F.max_by("text", "pos").alias("text"))


def typed_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """edges with from_type, to_type, from_scheme, to_scheme; types are null for missing ends."""
    by = index(nodes)
    side = lambda s: by.select("graph_id", F.col("node_id").alias(f"{s}_id"), F.col("type").alias(f"{s}_type"), F.col("scheme").alias(f"{s}_scheme"))
    return edges.select("graph_id", "pos", "from_id", "to_id").join(side("from"), ["graph_id", "from_id"], "left").join(side("to"), ["graph_id", "to_id"], "left")


def normalize(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keeps the first of allowed, distinct, non-loop edges, and nodes with an edge; trims texts."""
    typed = typed_edges(nodes, edges).filter(allowed_edge(F.col("from_type"), F.col("to_type")) & (F.col("from_id") != F.col("to_id")))
    kept = typed.groupBy("graph_id", "from_id", "to_id").agg(F.min("pos").alias("pos")).select("graph_id", "pos", "from_id", "to_id")
    ends = kept.select("graph_id", F.explode(F.array("from_id", "to_id")).alias("node_id")).distinct()
    return nodes.join(ends, ["graph_id", "node_id"], "left_semi").withColumn("text", F.trim("text")), kept


def normalize_report(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, dropped_edges, dropped_isolated_l, dropped_other, dropped_node_ids, violations)."""
    new_nodes, new_edges = normalize(nodes, edges)
    count = lambda df, name: df.groupBy("graph_id").agg(F.count("*").alias(name))
    gone = nodes.join(new_nodes.select("graph_id", "node_id"), ["graph_id", "node_id"], "left_anti").groupBy("graph_id").agg(
        F.count_if(F.col("type") == "L").alias("dropped_isolated_l"), F.count_if(F.col("type") != "L").alias("dropped_other"), F.array_join(F.array_sort(F.collect_list("node_id")), ",").alias("dropped_node_ids"))
    out = nodes.select("graph_id").distinct()
    for part in (count(edges, "before"), count(new_edges, "after"), gone, count(violations(new_nodes, new_edges), "violations")):
        out = out.join(part, "graph_id", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return out.select("graph_id", (n("before") - n("after")).alias("dropped_edges"), *(n(c).alias(c) for c in ("dropped_isolated_l", "dropped_other")), F.coalesce("dropped_node_ids", F.lit("")).alias("dropped_node_ids"), n("violations").alias("violations"))


def violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, node_id, rule), a row for each violation of rules R1 to R10.

    Neighbour counts of all nodes come from one aggregate by each end; every rule is then a filter over them.
    """
    typed = typed_edges(nodes, edges)
    rel = lambda c: is_relation(F.col(c))
    into = typed.groupBy("graph_id", F.col("to_id").alias("node_id")).agg(
        F.count_if(F.col("from_type") == "I").alias("in_i"), F.count_if(F.col("from_type") == "L").alias("in_l"), F.count_if(F.col("from_type").isin("L", "TA")).alias("in_anchor"))
    content = (F.col("to_type") == "I") | rel("to_type")
    out_of = typed.groupBy("graph_id", F.col("from_id").alias("node_id")).agg(
        F.count_if(F.col("to_type") == "I").alias("out_i"), F.count_if(content).alias("out_content"), F.count_if(F.col("to_type") == "L").alias("out_l"),
        F.count_if(~F.coalesce(F.col("to_type").isin("YA", "TA"), F.lit(False))).alias("out_not_ya_ta"), F.max_by(F.when(content, F.col("to_id")), F.when(content, F.col("pos"))).alias("last_content"))
    counted = nodes.select("graph_id", "node_id", "type", "scheme").join(into, ["graph_id", "node_id"], "left").join(out_of, ["graph_id", "node_id"], "left").fillna(0)
    loops = typed.select("graph_id", F.col("to_id").alias("node_id"), F.col("from_id").alias("last_content")).groupBy("graph_id", "node_id", "last_content").agg(F.count("*").alias("loops"))
    counted = counted.join(loops, ["graph_id", "node_id", "last_content"], "left")
    t = F.col("type")
    rule = F.when(t == "RA", "R2").when(t == "CA", "R3").otherwise("R4")
    times = lambda n, name: F.when(n > 0, F.array_repeat(F.lit(name) if isinstance(name, str) else name, n.cast("int"))).otherwise(F.array().cast("array<string>"))
    once = lambda c, name: times(F.when(c, 1).otherwise(0), name)
    found = F.concat(
        times(F.when(t == "I", F.col("out_i")).otherwise(0), "R1"),
        once(rel("type") & ((F.col("in_i") == 0) | (t != "RA") & (F.col("in_i") != 1)), rule),
        once(rel("type") & (F.col("out_content") != 1), rule),
        times(F.when(rel("type"), F.coalesce("loops", F.lit(0))).otherwise(0), "R10"),
        once((t == "YA") & (F.col("in_anchor") != 1), "R5"),
        once((t == "YA") & (F.col("out_content") != 1), "R5"),
        once((t == "YA") & ~F.coalesce(F.col("scheme").isin(vocab.FORCES), F.lit(False)), "R8"),
        once((t == "TA") & ((F.col("in_l") != 1) | (F.col("out_l") != 1)), "R6"),
        times(F.when(t == "L", F.col("out_not_ya_ta")).otherwise(0), "R7"),
        once(~t.isin(vocab.NODE_TYPES), "R9"),
    )
    by_node = counted.select("graph_id", "node_id", F.explode(found).alias("rule"))
    repeated = nodes.groupBy("graph_id", "node_id").agg(F.count("*").alias("n")).filter("n > 1").select("graph_id", "node_id", F.explode(F.array_repeat(F.lit("R9"), (F.col("n") - 1).cast("int"))).alias("rule"))
    missing = typed.select("graph_id", F.explode(F.array(F.when(F.col("from_type").isNull(), F.col("from_id")), F.when(F.col("to_type").isNull(), F.col("to_id")))).alias("node_id")).filter("node_id IS NOT NULL").withColumn("rule", F.lit("R9"))
    return by_node.unionByName(repeated).unionByName(missing)


def labeled_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, pos, from_id, to_id, kind) of edges that have a kind."""
    return typed_edges(nodes, edges).select("graph_id", "pos", "from_id", "to_id", edge_kind(F.col("from_type"), F.col("to_type")).alias("kind")).filter("kind IS NOT NULL")


def relations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, pos, snode_id, type, src_ids, dst_id, force): relation nodes with all premises and the first conclusion."""
    typed = typed_edges(nodes, edges)
    into = typed.filter(is_relation(F.col("to_type"))).groupBy("graph_id", F.col("to_id").alias("snode_id")).agg(
        F.array_sort(F.collect_list(F.when(F.col("from_type") == "I", F.col("from_id")))).alias("src_ids"),
        F.min_by("from_scheme", F.when(F.col("from_type") == "YA", F.col("pos"))).alias("_first"),
        F.min(F.when(F.col("from_type") == "YA", F.struct("pos", "from_scheme"))).alias("ya"))
    out_of = typed.filter(is_relation(F.col("from_type")) & (F.col("to_type") == "I")).groupBy("graph_id", F.col("from_id").alias("snode_id")).agg(F.min_by("to_id", "pos").alias("dst_id"))
    snodes = nodes.filter(is_relation(F.col("type"))).select("graph_id", "pos", F.col("node_id").alias("snode_id"), "type", "confidence")
    return snodes.join(into.filter(F.size("src_ids") > 0), ["graph_id", "snode_id"]).join(out_of, ["graph_id", "snode_id"]).select("graph_id", "pos", "snode_id", "type", "confidence", "src_ids", "dst_id", F.coalesce("ya.from_scheme", F.lit("")).alias("force"))


def relation_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, pos, from_id, to_id, kind), an edge for each premise of a relation."""
    return relations(nodes, edges).select("graph_id", "pos", F.explode("src_ids").alias("from_id"), F.col("dst_id").alias("to_id"), relation_kind(F.col("type")).alias("kind"))


def illocutions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, pos, ya_id, anchor_id, anchor_type, target_id, target_type, force): the anchor may be missing."""
    typed = typed_edges(nodes, edges)
    anchor = typed.filter((F.col("to_type") == "YA") & F.col("from_type").isin("L", "TA")).groupBy("graph_id", F.col("to_id").alias("ya_id")).agg(F.min(F.struct("pos", "from_id", "from_type")).alias("a"))
    target = typed.filter((F.col("from_type") == "YA") & ((F.col("to_type") == "I") | is_relation(F.col("to_type")))).groupBy("graph_id", F.col("from_id").alias("ya_id")).agg(F.min(F.struct("pos", "to_id", "to_type")).alias("t"))
    yas = nodes.filter("type = 'YA'").select("graph_id", "pos", F.col("node_id").alias("ya_id"), F.col("scheme").alias("force"))
    return yas.join(target, ["graph_id", "ya_id"]).join(anchor, ["graph_id", "ya_id"], "left").select(
        "graph_id", "pos", "ya_id", F.coalesce("a.from_id", F.lit("")).alias("anchor_id"), F.coalesce("a.from_type", F.lit("")).alias("anchor_type"), F.col("t.to_id").alias("target_id"), F.col("t.to_type").alias("target_type"), "force")


def transitions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, pos, ta_id, from_id, to_id): transitions with a locution on both sides, the first of each."""
    typed = typed_edges(nodes, edges)
    before = typed.filter("from_type = 'L' AND to_type = 'TA'").groupBy("graph_id", F.col("to_id").alias("ta_id")).agg(F.min_by("from_id", "pos").alias("from_id"))
    after = typed.filter("from_type = 'TA' AND to_type = 'L'").groupBy("graph_id", F.col("from_id").alias("ta_id")).agg(F.min_by("to_id", "pos").alias("to_id"))
    return nodes.filter("type = 'TA'").select("graph_id", "pos", F.col("node_id").alias("ta_id")).join(before, ["graph_id", "ta_id"]).join(after, ["graph_id", "ta_id"])


def view(nodes: DataFrame, edges: DataFrame, transitions_too: bool) -> tuple[DataFrame, DataFrame]:
    """The dialogue view (with transitions) or the anchor view: locutions, propositions, their anchoring, folded relations."""
    kinds = ["L", "I", "TA"] if transitions_too else ["L", "I"]
    keep = nodes.filter(F.col("type").isin(kinds)).select("graph_id", "node_id").unionByName(illocutions(nodes, edges).filter("anchor_type = 'L' AND target_type = 'I'").select("graph_id", F.col("ya_id").alias("node_id"))).distinct()
    inner = labeled_edges(nodes, edges)
    for end in ("from_id", "to_id"):
        inner = inner.join(keep.select("graph_id", F.col("node_id").alias(end)), ["graph_id", end], "left_semi")
    return nodes.join(keep, ["graph_id", "node_id"], "left_semi"), inner.select("graph_id", "from_id", "to_id", "kind").unionByName(relation_edges(nodes, edges).select("graph_id", "from_id", "to_id", "kind"))


def locution_order(nodes: DataFrame, edges: DataFrame, partitions: int | None = None) -> DataFrame:
    """(graph_id, node_id, idx): locutions in an order that transitions allow; ties by timestamp, then by input.

    A cycle is broken at its earliest locution. Many graphs are packed into each task, which holds one graph at a time.
    """
    import heapq

    locutions = nodes.filter("type = 'L'").groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("pos", "node_id", F.coalesce("timestamp", F.lit("")).alias("timestamp")))).alias("l"))
    arrows = transitions(nodes, edges).groupBy("graph_id").agg(F.collect_list(F.struct("from_id", "to_id")).alias("t"))

    def ordered(locs: list, pairs: list) -> list[str]:
        at = {x["node_id"]: i for i, x in enumerate(locs)}
        after: dict[int, list[int]] = {}
        waits = [0] * len(locs)
        for p in pairs if pairs is not None else []:
            a, b = at.get(p["from_id"]), at.get(p["to_id"])
            if a is not None and b is not None:
                after.setdefault(a, []).append(b)
                waits[b] += 1
        free = [(x["timestamp"], i) for i, x in enumerate(locs) if not waits[i]]
        every = sorted((x["timestamp"], i) for i, x in enumerate(locs))
        heapq.heapify(free)
        done, out, cursor = [False] * len(locs), [], 0
        while len(out) < len(locs):
            while free and done[free[0][1]]:
                heapq.heappop(free)
            if free:
                i = heapq.heappop(free)[1]
            else:
                while done[every[cursor][1]]:
                    cursor += 1
                i = every[cursor][1]
            done[i] = True
            out.append(locs[i]["node_id"])
            for j in after.get(i, ()):
                waits[j] -= 1
                if not waits[j] and not done[j]:
                    heapq.heappush(free, (locs[j]["timestamp"], j))
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(g, n, i) for g, l, t in zip(frame["graph_id"], frame["l"], frame["t"]) for i, n in enumerate(ordered(list(l), t))]
            yield pd.DataFrame(rows, columns=["graph_id", "node_id", "idx"])

    return locutions.join(arrows, "graph_id", "left").mapInPandas(run, "graph_id string, node_id string, idx long")


def proposition_order(nodes: DataFrame, edges: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """(graph_id, node_id, idx): propositions with the index of the earliest locution that anchors them."""
    order = locution_order(nodes, edges) if order is None else order
    anchored = illocutions(nodes, edges).filter("anchor_type = 'L' AND target_type = 'I'").select("graph_id", F.col("anchor_id").alias("node_id"), "target_id")
    return anchored.join(order, ["graph_id", "node_id"]).groupBy("graph_id", F.col("target_id").alias("node_id")).agg(F.min("idx").alias("idx"))


def grade_ladder(nodes: DataFrame) -> DataFrame:
    """(graph_id, ladder): the grades' ladder joined by commas; '' without grades or with unknown ones."""
    seen = nodes.groupBy("graph_id").agg(F.collect_set(F.when(is_relation(F.col("type")) & (F.col("confidence") != ""), F.col("confidence"))).alias("seen"))
    out = F.lit("")
    for ladder in reversed(vocab.LADDERS):
        known = F.array(*(F.lit(x) for x in ladder))
        out = F.when((F.size("seen") > 0) & (F.size(F.array_except("seen", known)) == 0), ",".join(ladder)).otherwise(out)
    return seen.select("graph_id", out.alias("ladder"))


def grade_variants(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges with ``variant``: for each rung but the last, the graph without relations of lower grades and their YAs."""
    ladders = grade_ladder(nodes).filter("ladder <> ''").select("graph_id", F.split("ladder", ",").alias("rungs"))
    kept = ladders.select("graph_id", "rungs", F.explode(F.sequence(F.lit(1), F.size("rungs") - 1)).alias("i")).select(
        "graph_id", F.slice("rungs", 1, F.col("i")).alias("keep"), F.concat(F.when(F.col("i") == 1, "+grade=").otherwise("+grade≥"), F.element_at("rungs", F.col("i"))).alias("variant"))
    gone = nodes.filter(is_relation(F.col("type")) & (F.coalesce("confidence", F.lit("")) != "")).join(kept, "graph_id").filter(~F.array_contains(F.col("keep"), F.col("confidence"))).select("graph_id", "variant", "node_id")
    typed = typed_edges(nodes, edges)
    silent = typed.filter("from_type = 'YA'").select("graph_id", F.col("to_id").alias("node_id"), "from_id").join(gone, ["graph_id", "node_id"]).select("graph_id", "variant", F.col("from_id").alias("node_id"))
    gone = gone.unionByName(silent).distinct()
    each = kept.select("graph_id", "variant")
    left = edges.join(each, "graph_id")
    for end in ("from_id", "to_id"):
        left = left.join(gone.withColumnRenamed("node_id", end), ["graph_id", "variant", end], "left_anti")
    return nodes.join(each, "graph_id").join(gone, ["graph_id", "variant", "node_id"], "left_anti"), left
