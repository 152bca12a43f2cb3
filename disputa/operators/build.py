"""Construction of argument graphs from utterances, rules and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from disputa.functions import vocab


def _node(kind: str, prefix: str, offset: int, text: str, scheme: str, speaker: str = "''", condition: str = "true") -> str:
    return f"SELECT graph_id, idx * 8 + {offset} AS pos, concat('{prefix}', idx) AS node_id, '{kind}' AS type, {text} AS text, {scheme} AS scheme, {speaker} AS speaker, '' AS timestamp, '' AS confidence FROM {{u}} WHERE {condition}"


def baseline(utterances: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without relations: (graph_id, idx, speaker, text) utterances, asserted one by one, in a chain."""
    spark = utterances.sparkSession
    said = utterances.withColumn("idx", F.row_number().over(W.partitionBy("graph_id").orderBy("idx")) - 1)
    nodes = spark.sql(" UNION ALL ".join([_node("L", "L", 0, "concat(speaker, ' : ', text)", "''", "speaker"), _node("YA", "Y", 1, "''", "'Asserting'"), _node("I", "I", 2, "trim(text)", "''"), _node("TA", "T", 3, "''", f"'{vocab.DEFAULT_SCHEMES['TA']}'", condition="idx > 0")]), u=said)
    edge = lambda o, a, b, c="true": f"SELECT graph_id, idx * 8 + {o} AS pos, {a} AS from_id, {b} AS to_id FROM {{u}} WHERE {c}"
    edges = spark.sql(" UNION ALL ".join([edge(0, "concat('L', idx)", "concat('Y', idx)"), edge(1, "concat('Y', idx)", "concat('I', idx)"), edge(2, "concat('L', idx - 1)", "concat('T', idx)", "idx > 0"), edge(3, "concat('T', idx)", "concat('L', idx)", "idx > 0")]), u=said)
    return nodes, edges


def adjacent_relations(order: DataFrame) -> DataFrame:
    """(graph_id, from_id, to_id, kind): each proposition supports the one before it; order: (graph_id, node_id, idx)."""
    w = W.partitionBy("graph_id").orderBy("idx", "node_id")
    return order.select("graph_id", F.col("node_id").alias("from_id"), F.lag("node_id").over(w).alias("to_id"), F.lit("support").alias("kind")).filter("to_id IS NOT NULL")


def candidate_pairs(order: DataFrame, reach: int = 4) -> DataFrame:
    """(graph_id, i, j, a, b): pairs of propositions at most ``reach`` apart. Each row meets only the next ones: no join."""
    w = W.partitionBy("graph_id").orderBy("idx", "node_id")
    ahead = F.collect_list("node_id").over(w.rowsBetween(1, reach))
    ranked = order.select("graph_id", (F.row_number().over(w) - 1).cast("long").alias("i"), F.col("node_id").alias("a"), ahead.alias("next"))
    return ranked.select("graph_id", "i", "a", F.posexplode("next").alias("k", "b")).select("graph_id", "i", (F.col("i") + F.col("k") + 1).alias("j"), "a", "b")


def verdict_relations(candidates: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(graph_id, from_id, to_id, type): verdicts (graph_id, i, j, seq, type, source); the first for a candidate counts, 'none' is no relation."""
    first = verdicts.groupBy("graph_id", "i", "j").agg(F.min_by(F.struct("type", "source"), "seq").alias("v"))
    later = F.col("v.source") == "later"
    return candidates.join(first, ["graph_id", "i", "j"]).filter("v.type <> 'none'").select("graph_id", F.when(later, F.col("b")).otherwise(F.col("a")).alias("from_id"), F.when(later, F.col("a")).otherwise(F.col("b")).alias("to_id"), F.col("v.type").alias("type"))


def assemble(utterances: DataFrame, items: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A graph from utterances (graph_id, idx, speaker, text), items (graph_id, idx, seq, proposition, force) and relations (graph_id, src, dst, type, force, seq).

    The first item of an index counts; unknown forces become the default; an empty proposition has no I and YA; relations
    repeat once by (src, dst, type) and need both propositions; a relation has a YA only between neighbours.
    """
    spark = utterances.sparkSession
    default = vocab.DEFAULT_SCHEMES["YA"]
    first = items.groupBy("graph_id", "idx").agg(F.min_by(F.struct("proposition", "force"), "seq").alias("item"))
    said = utterances.join(first, ["graph_id", "idx"], "left").select("graph_id", "idx", "speaker", "text", F.trim(F.coalesce("item.proposition", F.lit(""))).alias("proposition"), F.when(F.col("item.force").isin(vocab.LOCUTION_FORCES), F.col("item.force")).otherwise(default).alias("force"))
    nodes = spark.sql(" UNION ALL ".join([_node("L", "L", 0, "concat(speaker, ' : ', text)", "''", "speaker"), _node("YA", "Y", 1, "''", "force", condition="proposition <> ''"), _node("I", "I", 2, "proposition", "''", condition="proposition <> ''"), _node("TA", "T", 3, "''", f"'{vocab.DEFAULT_SCHEMES['TA']}'", condition="idx > 0")]), u=said)
    edge = lambda o, a, b, c="true": f"SELECT graph_id, idx * 8 + {o} AS pos, {a} AS from_id, {b} AS to_id FROM {{u}} WHERE {c}"
    edges = spark.sql(" UNION ALL ".join([edge(0, "concat('L', idx)", "concat('Y', idx)", "proposition <> ''"), edge(1, "concat('Y', idx)", "concat('I', idx)", "proposition <> ''"), edge(2, "concat('L', idx - 1)", "concat('T', idx)", "idx > 0"), edge(3, "concat('T', idx)", "concat('L', idx)", "idx > 0")]), u=said)
    there = said.filter("proposition <> ''").select("graph_id", "idx")
    once = found.filter(F.col("type").isin(vocab.RELATION_TYPES) & (F.col("src") != F.col("dst"))).groupBy("graph_id", "src", "dst", "type").agg(F.min_by(F.struct("seq", "force"), "seq").alias("r"))
    once = once.join(there.withColumnRenamed("idx", "src"), ["graph_id", "src"], "left_semi").join(there.withColumnRenamed("idx", "dst"), ["graph_id", "dst"], "left_semi")
    numbered = once.select("graph_id", "src", "dst", "type", F.row_number().over(W.partitionBy("graph_id").orderBy("r.seq", "src", "dst", "type")).alias("k"), F.when(F.col("r.force").isin(vocab.TRANSITION_FORCES), F.col("r.force")).otherwise(default).alias("force"), (F.abs(F.col("src") - F.col("dst")) == 1).alias("near"), F.greatest("src", "dst").alias("late"))
    scheme = "CASE type WHEN 'RA' THEN 'Default Inference' WHEN 'CA' THEN 'Default Conflict' ELSE 'Default Rephrase' END"
    more = spark.sql(f"SELECT graph_id, 1000000 + k * 8 AS pos, concat('S', k) AS node_id, type, '' AS text, {scheme} AS scheme, '' AS speaker, '' AS timestamp, '' AS confidence FROM {{r}} UNION ALL SELECT graph_id, 1000000 + k * 8 + 1, concat('V', k), 'YA', '', force, '', '', '' FROM {{r}} WHERE near", r=numbered)
    links = spark.sql("SELECT graph_id, 1000000 + k * 8 AS pos, concat('I', src) AS from_id, concat('S', k) AS to_id FROM {r} UNION ALL SELECT graph_id, 1000000 + k * 8 + 1, concat('S', k), concat('I', dst) FROM {r} UNION ALL SELECT graph_id, 1000000 + k * 8 + 2, concat('T', late), concat('V', k) FROM {r} WHERE near UNION ALL SELECT graph_id, 1000000 + k * 8 + 3, concat('V', k), concat('S', k) FROM {r} WHERE near", r=numbered)
    return nodes.unionByName(more), edges.unionByName(links)


def prune(found: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Relations (graph_id, k, ...) without those whose verdict (graph_id, k, keep) is false."""
    return found.join(verdicts.filter("NOT keep").select("graph_id", "k"), ["graph_id", "k"], "left_anti")
