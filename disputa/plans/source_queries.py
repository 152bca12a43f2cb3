"""Named queries over readers, writers, sampling, labels, hash vectors and the reports of edits, with the same results as SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from disputa.functions import graph as G
from disputa.operators import cache, calibrate, report
from disputa.plans.catalog import query
from disputa.plans.graph_queries import MATCHED, relation_prf
from disputa.plans.table_queries import _EDITS, _JUDGED, _judgments, edit_plans
from disputa.plans.testgraphs import duck, graphs
from disputa.sources import nodesets
from disputa.sources.scratch import folder


def _path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@query("nodeset_ids", r"""WITH p AS (SELECT doc_id, concat(CASE doc_id % 3 WHEN 0 THEN 'corpus/' ELSE '' END, CASE doc_id % 7 WHEN 0 THEN 'nodes' ELSE 'nodeset' END, CAST(doc_id AS VARCHAR), CASE doc_id % 4 WHEN 0 THEN '.json' WHEN 1 THEN '.txt' WHEN 2 THEN '' ELSE '.xml' END) AS path FROM documents)
SELECT doc_id, CASE WHEN doc_id % 7 <> 0 AND doc_id % 4 <> 3 THEN CAST(doc_id AS VARCHAR) ELSE '' END AS nodeset_id FROM p""")
def nodeset_ids(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    ending = F.when(n % 4 == 0, ".json").when(n % 4 == 1, ".txt").when(n % 4 == 2, "").otherwise(".xml")
    path = F.concat(F.when(n % 3 == 0, "corpus/").otherwise(""), F.when(n % 7 == 0, "nodes").otherwise("nodeset"), n.cast("string"), ending)
    return _table(spark, d, "documents").select("doc_id", nodesets.nodeset_id(path).alias("nodeset_id"))


def _bodies(spark: SparkSession, d: str) -> DataFrame:
    """Nodesets as JSON text, every second scheme left out."""
    g = graphs(spark, d)
    node = F.struct(F.col("node_id").alias("nodeID"), F.concat(F.lit(" "), "text", F.lit(" ")).alias("text"), "type", F.when(F.col("pos") % 20 < 10, F.col("scheme")).otherwise("").alias("scheme"), "timestamp")
    n = g["gn"].groupBy("graph_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "node_id", node.alias("n")))), lambda x: x["n"]).alias("nodes"))
    e = g["ge"].groupBy("graph_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col("from_id").alias("fromID"), F.col("to_id").alias("toID")))), lambda x: F.struct(x["fromID"], x["toID"])).alias("edges"))
    empty = F.array().cast("array<struct<nodeID string, personID string>>")
    return n.join(e, "graph_id").select("graph_id", F.to_json(F.struct("nodes", "edges", empty.alias("locutions"))).alias("body"))


@query("parsed_nodesets", duck("""SELECT graph_id, node_id, type, CASE WHEN type IN ('I', 'L') THEN '' WHEN pos % 20 < 10 THEN scheme ELSE CASE type WHEN 'RA' THEN 'Default Inference' WHEN 'CA' THEN 'Default Conflict' WHEN 'MA' THEN 'Default Rephrase' WHEN 'TA' THEN 'Default Transition' ELSE 'Default Illocuting' END END AS scheme, speaker, md5(trim(text)) AS body FROM gn"""))
def parsed_nodesets(spark: SparkSession, d: str) -> DataFrame:
    nodes, _ = nodesets.parse_json(_bodies(spark, d), "graph_id", "body")
    return nodes.select("graph_id", "node_id", "type", "scheme", "speaker", F.md5(F.encode("text", "UTF-8")).alias("body"))


def _results(spark: SparkSession, d: str) -> DataFrame:
    rows = relation_prf(spark, d).select("graph_id", F.col("correct").cast("long").alias("correct"), F.col("reversed").cast("long").alias("reversed"))
    return rows.withColumn("error", F.when(F.col("graph_id").cast("long") % 10 == 3, "no text").otherwise(""))


@query("results_round_trip", duck(MATCHED + "SELECT graph_id, CAST(correct AS BIGINT) AS correct, CASE CAST(graph_id AS BIGINT) % 10 WHEN 3 THEN 'no text' ELSE '' END AS error FROM rc"))
def results_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = _path(spark, "results")
    nodesets.write_results(_results(spark, d), path)
    return nodesets.read_results(spark, path).select("graph_id", "correct", "error")


@query("metrics_csv", duck(MATCHED + "SELECT graph_id AS nodeset_id, CAST(correct AS DOUBLE) AS correct, round(correct / 7.0::DOUBLE, 4) AS part FROM rc WHERE CAST(graph_id AS BIGINT) % 10 <> 3 AND CAST(graph_id AS BIGINT) % 2 = 0"))
def metrics_csv(spark: SparkSession, d: str) -> DataFrame:
    path, even = _path(spark, "metrics"), F.col("graph_id").cast("long") % 2 == 0
    rows = _results(spark, d).select(F.col("graph_id").alias("nodeset_id"), "correct", (F.col("correct") / 7).alias("part"), F.when(even, "0.3").otherwise("0.4").alias("metric"), F.lit("uniform").alias("weights"), "error")
    nodesets.write_csv(rows, path)
    return nodesets.read_metrics(spark, path, "0.3", "uniform").select("nodeset_id", "correct", "part")


@query("graph_lines", duck("SELECT graph_id, count(*) AS n_nodes, count(*) FILTER (WHERE speaker <> '') AS n_spoken, (SELECT count(*) FROM pe WHERE pe.graph_id = pn.graph_id) AS n_edges FROM pn GROUP BY graph_id"))
def graph_lines(spark: SparkSession, d: str) -> DataFrame:
    g, path = graphs(spark, d), _path(spark, "lines")
    nodesets.write_graphs(g["pn"], g["pe"], path)
    size = lambda c: F.size(c).cast("long")
    return spark.read.json(path).select("graph_id", size("nodes").alias("n_nodes"), size(F.filter("nodes", lambda n: n["speaker"] != "")).alias("n_spoken"), F.coalesce(size("edges"), F.lit(0)).alias("n_edges"))


_SPLITS = [("dev", "c0"), ("dev", "c1"), ("test", "c2")]


@query("sampled_graphs", duck("""SELECT graph_id FROM (SELECT graph_id, row_number() OVER (ORDER BY md5(concat('s7:', graph_id)), graph_id) AS r FROM (SELECT graph_id, c FROM tg GROUP BY ALL HAVING count(*) BETWEEN 3 AND 7 AND bool_or(has)) WHERE c % 4 IN (0, 1)) WHERE r <= 20"""))
def sampled_graphs(spark: SparkSession, d: str) -> DataFrame:
    counts = graphs(spark, d)["tg"].groupBy("graph_id", F.concat(F.lit("c"), F.col("c") % 4).alias("corpus")).agg(F.count("*").alias("locutions"), F.count_if("has").alias("relations"))
    kept = nodesets.eligible(counts, spark.createDataFrame(_SPLITS, "split string, corpus string"), "dev", 3, 7)
    return nodesets.sample(kept.select("graph_id"), "graph_id", "s7", 20)


@query("manifest", "SELECT source, count(*) AS n, count(*) FILTER (WHERE coalesce(text, '') <> '') AS with_text FROM documents GROUP BY 1")
def manifest(spark: SparkSession, d: str) -> DataFrame:
    return nodesets.manifest(_table(spark, d, "documents"), "source", "text")


@query("condition_labels", "SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'baseline' ELSE concat('e2e@', role, '/', CASE conv_id % 2 WHEN 0 THEN '5-mini' ELSE 'own' END) END AS label FROM conversations")
def condition_labels(spark: SparkSession, d: str) -> DataFrame:
    condition, model = F.when(F.col("turn") % 3 == 0, "baseline").otherwise("e2e"), F.when(F.col("conv_id") % 2 == 0, "gpt-5-mini").otherwise("own")
    return _table(spark, d, "conversations").select("conv_id", "turn", G.condition_label(condition, F.col("role"), model).alias("label"))


@query("truncated_texts", "SELECT doc_id, md5(CASE WHEN length(text) > 80 THEN concat(substr(text, 1, 80), '…') ELSE text END) AS short FROM documents WHERE text IS NOT NULL")
def truncated_texts(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.md5(F.encode(G.truncated(F.col("text")), "UTF-8")).alias("short"))


_VECTOR = "SELECT doc_id, j, (CAST(concat('0x', substr(h, 7, 2), substr(h, 5, 2), substr(h, 3, 2), substr(h, 1, 2)) AS BIGINT) / 4294967295.0::DOUBLE) * 2 - 1 AS v FROM (SELECT doc_id, j, sha256(encode(text) || unhex(printf('%02x000000', j))) AS h FROM documents, range(16) r(j) WHERE text IS NOT NULL)"


@query("hash_vectors", f"WITH v AS ({_VECTOR}), n AS (SELECT doc_id, sqrt(sum(v * v)) AS n FROM v GROUP BY 1) SELECT doc_id, CAST(j AS BIGINT) AS place, round(CAST(CAST(CAST(CAST(v AS FLOAT) AS DOUBLE) / n AS FLOAT) AS DOUBLE), 4) AS value FROM v JOIN n USING (doc_id)")
def hash_vectors(spark: SparkSession, d: str) -> DataFrame:
    made = _table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.posexplode(G.hash_vector(F.col("text"))).alias("place", "value"))
    return made.select("doc_id", F.col("place").cast("long").alias("place"), F.round(F.col("value").cast("double"), 4).alias("value"))


@query("weighted_means", "SELECT event_type, CAST(sum(n) AS BIGINT) AS n, round(sum(m * n) / sum(n), 6) AS mean FROM (SELECT event_type, user_id, avg(value) AS m, count(value) AS n FROM events GROUP BY ALL) GROUP BY 1")
def weighted_means(spark: SparkSession, d: str) -> DataFrame:
    by = _table(spark, d, "events").groupBy("event_type", "user_id").agg(F.avg("value").alias("m"), F.count("value").alias("n"))
    return report.weighted_mean(by, ["event_type"], "m", "n").select("event_type", "n", F.round("mean", 6).alias("mean"))


@query("budget_stop", "SELECT conv_id, count(*) AS n FROM (SELECT conv_id, coalesce(sum(length(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM conversations) WHERE spent < 300 GROUP BY 1")
def budget_stop(spark: SparkSession, d: str) -> DataFrame:
    spent = _table(spark, d, "conversations").withColumn("amount", F.length(F.coalesce("text", F.lit(""))).cast("double"))
    return cache.within_budget(spent, "turn", "amount", 300.0, ["conv_id"]).groupBy("conv_id").agg(F.count("*").alias("n"))


# ---- Edits.


def _kinds(spark: SparkSession, d: str) -> DataFrame:
    return edit_plans(spark, d).groupBy("triplet_id", "plan", "side").agg(F.collect_list("kind").alias("kinds"))


_PER = f"WITH x AS ({_EDITS}), k AS (SELECT triplet_id, plan, side, list(DISTINCT kind) AS kinds FROM x GROUP BY ALL) "


@query("changing_edits", _PER + "SELECT triplet_id, side, len(list_filter(kinds, lambda k: k NOT IN ('X-spk', 'X-surf'))) > 0 AS changes FROM k")
def changing_edits(spark: SparkSession, d: str) -> DataFrame:
    return _kinds(spark, d).select("triplet_id", "side", calibrate.changes_graph(F.col("kinds")).alias("changes"))


@query("unrealized_edits", _PER + ", e AS (SELECT triplet_id, unnest(kinds) AS kind FROM k) SELECT kind, count(*) AS n, count(*) FILTER (WHERE triplet_id % 5 = 0) AS same FROM e WHERE kind <> 'X-spk' GROUP BY 1")
def unrealized_edits(spark: SparkSession, d: str) -> DataFrame:
    return calibrate.unrealized(_kinds(spark, d).withColumn("same", F.col("triplet_id") % 5 == 0))


@query("verified_edits", _PER + ", e AS (SELECT triplet_id % 3 + 1 AS tries, triplet_id % 7 <> 0 AS passed, unnest(kinds) AS kind FROM k) SELECT kind, count(*) AS n, count(*) FILTER (WHERE passed AND tries = 1) AS first, count(*) FILTER (WHERE passed AND tries > 1) AS again, count(*) FILTER (WHERE NOT passed) AS failed FROM e GROUP BY 1")
def verified_edits(spark: SparkSession, d: str) -> DataFrame:
    return calibrate.verified(_kinds(spark, d).withColumns({"tries": F.col("triplet_id") % 3 + 1, "passed": F.col("triplet_id") % 7 != 0}))


@query("edit_problems", "SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN turn % 2 = 0 THEN 'unchecked' END, CASE WHEN turn % 2 = 1 AND conv_id % 3 = 0 THEN 'unrealized' END, CASE WHEN conv_id % 5 = 0 THEN 'unintended' END, CASE WHEN conv_id % 6 < 3 THEN 'unnatural' END], lambda x: x IS NOT NULL), ',') AS problems FROM conversations")
def edit_problems(spark: SparkSession, d: str) -> DataFrame:
    found = calibrate.problems(F.col("turn") % 2 == 1, F.col("conv_id") % 3 != 0, (F.col("conv_id") % 5 == 0).cast("int"), F.col("conv_id") % 6)
    return _table(spark, d, "conversations").select("conv_id", "turn", F.array_join(found, ",").alias("problems"))


@query("mapped_answers", "SELECT conv_id, turn, CASE turn % 3 WHEN 2 THEN 2 WHEN 0 THEN CASE WHEN conv_id % 2 = 0 THEN 0 ELSE 1 END ELSE CASE WHEN conv_id % 2 = 0 THEN 1 ELSE 0 END END AS answer FROM conversations")
def mapped_answers(spark: SparkSession, d: str) -> DataFrame:
    raw: Column = F.when(F.col("turn") % 3 == 2, "tie").when(F.col("turn") % 3 == 0, "first").otherwise("second")
    return _table(spark, d, "conversations").select("conv_id", "turn", calibrate.map_answer(raw, F.when(F.col("conv_id") % 2 == 0, 1).otherwise(-1)).alias("answer"))


@query("allocation_hits", "SELECT conv_id % 2 = 0 AS near_target, count(*) AS n, count(*) FILTER (WHERE (abs(turn - 3) / 4.0 < 0.5) = (conv_id % 2 = 0)) AS hit FROM conversations WHERE turn % 4 <> 0 GROUP BY 1")
def allocation_hits(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "conversations").select(F.when(F.col("turn") % 4 != 0, F.col("conv_id") % 2 == 0).alias("near_target"), ((F.col("turn") - 3) / 4).alias("delta"))
    return calibrate.allocation_hits(rows)


@query("answers_by_plan", _JUDGED + f", x AS ({_EDITS}), y AS (SELECT DISTINCT triplet_id, plan FROM x) SELECT plan, answer, count(*) AS n FROM j JOIN y ON j.triplet_id // 8 = y.triplet_id GROUP BY ALL")
def answers_by_plan(spark: SparkSession, d: str) -> DataFrame:
    planned = edit_plans(spark, d).select("triplet_id", "plan").distinct()
    return calibrate.answers_by_plan(_judgments(spark, d).withColumn("triplet_id", F.floor(F.col("triplet_id") / 8)), planned)
