"""Named queries over argument graphs, each with the same result as SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from disputa.functions import graph as G
from disputa.functions import vocab
from disputa.operators import assign, build, fold, ged, report, score
from disputa.plans.catalog import query
from disputa.plans.testgraphs import duck, graphs
from disputa.sources.scratch import written

KEY = "graph_id"
_R = lambda name, t: f"{name} AS (SELECT graph_id, i, rel AS type, grade, CASE WHEN turned THEN dst ELSE i END AS src, CASE WHEN turned THEN i ELSE dst END AS dst FROM {t} WHERE has)"
RELS = f", {_R('pr', 'tp')}, {_R('gr', 'tg')} "
#: Closed form of the three matching passes on identical propositions.
MATCHED = RELS.rstrip() + """,
pk AS (SELECT graph_id, src, dst, type, count(*) AS n FROM pr GROUP BY ALL), gk AS (SELECT graph_id, src, dst, type, count(*) AS n FROM gr GROUP BY ALL),
bk AS (SELECT graph_id, src, dst, coalesce(pk.n, 0) AS p, coalesce(gk.n, 0) AS g FROM pk FULL JOIN gk USING (graph_id, src, dst, type)),
bp AS (SELECT graph_id, src, dst, sum(p) AS p, sum(g) AS g, sum(least(p, g)) AS exact FROM bk GROUP BY ALL),
bt AS (SELECT *, least(p - exact, g - exact) AS typed FROM bp),
bd AS (SELECT a.*, least(a.p - a.exact - a.typed, coalesce(b.g - b.exact - b.typed, 0)) AS turned FROM bt a LEFT JOIN bt b ON a.graph_id = b.graph_id AND a.src = b.dst AND a.dst = b.src),
rc AS (SELECT graph_id, sum(p) AS pred_total, sum(g) AS gold_total, sum(exact) AS correct, sum(typed) AS mistyped, sum(turned) AS reversed FROM bd GROUP BY graph_id) """


def _big(*names: str) -> list:
    return [F.col(n).cast("long").alias(n) for n in names]


def _same(g: dict[str, DataFrame]) -> DataFrame:
    """Matching of propositions with equal ids."""
    return g["pn"].filter("type = 'I'").select(KEY, F.col("node_id").alias("a")).join(g["gn"].filter("type = 'I'").select(KEY, F.col("node_id").alias("a")), [KEY, "a"]).withColumn("b", F.col("a"))


def _scored(spark: SparkSession, d: str) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    g = graphs(spark, d)
    gold = score.instances(g["gn"], g["ge"])
    return g, score.relation_outcomes(score.instances(g["pn"], g["pe"]), gold, _same(g)), gold


def _counts(outcomes: DataFrame, gold: DataFrame) -> DataFrame:
    return score.relation_counts(outcomes, gold)


@query("relation_prf", duck(MATCHED + """SELECT graph_id, CAST(correct AS BIGINT) AS correct, CAST(mistyped AS BIGINT) AS mistyped, CAST(reversed AS BIGINT) AS reversed, CAST(pred_total AS BIGINT) AS pred_total, CAST(gold_total AS BIGINT) AS gold_total,
round(CASE WHEN pred_total + gold_total > 0 THEN 2.0 * correct / (pred_total + gold_total) ELSE 0 END, 6) AS typed_f1, round(CASE WHEN pred_total > 0 THEN (correct + mistyped + reversed) / CAST(pred_total AS DOUBLE) ELSE 0 END, 6) AS undirected_precision FROM rc"""))
def relation_prf(spark: SparkSession, d: str) -> DataFrame:
    _, outcomes, gold = _scored(spark, d)
    return score.relation_scores(_counts(outcomes, gold)).select(KEY, *_big("correct", "mistyped", "reversed", "pred_total", "gold_total"), F.round("typed_f1", 6).alias("typed_f1"), F.round("undirected_precision", 6).alias("undirected_precision"))


@query("node_type_counts", duck("SELECT graph_id, type, count(*) AS n FROM gn GROUP BY ALL"))
def node_type_counts(spark: SparkSession, d: str) -> DataFrame:
    return graphs(spark, d)["gn"].groupBy(KEY, "type").agg(F.count("*").alias("n"))


TYPED = """, ty AS (SELECT e.graph_id, e.pos, from_id, to_id, a.type AS ft, b.type AS tt FROM re e LEFT JOIN rn a ON a.graph_id = e.graph_id AND a.node_id = from_id LEFT JOIN rn b ON b.graph_id = e.graph_id AND b.node_id = to_id),
ok AS (SELECT *, coalesce(CASE WHEN ft = 'I' THEN tt IN ('RA','CA','MA') WHEN ft IN ('RA','CA','MA','YA') THEN tt IN ('I','RA','CA','MA') WHEN ft = 'L' THEN tt IN ('YA','TA') WHEN ft = 'TA' THEN tt IN ('L','YA') END, false) AND from_id <> to_id AS fine FROM ty),
kept AS (SELECT DISTINCT graph_id, from_id, to_id FROM ok WHERE fine), ends AS (SELECT graph_id, from_id AS node_id FROM kept UNION SELECT graph_id, to_id FROM kept) """


@query("normalize_report", duck(TYPED + """, eb AS (SELECT graph_id, count(*) AS n FROM re GROUP BY 1), ea AS (SELECT graph_id, count(*) AS n FROM kept GROUP BY 1),
gone AS (SELECT n.graph_id, count(*) FILTER (WHERE type = 'L') AS l, count(*) FILTER (WHERE type <> 'L') AS o, string_agg(node_id, ',' ORDER BY node_id) AS ids FROM rn n WHERE NOT EXISTS (SELECT 1 FROM ends e WHERE e.graph_id = n.graph_id AND e.node_id = n.node_id) GROUP BY 1)
SELECT g.graph_id, CAST(coalesce(eb.n, 0) - coalesce(ea.n, 0) AS BIGINT) AS dropped_edges, CAST(coalesce(l, 0) AS BIGINT) AS dropped_isolated_l, CAST(coalesce(o, 0) AS BIGINT) AS dropped_other, coalesce(ids, '') AS dropped_node_ids, CAST(0 AS BIGINT) AS violations
FROM (SELECT DISTINCT graph_id FROM rn) g LEFT JOIN eb USING (graph_id) LEFT JOIN ea USING (graph_id) LEFT JOIN gone USING (graph_id)"""))
def normalize_report(spark: SparkSession, d: str) -> DataFrame:
    g = graphs(spark, d)
    return fold.normalize_report(g["rn"], g["re"])


@query("metamodel_violations", duck(TYPED + """SELECT rule, CAST(count(*) AS BIGINT) AS n FROM (
SELECT 'R1' AS rule FROM ty WHERE ft = 'I' AND tt = 'I' UNION ALL SELECT 'R7' FROM ty WHERE ft = 'L' AND (tt IS NULL OR tt NOT IN ('YA','TA')) UNION ALL SELECT 'R9' FROM ty WHERE ft IS NULL UNION ALL SELECT 'R9' FROM ty WHERE tt IS NULL
UNION ALL SELECT 'R5' FROM rn n WHERE type = 'YA' AND (SELECT count(*) FROM ty WHERE ty.graph_id = n.graph_id AND to_id = n.node_id AND ft IN ('L','TA')) <> 1
UNION ALL SELECT 'R5' FROM rn n WHERE type = 'YA' AND (SELECT count(*) FROM ty WHERE ty.graph_id = n.graph_id AND from_id = n.node_id AND tt IN ('I','RA','CA','MA')) <> 1
UNION ALL SELECT 'R6' FROM rn n WHERE type = 'TA' AND ((SELECT count(*) FROM ty WHERE ty.graph_id = n.graph_id AND to_id = n.node_id AND ft = 'L') <> 1 OR (SELECT count(*) FROM ty WHERE ty.graph_id = n.graph_id AND from_id = n.node_id AND tt = 'L') <> 1)
UNION ALL SELECT CASE type WHEN 'RA' THEN 'R2' WHEN 'CA' THEN 'R3' ELSE 'R4' END FROM rn n WHERE type IN ('RA','CA','MA') AND (SELECT count(*) FROM ty WHERE ty.graph_id = n.graph_id AND from_id = n.node_id AND tt IN ('I','RA','CA','MA')) <> 1) GROUP BY rule"""))
def metamodel_violations(spark: SparkSession, d: str) -> DataFrame:
    g = graphs(spark, d)
    return fold.violations(g["rn"], g["re"]).groupBy("rule").agg(F.count("*").alias("n"))


@query("relation_fold", duck(RELS + "SELECT graph_id, concat('S', CAST(i AS VARCHAR)) AS snode_id, type, concat('I', CAST(src AS VARCHAR)) AS srcs, concat('I', CAST(dst AS VARCHAR)) AS dst_id, CASE type WHEN 'RA' THEN 'Arguing' WHEN 'CA' THEN 'Disagreeing' ELSE 'Restating' END AS force FROM pr"))
def relation_fold(spark: SparkSession, d: str) -> DataFrame:
    g = graphs(spark, d)
    return fold.relations(g["pn"], g["pe"]).select(KEY, "snode_id", "type", F.array_join("src_ids", ",").alias("srcs"), "dst_id", "force")


@query("illocution_fold", duck("SELECT graph_id, concat('Y', CAST(i AS VARCHAR)) AS ya_id, concat('L', CAST(i AS VARCHAR)) AS anchor_id, 'L' AS anchor_type, concat('I', CAST(i AS VARCHAR)) AS target_id, 'I' AS target_type, force FROM tg UNION ALL SELECT graph_id, concat('V', CAST(i AS VARCHAR)), concat('T', CAST(i AS VARCHAR)), 'TA', concat('S', CAST(i AS VARCHAR)), rel, CASE rel WHEN 'RA' THEN 'Arguing' WHEN 'CA' THEN 'Disagreeing' ELSE 'Restating' END FROM tg WHERE has"))
def illocution_fold(spark: SparkSession, d: str) -> DataFrame:
    g = graphs(spark, d)
    return fold.illocutions(g["gn"], g["ge"]).drop("pos")


@query("transition_fold", duck("SELECT graph_id, concat('T', CAST(i AS VARCHAR)) AS ta_id, concat('L', CAST(before AS VARCHAR)) AS from_id, concat('L', CAST(i AS VARCHAR)) AS to_id FROM tp WHERE before IS NOT NULL AND i > 0"))
def transition_fold(spark: SparkSession, d: str) -> DataFrame:
    g = graphs(spark, d)
    return fold.transitions(g["pn"], g["pe"]).drop("pos")


KINDS = """, lk AS (SELECT graph_id, from_id, to_id, CASE WHEN tt = 'YA' THEN 'ANCHORS' WHEN ft = 'YA' THEN 'ILLOCUTES' WHEN ft = 'I' THEN CASE tt WHEN 'RA' THEN 'PREMISE_OF' WHEN 'CA' THEN 'CONFLICTS_VIA' WHEN 'MA' THEN 'REPHRASES_VIA' END
WHEN ft = 'RA' THEN 'CONCLUDES' WHEN ft = 'CA' THEN 'CONFLICTS_WITH' WHEN ft = 'MA' THEN 'REPHRASES_TO' WHEN ft = 'L' THEN 'NEXT' ELSE 'LEADS_TO' END AS kind
FROM (SELECT e.*, a.type AS ft, b.type AS tt FROM pe e JOIN pn a ON a.graph_id = e.graph_id AND a.node_id = from_id JOIN pn b ON b.graph_id = e.graph_id AND b.node_id = to_id)) """


@query("labeled_edges", duck(KINDS + "SELECT graph_id, from_id, to_id, kind FROM lk"))
def labeled_edges(spark: SparkSession, d: str) -> DataFrame:
    g = graphs(spark, d)
    return fold.labeled_edges(g["pn"], g["pe"]).drop("pos")


def _view_sql(kinds: str) -> str:
    keep = f"(type IN ({kinds}) OR node_id LIKE 'Y%')"
    return KINDS + RELS + f"""SELECT graph_id, (SELECT count(*) FROM pn WHERE pn.graph_id = g.graph_id AND {keep}) AS n_nodes,
(SELECT count(*) FROM lk JOIN pn a ON a.graph_id = lk.graph_id AND a.node_id = from_id JOIN pn b ON b.graph_id = lk.graph_id AND b.node_id = to_id WHERE lk.graph_id = g.graph_id AND (a.type IN ({kinds}) OR from_id LIKE 'Y%') AND (b.type IN ({kinds}) OR to_id LIKE 'Y%')) + (SELECT count(*) FROM pr WHERE pr.graph_id = g.graph_id) AS n_edges FROM (SELECT DISTINCT graph_id FROM pn) g"""


def _view(spark: SparkSession, d: str, ta: bool) -> DataFrame:
    g = graphs(spark, d)
    n, e = fold.view(g["pn"], g["pe"], ta)
    return n.groupBy(KEY).agg(F.count("*").alias("n_nodes")).join(e.groupBy(KEY).agg(F.count("*").alias("n_edges")), KEY, "left").fillna(0)


@query("dialogue_view", duck(_view_sql("'L','I','TA'")))
def dialogue_view(spark: SparkSession, d: str) -> DataFrame:
    return _view(spark, d, True)


@query("anchor_view", duck(_view_sql("'L','I'")))
def anchor_view(spark: SparkSession, d: str) -> DataFrame:
    return _view(spark, d, False)


@query("locution_order", duck("SELECT graph_id, concat('L', CAST(i AS VARCHAR)) AS node_id, row_number() OVER (PARTITION BY graph_id ORDER BY i) - 1 AS idx FROM tp"))
def locution_order(spark: SparkSession, d: str) -> DataFrame:
    g = graphs(spark, d)
    return fold.locution_order(g["pn"], g["pe"])


@query("proposition_order", duck("SELECT graph_id, concat('I', CAST(i AS VARCHAR)) AS node_id, row_number() OVER (PARTITION BY graph_id ORDER BY i) - 1 AS idx FROM tp"))
def proposition_order(spark: SparkSession, d: str) -> DataFrame:
    g = graphs(spark, d)
    return fold.proposition_order(g["pn"], g["pe"])


BANDED = MATCHED.rstrip() + """, po AS (SELECT graph_id, i, row_number() OVER (PARTITION BY graph_id ORDER BY i) AS x FROM tp),
pb AS (SELECT pr.*, abs(a.x - b.x) AS dist FROM pr JOIN po a ON a.graph_id = pr.graph_id AND a.i = src JOIN po b ON b.graph_id = pr.graph_id AND b.i = dst), gb AS (SELECT *, abs(src - dst) AS dist FROM gr),
hit AS (SELECT DISTINCT pr.graph_id, pr.src, pr.dst, pr.type FROM pr JOIN gr ON pr.graph_id = gr.graph_id AND pr.src = gr.src AND pr.dst = gr.dst AND pr.type = gr.type) """
_BAND = "CASE WHEN dist <= 1 THEN '1' WHEN dist <= 4 THEN '2-4' WHEN dist <= 9 THEN '5-9' ELSE '10+' END"


@query("distance_bands", duck(BANDED + f"""SELECT band, CAST(sum(p) AS BIGINT) AS pred_total, CAST(sum(g) AS BIGINT) AS gold_total, CAST(sum(tp) AS BIGINT) AS tp_pred, CAST(sum(tg) AS BIGINT) AS tp_gold FROM (
SELECT {_BAND} AS band, 1 AS p, 0 AS g, CASE WHEN EXISTS (SELECT 1 FROM hit WHERE hit.graph_id = pb.graph_id AND hit.src = pb.src AND hit.dst = pb.dst AND hit.type = pb.type) THEN 1 ELSE 0 END AS tp, 0 AS tg FROM pb
UNION ALL SELECT {_BAND}, 0, 1, 0, CASE WHEN EXISTS (SELECT 1 FROM hit WHERE hit.graph_id = gb.graph_id AND hit.src = gb.src AND hit.dst = gb.dst AND hit.type = gb.type) THEN 1 ELSE 0 END FROM gb
UNION ALL SELECT unnest(['1', '2-4', '5-9', '10+']), 0, 0, 0, 0) GROUP BY band"""))
def distance_bands(spark: SparkSession, d: str) -> DataFrame:
    g, outcomes, gold = _scored(spark, d)
    rows = score.distance_buckets(outcomes, gold, fold.proposition_order(g["pn"], g["pe"]), fold.proposition_order(g["gn"], g["ge"]))
    return report.bands(rows, []).select("band", *_big("pred_total", "gold_total", "tp_pred", "tp_gold"))


@query("grade_ladder", duck("SELECT graph_id, CASE WHEN bool_or(has) THEN 'high,medium,low' ELSE '' END AS ladder FROM tp GROUP BY 1"))
def grade_ladder(spark: SparkSession, d: str) -> DataFrame:
    return fold.grade_ladder(graphs(spark, d)["pn"])


@query("grade_thresholds", duck(RELS + """, v AS (SELECT * FROM (VALUES ('+grade=high', 1), ('+grade≥medium', 2)) x(variant, r)), q AS (SELECT *, CASE grade WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS g FROM pr)
SELECT variant, CAST(count(*) FILTER (WHERE q.g <= v.r) AS BIGINT) AS n_relations, CAST((SELECT count(*) FROM tp WHERE graph_id IN (SELECT graph_id FROM pr)) + count(*) FILTER (WHERE q.g <= v.r) AS BIGINT) AS n_yas FROM q, v GROUP BY variant"""))
def grade_thresholds(spark: SparkSession, d: str) -> DataFrame:
    g = graphs(spark, d)
    nodes, _ = fold.grade_variants(g["pn"], g["pe"])
    return nodes.groupBy("variant").agg(F.count_if(G.is_relation(F.col("type"))).alias("n_relations"), F.count_if(F.col("type") == "YA").alias("n_yas"))


def _utterances(g: dict[str, DataFrame]) -> DataFrame:
    return g["t"].select(KEY, F.col("i").alias("idx"), F.col("role").alias("speaker"), "text")


@query("baseline_graph", duck("""SELECT graph_id, type, CAST(count(*) AS BIGINT) AS n, min(md5(text)) AS least FROM (SELECT graph_id, 'L' AS type, concat(role, ' : ', text) AS text FROM t UNION ALL SELECT graph_id, 'I', text FROM t UNION ALL SELECT graph_id, 'YA', '' FROM t UNION ALL SELECT graph_id, 'TA', '' FROM t WHERE i > 0) GROUP BY ALL"""))
def baseline_graph(spark: SparkSession, d: str) -> DataFrame:
    nodes, _ = build.baseline(_utterances(graphs(spark, d)))
    return nodes.groupBy(KEY, "type").agg(F.count("*").alias("n"), F.min(F.md5(F.encode("text", "UTF-8"))).alias("least"))


@query("adjacent_relations", duck("SELECT graph_id, concat('I', CAST(i AS VARCHAR)) AS from_id, concat('I', CAST(lag(i) OVER (PARTITION BY graph_id ORDER BY i) AS VARCHAR)) AS to_id, 'support' AS kind FROM tp QUALIFY lag(i) OVER (PARTITION BY graph_id ORDER BY i) IS NOT NULL"))
def adjacent_relations(spark: SparkSession, d: str) -> DataFrame:
    g = graphs(spark, d)
    return build.adjacent_relations(fold.proposition_order(g["pn"], g["pe"]))


@query("candidate_pairs", duck(", o AS (SELECT graph_id, i, row_number() OVER (PARTITION BY graph_id ORDER BY i) - 1 AS x FROM tp) SELECT a.graph_id, a.x AS i, b.x AS j, concat('I', CAST(a.i AS VARCHAR)) AS a, concat('I', CAST(b.i AS VARCHAR)) AS b FROM o a JOIN o b ON a.graph_id = b.graph_id AND b.x > a.x AND b.x <= a.x + 4"))
def candidate_pairs(spark: SparkSession, d: str) -> DataFrame:
    g = graphs(spark, d)
    return build.candidate_pairs(fold.proposition_order(g["pn"], g["pe"]))


_VERDICT = ", o AS (SELECT graph_id, i, row_number() OVER (PARTITION BY graph_id ORDER BY i) - 1 AS x FROM tp), cp AS (SELECT a.graph_id, a.x AS i, b.x AS j, concat('I', CAST(a.i AS VARCHAR)) AS a, concat('I', CAST(b.i AS VARCHAR)) AS b FROM o a JOIN o b ON a.graph_id = b.graph_id AND b.x > a.x AND b.x <= a.x + 4) "


@query("candidate_verdicts", duck(_VERDICT + "SELECT graph_id, CASE WHEN (i + j) % 2 = 0 THEN b ELSE a END AS from_id, CASE WHEN (i + j) % 2 = 0 THEN a ELSE b END AS to_id, CASE (i * 3 + j) % 4 WHEN 1 THEN 'RA' WHEN 2 THEN 'CA' ELSE 'MA' END AS type FROM cp WHERE (i * 3 + j) % 4 <> 0"))
def candidate_verdicts(spark: SparkSession, d: str) -> DataFrame:
    g = graphs(spark, d)
    pairs = build.candidate_pairs(fold.proposition_order(g["pn"], g["pe"]))
    r = (F.col("i") * 3 + F.col("j")) % 4
    kind = F.when(r == 0, "none").when(r == 1, "RA").when(r == 2, "CA").otherwise("MA")
    said = pairs.select(KEY, "i", "j", F.explode(F.array(F.struct(F.lit(0).alias("seq"), kind.alias("type"), F.when((F.col("i") + F.col("j")) % 2 == 0, "later").otherwise("earlier").alias("source")), F.struct(F.lit(1).alias("seq"), F.lit("none").alias("type"), F.lit("later").alias("source")))).alias("v")).select(KEY, "i", "j", "v.*")
    return build.verdict_relations(pairs, said)


@query("assembled_graph", duck(""", f AS (SELECT graph_id, i AS src, greatest(i - 1 - i % 2, 0) AS dst, CASE i % 3 WHEN 0 THEN 'RA' WHEN 1 THEN 'CA' ELSE 'MA' END AS type FROM t WHERE i > 0 AND i % 4 <> 3 AND (i - 1 - i % 2) % 4 <> 3),
x AS (SELECT graph_id, CASE WHEN i % 4 <> 3 THEN 1 ELSE 0 END AS has, i FROM t) SELECT graph_id, CAST(sum(l) AS BIGINT) AS n_l, CAST(sum(p) AS BIGINT) AS n_i, CAST(sum(y) AS BIGINT) AS n_ya, CAST(sum(s) AS BIGINT) AS n_s FROM (SELECT graph_id, 1 AS l, has AS p, has AS y, 0 AS s FROM x UNION ALL SELECT graph_id, 0, 0, CASE WHEN abs(src - dst) = 1 THEN 1 ELSE 0 END, 1 FROM f WHERE src <> dst) GROUP BY 1"""))
def assembled_graph(spark: SparkSession, d: str) -> DataFrame:
    u = _utterances(graphs(spark, d))
    items = u.select(KEY, "idx", F.explode(F.array(F.struct(F.lit(0).alias("seq"), F.when(F.col("idx") % 4 == 3, "").otherwise(F.concat(F.lit("p "), F.col("text"))).alias("proposition"), F.lit("Asserting").alias("force")), F.struct(F.lit(1).alias("seq"), F.lit("late").alias("proposition"), F.lit("odd").alias("force")))).alias("x")).select(KEY, "idx", "x.*")
    i = F.col("idx")
    found = u.filter("idx > 0").select(KEY, i.alias("src"), F.greatest(i - 1 - i % 2, F.lit(0)).alias("dst"), F.when(i % 3 == 0, "RA").when(i % 3 == 1, "CA").otherwise("MA").alias("type"), F.lit("Arguing").alias("force"), i.alias("seq"))
    nodes, _ = build.assemble(u, items, found.unionByName(found.withColumn("seq", F.col("seq") + 100)))
    return nodes.groupBy(KEY).agg(F.count_if(F.col("type") == "L").alias("n_l"), F.count_if(F.col("type") == "I").alias("n_i"), F.count_if(F.col("type") == "YA").alias("n_ya"), F.count_if(G.is_relation(F.col("type"))).alias("n_s"))


@query("relation_verify_prune", duck(RELS + "SELECT graph_id, CAST(count(*) AS BIGINT) AS n FROM pr WHERE i % 3 <> 1 GROUP BY 1"))
def relation_verify_prune(spark: SparkSession, d: str) -> DataFrame:
    found = graphs(spark, d)["tp"].filter("has").select(KEY, F.col("i").alias("k"))
    kept = build.prune(found, found.select(KEY, "k", (F.col("k") % 3 != 1).alias("keep")).unionByName(found.select(KEY, (F.col("k") + 1000).alias("k"), F.lit(False).alias("keep"))))
    return kept.groupBy(KEY).agg(F.count("*").alias("n"))


# ---- Similarities, assignment, distances.

VECTORS = """, ne AS (SELECT count(*) AS n FROM embeddings),
pv AS (SELECT graph_id, i, CAST(embedding AS DOUBLE[]) AS v FROM tp, ne JOIN embeddings e ON e.vec_id = (c * 8 + i + CASE WHEN (c * 13 + i * 7) % 4 = 0 THEN 1 ELSE 0 END) % n), gv AS (SELECT graph_id, i, CAST(embedding AS DOUBLE[]) AS v FROM tg, ne JOIN embeddings e ON e.vec_id = (c * 8 + i) % n),
sim AS (SELECT p.graph_id, p.i AS a, g.i AS b, list_inner_product(p.v, g.v) / (sqrt(list_inner_product(p.v, p.v)) * sqrt(list_inner_product(g.v, g.v))) AS cos FROM pv p JOIN gv g USING (graph_id)) """


def _similarities(spark: SparkSession, d: str, g: dict[str, DataFrame]) -> DataFrame:
    """(graph_id, a_pos, b_pos, a, b, cos): propositions of both graphs, vectors by residue of the turn."""
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding")
    n = F.lit(e.count())
    vector = lambda t, shift, name: g[t].select(KEY, F.col("i").alias(f"{name}_pos"), F.concat(F.lit("I"), F.col("i")).alias(name), ((F.col("c") * 8 + F.col("i") + shift) % n).alias("vec_id")).join(e, "vec_id").withColumnRenamed("embedding", f"{name}v").drop("vec_id")
    p = vector("tp", F.when((F.col("c") * 13 + F.col("i") * 7) % 4 == 0, 1).otherwise(0), "a")
    return p.join(vector("tg", F.lit(0), "b"), KEY).select(KEY, "a_pos", "b_pos", "a", "b", G.cosine(F.col("av"), F.col("bv")).alias("cos"))


def _matched(sim: DataFrame) -> DataFrame:
    table = sim.select(F.col(KEY).alias("cmp_id"), "a_pos", "b_pos", "a", "b", F.greatest(F.lit(0.0), 1 - F.greatest(F.lit(0.0), F.col("cos"))).alias("cost"), F.lit(1.0).alias("delete"), F.lit(1.0).alias("insert"))
    return assign.match(table).select(F.col("cmp_id").alias(KEY), "a", "b", "cost")


@query("cosine_pairs", duck(VECTORS + "SELECT graph_id, concat('I', CAST(a AS VARCHAR)) AS a, concat('I', CAST(b AS VARCHAR)) AS b, round(cos, 6) AS cos FROM sim"))
def cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _similarities(spark, d, graphs(spark, d)).select(KEY, "a", "b", F.round("cos", 6).alias("cos"))


@query("substitution_costs", """WITH s(a, sa) AS (VALUES ('I', ''), ('L', ''), ('RA', 'Default Inference'), ('CA', 'Default Conflict'), ('MA', 'Default Rephrase'), ('TA', ''), ('YA', 'Asserting'), ('YA', 'Arguing'), ('YA', 'Challenging'), ('YA', 'Agreeing')), f AS (SELECT *, CASE WHEN sa IN ('Asserting', 'Arguing') THEN 1 WHEN sa = 'Challenging' THEN 2 WHEN sa = 'Agreeing' THEN 3 ELSE 4 END AS fam FROM s)
SELECT x.a AS type_a, x.sa AS scheme_a, y.a AS type_b, y.sa AS scheme_b, CAST(CASE WHEN x.a = y.a AND x.a IN ('I', 'L') THEN 0.75 WHEN x.a = y.a AND x.a = 'YA' THEN CASE WHEN x.sa = y.sa THEN 0 WHEN x.fam = y.fam THEN 0.5 ELSE 1 END WHEN x.a = y.a THEN 0 WHEN x.a IN ('RA', 'CA', 'MA') AND y.a IN ('RA', 'CA', 'MA') THEN 0.75 ELSE 1000000 END AS DOUBLE) AS cost FROM f x, f y""")
def substitution_costs(spark: SparkSession, d: str) -> DataFrame:
    rows = [("I", ""), ("L", ""), ("RA", "Default Inference"), ("CA", "Default Conflict"), ("MA", "Default Rephrase"), ("TA", ""), ("YA", "Asserting"), ("YA", "Arguing"), ("YA", "Challenging"), ("YA", "Agreeing")]
    both = spark.createDataFrame([(*a, *b) for a in rows for b in rows], "type_a string, scheme_a string, type_b string, scheme_b string")
    return both.withColumn("cost", G.substitution_cost(*(F.col(c) for c in ("type_a", "type_b", "scheme_a", "scheme_b")), F.lit(0.25)))


@query("assignment_cost", duck(VECTORS.rstrip() + """, pi AS (SELECT graph_id, a, row_number() OVER (PARTITION BY graph_id ORDER BY a) - 1 AS r FROM (SELECT DISTINCT graph_id, a FROM sim)), gi AS (SELECT graph_id, b, row_number() OVER (PARTITION BY graph_id ORDER BY b) - 1 AS q, count(*) OVER (PARTITION BY graph_id) AS m FROM (SELECT DISTINCT graph_id, b FROM sim)),
cell AS (SELECT graph_id, r, q, m, greatest(0, 1 - greatest(0, cos)) AS cost FROM sim JOIN pi USING (graph_id, a) JOIN gi USING (graph_id, b)),
dp AS (SELECT graph_id, r, bit, min(s) AS s FROM (SELECT 1) JOIN (SELECT graph_id, CAST(0 AS BIGINT) AS r, CAST(1 AS BIGINT) << q AS bit, cost AS s FROM cell WHERE r = 0) ON true GROUP BY ALL) """ + """
SELECT graph_id, round(min(s) + (m - n), 6) AS cost FROM (WITH RECURSIVE z AS (SELECT graph_id, CAST(-1 AS BIGINT) AS r, CAST(0 AS BIGINT) AS mask, CAST(0 AS DOUBLE) AS s FROM (SELECT DISTINCT graph_id FROM cell)
UNION ALL SELECT graph_id, r, mask, min(s) FROM (SELECT z.graph_id, cell.r, z.mask | (CAST(1 AS BIGINT) << q) AS mask, z.s + cost AS s FROM z JOIN cell ON cell.graph_id = z.graph_id AND cell.r = z.r + 1 WHERE z.mask & (CAST(1 AS BIGINT) << q) = 0) GROUP BY ALL)
SELECT * FROM z) JOIN (SELECT graph_id, max(r) + 1 AS n, max(m) AS m FROM cell GROUP BY 1) k USING (graph_id) WHERE r = n - 1 GROUP BY graph_id, m, n"""))
def assignment_cost(spark: SparkSession, d: str) -> DataFrame:
    g = graphs(spark, d)
    got = _matched(_similarities(spark, d, g)).groupBy(KEY).agg(F.sum("cost").alias("s"), F.count("*").alias("k"))
    sizes = g["tg"].groupBy(KEY).agg(F.count("*").alias("m"))
    return got.join(sizes, KEY).select(KEY, F.round(F.col("s") + F.col("m") - F.col("k"), 6).alias("cost"))


@query("max_matching_above_threshold")
def max_matching_above_threshold(spark: SparkSession, d: str) -> DataFrame:
    sim = _similarities(spark, d, graphs(spark, d)).withColumnRenamed(KEY, "cmp_id")
    return assign.matched_above(sim, vocab.THRESHOLDS)


@query("edge_edit_breakdown", duck(MATCHED + "SELECT graph_id, CAST(correct AS BIGINT) AS exact, CAST(mistyped AS BIGINT) AS type_substituted, CAST(reversed AS BIGINT) AS direction_substituted, CAST(pred_total - correct - mistyped - reversed AS BIGINT) AS inserted, CAST(gold_total - correct - mistyped - reversed AS BIGINT) AS deleted, CAST(mistyped * 0.75 + reversed + (pred_total + gold_total - 2 * (correct + mistyped + reversed)) AS DOUBLE) AS edge_cost FROM rc"))
def edge_edit_breakdown(spark: SparkSession, d: str) -> DataFrame:
    g = graphs(spark, d)
    return ged.edge_breakdown(fold.relation_edges(g["pn"], g["pe"]), fold.relation_edges(g["gn"], g["ge"]), _same(g), True, KEY)


@query("proposition_distance", duck(MATCHED + """, nn AS (SELECT graph_id, sum(p) AS p, sum(g) AS g FROM (SELECT graph_id, 1 AS p, 0 AS g FROM tp UNION ALL SELECT graph_id, 0, 1 FROM tg) GROUP BY 1),
x AS (SELECT graph_id, CAST(g - p + coalesce(mistyped * 0.75 + reversed + pred_total + gold_total - 2 * (correct + mistyped + reversed), 0) AS DOUBLE) AS ged, CAST(g + coalesce(gold_total, 0) AS DOUBLE) AS gold_cost, CAST(p + g + coalesce(pred_total + gold_total, 0) AS DOUBLE) AS denominator FROM nn LEFT JOIN rc USING (graph_id))
SELECT graph_id, ged, gold_cost, denominator, round(1 - ged / denominator, 6) AS similarity, round(1 - ged / gold_cost, 6) AS similarity_gold FROM x"""))
def proposition_distance(spark: SparkSession, d: str) -> DataFrame:
    g = graphs(spark, d)
    same = _same(g)
    only = lambda n: g[n].filter("type = 'I'")
    out = ged.distance(only("pn"), only("gn"), fold.relation_edges(g["pn"], g["pe"]), fold.relation_edges(g["gn"], g["ge"]), same, same.withColumn("cos", F.lit(1.0)), True, key=KEY)
    return out.select(KEY, "ged", "gold_cost", "denominator", F.round("similarity", 6).alias("similarity"), F.round("similarity_gold", 6).alias("similarity_gold"))


@query("ged_by_version")
def ged_by_version(spark: SparkSession, d: str) -> DataFrame:
    g = graphs(spark, d)
    sim = _similarities(spark, d, g)
    cos = sim.select(KEY, "a", "b", "cos")
    cos = cos.unionByName(cos.select(KEY, F.replace("a", F.lit("I"), F.lit("L")).alias("a"), F.replace("b", F.lit("I"), F.lit("L")).alias("b"), "cos"))
    pred, gold, cos, out = (g["pn"], g["pe"]), (g["gn"], g["ge"]), written(cos, "cos"), None
    raw = written(ged.assign_all(g["pn"], g["gn"], cos), "raw")
    derived = written(ged.derive(pred, gold, raw, KEY), "derived")
    for metric in vocab.METRICS:
        full, reduced = ged.compare(pred, gold, raw, cos, metric, derived=derived)
        row = full.select(KEY, F.lit(metric).alias("metric"), F.round("ged", 6).alias("full_ged"), F.round("similarity_gold", 6).alias("full_similarity_gold")).join(reduced.select(KEY, F.round("ged", 6).alias("reduced_ged"), F.round("similarity", 6).alias("reduced_similarity")), KEY)
        row = written(row, metric)
        out = row if out is None else out.unionByName(row)
    return out


# ---- Diagnostics and summaries.


@query("type_confusion", duck(RELS + """, u AS (SELECT graph_id, src, dst, pr.type AS pt, gr.type AS gt FROM pr JOIN gr USING (graph_id, src, dst)) SELECT pt AS pred_type, gt AS gold_type, CAST(count(*) AS BIGINT) AS n FROM u GROUP BY ALL"""))
def type_confusion(spark: SparkSession, d: str) -> DataFrame:
    return score.type_confusion(_scored(spark, d)[1])


@query("force_accuracy", duck("""SELECT p.force AS pred_force, g.force AS gold_force, CAST(count(*) AS BIGINT) AS n FROM tp p JOIN tg g USING (graph_id, i) GROUP BY ALL"""))
def force_accuracy(spark: SparkSession, d: str) -> DataFrame:
    g = graphs(spark, d)
    return score.force_pairs(score.forces(g["pn"], g["pe"]), score.forces(g["gn"], g["ge"]), _same(g)).groupBy("pred_force", "gold_force").agg(F.count("*").alias("n"))


@query("pair_similarity_means", duck(RELS.rstrip() + VECTORS + """, pc AS (SELECT x.graph_id, x.i AS src, y.i AS dst, list_inner_product(x.v, y.v) / (sqrt(list_inner_product(x.v, x.v)) * sqrt(list_inner_product(y.v, y.v))) AS cos FROM gv x JOIN gv y USING (graph_id)), h AS (SELECT DISTINCT graph_id, src, dst, type FROM pr),
z AS (SELECT pr.graph_id, CASE WHEN EXISTS (SELECT 1 FROM gr g WHERE g.graph_id = pr.graph_id AND g.src = pr.src AND g.dst = pr.dst AND g.type = pr.type) THEN 'correct' WHEN EXISTS (SELECT 1 FROM gr g WHERE g.graph_id = pr.graph_id AND least(g.src, g.dst) = least(pr.src, pr.dst) AND greatest(g.src, g.dst) = greatest(pr.src, pr.dst)) THEN 'other' ELSE 'spurious' END AS list, src, dst FROM pr)
SELECT list, CAST(count(*) AS BIGINT) AS n, round(avg(cos), 6) AS mean_cos FROM z JOIN pc USING (graph_id, src, dst) WHERE list <> 'other' GROUP BY list"""))
def pair_similarity_means(spark: SparkSession, d: str) -> DataFrame:
    g, outcomes, gold = _scored(spark, d)
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding")
    v = g["tg"].select(KEY, F.concat(F.lit("I"), F.col("i")).alias("id"), ((F.col("c") * 8 + F.col("i")) % F.lit(e.count())).alias("vec_id")).join(e, "vec_id")
    cos = v.select(KEY, F.col("id").alias("src"), F.col("embedding").alias("x")).join(v.select(KEY, F.col("id").alias("dst"), F.col("embedding").alias("y")), KEY).select(KEY, "src", "dst", G.cosine(F.col("x"), F.col("y")).alias("cos"))
    rows = score.pair_similarity(outcomes, gold, cos, cos).filter("list <> 'missed'").withColumn("s", F.col("mean_cos") * F.col("n"))
    return rows.groupBy("list").agg(F.sum("n").alias("n"), F.round(F.sum("s") / F.sum("n"), 6).alias("mean_cos"))


@query("best_worst_pairs", duck(VECTORS + """, m AS (SELECT graph_id, concat('I', CAST(a AS VARCHAR)) AS a, cos FROM sim WHERE a = b), r AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY cos DESC, a) AS up, row_number() OVER (PARTITION BY graph_id ORDER BY cos, a DESC) AS down FROM m)
SELECT graph_id, 'best' AS list, up AS rank, a, round(cos, 6) AS cos FROM r WHERE up <= 2 UNION ALL SELECT graph_id, 'worst', down, a, round(cos, 6) FROM r WHERE down <= 2 AND up > 2"""))
def best_worst_pairs(spark: SparkSession, d: str) -> DataFrame:
    same = _similarities(spark, d, graphs(spark, d)).filter("a = b").select(KEY, "a", "b", "cos")
    return score.best_and_worst(same, 2).select(KEY, "list", "rank", "a", F.round("cos", 6).alias("cos"))


@query("macro_micro_summary", duck(MATCHED + """, s AS (SELECT count(*) AS n, avg(CASE WHEN pred_total + gold_total > 0 THEN 2.0 * correct / (pred_total + gold_total) ELSE 0 END) AS f, sum(correct) AS c, sum(pred_total) AS p, sum(gold_total) AS g FROM rc)
SELECT n, round(f, 6) AS macro_f1, round(c / CAST(p AS DOUBLE), 6) AS micro_precision, round(c / CAST(g AS DOUBLE), 6) AS micro_recall, round(2.0 * c / (p + g), 6) AS micro_f1 FROM s"""))
def macro_micro_summary(spark: SparkSession, d: str) -> DataFrame:
    _, outcomes, gold = _scored(spark, d)
    rows = score.relation_scores(_counts(outcomes, gold)).withColumn("f1", F.col("typed_f1"))
    return report.macro_micro(rows, []).select("n", *(F.round(c, 6).alias(c) for c in ("macro_f1", "micro_precision", "micro_recall", "micro_f1")))


@query("threshold_curve")
def threshold_curve(spark: SparkSession, d: str) -> DataFrame:
    g = graphs(spark, d)
    above = assign.matched_above(_similarities(spark, d, g).withColumnRenamed(KEY, "cmp_id"), vocab.THRESHOLDS).withColumnRenamed("cmp_id", KEY)
    sizes = g["tp"].groupBy(KEY).agg(F.count("*").alias("n_pred")).join(g["tg"].groupBy(KEY).agg(F.count("*").alias("n_gold")), KEY)
    return report.curve(score.threshold_curve(sizes, above), []).select("threshold", F.round("f1", 6).alias("f1"))


@query("error_budget", duck(MATCHED + "SELECT CAST(sum(correct) AS BIGINT) AS correct, CAST(sum(mistyped) AS BIGINT) AS mistyped, CAST(sum(reversed) AS BIGINT) AS reversed, CAST(sum(gold_total - correct - mistyped - reversed) AS BIGINT) AS missed, CAST(sum(pred_total - correct - mistyped - reversed) AS BIGINT) AS spurious FROM rc"))
def error_budget(spark: SparkSession, d: str) -> DataFrame:
    _, outcomes, gold = _scored(spark, d)
    return report.error_budget(_counts(outcomes, gold))


@query("evidence_lists", duck(RELS + """, z AS (SELECT graph_id, i, type, src, dst, CASE WHEN EXISTS (SELECT 1 FROM gr g WHERE g.graph_id = pr.graph_id AND least(g.src, g.dst) = least(pr.src, pr.dst) AND greatest(g.src, g.dst) = greatest(pr.src, pr.dst)) THEN 'other' ELSE 'spurious' END AS list FROM pr)
SELECT graph_id, list, rank, concat('I', CAST(src AS VARCHAR)) AS src, concat('I', CAST(dst AS VARCHAR)) AS dst, type FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY i) AS rank FROM z WHERE list = 'spurious') WHERE rank <= 8"""))
def evidence_lists(spark: SparkSession, d: str) -> DataFrame:
    _, outcomes, gold = _scored(spark, d)
    return score.evidence(outcomes, gold).filter("list = 'spurious'")


@query("grade_distribution", duck(RELS + "SELECT grade, CAST(count(*) AS BIGINT) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM pr GROUP BY grade"))
def grade_distribution(spark: SparkSession, d: str) -> DataFrame:
    rows = graphs(spark, d)["pn"].filter(G.is_relation(F.col("type"))).select(F.col("confidence").alias("grade"))
    return report.shares(rows, [], "grade").select("grade", "n", F.round("percent", 6).alias("percent"))


@query("locution_texts", duck("SELECT graph_id, concat('L', CAST(i AS VARCHAR)) AS node_id, role AS speaker, md5(text) AS body FROM tg"))
def locution_texts(spark: SparkSession, d: str) -> DataFrame:
    n = graphs(spark, d)["gn"].filter("type = 'L'")
    return n.select(KEY, "node_id", G.speaker_of(F.lit(""), F.col("text")).alias("speaker"), F.md5(F.encode(G.locution_text(F.col("text")), "UTF-8")).alias("body"))
