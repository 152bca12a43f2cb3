"""Named queries over events, documents, conversations and small parameter tables, with the same results as SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from disputa.functions import graph as G
from disputa.functions import vocab
from disputa.operators import cache, calibrate, report, stats, text
from disputa.plans.catalog import query
from disputa.plans.graph_queries import MATCHED
from disputa.plans.testgraphs import duck, graphs
from disputa.sources import nodesets
from disputa.sources.scratch import written

SERIES = "WITH s AS (SELECT user_id, event_type AS c, avg(value) AS v FROM events GROUP BY ALL), b AS (SELECT x.c AS c1, y.c AS c2, x.user_id AS unit, x.v AS x, y.v AS y, x.v - y.v AS diff FROM s x JOIN s y USING (user_id) WHERE x.c <> y.c) "


def _series(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").groupBy("user_id", F.col("event_type").alias("c")).agg(F.avg("value").alias("v"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return stats.paired(_series(spark, d), "user_id", "c", "v").withColumn("diff", F.round("diff", 9))


@query("describe", "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS sd, min(value) AS min, max(value) AS max FROM events GROUP BY 1")
def describe(spark: SparkSession, d: str) -> DataFrame:
    rows = stats.describe(spark.read.parquet(f"{d}/events.parquet"), ["event_type"], "value")
    return rows.select("event_type", "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "min", "max")


@query("wilcoxon_stats", SERIES + """, u AS (SELECT c1, c2, round(diff, 9) AS diff, abs(round(diff, 9)) AS size FROM b WHERE round(diff, 9) <> 0), r AS (SELECT *, rank() OVER (PARTITION BY c1, c2 ORDER BY size) + (count(*) OVER (PARTITION BY c1, c2, size) - 1) / 2.0 AS r FROM u),
w AS (SELECT c1, c2, count(*) AS n, coalesce(sum(r) FILTER (WHERE diff > 0), 0) AS wp, coalesce(sum(r) FILTER (WHERE diff < 0), 0) AS wm FROM r GROUP BY ALL)
SELECT c1, c2, n, round(CAST(wp AS DOUBLE), 6) AS w_plus, round(CAST(wm AS DOUBLE), 6) AS w_minus, round(least(0, (least(wp, wm) - n * (n + 1) / 4.0 + 0.5) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0)), 6) AS z FROM w WHERE (SELECT count(*) FROM b WHERE b.c1 = w.c1 AND b.c2 = w.c2) >= 3""")
def wilcoxon_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = stats.wilcoxon(_pairs(spark, d), ["c1", "c2"])
    return rows.select("c1", "c2", "n", *(F.round(c, 6).alias(c) for c in ("w_plus", "w_minus", "z")))


@query("cliffs_delta", SERIES + "SELECT a.c1, a.c2, round(avg(sign(a.x - e.y)), 6) AS delta FROM b a JOIN b e ON a.c1 = e.c1 AND a.c2 = e.c2 GROUP BY ALL HAVING count(*) >= 9")
def cliffs_delta(spark: SparkSession, d: str) -> DataFrame:
    return stats.cliffs_delta(_pairs(spark, d), ["c1", "c2"]).select("c1", "c2", F.round("delta", 6).alias("delta"))


@query("holm", """WITH t AS (SELECT l_returnflag AS family, l_shipmode AS name, CAST(0 AS DOUBLE) AS p FROM (SELECT '' AS l_returnflag, '' AS l_shipmode) WHERE false UNION ALL SELECT 'f', event_type, round((count(*) % 97) / 1000.0, 6) FROM events GROUP BY event_type),
r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, name) AS k, count(*) OVER (PARTITION BY family) AS n FROM t) SELECT family, name, p, round(max(least(1, (n - k + 1) * p)) OVER (PARTITION BY family ORDER BY k), 6) AS p_holm FROM r""")
def holm(spark: SparkSession, d: str) -> DataFrame:
    tests = spark.read.parquet(f"{d}/events.parquet").groupBy("event_type").agg(F.round((F.count("*") % 97) / 1000.0, 6).alias("p")).select(F.lit("f").alias("family"), F.col("event_type").alias("name"), "p")
    return stats.holm(tests, ["family"], "p", ["name"]).withColumn("p_holm", F.round("p_holm", 6))


@query("bootstrap_ci_md5", """WITH v AS (SELECT event_type, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events),
d AS (SELECT event_type, b, CAST(concat('0x', substr(md5(concat_ws(':', '1', CAST(b AS VARCHAR), CAST(i AS VARCHAR))), 1, 8)) AS BIGINT) % n AS i FROM v, range(100) r(b)),
m AS (SELECT event_type, b, round(avg(v.v), 9) AS m FROM d JOIN v USING (event_type, i) GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY m, b) - 1 AS r FROM m)
SELECT event_type, round(max(m) FILTER (WHERE r = 2), 6) AS low, round(max(m) FILTER (WHERE r = 96), 6) AS high FROM k GROUP BY 1""")
def bootstrap_ci_md5(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/events.parquet")
    out = stats.bootstrap_ci(rows, ["event_type"], "value", "event_id", replicates=100, alpha=0.05, seed=1)
    return out.select("event_type", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("paired_comparisons")
def paired_comparisons(spark: SparkSession, d: str) -> DataFrame:
    rows = _series(spark, d).withColumn("metric", F.lit("value"))
    return stats.compare_all(rows, "user_id", "c", "metric", "v", replicates=200)


@query("common_units", "SELECT user_id FROM events GROUP BY user_id HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events)")
def common_units(spark: SparkSession, d: str) -> DataFrame:
    return report.common_units(spark.read.parquet(f"{d}/events.parquet"), "user_id", "event_type")


_TRANSCRIPT = "SELECT CAST(conv_id AS VARCHAR) AS doc, string_agg(role || chr(10) || '[0:' || lpad(CAST(turn AS VARCHAR), 2, '0') || ':00] ' || coalesce(text, ''), chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1"


@query("transcript_turns", r"""WITH r AS (SELECT CAST(conv_id AS VARCHAR) AS doc, CAST(turn + 1 AS BIGINT) AS turn, role AS speaker, '[0:' || lpad(CAST(turn AS VARCHAR), 2, '0') || ':00]' AS stamp, coalesce(text, '') AS text FROM conversations),
l AS (SELECT doc, turn, speaker, stamp, i, trim(x, ' ' || chr(9) || chr(13)) AS line FROM (SELECT doc, turn, speaker, stamp, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM r))
SELECT doc, turn, speaker, stamp, md5(coalesce(string_agg(line, ' ' ORDER BY i) FILTER (WHERE i = 1 OR (line <> '' AND NOT regexp_matches(line, '^(Part \d+|Words: \d+|\d{1,2}:\d{2}|[a-z0-9_+-]+)$'))), '')) AS body FROM l GROUP BY ALL""")
def transcript_turns(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/conversations.parquet")
    line = F.concat(F.col("role"), F.lit("\n[0:"), F.lpad(F.col("turn").cast("string"), 2, "0"), F.lit(":00] "), F.coalesce("text", F.lit("")))
    docs = rows.groupBy(F.col("conv_id").cast("string").alias("doc")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))
    return text.turns(docs).select("doc", "turn", "speaker", "stamp", F.md5(F.encode("body", "UTF-8")).alias("body"))


@query("locate_utterances")
def locate_utterances(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/conversations.parquet").select(F.col("conv_id").cast("string").alias("doc"), F.col("turn").alias("idx"), F.coalesce("text", F.lit("")).alias("text"))
    docs = rows.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), "\n").alias("text"))
    places = written(text.located(docs, rows), "places")
    return places.join(text.excerpt_spans(places), "doc").select("doc", "idx", "start", "size", "first", "last", "n")


@query("cache_hit_miss", "WITH k AS (SELECT sha256(concat(CAST(strlen(text) AS VARCHAR), ':', text)) AS key, doc_id FROM documents WHERE text IS NOT NULL), c AS (SELECT DISTINCT key FROM k WHERE doc_id % 3 = 0) SELECT CAST((SELECT count(*) FROM k WHERE key IN (SELECT key FROM c)) AS BIGINT) AS hits, CAST((SELECT count(DISTINCT key) FROM k WHERE key NOT IN (SELECT key FROM c)) AS BIGINT) AS misses")
def cache_hit_miss(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet").filter("text IS NOT NULL")
    keyed = docs.select("doc_id", F.sha2(F.encode(F.concat(F.octet_length("text").cast("string"), F.lit(":"), "text"), "UTF-8"), 256).alias("key"))
    stored = keyed.filter("doc_id % 3 = 0").select("key").distinct().withColumn("answer", F.lit("x"))
    hits, misses = cache.split_hits(keyed, stored)
    return hits.agg(F.count("*").alias("hits")).crossJoin(misses.agg(F.count("*").alias("misses")))


_PRICES = [("small", 0.5, 0.25, 2.0), ("small-fast", 1.0, 0.5, 4.0), ("large", 5.0, 2.5, 20.0), ("large-x", 8.0, 4.0, 30.0)]
_PRICE_SQL = "WITH p(name, input, cached, output) AS (VALUES ('small', 0.5, 0.25, 2.0), ('small-fast', 1.0, 0.5, 4.0), ('large', 5.0, 2.5, 20.0), ('large-x', 8.0, 4.0, 30.0)), u AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'small-2' WHEN 1 THEN 'small-fast-1' WHEN 2 THEN 'large-1' WHEN 3 THEN 'large-x9' ELSE 'other' END AS model, event_id % 1000 AS i, event_id % 100 AS k, event_id % 300 AS o, event_type FROM events), "


def _usage(spark: SparkSession, d: str) -> DataFrame:
    e, r = spark.read.parquet(f"{d}/events.parquet"), F.col("event_id") % 5
    model = F.when(r == 0, "small-2").when(r == 1, "small-fast-1").when(r == 2, "large-1").when(r == 3, "large-x9").otherwise("other")
    return e.select("event_id", "event_type", model.alias("model"), (F.col("event_id") % 1000).alias("i"), (F.col("event_id") % 100).alias("k"), (F.col("event_id") % 300).alias("o"))


def _price_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_PRICES, "name string, input double, cached double, output double")


@query("price_prefix_match", _PRICE_SQL + "m AS (SELECT DISTINCT model FROM u) SELECT model, (SELECT max_by(name, length(name)) FROM p WHERE starts_with(model, name)) AS name FROM m")
def price_prefix_match(spark: SparkSession, d: str) -> DataFrame:
    return cache.priced(_usage(spark, d).select("model").distinct(), _price_table(spark)).select("model", "price.name")


@query("llm_cost", _PRICE_SQL + "m AS (SELECT u.*, (SELECT max_by(name, length(name)) FROM p WHERE starts_with(model, name)) AS name FROM u) SELECT event_type, CAST(count(*) AS BIGINT) AS calls, round(CAST(coalesce(sum(((i - least(k, i)) * input + least(k, i) * cached + o * output) / 1e6), 0) AS DOUBLE), 6) AS dollars FROM m LEFT JOIN p USING (name) GROUP BY 1")
def llm_cost(spark: SparkSession, d: str) -> DataFrame:
    used = _usage(spark, d)
    price = cache.priced(used.select("model").distinct(), _price_table(spark))
    dollars = cache.cost(F.col("i"), F.least("k", "i"), F.col("o"), F.col("price"))
    return used.join(price, "model").groupBy("event_type").agg(F.count("*").alias("calls"), F.round(F.coalesce(F.sum(dollars), F.lit(0.0)), 6).alias("dollars"))


@query("sample_split", "SELECT doc_id FROM (SELECT doc_id, md5(concat('s1:', CAST(doc_id AS VARCHAR))) AS h FROM documents WHERE lang = 'en') ORDER BY h, doc_id LIMIT 50")
def sample_split(spark: SparkSession, d: str) -> DataFrame:
    return nodesets.sample(spark.read.parquet(f"{d}/documents.parquet").filter("lang = 'en'").select("doc_id"), "doc_id", "s1", 50)


@query("fingerprints", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return nodesets.fingerprints(spark.read.parquet(f"{d}/documents.parquet"), "doc_id", "text")


# ---- Judgments and the learnable distance.

_JUDGED = "WITH j AS (SELECT conv_id * 8 + turn AS triplet_id, CAST(jj AS INTEGER) AS judge, CAST(oo AS INTEGER) AS ord, CAST((conv_id * 7 + turn * 5 + jj * 3 + CASE WHEN jj = 1 THEN oo ELSE 0 END + 9) % 3 AS INTEGER) AS answer FROM conversations, range(3) a(jj), (VALUES (1), (-1)) b(oo)) "


def _judgments(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", F.explode(F.array(*(F.lit(j) for j in range(3)))).alias("judge")).withColumn("ord", F.explode(F.array(F.lit(1), F.lit(-1))))
    answer = (F.col("conv_id") * 7 + F.col("turn") * 5 + F.col("judge") * 3 + F.when(F.col("judge") == 1, F.col("ord")).otherwise(0) + 9) % 3
    return rows.select((F.col("conv_id") * 8 + F.col("turn")).alias("triplet_id"), "judge", "ord", answer.cast("int").alias("answer"))


_MAJ = _JUDGED + ", n AS (SELECT triplet_id, answer, count(*) AS n FROM j GROUP BY ALL), m AS (SELECT triplet_id, CASE WHEN count(*) FILTER (WHERE n = t) = 1 THEN max(answer) FILTER (WHERE n = t) END AS majority FROM (SELECT *, max(n) OVER (PARTITION BY triplet_id) AS t FROM n) GROUP BY 1) "


@query("majority_vote", _MAJ + "SELECT triplet_id, majority FROM m")
def majority_vote(spark: SparkSession, d: str) -> DataFrame:
    return calibrate.majority(_judgments(spark, d))


@query("agreement_rate", _MAJ + "SELECT count(*) AS n, round(avg(CASE WHEN triplet_id % 5 = 2 THEN 0.5 WHEN (CASE WHEN triplet_id % 5 > 2 THEN 0 ELSE 1 END) = majority THEN 1.0 ELSE 0.0 END), 6) AS rate FROM m WHERE majority < 2")
def agreement_rate(spark: SparkSession, d: str) -> DataFrame:
    votes = calibrate.majority(_judgments(spark, d))
    deltas = votes.select("triplet_id", (F.col("triplet_id") % 5 - 2).cast("double").alias("delta"))
    return calibrate.agreement(deltas, votes).select("n", F.round("rate", 6).alias("rate"))


@query("judge_diagnostics", _JUDGED + ", c AS (SELECT judge, triplet_id, count(DISTINCT answer) AS a FROM j GROUP BY ALL HAVING count(DISTINCT ord) = 2) SELECT j.judge, count(*) AS n, round(100.0 * avg(CASE WHEN answer = 2 THEN 1 ELSE 0 END), 6) AS tie_percent, round((SELECT avg(CASE WHEN a = 1 THEN 1.0 ELSE 0 END) FROM c WHERE c.judge = j.judge), 6) AS consistency FROM j GROUP BY j.judge")
def judge_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return calibrate.judge_diagnostics(_judgments(spark, d)).select("judge", "n", F.round("tie_percent", 6).alias("tie_percent"), F.round("consistency", 6).alias("consistency"))


@query("answer_distribution", _JUDGED + "SELECT answer, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM j GROUP BY answer")
def answer_distribution(spark: SparkSession, d: str) -> DataFrame:
    return report.shares(_judgments(spark, d), [], "answer").select("answer", "n", F.round("percent", 6).alias("percent"))


@query("substitution_basis", "SELECT x, round(least(1, greatest(0, (1 - x) / 0.1)) * 0.1 + least(1, greatest(0, (0.9 - x) / 0.2)) * 0.2 + least(1, greatest(0, (0.7 - x) / 0.2)) * 0.2 + least(1, greatest(0, (0.5 - x) / 0.2)) * 0.2, 6) AS cost FROM (SELECT CAST(i AS DOUBLE) / 20 AS x FROM range(21) r(i))")
def substitution_basis(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(21).select((F.col("id").cast("double") / 20).alias("x")).select("x", F.round(calibrate.substitution(F.col("x")), 6).alias("cost"))


@query("judgment_nll", _JUDGED + ", z AS (SELECT judge, answer, CAST(triplet_id % 7 AS DOUBLE) / 2 - 1.5 AS z, 0.4 AS t FROM j), p AS (SELECT judge, answer, 1 / (1 + exp(-(z - t))) AS a, 1 / (1 + exp(z + t)) AS b FROM z) SELECT judge, round(-sum(ln(CASE answer WHEN 0 THEN a WHEN 1 THEN b ELSE greatest(1 - a - b, 1e-12) END)), 4) AS nll FROM p GROUP BY judge")
def judgment_nll(spark: SparkSession, d: str) -> DataFrame:
    z = (F.col("triplet_id") % 7).cast("double") / 2 - 1.5
    return _judgments(spark, d).groupBy("judge").agg(F.round(-F.sum(calibrate.log_likelihood(F.col("answer"), z, F.lit(0.4))), 4).alias("nll"))


@query("quantile_decision", "WITH q AS (SELECT event_type, quantile_cont(value, 0.05) AS l90, quantile_cont(value, 0.95) AS h90, quantile_cont(value, 0.025) AS l95, quantile_cont(value, 0.975) AS h95, median(value) AS e FROM events GROUP BY 1) SELECT event_type, round(l95, 6) AS low, round(h95, 6) AS high, CASE WHEN l90 >= 50 - 30 AND h90 <= 50 + 30 THEN 'keep' WHEN (50 < l95 OR 50 > h95) AND abs(e - 50) >= 30 THEN 'change' ELSE 'undecided' END AS decision FROM q")
def quantile_decision(spark: SparkSession, d: str) -> DataFrame:
    q = spark.read.parquet(f"{d}/events.parquet").groupBy("event_type").agg(*(F.percentile("value", p).alias(n) for n, p in (("l90", 0.05), ("h90", 0.95), ("l95", 0.025), ("h95", 0.975), ("e", 0.5))))
    rule = calibrate.decision(F.col("l90"), F.col("h90"), F.col("l95"), F.col("h95"), F.col("e"), F.lit(50.0), 30.0)
    return q.select("event_type", F.round("l95", 6).alias("low"), F.round("h95", 6).alias("high"), rule.alias("decision"))


def _u(seed: int, *parts: str) -> str:
    """``calibrate.uniform`` as SQL."""
    return f"(CAST(concat('0x', substr(md5(concat_ws(':', '{seed}', {', '.join(f'CAST({p} AS VARCHAR)' for p in parts)})), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE)"


def _kind(u: str) -> str:
    return "CASE " + " ".join(f"WHEN {u} < {above}::DOUBLE THEN '{kind}'" for kind, above in calibrate.edit_bounds()[:-1]) + f" ELSE '{calibrate.edit_bounds()[-1][0]}' END"


def _learned(spark: SparkSession, d: str) -> DataFrame:
    """Features of predicted against gold graphs, propositions matched by id with cosines by residue."""
    g = graphs(spark, d)
    key = F.col("graph_id").alias("cmp_id")
    edges = lambda t: g[t].filter("has").select(key, F.col("i").alias("pos"), F.when(F.col("turned"), F.col("dst")).otherwise(F.col("i")).cast("string").alias("from_id"), F.when(F.col("turned"), F.col("i")).otherwise(F.col("dst")).cast("string").alias("to_id"), F.col("rel").alias("kind"))
    props = lambda t: g[t].select(key, F.col("i").cast("string").alias("prop_id"))
    matching = g["tp"].select(key, F.col("i").cast("string").alias("a"), F.col("i").cast("string").alias("b"), (1 - (F.col("c") + F.col("i")) % 9 / 10).alias("cos"))
    return calibrate.features(matching, props("tp"), props("tg"), edges("tp"), edges("tg"))


_LEARNED = MATCHED + """, np AS (SELECT graph_id, count(*) AS n, sum(least(1, x / 0.1) * 0.1 + least(1, greatest(0, (x - 0.1) / 0.2)) * 0.2 + least(1, greatest(0, (x - 0.3) / 0.2)) * 0.2 + least(1, greatest(0, (x - 0.5) / 0.2)) * 0.2) AS sub
FROM (SELECT graph_id, CAST((c + i) % 9 AS DOUBLE) / 10 AS x FROM tp) GROUP BY 1), ng AS (SELECT graph_id, count(*) AS n FROM tg GROUP BY 1), e AS (SELECT *, correct + mistyped + reversed AS met FROM rc)
SELECT ng.graph_id AS cmp_id, round(CAST(ng.n - coalesce(np.n, 0) + coalesce(sub, 0) + 0.75 * coalesce(mistyped, 0) + coalesce(reversed, 0) + coalesce(gold_total - met, 0) + coalesce(pred_total - met, 0) AS DOUBLE), 6) AS cost
FROM ng LEFT JOIN np USING (graph_id) LEFT JOIN e USING (graph_id)"""


@query("learned_ged_cost", duck(_LEARNED))
def learned_ged_cost(spark: SparkSession, d: str) -> DataFrame:
    return _learned(spark, d).select("cmp_id", F.round(calibrate.learned_cost(), 6).alias("cost"))


_EDITS = f"""WITH p AS (SELECT conv_id AS triplet_id, {_u(7, "conv_id")} AS u0, {_u(8, "conv_id")} AS u1, {_u(9, "conv_id")} AS u2, {_u(11, "conv_id")} AS u4 FROM (SELECT DISTINCT conv_id FROM conversations)),
q AS (SELECT *, CASE WHEN u0 < 0.1 THEN 'T1' WHEN u0 < 0.2 THEN 'T2' WHEN u0 < 0.9 THEN 'T3' ELSE 'T4' END AS plan FROM p),
n AS (SELECT *, CASE plan WHEN 'T1' THEN 1 + floor(u1 * 2) WHEN 'T3' THEN 1 + floor(u1 * 3) ELSE 1 END AS na, floor(u2 * CASE plan WHEN 'T1' THEN 2 ELSE 3 END) AS more FROM q),
m AS (SELECT *, CASE plan WHEN 'T1' THEN na + 1 + more WHEN 'T2' THEN 2 WHEN 'T3' THEN 1 + more ELSE 1 END AS nb FROM n),
e AS (SELECT *, CASE WHEN plan = 'T1' THEN {_u(10, "triplet_id", "step")} ELSE {_u(10, "triplet_id", "side", "step")} END AS u3 FROM m, (VALUES ('A'), ('B')) s(side), range(1, 8) r(step) WHERE step <= CASE side WHEN 'A' THEN na ELSE nb END)
SELECT triplet_id, plan, side, step, CASE plan WHEN 'T2' THEN {calibrate.SAME_KIND!r}[CAST(1 + floor(u4 * {len(calibrate.SAME_KIND)}) AS INTEGER)] WHEN 'T4' THEN CASE side WHEN 'A' THEN 'X-surf' ELSE 'X-spk' END ELSE {_kind("u3")} END AS kind FROM e"""


@query("edit_plans", _EDITS)
def edit_plans(spark: SparkSession, d: str) -> DataFrame:
    return calibrate.edit_plans(spark.read.parquet(f"{d}/conversations.parquet").select(F.col("conv_id").alias("triplet_id")).distinct())


@query("perturbed_graphs")
def perturbed_graphs(spark: SparkSession, d: str) -> DataFrame:
    g = graphs(spark, d)
    links = g["tg"].filter("has").groupBy("c").agg(F.collect_list(F.struct(F.concat(F.lit("p"), F.col("i")).alias("a"), F.concat(F.lit("p"), F.col("dst")).alias("b"), F.col("rel").alias("c"))).alias("links"))
    made = g["tg"].groupBy("c").agg(F.sort_array(F.collect_list(F.concat(F.lit("p"), F.col("i")))).alias("props")).join(links, "c", "left").select(F.col("c").alias("triplet_id"), "props", F.coalesce("links", F.array().cast("array<struct<a string, b string, c string>>")).alias("links"))
    out = calibrate.perturb(made, calibrate.edit_plans(made.select("triplet_id")))
    return out.select("triplet_id", "side", F.size("props").alias("n_props"), F.size("links").alias("n_links"), F.size("log").alias("n_edits"))


_SIMULATED = f"""WITH t AS (SELECT conv_id * 8 + turn AS triplet_id, CAST(turn - 3 AS DOUBLE) AS delta FROM conversations),
z AS (SELECT triplet_id, judge, ord, delta + sqrt(-2 * ln(1 - {_u(5, "triplet_id")})) * cos(2 * pi() * {_u(6, "triplet_id")}) AS z, {_u(7, "triplet_id", "judge", "ord")} AS u2, {_u(8, "triplet_id", "judge", "ord")} AS u3, {_u(9, "triplet_id", "judge", "ord")} AS u4 FROM t, (VALUES (0), (1), (2)) a(judge), (VALUES (1), (-1)) b(ord)),
l AS (SELECT *, 1 / (1 + exp(-(z - 0.5))) AS lean, 1 / (1 + exp(z + 0.5)) AS other FROM z)
SELECT triplet_id, CAST(judge AS INTEGER) AS judge, CAST(ord AS INTEGER) AS ord, CAST(CASE WHEN u3 < 0.1 THEN floor(u4 * 3) WHEN u2 < lean THEN 0 WHEN u2 < lean + other THEN 1 ELSE 2 END AS INTEGER) AS answer FROM l"""


@query("simulated_judgments", _SIMULATED)
def simulated_judgments(spark: SparkSession, d: str) -> DataFrame:
    deltas = spark.read.parquet(f"{d}/conversations.parquet").select((F.col("conv_id") * 8 + F.col("turn")).alias("triplet_id"), (F.col("turn") - 3).cast("double").alias("delta"))
    return calibrate.simulated(deltas)


_TRIPLETS: dict[tuple[str, str], tuple[DataFrame, DataFrame, DataFrame, DataFrame]] = {}
JUDGES = 3


def _triplets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(sources, variants, cells, answers): two triplets for each conversation's graph, edited by plan, judged under the costs with a missing proposition at 1.4."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _TRIPLETS:
        tg = graphs(spark, d)["tg"]
        name = lambda c: F.concat(F.lit("p"), F.col(c))
        link = F.when(F.col("has"), F.struct(name("i").alias("a"), name("dst").alias("b"), F.col("rel").alias("c")))
        made = tg.groupBy(F.col("c").alias("source_id")).agg(F.sort_array(F.collect_list(name("i"))).alias("props"), F.sort_array(F.collect_list(link)).alias("links"))
        sources = written(made.withColumn("half", F.explode(F.array(F.lit(0), F.lit(1)))).select((F.col("source_id") * 2 + F.col("half")).alias("triplet_id"), "source_id", "props", "links"), "sources")
        variants = written(calibrate.perturb(sources.select("triplet_id", "props", "links"), calibrate.edit_plans(sources.select("triplet_id"))), "variants")
        cells = written(calibrate.triplet_cells(sources, variants), "cells")
        truth = [1.4, *vocab.THETA[1:]]
        delta = F.col("extra") * vocab.EDGE_EXTRA
        for i, t in enumerate(truth):
            delta = delta + F.col(f"d{i}") * t
        deltas = calibrate.differences(calibrate.matched(cells, truth), sources, variants).select("triplet_id", delta.alias("delta"))
        _TRIPLETS[key] = (sources, variants, cells, written(calibrate.simulated(deltas, JUDGES), "answers"))
    return _TRIPLETS[key]


def _fit_rows(spark: SparkSession, d: str) -> DataFrame:
    """Judged feature differences under the current costs' matchings."""
    sources, variants, cells, answers = _triplets(spark, d)
    return written(calibrate.differences(calibrate.matched(cells, vocab.THETA), sources, variants).join(answers, "triplet_id"), "fit")


def _fitted(rows: DataFrame) -> np.ndarray:
    table = written(calibrate.weighted(rows), "weighted")
    return calibrate.newton(lambda x: calibrate.summed(table, JUDGES, x), calibrate.start(JUDGES))[0]


@query("fit_theta")
def fit_theta(spark: SparkSession, d: str) -> DataFrame:
    found = calibrate.fit_triplets(*_triplets(spark, d), JUDGES)
    return spark.createDataFrame(list(zip(vocab.PARAMETERS, np.round(calibrate.costs(found.x), 4).tolist())), "param string, value double")


@query("cluster_bootstrap")
def cluster_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    rows = _fit_rows(spark, d)
    draws = calibrate.cluster_draws(rows.select("source_id").distinct(), 100)
    fits = calibrate.bootstrap_fits(rows, draws, JUDGES, _fitted(rows))
    return fits.groupBy("param").agg(F.percentile("value", 0.05).alias("low"), F.percentile("value", 0.95).alias("high"), calibrate.robust_sd("value").alias("sd"))


@query("cross_validated_delta")
def cross_validated_delta(spark: SparkSession, d: str) -> DataFrame:
    return calibrate.cross_validated(_fit_rows(spark, d), JUDGES, folds=4)


@query("profile_likelihood")
def profile_likelihood(spark: SparkSession, d: str) -> DataFrame:
    rows = _fit_rows(spark, d)
    return calibrate.profile(written(calibrate.weighted(rows), "weighted"), _fitted(rows), JUDGES)
