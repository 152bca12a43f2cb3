"""Argument graphs made from the conversation and embedding tables by integer arithmetic, as SQL that two engines read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from disputa.sources.scratch import written

_TURNS = """
t AS (SELECT cast(conv_id AS BIGINT) AS c, cast(turn AS BIGINT) AS i, cast(conv_id AS STRING) AS graph_id, coalesce(role, '') AS role, trim(coalesce(text, '')) AS text FROM conversations),
k AS (SELECT *, lag(i) OVER (PARTITION BY c ORDER BY i) AS before FROM t WHERE i = 0 OR (c * 31 + i * 17) % 7 <> 0),
lf AS (SELECT 0 AS f, 'Asserting' AS force UNION ALL SELECT 1, 'PureQuestioning' UNION ALL SELECT 2, 'AssertiveQuestioning' UNION ALL SELECT 3, 'RhetoricalQuestioning' UNION ALL SELECT 4, 'Challenging' UNION ALL SELECT 5, 'Agreeing' UNION ALL SELECT 6, 'Disagreeing' UNION ALL SELECT 7, 'Default Illocuting'),
tg AS (SELECT t.*, lf.force, i - 1 AS before, CASE (c * 11 + i * 5) % 3 WHEN 0 THEN 'RA' WHEN 1 THEN 'CA' ELSE 'MA' END AS rel, CASE WHEN i - 1 - (c + i) % 2 > 0 THEN i - 1 - (c + i) % 2 ELSE 0 END AS dst, i >= 1 AND (c * 7 + i * 3) % 5 <> 0 AS has, '' AS grade, false AS turned FROM t JOIN lf ON lf.f = (t.c * 3 + t.i) % 8),
tp AS (SELECT k.c, k.i, k.graph_id, k.role, k.text, lf.force, before, CASE (c * 5 + i * 7) % 4 WHEN 2 THEN 'CA' WHEN 3 THEN 'MA' ELSE 'RA' END AS rel, before AS dst, before IS NOT NULL AS has, CASE (c * 3 + i) % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS grade, (c + i) % 6 = 0 AS turned FROM k JOIN lf ON lf.f = (k.c * 3 + k.i + CASE WHEN (k.c + 2 * k.i) % 3 = 0 THEN 1 ELSE 0 END) % 8)"""

_SCHEME = "CASE rel WHEN 'RA' THEN 'Default Inference' WHEN 'CA' THEN 'Default Conflict' ELSE 'Default Rephrase' END"
_FORCE = "CASE rel WHEN 'RA' THEN 'Arguing' WHEN 'CA' THEN 'Disagreeing' ELSE 'Restating' END"


def _nodes(u: str) -> str:
    row = lambda o, p, kind, text, scheme, speaker, grade, where: f"SELECT graph_id, cast(i * 10 + {o} AS BIGINT) AS pos, concat('{p}', cast(i AS STRING)) AS node_id, {kind} AS type, {text} AS text, {scheme} AS scheme, {speaker} AS speaker, '' AS timestamp, {grade} AS confidence FROM {u} WHERE {where}"
    return " UNION ALL ".join([
        row(0, "L", "'L'", "concat(role, ' : ', text)", "''", "role", "''", "true"), row(1, "I", "'I'", "text", "''", "''", "''", "true"), row(2, "Y", "'YA'", "''", "force", "''", "''", "true"),
        row(3, "T", "'TA'", "''", "'Default Transition'", "''", "''", "before IS NOT NULL AND i > 0"), row(4, "S", "rel", "''", _SCHEME, "''", "grade", "has"), row(5, "V", "'YA'", "''", _FORCE, "''", "''", "has")])


def _edges(u: str) -> str:
    name = lambda p, e: f"concat('{p}', cast({e} AS STRING))"
    row = lambda o, a, b, where: f"SELECT graph_id, cast(i * 10 + {o} AS BIGINT) AS pos, {a} AS from_id, {b} AS to_id FROM {u} WHERE {where}"
    src, dst = f"CASE WHEN turned THEN {name('I', 'dst')} ELSE {name('I', 'i')} END", f"CASE WHEN turned THEN {name('I', 'i')} ELSE {name('I', 'dst')} END"
    chain = "before IS NOT NULL AND i > 0"
    return " UNION ALL ".join([
        row(0, name("L", "i"), name("Y", "i"), "true"), row(1, name("Y", "i"), name("I", "i"), "true"), row(2, name("L", "before"), name("T", "i"), chain), row(3, name("T", "i"), name("L", "i"), chain),
        row(4, src, name("S", "i"), "has"), row(5, name("S", "i"), dst, "has"), row(6, name("T", "i"), name("V", "i"), "has"), row(7, name("V", "i"), name("S", "i"), "has")])


_NOISE_NODES = "SELECT graph_id, cast(i * 10 + 9 AS BIGINT), concat('Z', cast(i AS STRING)), 'L', concat('Annotator: ', text), '', '', '', '' FROM t WHERE (c + i) % 3 = 0"
_NOISE_EDGES = """SELECT graph_id, cast(i * 10 + 8 AS BIGINT), concat('L', cast(i AS STRING)), concat('I', cast(i AS STRING)) FROM t WHERE (c + i) % 4 = 0
UNION ALL SELECT graph_id, cast(i * 10 + 8 AS BIGINT), concat('L', cast(i AS STRING)), concat('Y', cast(i AS STRING)) FROM t WHERE (c + i) % 5 = 0
UNION ALL SELECT graph_id, cast(i * 10 + 9 AS BIGINT), concat('I', cast(i AS STRING)), concat('I', cast(i AS STRING)) FROM t WHERE (c + i) % 6 = 0
UNION ALL SELECT graph_id, cast(i * 10 + 9 AS BIGINT), concat('I', cast(i AS STRING)), concat('X', cast(i AS STRING)) FROM t WHERE (c + i) % 7 = 0"""

#: gold and predicted graphs (gn, ge, pn, pe), raw graphs with noise (rn, re), and cosines of all propositions and locutions (sim).
PREAMBLE = f"""WITH {_TURNS},
gn AS ({_nodes('tg')}), ge AS ({_edges('tg')}), pn AS ({_nodes('tp')}), pe AS ({_edges('tp')}),
rn AS (SELECT * FROM gn UNION ALL {_NOISE_NODES}), re AS (SELECT * FROM ge UNION ALL {_NOISE_EDGES})"""


def duck(body: str) -> str:
    """The same text for DuckDB: the preamble, then a query over it."""
    return PREAMBLE.replace("AS STRING", "AS VARCHAR") + body


_MADE: dict[tuple[str, str], dict[str, DataFrame]] = {}


def graphs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The tables of the preamble, written once for a session and folder."""
    made = _MADE.get((spark.sparkContext.applicationId, sf_dir))
    if made is None:
        conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
        text = PREAMBLE.replace("FROM conversations", "FROM {conversations}")
        named = lambda name: spark.sql(f"{text} SELECT * FROM {name}", conversations=conversations)
        made = {name: written(named(name), name) for name in ("t", "tg", "tp", "gn", "ge", "pn", "pe", "rn", "re")}
        _MADE[(spark.sparkContext.applicationId, sf_dir)] = made
    return made
