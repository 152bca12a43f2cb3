"""Readers of argument graphs and results, and their writers."""

from __future__ import annotations

import io
import json
import re
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from disputa.functions import vocab
from disputa.functions.graph import speaker_of

NODESET = "nodes array<struct<nodeID string, text string, type string, scheme string, timestamp string>>, edges array<struct<fromID string, toID string>>, locutions array<struct<nodeID string, personID string>>"


def nodeset_id(path: Column) -> Column:
    """The digits of nodesetN, nodesetN.json or nodesetN.txt at the end of a path; '' for other names."""
    return F.regexp_extract(path, r"(?:^|/)nodeset([0-9]+)(?:\.json|\.txt)?$", 1)


def parse(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes and edges of (graph_id, nodes, edges, locutions): trims, fills default schemes, finds speakers."""
    person = raw.select("graph_id", F.explode("locutions").alias("l")).groupBy("graph_id", F.col("l.nodeID").alias("node_id")).agg(F.first("l.personID").alias("person"))
    n = raw.select("graph_id", F.posexplode("nodes").alias("pos", "n")).select("graph_id", "pos", F.col("n.nodeID").alias("node_id"), F.trim(F.coalesce("n.type", F.lit(""))).alias("type"), F.trim(F.coalesce("n.text", F.lit(""))).alias("text"), F.trim(F.coalesce("n.scheme", F.lit(""))).alias("scheme"), F.coalesce("n.timestamp", F.lit("")).alias("timestamp"))
    scheme = F.col("scheme")
    for kind, default in vocab.DEFAULT_SCHEMES.items():
        scheme = F.when((F.col("type") == kind) & (F.col("scheme") == ""), default).otherwise(scheme)
    scheme = F.when(F.col("type").isin("I", "L"), "").otherwise(scheme)
    spoken = F.when(F.col("type") == "L", F.coalesce(F.nullif(speaker_of(F.lit(""), F.col("text")), F.lit("")), F.col("person"), F.lit(""))).otherwise("")
    nodes = n.join(person, ["graph_id", "node_id"], "left").select("graph_id", "pos", "node_id", "type", "text", scheme.alias("scheme"), spoken.alias("speaker"), "timestamp", F.lit("").alias("confidence"))
    edges = raw.select("graph_id", F.posexplode("edges").alias("pos", "e")).select("graph_id", "pos", F.col("e.fromID").alias("from_id"), F.col("e.toID").alias("to_id"))
    return nodes, edges


def parse_json(rows: DataFrame, graph_id: str, body: str) -> tuple[DataFrame, DataFrame]:
    """nodes and edges of nodesets kept as JSON text; rows that are no JSON give none."""
    made = rows.select(F.col(graph_id).alias("graph_id"), F.from_json(body, NODESET).alias("g"))
    return parse(made.select("graph_id", "g.*"))


def read_nodesets(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes and edges of all JSON nodesets under a path; the id comes from the file's name."""
    raw = spark.read.schema(NODESET).json(path, multiLine=True).withColumn("graph_id", nodeset_id(F.col("_metadata.file_name")))
    return parse(raw.filter("graph_id <> ''"))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(archive, nodeset_id, json, text, broken) of gzipped tar files; broken: the JSON does not parse. One archive is one record."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, content in zip(frame["path"], frame["content"]):
                found: dict[str, dict[str, str]] = {}
                with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as tar:
                    for member in tar:
                        hit = re.search(r"(?:^|/)nodeset([0-9]+)\.(json|txt)$", member.name)
                        if hit and member.isfile():
                            found.setdefault(hit[1], {})[hit[2]] = tar.extractfile(member).read().decode("utf-8", "replace")
                for key in sorted(found):
                    text = found[key].get("json", "")
                    try:
                        broken = not json.loads(text)
                    except ValueError:
                        broken = True
                    rows.append((name, key, text, found[key].get("txt", ""), broken))
            yield pd.DataFrame(rows, columns=["archive", "nodeset_id", "json", "text", "broken"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "archive string, nodeset_id string, json string, text string, broken boolean")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Result rows of JSON lines; blank lines are skipped."""
    return spark.read.json(path)


def read_metrics(spark: SparkSession, path: str, metric: str, weights: str) -> DataFrame:
    """Rows of a metrics CSV with this metric and weights; columns that hold numbers only become doubles."""
    raw = spark.read.csv(path, header=True).filter((F.col("metric") == metric) & (F.col("weights") == weights))
    text = {"nodeset_id", "condition", "metric", "weights", "error"}
    return raw.select(*(F.col(c) if c in text else F.col(c).try_cast("double").alias(c) for c in raw.columns))


def fingerprints(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, sha256) of texts."""
    return rows.select(key, F.sha2(F.encode(F.col(text), "UTF-8"), 256).alias("sha256"))


def sample(rows: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    """The n rows with the least keyed hash, by key; equal seeds, equal samples. A top-k: no sort of all rows."""
    return rows.withColumn("_h", F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")).cast("binary"))).orderBy("_h", key).limit(n).drop("_h")


def eligible(counts: DataFrame, splits: DataFrame | None, split: str, least: int, most: int) -> DataFrame:
    """Rows (graph_id, corpus, locutions, relations) of a split with least to most locutions and a relation. splits: (split, corpus); an unknown split, or none, takes all."""
    kept = counts.filter(F.col("locutions").between(least, most) & (F.col("relations") > 0))
    if splits is None or splits.filter(F.col("split") == split).isEmpty():
        return kept
    return kept.join(splits.filter(F.col("split") == split).select("corpus").distinct(), "corpus", "left_semi")


def manifest(rows: DataFrame, source: str, text: str) -> DataFrame:
    """(source, n, with_text): how many nodesets a source has, and how many of them have a text."""
    return rows.groupBy(source).agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col(text), F.lit("")) != "").alias("with_text"))


def write_results(rows: DataFrame, path: str) -> None:
    """JSON lines, a file for each task."""
    rows.write.json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header, doubles to 4 places, rows with an error left out."""
    ok = rows.filter("coalesce(error, '') = ''") if "error" in rows.columns else rows
    ok.select(*(F.format_string("%.4f", c).alias(c) if t == "double" else F.col(c) for c, t in ok.dtypes)).write.csv(path, header=True)


def write_graphs(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A JSON line for each graph, nodes and edges in order."""
    n = nodes.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("pos", "node_id", "type", "text", "scheme", "speaker", "timestamp", "confidence"))).alias("nodes"))
    e = edges.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("pos", "from_id", "to_id"))).alias("edges"))
    n.join(e, "graph_id", "left").write.json(path)
