"""Transcripts: turns, normalised search, location of utterances, excerpts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The patterns of a time stamp and of noise lines, probe lengths, and the largest gap inside an excerpt.
STAMP = r"^\[(\d+:)?\d{1,2}:\d{2}\]\s*"
NOISE = r"^(Part \d+|Words: \d+|\d{1,2}:\d{2}|[a-z0-9_+-]+)$"
PROBE_LEAST, PROBE_MOST, GAP = 12, 40, 3000


def turns(transcripts: DataFrame) -> DataFrame:
    """(doc, turn, speaker, stamp, body) of (doc, text): a stamped line begins a turn, the line before it names the speaker.

    Later lines join the turn, unless they are noise or the next speaker: gaps and islands over the lines' numbers.
    """
    lines = transcripts.select("doc", F.posexplode(F.split(F.replace("text", F.lit("\r\n"), F.lit("\n")), "\n")).alias("i", "raw")).withColumn("line", F.regexp_replace("raw", r"^\s+|\s+$", "")).filter("line <> ''")
    w = W.partitionBy("doc").orderBy("i")
    marked = lines.withColumn("stamped", F.col("line").rlike(STAMP))
    marked = marked.select("doc", "i", "line", "stamped", F.coalesce(F.lead("stamped").over(w), F.lit(False)).alias("next"), F.lag("line").over(w).alias("before"), F.coalesce(F.lag("stamped").over(w), F.lit(True)).alias("before_stamped"))
    marked = marked.withColumn("turn", F.sum(F.col("stamped").cast("long")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    kept = marked.filter("turn > 0 AND (stamped OR NOT (next OR line RLIKE r'" + NOISE + "'))")
    body = F.when(F.col("stamped"), F.regexp_replace("line", STAMP, "")).otherwise(F.col("line"))
    return kept.groupBy("doc", "turn").agg(
        F.max(F.when(F.col("stamped"), F.when(F.col("before_stamped"), "").otherwise(F.col("before")))).alias("speaker"),
        F.max(F.when(F.col("stamped"), F.trim(F.regexp_extract("line", STAMP, 0)))).alias("stamp"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", body.alias("b")))), lambda x: x["b"]), " ").alias("body"))


def normalized(text: Column) -> Column:
    """Lower-case letters and digits alone."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{Nd}]", ""))


def located(documents: DataFrame, utterances: DataFrame) -> DataFrame:
    """(doc, idx, start, size): utterances (doc, idx, text) whose probe occurs once in the normalised document; 1-based."""
    probes = utterances.select("doc", "idx", normalized(F.col("text")).alias("u")).filter(F.length("u") >= PROBE_LEAST).withColumn("probe", F.substring("u", 1, PROBE_MOST))
    found = probes.join(documents.select("doc", normalized(F.col("text")).alias("t")), "doc")
    start = F.instr(F.col("t"), F.col("probe"))
    again = F.expr("locate(probe, t, instr(t, probe) + 1)")
    return found.filter((start > 0) & (again == 0)).select("doc", "idx", start.cast("long").alias("start"), F.length("u").cast("long").alias("size"))


def excerpt_spans(places: DataFrame, gap: int = GAP) -> DataFrame:
    """(doc, first, last, n): the largest run of located utterances with gaps up to ``gap``; the earlier of equals."""
    w = W.partitionBy("doc").orderBy("start", "idx")
    new = F.coalesce((F.col("start") - F.lag(F.col("start") + F.col("size")).over(w) > gap).cast("long"), F.lit(0))
    runs = places.withColumn("new", new).withColumn("run", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0))).groupBy("doc", "run").agg(F.min("start").alias("first"), F.max(F.col("start") + F.col("size") - 1).alias("last"), F.count("*").alias("n"))
    return runs.groupBy("doc").agg(F.max_by(F.struct("first", "last", "n"), F.struct("n", -F.col("run"))).alias("r")).select("doc", "r.*")


def bodies(text: Column) -> Column:
    """A locution's candidate bodies: as it is, and with one and two speaker prefixes removed."""
    once = F.regexp_replace(text, r"^[^:]{1,60}:\s*", "")
    return F.array_distinct(F.array(F.trim(text), F.trim(once), F.trim(F.regexp_replace(once, r"^[^:]{1,60}:\s*", ""))))
