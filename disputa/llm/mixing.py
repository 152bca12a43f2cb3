"""Mixing sources to target weights by temperature.

Weights are token shares to a power (the inverse temperature) between 0 and 1. The power is bisected to reach a target
entropy, as a share of the entropy of equal weights, and then raised as far as a limit of repetitions asks. Quotas
are realised as block permutations: a source's rows are dealt to blocks by hash, an epoch is a permutation of blocks and of
rows inside blocks, whole epochs repeat every row, and the last one stops where the quota is met.

Since a permutation's order is that of a hash, one pair of keys for each source tells which rows are in its last
epoch. Those pairs and the plan (a row for each source, at most ``MOST_SOURCES``) are all that is sent to tasks; rows and
their texts are never shuffled.

Defined results: a null source is a source; a null or empty text has no tokens and goes with its block; a source
without tokens is kept once; rows with one id are taken or left together; extra columns stay; an empty table stays empty.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from disputa.llm.common import table

#: Target entropy (share of that of equal weights), most repetitions of a source, blocks of a source, most sources.
ENTROPY, REPETITIONS, BLOCKS, MOST_SOURCES, SEED = 0.95, 4.0, 4096, 100_000, 17


@dataclass
class Plan:
    """power: the exponent of shares; quotas: tokens by source, in the order of the input."""

    power: float
    budget: int
    weights: list[float]
    quotas: list[int]


def powered(shares: list[float], power: float) -> list[float]:
    """Normalised shares ** power; shares of 0 stay 0."""
    logs = [power * math.log(s) if s > 0 else None for s in shares]
    top = max((x for x in logs if x is not None), default=0.0)
    raw = [0.0 if x is None else math.exp(x - top) for x in logs]
    total = sum(raw) or 1.0
    return [x / total for x in raw]


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def bisect(good, steps: int = 60) -> float:
    """The largest power in [0, 1] for which ``good`` holds, if it holds up to a point; 0 if never."""
    if good(1.0):
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (middle, high) if good(middle) else (low, middle)
    return low


def solve(tokens: list[int], target: float = ENTROPY, limit: float = REPETITIONS, budget: int | None = None) -> Plan:
    """The plan for sources of so many tokens. Without a budget, it is the least that gives every source a whole epoch."""
    total = sum(tokens)
    if not total:
        return Plan(1.0, 0, [0.0] * len(tokens), [0] * len(tokens))
    shares = [t / total for t in tokens]
    live = sum(t > 0 for t in tokens)
    power = bisect(lambda a: entropy(powered(shares, a)) >= target * math.log(live) - 1e-12) if live > 1 else 1.0

    def spent(a: float) -> tuple[list[float], float]:
        weights = powered(shares, a)
        return weights, float(budget) if budget is not None else max(t / w for t, w in zip(tokens, weights) if t)

    def repeated(a: float) -> float:
        weights, b = spent(a)
        return max(b * w / t for t, w in zip(tokens, weights) if t)

    if repeated(power) > limit:
        power = 1 - bisect(lambda x: repeated(1 - x) <= limit + 1e-9) if repeated(1.0) <= limit else 1.0
    weights, b = spent(power)
    b = min(b, limit * total) if repeated(power) > limit + 1e-6 else b
    return Plan(power, round(b), weights, [round(b * w) for w in weights])


def word_count(text: str) -> Column:
    """Words without white space; a null text has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _keys(epoch: Column, doc_id: str) -> tuple[Column, Column]:
    """(order of the block in the epoch, order of the row in the block)."""
    block = F.pmod(F.xxhash64(F.lit(SEED), F.col(doc_id)), F.lit(BLOCKS))
    return F.xxhash64(F.lit(SEED + 1), epoch, block), F.xxhash64(F.lit(SEED + 2), epoch, F.col(doc_id))


def mix(docs: DataFrame, target: float = ENTROPY, limit: float = REPETITIONS, budget: int | None = None, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """All columns of ``docs`` with mix_epoch, mix_block and mix_place: a row for each time that a row is taken.

    Ordering by (mix_epoch, mix_block, mix_place) within a source gives its permutations.
    """
    from pyspark.sql import Window as W

    spark = docs.sparkSession
    sized = docs.select(F.col(doc_id).alias("_id"), F.col(source).alias("_source"), word_count(text).alias("_n"))
    totals = sized.groupBy("_source").agg(F.sum("_n").alias("n")).orderBy("_source").limit(MOST_SOURCES + 1).collect()
    if len(totals) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    plan = solve([r["n"] for r in totals], target, limit, budget)
    rows = [(r["_source"], q // r["n"] if r["n"] else 1, q % r["n"] if r["n"] else 0) for r, q in zip(totals, plan.quotas)]
    quota = F.broadcast(spark.createDataFrame(rows, "_source string, _full long, _rest long").withColumn("_source", F.col("_source").cast(sized.schema["_source"].dataType)))
    # The last epoch: sum blocks, find where the quota ends, then do the same with the rows of that block alone.
    block, place = _keys(F.col("_full"), "_id")
    last = sized.join(quota, sized["_source"].eqNullSafe(quota["_source"])).drop(quota["_source"]).filter("_rest > 0").select("_source", "_rest", "_n", block.alias("_block"), place.alias("_place"))
    sums = last.groupBy("_source", "_rest", "_block").agg(F.sum("_n").alias("n"))
    upto = F.sum("n").over(W.partitionBy("_source").orderBy("_block"))
    bounds = sums.select("_source", "_block", "_rest", "n", upto.alias("upto")).filter("upto > _rest AND upto - n <= _rest").select("_source", "_block", (F.col("_rest") - F.col("upto") + F.col("n")).alias("left"))
    # A source whose blocks after the bound have no tokens has one bound all the same: the first.
    bounds = bounds.groupBy("_source").agg(F.min(F.struct("_block", "left")).alias("b")).select("_source", "b.*").collect()
    bound = F.broadcast(spark.createDataFrame([tuple(r) for r in bounds], "_source string, _block long, left long").withColumn("_source", F.col("_source").cast(sized.schema["_source"].dataType)))
    inside = last.join(bound, last["_source"].eqNullSafe(bound["_source"]) & (last["_block"] == bound["_block"])).select(last["_source"], "left", "_place", "_n").groupBy("_source", "left", "_place").agg(F.sum("_n").alias("n"))
    taken = inside.select("_source", "_place", "left", F.sum("n").over(W.partitionBy("_source").orderBy("_place")).alias("upto")).filter("upto <= left").groupBy("_source").agg(F.max("_place").alias("_place"))
    cut = {r["_source"]: r["_place"] for r in taken.collect()}
    low = -(1 << 63)
    ends = {r["_source"]: (r["_block"], cut.get(r["_source"], low)) for r in bounds}
    full = [(s, f, *ends.get(s, (low, low))) for s, f, _ in rows]
    decided = F.broadcast(spark.createDataFrame(full, "_source string, _full long, _end long, _cut long").withColumn("_source", F.col("_source").cast(sized.schema["_source"].dataType)))
    out = docs.join(decided, docs[source].eqNullSafe(decided["_source"])).drop("_source")
    block, place = _keys(F.col("_full"), doc_id)
    partly = (block < F.col("_end")) | (block == F.col("_end")) & (place <= F.col("_cut"))
    times = F.col("_full") + F.when(partly, 1).otherwise(0)
    out = out.withColumn("mix_epoch", F.explode(F.when(times > 0, F.sequence(F.lit(0).cast("long"), times - 1)).otherwise(F.array().cast("array<bigint>"))))
    block, place = _keys(F.col("mix_epoch"), doc_id)
    return out.withColumns({"mix_block": block, "mix_place": place}).drop("_full", "_end", "_cut")


def op2_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "source", word_count("text").alias("n_tokens"), "mix_epoch", "mix_block", "mix_place")
