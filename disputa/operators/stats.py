"""Paired statistics over long tables of metric values, as windows and aggregates."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from disputa.sources.scratch import written


def normal_tail(z: Column) -> Column:
    """Two-sided tail of the standard normal distribution."""

    @F.pandas_udf(T.DoubleType())
    def tail(values: pd.Series) -> pd.Series:
        return values.map(lambda x: math.erfc(abs(x) / math.sqrt(2)) if x == x else None)

    return tail(z)


def describe(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, mean, sd, min, max); sd is 0 for fewer than two values."""
    v = F.col(value)
    return values.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("sd"), F.min(v).alias("min"), F.max(v).alias("max"))


def paired(values: DataFrame, unit: str, condition: str, value: str, least: int = 3) -> DataFrame:
    """(c1, c2, unit, x, y, diff): all ordered pairs of conditions on their common units, at least ``least`` of them."""
    one = values.select(F.col(unit).alias("unit"), F.col(condition).alias("c1"), F.col(value).alias("x"))
    two = values.select(F.col(unit).alias("unit"), F.col(condition).alias("c2"), F.col(value).alias("y"))
    both = one.join(two, "unit").filter("c1 <> c2").withColumn("diff", F.col("x") - F.col("y"))
    enough = both.groupBy("c1", "c2").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("c1", "c2")
    return both.join(enough, ["c1", "c2"])


def running(rows: DataFrame, keys: list[str], order: list[str], amount: str) -> DataFrame:
    """rows with ``before`` and ``whole``: the sum of ``amount`` over the rows of the same keys that come first, and over all of them.

    Rows are range-partitioned by keys and order and written once; sums are made within a range, and a table of one row for
    each key and range carries them over. So a key with most of the rows is spread over all tasks.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = written(rows.repartitionByRange(parts, *keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    first = lambda w: F.coalesce(F.sum(F.col("_n")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = spread.withColumn("_n", F.col(amount)).withColumn("_inside", first(W.partitionBy("_range", *keys).orderBy(*order)))
    sums = spread.groupBy("_range", *keys).agg(F.sum(amount).alias("_n"))
    named = [F.col(k).alias(f"_{k}") for k in keys]
    carried = sums.select(F.col("_range").alias("_r"), *named, first(W.partitionBy(*keys).orderBy("_range")).alias("_carried"), F.sum("_n").over(W.partitionBy(*keys)).alias("whole"))
    same = F.col("_range") == F.col("_r")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return inside.join(carried, same).select(*rows.columns, (F.col("_inside") + F.col("_carried")).alias("before"), "whole")


def wilcoxon(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, w_plus, w_minus, z): zero differences left out, mean ranks of ties, continuity 0.5, no tie correction of the variance.

    Differences of one size are counted before they are ranked.
    """
    sizes = pairs.filter("diff <> 0").groupBy(*keys, F.abs("diff").alias("size")).agg(F.count("*").alias("n"), F.count_if(F.col("diff") > 0).alias("plus"))
    rank = F.col("before") + (F.col("n") + 1) / 2
    summed = running(sizes, keys, ["size"], "n").groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.col("plus") * rank).alias("w_plus"), F.sum((F.col("n") - F.col("plus")) * rank).alias("w_minus"))
    n = F.col("n").cast("double")
    low, mean, sd = F.least("w_plus", "w_minus"), n * (n + 1) / 4, F.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    return summed.withColumn("z", F.when(sd > 0, F.least(F.lit(0.0), (low - mean + 0.5) / sd)).otherwise(0.0))


def cliffs_delta(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, delta): mean sign over all pairs of the two samples, by running counts of values instead of all pairs."""
    both = pairs.select(*keys, F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col("x").alias("v")), F.struct(F.lit(0).alias("side"), F.col("y").alias("v")))).alias("s")).select(*keys, "s.*")
    by_value = both.groupBy(*keys, "v").agg(F.sum("side").alias("nx"), F.sum(1 - F.col("side")).alias("ny"))
    signed = running(by_value, keys, ["v"], "ny").withColumn("s", F.col("nx") * (F.col("before") - (F.col("whole") - F.col("before") - F.col("ny"))))
    return signed.groupBy(*keys).agg((F.sum("s") / (F.sum("nx") * F.sum("ny"))).alias("delta"))


def magnitude(delta: Column) -> Column:
    """The usual name of an effect size."""
    d = F.abs(delta)
    return F.when(d < 0.147, "negligible").when(d < 0.33, "small").when(d < 0.474, "medium").otherwise("large")


def holm(tests: DataFrame, family: list[str], p: str, order: list[str]) -> DataFrame:
    """tests with p_holm: (n - rank) p, running maximum, at most 1."""
    w = W.partitionBy(*family) if family else W.partitionBy(F.lit(1))
    ranked = tests.withColumn("_r", F.row_number().over(w.orderBy(p, *order))).withColumn("_n", F.count("*").over(w))
    scaled = F.least(F.lit(1.0), (F.col("_n") - F.col("_r") + 1) * F.col(p))
    return ranked.withColumn("p_holm", F.max(scaled).over(w.orderBy("_r").rowsBetween(W.unboundedPreceding, 0))).drop("_r", "_n")


def draw(seed: int, *parts: Column) -> Column:
    """A number below 2**32 from md5 of the parts, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]).cast("binary")), 1, 8), 16, 10).cast("long")


#: Places that one task draws at a time, and values of a key that are gathered from at a time: fixed numbers, so what a task holds is bounded.
DRAWN, BLOCK = 1 << 18, 1 << 16
_SHIFTS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_SINES = [int(abs(math.sin(i + 1)) * (1 << 32)) for i in range(64)]


def _first_word(prefix: bytes, digits: np.ndarray) -> np.ndarray:
    """The first four bytes of md5 of the prefix and a row of digits, for each row, as a big-endian number."""
    rows, size = len(digits), len(prefix) + digits.shape[1]
    if size > 55:  # more than one block of md5
        return np.array([int.from_bytes(hashlib.md5(prefix + d.tobytes()).digest()[:4], "big") for d in digits], np.int64)
    text = np.zeros((rows, 64), np.uint8)
    text[:, : len(prefix)] = np.frombuffer(prefix, np.uint8)
    text[:, len(prefix) : size] = digits
    text[:, size], text[:, 56], text[:, 57] = 128, size * 8 & 255, size * 8 >> 8
    words = [np.ascontiguousarray(w) for w in text.view("<u4").T]
    begun = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = (np.full(rows, x) for x in begun)
    for i in range(64):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f += a
        f += words[g]
        f += np.uint32(_SINES[i])
        a, d, c, b = d, c, b, b + ((f << np.uint32(_SHIFTS[i])) | (f >> np.uint32(32 - _SHIFTS[i])))
    return (a + begun[0]).byteswap().astype(np.int64)


def draws(seed: int, replicate: int, first: int, n: int) -> np.ndarray:
    """``draw`` of (replicate, place) for n places from the first on, without a row for each."""
    prefix, out, at, end = f"{seed}:{replicate}:".encode(), [], first, first + n
    while at < end:
        size = len(str(at))
        stop = min(end, at + 8192, 10**size)
        k = np.arange(at, stop)
        digits = np.stack([k // 10 ** (size - 1 - i) % 10 + 48 for i in range(size)], axis=1).astype(np.uint8)
        out.append(_first_word(prefix, digits))
        at = stop
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _drawn(units: DataFrame, seed: int) -> DataFrame:
    """(block, key, b, drawn): offsets inside a block of values, as packed 2-byte numbers, of units (key, n, part, b) of ``DRAWN`` places. Units of one (part, b) that follow each other share the hashes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, hashes = None, None
        for frame in frames:
            for key, n, part, b in zip(*(frame[c] for c in ("key", "n", "part", "b"))):
                size = min(DRAWN, n - part * DRAWN)
                if known != (part, b) or len(hashes) < size:
                    known, hashes = (part, b), draws(seed, b, part * DRAWN, size)
                at = np.sort(hashes[:size] % n)
                blocks = at // BLOCK
                cuts = np.flatnonzero(np.diff(blocks)) + 1
                pieces = np.split((at % BLOCK).astype("<u2"), cuts)
                yield pd.DataFrame({"block": blocks[np.concatenate([[0], cuts])], "key": key, "b": b, "drawn": [p.tobytes() for p in pieces]})

    return units.mapInPandas(run, "block long, key string, b long, drawn binary")


def _gathered(rows: DataFrame) -> DataFrame:
    """(key, b, s, m): sums and numbers of the values that draws hit, of rows (block, key, b, drawn, v, gaps) where a block's values, with b -1 and the places of nulls, come before its draws."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        values = there = None
        for frame in frames:
            found = []
            for key, b, drawn, v, gaps in zip(*(frame[c] for c in ("key", "b", "drawn", "v", "gaps"))):
                if b < 0:
                    values, there = np.asarray(v, float), np.ones(len(v), bool)
                    there[np.asarray(gaps, np.int64)] = False
                else:
                    at = np.frombuffer(drawn, "<u2")
                    found.append((key, b, values[at].sum(), int(there[at].sum())))
            yield pd.DataFrame(found, columns=["key", "b", "s", "m"])

    return rows.mapInPandas(run, "key string, b long, s double, m long")


def bootstrap_ci(values: DataFrame, keys: list[str], value: str, order: str, replicates: int = 1000, alpha: float = 0.05, seed: int = 1) -> DataFrame:
    """(keys, low, high): percentile interval of the mean over resamples; draws are md5 of (seed, replicate, place).

    Draws are made in tasks and sent, two bytes each, to the block of ``BLOCK`` values that they hit, which adds up what
    is drawn; no draw is a row, and no table of values is broadcast. Rows with a null key are left out.
    """
    placed = running(values.select(*keys, F.col(order).alias("_at"), F.col(value).alias("v"), F.lit(1).cast("long").alias("one")).dropna(subset=keys), keys, ["_at"], "one")
    key = F.to_json(F.struct(*keys)).alias("key")
    numbered = written(placed.select(*keys, key, F.col("v").cast("double").alias("v"), F.col("before").alias("i"), F.col("whole").alias("n")), "numbered")
    sizes = written(numbered.filter("i = 0").select(*keys, "key", "n"), "sizes")
    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    units = sizes.select("key", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {DRAWN}"))).alias("part")).withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(replicates - 1).cast("long"))))
    units = units.repartition(parts, "part", "b").sortWithinPartitions("part", "b", F.desc("n"))
    blocks = numbered.groupBy("key", F.expr(f"i div {BLOCK}").alias("block")).agg(F.sort_array(F.collect_list(F.struct("i", F.coalesce("v", F.lit(0.0)).alias("v")))).getField("v").alias("v"), F.collect_list(F.when(F.col("v").isNull(), F.col("i") % BLOCK)).alias("gaps"))
    hits = blocks.select("block", "key", F.lit(-1).cast("long").alias("b"), F.lit(None).cast("binary").alias("drawn"), "v", "gaps").unionByName(_drawn(units, seed), allowMissingColumns=True)
    sums = _gathered(hits.repartition(parts, "key", "block").sortWithinPartitions("key", "block", "b"))
    means = sums.groupBy("key", "b").agg(F.round(F.when(F.sum("m") > 0, F.sum("s") / F.sum("m")), 9).alias("m"))
    ranked = means.withColumn("r", F.row_number().over(W.partitionBy("key").orderBy(F.asc_nulls_last("m"), "b")) - 1)
    low, high = int(alpha / 2 * replicates), int((1 - alpha / 2) * replicates) - 1
    ends = ranked.groupBy("key").agg(F.max(F.when(F.col("r") == low, F.col("m"))).alias("low"), F.max(F.when(F.col("r") == high, F.col("m"))).alias("high"))
    return sizes.join(ends, "key").select(*keys, "low", "high")


def compare_all(values: DataFrame, unit: str, condition: str, metric: str, value: str, replicates: int = 500) -> DataFrame:
    """(metric, c1, c2, n, mean_diff, low, high, z, p, p_holm, delta, magnitude) for every ordered pair of conditions and metric."""
    every = None
    keys = ["metric", "c1", "c2"]
    one = values.select(F.col(metric).alias("metric"), F.col(unit).alias("unit"), F.col(condition).alias("c1"), F.col(value).alias("x"))
    two = values.select(F.col(metric).alias("metric"), F.col(unit).alias("unit"), F.col(condition).alias("c2"), F.col(value).alias("y"))
    both = one.join(two, ["metric", "unit"]).filter("c1 <> c2").withColumn("diff", F.col("x") - F.col("y"))
    base = both.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("diff").alias("mean_diff")).filter("n >= 3")
    every = base.join(bootstrap_ci(both, keys, "diff", "unit", replicates), keys).join(wilcoxon(both, keys).select(*keys, "z"), keys, "left").join(cliffs_delta(both, keys), keys)
    tested = every.withColumn("z", F.coalesce("z", F.lit(0.0))).withColumn("p", F.least(F.lit(1.0), normal_tail(F.col("z"))))
    return holm(tested, ["c1", "c2"], "p", ["metric"]).withColumn("magnitude", magnitude(F.col("delta")))
