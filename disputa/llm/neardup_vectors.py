"""Near-duplicate vectors: p-stable hashing for Euclidean distance, then exact cosines.

Normalised vectors are projected on Gaussian directions, shifted and quantised; the quanta of several projections
are a bucket, and many tables of buckets are searched. Projections by table and tables follow from the number of
vectors: random vectors meet ``PURITY`` others of a table on average, and a pair at the threshold meets in some table
with probability ``RECALL``, closer pairs more surely.

Equal vectors are one class from the start. In a bucket, each class is first tried with the least one;
tries with an exact cosine (double precision) of the threshold are links, whose components are found on written
tables. A bucket whose other classes are not all of one component by then is compared whole, all pairs, so that every
pair that meets in a bucket is tried or already joined. Links are then counted whole inside each component. Both are
products of blocks of about ``BLOCK`` vectors, so no list of all pairs is made and a large bucket or component is many
small tasks.

Defined results: null, empty and zero vectors and those with null or non-finite components link with nothing; vectors of
different lengths are never linked; rows with one id count as vectors of their own; labels and other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from disputa.llm.common import Scratch, mix, runs, table
from disputa.llm.components import components

#: Links need this cosine; width of a quantum; recall at the threshold; random mates in a bucket; vectors of a block.
THRESHOLD, WIDTH, RECALL, PURITY, BLOCK, SEED = 0.9, 2.0, 0.9, 0.05, 512, 23


def collision(distance: float, width: float = WIDTH) -> float:
    """Probability that one quantised Gaussian projection is equal for two points at a distance."""
    if distance <= 0:
        return 1.0
    r = width / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def shape(n: int, threshold: float = THRESHOLD, recall: float = RECALL, purity: float = PURITY) -> tuple[int, int]:
    """(projections of a table, tables) for n vectors."""
    near, far = collision(math.sqrt(2 - 2 * threshold)), collision(math.sqrt(2))
    k = max(4, math.ceil(math.log(max(2, n) / purity) / -math.log(far)))
    return k, max(1, math.ceil(math.log(1 - recall) / math.log(1 - near**k)))


def by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, unit vectors in double precision) of the rows that can link, for each length of vectors."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    for length in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == length)
        flat = column.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(rows), length)
        with np.errstate(over="ignore", invalid="ignore"):
            top = np.abs(flat).max(1)  # scaling first keeps squares in range
            good = np.isfinite(top) & (top > 0)
            rows, flat = rows[good], flat[good] / top[good][:, None]
        if len(rows):
            yield rows, flat / np.sqrt((flat * flat).sum(1))[:, None]


def _met(classes: DataFrame, k: int, tables: int) -> DataFrame:
    """(bucket, n, a, b) of buckets with n > 1 classes: each class b with the least id a of its bucket."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                ids = batch.column("id").to_numpy()
                for rows, unit in by_length(batch.column("embedding")):
                    length = unit.shape[1]
                    if length not in drawn:
                        random = np.random.default_rng((SEED, length))
                        drawn[length] = random.normal(size=(length, k * tables)), random.uniform(0, WIDTH, k * tables)
                    directions, shifts = drawn[length]
                    quanta = np.floor((unit @ directions + shifts) / WIDTH).astype(np.int64).astype(np.uint64).reshape(len(rows), tables, k)
                    key = np.full((len(rows), tables), length, np.uint64) + np.arange(tables, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                    for j in range(k):
                        key = mix(key * np.uint64(0xD6E8FEB86659FD93) + quanta[:, :, j])
                    yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(np.repeat(ids[rows], tables))], names=["bucket", "id"])

    placed = classes.select("id", "embedding").mapInArrow(hashed, "bucket long, id long")
    least = placed.groupBy("bucket").agg(F.min("id").alias("a"), F.count("*").alias("n")).filter("n > 1")
    return placed.join(least, "bucket").filter("id <> a").select("bucket", "n", "a", F.col("id").alias("b"))


def _verified(tries: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The tries whose exact cosine reaches the threshold."""
    one, two = (classes.select(F.col("id").alias(side), F.col("embedding").alias(f"v{side}")) for side in "ab")
    joined = tries.join(one, "a").join(two, "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                left, right = {}, {}
                for side, into in (("va", left), ("vb", right)):
                    for rows, unit in by_length(batch.column(side)):
                        into.update(zip(rows.tolist(), unit))
                both = [i for i in left if i in right and len(left[i]) == len(right[i])]
                good = [i for i in both if float(np.dot(left[i], right[i])) >= threshold]
                yield batch.select(["a", "b"]).take(pa.array(good, pa.int64()))

    return joined.select("a", "b", "va", "vb").mapInArrow(run, "a long, b long")


def _forest(close: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect whatever a symmetric matrix of links connects: one for each vertex reached from another."""
    left, out = np.ones(len(close), bool), []
    for seed in range(len(close)):
        reached = [seed] if left[seed] else []
        left[seed] = False
        while reached:
            at = reached.pop()
            new = np.flatnonzero(close[at] & left).tolist()
            left[new] = False
            out += [(at, i) for i in new]
            reached += new
    return out


def _crowded(met: DataFrame, labels: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b) links that connect the classes of each bucket beyond the tries with its least id; labels: (id, component) so far.

    Only buckets where classes besides the least are of several components have anything to add.
    """
    named = met.filter("n > 2").join(labels.withColumnRenamed("id", "b"), "b", "left").select("bucket", "n", F.col("b").alias("id"), F.coalesce("component", "b").alias("component"))
    mixed = named.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("bucket")
    blocks = F.ceil((F.col("n") - 1) / BLOCK).cast("long")
    dealt = named.join(mixed, "bucket").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    # A block meets every other block of its bucket; a pair of blocks compares all its vectors.
    paired = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).filter("blocks = 1 OR block <> other")
    paired = paired.select("bucket", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, ["bucket", "x", "y"]):
            ids = rows.column("id").to_numpy()
            for at, unit in by_length(rows.column("embedding").combine_chunks()):
                found = np.array(_forest(unit @ unit.T >= threshold), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at[found[:, i]]]) for i in (0, 1)], names=["a", "b"])

    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = paired.join(classes.select("id", "embedding"), "id").repartition(n, "bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")
    return packed.mapInArrow(run, "a long, b long").distinct()


def _degrees(members: DataFrame, threshold: float) -> DataFrame:
    """(id, n) with n the linked rows of other classes; members: id, component, times, embedding of components of two or more."""
    sizes = members.groupBy("component").agg(F.count("*").alias("size"))
    blocks = F.ceil(F.col("size") / BLOCK).cast("long")
    dealt = members.join(sizes, "component").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    # A block meets every block of its component, itself included: rows are repeated once for each.
    paired = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    paired = paired.select("component", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "id", "times", "embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, ["component", "x", "y"]):
            ids, times, block = (rows.column(c).to_numpy() for c in ("id", "times", "block"))
            same = rows.column("x")[0].as_py() == rows.column("y")[0].as_py()
            for at, unit in by_length(rows.column("embedding").combine_chunks()):
                mine, weight = ids[at], times[at]
                if same:
                    n = np.zeros(len(at), np.int64)
                    for a in range(0, len(at), BLOCK):
                        close = unit[a : a + BLOCK] @ unit.T >= threshold
                        close[np.arange(len(close)), np.arange(a, a + len(close))] = False
                        n[a : a + BLOCK] = close @ weight
                    yield pa.RecordBatch.from_arrays([pa.array(mine), pa.array(n)], names=["id", "n"])
                else:
                    low = block[at] == rows.column("x")[0].as_py()
                    close = unit[low] @ unit[~low].T >= threshold
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([mine[low], mine[~low]])), pa.array(np.concatenate([close @ weight[~low], weight[low] @ close]).astype(np.int64))], names=["id", "n"])

    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = paired.repartition(n, "component", "x", "y").sortWithinPartitions("component", "x", "y")
    return packed.mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row of ``vectors``."""
    scratch = Scratch(vectors.sparkSession)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"))
    key = [F.xxhash64("embedding").alias("k1"), F.xxhash64(F.lit(SEED), F.col("embedding")).alias("k2")]
    usable = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0)
    classes = scratch.keep(rows.filter(usable).groupBy(*key).agg(F.min("vec_id").alias("id"), F.count("*").alias("times"), F.first("embedding").alias("embedding")), "classes")
    k, tables = shape(classes.count(), threshold, recall)
    met = scratch.keep(_met(classes, k, tables), "met")
    links = scratch.keep(_verified(met.select("a", "b").distinct(), classes, threshold), "links")
    labels = scratch.keep(components(links, scratch), "labels")
    more = scratch.keep(_crowded(met, labels, classes, threshold), "more")
    scratch.drop(met)
    if not more.isEmpty():
        labels = scratch.keep(components(links.unionByName(more), scratch), "labels")
    degrees = _degrees(classes.join(labels, "id").select("id", "component", "times", "embedding"), threshold)
    found = scratch.keep(classes.select("k1", "k2", "id", "times").join(labels, "id", "left").join(degrees, "id", "left").select("k1", "k2", F.coalesce("component", "id").alias("component"), (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n")), "found")
    named = rows.select("vec_id", *[F.when(usable, k).alias(f"k{i}") for i, k in enumerate(key, 1)])
    own = F.coalesce("component", "vec_id")
    return named.join(found, ["k1", "k2"], "left").select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), (own == F.col("vec_id")).alias("kept"))


def op6_vector_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
