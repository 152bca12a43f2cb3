"""Helpers shared by the operators of this folder: table access, shared scratch tables, batch slicing, hashing."""

from __future__ import annotations

import atexit
import contextlib
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of UTF-8 text that one numpy step works on; longer documents are a step of their own.
STEP_BYTES = 1 << 18
#: Bytes of an Arrow batch that is sent to Python; a longer row is a batch of its own.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Reads a Parquet table of the data folder (any file system that Spark's readers open)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the id's decimal text modulo ``modulus``; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % F.lit(modulus)


def bounded(docs: DataFrame) -> DataFrame:
    """The same table; from here on the session sends Python no Arrow batches above ``BATCH_BYTES``, however long texts are."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return docs


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Where the session names none, a local master gets a temporary one; a cluster is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._conf.get("spark.checkpoint.dir")
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="disputa-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Scratch:
    """Tables written to the shared folder, which cut lineage and outlive executors; ``drop`` frees one early."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{scratch_root(spark)}/scratch-{uuid.uuid4().hex}"
        atexit.register(self._clean)

    def _clean(self) -> None:
        """Deletes what is left when the program ends, if the session is still there."""
        if self.spark.sparkContext._jsc is not None:
            with contextlib.suppress(Exception):
                self._delete(self.root)

    def _delete(self, name: str) -> None:
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def release(self) -> None:
        """Lets Spark remove the shuffle files of plans that nothing refers to any more; else they wait for the driver's next full collection."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *tables: DataFrame) -> None:
        """Deletes the files of tables that no later plan reads."""
        for df in tables:
            self._delete(df._scratch_path)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; a null is an empty text."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(batch: pa.RecordBatch, text: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts an Arrow batch into runs of rows with about ``limit`` bytes of text, so that work arrays stay small."""
    if not batch.num_rows:
        return
    _, offsets = utf8(batch.column(text))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the splitmix finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_ODD, _POWERS, _INVERSES = 0x9E3779B97F4A7C15, np.ones(1, np.uint64), np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        size = max(n, 1 << 20)
        out = []
        for base in (_ODD, pow(_ODD, -1, 1 << 64)):
            full = np.full(size, base, np.uint64)
            full[0] = 1
            out.append(np.multiply.accumulate(full))
        _POWERS, _INVERSES = out
    return _POWERS, _INVERSES


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of codes[start:end] for all spans at once, by one running polynomial sum."""
    powers, inverses = _powers(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(mix(np.arange(256, dtype=np.uint64) + np.uint64(1))[codes] * powers[: len(codes)] if codes.dtype == np.uint8 else mix(codes.astype(np.uint64) + np.uint64(1)) * powers[: len(codes)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def fold_case(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, nothing else; UTF-8 bytes of other letters are all over 127."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


#: The ASCII white space that ends a word, 0x20 and 0x09-0x0D.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, index of the first word of each text and the end) of maximal runs without white space within each text."""
    inside = ~SPACE[data]
    first = inside.copy()
    if len(data):
        first[1:] &= ~inside[:-1]
        cut = offsets[:-1][offsets[:-1] < len(data)]
        first[cut] = inside[cut]
    starts = np.flatnonzero(first)
    last = inside.copy()
    if len(data):
        last[:-1] &= ~inside[1:]
        cut = offsets[1:][offsets[1:] > 0] - 1
        last[cut] = inside[cut]
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets) of all texts in a row; a null is empty."""
    parts = [t or "" for t in texts.to_pylist()]
    offsets = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(t) for t in parts], out=offsets[1:])
    return np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32), offsets


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys, across batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)
