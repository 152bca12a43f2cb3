"""Language identification by Bloom filters of n-grams whose cells are bit masks over languages.

One lookup answers for all languages at once: a cell holds a bit for each language, and the AND of an n-gram's cells
is the set of languages that may contain it. A text's counts of set bits, less what false positives would give, decide.

Defined results: a null text and one without letters are ``und`` with score 0; a text whose n-grams no language has
gets the language with most training rows and score 0; ties go to the language with more training rows, then by name;
repeated rows give repeated rows, and equal training rows of a language count once; rows with a null id train like others;
extra columns do not matter and clashing names are replaced; without training rows every text is ``und``. Every language
of the training rows is learned; more than ``MOST_LANGUAGES`` different values are an error, as filters go to every task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from disputa.llm.bpe import char_classes
from disputa.llm.common import bounded, code_points, mix, remainder, steps, table
from disputa.llm.grams import letters_or_gap, ngrams, padded

#: Lengths of the n-grams.
ORDERS = (2, 3, 4)
#: Rows of each language from which the filters are learned, as an expected number: the rows whose hash of id and text is lowest.
FIT_ROWS = 1500
#: Share of a language's rows that must hold an n-gram for it to enter that language's filter.
LEAST_SHARE = 0.004
#: Cells of a filter (a power of 2) and hash functions.
CELLS, HASHES = 1 << 20, 3
#: Most languages, 8 to a slice of a cell; with more the training fails, as a column of so many values isn't one of languages.
MOST_LANGUAGES = 2048


@dataclass
class Filters:
    """cells: (slices, CELLS) bytes; false_positive: by language, the share of foreign n-grams that its bits let through."""

    languages: list[str]
    cells: np.ndarray
    false_positive: np.ndarray

    def masks(self, hashes: np.ndarray) -> list[np.ndarray]:
        """For each slice of eight languages, the byte of languages that may contain each n-gram."""
        first, step = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
        cells = [((first + np.uint64(i) * step) & np.uint64(CELLS - 1)).astype(np.int64) for i in range(HASHES)]
        out = []
        for part in self.cells:
            got = part[cells[0]]
            for cell in cells[1:]:
                got = got & part[cell]
            out.append(got)
        return out

    def counts(self, codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n-grams, hits by language) of each text, hits corrected for false positives."""
        n = len(offsets) - 1
        stream, owner = padded(letters_or_gap(codes), offsets)
        total, hits = np.zeros(n), np.zeros((n, 8 * len(self.cells)))
        bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
        for order in ORDERS:
            at, hashes = ngrams(stream, order)
            whose = owner[at]
            total += np.bincount(whose, minlength=n)
            for k, mask in enumerate(self.masks(hashes)):
                hits[:, 8 * k : 8 * k + 8] += np.bincount(whose * 256 + mask, minlength=n * 256).reshape(n, 256) @ bits
        hits = hits[:, : len(self.languages)]
        return total, np.maximum(0, (hits - total[:, None] * self.false_positive) / np.maximum(1e-9, 1 - self.false_positive))


def build(rows: list[tuple[str, int]], sizes: dict[str, int]) -> Filters:
    """Filters of (language, n-gram hash) rows; sizes: training rows by language."""
    languages = sorted(sizes, key=lambda name: (-sizes[name], name))
    cells = np.zeros((max(1, -(-len(languages) // 8)), CELLS), np.uint8)
    filled = np.zeros(len(languages))
    names, hashes = np.array([r[0] for r in rows], object), np.array([r[1] for r in rows], np.int64).view(np.uint64)
    for i, name in enumerate(languages):
        own = hashes[names == name] if len(rows) else hashes
        first, step = own & np.uint64(0xFFFFFFFF), (own >> np.uint64(32)) | np.uint64(1)
        for k in range(HASHES):
            cells[i // 8, ((first + np.uint64(k) * step) & np.uint64(CELLS - 1)).astype(np.int64)] |= np.uint8(1 << (i % 8))
        filled[i] = ((cells[i // 8] >> (i % 8)) & 1).mean()
    return Filters(languages, cells, filled**HASHES)


def fit(training: DataFrame, fit_rows: int = FIT_ROWS, least_share: float = LEAST_SHARE) -> Filters:
    """Learns from (doc_id, text, lang) rows: about ``fit_rows`` of each language, those with the lowest hash of id and text.

    An n-gram enters a language's filter if at least ``least_share`` of these rows (and one row) hold it.
    """
    spark = training.sparkSession
    training = bounded(training).filter("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r[0]: r[1] for r in training.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not sizes:
        return build([], {})
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    share = spark.createDataFrame([(k, int(min(1.0, fit_rows / v) * (1 << 30))) for k, v in sizes.items()], "lang string, below long")
    sample = training.join(F.broadcast(share), "lang").filter(draw < F.col("below")).select("lang", "text").distinct()

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch):
                codes, offsets = code_points(part.column("text"))
                stream, owner = padded(letters_or_gap(codes), offsets)
                langs = np.array(part.column("lang").to_pylist(), object)
                seen = [ngrams(stream, order) for order in ORDERS]
                hashes, whose = np.concatenate([h for _, h in seen]), np.concatenate([owner[at] for at, _ in seen])
                order = np.lexsort((hashes, whose))
                hashes, whose = hashes[order], whose[order]
                new = np.ones(len(hashes), bool)
                new[1:] = (hashes[1:] != hashes[:-1]) | (whose[1:] != whose[:-1])
                for name in sorted(set(langs)):
                    own, counts = np.unique(hashes[new & (langs == name)[whose]], return_counts=True) if len(hashes) else (hashes, np.zeros(0, int))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(own), pa.string()), pa.array(own.view(np.int64)), pa.array(counts, pa.int64())], names=["lang", "gram", "n"])

    counted = sample.mapInArrow(grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    least = spark.createDataFrame([(k, least_share * min(v, fit_rows)) for k, v in sizes.items()], "lang string, least double")
    rows = counted.join(F.broadcast(least), "lang").filter("n >= least").select("lang", "gram").toArrow()
    return build(list(zip(rows.column("lang").to_pylist(), rows.column("gram").to_pylist())), sizes)


def predict(docs: DataFrame, filters: Filters, text: str = "text", pred: str = "lang_pred", score: str = "lang_score") -> DataFrame:
    """All columns of ``docs`` with the predicted language and its share of the text's n-grams (0 to 1)."""
    from pyspark.sql import types as T

    keep = [c for c in docs.columns if c not in (pred, score)]
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        names = np.array([*own.languages, "und"], object)
        for batch in batches:
            for part in steps(batch, text):
                codes, offsets = code_points(part.column(text))
                n = len(offsets) - 1
                letters = np.concatenate(([0], np.cumsum(char_classes()[codes] == 0)))[offsets]
                has = np.diff(letters) > 0
                if own.languages:
                    total, hits = own.counts(codes, offsets)
                    best = hits.round(6).argmax(1)
                    value = hits[np.arange(n), best] / np.maximum(1, total)
                else:
                    best, value, has = np.zeros(n, int), np.zeros(n), np.zeros(n, bool)
                best, value = np.where(has, best, len(own.languages)), np.where(has, np.clip(value, 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(names[best], pa.string()), pa.array(value)], names=[*keep, pred, score])

    return bounded(docs).select(*keep).mapInArrow(run, schema)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 4) == 2
    filters = fit(docs.filter(~held_out).select("doc_id", "text", "lang"))
    return predict(docs.select("doc_id", "text"), filters).select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
