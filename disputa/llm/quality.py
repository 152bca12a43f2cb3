"""Quality classifier: supervised subword embeddings.

A text's vector is the average of learned vectors of its hashed words plus the average of those of its hashed
character n-grams; a softmax layer reads it. Everything is trained by numpy stochastic gradient descent. As averaging
and the output layer are both linear, scoring collapses each bucket's vector to its difference of class logits.

Words are lower-case runs without white space; a word that repeats the one before it, or ends a three-word run
seen before in the text, also counts as a marker word, so that averages see repetition.

Defined results: a null or empty text has the score of the bias alone; ids that occur in several label rows take the
mean label, 0.5 counting as 1, and with several texts train on the one whose features have the least hash; null labels are left out; without label rows every score is 0.5; repeated rows give
repeated rows; extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from disputa.llm.common import bounded, code_points, fold_case, mix, remainder, span_hashes, steps, table, utf8, words
from disputa.llm.grams import ngrams, padded, spaced

#: Most labelled rows that training sees, those with the lowest hash of the id.
FIT_ROWS = 3000
#: Buckets of hashed words and of hashed character n-grams; lengths of the n-grams; dimensions.
WORD_BUCKETS, GRAM_BUCKETS, ORDERS, DIMENSIONS = 1 << 16, 1 << 17, (1, 2, 3), 12
EPOCHS, RATE, BATCH, SEED, SHRINK = 8, 0.5, 32, 5, 1e-5
#: From this score on, a text is predicted to be of quality.
THRESHOLD = 0.3
_REPEAT, _SEEN = np.uint64(1), np.uint64(2)


def features(texts: pa.Array) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray], int]:
    """((text index, bucket) of the words, the same of the n-grams, number of texts)."""
    data, spans = utf8(texts)
    data = fold_case(data)
    starts, ends, first = words(data, spans)
    n = len(spans) - 1
    hashes = span_hashes(data, starts, ends)
    owner = np.repeat(np.arange(n), np.diff(first))
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    again = np.zeros(len(hashes), bool)
    if len(hashes) > 2:
        inside = np.flatnonzero(owner[2:] == owner[:-2])
        runs = mix(mix(mix(hashes[inside]) + hashes[inside + 1]) + hashes[inside + 2] + mix(owner[inside].astype(np.uint64)))
        order = np.argsort(runs, kind="stable")
        later = order[1:][runs[order[1:]] == runs[order[:-1]]]
        again[inside[later] + 2] = True
    whose = np.concatenate([owner, owner[same], owner[again]])
    bucket = (np.concatenate([hashes, np.full(same.sum(), mix(_REPEAT[None])[0]), np.full(again.sum(), mix(_SEEN[None])[0])]) & np.uint64(WORD_BUCKETS - 1)).astype(np.int32)
    codes, offsets = code_points(texts)
    stream, by = padded(spaced(codes), offsets)
    found = [ngrams(stream, k) for k in ORDERS]
    return (whose, bucket), (np.concatenate([by[at] for at, _ in found]), (np.concatenate([h for _, h in found]) & np.uint64(GRAM_BUCKETS - 1)).astype(np.int32)), n


@dataclass
class Model:
    """Differences of class logits: of each word bucket, each n-gram bucket, and the bias."""

    word: np.ndarray
    gram: np.ndarray
    bias: float

    def score(self, texts: pa.Array) -> np.ndarray:
        parts, total = features(texts), None
        n = parts[2]
        total = np.full(n, self.bias)
        for (whose, bucket), weights in zip(parts[:2], (self.word, self.gram)):
            total += np.bincount(whose, weights[bucket], n) / np.maximum(1, np.bincount(whose, minlength=n))
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def train(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]) -> Model:
    """Stochastic gradient descent over (word buckets, their shares, gram buckets, their shares, label) rows."""
    if not rows:
        return Model(np.zeros(WORD_BUCKETS), np.zeros(GRAM_BUCKETS), 0.0)
    random = np.random.default_rng(SEED)
    vectors = [random.uniform(-1, 1, (size, DIMENSIONS)).astype(np.float32) / DIMENSIONS for size in (WORD_BUCKETS, GRAM_BUCKETS)]
    output, bias = (random.normal(0, 1, (DIMENSIONS, 2)) / DIMENSIONS).astype(np.float32), np.zeros(2, np.float32)
    labels = np.array([r[4] for r in rows])
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = random.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            hidden, used = np.zeros((len(pick), DIMENSIONS), np.float32), []
            for k in (0, 1):
                buckets = np.concatenate([rows[i][2 * k] for i in pick])
                shares = np.concatenate([rows[i][2 * k + 1] for i in pick])
                whose = np.repeat(np.arange(len(pick)), [len(rows[i][2 * k]) for i in pick])
                used.append((buckets, shares, whose))
                got = vectors[k][buckets] * shares[:, None]
                for d in range(DIMENSIONS):
                    hidden[:, d] += np.bincount(whose, got[:, d], len(pick))
            logits = hidden @ output + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            error = p
            error[np.arange(len(pick)), labels[pick]] -= 1
            back = error @ output.T
            output -= rate * (hidden.T @ error / len(pick) + SHRINK * output)
            bias -= rate * error.mean(0)
            for k, (buckets, shares, whose) in enumerate(used):
                unique, inverse = np.unique(buckets, return_inverse=True)
                step = back[whose] * shares[:, None]
                vectors[k][unique] -= rate * np.stack([np.bincount(inverse, step[:, d], len(unique)) for d in range(DIMENSIONS)], 1).astype(np.float32)
    gap = (output[:, 1] - output[:, 0]).astype(np.float64)
    return Model(vectors[0] @ gap, vectors[1] @ gap, float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Learns from at most ``fit_rows`` (doc_id, quality) rows of ``labels`` and the whole texts of these ids."""
    spark = docs.sparkSession
    sample = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    chosen = {r[0]: r[1] for r in sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows).collect()}
    shared = spark.sparkContext.broadcast(chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            kept = batch.filter(pa.array([i in own for i in ids], pa.bool_()))
            for part in steps(kept):
                *found, n = features(part.column("text"))
                columns = [part.column("doc_id").cast(pa.int64())]
                for whose, bucket in found:
                    order = np.lexsort((bucket, whose))
                    whose, bucket = whose[order], bucket[order]
                    new = np.flatnonzero(np.concatenate(([True], (whose[1:] != whose[:-1]) | (bucket[1:] != bucket[:-1])))) if len(whose) else np.zeros(0, int)
                    count = np.diff(np.append(new, len(whose)))
                    share = (count / np.bincount(whose, minlength=n)[whose[new]]).astype(np.float32)
                    cut = np.searchsorted(whose[new], np.arange(n + 1))
                    columns += [pa.array([bucket[new][a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary()), pa.array([share[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "w", "ws", "g", "gs"])

    got = bounded(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, w binary, ws binary, g binary, gs binary").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("w", "g").alias("hash"), "w", "ws", "g", "gs")).alias("row")).select("doc_id", "row.*").toArrow().sort_by("doc_id")
    return train([(np.frombuffer(r["w"], np.int32), np.frombuffer(r["ws"], np.float32), np.frombuffer(r["g"], np.int32), np.frombuffer(r["gs"], np.float32), chosen[r["doc_id"]]) for r in got.to_pylist()])


def predict(docs: DataFrame, model: Model, text: str = "text", score: str = "quality_score") -> DataFrame:
    """All columns of ``docs`` with the probability of quality."""
    from pyspark.sql import types as T

    keep = [c for c in docs.columns if c != score]
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(score, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part in steps(batch, text):
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(own.score(part.column(text)))], names=[*keep, score])

    return bounded(docs).select(*keep).mapInArrow(run, schema)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = remainder("doc_id", 5) == 0
    model = fit(docs, labels.filter(~held_out).select("doc_id", "quality"))
    score = F.col("quality_score")
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"))
