"""A training corpus from raw documents, stage by stage; each stage reads what the one before it wrote.

Every stage takes (spark, docs, sf_dir) and returns the columns of ``documents``, the last one the tokens. Rows are
dropped only by decisions: language and quality rejections, and near-duplicates, of which the smallest doc_id stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from disputa.llm import bpe, langid, mixing, neardup_texts, quality
from disputa.llm.common import Scratch, remainder, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text is rejected if less than this share of its n-grams is of the language that fits best.
LEAST_LANGUAGE_SCORE = 0.5
#: Most repetitions of a source in the mix.
REPETITIONS = 2.0


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts in a known language; texts without letters go."""
    filters = langid.fit(docs.filter(remainder("doc_id", 4) != 2).select("doc_id", "text", "lang"))
    found = langid.predict(docs.select(*COLUMNS), filters)
    return found.filter(f"lang_pred <> 'und' AND lang_score >= {LEAST_LANGUAGE_SCORE}").select(*COLUMNS)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts that the quality classifier, learned from the labels of the documents at hand, accepts."""
    labels = table(spark, sf_dir, "labels").filter(remainder("doc_id", 5) != 0)
    model = quality.fit(docs, labels.select("doc_id", "quality"))
    return quality.predict(docs.select(*COLUMNS), model).filter(F.col("quality_score") >= quality.THRESHOLD).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of similar ones, that with the smallest doc_id.

    Rows with equal id and text are one document, with the least (lang, source, n_chars) of theirs; an id with different
    texts keeps each of them, as none may be lost that isn't similar; rows without an id are all kept.
    """
    found = neardup_texts.near_duplicates(docs)
    kept = Scratch(spark).keep(found.filter("doc_id = component_id").select("doc_id").distinct(), "kept")
    rest = F.min(F.struct("lang", "source", "n_chars")).alias("rest")
    alone = docs.select(*COLUMNS).join(kept, "doc_id", "left_semi").groupBy("doc_id", F.xxhash64("text").alias("hash")).agg(F.first("text").alias("text"), rest).select("doc_id", "text", "rest.*")
    return alone.unionByName(docs.filter("doc_id IS NULL").select(*COLUMNS))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents so that sources have their tempered weights; every document stays at least once."""
    return mixing.mix(docs.select(*COLUMNS), limit=REPETITIONS).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, token_ids, decoded_sha256): the ids and the digest of the bytes that they decode to."""
    return bpe.encode_checked(docs.select("doc_id", "source", "text"))


STAGES = [
    ("language ID", language_id),
    ("quality classifier", quality_filter),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mixture),
    ("byte-level BPE encoding and decoding", tokens),
]

#: Trained models can't be said in SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
