"""Caches of expensive answers as tables, prices, usage and budgets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def request_key(*parts: Column) -> Column:
    """SHA-256 of the parts as JSON: equal requests, equal keys."""
    return F.sha2(F.to_json(F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)])), 256)


def text_key(model: str, size: int, text: Column) -> Column:
    return F.sha2(F.concat_ws("\x00", F.lit(model), F.lit(str(size)), text), 256)


def split_hits(requests: DataFrame, cache: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(rows with their cached answer, distinct keys still to be asked)."""
    return requests.join(cache, key), requests.join(cache.select(key), key, "left_anti").dropDuplicates([key])


def fill(requests: DataFrame, cache: DataFrame, ask: Callable[[list[str]], list[str]], key: str = "key", text: str = "text", per_second: float | None = None) -> DataFrame:
    """The cache (key, answer) with answers for all distinct missing requests; each task asks in batches, at most so often."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        last = 0.0
        for frame in frames:
            for at in range(0, len(frame), 96):
                part = frame.iloc[at : at + 96]
                if per_second:
                    time.sleep(max(0.0, last + 1 / per_second - time.monotonic()))
                    last = time.monotonic()
                yield pd.DataFrame({key: part[key], "answer": retried(ask, part[text].tolist())})

    missing = split_hits(requests, cache, key)[1].select(key, text)
    return cache.select(key, "answer").unionByName(missing.mapInPandas(run, f"{key} string, answer string"))


#: Status codes worth another try.
RETRYABLE = (408, 409, 429)


class AnswerError(Exception):
    def __init__(self, status: int):
        super().__init__(f"status {status}")
        self.status = status


def retryable(status: int) -> bool:
    return status in RETRYABLE or status >= 500


def retried(ask: Callable, texts: list[str], tries: int = 4, first: float = 1.0, most: float = 30.0, sleep: Callable[[float], None] | None = None) -> list[str]:
    """Asks up to ``tries`` times, waiting 50 to 100 % of a doubling delay."""
    import random
    import time

    for attempt in range(tries):
        try:
            return ask(texts)
        except AnswerError as error:
            if not retryable(error.status) or attempt == tries - 1:
                raise
            (sleep or time.sleep)(min(most, first * 2**attempt) * random.uniform(0.5, 1.0))
    raise AssertionError


def priced(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Every row of usage (model, ...) with the price of the longest name that begins the model's name; names are matched once for each model."""
    models = usage.select("model").distinct()
    hit = models.join(prices, F.startswith(models["model"], prices["name"]), "left").groupBy("model").agg(F.max_by(F.struct(*prices.columns), F.length("name")).alias("price"))
    return usage.join(hit, "model", "left").select(*usage.columns, "price")


def cost(input_tokens: Column, cached_tokens: Column, output_tokens: Column, price: Column) -> Column:
    """Dollars, prices being by million tokens; cached input has a rate of its own."""
    return ((input_tokens - cached_tokens) * price["input"] + cached_tokens * price["cached"] + output_tokens * price["output"]) / 1e6


def within_budget(spent: DataFrame, order: str, amount: str, budget: float, keys: list[str]) -> DataFrame:
    """Rows up to the first that brings the running sum to the budget."""
    before = F.coalesce(F.sum(amount).over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    return spent.withColumn("before", before).filter(F.col("before") < budget).drop("before")
