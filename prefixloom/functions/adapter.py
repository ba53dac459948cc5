"""What an engine brings along: a tokenizer, and ways to save, load and tell apart its states."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType


class Tokenizer(Protocol):
    """Text to token ids, alike at every call; it is sent to the workers, so it can be pickled."""

    def __call__(self, text: str) -> list[int]: ...


def tokens(tokenizer: Tokenizer, text: Column) -> Column:
    """The token ids of a text column, in batches; null for a null text."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if t is None else list(tokenizer(t)) for t in batch], dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, ArrayType(LongType()))(text)


@dataclass(frozen=True)
class Adapter:
    """Injected steps of a store, each from DataFrame to DataFrame or from columns to a column.

    ``fingerprint``: the identity of a row. ``save``: rows (name, payload) to the files' table. ``load``: files back to name and payload.
    """

    fingerprint: Callable[[DataFrame], Column]
    save: Callable[[DataFrame], DataFrame] = lambda df: df
    load: Callable[[DataFrame], DataFrame] = lambda df: df

    def published(self, states: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Entries (all columns but payload, and fp) and saved payloads of ``states`` (name, payload, ...)."""
        entries = states.withColumn("fp", self.fingerprint(states)).drop("payload")
        return entries, self.save(states.select("name", "payload"))

    def fetched(self, found: DataFrame, saved: DataFrame) -> DataFrame:
        """``found`` (entry) with the loaded payload, null where it is gone."""
        return found.join(self.load(saved).select(F.col("name").alias("entry"), "payload"), "entry", "left")
