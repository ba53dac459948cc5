"""Pieces shared by the corpus operators: word patterns, written intermediates, table reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import materialised as written
from ..functions.tables import shared_dir

__all__ = ["SPACE_CHARS", "SPACE_RUN", "WORD", "ascii_lower", "others", "read", "shared_dir", "words", "written"]

#: White space of the word contract: space and U+0009 to U+000D.
SPACE_CHARS = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """One of the input tables, narrowed to ``columns`` if any are named."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def words(text: Column) -> Column:
    """The words of ``text`` by the contract's pattern; null and blank texts give an empty array."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def others(df: DataFrame, *names: str) -> list[str]:
    """The columns of ``df`` but those called like one of ``names``, in any case of letters.

    Operators replace an input column that is called like one of their results.
    """
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]
