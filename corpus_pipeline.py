"""The corpus pipeline: language, near-dedup, decontamination, personal data, mixing, over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last
return the columns of ``docs``. Rows are told apart by a 128-bit digest of id and text, so that null and
repeated ids need no care. Between stages the rows are a written table; it and a stage's own tables are
deleted once the next stage's rows are written.

Defined results: null texts and texts without a letter leave at the first stage; of a group of near
copies the row of the least doc_id stays (ids before null, then the least digest), repeated rows once;
very long texts go through whole; other columns pass through, whatever their names; an empty table stays
empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prefixloom.functions import tables
from prefixloom.llm import decontaminate, jaccard, keyset, language_id, mixing, pii
from prefixloom.llm.common import others, read, written

ORACLE_SQL = None


def _key() -> Column:
    """128 bits of id and text; null is no text and no id, and nothing else."""
    parts = [F.when(F.col(c).isNull(), "-").otherwise(F.concat(F.lit("+"), F.col(c).cast("string"))) for c in ("doc_id", "text")]
    return F.unhex(F.md5(F.concat(parts[0], F.lit(" "), parts[1])))


def _name(docs: DataFrame) -> str:
    """A column name that ``docs`` has not."""
    taken, name = {c.lower() for c in docs.columns}, "_key"
    while name in taken:
        name += "_"
    return name


def _apart(docs: DataFrame, results: tuple[str, ...], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``stage`` of ``docs`` with the columns of ``docs``, those that are called like its results included."""
    away = {c: f"_own_{i}_{c}" for i, c in enumerate(docs.columns) if c not in others(docs, *results)}
    back = {v: k for k, v in away.items()}
    return stage(docs.withColumnsRenamed(away)).select(*[F.col(away.get(c, c)).alias(c) for c in docs.columns]) if back else stage(docs).select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter; a missing ``lang`` is filled in. Ambiguous texts stay: only letterless ones are rejected."""
    model = language_id.fit(docs.where(language_id.remainder(F.col("doc_id"), 4) != 2).select("doc_id", "text", "lang"))
    told = lambda rows: language_id.predicted(rows, model, drop_text=False).where("lang_pred <> 'und'").withColumn("lang", F.coalesce("lang", "lang_pred"))
    return _apart(docs, language_id.RESULTS, told)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: 5-word shingles, Jaccard similarity 0.8 or more."""
    key = _name(docs)
    groups = jaccard.near_copies(docs.select("doc_id", "text", _key().alias(key)), key)
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", key)).alias("m"))
    kept = first.select(F.col(f"m.{key}").alias(key), F.lit(True).alias("stays"))
    # Keys of rows that go, and of repeated rows; all other rows stay without a shuffle.
    told = groups.groupBy(key).agg(F.count("*").alias("n")).join(kept, key, "left")
    told = written(told.where("n > 1 or not coalesce(stays, false)").select(key, F.coalesce("stays", F.lit(False)).alias("stays")))
    rows, keys = docs.withColumn(key, _key()), keyset.Keys(told, key)
    first = keys.within(rows).join(told.where("not stays").select(key), key, "left_anti").dropDuplicates([key])
    return keys.without(rows).unionByName(first).drop(key)


def clear_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    items = read(spark, sf_dir, "benchmark", "item_id", "text")
    key = _name(docs)
    found = decontaminate.contamination(docs.select("text", _key().alias(key)), items).where("contaminated")
    hit = written(found.select(key).distinct())  # its size decides how the join is done
    return docs.withColumn(key, _key()).join(hit, key, "left_anti").drop(key)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind."""
    out = _apart(docs, pii.RESULTS, pii.redacted)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with their source's target and the words taken."""
    out = mixing.mix(docs).where("taken > 0")
    return out.select("doc_id", "source", *mixing.RESULTS)


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontaminate", clear_of_benchmark),
    ("redact", redact),
    ("mix", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), set(tables.tables())
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
        *done, _ = (t for t in tables.tables() if t not in before)
        tables.release(done)
    return STAGES[-1][1](spark, docs, sf_dir)
