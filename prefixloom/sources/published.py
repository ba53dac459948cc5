"""Tables published by version, captures of a growing store, line-framed events, and reports of small results."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

POINTER = "CURRENT"


def _fs(spark: SparkSession, path: str):
    jvm, sc = spark._jvm, spark.sparkContext
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(sc._jsc.hadoopConfiguration()), target, jvm.org.apache.hadoop.fs.Path


def publish(df: DataFrame, root: str) -> str:
    """Writes ``df`` as a new version under ``root`` and makes it current; readers see the old or the new one, never half of it.

    The version is written first, by Spark's own commit; the pointer is then put in place by one rename. Versions
    stay until they are removed by ``prune``.
    """
    spark = df.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{version}")
    fs, _, path = _fs(spark, root)
    temporary = path(f"{root}/.{POINTER}.{uuid.uuid4().hex}")
    out = fs.create(temporary, False)
    out.write(bytearray(version.encode()))
    out.close()
    pointer = path(f"{root}/{POINTER}")
    options = spark._jvm.org.apache.hadoop.fs.Options.Rename
    rename = spark.sparkContext._gateway.new_array(options, 1)
    rename[0] = options.OVERWRITE
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(pointer.toUri() if pointer.toUri().getScheme() else fs.getUri(), fs.getConf()).rename(temporary, pointer, rename)
    return version


def version(spark: SparkSession, root: str) -> str | None:
    """The current version; null where nothing is published."""
    fs, _, path = _fs(spark, root)
    if not fs.exists(path(f"{root}/{POINTER}")):
        return None
    return spark.read.text(f"{root}/{POINTER}").first()[0]


def current(spark: SparkSession, root: str) -> DataFrame:
    return snapshot(spark, root, version(spark, root))


def snapshot(spark: SparkSession, root: str, of: str) -> DataFrame:
    """A version as it was, whatever has been published since."""
    return spark.read.parquet(f"{root}/{of}")


def versions(spark: SparkSession, root: str) -> list[str]:
    fs, target, _ = _fs(spark, root)
    return sorted(n for s in fs.listStatus(target) if (n := s.getPath().getName()).startswith("v-"))


def prune(spark: SparkSession, root: str, keep: set[str]) -> list[str]:
    """Removes versions but the current one and ``keep``; returns their names."""
    fs, _, path = _fs(spark, root)
    now = version(spark, root)
    gone = [v for v in versions(spark, root) if v != now and v not in keep]
    for v in gone:
        fs.delete(path(f"{root}/{v}"), True)
    return gone


def captured(captures: DataFrame, chain: str = "chain", turn: str = "turn", names: str = "names") -> DataFrame:
    """``chain``, ``turn``, new (the names not seen in any earlier turn) and problem: each turn of a growing store must add exactly one."""
    w = Window.partitionBy(chain).orderBy(turn)
    rows = captures.select(chain, turn, F.explode_outer(names).alias("_name"))
    first = rows.groupBy(chain, "_name").agg(F.min(turn).alias("_first"))
    new = rows.join(first, [chain, "_name"], "left").withColumn("_new", F.when(F.col(turn) == F.col("_first"), F.col("_name")))
    out = new.groupBy(chain, turn).agg(F.array_sort(F.collect_set("_new")).alias("new"))
    start = F.row_number().over(w) == 1
    return out.withColumn("problem", F.when(~start & (F.size("new") != 1), F.concat(F.size("new").cast("string"), F.lit(" new names"))))


def event_frames(lines: DataFrame, line: str = "value") -> DataFrame:
    """``lines`` with data (the text of an event line), kind (event, done, comment, blank or other); plain JSON lines are events too."""
    text = F.regexp_replace(F.col(line), r"\r$", "")
    data = F.when(text.startswith("data:"), F.regexp_replace(text, r"^data: ?", "")).when(text.rlike(r"^\s*\{"), F.trim(text))
    kind = F.when(data == "[DONE]", "done").when(data.isNotNull(), "event").when(F.trim(text) == "", "blank").when(text.startswith(":"), "comment").otherwise("other")
    return lines.withColumns({"data": F.when(kind == "event", data), "kind": kind})


def events(lines: DataFrame, schema: str, stream: str, order: str, line: str = "value") -> DataFrame:
    """Parsed events of each ``stream`` up to its terminator: ``stream``, ``order``, event, bad (text that doesn't parse). Lines after the terminator are left out.

    A stream's end is the least place of a terminator, joined back; over a structured stream use ``event_frames`` alone.
    """
    f = event_frames(lines, line)
    done = f.where("kind = 'done'").groupBy(F.col(stream).alias("_s")).agg(F.min(order).alias("_end"))
    j = f.where("kind = 'event'").join(done, F.col(stream).eqNullSafe(F.col("_s")), "left").where(F.col("_end").isNull() | (F.col(order) < F.col("_end")))
    parsed = F.from_json("data", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    out = j.withColumn("event", parsed)
    sound = F.try_parse_json("data").isNotNull()
    return out.select(stream, order, F.when(sound, F.col("event")).alias("event"), F.when(~sound, F.col("data")).alias("bad"))


def report(df: DataFrame, order: list[str], most: int = 1000) -> dict[str, str]:
    """A small result as ``json`` and ``markdown`` text, at most ``most`` rows in ``order``; more are an error, never left out."""
    rows = df.orderBy(*order).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    names = df.columns
    lines = ["| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    lines += ["| " + " | ".join("n/a" if r[n] is None else str(r[n]) for n in names) + " |" for r in rows]
    return {"json": json.dumps([r.asDict(recursive=True) for r in rows], indent=1, default=str, ensure_ascii=False), "markdown": "\n".join(lines) + "\n"}


def write_report(df: DataFrame, path: str, order: list[str], most: int = 1000) -> None:
    """The JSON text of ``report`` as one file, through Spark."""
    df.sparkSession.createDataFrame([(report(df, order, most)["json"],)], "value string").coalesce(1).write.text(path)
