"""Host-level quality rules (operator 4), DataFrame functions only.

Each document is measured (words, symbols, repeated lines, repeated five-word windows) and held
against simple rules. Failures are summed by host (here: ``source``), each host's failure rate is
shrunk towards the corpus by a beta prior whose parameters are fitted to the rates of all hosts
(method of moments), and the verdict on the host is joined back to its documents.

Defined results for odd input: a null text has no words and fails ``short``; a null source is a
host of its own; repeated rows are judged one by one; an empty table gives an empty result; extra
columns pass through ``measured`` and ``judge``, but for those named like a result, which are replaced.

Windows are compared by a 64-bit hash of their five word hashes: two different windows of a text of
a million words collide with a probability under 1e-7.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, others, words, written

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MAX_SYMBOL_RATIO = 0.5
MAX_DUP_LINE_RATIO = 0.5
#: A host is rejected if the shrunk failure rate of any rule is above this.
MAX_HOST_RATE = 0.6
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def rules() -> dict[str, Column]:
    """The rules over the measures; true: the document fails."""
    n = F.col("n_words")
    return {
        "short": n < MIN_WORDS,
        "repeats": 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n,
        "symbols": F.col("n_symbols") > MAX_SYMBOL_RATIO * F.col("word_chars"),
        "lines": F.col("n_dup_lines") > MAX_DUP_LINE_RATIO * F.col("_qr_lines"),
    }


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with the five MEASURES (long) and ``_qr_lines``; one pass, no shuffle."""
    kept = [F.col(c) for c in others(docs, text, *MEASURES, "base_failed", "kept", "host_ok")]
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda line: F.btrim(line, F.lit(SPACE_CHARS)) != "")
    # Each select below uses the last one's arrays more than once, which keeps Spark from inlining them.
    out = docs.select(*kept, t.alias("_qr_t"), words(F.col(text)).alias("_qr_w"), lines.alias("_qr_l"))
    out = out.select(
        *kept,
        F.size("_qr_w").cast("long").alias("n_words"),
        F.length(F.array_join("_qr_w", "")).cast("long").alias("word_chars"),
        (F.length("_qr_t") - F.length(F.regexp_replace("_qr_t", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size("_qr_l") - F.size(F.array_distinct("_qr_l"))).cast("long").alias("n_dup_lines"),
        F.size("_qr_l").cast("long").alias("_qr_lines"),
        F.transform("_qr_w", lambda w: F.xxhash64(w)).alias("_qr_h"),
    )
    rest = [F.col(c) for c in out.columns if c != "_qr_h"]
    m = F.greatest(F.size("_qr_h") - (WINDOW - 1), F.lit(0))
    out = out.select(*rest, F.transform(F.arrays_zip(*[F.slice("_qr_h", k + 1, m).alias(f"w{k}") for k in range(WINDOW)]), lambda z: F.xxhash64(z)).alias("_qr_g"))
    # Only texts that repeat a window get sorted (hash, position) pairs.
    pairs = F.sort_array(F.transform("_qr_g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.select(*rest, F.when(F.size(F.array_distinct("_qr_g")) < F.size("_qr_g"), pairs).alias("_qr_s"))
    hashes = F.col("_qr_s.h")
    none = F.array(F.lit(None).cast("bigint"))
    beside = F.arrays_zip(F.col("_qr_s").alias("s"), F.concat(none, hashes).alias("before"), F.concat(F.slice(hashes, 2, F.size("_qr_s")), none).alias("after"))
    twice = F.filter(beside, lambda z: (z["s"]["h"] == z["before"]) | (z["s"]["h"] == z["after"]))
    out = out.select(*rest, F.sort_array(F.transform(twice, lambda z: z["s"]["i"])).alias("_qr_p"))
    gaps = F.zip_with("_qr_p", F.slice("_qr_p", 2, F.size("_qr_p")), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    count = F.when(F.col("_qr_p").isNull(), F.lit(0)).otherwise(F.aggregate(gaps, F.lit(0), lambda s, g: s + g))
    return out.select(*rest, count.cast("long").alias("n_repeat_words"))


def host_verdicts(measures: DataFrame, host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """A row per host: ``host``, n_docs, the shrunk failure rate of each rule, host_ok.

    The prior of a rule is the beta distribution with the mean and variance of the hosts' rates; if
    the rates don't vary (or there is one host), it weighs as much as the mean host's documents.
    """
    names = list(rules())
    sums = measures.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n_docs"), *[F.sum(r.cast("long")).alias(f"_f_{k}") for k, r in rules().items()])
    rate = {k: F.col(f"_f_{k}") / F.col("n_docs") for k in names}
    prior = sums.agg(F.struct(F.avg("n_docs").alias("size"), *[F.avg(rate[k]).alias(f"m_{k}") for k in names], *[F.var_pop(rate[k]).alias(f"v_{k}") for k in names]).alias("p"))
    both = sums.withColumn("_p", prior.scalar())
    out = [F.col("host"), F.col("n_docs")]
    for k in names:
        m, v = F.col(f"_p.m_{k}"), F.col(f"_p.v_{k}")
        weight = F.when(v > 1e-12, F.greatest(m * (1 - m) / F.greatest(v, F.lit(1e-12)) - 1, F.lit(0.0))).otherwise(F.col("_p.size"))
        out.append(((F.col(f"_f_{k}") + weight * m) / (F.col("n_docs") + weight)).alias(f"rate_{k}"))
    shrunk = both.select(*out)
    return shrunk.withColumn("host_ok", F.greatest(*[F.col(f"rate_{k}") for k in names]) <= max_rate)


def judge(docs: DataFrame, text: str = "text", host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """``docs`` without ``text``, with MEASURES, base_failed and kept.

    The measures are written once and read twice (by host, then by document). The join is by host;
    a hot host's rows can be split by adaptive execution, its verdict is one row.
    """
    r = rules()
    m = written(measured(docs, text).withColumn("base_failed", r["short"] | r["repeats"]))
    v = host_verdicts(m, host, max_rate).select(F.col("host").alias("_qr_host"), "host_ok")
    j = m.join(v, m[host].eqNullSafe(v["_qr_host"]), "left")
    return j.withColumn("kept", ~F.col("base_failed") & F.col("host_ok")).drop("_qr_host", "_qr_lines", "host_ok")
