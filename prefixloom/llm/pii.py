"""Personal data by weak-supervision aggregation (operator 6), DataFrame functions only.

One pass over each text finds candidate spans of every kind by pattern, with the characters around
them. Four labelers vote on a candidate (1 yes, -1 no, 0 no opinion): ``regex`` (does the match pass
the kind's checks), ``gazetteer`` (top-level domains, country codes, card issuers, reserved networks),
``edge`` (does it stand free of letters and digits) and ``cue`` (does a word like "phone" or "token"
lead to it). Candidates are counted by kind and votes, at most ``len(KINDS) * 3 ** 4`` rows, and
expectation-maximisation over these counts estimates each labeler's reliability and each pattern's
chance. A logistic span classifier is trained on those chances and applied to every candidate as a
linear expression.

The base spans (email, ip, card, phone that pass their checks) always stay. The classifier adds spans
that overlap none of them: ``secret``, ``masked_email``, ``local_phone``; of added spans that overlap each
other the one of the first-named kind stays. A match that fails its own
kind's checks is evidence for the training and never a span.

Offsets are code points, ends exclusive. A match's offset is a running sum over the matches of its
text, so that a text with any number of matches costs linear work.

Defined results: null and empty texts have no spans; very long texts are searched whole; repeated rows are
searched one by one; an empty table gives an empty result and an untrained classifier adds nothing; extra columns pass through, but
for those named like RESULTS, which are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from .common import others, written

BASE = ("email", "ip", "card", "phone")
ADDED = ("secret", "masked_email", "local_phone")
KINDS = BASE + ADDED
VOTES = ("regex", "gazetteer", "edge", "cue")
RESULTS = ("n_email", "n_ip", "n_card", "n_phone", "base_spans", "spans")

# The base patterns. Possessive forms and the look-behinds below find the same matches
# as the plain forms (a match can only start at the front of a run, or where the last match ended),
# without their quadratic search and deep recursion on long runs.
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_/+-])(?=[A-Za-z_/+-]*+[0-9])(?=[0-9_/+-]*+[A-Za-z])[A-Za-z0-9_/+-]{24,}+",
    "masked_email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++\x20?(?:\[at\]|\(at\))\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?(?:\[dot\]|\(dot\))\x20?)[A-Za-z0-9-]++)++",
    "local_phone": r"(?<![0-9+][\x20().-]{0,2})\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
#: A text without these has no match; cheaper than the search.
GUARDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "secret": r"[A-Za-z0-9_/+-]{24}", "masked_email": r"[\[(]at[\])]", "local_phone": r"[0-9]{3}[\x20.-][0-9]{4}"}

# Gazetteers.
DOMAINS = "com net org edu gov mil int info biz io co app dev de fr es it nl be at ch pl pt se no fi dk uk eu us ca au nz jp cn in br mx ru ua cz ie gr tr za kr".split()
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|3[0689]|35|6(?:011|4[4-9]|5))"
COUNTRIES = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-69][0-9]|3[578][0-9]|42[0-9]|5[09][0-9]|6[789][0-9]|8[05789][0-9]|9[679][0-9])"
CUES = {
    "email": r"(?:e-?mail|mail|contact|write|from|to)",
    "ip": r"(?:ip|host|server|address|from|client)",
    "card": r"(?:card|visa|mastercard|amex|pay|account|number)",
    "phone": r"(?:tel|telephone|phone|fon|call|fax|mobile|cell)",
    "secret": r"(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|key|bearer|auth)",
}
CUES |= {"masked_email": CUES["email"], "local_phone": CUES["phone"]}


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a Luhn sum divisible by ten."""
    d = F.transform(F.split(F.reverse(digits), ""), lambda x, i: F.when(i % 2 == 1, x.cast("int") * 2 - F.when(x.cast("int") > 4, 9).otherwise(0)).otherwise(x.cast("int")))
    return F.aggregate(d, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _passes(kind: str, m: Column) -> Column:
    n = F.length(_digits(m))
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike("^(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        # Nested, so that longer runs of digits are never summed.
        return F.when(n.between(13, 19), luhn(_digits(m))).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(9, 15)
    if kind == "secret":
        return m.rlike("[0-9].*[0-9].*[0-9]")
    return F.lit(True)


def _gazetteer(kind: str, m: Column) -> Column:
    if kind in ("email", "masked_email"):
        known = F.lower(F.regexp_extract(m, "([A-Za-z0-9-]+)$", 1)).isin(DOMAINS)
    elif kind == "ip":
        known = ~m.rlike(r"^(?:0|10|127|255|192\.168|172\.(?:1[6-9]|2[0-9]|3[01])|22[4-9]|2[3-5][0-9])\.")
    elif kind == "card":
        known = _digits(m).rlike(ISSUERS)
    elif kind == "phone":
        known = F.concat(F.lit("+"), _digits(m)).rlike(COUNTRIES)
    else:
        return F.lit(0)
    return F.when(known, 1).otherwise(-1)


def _votes(kind: str, x: Column) -> Column:
    """The struct of votes on a candidate (gap, before, match, after)."""
    m = x["match"]
    free = ~x["before"].rlike(r"[\p{L}\p{N}]$") & ~x["after"].rlike(r"^[\p{L}\p{N}]")
    # A secret needs its cue; a cue elsewhere only helps.
    cue = F.when(x["before"].rlike(rf"(?i)(?<![\p{{L}}]){CUES[kind]}[^\p{{L}}\p{{N}}]{{0,5}}$"), 1).otherwise(-1 if kind == "secret" else 0)
    parts = {"regex": F.when(_passes(kind, m), 1).otherwise(-1), "gazetteer": _gazetteer(kind, m), "edge": F.when(free, 1).otherwise(-1), "cue": cue}
    return F.struct(*[parts[v].cast("tinyint").alias(v) for v in VOTES])


def candidates(docs: DataFrame, text: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs`` with _pi_row and _pi_c, the candidates of the text in order of kind and place; without ``text`` unless kept."""
    kept = [F.col(c) for c in others(docs, *RESULTS, *([] if keep_text else [text]))]
    rows = docs.select(*kept, F.monotonically_increasing_id().alias("_pi_row"), F.coalesce(F.col(text), F.lit("")).alias("_pi_t"))
    rows = rows.select("*", *[F.col("_pi_t").rlike(g).alias(f"_pi_g{i}") for i, g in enumerate(GUARDS[k] for k in KINDS)])
    empty = F.array().cast("array<struct<gap:int,before:string,match:string,after:string>>")

    def found(i: int, kind: str) -> Column:
        matches, pieces = F.regexp_extract_all("_pi_t", F.lit(PATTERNS[kind]), F.lit(0)), F.split("_pi_t", PATTERNS[kind])
        pair = F.arrays_zip(pieces.alias("p"), matches.alias("m"), F.slice(pieces, 2, F.size(pieces)).alias("q"))
        cut = F.transform(F.filter(pair, lambda z: z["m"].isNotNull()), lambda z: F.struct(F.length(z["p"]).alias("gap"), F.right(z["p"], F.lit(24)).alias("before"), z["m"].alias("match"), F.left(z["q"], F.lit(1)).alias("after")))
        return F.when(F.col(f"_pi_g{i}"), cut).otherwise(empty).alias(f"_pi_m{i}")

    rows = rows.select(*kept, "_pi_row", *[found(i, k) for i, k in enumerate(KINDS)])

    def voted(i: int, kind: str) -> Column:
        return F.transform(f"_pi_m{i}", lambda x, at: F.struct(F.lit(i).cast("tinyint").alias("kind"), at.alias("at"), x["gap"].alias("gap"), F.length(x["match"]).alias("n"), _votes(kind, x).alias("v")))

    return written(rows.select(*kept, "_pi_row", F.concat(*[voted(i, k) for i, k in enumerate(KINDS)]).alias("_pi_c")))


def estimate(counts: list[Row], rounds: int = 50) -> dict[tuple, float]:
    """Chance of a true span by (kind, votes): expectation-maximisation over pattern counts.

    Labelers are taken as independent given the truth and better than chance, their reliabilities
    shared by all kinds; the share of true spans is a kind's own. The start trusts every vote alike;
    pseudo-counts (``right`` and ``wrong`` votes) stand for a labeler of which little is seen.
    """
    right, wrong = 8.0, 2.0
    patterns = [((r["kind"], *[r[v] for v in VOTES]), r["n"]) for r in counts]
    chance = {p: 1 / (1 + math.exp(-1.5 * sum(p[1:]))) for p, _ in patterns}
    for _ in range(rounds):
        share = {}
        given = [[{-1: wrong if y else right, 0: right, 1: right if y else wrong} for _ in VOTES] for y in (0, 1)]
        for kind in {p[0] for p, _ in patterns}:
            own = [(p, n) for p, n in patterns if p[0] == kind]
            share[kind] = (1 + sum(chance[p] * n for p, n in own)) / (2 + sum(n for _, n in own))
        for p, n in patterns:
            for j, v in enumerate(p[1:]):
                given[1][j][v] += chance[p] * n
                given[0][j][v] += (1 - chance[p]) * n
        rate = [[{v: c / sum(t.values()) for v, c in t.items()} for t in given[y]] for y in (0, 1)]
        for p, _ in patterns:
            odds = math.log(share[p[0]] / (1 - share[p[0]]))
            # A vote never speaks against itself, and no opinion says nothing.
            odds += sum(v * max(0.0, v * math.log(rate[1][j][v] / rate[0][j][v])) for j, v in enumerate(p[1:]))
            chance[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return chance


def classifier(counts: list[Row], steps: int = 400) -> tuple[dict[int, float], list[float]]:
    """Bias by kind and weight by labeler of a logistic regression on the estimated chances."""
    chance = estimate(counts)
    bias, weights = {p[0]: 0.0 for p in chance}, [0.0] * len(VOTES)
    number = {(r["kind"], *[r[v] for v in VOTES]): math.log1p(r["n"]) for r in counts}
    total = sum(number.values()) or 1.0
    for _ in range(steps):
        gb, gw = dict.fromkeys(bias, 0.0), [1e-3 * w for w in weights]
        for p, y in chance.items():
            z = bias[p[0]] + sum(w * v for w, v in zip(weights, p[1:]))
            g = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - y) * number[p] / total
            gb[p[0]] += g
            for j, v in enumerate(p[1:]):
                gw[j] += g * v
        bias = {k: b - 4.0 * gb[k] for k, b in bias.items()}
        weights = [max(0.0, w - 4.0 * g) for w, g in zip(weights, gw)]
    return bias, weights


def found(cands: DataFrame) -> DataFrame:
    """A row per span of ``candidates``: _pi_row, kind (number), start, end, base, done (the furthest end before it)."""
    c = cands.where(F.size("_pi_c") > 0).select("_pi_row", F.explode("_pi_c").alias("c")).select("_pi_row", "c.*")
    counts = c.groupBy("kind", *[F.col(f"v.{v}").alias(v) for v in VOTES]).agg(F.count("*").alias("n")).collect()
    bias, weights = classifier(counts)
    z = F.lit(-1e9)
    for kind, b in sorted(bias.items()):
        z = F.when(F.col("kind") == kind, F.lit(b)).otherwise(z)
    for v, w in zip(VOTES, weights):
        z = z + F.col(f"v.{v}") * F.lit(w)
    running = Window.partitionBy("_pi_row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumn("end", F.sum(F.col("gap") + F.col("n")).over(running)).withColumn("start", F.col("end") - F.col("n"))
    c = c.withColumn("base", (F.col("kind") < len(BASE)) & (F.col("v.regex") == 1)).where((F.col("v.regex") == 1) & (F.col("base") | (z > 0)))
    # Base spans stay; an added span stays if it overlaps none that stays of an earlier kind. Spans of one kind never overlap.
    order = Window.partitionBy("_pi_row").orderBy("start", "kind", "end").rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy("_pi_row").orderBy(F.desc("start"), F.desc("kind"), F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("_stays", F.col("base"))
    for kind in range(len(BASE), len(KINDS)):
        before, after = F.max(F.when(F.col("_stays"), F.col("end"))).over(order), F.min(F.when(F.col("_stays"), F.col("start"))).over(back)
        free = (F.coalesce(before, F.lit(0)) <= F.col("start")) & (F.coalesce(after, F.col("end")) >= F.col("end"))
        c = c.withColumn("_stays", F.when(F.col("kind") == kind, free).otherwise(F.col("_stays")))
    c = c.where("_stays").withColumn("done", F.coalesce(F.max("end").over(order), F.lit(0)))
    return c.select("_pi_row", F.col("kind").cast("int").alias("kind"), "start", "end", "base", "done")


def by_document(spans: DataFrame) -> DataFrame:
    """A row per _pi_row with spans: counts of the base kinds, base_spans and spans as kind:start:end, _pi_s (sorted by place)."""
    label = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    s = F.struct("kind", "start", "end", "base", "done", label.alias("label"))
    g = spans.groupBy("_pi_row").agg(F.sort_array(F.collect_list(s)).alias("s"))
    text = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["label"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("s", lambda x: x["base"])

    def number(i: int) -> Column:
        return F.size(F.filter("s", lambda x: x["base"] & (x["kind"] == i))).cast("long").alias(f"n_{BASE[i]}")

    places = F.sort_array(F.transform("s", lambda x: F.struct(x["start"], x["end"], x["done"], x["label"])))
    return g.select("_pi_row", *[number(i) for i in range(len(BASE))], text(base).alias("base_spans"), text(F.col("s")).alias("spans"), places.alias("_pi_s"))


def searched(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with RESULTS (``base_spans`` and ``spans`` are empty strings if there are none)."""
    c = candidates(docs, text)
    j = c.drop("_pi_c").join(by_document(found(c)), "_pi_row", "left")
    counts = [F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in BASE]
    return j.select(*others(c, "_pi_row", "_pi_c"), *counts, *[F.coalesce(x, F.lit("")).alias(x) for x in ("base_spans", "spans")])


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets; only texts with candidates are shuffled."""
    c = candidates(docs, text, keep_text=True)
    own = others(c, "_pi_row", "_pi_c")
    clean = c.where(F.size("_pi_c") == 0).select(*own)
    spans = by_document(found(c)).select("_pi_row", "_pi_s")
    j = c.where(F.size("_pi_c") > 0).join(spans, "_pi_row", "left")
    heads = F.filter("_pi_s", lambda x: x["start"] >= x["done"])
    t = F.col(text)
    pieces = F.transform(heads, lambda x: F.concat(F.substring(t, x["done"].cast("int") + 1, (x["start"] - x["done"]).cast("int")), F.lit("["), F.upper(x["label"]), F.lit("]")))
    last = F.array_max(F.transform("_pi_s", lambda x: x["end"])).cast("int")
    new = F.concat(F.array_join(pieces, ""), F.substring(t, last + 1, F.length(t)))
    return clean.unionByName(j.withColumn(text, F.when(F.size("_pi_s") > 0, new).otherwise(t)).select(*own))
