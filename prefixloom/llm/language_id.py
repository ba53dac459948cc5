"""Language identification by error-correcting output codes (operator 3).

Every language has a codeword; a binary classifier per bit (logistic regression on hashed letter
n-grams) predicts the bit's margin, and loss-weighted decoding takes the language whose codeword the
margins fit best: the sum over bits of the bit's reliability times log(1 + exp(-margin * codeword bit)).
The score is the softmax of the negative losses; a text is flagged ambiguous if the runner-up's loss is
within ``AMBIGUOUS`` of the best.

Learning takes at most ``SAMPLE`` labelled texts, but ``LEAST`` of each language if there are: as many of
each language as there are or its share of the bound (chosen by a hash of doc_id, one text of each id).
Every label is learned, however rare: the driver holds the distinct labels and at most ``LEAST`` texts'
histograms (up to 32 KB) of each. Scoring reads whole texts and needs nothing but the text.

Defined results: null texts and texts without a letter are ``und`` with score 0; without any labelled
text every text is ``und``; ties between languages go to the first by name; a label of which no text has
a letter is not learned; a null doc_id is never learned from and never held out; repeated rows are scored
one by one, and learned from once; very long texts are read whole, in pieces; an empty table gives an
empty result; extra columns pass through, but for those named like RESULTS, which are replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType

from .common import others

SAMPLE, LEAST = 2048, 8
BUCKETS = 1 << 13
STEPS, RATE, DECAY = 150, 0.3, 1e-3
SCALE = 30.0
AMBIGUOUS = 0.5
RESULTS = ("lang_pred", "score", "ambiguous")
_NO_LETTER = re.compile(r"[\W\d_]+")
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)
#: Characters of a text that are turned into n-grams at once.
_PIECE = 1 << 18


def histogram(text: str | None) -> np.ndarray | None:
    """Frequencies of the text's letter 2- to 4-grams by bucket, square-rooted (unit length); None without a letter."""
    total = None
    text = text or ""
    for at in range(0, len(text), _PIECE):
        letters = _NO_LETTER.sub(" ", text[at : at + _PIECE].lower())
        if letters in ("", " "):
            continue
        a = np.frombuffer(f" {letters} ".encode(), np.uint8).astype(np.uint32)
        parts = []
        for n in (2, 3, 4):
            if len(a) >= n:
                h = np.full(len(a) - n + 1, n, np.uint32)
                for k in range(n):
                    h = (h ^ a[k : len(a) - n + 1 + k]) * _MULTIPLIERS[k]
                    h ^= h >> np.uint32(15)
                parts.append(h & np.uint32(BUCKETS - 1))
        counts = np.bincount(np.concatenate(parts), minlength=BUCKETS)
        total = counts if total is None else total + counts
    return None if total is None else np.sqrt(total / total.sum()).astype(np.float32)


def codewords(n: int) -> np.ndarray:
    """A row of +1 and -1 per language: all 2 ** (n - 1) - 1 splits up to 5 languages, else seeded splits in halves."""
    if n <= 5:
        columns = [[1 if i == 0 else (-1 if m >> (i - 1) & 1 else 1) for i in range(n)] for m in range(1, 1 << (n - 1))] or [[1]]
        return np.array(columns, np.float32).T
    rng = np.random.default_rng(11)
    best, width = None, int(np.ceil(10 * np.log2(n)))
    half = np.where(np.arange(n) < n // 2, 1, -1).astype(np.float32)
    for _ in range(50 if n <= 200 else 3):
        code = np.stack([rng.permutation(half) for _ in range(width)], 1)
        same = max((code[at : at + 512] @ code.T - 2 * width * np.eye(n, dtype=np.float32)[at : at + 512]).max() for at in range(0, n, 512))
        if best is None or same < best[0]:
            best = same, code
    return best[1]


class Model:
    """Languages, their codewords, the bits' weights and reliabilities."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        self.langs = sorted(set(langs))
        number = {s: i for i, s in enumerate(self.langs)}
        y = np.array([number[s] for s in langs], np.int64)
        self.code = codewords(len(self.langs)) if self.langs else np.zeros((0, 0), np.float32)
        self.w, self.b = np.zeros((BUCKETS, self.code.shape[1]), np.float32), np.zeros(self.code.shape[1], np.float32)
        self.reliability = np.ones(self.code.shape[1], np.float32)
        if len(self.langs) < 2:
            return
        held = np.arange(len(y)) % 5 == 4  # for the reliabilities; then all are learned from
        if held.any() and len(set(y[~held])) > 1:
            self._fit(x, y, ~held)
            right = ((self.margins(x) * self.code[y]) > 0)[held].sum(0)
            p = (right + 1) / (held.sum() + 2)
            self.reliability = np.clip(np.log(p / (1 - p)), 0.1, 5).astype(np.float32)
        self._fit(x, y, np.ones(len(y), bool))

    def _fit(self, x: np.ndarray, y: np.ndarray, used: np.ndarray) -> None:
        """Full-batch logistic regression of all bits with adaptive steps on the rows ``used``, which aren't copied; every language weighs alike."""
        share = np.bincount(y[used], minlength=len(self.langs))
        weight = (used / np.maximum(share, 1)[y])[:, None].astype(np.float32)
        weight /= weight.sum()
        sign = self.code[y]
        w, b = np.zeros_like(self.w), np.zeros_like(self.b)
        m, v = np.zeros_like(w), np.zeros_like(w)
        for t in range(1, STEPS + 1):
            z = SCALE * (x @ w) + b
            g = -sign / (1 + np.exp(np.clip(sign * z, -30, 30))) * weight
            gw = SCALE * (x.T @ g) + DECAY * w
            m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
            w -= RATE / 10 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
            b -= RATE * g.sum(0)
        self.w, self.b = w, b

    def margins(self, x: np.ndarray) -> np.ndarray:
        return SCALE * (x @ self.w) + self.b

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        x = histogram(text)
        if x is None or not self.langs:
            return "und", 0.0, True
        if len(self.langs) == 1:
            return self.langs[0], 1.0, False
        z = self.margins(x) * self.code
        loss = (self.reliability * np.logaddexp(0, -z)).sum(1) / self.reliability.sum()
        p = np.exp(-loss * len(self.reliability))
        best = int(loss.argmin())
        second = np.partition(loss, 1)[1]
        return self.langs[best], float(np.clip(p[best] / p.sum(), 0, 1)) if p.sum() > 0 else 1.0, bool(second - loss[best] < AMBIGUOUS)


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


@pandas_udf(BinaryType())
def _histograms(texts: pd.Series) -> pd.Series:
    """Sparse: the buckets in use, then their values; 4 bytes each."""

    def packed(h: np.ndarray) -> bytes:
        at = np.flatnonzero(h)
        return at.astype(np.uint16).tobytes() + h[at].astype(np.float16).tobytes()

    return pd.Series([None if (h := histogram(t)) is None else packed(h) for t in texts])


# A filter on a deterministic function's result is pushed below it, and the function is run twice.
_histograms = _histograms.asNondeterministic()


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample: int = SAMPLE) -> Model:
    """Learns from ``labelled``: a bounded sample of it is drawn, its histograms (4 bytes a bucket in use) come to the driver."""
    known = labelled.where(F.col(lang).isNotNull() & F.col(doc_id).isNotNull())
    ids = {r[0]: r[1] for r in known.groupBy(lang).agg(F.approx_count_distinct(doc_id).alias("n")).collect()}
    part = max(LEAST, sample // max(1, len(ids)))
    draw = F.pmod(F.xxhash64(F.lit("lang"), F.col(doc_id)), F.lit(1 << 30))
    shares, drawn = {k: min(1.0, 1.3 * part / max(1, n)) for k, n in ids.items()}, {}
    while shares:
        # The threshold on the draw bounds what is gathered; languages it leaves short (texts without a letter) are drawn anew.
        by_share: dict[float, list] = {}
        for k, x in shares.items():
            by_share.setdefault(x, []).append(k)
        want = F.lit(False)
        for x, langs in by_share.items():
            want |= F.col(lang).isin(langs) & (draw <= int(x * (1 << 30)))
        rows = known.where(want).select(F.col(lang).alias("lang"), draw.alias("draw"), F.col(doc_id).alias("id"), F.col(text).alias("t"))
        rows = rows.select("lang", "draw", "id", _histograms("t").alias("h")).where("h IS NOT NULL").groupBy("lang", "draw", "id").agg(F.min("h").alias("h"))
        place = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "id"))
        got: dict[str, list[bytes]] = {}
        for k, _, h in sorted(rows.withColumn("place", place).where(F.col("place") <= part).select("lang", "place", "h").collect()):
            got.setdefault(k, []).append(h)
        drawn |= got
        shares = {k: min(1.0, 16 * x) for k, x in shares.items() if x < 1 and len(got.get(k, ())) < part}
    langs = [k for k in sorted(drawn) for _ in drawn[k]]
    x = np.zeros((len(langs), BUCKETS), np.float32)
    for i, h in enumerate(h for k in sorted(drawn) for h in drawn.pop(k)):
        n = len(h) // 4
        x[i, np.frombuffer(h, np.uint16, n)] = np.frombuffer(h, np.float16, n, 2 * n)
    return Model(x, langs)


def predicted(docs: DataFrame, model: Model, text: str = "text", drop_text: bool = True) -> DataFrame:
    """``docs`` with lang_pred, score and ambiguous; the model (32 KB a bit: 2 MB for 64 languages, 3.3 MB for 1,000) goes to the workers by broadcast."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([sent.value.predict(t) for t in texts], columns=list(RESULTS))

    run.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    # Not deterministic to the optimizer: a filter on the result would be pushed below and run the model twice.
    udf = pandas_udf(run, "lang_pred string, score double, ambiguous boolean").asNondeterministic()
    kept = others(docs, *RESULTS, *([text] if drop_text else []))
    return docs.select(*kept, udf(F.col(text)).alias("_li")).select(*kept, "_li.*")
