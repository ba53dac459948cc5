"""Quality classifier (operator 2): logistic regression on hashed word n-grams, trained by follow the regularised leader.

A word counts as itself and as its shape (case, marks at its end, length, equal to the word before);
single words, pairs of words, and runs of one to three shapes are hashed into ``BUCKETS`` features,
each kind's square-rooted frequencies of unit length. Training makes ``EPOCHS`` passes of FTRL-Proximal
updates over at most ``SAMPLE`` labelled texts (chosen by a hash of doc_id); a text's score is a sparse
dot product with the weights.

Word shapes are there because bad text is often told by how words are written and repeated, which no
word seen in training shows. Texts of any length are scored whole, in linear time.

Defined results: null and empty texts have the features of a text without words and get a score like
any other; without labels every score is 0.5; a score of exactly 0.5 is predicted 1; an id labelled both
ways is not learned from; a null doc_id is never learned from nor held out; repeated rows are scored one
by one; an empty table gives an empty result; extra columns pass through, but for those named like
RESULTS, which are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import others

BUCKETS = 1 << 18
SAMPLE, EPOCHS = 4096, 4
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.5
RESULTS = ("score", "predicted")
CACHED = 1 << 18
_SHIFT = np.uint64(64 - 18)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


class _Codes(dict):
    """40 bits of a word's hash and 8 bits of its shape, for the frequent words remembered."""

    def __missing__(self, word: bytes) -> int:
        w = word.decode()
        end = len(w)
        while end and not w[end - 1].isalnum():
            end -= 1
        core, tail = w[:end], w[end:]
        case = 0 if not core else 1 if core.isdigit() else 2 if core.islower() else 3 if core.isupper() and len(core) > 1 else 4 if core[0].isupper() and core[1:].islower() or len(core) == 1 else 5
        mark = 0 if not tail else 1 if tail in (".", ",") else 2 if len(tail) == 1 else 3
        code = xxhash.xxh64_intdigest(word) >> 24 << 8 | case << 5 | mark << 3 | min(7, len(core).bit_length())
        if len(self) < CACHED and len(word) < 64:
            self[word] = code
        return code


_CODES = _Codes()


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (int32, ascending) and values (float32) of a text."""
    words = (text or "").encode().split()
    n = len(words)
    code = np.fromiter(map(_CODES.__getitem__, words), np.uint64, n)
    raw, shape = code >> np.uint64(8), (code & np.uint64(255)) << np.uint64(1)
    shape[1:] |= raw[1:] == raw[:-1]
    kinds = [raw, raw[:-1] * _ODD[1] + raw[1:], shape, (shape[:-1] << np.uint64(9)) + shape[1:], (shape[:-2] << np.uint64(18)) + (shape[1:-1] << np.uint64(9)) + shape[2:]]
    idx, val = [np.array([n.bit_length()], np.int32)], [np.ones(1, np.float32)]
    for k, x in enumerate(kinds):
        if len(x):
            u, c = np.unique(((x + np.uint64(k)) * _ODD[0] ^ _ODD[k]) * _ODD[2] >> _SHIFT, return_counts=True)
            idx.append(u.astype(np.int32))
            val.append(np.sqrt(c / len(x)).astype(np.float32))
    i, v = np.concatenate(idx), np.concatenate(val)
    u, where = np.unique(i, return_inverse=True)
    return u, np.bincount(where, v).astype(np.float32)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> np.ndarray:
    """FTRL-Proximal weights; both classes weigh alike; the order of the rows is theirs, then seeded."""
    z, n = np.zeros(BUCKETS), np.zeros(BUCKETS)
    share = np.bincount([y for *_, y in rows], minlength=2)
    weight = [0.0 if not s else min(4.0, (len(rows) / (2 * s)) ** 0.5) for s in share]

    def weights(i):
        w = -(z[i] - np.sign(z[i]) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2)
        return np.where(np.abs(z[i]) <= L1, 0.0, w)

    rng = np.random.default_rng(3)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            i, x, y = rows[k]
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = weight[y] * (p - y) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA * w
            n[i] += g * g
    return weights(np.arange(BUCKETS)).astype(np.float32)


@pandas_udf(StructType([StructField("idx", BinaryType()), StructField("val", BinaryType())]))
def _features(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(i.tobytes(), v.tobytes()) for i, v in map(features, texts)], columns=["idx", "val"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", doc_id: str = "doc_id", sample: int = SAMPLE) -> np.ndarray:
    """Weights learned from the texts of at most ``sample`` ids of ``labels``, one text of each id.

    The ids are drawn before texts are touched: a threshold on their hash first, so that little is
    sorted, then the least hashes. They are a broadcast of bounded size, and one scan of ``docs`` finds
    their texts. Of the texts of a repeated id the one with the least features counts, at every rerun.
    """
    sure = labels.where(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(doc_id).alias("_id")).agg(F.min(label).alias("_y"), F.max(label).alias("_z"))
    sure = sure.where("_y = _z").select("_id", "_y", F.pmod(F.xxhash64(F.lit("quality"), F.col("_id")), F.lit(1 << 40)).alias("_draw"))
    share = min(1.0, 1.5 * sample / max(1, sure.count()))
    drawn = sure.where(F.col("_draw") <= int(share * (1 << 40))).orderBy("_draw", "_id").limit(sample).select("_id", "_y")
    found = docs.select(F.col(doc_id).alias("_d"), F.col(text).alias("_t")).join(F.broadcast(drawn), F.col("_d") == F.col("_id"))
    rows = found.select("_id", "_y", _features("_t").alias("f")).groupBy("_id", "_y").agg(F.min("f").alias("f")).select("_id", "_y", "f.*").collect()
    rows.sort(key=lambda r: r["_id"])
    return train([(np.frombuffer(r["idx"], np.int32), np.frombuffer(r["val"], np.float32), int(r["_y"])) for r in rows])


def scored(docs: DataFrame, weights: np.ndarray, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with score (double) and predicted (int); the weights are 1 MB, sent by broadcast."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(texts: pd.Series) -> pd.Series:
        w = sent.value
        margins = np.array([w[i] @ v for i, v in map(features, texts)], np.float64)
        return pd.Series(1 / (1 + np.exp(-np.clip(margins, -35, 35))))

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    kept = others(docs, text, *RESULTS)
    out = docs.select(*kept, pandas_udf(run, "double")(F.col(text)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
