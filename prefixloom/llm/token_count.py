"""Token counts by heap-and-linked-list byte-pair merging (operator 8).

The vocabulary of a SentencePiece BPE model with byte fallback is read; the counting is done here:
the symbols of a stretch form a linked list, a heap holds its adjacent pairs by rank, and the lowest
rank is merged again and again (leftmost first among equals). The count is the initial symbols minus
the merges; a symbol that is no piece counts as its UTF-8 bytes. No identifiers are made.

No piece holds a space mark after another character, nor a line feed, so merges never cross from a
word into the next space or line: texts are cut there and stretches counted apart, the frequent ones
once per worker (a bounded cache).

Defined results: null and empty texts count 0; repeated rows count one by one; special strings inside
a text are ordinary text; nothing is truncated. Models of another kind are refused with ValueError.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

from .common import others

MARK = "▁"
#: Stretches that a worker remembers, and how long they may be.
CACHED, CACHED_CHARS = 1 << 19, 48
LIMIT = 4096


class Vocabulary:
    """Pieces and merge ranks of a model file's bytes."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        m = sentencepiece_model_pb2.ModelProto()
        m.ParseFromString(model)
        norm, train = m.normalizer_spec, m.trainer_spec
        if train.model_type != train.BPE or not train.byte_fallback or norm.precompiled_charsmap or norm.normalization_rule_tsv:
            raise ValueError("only BPE models with byte fallback and without text normalisation are supported")
        if not norm.add_dummy_prefix or norm.remove_extra_whitespaces or not norm.escape_whitespaces or train.treat_whitespace_as_suffix:
            raise ValueError("only models that mark words by a leading space and keep all spaces are supported")
        kinds = {p.type for p in m.pieces}
        if kinds - {1, 2, 3, 6}:  # normal, unknown, control, byte
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.rank = {p.piece: -p.score for p in m.pieces if p.type == 1}
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.rank):
            raise ValueError("a piece crosses from a word into a space or a line")

    def count(self, stretch: str) -> int:
        """Tokens of ``stretch``, whose spaces are marks."""
        rank, symbols = self.rank, list(stretch)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank[p], i, p) for i in range(n - 1) if (p := symbols[i] + symbols[i + 1]) in rank]
        heapq.heapify(heap)
        while heap:
            _, i, piece = heapq.heappop(heap)
            left = symbols[i]
            if left is None or (j := after[i]) >= n or len(left) + len(symbols[j]) != len(piece):
                continue  # one of the two has been merged meanwhile
            symbols[i], symbols[j] = piece, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (p := piece + symbols[k]) in rank:
                    heapq.heappush(heap, (rank[p], i, p))
            if (h := before[i]) >= 0 and (p := symbols[h] + piece) in rank:
                heapq.heappush(heap, (rank[p], h, p))
        return sum(1 if s in rank else len(s.encode()) for s in symbols if s is not None)


class Counter(dict):
    """Counts by stretch; ``prefix`` stands before each key."""

    def __init__(self, vocabulary: Vocabulary, prefix: str):
        self.vocabulary, self.prefix = vocabulary, prefix

    def __missing__(self, key: str) -> int:
        n = self.vocabulary.count(self.prefix + key)
        if len(self) < CACHED and len(key) <= CACHED_CHARS:
            self[key] = n
        return n


class Tokens:
    """Counts whole texts."""

    STRETCH = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")

    def __init__(self, model: bytes):
        v = Vocabulary(model)
        self.bare, self.marked, self.line_feed = Counter(v, ""), Counter(v, MARK), v.count("\n")
        self.bare[""] = 0

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        lines = text.split("\n")
        total = (len(lines) - 1) * self.line_feed
        bare, marked = self.bare.__getitem__, self.marked.__getitem__
        simple = "  " not in text and MARK not in text
        for i, line in enumerate(lines):
            if simple and not (i == 0 and line[:1] == " "):
                parts = line.split(" ")
                # The first line has a mark put before it.
                total += (marked if i == 0 and (line or len(lines) > 1) else bare)(parts[0])
                if len(parts) > 1:
                    total += sum(map(marked, parts[1:]))
            else:
                whole = (MARK if i == 0 else "") + line.replace(" ", MARK)
                total += sum(map(bare, self.STRETCH.findall(whole)))
        return total


#: A worker process serves many tasks and keeps what it has counted.
_COUNTERS: dict[int, Tokens] = {}


def count_tokens(spark: SparkSession, model_path: str):
    """A function from a text column to its tokens; the model's bytes (under a MB) go to the workers by broadcast."""
    with open(model_path, "rb") as f:
        model = f.read()
    Vocabulary(model)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = hash(sent.value)
        if own not in _COUNTERS:
            _COUNTERS[own] = Tokens(sent.value)
        counter = _COUNTERS[own]
        for texts in batches:
            yield pd.Series([counter.count(t) for t in texts], dtype="int64")

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}  # types, not their names
    return pandas_udf(run, LongType())


def counted(docs: DataFrame, model_path: str, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """``docs`` without ``text``, with n_bytes, n_tokens and over_limit."""
    count = count_tokens(docs.sparkSession, model_path)
    kept = others(docs, text, "n_bytes", "n_tokens", "over_limit")
    out = docs.select(*kept, F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_bytes"), count(F.col(text)).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
