"""The online operators over streams: counters, windows, single flight, sessions, publish-and-match per domain."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import lifecycle, policy, trace
from ..operators.segments import EvictConfig


def stats(stream: DataFrame, *keys: str) -> DataFrame:
    """Running counters; to be written in update or complete mode."""
    return policy.stats(stream, *keys)


def tumbling(stream: DataFrame, ts: str, width: str, late: str, *keys: str) -> DataFrame:
    g = stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count("*").alias("n"))
    return g.select("w.start", *keys, "n")


def sliding(stream: DataFrame, ts: str, width: str, step: str, late: str, *keys: str) -> DataFrame:
    g = stream.withWatermark(ts, late).groupBy(F.window(ts, width, step).alias("w"), *keys).agg(F.count("*").alias("n"))
    return g.select("w.start", *keys, "n")


def sessions(stream: DataFrame, ts: str, gap: str, late: str, key: str) -> DataFrame:
    """Gaps of idleness close a session."""
    g = stream.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select(key, "w.start", "n")


def single_flight(stream: DataFrame, ts: str, late: str, *keys: str) -> DataFrame:
    """The first request of each key within the watermark's delay."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))


def first_token(stream: DataFrame, key: str, ts: str, kind: str) -> DataFrame:
    """By request: milliseconds from its start to its first token; to be written in update mode."""
    return trace.first_token(stream, key, ts, kind)


class Index:
    """One domain's entries as a tree of tokens: a lookup walks the request once and looks at siblings only where entries end."""

    def __init__(self) -> None:
        self.root: dict = {}
        self.entries: dict[tuple, list] = {}  # tokens: last use, whole context only

    def add(self, tokens: tuple, used: int, whole: bool) -> None:
        if tokens in self.entries:
            self.entries[tokens] = [used, whole]
            return
        node = self.root
        for t in tokens:
            node = node.setdefault("next", {}).setdefault(t, {})
            node["below"] = node.get("below", 0) + 1
        node["ends"] = True
        self.entries[tokens] = [used, whole]
        node = self.root
        for t in tokens[:-1]:
            node = node["next"][t]
        node.setdefault("last", set()).add(tokens[-1])

    def drop(self, tokens: tuple) -> None:
        del self.entries[tokens]
        node, path = self.root, []
        for t in tokens:
            path.append((node, t))
            node = node["next"][t]
            node["below"] -= 1
        node["ends"] = False
        path[-1][0]["last"].discard(tokens[-1])
        for parent, t in reversed(path):
            if not parent["next"][t]["below"]:
                del parent["next"][t]

    def extended(self, tokens: tuple) -> bool:
        """Another entry begins with this one."""
        node = self.root
        for t in tokens:
            node = node["next"][t]
        return node["below"] > 1

    def match(self, tokens: tuple) -> tuple | None:
        """The entry by the batch rules: the longest; on the path before end-anchored; the last used, the least last token."""
        node, best = self.root, None
        for k, t in enumerate(tokens, 1):
            last = node.get("last", ())
            if k >= 2 and last:
                on = tokens[:k] if t in last and (not self.entries[tokens[:k]][1] or k == len(tokens)) else None
                off = [x for x in last if x != t and not self.entries[(*tokens[: k - 1], x)][1]] if on is None else []
                if on is not None:
                    best = on
                elif off:
                    best = (*tokens[: k - 1], min(off, key=lambda x: (-self.entries[(*tokens[: k - 1], x)][0], x)))
            node = node.get("next", {}).get(t)
            if node is None:
                break
        return best


ONLINE = "request_id long, engine string, fp string, matched_tokens long, on_path boolean, verdict string, prefill_from long, evicted long, expired long"
STATE = "tokens array<array<string>>, used array<long>, whole array<boolean>, tick long, evicted long, expired long"


def matched_online(stream: DataFrame, most_entries: int = 1000, ttl_ticks: int | None = None) -> DataFrame:
    """Lookup, verdict, publish, expiry and entry cap in order of arrival, by engine and fingerprint; the rules of ``prefix.matches``.

    ``stream``: request_id, engine, fp, tokens, and granularity of the entry to be published (any prefix without the column).
    Requests of unknown identity miss and publish nothing. A domain's state is bounded: beyond ``most_entries`` the entries
    that no other extends leave first, the least used, then the shortest; entries not used for ``ttl_ticks`` requests leave
    too. Both are counted so far, in evicted and expired. A domain is one task's: a hot one is split by giving its
    conversations engines of their own, since any of its entries may serve any request.
    """
    whole_column = "granularity" in stream.columns

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        index, tick, evicted, expired = Index(), 0, 0, 0
        if state.exists:
            tokens, used, whole, tick, evicted, expired = state.get
            for t, u, w in zip(tokens, used, whole):
                index.add(tuple(t), u, w)
        known = not {*key} & {*policy.UNKNOWN}
        for batch in batches:
            out = []
            for r in batch.sort_values("request_id").itertuples():
                t = tuple(r.tokens)
                if ttl_ticks is not None:
                    old = [e for e, (u, _) in index.entries.items() if tick - u > ttl_ticks]
                    for e in old:
                        index.drop(e)
                    expired += len(old)
                best = index.match(t) if known else None
                m = len(best or ())
                verdict = "miss" if m < 2 else "hit" if m == len(t) else "partial"
                if best:
                    index.entries[best][0] = tick
                if known and len(t) >= 2:
                    index.add(t, tick, bool(whole_column and r.granularity == 1))
                tick += 1
                while len(index.entries) > most_entries:
                    ends = [e for e in index.entries if not index.extended(e)]
                    index.drop(min(ends, key=lambda e: (index.entries[e][0], len(e), e)))
                    evicted += 1
                out.append((r.request_id, *key, m, None if best is None else best == t[:m], verdict, 0 if m < 2 else m - 1, evicted, expired))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ONLINE.split(", ")])
        e = index.entries
        state.update(([list(t) for t in e], [u for u, _ in e.values()], [bool(w) for _, w in e.values()], tick, evicted, expired))

    return stream.groupBy("engine", "fp").applyInPandasWithState(run, ONLINE, STATE, "append", GroupStateTimeout.NoTimeout)


def reaper(ticks: DataFrame, entries: Callable[[], DataFrame], reclaim: Callable[[DataFrame, int], None], limits: EvictConfig, clock: Callable[[DataFrame], int]) -> DataStreamWriter:
    """A sweep for every batch of ``ticks`` (a rate stream with a processing-time trigger, say): victims go to ``reclaim`` with the batch's number.

    ``entries`` gives the table as it is at that time, ``clock`` the time of a batch. A batch that is run again after a
    failure has the same number, by which ``reclaim`` can tell what it has done already. Without limits nothing is swept.
    """

    def sweep(batch: DataFrame, number: int) -> None:
        if limits.enabled and not batch.isEmpty():
            reclaim(lifecycle.evict_cold(entries(), limits.max_entries, limits.max_bytes, clock(batch), limits.anchor_window_s), number)

    return ticks.writeStream.foreachBatch(sweep)


def traced(stream: DataFrame, path: str, checkpoint: str, required: tuple[str, ...] = ("request_id", "verdict")) -> tuple[DataStreamWriter, str]:
    """A writer of ``stream`` as JSON lines, each row exactly once, and the name of its metrics: rows written, and rows that lack a required field.

    Nothing is dropped when the sink is slow: the source waits. The metrics come with every batch's progress (``observedMetrics``).
    """
    name = "trace"
    lacking = F.lit(False)
    for c in required:
        lacking |= F.col(c).isNull()
    seen = stream.observe(name, F.count(F.lit(1)).alias("records"), F.count_if(lacking).alias("lacking"))
    return seen.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append"), name
