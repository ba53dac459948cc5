"""A checkpoint store over two tables: entries, and the payloads that their names point at."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import evict, lifecycle, policy, prefix

KEYS = ("engine", "fp", "tokens")


@dataclass(frozen=True)
class Store:
    """Nothing is changed in place: ``put``, ``invalidate`` and ``within`` give a new store, whose tables the caller writes.

    ``entries``: name, engine, fp, tokens, granularity, last_used, size_bytes, generation. ``payloads``: name, payload.
    """

    entries: DataFrame
    payloads: DataFrame

    def lookup(self, requests: DataFrame) -> DataFrame:
        """``requests`` with entry, matched_tokens, verdict and prefill_from; unknown identities (fp ``missing`` or ``unresolved``) match nothing."""
        known = self.entries.where(~F.col("fp").isin(*policy.UNKNOWN))
        return policy.classified(prefix.matches(requests, known))

    def fetch(self, found: DataFrame) -> DataFrame:
        """``found`` (entry) with its payload, null where the entry or its payload is gone."""
        return found.join(self.payloads.select(F.col("name").alias("entry"), "payload"), "entry", "left")

    def put(self, entries: DataFrame, payloads: DataFrame) -> Store:
        """Of each key the newest generation stays; entries of under two tokens or of unknown identity are refused."""
        fit = entries.where((F.size("tokens") >= 2) & ~F.col("fp").isin(*policy.UNKNOWN))
        return self._with(lifecycle.publish(self.entries, fit.select(*self.entries.columns), *KEYS), self.payloads.unionByName(payloads))

    def invalidate(self, key: list) -> Store:
        """Without the entries at ``key`` and below it."""
        return self._with(lifecycle.invalidate(self.entries, key)[0], self.payloads)

    def within(self, budget: int, now: int, window: int) -> Store:
        """Without the victims of one sweep under a byte budget."""
        victims = evict.whole_budget(prefix.with_anchor(self.entries), budget, now, window)
        return self._with(self.entries.join(victims.select("name"), "name", "left_anti").select(*self.entries.columns), self.payloads)

    @staticmethod
    def _with(entries: DataFrame, payloads: DataFrame) -> Store:
        return Store(entries, payloads.join(entries.select("name"), "name", "left_semi"))
