"""Bitmaps of keys before a join, and what they spare the near-dedup stage."""

import pytest

import corpus_pipeline
from prefixloom.llm import keyset


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_no_key_is_turned_away(spark, monkeypatch, n):
    monkeypatch.setattr(keyset, "MOST", 1 << 16)  # 5000 keys get fewer bits than they would
    rows = spark.range(20_000).selectExpr("id", "unhex(md5(cast(id as string))) as k", "'own' as _bits", "1 as _span")
    keys = keyset.Keys(rows.where(f"id < {n}").select("k"), "k")
    within, without = ({r.id for r in f(rows).collect()} for f in (keys.within, keys.without))
    assert within >= set(range(n)) and within | without == set(range(20_000)) and not within & without
    assert len(within) <= n + 0.1 * 20_000
    assert keys.within(rows).columns == keys.without(rows).columns == rows.columns


def test_stage_sends_only_texts_in_question(spark, monkeypatch):
    """Texts without a near copy pass no shuffle; a repeated row and the copies do."""
    texts = [" ".join(f"w{i}_{j}" for j in range(30)) for i in range(600)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(600, texts[0]), (1, texts[1]), (601, texts[2] + " end")]
    docs, sent = spark.createDataFrame(rows, "doc_id long, text string"), []

    def counted(self, rows, held=keyset.Keys.within):
        sent.append(held(self, rows).count())
        return held(self, rows)

    monkeypatch.setattr(keyset.Keys, "within", counted)
    assert sorted((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == list(enumerate(texts))
    assert len(sent) == 2 and all(2 <= n < 60 for n in sent)
