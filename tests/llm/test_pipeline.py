"""The pipeline's stages against plain Python, on documents of the small tables and odd rows."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from prefixloom.functions import tables
from test_jaccard import brute_groups
from test_native import brute_contamination, brute_targets
from test_pii import brute as brute_spans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(900001, None, "en", "src0", 0), (900002, "", "en", None, 0), (900003, "12 34", None, "src1", 5), (None, "words without an id stand here", "en", "src1", 30)]
    odd += [(900004, "repeated row of words", None, "src2", 21)] * 2
    return d.unionByName(spark.createDataFrame(odd, d.schema))


def plain(df):
    return [r.asDict() for r in df.collect()]


def test_stages(spark, docs):
    before, out = plain(docs), docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.written(stage(spark, out, SF))
        seen[name] = plain(out)
        if name != "mix":
            assert out.columns == docs.columns
    ids = lambda rows: sorted(((r["doc_id"], r["text"]) for r in rows), key=str)

    letters = [r for r in before if any(c.isalpha() for c in r["text"] or "")]
    assert ids(seen["language"]) == ids(letters) and all(r["lang"] for r in seen["language"])

    # The stage is on 5-word shingles at a similarity of 0.8: one row of each group of an exact join stays.
    came = sorted(seen["language"], key=lambda r: (r["doc_id"] is None, r["doc_id"]))
    groups = brute_groups([r["text"] for r in came])
    assert ids(seen["near_dedup"]) == ids([r for k, r in enumerate(came) if groups[k] == k])

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clear = [r for r in seen["near_dedup"] if not brute_contamination(r["text"], items)[1]]
    assert ids(seen["decontaminate"]) == ids(clear) and len(clear) < len(seen["near_dedup"])

    new = {r["doc_id"]: r for r in seen["redact"]}
    assert len(new) == len(seen["decontaminate"])
    for r in seen["decontaminate"]:
        spans = brute_spans(r["text"])
        got = new[r["doc_id"]]
        assert got["n_chars"] == len(got["text"])
        assert (got["text"] == r["text"]) or spans or "[SECRET]" in got["text"]
        for _, a, b in spans:
            assert r["text"][a:b] not in got["text"]

    size = Counter()
    for r in seen["redact"]:
        size[r["source"]] += len(r["text"].split())
    want, taken = brute_targets(size), Counter()
    for r in seen["mix"]:
        taken[r["source"]] += r["taken"]
        assert 0 < r["taken"] <= 3 * r["size"]
    for s in size:
        assert abs(taken[s] - want[s]) <= 1


def test_clashing_names(spark, docs):
    out = docs.withColumns({"_key": F.lit("own"), "_key_": F.lit(1), "score": F.lit(2.0), "spans": F.lit("s"), "n_words": F.lit(3)})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = out.columns
        out = corpus_pipeline.written(stage(spark, out, SF))
        assert out.columns == columns, name
    kept = out.select("_key", "_key_", "score", "spans", "n_words").distinct().collect()
    assert [tuple(r) for r in kept] == [("own", 1, 2.0, "s", 3)]


def test_empty(spark, docs):
    out = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.written(stage(spark, out, SF))
    assert out.count() == 0


def test_run(spark):
    before = tables.tables()
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 50 and len([t for t in tables.tables() if t not in before]) <= 3  # the last stage's input and its own two
