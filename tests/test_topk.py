"""Top scores of several queries against a plain computation."""

import numpy as np

from prefixloom.operators import vectors
from prefixloom.plans import catalogue


def test_top_k_of_each_query(spark):
    x = np.random.default_rng(3).standard_normal((300, 64))
    e = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(300)], "vec_id long, embedding array<double>").where("vec_id > 0")
    codes = vectors.encoded(e, "embedding", 64, 4).select("vec_id", "packed", "norm")
    q = e.where("vec_id % 100 = 0").selectExpr("vec_id AS query_id", "embedding")
    got = {}
    for r in vectors.top_k_each(codes, q, 64, 4, 5, block=40, query_block=1).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    whole = vectors.decode(*vectors.encode(x[1:], 4), 4, 64)
    assert got == {i: set((np.argsort(-(whole @ x[i]))[:5] + 1).tolist()) for i in (100, 200)}


def test_registered_search_takes_every_hundredth_vector(spark):
    d = "/root/testdata/sf0.01"
    want = {r.vec_id for r in spark.read.parquet(f"{d}/embeddings.parquet").where("vec_id % 100 = 0").collect()}
    rows = catalogue.QUERIES["score_topk"](spark, d).collect()
    assert {r.query_id for r in rows} == want and len(rows) == 20 * len(want)
