"""Top-k search where the queries are many."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from profseg.llm import topk


def brute(x: np.ndarray, every: int) -> list[tuple]:
    whole = np.floor(1024 * x).astype(int)
    out = []
    for q in range(0, len(x), every):
        order = sorted((-int(whole[q] @ whole[i]), i) for i in range(len(x)) if i != q)[:10]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(order, 1)]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_copies_of_the_queries_are_never_broadcast(spark, monkeypatch, seed):
    monkeypatch.setattr(topk, "BLOCK", 16, raising=False)
    monkeypatch.setattr(topk, "QUERY_BLOCKS", 2, raising=False)
    x = np.random.default_rng(seed).normal(0, 1, (300, 6)).round(1)
    x[::7] = x[3]
    found = topk.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), F.col("vec_id") % 3 == 0)
    assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in found.select("query_id", "rank", "vec_id", "score").collect()) == brute(x, 3)


def test_a_bar_closes_queries_of_later_blocks():
    rng = np.random.default_rng(5)
    whole = np.floor(1024 * rng.normal(0, 0.1, (600, 32)))
    block, asked = topk.Block(np.arange(600), whole), whole[:40] + 1
    ids = np.arange(1000, 1040)
    scores = asked @ whole.T
    bars = np.sort(scores, axis=1)[:, -3]  # two candidates are above it and one equals it
    alone = list(block.best(ids, asked, 10))
    read, block.read = block.read, 0
    got = list(block.best(ids, asked, 10, bars=bars))
    assert block.read <= read
    assert sorted(got) == sorted((q, i, s) for q, i, s in alone if s >= bars[q - 1000])
    block.read = 0
    assert list(block.best(ids, asked, 10, bars=np.full(40, 1e18))) == [] and block.read < read
