import random

import pytest
from pyspark.sql import functions as F
from test_llm_more import brute_tree

from profseg.llm import lm


def test_lm_tells_places_in_their_buckets(spark, monkeypatch):
    # one shuffle of places instead of a shuffle, two joins and a table of grams a level; very frequent symbols split, and rare words
    rng = random.Random(12)
    phrases = [" ".join(f"w{rng.randrange(60)}" for _ in range(rng.randrange(2, 7))) for _ in range(15)]
    texts = [" ".join(rng.choice(phrases) if rng.random() < 0.7 else f"w{rng.randrange(200)}" for _ in range(rng.randrange(0, 12))) for _ in range(150)]
    texts += ["p q r alpha", "s q r beta"] * 30 + ["w1 w2 never w3", "", "never seen", None]
    df = spark.createDataFrame([(i if i % 50 else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    learns = F.coalesce(F.pmod("doc_id", F.lit(5)) != 2, F.lit(False))
    mine = [(t or "").encode().split() for i, t in enumerate(texts) if i % 50 and i % 5 != 2]
    score, keep = brute_tree(mine)
    want = sorted((i if i % 50 else -1, round(score((t or "").encode().split()), 6)) for i, t in enumerate(texts))
    seen = {w for t in mine for w in t}
    for most, share, chunk in ((1_000_000, 1e-6, 1_000_000), (40, 0.01, 1_000_000), (40, 0.01, 7), (4, 0.05, 7)):
        monkeypatch.setattr(lm, "BUCKET_TOKENS", most)
        monkeypatch.setattr(lm, "FREQUENT", share)
        monkeypatch.setattr(lm, "CHUNK", chunk)
        got = lm.train_and_score(df, learns, ~learns).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, round(r.score, 6)) for r in got) == want
        assert {r.train_tokens for r in got} == {sum(len(t) + 1 for t in mine)}
        assert sum(r.n_known for r in got) == sum(w in seen for t in texts for w in (t or "").encode().split()) + len(texts)
        apart = lm.score(df, ~learns, lm.train(df, learns)).collect()
        both = [sorted((r.doc_id or -1, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in x) for x in (got, apart)]
        assert both[0] == both[1]


def test_lm_without_teachers_or_texts(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = lm.train_and_score(df, F.lit(False), F.lit(True)).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got) == [(1, 3, 0, 0, 0.0, 0.0), (2, 1, 0, 0, 0.0, 0.0)]
    assert lm.train_and_score(df.limit(0), F.lit(True), F.lit(True)).count() == 0


def test_lm_shuffles_places_once(spark):
    df = spark.createDataFrame([(i, "a b c d " * 20) for i in range(50)], "doc_id long, text string")
    plan = lm.train_and_score(df, F.lit(True), F.lit(False))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
