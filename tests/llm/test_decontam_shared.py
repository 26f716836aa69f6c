"""Passages that many items quote: the queries count all windows."""

from profseg.llm import decontam, queries, stages

PASSAGE = "the old harbour town had no road before the railway came and its people lived from salt and from fish that they carried over the hills"
ITEMS = [f"{PASSAGE} so what did {name} sell in the year {1700 + i}" for i, name in enumerate(["miller", "widow", "priest"] * 10)]
DOCS = [f"it is said that {PASSAGE} and nobody knew better", "a text about other things that nobody asked for", ITEMS[3]]


def tables(spark, path):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(DOCS)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(enumerate(ITEMS)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return docs


def test_passages_that_many_items_quote(spark, tmp_path, monkeypatch):
    docs = tables(spark, tmp_path)
    monkeypatch.setattr(decontam, "ITEM_BITS", 2)  # a text goes to the judge several times
    got = sorted((r.doc_id, r.item_id) for r in queries.op10_template_decontamination(spark, str(tmp_path)).collect())
    assert got == [(d, i) for d in (0, 2) for i in range(len(ITEMS))]
    assert [r.doc_id for r in stages.drop_contaminated(spark, docs, str(tmp_path)).collect()] == [1]
