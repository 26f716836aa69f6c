"""Spelling variants against all pairs of words, and its SQL."""

import random
from collections import Counter

import pytest

from profseg.llm import variants
from profseg.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(counts):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, counts[w], len(near[w]), form[w], counts.get(form[w]), root))
    return sorted(out)


def rows_of(df):
    return sorted(map(tuple, df.select("word", "n", "n_near", "form", "form_n", "root").collect()))


def some_words(seed, n, letters, shared=""):
    rnd = random.Random(seed)
    words = {shared + "".join(rnd.choice(letters) for _ in range(rnd.randrange(5, 8))) for _ in range(n)}
    return {w: rnd.choice([3, 3, 4, 6, 7, 12, 30, 100]) for w in words}


@pytest.mark.parametrize("group", [2, 8, 32])
def test_all_pairs_whatever_the_size_of_a_key(spark, monkeypatch, group):
    monkeypatch.setattr(variants, "GROUP", group)
    counts = some_words(1, 250, "abÿ") | some_words(2, 250, "àb", "sharedstem")
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert rows_of(variants.variants(df)) == expected(counts)


def test_pairs_at_every_place_and_a_chain_of_forms(spark):
    base = "grünlich"
    counts = {base: 3}
    for i in range(len(base) + 1):
        counts[base[:i] + "x" + base[i:]] = 4
        if i < len(base):
            counts[base[:i] + "y" + base[i + 1 :]] = 5
            counts[base[:i] + base[i + 1 :]] = 3
    counts |= {"aaaaa" + "b" * i: 3 * 2**i for i in range(12)}  # each leads to the next
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = rows_of(variants.variants(df))
    assert got == expected(counts)
    assert next(r for r in got if r[0] == "aaaaa")[5] == "aaaaa" + "b" * 11


def test_words_are_damaged_runs_of_whole_texts(spark):
    rnd = random.Random(4)
    words = ["Straße", "ÀÉî×÷xyz", "kein", "HOUSES", "houses", "a" * 300, "abcde"]
    texts = [(rnd.choice([None, 1, 2, 3]), rnd.choice([None, "", " ".join(rnd.choice(words) + rnd.choice(["", "1", "_", "é"]) for _ in range(60))])) for _ in range(60)]
    counts = Counter()
    for doc_id, text in texts:
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        runs = "".join(c if "a" <= c <= "z" or "À" <= c <= "ÿ" else " " for c in low).split()
        counts.update(variants.damaged(doc_id, r) for r in runs)
    want = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    df = spark.createDataFrame([(*t, 1, "x") for t in texts], "doc_id long, text string, n int, word string")
    got = {r.word: r.n for r in variants.words_of(df).collect()}
    assert got == want and "a" * 300 in got
    assert rows_of(variants.document_variants(df)) == expected(want)
    assert variants.document_variants(df.limit(0)).collect() == []


def test_query_equals_its_sql(spark, duck):
    columns = ["word", "n", "n_near", "form", "form_n", "root"]
    want = duck.sql(f"select {', '.join(columns)} from ({ORACLE_SQL['op12_spelling_variants']})").fetchall()
    assert rows_of(QUERIES["op12_spelling_variants"](spark, DATA)) == sorted(want) and len(want) > 1000
