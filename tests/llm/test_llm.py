"""The training-data operators: brute force, exact round trips, held-out accuracy and edge cases."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from profseg.llm import bpe, chat, decontam, fixity, langid, lm, quality, setsketch, topk, toxicity
from profseg.llm.common import remainder
from profseg.llm.queries import ORACLE_SQL, QUERIES, bpe_files

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "Same text of five words here"), (5, "Same text of five words here"), (None, "no id"), (6, "x" * 200_000), (7, "a b " * 30_000), (8, "ÉCOLE 日本語 ́   \x00 end"), (9, "12 $ % !! |||")]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, with an extra column and one whose name clashes with a result's."""
    return spark.createDataFrame([(i, t, "en", "s", "extra", 5.0) for i, t in ODD], "doc_id long, text string, lang string, source string, kept string, score double")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


def labels_of(spark, rows, name):
    return spark.createDataFrame(rows, f"doc_id long, {name} int")


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_equals_sql(spark, duck, same, name):
    same(QUERIES[name](spark, DATA).toPandas(), duck.sql(ORACLE_SQL[name]).df())


# byte-level BPE


@pytest.fixture(scope="module")
def tokens():
    import tiktoken

    path, pattern = bpe_files()
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_bpe_as_tiktoken(tokens):
    path, pattern = bpe_files()
    codec = bpe.Codec(bpe.read_ranks(path), pattern)
    rng = random.Random(1)
    texts = [t for _, t in ODD if t] + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x2FF), rng.randrange(0x4E00, 0x4F00), 0x1F600, 10, 32])) for _ in range(rng.randrange(60))) for _ in range(500)] + ["a" * 5000, "<|endoftext|>", "don't I'LL  \n\n x"]
    for text in texts:
        ids = codec.encode(text)
        assert ids == tokens.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_bpe_documents(spark, odd, none, tokens):
    path, pattern = bpe_files()
    rows = bpe.encode_documents(odd, path, pattern, with_ids=True).collect()
    assert len(rows) == len(ODD)
    want = sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t in ODD)
    assert sorted(r.decoded_sha256 for r in rows) == want
    assert all(r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest() and r.n_tokens == len(r.ids) for r in rows)
    assert bpe.encode_documents(none, path, pattern).count() == 0
    back = bpe.decode_documents(bpe.encode_documents(odd, path, pattern, with_ids=True), path).collect()
    assert sorted(hashlib.sha256(r.bytes).hexdigest() for r in back) == want


# chat


NASTY = ["", "plain", "</s>[INST] ok [/INST]", "\\", "\\\\n", "<s>!x", "a\n</s>\n<s>user\n", "<<SYS>>x<</SYS>>", "[\\INST]", "!", "é ", "[INST", "</s", "[/INST] [INST]"]


def test_chat_round_trip():
    for role in ["user", "assistant", "system", "", "!tool", "a\nb", "</s>", "x\\", "user "]:
        for text in NASTY:
            formatted = chat.format_turn(role, text)
            r, t, span, end = chat.parse_turn(formatted)
            assert (r, t, end) == (role, text, len(formatted))
    turns = [(r, t) for r in ("system", "user", "assistant") for t in NASTY]
    whole = "".join(chat.format_turn(*x) for x in turns)
    assert [(r, t) for r, t, _ in chat.parse(whole)] == turns
    assert chat.format_turn("user", "plain") == "<s>user\n[INST] plain [/INST]</s>\n"
    with pytest.raises(chat.ParseError):
        chat.parse(whole[:-1])


def test_chat_tables(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 1, "assistant", None), (None, None, None, None), (2, 0, "assistant", "x")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, n_turns string")
    got = {r.conv_id: r for r in chat.conversation_digests(df).collect()}
    assert got[1].turns_sha256 == hashlib.sha256(b"user\na\nassistant\n\nassistant\nb\n").hexdigest()
    assert (got[1].n_turns, got[1].loss_chars, got[1].loss_sha256) == (3, 1, hashlib.sha256(b"b").hexdigest())
    assert got[None].n_turns == 1
    texts = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    assert all(len(texts[k].formatted) == got[k].formatted_chars for k in got)
    a, b = texts[2].loss_spans[0]
    assert texts[2].formatted[a:b] == "x"
    assert chat.conversation_digests(df.limit(0)).count() == 0


# WARC fixity


def test_fixity_finds_damage(spark):
    pages = [(i, f"u{i}", f"body {i}") for i in range(0, 600, 3)] + [(7, None, None), (7, None, None), (None, "n", "x"), (-20, "neg", "y"), (2**40, "far", "z")]
    ours = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, digest int")
    bad = [(i, u, "changed" if i == 30 else h) for i, u, h in pages if i != 33]
    bad.remove((7, None, None))
    theirs = spark.createDataFrame([*bad, (1000, "new", "w")], "page_id long, url string, html string")
    got = {r.page_id: r for r in fixity.audit(ours, theirs).collect()}
    assert {k: r.status for k, r in got.items() if r.status != "intact"} == {30: "altered", 33: "missing", 7: "altered", 1000: "extra"}
    at = 0
    for key in sorted(k for k in got if k != 1000):
        assert got[key].start_offset == at
        at += got[key].n_bytes
    assert {r.status for r in fixity.audit(ours, ours).collect()} == {"intact"}
    assert fixity.audit(ours.limit(0), ours.limit(0)).count() == 0
    assert {r.status for r in fixity.audit(ours, ours.limit(0)).collect()} == {"missing"}


def test_fixity_finds_moved_records(spark):
    rows = [(i, f"u{i}", f"body {i}") for i in range(0, 6000, 5)]
    moved = [(i + 1 if i == 40 else i + 256 if 5120 <= i < 5376 else i, u, h) for i, u, h in rows if not 5376 <= i < 5632]
    rows = [r for r in rows if not 5376 <= r[0] < 5632]
    ours, theirs = (spark.createDataFrame(x, "page_id long, url string, html string") for x in (rows, moved))
    got = {r.page_id: r.status for r in fixity.audit(ours, theirs).collect() if r.status != "intact"}
    want = {40: "missing", 41: "extra"} | {i: "missing" for i in range(5120, 5376, 5)} | {i + 256: "extra" for i in range(5120, 5376, 5)}
    assert got == want


# language model


def test_lm_equals_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = QUERIES["op3_suffix_tree_lm"](spark, DATA).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    words = lambda t: re.findall(r"[^ \t-\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
    c, ends = Counter(), 0
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            c.update(words(t))
            ends += 1
    n, v = sum(c.values()) + ends, len(c) + 1
    for r in got:
        own = words(texts[r.doc_id])
        base = sum(math.log10((x + 1) / (n + v + 1)) for x in [*(c[w] for w in own), ends])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own) + 1, sum(c[w] > 0 for w in own) + 1, n)
        assert r.base_score == pytest.approx(base, abs=1e-6)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_is_a_distribution(spark):
    rng = random.Random(3)
    text = lambda: " ".join(rng.choice(["a", "a", "b", "a b", "c d e"]) for _ in range(30))
    df = spark.createDataFrame([(i, text()) for i in range(40)], "doc_id long, text string")
    m = lm.train(df, F.lit(True))
    assert len(m.tree.contexts) > 0
    names = [w for w in m.frequent if w != lm.END]
    for history in ([], [b"a"], [b"c", b"d"], [b"b", b"zz"]):
        total = 0.0
        for word in [*names, None, b"unseen"]:
            texts = [history + ([] if word is None else [word])]
            ids, starts = lm.numbered(texts, m.tree.symbols)
            p = 10 ** m.tree.log10(ids, starts)[len(history)]
            total += p * m.unseen if word == b"unseen" else p
        assert total == pytest.approx(1.0, abs=1e-9)


def test_lm_contexts_grow_with_the_corpus(spark, monkeypatch):
    # a phrase of content words that is far below 1e-4 of all tokens, yet recurs
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{rng.randrange(4000)}" for _ in range(200))) for i in range(500)]
    rows += [(1000 + i, "rare phrase stands here") for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    asked = spark.createDataFrame([(1, "rare phrase stands here"), (2, "rare here stands phrase")], "doc_id long, text string")
    scores = []
    for head in (lm.HEAD, 0, 20):  # the grams beyond the head are joined, to the same result
        monkeypatch.setattr(lm, "HEAD", head)
        m = lm.train(df, F.lit(True))
        assert head or not len(m.tree.grams)
        scores.append({r.doc_id: r.score for r in lm.score(asked, F.lit(True), m).collect()})
    assert scores[0][1] > scores[0][2] + 6
    assert all(s == pytest.approx(scores[0], abs=1e-9) for s in scores)


def test_lm_edge_cases(spark, odd, none):
    got = lm.score(lm.documents_of(odd), F.lit(True), lm.train(lm.documents_of(odd), F.lit(False))).collect()
    assert len(got) == len(ODD) and all(math.isfinite(r.score) and r.train_tokens == 0 and r.n_known == 0 for r in got)
    got = lm.score(lm.documents_of(odd), F.lit(False), lm.train(lm.documents_of(odd), F.lit(True))).collect()
    assert all(r.n_known == r.n_tokens for r in got) and {r.n_tokens for r in got if r.doc_id in (1, 2, 3)} == {1}
    assert lm.score(lm.documents_of(none), F.lit(True), lm.train(lm.documents_of(none), F.lit(True))).count() == 0


# near-duplicates


def brute_near(rows):
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
    low = {i: i for i, _ in rows}
    changed = True
    links = [(a, b) for a, x in sets for b, y in sets if a < b and x and y and 100 * len(x & y) >= 75 * len(x | y)]
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            changed |= (low[a], low[b]) != (m, m)
            low[a] = low[b] = m
    return {i: (len(s), low[i]) for i, s in sets}


def test_near_equals_brute_force(spark):
    rng = random.Random(4)
    base = [[f"w{rng.randrange(300)}" for _ in range(rng.randrange(3, 120))] for _ in range(12)]
    rows = []
    for i in range(160):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(0, 6)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(300)}"
        rows.append((i, " ".join(words).upper() if i % 7 == 0 else "\n".join(words)))
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, component_id string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in setsketch.near_duplicates(df).collect()}
    assert got == brute_near(rows)


def test_near_edge_cases(spark, odd, none):
    got = setsketch.near_duplicates(odd).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r for r in got}
    assert all(by[i].n_shingles == 0 and by[i].component_id == i and by[i].kept for i in (1, 2, 3))
    assert sum(r.doc_id == 5 and r.kept for r in got) == 2
    assert by[None].component_id is None and by[None].kept
    assert setsketch.near_duplicates(none).count() == 0


def test_sketch_estimates_and_merges():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 2**63, 4000, np.int64).astype(np.uint64)
    for j in (0.2, 0.5, 0.75, 0.95):
        k = int(2000 * 2 * j / (1 + j))
        a, b = pool[:2000], np.concatenate([pool[:k], pool[2000 : 4000 - k]])
        r = setsketch.sketch([a, b, np.union1d(a, b)])
        assert setsketch.estimate(r[:1], r[1:2], np.array([2000.0]), np.array([float(len(b))]))[0] == pytest.approx(j, abs=0.12)
        assert (np.maximum(r[0], r[1]) == r[2]).all()


# top-k


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 8)]) for i in range(300)]
    rows += [(1000 + i, [0.5] * 8) for i in range(40)] + [(2000, None), (2100, [float("nan")] * 8), (2200, [None] * 8), (2300, [0.1, 0.2]), (2400, [0.1, 0.3]), (None, [0.1] * 8), (100, rows[100][1]), (2500, [])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, rank int")
    got = {}
    for r in topk.search(df, F.pmod("vec_id", F.lit(100)) == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    for q in {i for i, _ in ok if i % 100 == 0}:
        v = next(v for i, v in ok if i == q)
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q and len(w) == len(v))[:10]
        assert sorted(got.get(q, [])) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert topk.search(df.limit(0), F.lit(True)).count() == 0


def test_topk_wide_numbers():
    block = topk.Block(np.array([1, 2, 3]), np.array([[2.0**40, 1], [2.0**40, 2], [-(2.0**40), 0]]))
    assert list(block.best(np.array([9]), np.array([[2.0**20, 1.0]]), 2)) == [(9, 2, 2**60 + 2), (9, 1, 2**60 + 1)]


# classifiers


def accuracy(rows, truth, at=0.5):
    return np.mean([(r.score >= at) == truth[r.doc_id] for r in rows])


def test_quality_held_out(spark):
    rng = random.Random(7)
    clean = lambda: ". ".join(" ".join(rng.choice(["river", "stone", "light", "of", "the", "and"]) for _ in range(9)) for _ in range(6))
    junk = [lambda: " ".join(rng.choice(["BUY!!", "NOW!!", "FREE!!"]) for _ in range(40)), lambda: " | ".join(rng.choice(["home", "login"]) for _ in range(30)), lambda: "word " * 50]
    truth = {i: rng.random() < 0.7 for i in range(400)}
    docs = spark.createDataFrame([(i, clean() if good else rng.choice(junk)()) for i, good in truth.items()], "doc_id long, text string")
    labels = labels_of(spark, [(i, int(g)) for i, g in truth.items()], "quality")
    model = quality.train(docs, labels, remainder(F.col("doc_id"), 3) != 1)
    rows = quality.score(docs, model).collect()
    assert accuracy(rows, truth) > 0.97 and model.rules
    x = np.array([[r[s] for s in quality.STATS] for r in quality.with_stats(docs).orderBy("doc_id").collect()])
    assert np.allclose(model.scores(x), [r.score for r in sorted(rows, key=lambda r: r.doc_id)])


def test_quality_edge_cases(spark, odd, none):
    for labels in ([], [(4, 1), (4, 0), (None, 1), (5, None)], [(4, 1)], [(4, 0), (5, 1)]):
        model = quality.train(odd.select("doc_id", "text"), labels_of(spark, labels, "quality"), F.lit(True))
        rows = quality.score(odd.select("doc_id", "text"), model).collect()
        assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert quality.score(none.select("doc_id", "text"), quality.Model(0.0, [])).count() == 0


def test_toxicity_held_out(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice(["tha", "eri", "on", "sil", "ver", "ka"]) for _ in range(rng.randrange(1, 4)))
    truth, rows = {}, []
    for i in range(600):
        words = [word() for _ in range(40)]
        truth[i] = i % 4 == 0
        if truth[i]:
            for _ in range(3):
                words.insert(rng.randrange(40), rng.choice(["wretch", "blockhead", "qur" + word()]))
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = labels_of(spark, [(i, int(t)) for i, t in truth.items()], "toxic")
    model = toxicity.train(docs, labels, remainder(F.col("doc_id"), 5) != 0)
    assert accuracy(toxicity.score(docs, model).collect(), truth) > 0.97
    assert "wretch" in model.terms and any("qur" in s for s in model.stems)
    new = spark.createDataFrame([(1, "you wretsh and blokhead, a wretch"), (2, 'she said "wretch" to him'), (3, "a silver kaka")], "doc_id long, text string")
    got = {r.doc_id: r.predicted for r in toxicity.score(new, model).collect()}
    assert got == {1: 1, 2: 0, 3: 0}


def test_toxicity_matcher_equals_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(9)
    terms = ["abab", "babab", "abbabb", "aabbaabba", "bbbbbaaaaa"]
    matcher = toxicity.Matcher(terms, [])
    for _ in range(3000):
        w = "".join(rng.choice("ab") for _ in range(rng.randrange(0, 13)))
        best = min((distance(w, t), t) for t in terms if distance(w, t) <= toxicity.edits_for(t)) if any(distance(w, t) <= toxicity.edits_for(t) for t in terms) else None
        found = matcher.match(w)
        assert (found and found[1]) == (best and best[0])


def test_toxicity_misspelt_stems():
    rows = [("bomentela", 0, 5, 0), ("bomentori", 0, 5, 0), ("bomente", 1, 10, 0), ("qurilo", 0, 5, 0), ("quravi", 0, 5, 0), ("qur", 1, 10, 0)]
    terms, stems = toxicity.choose_terms(rows, 20, 20)
    matcher = toxicity.Matcher(sorted(terms), sorted(stems), frozenset(["bomantor"]))
    assert matcher.match("bomenteki") == ("bomente", 0, True) and matcher.match("bomemteki") == ("bomente", 1, True)
    assert matcher.match("bmenteki") == ("bomente", 1, True) and matcher.match("qirilo") == ("qurilo", 1, False)
    assert matcher.match("bomantor") is None and matcher.match("bamemteki") is None and matcher.match("qiravolo") is None


def test_toxicity_quotation_needs_a_close():
    model = toxicity.Model({"wretch": 3.0}, {}, frozenset(), np.zeros(6))
    far = "a b c d e f g h "
    for text, quoted in ((f'a 5" board {far} wretch', 0), (f'"{far} wretch" he', 1), (f"„{far} wretch“ er", 1), (f"“{far} wretch\n” x", 0), (f"«{far} wretch» x", 1)):
        assert toxicity.Reader(model).features(text)[2] == pytest.approx(math.log1p(quoted))


def test_toxicity_edge_cases(spark, odd):
    for labels in ([], [(4, 1)], [(4, 1), (5, 0)]):
        model = toxicity.train(odd.select("doc_id", "text"), labels_of(spark, labels, "toxic"), F.lit(True))
        rows = toxicity.score(odd.select("doc_id", "text"), model).collect()
        assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)


def test_language_held_out(spark):
    docs = langid.documents_of(spark.read.parquet(f"{DATA}/documents.parquet"))
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = [r for r in QUERIES["op9_language_backoff"](spark, DATA).collect() if r.held_out]
    assert rows and np.mean([r.lang_pred == truth[r.doc_id] for r in rows]) > 0.95


def test_language_edge_cases(spark, odd, none):
    rows = langid.predict(odd.select("doc_id", "text"), langid.train(langid.documents_of(odd), F.lit(True))).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(ODD) and all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (1, 2, 3, 9))
    assert all(0 <= r.score <= 1 for r in rows)
    empty = langid.train(langid.documents_of(none), F.lit(True))
    assert {r.lang_pred for r in langid.predict(odd.select("doc_id", "text"), empty).collect()} == {"und"}


# decontamination


def test_decontamination(spark):
    item = "If Anna buys 12 apples for 3 dollars and Bob buys 12 pears, how many kg of fruit does Anna carry home today?"
    changed = item.replace("Anna", "Clara").replace("12", "40").replace("Bob", "Dan").replace("3 dollars", "9 euros")
    wrong = item.replace("Anna", "Clara", 1).replace("12", "40", 1)
    docs = spark.createDataFrame([(1, "Some words. " + item), (2, "intro\n" + changed + " outro"), (3, wrong), (4, "nothing of the kind"), (5, None), (6, ""), (1, "Some words. " + item)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, None), (9, ""), (10, "short one"), (7, item)], "item_id long, text string")
    for size in (8_000_000, 60):
        got = {(r.doc_id, r.item_id, r.exact) for r in decontam.matches(docs, bench, size).collect()}
        assert got == {(1, 7, True), (2, 7, False)}
        assert sorted(r.doc_id for r in decontam.clean(docs, bench, size).collect()) == [3, 4, 5, 6]
    assert decontam.matches(docs, bench.limit(0)).count() == 0 and decontam.matches(docs.limit(0), bench).count() == 0


def test_decontamination_values_may_become_equal(spark):
    item = "A farmer keeps 3 goats in one field and 5 sheep in the other field behind the old barn"
    docs = spark.createDataFrame([(1, item.replace("3", "4").replace("5", "4"))], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.exact) for r in decontam.matches(docs, bench).collect()] == [(1, 7, False)]


def test_decontamination_few_words(spark):
    sums, short, question = "12 + 30 = 42 , 7 + 8 = 15 , 9 + 2 = 11", "add 3 and 4 to 5", "What is heavier than lead"
    docs = [(1, "see " + sums + " done"), (2, sums.replace("12", "13").replace("7", "6").replace("9", "8").replace("3", "1")), (3, "please " + short), (4, "1) " + question), (5, "so " + question.replace("lead", "gold"))]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(7, sums), (8, short), (9, question)], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id, r.exact) for r in decontam.matches(docs, bench).collect()) == [(1, 7, True), (3, 8, True), (4, 9, True)]


def test_decontamination_equals_brute_force(spark):
    docs, bench = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet")
    items = {r.item_id: decontam.canonical(r.text)[0] for r in bench.collect()}
    want = set()
    for d in docs.collect():
        have = decontam.canonical(d.text)[0]
        grams = {tuple(have[k : k + 8]) for k in range(len(have) - 7)}
        for i, t in items.items():
            own = [tuple(t[k : k + 8]) for k in range(len(t) - 7)]
            covered = {k + x for k, g in enumerate(own) if g in grams for x in range(8)}
            if len(covered) >= 0.5 * len(t):
                want.add((d.doc_id, i))
    assert {(r.doc_id, r.item_id) for r in decontam.matches(docs, bench).collect()} == want


# pipeline


def test_pipeline(spark):
    import corpus_pipeline as p
    from profseg.llm.common import written

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in p.STAGES:
        docs = written(stage(spark, docs, DATA), f"test-{name}")
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
        if name != p.STAGES[-1][0]:
            assert docs.columns == columns
    assert all(b <= a for a, b in zip(kept, kept[1:])) and kept[-1]
    assert {r.doc_id for r in corpus_pipeline.run(spark, DATA).collect()} == kept[-1]


def test_near_stage_keeps_one(spark):
    from profseg.llm import stages

    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text), (2, text), (3, text + " more"), (4, "else entirely"), (4, "else entirely"), (None, "no id at all"), (5, None), (6, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, kept int")
    got = stages.keep_one_of_each_group(spark, docs, DATA)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in got.collect() if r.doc_id != 5) == [(0, "no id at all"), (1, text), (4, "else entirely"), (6, "")]
    assert got.filter("doc_id = 5").count() == 1
    assert stages.keep_one_of_each_group(spark, docs.limit(0), DATA).count() == 0
