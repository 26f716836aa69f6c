"""More of the training-data operators: what they must not drop, edges of the pipeline's stages, and plain forms of models."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from profseg.llm import bpe, common, decontam, langid, lm, quality, setsketch, stages, topk, toxicity
from profseg.llm.queries import QUERIES, bpe_files

DATA, LARGER, LARGEST = "/root/testdata/sf0.001", "/root/testdata/sf0.01", "/root/testdata/sf0.1"


# filters and the shared folder


def test_filter_misses_nothing(spark):
    rng = np.random.default_rng(1)
    keys = rng.integers(-(2**63), 2**63 - 1, 3000, np.int64)
    df = spark.createDataFrame([(int(k),) for k in keys], "key long")
    for bits in (1 << 30, 1 << 12, 60):
        found = common.Filter.of(df, bits)
        assert found.size <= bits and found.passes(keys).all()
    assert common.Filter.of(df).passes(rng.integers(-(2**63), 2**63 - 1, 20000, np.int64)).mean() < 0.01
    assert not common.Filter.of(df.limit(0)).passes(keys).any()


def test_shared_folder_must_be_named_on_a_cluster():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda *_: None)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getConf = staticmethod(lambda: Session.conf)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session)


# language model


def brute_tree(texts):
    """log10 probabilities of a text by the definition of the tree, from plain dictionaries."""
    words, grams = Counter(), [Counter() for _ in range(lm.DEPTH + 1)]
    for text in texts:
        words.update([*text, lm.END])
        whole = [lm.END, *text, lm.END]
        for i in range(1, len(whole)):
            for d in range(1, min(lm.DEPTH, i) + 1):
                grams[d][tuple(whole[i - d : i]), whole[i]] += 1
    n, v = sum(words.values()), len(words)
    once, twice = (sum(1 for w, c in words.items() if c == k and w != lm.END) for k in (1, 2))
    discount = lm.discount_of(once, twice)
    level = [{((), w): c / n - discount / n for w, c in words.items()}]
    totals, told, keep = [{(): n}], [{}], [{()}]
    for d in range(1, lm.DEPTH + 1):
        own = {g: c for g, c in grams[d].items() if c >= lm.LEAST}
        shorter = words if d == 1 else None
        total = {ctx: shorter[ctx[0]] if d == 1 else grams[d - 1][ctx[:-1], ctx[-1]] for ctx, _ in own}
        totals.append(total)
        level.append({(ctx, w): c / total[ctx] for (ctx, w), c in own.items()})
        told.append({})
        for (ctx, w), c in own.items():
            told[d].setdefault(ctx, {})[w] = c
        kept = set()
        for ctx, next_ in told[d].items():
            below = {w: level[d - 1][ctx[1:], w] for w in next_}
            rest, rest_below = total[ctx] - sum(next_.values()), 1 - sum(below.values())
            gain = sum(c * math.log(c / total[ctx] / below[w]) for w, c in next_.items())
            gain += rest * math.log(rest / total[ctx] / rest_below) if rest > 0 and rest_below > 1e-12 else 0
            if gain >= lm.LEAST_GAIN + lm.GAIN_A_SYMBOL * len(next_):
                kept.add(ctx)
        keep.append(kept)
    for d in range(lm.DEPTH, 1, -1):
        keep[d - 1] |= {ctx[1:] for ctx in keep[d]}

    def p(ctx, w):
        if not ctx:
            return (words[w] - discount) / n if w in words else discount * v / n
        low = p(ctx[1:], w)
        if ctx not in keep[len(ctx)]:
            return low
        next_, total = told[len(ctx)][ctx], totals[len(ctx)][ctx]
        left = (total - sum(next_.values()) + lm.DISCOUNT * len(next_)) / total
        return (next_[w] - lm.DISCOUNT) / total + left * low if w in next_ else left * low

    def score(text):
        whole = [lm.END, *text, lm.END]
        return sum(math.log10(p(tuple(whole[max(0, i - lm.DEPTH) : i]), whole[i])) for i in range(1, len(whole)))

    return score, keep


def test_lm_equals_a_brute_force_tree(spark, monkeypatch):
    rng = random.Random(11)
    phrases = [" ".join(f"w{rng.randrange(60)}" for _ in range(rng.randrange(2, 7))) for _ in range(15)]
    texts = [" ".join(rng.choice(phrases) if rng.random() < 0.7 else f"w{rng.randrange(200)}" for _ in range(rng.randrange(0, 12))) for _ in range(150)]
    texts += ["p q r alpha", "s q r beta"] * 30
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    score, keep = brute_tree([t.encode().split() for t in texts])
    assert all(keep[1:])
    new = [*texts[:40], "w1 w2 never w3", "", "never seen"]
    asked = spark.createDataFrame(list(enumerate(new)), "doc_id long, text string")
    for most in (1_000_000, 40):  # contexts in one part, and split
        monkeypatch.setattr(lm, "BUCKET_TOKENS", most)
        got = {r.doc_id: r.score for r in lm.score(asked, F.lit(True), lm.train(df, F.lit(True))).collect()}
        for i, text in enumerate(new):
            assert got[i] == pytest.approx(score(text.encode().split()), abs=1e-9)


# near-duplicates


def test_rows_with_the_same_id_stay_apart(spark):
    words = lambda k, n=40: " ".join(f"{k}{i}" for i in range(n))
    rows = [(None, words("a")), (None, words("b")), (None, words("a")), (3, words("c")), (3, words("d")), (3, words("c")), (4, words("c") + " more"), (None, words("d") + " more"), (9, ""), (9, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, label long")
    got = stages.keep_one_of_each_group(spark, docs, DATA)
    assert got.columns == docs.columns
    assert sorted(r.label for r in got.collect() if r.label not in (0, 2, 3, 5)) == [1, 4, 8, 9, 10]
    kept = [r.label for r in got.collect()]
    assert len([k for k in kept if k in (0, 2)]) == 1 and len([k for k in kept if k in (3, 5)]) == 1
    found = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in setsketch.near_duplicates(docs).collect()}
    assert (3, 36, 3, True) in found and (4, 37, 3, False) in found and (None, 36, None, True) in found and (None, 37, 3, False) in found


def test_crowded_bands_are_split(spark, monkeypatch):
    """Copies with many common words in all sizes, so that bands hold several components."""
    rng = random.Random(12)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(120):
        words = base[: rng.choice([60, 90, 130, 200])]
        for _ in range(rng.randrange(0, 9)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(30)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(setsketch, "SPLIT", 3)
    got = {r.doc_id: r.component_id for r in setsketch.near_duplicates(df).collect()}
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    low = list(range(len(rows)))
    for _ in range(len(rows)):
        for a in range(len(rows)):
            for b in range(a):
                if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    low[a] = low[b] = min(low[a], low[b])
    assert got == dict(enumerate(low))


# stages


def test_stages_keep_clashing_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = ["score", "lang_pred", "log_words", "_kept", "predicted", "key", "label", "uid", "copies", "a.b"]
    wide = docs.withColumns({n: F.concat(F.lit(f"{n} "), F.col("doc_id").cast("string")) for n in names})
    wide = wide.unionByName(wide.limit(3)).unionByName(wide.limit(2).withColumns({"text": F.lit(None).cast("string"), "doc_id": F.lit(None).cast("long")}))
    for stage in (stages.keep_good, stages.keep_known_language, stages.keep_one_of_each_group, stages.drop_contaminated):
        plain = sorted(r.doc_id for r in stage(spark, docs, DATA).select("doc_id").collect())
        out = stage(spark, wide, DATA)
        assert out.columns == wide.columns
        rows = out.collect()
        assert all(r[n] == f"{n} {r.doc_id}" for r in rows if r.doc_id is not None for n in names)
        assert set(plain) == {r.doc_id for r in rows if r.doc_id is not None}
        assert stage(spark, wide.limit(0), DATA).count() == 0
    tokens = stages.encode(spark, wide, DATA)
    assert tokens.count() == wide.count() and tokens.filter("doc_id is null and n_tokens <> 0").count() == 0


# language


def test_language_forgets_between_texts_only(spark, monkeypatch):
    docs = langid.documents_of(spark.read.parquet(f"{DATA}/documents.parquet"))
    model = langid.train(docs, F.lit(True))
    texts = [r.text for r in docs.limit(40).collect()] + ["the the the cat ax bx"]
    whole = [langid.Reader(model).judge(t) for t in texts]
    for size in (1, 3, 50):
        monkeypatch.setattr(langid, "CACHE_ENTRIES", size)
        reader = langid.Reader(model)
        assert [reader.judge(t) for t in texts] == whole


def test_rare_languages_are_learned(spark):
    rng = random.Random(2)
    many = [(i, " ".join(rng.choice(["river", "stone", "light"]) for _ in range(20)), "en") for i in range(300)]
    few = [(1000 + i, "kala puu vesi " * 5, "fi") for i in range(4)]
    docs = spark.createDataFrame(many + few, "doc_id long, text string, lang string")
    model = langid.train(docs, F.lit(True), train_docs=30)
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs, model).collect()}
    assert all(got[1000 + i] == "fi" for i in range(4)) and got[0] == "en"


# top-k


def test_topk_reads_fewer_postings():
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 0.3, (30, 48))
    whole = np.floor(1024 * (centres[rng.integers(0, 30, 1500)] + rng.normal(0, 0.05, (1500, 48))))
    block, asked = topk.Block(np.arange(1500), whole), whole[:60]
    got = list(block.best(np.arange(60), asked, 10))
    for q in range(60):
        scores = sorted((-float(asked[q] @ whole[i]), i) for i in range(1500) if i != q)[:10]
        assert [(i, s) for query, i, s in got if query == q] == [(i, int(-s)) for s, i in scores]
    assert 0 < block.read < 0.6 * whole.size * 60  # brute force reads every component for every query


def test_topk_takes_all_finite_components(spark):
    rows = [(100, [1.0, 2.0]), (200, [1e307, 0.0]), (1, [1.7e305, 0.0]), (2, [0.5, 0.25]), (3, [-1.7e308, 1e308]), (4, [float("inf"), 0.0]), (5, [None, 1.0])]
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") >= 100).collect())
    most = 2**63 - 1
    assert got == [(100, 1, 1, most), (100, 2, 3, most), (100, 3, 200, most), (100, 4, 2, 1024 * 512 + 2048 * 256), (200, 1, 1, most), (200, 2, 2, most), (200, 3, 100, most), (200, 4, 3, -(2**63))]


@pytest.mark.parametrize("block", [7, 64])
def test_topk_over_blocks_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCKS_PER_COPY", 2)
    rng = np.random.default_rng(21)
    x = rng.normal(0, 1, (150, 8)).round(2)
    x[::9] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").coalesce(1)
    whole = np.floor(1024 * x).astype(int)
    index = [topk.Block(np.arange(i, min(150, i + block)), topk.whole_of(x[i : i + block])) for i in range(0, 150, block)]
    want, parts = [], {}
    for q in range(0, 150, 10):
        order = sorted((-int(whole[q] @ whole[i]), i) for i in range(150) if i != q)[:10]
        want += [(q, n, i, -s) for n, (s, i) in enumerate(order, 1)]
        for part in index:
            parts.setdefault(q, []).extend((-s, i) for _, i, s in part.best(np.array([q]), topk.whole_of(x[[q]]), 10))
        assert sorted(parts[q])[:10] == order
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.search(df, F.col("vec_id") % 10 == 0).collect())
    assert got == want


# classifiers on the labels at hand


def held_out(spark, name, label, data):
    rows = QUERIES[name](spark, data).filter("held_out").join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").select("score", "predicted", F.col(label).alias("y")).collect()
    good, bad = ([r.score for r in rows if r.y == y] for y in (1, 0))
    return np.mean([(g > b) + (g == b) / 2 for g in good for b in bad]), np.mean([r.predicted == r.y for r in rows])


def test_quality_on_labels(spark):
    auc, accuracy = held_out(spark, "op7_quality_rules", "quality", LARGER)
    assert auc > 0.97 and accuracy > 0.95


def test_toxicity_on_labels(spark):
    auc, accuracy = held_out(spark, "op8_toxicity_automata", "toxic", LARGEST)  # fewer rows have a handful of toxic ones
    assert auc > 0.94 and accuracy > 0.97


def test_toxicity_keeps_all_terms():
    rows = [(f"bad{i:04d}x{i % 7}", 0, 3 + i % 2, 0) for i in range(6000)]
    terms, _ = toxicity.choose_terms(rows, 100, 100)
    assert len(terms) == 6000


def test_toxicity_cues_are_a_parameter(spark):
    model = toxicity.Model({"wretch": 3.0}, {}, frozenset(), np.zeros(6), frozenset({"quoth"}))
    assert toxicity.Reader(model).features("quoth he wretch")[2] > 0 and toxicity.Reader(model).features("said he wretch")[2] == 0
    none = spark.createDataFrame([], "doc_id long, text string")
    assert toxicity.score(none, model).count() == 0


# decontamination


def test_short_items_match_whole_texts_only(spark):
    bench = spark.createDataFrame([(1, "yes"), (2, "add 3 kg"), (3, "?!"), (4, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "oh yes it is"), (2, "Yes!"), (3, "add 3 kg"), (4, "add 4 kg"), (5, "please add 3 kg of it"), (6, "yes yes")], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontam.matches(docs, bench).collect()) == [(2, 1), (3, 2)]
    assert sorted(r.doc_id for r in decontam.clean(docs, bench).collect()) == [1, 4, 5, 6]


def brute_contained(item, text):
    """By definition: windows of all places of both, put together by shift, judged whole."""
    own, own_slots = decontam.canonical(item)
    have, slots = decontam.canonical(text)
    named = bool(own) and decontam.first_as_name(item, own_slots)
    size = min(decontam.WINDOW, len(own))
    if not size or len(own) < decontam.LEAST_ITEM:
        return size > 0 and (own, own_slots) == (have, slots)
    for shift in range(-len(own), len(have)):
        starts = [at for at in range(len(own) - size + 1) if 0 <= at + shift <= len(have) - size]
        if starts and decontam.judge((own, own_slots, named), have, slots, shift, starts):
            return True
    return False


def test_decontamination_equals_the_definition(spark):
    rng = random.Random(13)
    vocabulary = ["farm", "road", "apples", "in", "the", "Anna", "Bob", "12", "7", "kg", "of", "buys", "sells"]
    items = ["Anna " + " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(2, 22))) for _ in range(25)]
    docs = []
    for i in range(120):
        words = rng.choice(items).split() if i % 4 else [rng.choice(vocabulary) for _ in range(30)]
        for _ in range(rng.randrange(0, 3)):
            words[rng.randrange(len(words))] = rng.choice(["Clara", "9", "mill"])
        docs.append((i, " ".join(["so", *words, "end"] if i % 3 else words)))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = {(d, k) for d, t in docs for k, item in enumerate(items) if brute_contained(item, t)}
    got = {(r.doc_id, r.item_id) for r in decontam.matches(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got == want and len(want) > 40


# byte-level BPE


def test_bpe_slices(spark, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(60)
    want = sorted(tuple(r) for r in bpe.encode_documents(docs, *bpe_files(), with_ids=True).collect())
    codec = bpe.Codec(bpe.read_ranks(bpe_files()[0]), bpe_files()[1])
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 5)
    small = bpe.Codec(bpe.read_ranks(bpe_files()[0]), bpe_files()[1])
    for doc_id, n, _, _, ids in want:
        assert ids == codec.encode(texts[doc_id]) == small.encode(texts[doc_id]) and n == len(ids)


def test_quality_keeps_what_it_scores(spark):
    docs = spark.createDataFrame([(1, "Some words here. And more.", "a"), (2, None, "b")], "doc_id long, text string, words string")
    assert sorted(r.words for r in quality.keep(docs, quality.Model(5.0, [])).collect()) == ["a", "b"]
    assert quality.keep(docs, quality.Model(-5.0, [])).count() == 0
