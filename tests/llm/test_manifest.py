"""Merkle manifest against a tree built in one piece."""

import hashlib
import random
import zlib

import pytest

from profseg.llm import manifest
from profseg.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def path(tree, at):
    out = []
    for nodes in tree[:-1]:
        run = nodes[at // 8 * 8 : at // 8 * 8 + 8]
        out.append(("".join(run[: at % 8]), "".join(run[at % 8 + 1 :])))
        at //= 8
    return out


def expected(rows):
    groups = {}
    for row in rows:
        leaf = h(*map(field, row))
        low = None if row[4] is None else "".join(c.lower() if c.isascii() else c for c in row[4])
        bad = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0
        groups.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf, h(*map(field, (*row[:4], low))) if bad else leaf, row[0]))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([x[2] for x in sorted(groups[g])]) for g in order}
    top = levels([trees[g][-1][0] for g in order])
    out = []
    for i, g in enumerate(order):
        for at, (_, _, leaf, changed, doc_id) in enumerate(sorted(groups[g])):
            whole = path(trees[g], at) + path(top, i)
            folded = changed
            for left, right in whole:
                folded = h(left, folded, right)
            out.append((doc_id, leaf, trees[g][-1][0], top[-1][0], h(*[a + b for a, b in whole]), folded, folded == top[-1][0]))
    return sorted(out, key=str)


def some_rows(n, langs, seed=3):
    rnd = random.Random(seed)
    rows = [(rnd.choice([None, rnd.randrange(n)]), rnd.choice(["web", None]), rnd.choice(langs), rnd.choice([None, i]), rnd.choice([None, "", "Ab Ä" * rnd.randrange(5), f"t{i}"])) for i in range(n)]
    return rows + rows[:5] + [(7, "s", langs[0], 1, "Same")] * 20


@pytest.mark.parametrize(("n", "langs", "span"), [(600, ["en"], 40), (300, [None, "de", "en", "", "fr", "é", "z"], 9), (150, [f"l{i:03d}" for i in range(70)], 10), (1, ["en"], 100)])
def test_proofs_are_those_of_one_tree(spark, n, langs, span):
    rows = some_rows(n, langs)
    got = manifest.document_proofs(spark.createDataFrame(rows, SCHEMA), span).collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)


def test_lone_row_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([(None, None, None, None, None, 1, "x", 2)], SCHEMA + ", part int, leaf string, `group` int")
    (row,) = manifest.document_proofs(df).collect()
    leaf = h("-----")
    assert tuple(row) == (None, leaf, leaf, leaf, h(), leaf, True)
    assert manifest.document_proofs(df.limit(0)).collect() == []


def test_stack_leaves_peaks_and_full_runs():
    leaves = [h(str(i)) for i in range(200)]
    runs, peaks = manifest.climb(leaves[3:150], 3)
    whole = levels(leaves)
    assert {(level, at) for level, at in runs} == {(0, r) for r in range(1, 18)} | {(1, 1)}
    for level, first, run in peaks:
        assert run == whole[level][first : first + len(run)] and len(run) < 8
    assert runs[1, 1] == whole[1][8:16]


def test_node_records_are_all_nodes(spark):
    rows = [(i, "s", "en" if i % 3 else "de", 1, str(i)) for i in range(500)]
    forest = manifest.grow(manifest.document_leaves(spark.createDataFrame(rows, SCHEMA)), "test", 30)
    got = {(r.group, r.level, r.at, r.digest) for r in manifest.node_records(forest).collect()}
    want = set()
    for lang in ("de", "en"):
        tree = levels([h(*map(field, r)) for r in rows if r[2] == lang])
        want |= {("=" + lang, level, at, node) for level, nodes in enumerate(tree) if level for at, node in enumerate(nodes)}
    assert got == want and manifest.node_records(forest).count() == len(want)


def test_query_equals_its_sql_and_the_tree(spark, duck, same):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = QUERIES["op11_merkle_manifest"](spark, DATA)
    assert sorted(map(tuple, got.collect()), key=str) == expected(docs)
    same(got.toPandas(), duck.sql(ORACLE_SQL["op11_merkle_manifest"]).df())
