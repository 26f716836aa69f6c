"""Spelling variants: words one edit apart, found by an even-partition pigeonhole join.

An indexed word is cut into two segments by its length. One edit spares one of the two, so a near word of equal length has it
at the same place, and one that is longer by one has it there or shifted by one. A key is thus a word with a hole: the hole
holds the edit and all around it is matched. Words that share a key are candidates, verified as one edit and deduplicated.
Where more than GROUP words share a key, its hole is cut in two in turn, as the edit lies in one half, down to holes of one
letter, which few words can share: their number is bounded by the alphabet. So no key makes many pairs that are none.

A word's form is its most frequent near word, if that is at least RATIO times as frequent; its root is where forms lead.
Null texts hold no words, a null id counts as empty text in the damage, repeated rows count as often as they stand, extra
columns are ignored, an empty table gives no words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, pick, written
from .manifest import CRC_TABLE_SQL, LOWER, UPPER, crc32_sql

RUN = re.compile("[a-zÀ-ÿ]+")
#: One in so many of a document's words is damaged; words have so many letters and occurrences at least.
DAMAGED, LEAST_LETTERS, LEAST_COUNT, RATIO = 97, 5, 3, 2
#: Words that may share a key before it is refined.
GROUP = 32
#: Distinct words that a counting task holds.
COUNTED = 300_000


def damaged(doc_id: int | None, run: str) -> str:
    """A run as the document has it after the damage: one letter less if the checksum of both says so."""
    check = zlib.crc32(run.encode(), zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode()))
    if check % DAMAGED:
        return run
    at = check % len(run)
    return run[:at] + run[at + 1 :]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter[str] = Counter()

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"])
        found.clear()
        return batch

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            whole = (text.as_py() or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # of bytes, only A-Z are lowered
            base = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
            for run, n in Counter(RUN.findall(whole)).items():
                if len(run) < LEAST_LETTERS:
                    continue
                if zlib.crc32(run.encode(), base) % DAMAGED == 0:
                    run = damaged(doc_id, run)  # noqa: PLW2901
                    if len(run) < LEAST_LETTERS:
                        continue
                found[run] += n
            if len(found) > COUNTED:
                yield flush()
    if found:
        yield flush()


def words_of(docs: DataFrame) -> DataFrame:
    """(word, n) of all words of the texts, damaged ones as they are then, written. Counts add up in the tasks first."""
    counted = pick(docs, doc_id="long", text="string").mapInArrow(_count, "word string, n long")
    return written(counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT), "variants-words")


def _holes(words: DataFrame) -> DataFrame:
    """The two segments of a word as an indexed one (role 0) and as one that is longer by one than those it meets (role 1)."""
    places = []
    for role in (0, 1):
        length = F.length("word") - role
        middle = F.floor(length / 2).cast("int")
        places += [F.struct(F.lit(role).alias("role"), a.cast("int").alias("a"), b.alias("b")) for a, b in ((F.lit(0), middle), (middle, length))]
    rows = words.select("word", "n", F.explode(F.array(*places)).alias("p")).select("word", "n", "p.*")
    return rows.filter(F.length("word") - F.col("role") >= LEAST_LETTERS)


def _keyed(rows: DataFrame) -> DataFrame:
    """Each hole's key: its place and what stands around it. Equal hashes of other words are told apart by the verification."""
    around = F.substring("word", F.lit(1), F.col("a")), F.substring("word", F.col("b") + F.col("role") + 1, F.length("word"))
    return rows.withColumn("key", F.xxhash64(F.length("word") - F.col("role"), "a", "b", *around))


def _sized(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keys that few words share, and those to refine."""
    sizes = keyed.groupBy("key").agg(F.count("*").alias("all"), F.count_if(F.col("role") == 0).alias("own"), F.max(F.col("b") - F.col("a")).alias("width"))
    sizes = sizes.filter("`all` > 1 and own > 0")
    large = (F.col("all") > GROUP) & (F.col("width") > 1)
    return keyed.join(sizes.filter(~large).select("key"), "key"), keyed.join(sizes.filter(large).select("key"), "key")


def _halves(rows: DataFrame) -> DataFrame:
    middle = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
    cut = F.array(F.struct(F.col("a").alias("a"), middle.alias("b")), F.struct(middle.alias("a"), F.col("b").alias("b")))
    return rows.select("word", "n", "role", F.explode(cut).alias("p")).select("word", "n", "role", "p.a", "p.b")


def _verified(rows: DataFrame) -> DataFrame:
    """Pairs that share a key and are one edit apart, the shorter or smaller word first."""
    own = rows.filter("role = 0").select("key", F.col("word").alias("x"), F.col("n").alias("x_n"))
    other = rows.select("key", "role", F.col("word").alias("y"), F.col("n").alias("y_n"))
    first = (F.col("role") == 1) | (F.col("x") < F.col("y"))
    return own.join(other, "key").filter(first & (F.levenshtein("x", "y", 1) == 1)).select("x", "x_n", "y", "y_n")


def near_pairs(words: DataFrame) -> list[DataFrame]:
    """Tables of all pairs (x, x_n, y, y_n) of words one edit apart; a pair of unlike length may stand in more than once."""
    found, rows, kept = [], _holes(words), None
    while True:
        few, many = _sized(_keyed(rows))
        found.append(written(_verified(few), "variants-pairs"))
        rows = written(_halves(many), "variants-holes")
        if kept:
            drop_written(kept)
        kept = rows
        if rows.isEmpty():
            return found


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words that have a form. Pointers double their reach in each turn; a form is RATIO times as frequent as
    its word, so that chains are no longer than the logarithm of the largest count."""
    links = written(forms.select("word", F.col("form").alias("root")), "variants-roots")
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        moved = written(links.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")), "variants-roots")
        drop_written(links)
        if moved.filter("moved").isEmpty():
            return moved.select("word", "root")
        links = moved.select("word", "root")


def variants(words: DataFrame) -> DataFrame:
    """(word, n) to word, n, n_near, form, form_n and root. Words must be distinct."""
    pairs = near_pairs(words)
    both = [p.select(F.col(a).alias("word"), F.col(b).alias("other"), F.col(f"{b}_n").alias("other_n")) for p in pairs for a, b in (("x", "y"), ("y", "x"))]
    every = both[0]
    for p in both[1:]:
        every = every.unionByName(p)
    near = every.repartition("word").distinct().groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best"))
    best = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))
    leads = F.col("form_n") >= F.col("n") * RATIO
    formed = written(best.select("word", "n", "n_near", F.when(leads, F.col("form")).alias("form"), F.when(leads, F.col("form_n")).alias("form_n")), "variants-formed")
    drop_written(*pairs)
    roots = _roots(formed.filter("form is not null"))
    return formed.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def document_variants(docs: DataFrame) -> DataFrame:
    return variants(words_of(docs))


#: Near words by their forms with one letter left out.
VARIANTS_SQL = f"""
with recursive runs as (
  select coalesce(doc_id::varchar, '') as id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) as run from documents
), own as (select id, run, count(*) as n, hex(id || ':' || run) as h from runs where length(run) >= 5 group by all),
crc_table as (select {CRC_TABLE_SQL} as crc_of),
checked as (select run, n, {crc32_sql("h", "crc_of")} as crc from own, crc_table),
words as materialized (
  select case when crc % 97 = 0 then substr(run, 1, (crc % length(run))::int) || substr(run, (crc % length(run))::int + 2) else run end as word, sum(n)::bigint as n
  from checked group by 1 having sum(n) >= 3 and length(word) >= 5
), less as materialized (select word, n, i, substr(word, 1, i) || substr(word, i + 2) as rest from words, lateral (select unnest(range(length(word)))::int as i)),
near as (
  select a.word, b.word as other, b.n as other_n from less a join less b on a.i = b.i and a.rest = b.rest and a.word <> b.word
  union select l.word, w.word, w.n from less l join words w on l.rest = w.word
  union select w.word, l.word, l.n from less l join words w on l.rest = w.word
), best as (
  select word, count(*) as n_near, first(other order by other_n desc, encode(other)) as form, max(other_n) as form_n from near group by word
), formed as materialized (
  select word, n, coalesce(n_near, 0)::bigint as n_near, case when form_n >= 2 * n then form end as form, case when form_n >= 2 * n then form_n end::bigint as form_n
  from words left join best using (word)
), walk as (
  select word, word as root, form as onward from formed
  union all select walk.word, formed.word, formed.form from walk join formed on formed.word = walk.onward
)
select formed.word, n, n_near, formed.form, form_n, walk.root from formed join walk on walk.word = formed.word and walk.onward is null"""
