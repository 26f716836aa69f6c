"""Language identification by words first, then by character n-grams.

Per language the log frequency of known words; a word that no language has is scored by its longest known character
n-grams, from MAX_GRAM letters down to one. Word and n-gram counts come from a sample of the labelled texts of each
language, of a documented size, in which every word and n-gram counts that occurs twice in a language; every whole text is
then scored.

Nulls, empty texts and texts without a letter are `und` with score 0; so is everything if nothing could be learned.
Ties go to the smaller language name. Rows with a null id are learned from or not as crc32('') says. Extra columns are
ignored, repeated rows give repeated results.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_written, keep_rows, pick, written

#: Texts of each language to learn from, about so many, chosen by a hash.
TRAIN_DOCS = 3_000
MAX_GRAM = 4
#: Words that a worker remembers; between texts it forgets them all once they are more, which changes no result.
CACHE_ENTRIES = 120_000
COUNTER_ENTRIES = 150_000
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams_of(word: str, n: int) -> list[str]:
    marked = f"<{word}>" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


class Table:
    """Terms with a row of centred log frequencies by language, from a table of (lang, term, n)."""

    def __init__(self, rows: pa.Table, langs: list[str]):
        at = {lang: i for i, lang in enumerate(langs)}
        columns = [at[x] for x in rows.column("lang").to_pylist()]
        self.numbers: dict[str, int] = {}
        numbers = [self.numbers.setdefault(x, len(self.numbers)) for x in rows.column("term").to_pylist()]
        counts = np.zeros((len(self.numbers), len(langs)), np.float64)
        counts[numbers, columns] = rows.column("n").to_numpy()
        logs = np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * len(counts))) if counts.size else counts
        self.logs = (logs - logs.mean(axis=1, keepdims=True) if counts.size else logs).astype(np.float32)

    def row(self, term: str) -> np.ndarray | None:
        i = self.numbers.get(term)
        return None if i is None else self.logs[i]


@dataclass
class Model:
    langs: list[str]
    words: Table
    grams: Table

    def of_word(self, word: str) -> np.ndarray | None:
        """What a word adds to the score of each language; None if it isn't made of letters."""
        if not any(c.isalpha() for c in word):
            return None
        if (found := self.words.row(word)) is not None:
            return found
        for n in range(MAX_GRAM, 0, -1):
            if known := [g for x in grams_of(word, n) if (g := self.grams.row(x)) is not None]:
                return np.mean(known, axis=0)
        return np.zeros(len(self.langs), np.float32)


def _summed(add):
    """A function over batches that adds up counts of (lang, term) in a task, and gives them out when they are many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["lang", "term", "n"])
            counts.clear()
            return out

        for batch in batches:
            for row in zip(*[batch.column(i) for i in range(batch.num_columns)], strict=True):
                add(counts, *[x.as_py() for x in row])
                if len(counts) > COUNTER_ENTRIES:
                    yield flush()
        if counts:
            yield flush()

    return run


def _add_words(counts: Counter, lang: str, text: str) -> None:
    for word in words_of(text):
        counts[lang, word] += 1


def _add_grams(counts: Counter, lang: str, word: str, n: int) -> None:
    for size in range(1, MAX_GRAM + 1):
        for gram in grams_of(word, size):
            counts[lang, gram] += n


def train(docs: DataFrame, learns: Column, train_docs: int = TRAIN_DOCS) -> Model:
    """A model from the rows of `docs` (text, lang) where `learns` is true. The sample bounds its size."""
    rows = docs.filter(learns & F.col("lang").isNotNull())
    shares = written(rows.groupBy("lang").agg((F.lit(float(train_docs)) / F.count("*")).alias("share")), "langid-shares")
    sampled = rows.filter(F.col("text").isNotNull()).join(shares, "lang")
    sampled = sampled.filter(F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1 << 30)) < F.col("share") * float(1 << 30))
    schema = "lang string, term string, n long"
    total = lambda df: df.groupBy("lang", "term").agg(F.sum("n").alias("n"))
    words = written(total(sampled.select("lang", "text").mapInArrow(_summed(_add_words), schema)), "langid-words")
    grams = total(words.mapInArrow(_summed(_add_grams), schema))
    found_words, found_grams = words.filter("n > 1").toArrow(), grams.filter("n > 1").toArrow()
    langs = sorted({*found_words.column("lang").unique().to_pylist(), *found_grams.column("lang").unique().to_pylist()})
    drop_written(words, shares)
    return Model(langs, Table(found_words, langs), Table(found_grams, langs))


class Reader:
    """Judges texts; remembers what words add."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, int] = {}
        self.rows = np.zeros((1024, max(1, len(model.langs))), np.float32)

    def _learn(self, word: str) -> int:
        found = self.model.of_word(word)
        i = -1 if found is None else len(self.known)
        if i >= len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        if i >= 0:
            self.rows[i] = found
        self.known[word] = i
        return i

    def judge(self, text: str | None) -> tuple[str, float]:
        """The language of a text, and how sure it is among the others."""
        langs = self.model.langs
        if len(self.known) >= CACHE_ENTRIES:  # only here: the numbers of a text's words hold until it ends
            self.known.clear()
            self.rows = self.rows[:1024].copy()
        get = self.known.get
        ids = [i if (i := get(w)) is not None else self._learn(w) for w in words_of(text or "")] if langs else []
        held = np.array(ids, np.int64)
        held = held[held >= 0]
        if not len(held):
            return UNKNOWN, 0.0
        total = self.rows[held].sum(axis=0, dtype=np.float64) / math.sqrt(len(held))
        best = int(total.argmax())
        return langs[best], float(1 / np.exp(total - total[best]).sum())


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Every row of `docs` (doc_id, text): doc_id, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for batch in batches:
            found = [reader.judge(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return pick(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep(docs: DataFrame, model: Model, least_score: float) -> DataFrame:
    """The rows of `docs` whose text is in a known language with at least this score, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def masks():
        reader = Reader(shared.value)

        def mask(texts: pa.Array) -> np.ndarray:
            found = [reader.judge(text.as_py()) for text in texts]
            return np.array([lang != UNKNOWN and score >= least_score for lang, score in found], bool)

        return mask

    return keep_rows(docs, ["text"], masks)


def documents_of(docs: DataFrame) -> DataFrame:
    return pick(docs, doc_id="long", text="string", lang="string")
