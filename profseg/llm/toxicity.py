"""Toxicity by a learned lexicon, matched through Levenshtein automata.

Words and word stems that labelled toxic texts hold far more often than clean ones form a lexicon, all of them: the sample
of labelled rows bounds it. Its trie
is intersected with Levenshtein automata of the terms; the intersection is determinised as words are read, so that a word
costs a table lookup a character. A misspelling counts unless clean texts use it as a word. Each hit is weighed by its
context: inside quotation marks or close behind a word of reporting it is quotation, else abuse. A logistic regression over
the hits' features, calibrated on labelled rows that the lexicon hasn't seen, gives the score.

Null and empty texts have no hits. Without labels of both kinds the score is the share of toxic labels (0 without any).
Labels repeated for a document count once, as the smaller. Extra columns are ignored; repeated rows repeat.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_written, pick, written
from .quality import sample

#: Labelled rows to learn from; letters of stems; rows of four that teach terms, not the regression.
TRAIN_ROWS = 24_000
STEM_LETTERS = range(4, 9)
TERM_FOLDS, FOLDS = 3, 4
#: A term needs so many toxic texts and at most this share of clean texts among those that hold it, at equal class sizes.
LEAST_TOXIC, MOST_CLEAN = 3, 0.02
#: Edits for terms from these lengths on.
ONE_EDIT, TWO_EDITS = 5, 9
CONTEXT, CACHE_ENTRIES = 6, 500_000
#: Words of reporting in the languages at hand, the default of a parameter of train().
CUES = frozenset("said says wrote writes quote quoted quotes called calls word words term terms named dit écrit cite mot mots appelé sagte schrieb zitat wort wörter genannt dijo escribió cita palabra palabras llamó".split())
_WORD = re.compile(r"[^\W_]+")
_PART = re.compile(r"[^\W_]+|[\"“”«»„\n]")
CLOSES = {'"': '"', "“": "”\"", "«": "»", "„": "“”\"", "»": "«"}
FEATURES = ("abuse", "misspelt", "quoted", "density", "weight")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def quotations(parts: list[str]) -> list[bool]:
    """Which parts stand between quotation marks that open and close on one line."""
    inside, opened = [False] * len(parts), {}
    for i, part in enumerate(parts):
        if part == "\n":
            opened.clear()
        elif mark := next((m for m in opened if part in CLOSES[m]), None):
            begin = opened.pop(mark)
            inside[begin:i] = [True] * (i - begin)
        elif part in CLOSES:
            opened[part] = i
    return inside


@dataclass
class Node:
    children: dict[str, int] = field(default_factory=dict)
    term: str | None = None
    stem: str | None = None
    edits: int = 0  # the most that a term below allows


def edits_for(term: str) -> int:
    return (len(term) >= ONE_EDIT) + (len(term) >= TWO_EDITS)


class Matcher:
    """The lexicon trie intersected with the Levenshtein automata of its terms, determinised on demand."""

    def __init__(self, terms: list[str], stems: list[str], clean: frozenset[str] = frozenset()):
        self.nodes, self.clean = [Node()], clean
        for text, is_stem in [*((t, False) for t in terms), *((s, True) for s in stems)]:
            at, edits = 0, edits_for(text)
            self.nodes[0].edits = max(self.nodes[0].edits, edits)
            for c in text:
                at = self.nodes[at].children.get(c) or self._grow(at, c)
                self.nodes[at].edits = max(self.nodes[at].edits, edits)
            if is_stem:
                self.nodes[at].stem = text
            else:
                self.nodes[at].term = text
        self.states: dict[tuple, int] = {}
        self.steps: list[dict[str, int]] = []
        self.accepts: list[tuple[str, int, bool] | None] = []
        self.sets: list[tuple] = []
        self.start = self._state(self._closed({0: 0}), None)

    def _grow(self, at: int, c: str) -> int:
        self.nodes.append(Node())
        self.nodes[at].children[c] = len(self.nodes) - 1
        return len(self.nodes) - 1

    def _closed(self, places: dict[int, int]) -> dict[int, int]:
        """Also the places reached by leaving out letters of the term."""
        waiting = list(places.items())
        while waiting:
            at, edits = waiting.pop()
            for child in self.nodes[at].children.values():
                if edits + 1 <= self.nodes[child].edits and edits + 1 < places.get(child, 9):
                    places[child] = edits + 1
                    waiting.append((child, edits + 1))
        return places

    def _state(self, places: dict[int, int], stem: tuple[int, str] | None) -> int:
        """stem: the fewest edits within which the letters so far, or fewer, are a stem."""
        begun = [(e, s) for n, e in places.items() if (s := self.nodes[n].stem) and e <= edits_for(s)]
        stem = min([*begun, *([stem] if stem else [])], default=None)
        key = (tuple(sorted(places.items())), stem)
        if key not in self.states:
            self.states[key] = len(self.steps)
            self.steps.append({})
            self.sets.append(key)
            ends = [(e, self.nodes[n].term) for n, e in places.items() if self.nodes[n].term and e <= edits_for(self.nodes[n].term)]
            exact = [t for e, t in ends if e == 0]
            if exact:
                self.accepts.append((exact[0], 0, False))
            elif stem and (stem[0] == 0 or not ends or stem[0] < min(ends)[0]):
                self.accepts.append((stem[1], stem[0], True))
            else:
                self.accepts.append((min(ends)[1], min(ends)[0], False) if ends else None)
        return self.states[key]

    def _step(self, state: int, c: str) -> int:
        places, stem = self.sets[state]
        after: dict[int, int] = {}

        def reach(node: int, edits: int) -> None:
            if edits <= self.nodes[node].edits and edits < after.get(node, 9) or edits == 0:
                after[node] = edits

        for at, edits in places:
            for letter, child in self.nodes[at].children.items():
                if letter == c:
                    reach(child, edits)
                else:
                    reach(child, edits + 1)
            reach(at, edits + 1)
        found = self._state(self._closed(after), stem)
        self.steps[state][c] = found
        return found

    def match(self, word: str) -> tuple[str, int, bool] | None:
        """The term or stem that a word is or misspells: its text, edits, whether it is a stem."""
        state, steps = self.start, self.steps
        for c in word:
            after = steps[state].get(c)
            state = self._step(state, c) if after is None else after
        found = self.accepts[state]
        return None if found and found[1] and word in self.clean else found


@dataclass
class Model:
    terms: dict[str, float]
    stems: dict[str, float]
    clean: frozenset[str]
    weights: np.ndarray  # the intercept, then FEATURES
    cues: frozenset[str] = CUES

    def matcher(self) -> Matcher:
        return Matcher(sorted(self.terms), sorted(self.stems), self.clean)

    def probability(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + features @ self.weights[1:], -40, 40)))


class Reader:
    """Features of texts; remembers what words match."""

    def __init__(self, model: Model):
        self.model, self.matcher = model, model.matcher()
        self.known: dict[str, tuple[str, int, bool] | None] = {}

    def hit(self, word: str) -> tuple[str, int, bool] | None:
        if word in self.known:
            return self.known[word]
        if len(self.known) >= CACHE_ENTRIES:
            self.known.clear()
        if len(self.matcher.steps) > 200_000:
            self.matcher = self.model.matcher()
        found = self.known[word] = self.matcher.match(word)
        return found

    def features(self, text: str) -> list[float]:
        words = words_of(text)
        hit = self.hit
        if not any([hit(w) for w in words]):
            return [0.0] * len(FEATURES)
        abuse = misspelt = quoted = 0
        weight = 0.0
        since_cue, parts = CONTEXT, _PART.findall(text.lower())
        for part, inside in zip(parts, quotations(parts), strict=True):
            if not part[0].isalnum():
                continue
            found = hit(part)
            if found:
                if inside or since_cue < CONTEXT:
                    quoted += 1
                else:
                    abuse += found[1] == 0
                    misspelt += found[1] > 0
                    weight = max(weight, (self.model.stems if found[2] else self.model.terms)[found[0]] / (1 + found[1]))
            since_cue = 0 if part in self.model.cues else since_cue + 1
        return [math.log1p(abuse), math.log1p(misspelt), math.log1p(quoted), math.log1p(100 * (abuse + misspelt) / len(words)), weight]


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, y) to texts that hold a word (stem 0) or a stem (1), by label."""
    counts: Counter = Counter()

    def flush() -> pa.RecordBatch:
        rows = list(counts.items())
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.int32()), pa.array([v if k[2] else 0 for k, v in rows], pa.int64()), pa.array([0 if k[2] else v for k, v in rows], pa.int64())], ["term", "stem", "toxic", "clean"])

    for batch in batches:
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = set(words_of(text or ""))
            counts.update((w, 0, y) for w in words)
            counts.update((s, 1, y) for s in {w[:n] for w in words for n in STEM_LETTERS if len(w) >= n})
            if len(counts) > 300_000:
                yield flush()
    if counts:
        yield flush()


def choose_terms(rows: list[tuple[str, int, int, int]], n_toxic: int, n_clean: int) -> tuple[dict[str, float], dict[str, float]]:
    """Terms and stems with their log odds from (term, stem, toxic, clean) counts. A stem stands for its longer stems; one
    that covers a single word is left to that word. The words of a stem stay terms, so that their misspellings match."""
    odds = {(t, s): math.log(((x + 0.1) / (n_toxic + 1)) / ((c + 0.1) / (n_clean + 1))) for t, s, x, c in rows}
    toxic = {(t, s): x for t, s, x, _ in rows}
    longest: dict[str, int] = {}  # the most toxic texts that one word under a stem has
    for (word, is_stem), x in toxic.items():
        for n in STEM_LETTERS if not is_stem else ():
            longest[word[:n]] = max(longest.get(word[:n], 0), x)
    stems: dict[str, float] = {}
    for term, _ in sorted((k for k in odds if k[1]), key=lambda k: (len(k[0]), k[0])):
        if any(term[:n] in stems for n in range(1, len(term))):
            continue
        if toxic[term, 1] > 1.2 * longest.get(term, 0):
            stems[term] = odds[term, 1]
    terms = {t: o for (t, s), o in odds.items() if not s}
    return terms, stems


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps with a small ridge; a hit never speaks against toxicity."""
    design = np.hstack([np.ones((len(y), 1)), x])
    free = list(range(design.shape[1]))
    while True:
        w = np.zeros(len(free))
        z = design[:, free]
        ridge = np.diag([1e-6, *[0.05] * (len(free) - 1)])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z.T * (p * (1 - p) + 1e-9)) @ z + ridge, z.T @ (y - p) - ridge @ w)
            w += step * min(1.0, 4 / (1e-9 + np.abs(step).max()))
            if np.abs(step).max() < 1e-8:
                break
        against = [f for f, v in zip(free, w, strict=True) if f and v < 0]
        if not against:
            out = np.zeros(design.shape[1])
            out[free] = w
            return out
        free = [f for f in free if f not in against]


def train(docs: DataFrame, labels: DataFrame, learns: Column, train_rows: int = TRAIN_ROWS, cues: frozenset[str] = CUES) -> Model:
    """A model from labelled documents (doc_id, text) where `learns` (of the labels) is true."""
    spark = docs.sparkSession
    labelled = sample(docs, labels, "toxic", learns, train_rows)
    fold = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS))
    teaching = labelled.filter(fold < TERM_FOLDS)
    sizes = {r.y: r.n for r in teaching.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        share = n_toxic / max(1, n_toxic + n_clean)
        return Model({}, {}, frozenset(), np.array([math.log(max(share, 1e-12) / max(1 - share, 1e-12)), *[0.0] * len(FEATURES)]), cues)
    counts = teaching.select("text", "y").mapInArrow(_term_counts, "term string, stem int, toxic long, clean long").groupBy("term", "stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    # clean stems serve no purpose, clean words tell which misspellings are words
    counts = written(counts.filter((F.col("stem") == 0) | (F.col("toxic") >= LEAST_TOXIC)), "toxicity-counts")
    rate = F.col("toxic") / n_toxic
    pure = (F.col("toxic") >= LEAST_TOXIC) & (F.col("clean") / n_clean <= MOST_CLEAN * (rate + F.col("clean") / n_clean))
    chosen = counts.filter(pure).collect()
    terms, stems = choose_terms([(r.term, r.stem, r.toxic, r.clean) for r in chosen], n_toxic, n_clean)
    model = Model(terms, stems, frozenset(), np.zeros(1 + len(FEATURES)), cues)
    shared = spark.sparkContext.broadcast(model)

    def misspellings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = shared.value.matcher()
        for batch in batches:
            words = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([w for w in words if (m := matcher.match(w)) and m[1]], pa.string())], ["term"])

    # clean words within the edits of a term, of the sample's words
    clean = counts.filter("stem = 0 and clean > 0").select("term").mapInArrow(misspellings, "term string").collect()
    model.clean = frozenset(r.term for r in clean)
    drop_written(counts)
    rows = features(labelled.filter(fold >= TERM_FOLDS).select("doc_id", "y", "text"), model).groupBy("doc_id").agg(F.min(F.struct("features", "y")).alias("row")).select("doc_id", "row.*").collect()
    rows.sort(key=lambda r: r.doc_id)
    # priors: no hits is clean, one hit of a strong term is toxic; they matter only if the calibration rows are few
    strong = max([*terms.values(), *stems.values()], default=0.0)
    x = np.array([r.features for r in rows] + [[0.0] * 5, [math.log(2), 0, 0, math.log1p(0.5), strong]], float)
    model.weights = _fit(x, np.array([r.y for r in rows] + [0, 1], float))
    return model


def features(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of `docs` but its text, with the features of the text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for batch in batches:
            found = [reader.features(t.as_py() or "") for t in batch.column(batch.schema.get_field_index("text"))]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in keep], pa.array(found, pa.list_(pa.float64()))], [*keep, "features"])

    kinds = dict(docs.dtypes)
    return docs.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", features array<double>")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Every row of `docs` without its text, with score (0 to 1) and predicted (0 or 1)."""
    logit = F.lit(float(model.weights[0]))
    for i, w in enumerate(model.weights[1:]):
        logit = logit + F.get("features", F.lit(i)) * float(w)
    scored = features(docs, model).withColumn("score", F.lit(1.0) / (F.lit(1.0) + F.exp(-logit)))
    return scored.drop("features").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
