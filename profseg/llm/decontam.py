"""Benchmark decontamination by template canonicalisation.

A text becomes a sequence of template tokens: numbers, units behind a number and names (capitalised words inside a
sentence) turn into typed placeholders whose values are slots; all else is a lower-case word. The hashes of windows of WINDOW
template tokens of documents are joined with those of the benchmark's items; windows that agree on one alignment with an item
are put together, and the slots they cover must change consistently (one value for each value of the item). A document that
covers enough of an item that way contains it, with its own numbers, names and units or with others.

A filter, sized by the number of the benchmark's windows, tells in the first pass which windows of a document may be there;
only these, and the texts that have one, go on to the joins, so that a benchmark of any size takes one pass. Items shorter
than a window have one window, their whole.

Windows of fewer than LEAST_WORDS words say little: with other values they count only where the whole item is there, its
placeholders of the same kinds in the same order; with fewer than FEW_WORDS they match with the same values only (any row of
numbers would do otherwise). Items of fewer than LEAST_ITEM tokens would be found in any text: they match only texts that
consist of just them, with the same values. With most_items=0 all windows count, as in the registered queries: a passage that
many items quote is found with all of them. Otherwise a window that more than `most_items` items hold (an instruction that all
begin with) says nothing about any of them: an item is looked for by its other windows and judged by the tokens under these; one
that has no others by those that the fewest items hold.

Where slots conflict, the alignment is no occurrence as a whole; with `split` each stretch between conflicts is judged.

Null and empty texts contain nothing and are contained in nothing; items without tokens match nothing; repeated rows give
repeated results, repeated items one; extra columns are ignored by matches() and kept by clean().
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW_ID, Filter, broadcast_filter, drop_written, own_columns, parted, pick, row_id, written

WINDOW = 8
#: A document contains an item of which it covers this share, or so many tokens in a row.
COVERAGE, RUN = 0.5, 13
#: Windows with fewer words that aren't placeholders match only with the same values in their slots; items with fewer tokens
#: match only whole texts.
LEAST_WORDS, FEW_WORDS, LEAST_ITEM = 4, 2, 5
#: Items that may hold a window for it to count, unless all windows do.
MOST_ITEMS = 20
#: Items (the logarithm of their number) with which a document's text goes to the judge at once; it changes no result.
ITEM_BITS = 8
CACHE_ENTRIES = 100_000
NUMBER, UNIT, NAME = "<number>", "<unit>", "<name>"
UNITS = frozenset("% $ € £ mm cm m km in ft yd mi mg g kg t lb oz ml cl l gal s sec min h hr hrs hour hours minute minutes second seconds day days week weeks month months year years usd eur gbp dollar dollars euro euros cent cents meter meters metre metres kilometer kilometers kilometre kilometres gram grams kilogram kilograms liter liters litre litres mile miles foot feet inch inches pound pounds percent mph kmh kb mb gb tb hz khz mhz ghz w kw v a".split())
_TOKENS = re.compile(r"\d+(?:[.,]\d+)*|[%$€£]|[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?\n:;\"“”|]")
#: What a token may be: a stop, a number, a unit's sign, a word; a word's own bits: capitalised, a unit behind a number.
STOP, NUM, SIGN, WORD, CAPITAL, MEASURE = 1, 2, 4, 8, 16, 32


def kind_of(value: str) -> tuple[int, str]:
    """What a token may be, and its lower-case form (of a number: without commas)."""
    lower = value.lower()
    if value[0].isdigit():
        return NUM, value.replace(",", "")
    if value in "%$€£":
        return SIGN, lower
    if value[0].isalpha():
        return WORD | CAPITAL * (value[0].isupper() and not value.isupper()) | MEASURE * (lower in UNITS), lower
    return STOP, lower


def canonical(text: str) -> tuple[list[str], list[str | None]]:
    """Template tokens and, for placeholders, the values that they stand for."""
    tokens: list[str] = []
    slots: list[str | None] = []
    begins, after_number = True, False
    for value in _TOKENS.findall(text):
        kind, lower = kind_of(value)
        if kind == WORD:
            tokens.append(lower)
            slots.append(None)
            begins = after_number = False
            continue
        if kind == STOP:
            begins, after_number = True, False
            continue
        if kind == NUM:
            token = NUMBER
        elif kind == SIGN or after_number and kind & MEASURE:
            token = UNIT
        elif not begins and kind & CAPITAL:
            token = NAME
        else:
            token = None
        tokens.append(token or lower)
        slots.append(lower if token else None)
        begins, after_number = False, kind == NUM
    return tokens, slots


def hash_of(token: str) -> int:
    return xxhash.xxh3_64_intdigest(token)


def window_hashes(tokens: np.ndarray, size: int, kind: int) -> np.ndarray:
    """A hash of each window of `size` token hashes."""
    out = np.full(max(0, len(tokens) - size + 1), 4 * size + kind, np.uint64)
    for i in range(size if len(out) else 0):
        out = (out ^ out >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) + tokens[i : i + len(out)]
    return ((out ^ out >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


#: Windows by their templates, with the values of their slots, and whole texts with them.
TEMPLATE, VALUED, WHOLE = 0, 1, 2


_NUMBER, _UNIT, _NAME = (np.uint64(hash_of(x)) for x in (NUMBER, UNIT, NAME))


class Reader(dict):
    """Reads windows of texts: what canonical() says, for all tokens of a text at once. Remembers tokens by number."""

    def __init__(self):
        super().__init__()
        self.kinds, self.hashes, self.lowers = np.zeros(1024, np.uint8), np.zeros(1024, np.uint64), []

    def __missing__(self, value: str) -> int:
        i = self[value] = len(self.lowers)
        if i == len(self.kinds):
            self.kinds, self.hashes = np.concatenate([self.kinds] * 2), np.concatenate([self.hashes] * 2)
        self.kinds[i], lower = kind_of(value)
        self.hashes[i] = hash_of(lower)
        self.lowers.append(lower)
        return i

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of a text's template tokens, which of them are placeholders, and the numbers of the tokens that they stand
        for."""
        return self._read([_TOKENS.findall(text)])[:3]

    def _read(self, found: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """tokens() of texts one behind the other, and how many each has."""
        sizes = np.array([len(values) for values in found], np.int64)
        ids = np.fromiter(map(self.__getitem__, chain.from_iterable(found)), np.int64, int(sizes.sum()))
        kinds = self.kinds[ids]
        before = np.concatenate([np.full(1, STOP, np.uint8), kinds])[:-1]
        first = np.cumsum(sizes) - sizes
        before[first[sizes > 0]] = STOP
        number = kinds == NUM
        unit = (kinds == SIGN) | (before == NUM) & (kinds & MEASURE > 0)
        name = (before != STOP) & (kinds & CAPITAL > 0) & ~unit
        hashes = np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(name, _NAME, self.hashes[ids])))
        kept = kinds != STOP
        counts = np.concatenate([[0], np.cumsum(kept)])
        return hashes[kept], (number | unit | name)[kept], ids[kept], counts[first + sizes] - counts[first]

    def windows(self, plain: np.ndarray, slot: np.ndarray, ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of windows and their places: of their templates, where they have FEW_WORDS, and with the values of their slots where
        they have few words."""
        words = np.concatenate([[0], np.cumsum(~slot)])
        count = words[size:] - words[:-size]
        templates = np.flatnonzero(count >= min(FEW_WORDS, size))
        at = np.flatnonzero(count < min(LEAST_WORDS, size))
        hashes = window_hashes(plain, size, TEMPLATE)[templates]
        if not len(at):
            return hashes, templates
        under = np.unique((at[:, None] + np.arange(size)).ravel())
        return np.concatenate([hashes, window_hashes(self.valued(plain, slot, ids, under), size, VALUED)[at]]), np.concatenate([templates, at])

    def valued(self, plain: np.ndarray, slot: np.ndarray, ids: np.ndarray, places: np.ndarray | None = None) -> np.ndarray:
        """The hashes of tokens with the values of placeholders (only at these places)."""
        out, kinds = plain.copy(), {int(_NUMBER): NUMBER, int(_UNIT): UNIT, int(_NAME): NAME}
        for i in (np.flatnonzero(slot) if places is None else places[slot[places]]).tolist():
            out[i] = hash_of(kinds[int(plain[i])] + self.lowers[ids[i]])
        return out

    def of_item(self, text: str) -> tuple[int, list[tuple[int, int]]]:
        """The number of an item's tokens, and (hash, place) of its windows."""
        plain, slot, ids = self.tokens(text)
        size = min(WINDOW, len(plain))
        if not size:
            return 0, []
        if len(plain) < LEAST_ITEM:
            return size, [(int(window_hashes(self.valued(plain, slot, ids), size, WHOLE)[0]), 0)]
        out = list(zip(*[x.tolist() for x in self.windows(plain, slot, ids, size)], strict=True))
        if not slot[0] and self.kinds[ids[0]] & CAPITAL:  # inside a sentence the first word is read as a name
            named, slots = plain[:size].copy(), slot[:size].copy()
            named[0], slots[0] = _NAME, True
            out += [(h, 0) for h in self.windows(named, slots, ids[:size], size)[0].tolist()]
        return len(plain), out

    def of_texts(self, texts: list[str], sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows of texts that could be an item's, of these sizes: the text's place in the list, hash, place in the text. All
        texts are read as one row of tokens."""
        if len(self.lowers) >= CACHE_ENTRIES:
            self.clear()
            self.__init__()
        found = [_TOKENS.findall(t) for t in texts]
        plain, slot, ids, sizes_of = self._read(found)
        text = np.repeat(np.arange(len(texts)), sizes_of)
        first = np.cumsum(sizes_of) - sizes_of
        parts = []
        for size in sizes:
            n = len(plain) - size + 1
            if n <= 0:
                continue
            if size >= LEAST_ITEM:
                hashes, at = self.windows(plain, slot, ids, size)
                inside = (text[size - 1 :] == text[:n])[at]  # within one text
                hashes, at = hashes[inside], at[inside]
            else:
                at = first[sizes_of == size]  # whole texts
                hashes = window_hashes(self.valued(plain, slot, ids, np.repeat(at, size) + np.tile(np.arange(size), len(at))), size, WHOLE)[at]
            parts.append((text[at], hashes, at - first[text[at]]))
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def first_as_name(text: str, slots: list[str | None]) -> bool:
    """Whether the first word of an item is one that inside a sentence is read as a name."""
    first = next((kind for kind, _ in map(kind_of, _TOKENS.findall(text)) if kind != STOP), 0)
    return bool(first & CAPITAL) and slots[0] is None


def _stretches(own: list[str], own_slots: list[str | None], slots: list[str | None], shift: int, places: list[int], split: bool) -> list[tuple[list[int], bool, int]]:
    """Covered places in stretches whose slots change consistently, each with whether all are the same, and their number. Without
    `split` there is one or none."""
    out: list[tuple[list[int], bool, int]] = []
    there: dict[tuple[str, str], str] = {}
    begin, n_slots, same = 0, 0, True
    for i, at in enumerate(places):
        kind, value, other = own[at], own_slots[at], slots[at + shift]
        if value is None and other is not None:  # the item's first word, read as a name
            kind, value = NAME, kind
        if value is None:
            continue
        if there.setdefault((kind, value), other) != other:
            if not split:
                return []
            out.append((places[begin:i], same, n_slots))
            there, begin, n_slots, same = {(kind, value): other}, i, 0, True
        n_slots += 1
        same &= value == other
    return [*out, (places[begin:], same, n_slots)]


def judge(item: tuple[list[str], list[str | None], bool], tokens: list[str], slots: list[str | None], shift: int, starts: list[int], counted: int | None = None, split: bool = False) -> tuple[int, float, bool, int] | None:
    """Whether the windows at `starts` of an item (tokens, slots, first_as_name), `shift` tokens further on in a text, are an
    occurrence of it: tokens covered, share covered of those that count (all), same slots, slots covered."""
    own, own_slots, named = item
    size = min(WINDOW, len(own))
    covered: set[int] = set()
    vague: set[int] = set()
    for at in starts:
        begin = at + shift
        skip = at == 0 and named and tokens[begin] == NAME
        want = own_slots[at : at + size] if not skip else [own[0], *own_slots[1:size]]
        have = slots[begin : begin + size]
        if tokens[begin + skip : begin + size] != own[at + skip : at + size]:
            continue
        words = sum(s is None for s in have)
        if have == want or words >= min(LEAST_WORDS, size) and len(own) >= LEAST_ITEM:
            covered.update(range(at, at + size))
        elif words >= min(FEW_WORDS, size) and len(own) >= LEAST_ITEM:
            vague.update(range(at, at + size))
    if vague and len(covered | vague) == len(own):
        covered |= vague
    whole = counted or len(own)
    best = None
    for places, same, n_slots in _stretches(own, own_slots, slots, shift, sorted(covered), split):
        run = longest = 0
        for i, at in enumerate(places):
            run = run + 1 if i and places[i - 1] == at - 1 else 1
            longest = max(longest, run)
        if places and (len(places) / whole >= COVERAGE or longest >= RUN):
            best = max(best or (0,), (len(places), len(places) / whole, same, n_slots))
    return best


def _under(starts: Column) -> Column:
    """The tokens under windows of the item's size, each once."""
    size = F.least("n", F.lit(WINDOW))
    gaps = F.transform(starts, lambda x, i: F.when(i == 0, size).otherwise(F.least(size, x - F.get(starts, i - 1))))
    return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)


def _indexed(benchmark: DataFrame, most_items: int) -> tuple[DataFrame, DataFrame]:
    """The items of a benchmark (item, a number, item_id, text, n, counted: the tokens under the windows that count) and these windows
    (h, item, at), as written tables."""
    rows = pick(benchmark, item_id="long", text="string").filter(F.coalesce(F.length("text"), F.lit(0)) > 0).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            found = [reader.of_item(text.as_py()) for text in batch.column(1)]
            lists = [pa.array([[w[i] for w in windows] for _, windows in found], pa.list_(kind)) for i, kind in enumerate((pa.int64(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([n for n, _ in found], pa.int32()), *lists], ["item_id", "text", "n", "hashes", "places"])

    items = written(rows.mapInArrow(run, "item_id long, text string, n int, hashes array<long>, places array<int>").filter("n > 0").withColumn("item", F.monotonically_increasing_id()), "decontam-items")
    windows = items.select("item", F.explode(F.arrays_zip("hashes", "places")).alias("w")).select(F.col("w.hashes").alias("h"), "item", F.col("w.places").alias("at"))
    if not most_items:
        return items.drop("hashes", "places").withColumn("counted", F.col("n")), written(windows, "decontam-windows")
    every = written(windows, "decontam-every")
    held_by = every.groupBy("h").agg(F.count_distinct("item").alias("items"))
    known = written(every.join(held_by, "h"), "decontam-known")
    least = known.groupBy("item").agg(F.greatest(F.min("items"), F.lit(most_items)).alias("bound"))
    kept = written(known.join(least, "item").filter("items <= bound").select("h", "item", "at"), "decontam-windows")
    drop_written(every, known)
    starts = kept.groupBy("item").agg(F.array_sort(F.collect_set("at")).alias("starts"))
    counted = items.drop("hashes", "places").join(starts, "item")
    return written(counted.withColumn("counted", _under(F.col("starts"))).drop("starts"), "decontam-counted"), kept


def _found(docs: DataFrame, benchmark: DataFrame, filter_bits: int, split: bool, most_items: int) -> DataFrame:
    """A row for each item that a row of `docs` (doc_id, text, ROW_ID) contains: ROW_ID, uid (of the row), doc_id, item,
    item_id, n_tokens, coverage, exact, n_slots."""
    items, windows = _indexed(benchmark, most_items)
    sizes = sorted(min(WINDOW, r.n) for r in items.select(F.least("n", F.lit(WINDOW)).alias("n")).distinct().collect())
    shared = broadcast_filter(windows.select(F.col("h").alias("key")), filter_bits)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, passes = Reader(), shared.value.passes
        for batch in batches:
            for slice_ in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                text, found, at = reader.of_texts([t.as_py() or "" for t in slice_.column(1)], sizes)
                there = np.flatnonzero(passes(found))
                there = there[np.argsort(text[there], kind="stable")]
                rows, begins = np.unique(text[there], return_index=True)
                ends = pa.array(np.append(begins, len(there)), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (found[there], at[there].astype(np.int32))]
                part = slice_.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns, *lists], [*batch.schema.names, "hashes", "places"])

    kinds = f"doc_id long, text string, {ROW_ID[0]} long, {ROW_ID[1]} long"
    held = written(docs.select("doc_id", "text", *ROW_ID).mapInArrow(hits, kinds + ", hashes array<long>, places array<int>").withColumn("uid", F.monotonically_increasing_id()), "decontam-hits")
    there = held.select("uid", F.explode(F.arrays_zip("hashes", "places")).alias("w")).select("uid", F.col("w.hashes").alias("h"), F.col("w.places").alias("begin"))
    aligned = there.join(windows, "h").groupBy("uid", "item", (F.col("begin") - F.col("at")).alias("shift")).agg(F.array_sort(F.collect_set("at")).alias("starts"))
    under = _under(F.col("starts"))
    enough = aligned.join(items, "item").filter((under >= F.lit(COVERAGE) * F.col("counted")) | (under >= RUN))
    # the text of a document once for each block of items, so that a row stays small whatever the number of its alignments
    asked = enough.groupBy("uid", F.shiftright("item", ITEM_BITS).alias("block")).agg(F.collect_list(F.struct("item", "item_id", F.col("text").alias("own"), "counted", "shift", "starts")).alias("asked"))
    asked = asked.join(held.select("uid", "doc_id", *ROW_ID, "text"), "uid").select("uid", *ROW_ID, "doc_id", "text", "asked")
    keys = ["uid", *ROW_ID, "doc_id"]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[str, tuple] = {}
        for batch in batches:
            rows, out = [], []
            for i in range(batch.num_rows):
                tokens, slots = canonical(batch.column(4)[i].as_py())
                for x in batch.column(5)[i].as_py():
                    if x["own"] not in own:
                        if len(own) >= 1024:
                            own.clear()
                        words, values = canonical(x["own"])
                        own[x["own"]] = (words, values, bool(words) and first_as_name(x["own"], values))
                    if result := judge(own[x["own"]], tokens, slots, x["shift"], x["starts"], x["counted"], split):
                        rows.append(i)
                        out.append((x["item"], x["item_id"], x["shift"], *result))
            kept = batch.select(keys).take(pa.array(rows, pa.int64()))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.bool_(), pa.int64())
            more = [pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*kept.columns, *more], [*keys, "item", "item_id", "shift", "n_tokens", "coverage", "exact", "n_slots"])

    schema = f"uid long, {ROW_ID[0]} long, {ROW_ID[1]} long, doc_id long, item long, item_id long, shift int, n_tokens long, coverage double, exact boolean, n_slots long"
    found = asked.mapInArrow(judged, schema)
    best = F.max(F.struct("n_tokens", "coverage", -F.col("shift"), "exact", "n_slots")).alias("best")
    return found.groupBy("uid", *ROW_ID, "doc_id", "item", "item_id").agg(best).select("uid", *ROW_ID, "doc_id", "item", "item_id", "best.n_tokens", "best.coverage", "best.exact", "best.n_slots")


def matches(docs: DataFrame, benchmark: DataFrame, filter_bits: int = Filter.MOST_BITS, split: bool = False, most_items: int = MOST_ITEMS) -> DataFrame:
    """A row for each item that a document contains: doc_id, item_id, n_tokens covered, coverage, exact (all slots the
    same), n_slots covered. The filter of windows has at most `filter_bits`; fewer only let more rows on to the joins. With `split`
    a long enough stretch between conflicting slots counts."""
    rows = pick(docs, doc_id="long", text="string").select("doc_id", "text", *row_id())
    return _found(rows, benchmark, filter_bits, split, most_items).select("doc_id", "item_id", "n_tokens", "coverage", "exact", "n_slots")


def clean(docs: DataFrame, benchmark: DataFrame, filter_bits: int = Filter.MOST_BITS, split: bool = False, most_items: int = MOST_ITEMS) -> DataFrame:
    """The rows of `docs` that contain no item, with all their columns, whatever their names."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *row_id())
    bad = written(_found(rows, benchmark, filter_bits, split, most_items).select(*ROW_ID).distinct(), "decontam-bad")
    kept, maybe = parted(docs, bad)
    return kept.unionByName(maybe.join(bad, list(ROW_ID), "left_anti").select(*own_columns(docs)))
