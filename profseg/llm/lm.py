"""Language-model scores by a probabilistic suffix tree over words.

Symbols are the words of the training corpus, the end of a text, and one symbol for all words that it lacks; the event space is
that of the add-one unigram model (the base) that stands beside it. A context is up to DEPTH symbols before the next, the
end standing before a text's first. A symbol that follows a context LEAST times is told apart there, whatever the corpus's
size; a context is retained when the divergence of its next-symbol distribution from that of its suffix gains more than it
costs, and then so are its suffixes. Counts are discounted and what is discounted follows the next shorter suffix, down to
the root, whose discount is the share of the unseen symbol. A symbol is scored from the longest retained suffix state.

All training texts are counted whole. A gram (a context and the symbol behind it) is a 64-bit hash. The places of all texts are
dealt once, by the symbol before each, so that a place's contexts and their suffixes meet in one bucket, which makes its part of the tree
by itself; very frequent symbols are dealt by two symbols, and what all their parts have to know is counted first. train_and_score() tells
places where they lie. train() writes the tree as a Parquet table of grams, which grows with the corpus, for score(). A log probability is a
sum over the grams of a text: what a retained context leaves to its suffix, and what a symbol told apart there gains over
that. The most frequent grams and words are broadcast, at most HEAD and 1 / FREQUENT; the others are joined by hash.
Null texts count as empty: an end alone. A null id falls into the fold of crc32(''). Repeated rows give
repeated results; extra columns are ignored. Without training texts N = V = 0 and every symbol is the unseen one.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Filter, drop_written, pick, words_of, written

#: Symbols of a context at most; a symbol needs so many occurrences behind a context to be told apart.
DEPTH, LEAST = 3, 2
#: A word of this share of the training tokens is broadcast; of grams, at most HEAD.
FREQUENT, HEAD = 1e-6, 1_000_000
#: The gain in nats that a retained context needs, and for each symbol that is told apart behind it.
LEAST_GAIN, GAIN_A_SYMBOL = 10.0, 2.0
#: Discount of counts behind contexts.
DISCOUNT = 0.75
#: Bits of a filter of grams at most: with more grams it lets more pass, which costs shuffles and no results.
FILTER_BITS = 1 << 28
CACHE_ENTRIES, COUNTER_ENTRIES, BUFFER = 200_000, 300_000, 800_000
#: Places that a bucket takes. The places behind a symbol of more than half of that are split by the symbol before into so many parts;
#: at most MOST_SPLIT symbols are. A bucket works through about CHUNK places at a time.
BUCKET_TOKENS, MOST_SPLIT, CHUNK = 1_000_000, 100_000, 300_000
END = b""  # as a key among words, none of which is empty


def word_hash(word: bytes) -> int:
    """As Spark's xxhash64."""
    h = xxhash.xxh64_intdigest(word, 42)
    return h - (1 << 64) if h >> 63 else h


class Hashes(dict):
    """Hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        found = self[word] = word_hash(word)
        return found


END_HASH = word_hash(END)


@dataclass
class Symbols:
    """Frequent symbols with numbers, the most frequent first, from 1; 0 is any other."""

    numbers: dict[bytes, int]
    counts: np.ndarray  # by number

    @classmethod
    def of(cls, frequent: dict[bytes, int]) -> Symbols:
        order = sorted(frequent, key=lambda w: (-frequent[w], w))
        return cls({w: i + 1 for i, w in enumerate(order)}, np.array([0, *(frequent[w] for w in order)], np.int64))


def longer(grams: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """The hashes of grams with one more symbol behind each; the empty gram is 0."""
    x = grams.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + symbols.view(np.uint64)
    x = (x ^ x >> np.uint64(31)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ x >> np.uint64(32)).view(np.int64)


def grams(hashes: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For contexts of 1, 2, ... DEPTH symbols: the places that have one, and by place the context, and it with the symbol
    there. Texts begin at `starts`; before a text's first symbol stands the end, and nothing before that."""
    place = np.arange(len(hashes)) - np.repeat(starts, np.diff(starts, append=len(hashes)))
    before = np.roll(hashes, 1)
    before[starts] = END_HASH
    context = longer(np.zeros(len(hashes), np.int64), before)
    for depth in range(1, DEPTH + 1):
        whole = longer(context, hashes)
        yield place >= depth - 1, context, whole
        context = np.roll(whole, 1)


@dataclass
class Tree:
    """The most frequent grams of the tree, sorted by hash, and a filter of all."""

    symbols: Symbols
    grams: np.ndarray
    left: np.ndarray  # log10 of the share that a context leaves to its suffix, 0 for grams that aren't retained contexts
    gain: np.ndarray  # log10 of what the last symbol gains over that, 0 where it isn't told apart
    root: np.ndarray  # log10 probabilities by number; 0 at 0, which another table tells
    maybe: Filter

    @property
    def contexts(self) -> np.ndarray:
        return self.grams[self.left != 0]

    def find(self, keys: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each key stands (-1 if it doesn't), and the places of keys that only the whole table can tell."""
        found = np.full(len(keys), -1)
        asked = np.flatnonzero(valid & self.maybe.passes(keys))
        if not len(self.grams):
            return found, asked
        at = np.minimum(np.searchsorted(self.grams, keys[asked]), len(self.grams) - 1)
        there = self.grams[at] == keys[asked]
        found[asked[there]] = at[there]
        return found, asked[~there]

    def read(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 of each symbol as far as the tree's head tells, and the places and hashes of grams beyond it. For symbols 0
        without their root probability."""
        numbers, hashes = ids
        out = self.root[numbers].copy()
        places, rest = [], []
        found = None
        for valid, context, whole in grams(hashes, starts):
            if found is None:
                found, open_ = self.find(context, valid)
                places.append(open_)
                rest.append(context[open_])
            else:
                found = np.where(valid, np.roll(found, 1), -1)
            out[found >= 0] += self.left[found[found >= 0]]
            found, open_ = self.find(whole, valid)
            places.append(open_)
            rest.append(whole[open_])
            out[found >= 0] += self.gain[found[found >= 0]]
        return out, np.concatenate(places), np.concatenate(rest)

    def log10(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return self.read(ids, starts)[0]


def discount_of(once: int, twice: int) -> float:
    """The root's discount from the numbers of words that occur once and twice."""
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
        counts.clear()
        return out

    for batch in batches:
        for text in batch.column(0):
            counts.update(words_of(text.as_py()))
            if len(counts) >= COUNTER_ENTRIES:
                yield flush()
    if counts:
        yield flush()


def numbered(texts: list[list[bytes]], symbols: Symbols | None, known: Hashes | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The symbol numbers (0 without `symbols`) and hashes of texts, each with its end, and where each text begins."""
    known = Hashes() if known is None else known
    words = [w for text in texts for w in (*text, END)]
    numbers = list(map(symbols.numbers.get, words, repeat(0))) if symbols else [0] * len(words)
    sizes = np.array([len(text) + 1 for text in texts], np.int64)
    return np.array([numbers, [known[w] for w in words]], np.int64), np.cumsum(sizes) - sizes


@dataclass
class Corpus:
    """The symbols of the training texts and their counts."""

    symbols: Symbols
    words: DataFrame  # word, n: all words, but not the end
    ends: int
    n_tokens: int
    n_distinct: int
    discount: float

    @property
    def unseen(self) -> float:
        """The root's probability of a word that the corpus lacks."""
        return self.discount * self.n_distinct / self.n_tokens if self.n_tokens else 1.0


def corpus_of(rows: DataFrame) -> Corpus:
    words = written(rows.select("text").mapInArrow(_word_counts, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "lm-words")
    ends = rows.select("doc_id").count()
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice")).first()
    n_tokens = total.n + ends
    frequent = {bytes(r.word): r.n for r in words.filter(F.col("n") >= max(1.0, FREQUENT * n_tokens)).collect()} | ({END: ends} if ends else {})
    return Corpus(Symbols.of(frequent), words, ends, n_tokens, total.v + bool(ends), discount_of(total.once, total.twice))


@dataclass
class Deal:
    """How the places of texts are dealt to buckets: by the symbol before, and where that is very frequent by the one before it
    too. So all contexts of a place, each the suffix of the next, fall into one bucket."""

    hashes: np.ndarray  # of symbols by number; 0 is what stands before a text's first end
    parts: np.ndarray  # by number, of the very frequent symbols
    buckets: int

    @classmethod
    def of(cls, corpus: Corpus, buckets: int) -> Deal:
        slice_ = max(1, BUCKET_TOKENS // 2)
        heavy = int((corpus.symbols.counts > max(slice_, corpus.n_tokens // MOST_SPLIT)).sum())
        return cls(np.array([0, *map(word_hash, corpus.symbols.numbers)], np.int64), -(-corpus.symbols.counts[: heavy + 1] // slice_), buckets)

    @property
    def heavy(self) -> int:
        """Symbols 1 to this are the very frequent ones."""
        return len(self.parts) - 1

    def bucket(self, w: np.ndarray, x: np.ndarray, before: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        own = hashes[x].view(np.uint64) % np.uint64(self.buckets)
        split = np.flatnonzero((x > 0) & (x <= self.heavy))
        part = (hashes[before[split]].view(np.uint64) >> np.uint64(7)) % self.parts[x[split]].astype(np.uint64)
        own[split] = self.of_part(x[split], part.astype(np.int64))
        # the frequent ones by turns, so that buckets are alike; a place behind a word that is in no gram may go anywhere
        rest = np.flatnonzero((x > self.heavy) & (x < len(self.hashes)))
        own[rest] = (self.parts.sum() + x[rest]) % self.buckets
        none = np.flatnonzero(x == 0)
        own[none] = hashes[w[none]].view(np.uint64) % np.uint64(self.buckets)
        return own.astype(np.int64)

    def of_part(self, x: np.ndarray, part: np.ndarray) -> np.ndarray:
        return ((np.cumsum(self.parts) - self.parts)[x] + part) % self.buckets


@dataclass
class Block:
    """Some texts of a task, as numbers of symbols; numbers beyond the frequent ones stand for this block's rare words."""

    rows: pa.Table
    sizes: np.ndarray  # by text, its end counted
    ids: np.ndarray
    hashes: np.ndarray  # by number
    twice: np.ndarray  # by number, whether it may occur LEAST times in training texts; no other is in a gram that counts

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.sizes) - self.sizes

    def before(self) -> list[np.ndarray]:
        """By place, the numbers of the symbols one, two, ... DEPTH places before; 0 where none is that counts."""
        out, row = [], np.where(self.twice[self.ids], self.ids, 0)
        for depth in range(DEPTH):
            row = np.roll(row, 1)
            row[self.starts] = 0 if depth else self.ids[-1]  # the last symbol of a text is the end
            out.append(row)
        return out

    def by_place(self, values: np.ndarray) -> np.ndarray:
        return np.repeat(values, self.sizes)


def _blocks(batches: Iterator[pa.RecordBatch], symbols: Symbols, hashes: np.ndarray, maybe: Filter) -> Iterator[Block]:
    """Blocks of about BUFFER places of the rows' column text."""
    get, first = symbols.numbers.get, len(hashes)
    rows, sizes, ids, rare, held = [], [], [], {}, 0

    def block() -> Block:
        names = np.array([word_hash(w) for w in rare], np.int64)
        twice = np.concatenate([np.ones(first, bool), maybe.passes(names) | (names == END_HASH)])
        own = Block(pa.Table.from_batches(rows), np.array(sizes, np.int64), np.concatenate(ids), np.concatenate([hashes, names]), twice)
        for x in (rows, sizes, ids, rare):
            x.clear()
        return own

    for batch in batches:
        texts = batch.column("text")
        for at in range(0, batch.num_rows, 128):
            words: list[bytes] = []
            for text in texts.slice(at, 128):
                own = words_of(text.as_py())
                words += own
                words.append(END)
                sizes.append(len(own) + 1)
            numbers = np.array(list(map(get, words, repeat(0))), np.int32)
            for i in np.flatnonzero(numbers == 0).tolist():
                numbers[i] = first + rare.setdefault(words[i], len(rare))
            rows.append(batch.slice(at, 128).drop_columns(["text"]))
            ids.append(numbers)
            held += len(numbers)
            if held >= BUFFER:
                yield block()
                held = 0
    if held:
        yield block()


def _beside(shared):
    """Texts to what buckets can't count by themselves: (x, bucket, w, n), pairs of a very frequent symbol x and the next one, w, and
    how often training texts have them, and with x = 0 the rare words w of a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, deal, maybe = shared.value
        for block in _blocks(batches, symbols, deal.hashes, maybe):
            x, before, *_ = block.before()
            at = np.flatnonzero((x > 0) & (x <= deal.heavy))
            own = deal.bucket(block.ids[at], x[at], before[at], block.hashes)
            pairs, n = np.unique((x[at].astype(np.int64) * deal.buckets + own) << 32 | block.ids[at], return_inverse=True)
            n = np.bincount(n, block.by_place(np.asarray(block.rows.column("learns")))[at], len(pairs)).astype(np.int64)
            at = np.flatnonzero(block.ids >= len(deal.hashes))
            rare = np.unique(deal.bucket(block.ids[at], x[at], before[at], block.hashes) << 32 | block.ids[at])
            kind = np.concatenate([(pairs >> 32) // deal.buckets, np.zeros(len(rare), np.int64)]).astype(np.int32)
            bucket = np.concatenate([(pairs >> 32) % deal.buckets, rare >> 32]).astype(np.int32)
            w = block.hashes[np.concatenate([pairs, rare]) & 0xFFFFFFFF]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (kind, bucket, w, np.concatenate([n, np.zeros(len(rare), np.int64)]))], ["x", "bucket", "w", "n"])

    return run


def _squeezed(*columns: np.ndarray) -> bytes:
    """Columns of numbers below 2^32, compressed byte by byte."""
    whole = np.concatenate(columns).astype(np.uint32).view(np.uint8).reshape(-1, 4)
    return pa.compress(np.ascontiguousarray(whole.T).tobytes(), "zstd", asbytes=True)


def _unsqueezed(data: bytes, columns: int, size: int) -> np.ndarray:
    if not size:
        return np.zeros((columns, 0), np.int64)
    planes = np.frombuffer(pa.decompress(data, 4 * columns * size, "zstd", asbytes=True), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view(np.uint32).reshape(columns, size).astype(np.int64)


#: A block's places of one bucket: the symbol, DEPTH before it and twice the text's number in the block, and one if it teaches;
#: `rare` has the hashes of numbers beyond the frequent ones. docs: the block's texts themselves, in one row of its own.
PLACES = "bucket int, block long, size int, data binary, rare binary, docs binary"
DOCS = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64())])


def _places(shared, scored: bool):
    """Texts (doc_id, held_out, learns, text) to their places by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        symbols, deal, maybe = shared.value
        logs, first = np.log10(symbols.counts + 1.0), len(deal.hashes)
        number = TaskContext.get().partitionId() << 32
        for block in _blocks(batches, symbols, deal.hashes, maybe):
            x, before, *others = block.before()
            bucket = deal.bucket(block.ids, x, before, block.hashes)
            cut = lambda v, bits: np.minimum(v, (1 << bits) - 1).astype(np.int64)
            order = np.argsort(bucket << 36 | cut(x, 20) << 16 | cut(before, 16), kind="stable")  # only packs better
            text = block.by_place(np.arange(len(block.sizes)) * 2 + np.asarray(block.rows.column("learns")))
            columns = [v[order] for v in (block.ids, x, before, *others, text)]
            ends = np.concatenate([[0], np.flatnonzero(np.diff(bucket[order])) + 1, [len(order)]])
            rows = []
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                own = np.concatenate([v[a:b] for v in columns[:-1]])
                rare = np.flatnonzero(own >= first)
                names, at = np.unique(own[rare], return_inverse=True)
                own[rare] = first + at
                rows.append((int(bucket[order[a]]), number, b - a, _squeezed(own, columns[-1][a:b]), block.hashes[names].tobytes(), None))
            if scored:
                numbers = np.where(block.ids < first, block.ids, 0)
                docs = pa.RecordBatch.from_arrays([block.rows.column("doc_id").combine_chunks(), block.rows.column("held_out").combine_chunks(), pa.array(block.sizes), pa.array(np.add.reduceat((numbers > 0).astype(np.int64), block.starts)), pa.array(np.add.reduceat(logs[numbers], block.starts))], schema=DOCS)
                rows.append((number % deal.buckets, number, 0, None, None, docs.serialize().to_pybytes()))
            number += 1
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], [c.split()[0] for c in PLACES.split(", ")])

    return run


@dataclass
class Root:
    """What each bucket has to know of the whole corpus."""

    hashes: np.ndarray
    counts: np.ndarray
    n_tokens: int
    n_distinct: int
    discount: float
    left: np.ndarray  # by number, of the very frequent symbols as contexts; others are counted in their buckets
    keep: np.ndarray

    def p(self, n: np.ndarray) -> np.ndarray:
        """The root's probabilities of symbols that occur n times."""
        if not self.n_tokens:
            return np.ones(len(n))
        return np.where(n > 0, (n - self.discount) / self.n_tokens, self.discount * self.n_distinct / self.n_tokens)


@dataclass
class Level:
    """Contexts of a length and the grams behind them, in a bucket. Rows are the bucket's different grams of the greatest length."""

    gram: np.ndarray  # by row, its gram of this length
    context: np.ndarray  # by row, its context of this length
    gram_row: np.ndarray  # by gram, a row that has it
    context_row: np.ndarray
    n: np.ndarray  # by gram
    told: np.ndarray  # by gram, whether it is told apart
    total: np.ndarray  # by context, as all below
    left: np.ndarray
    keep: np.ndarray


def _at(table: np.ndarray, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The values of keys in a sorted table, 0 for those that it lacks."""
    if not len(table):
        return np.zeros(len(keys), values.dtype)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, values[at], 0)


def _level(keys: tuple[np.ndarray, np.ndarray], n: np.ndarray, valid: np.ndarray, below: np.ndarray, known=None) -> Level:
    """keys: contexts and grams by row; n: occurrences; below: probabilities behind the suffix. known: what is known of very frequent
    contexts: (whether a row has one, occurrences of its gram, of the context, left, keep)."""
    _, context_row, context = np.unique(keys[0], return_index=True, return_inverse=True)
    _, gram_row, gram = np.unique(keys[1], return_index=True, return_inverse=True)
    count = lambda by, weights=None: np.bincount(by, weights, len(context_row)).astype(np.float64)
    sums, total = np.bincount(gram, n), count(context, n)
    if known:
        there, grams_n, contexts_n, left_of, keep_of = known
        sums = np.where(there[gram_row], grams_n[gram_row], sums)
        total = np.where(there[context_row], contexts_n[context_row], total)
    told = (sums >= LEAST) & valid[gram_row]
    of, k, low = context[gram_row[told]], sums[told], below[gram_row[told]]
    rest, symbols, rest_below = total - count(of, k), count(of), 1 - count(of, low)
    gain = count(of, k * np.log(k / total[of] / low))
    more = (rest > 0) & (rest_below > 1e-12) & (symbols > 0)
    gain[more] += rest[more] * np.log(rest[more] / total[more] / rest_below[more])
    left = (rest + DISCOUNT * symbols) / np.maximum(total, 1)
    keep = (symbols > 0) & (gain >= LEAST_GAIN + GAIN_A_SYMBOL * symbols)
    if known:
        left = np.where(there[context_row], left_of[context_row], left)
        keep = np.where(there[context_row], keep_of[context_row], keep)
    gram, context, gram_row, context_row = (v.astype(np.int32) for v in (gram, context, gram_row, context_row))
    return Level(gram, context, gram_row, context_row, sums, told, total, left, keep)


class Bucket:
    """The part of the tree that a bucket's places make, and what it says of them."""

    def __init__(self, places: list[dict], beside: pa.Table, root: Root, share: tuple[int, int]):
        """share: (k, n), the k-th of n parts, each with whatever follows its symbols."""
        first = len(root.hashes)
        self.places, self.root, self.share, heavy = places, root, share, len(root.left)
        parts, at, place, offset = [], [], [], 0
        for start, chunk in self._chunks():
            mine, keys, rows, inverse, own = self._grams(chunk, first)
            parts.append((keys, *(v[rows] for v in own[:-1]), np.bincount(inverse, own[-1], len(rows))))
            at.append((inverse + offset).astype(np.int32))
            place.append((mine + start).astype(np.int32))
            offset += len(rows)
        keys, numbers, x, *symbols, n = (np.concatenate(v) for v in zip(*parts, strict=True))
        #: the part's places, and the row of each
        self.place, self.at = np.concatenate(place), np.concatenate(at)
        if len(parts) > 1:
            _, rows, inverse = np.unique(keys, return_index=True, return_inverse=True)
            numbers, x, *symbols = (v[rows] for v in (numbers, x, *symbols))
            n, self.at = np.bincount(inverse, n, len(rows)), inverse.astype(np.int32)[self.at]
        del parts, keys
        w, *before = symbols
        kind, names, times = (beside.column(c).to_numpy() for c in ("x", "w", "n"))
        names_of = lambda which, keys: (np.sort(keys), times[which][np.argsort(keys)])
        rare, pairs = kind == 0, kind > 0
        table, counts = names_of(rare, names[rare])
        self.occurs = np.where(numbers < first, root.counts[np.minimum(numbers, first - 1)], _at(table, w, counts))
        self.x, self.there = x, (x > 0) & (x < heavy)
        self.undecided = self.there & ~root.keep[np.where(self.there, x, 0)]
        self.levels, self.keys = [], []
        p = self.p = root.p(self.occurs)
        for depth in range(1, DEPTH + 1):
            context = reduce(longer, before[depth - 1 :: -1], np.zeros(len(w), np.int64))
            self.keys.append((context, longer(context, w)))
            known = None
            if depth == 1:
                table, counts = names_of(pairs, longer(longer(np.zeros(int(pairs.sum()), np.int64), root.hashes[kind[pairs]]), names[pairs]))
                own = np.where(self.there, x, 0)
                known = (self.there, _at(table, self.keys[0][1], counts), root.counts[own], root.left[own], root.keep[own])
            level = _level(self.keys[-1], n, np.all([b != 0 for b in before[:depth]], axis=0), p, known)
            self.levels.append(level)
            p = (level.n / np.maximum(level.total, 1)[level.context[level.gram_row]])[level.gram]
        # a context that is retained retains its suffixes
        for whole, suffix in zip(self.levels[:0:-1], self.levels[-2::-1], strict=True):
            suffix.keep[suffix.context[whole.context_row[whole.keep]]] = True
        kept = self.levels[0].keep[self.levels[0].context]
        self.needed = np.unique(x[self.undecided & kept])

    def _chunks(self) -> Iterator[tuple[int, list[dict]]]:
        """So many places at a time, so that what is held of each is little more than its gram."""
        chunk, start, size = [], 0, 0
        for row in self.places:
            chunk.append(row)
            size += row["size"]
            if size >= CHUNK:
                yield start, chunk
                chunk, start, size = [], start + size, 0
        if chunk:
            yield start, chunk

    def _grams(self, chunk: list[dict], first: int) -> tuple:
        """This part's places, their different grams, a place of each, each place's gram, and by place the number of its symbol and the one
        before, the hashes of all symbols, and whether it teaches."""
        rare, columns, names, places, start = 0, [], [], [], 0
        named = lambda ids, names: np.where(ids < first, self.root.hashes[np.minimum(ids, first - 1)], names[np.maximum(ids - first, 0)] if len(names) else 0)
        k, of = self.share
        for row in chunk:
            own, rows = _unsqueezed(row["data"], DEPTH + 2, row["size"]), np.frombuffer(row["rare"], np.int64)
            if of > 1:
                x = own[1]
                split = np.where((x > 0) & (x < len(self.root.left)), named(own[2], rows), 0)
                mine = np.flatnonzero((longer(named(x, rows), split).view(np.uint64) >> np.uint64(20)) % np.uint64(of) == k)
                own = own[:, mine]
            else:
                mine = np.arange(row["size"])
            own[:-1][own[:-1] >= first] += rare
            rare += len(rows)
            columns.append(own)
            names.append(rows)
            places.append(mine + start)
            start += row["size"]
        whole, names = np.concatenate(columns, axis=1), np.concatenate(names)
        del columns
        hashes = [named(row, names) for row in whole[:-1]]
        context = reduce(longer, hashes[:0:-1], np.zeros(len(hashes[0]), np.int64))
        keys, rows, inverse = np.unique(longer(context, hashes[0]), return_index=True, return_inverse=True)
        return np.concatenate(places), keys, rows, inverse, (np.minimum(whole[0], first).astype(np.int32), np.minimum(whole[1], first).astype(np.int32), *hashes, (whole[-1] & 1).astype(np.int8))

    def _steps(self) -> Iterator[tuple[Level, np.ndarray, np.ndarray, np.ndarray]]:
        """By level and row: whether its context is retained, the probability behind the suffix, and behind the context."""
        q = self.p
        for depth, level in enumerate(self.levels):
            kept = level.keep[level.context] | (self.undecided if depth == 0 else False)
            told = np.flatnonzero(kept & level.told[level.gram])
            of = level.context[told]
            own = q.copy()
            own[told] = (level.n[level.gram[told]] - DISCOUNT) / level.total[of] + level.left[of] * q[told]
            yield level, kept, q, own
            q = own

    def values(self) -> tuple[np.ndarray, np.ndarray]:
        """By row the log10 of its last symbol, but for what undecided contexts add, which is the second."""
        value, undecided = np.log10(self.p), np.zeros(len(self.p))
        for depth, (level, kept, low, own) in enumerate(self._steps()):
            told = level.told[level.gram]
            add = np.where(told, np.log10(own / low), np.log10(np.where(kept, level.left[level.context], 1.0)))
            add[~kept] = 0.0
            if depth == 0:
                undecided = np.where(self.undecided, add, 0.0)
                add = np.where(self.undecided, 0.0, add)
            value += add
        return value, undecided

    def tree(self) -> pa.Table:
        """Retained contexts and the grams told apart there, but for very frequent symbols as contexts."""
        out = []
        for depth, (level, _, low, own) in enumerate(self._steps()):
            mine = ~self.there if depth == 0 else np.ones(len(self.x), bool)
            c = level.context_row[level.keep & mine[level.context_row]]
            of = level.context[c]
            out.append((self.keys[depth][0][c], level.total[of].astype(np.int64), np.log10(level.left[of]), np.zeros(len(c)), np.zeros(len(c), np.int32)))
            g = level.gram_row[level.told & level.keep[level.context[level.gram_row]] & mine[level.gram_row]]
            gain = np.log10(own[g] / low[g]) - np.log10(level.left[level.context[g]])
            out.append((self.keys[depth][1][g], level.n[level.gram[g]].astype(np.int64), np.zeros(len(g)), gain, np.zeros(len(g), np.int32)))
        none = np.zeros(len(self.needed))
        out.append((none.astype(np.int64), none.astype(np.int64), none, none, self.needed.astype(np.int32)))
        return pa.table(dict(zip(("key", "n", "left", "gain", "x"), map(np.concatenate, zip(*out, strict=True)), strict=True)))


def _parts(places: list[dict], beside: pa.Table, root: Root) -> Iterator[Bucket]:
    n = -(-sum(r["size"] for r in places) // CHUNK)
    return (Bucket(places, beside, root, (k, n)) for k in range(n))


def _scores(places: list[dict], beside: pa.Table, root: Root) -> list[tuple]:
    """Sums by block and text."""
    size, first, needed = sum(r["size"] for r in places), len(root.hashes), set()
    value, occurs, open_ = np.zeros(size), np.zeros(size, np.int64), np.zeros(size)
    for part in _parts(places, beside, root):
        known, undecided = part.values()
        value[part.place], occurs[part.place], open_[part.place] = known[part.at], part.occurs[part.at], undecided[part.at]
        needed |= set(part.needed.tolist())
    out, start = [], 0
    for row in places:
        own = slice(start, start + row["size"])
        start += row["size"]
        columns = _unsqueezed(row["data"], DEPTH + 2, row["size"])
        texts, rare = columns[-1] >> 1, np.flatnonzero((columns[0] >= first) & (occurs[own] > 0))
        sums = [(0, texts, value[own], texts[rare], np.log10(occurs[own][rare] + 1.0))]
        for x in np.unique(columns[1][open_[own] != 0]).tolist():
            some = np.flatnonzero((columns[1] == x) & (open_[own] != 0))
            sums.append((x, texts[some], open_[own][some], texts[:0], value[:0]))
        for x, by, v, known, base in sums:
            there = np.flatnonzero(np.bincount(by))
            out.append((row["block"], x, _squeezed(there), np.bincount(by, v)[there].tobytes(), _squeezed(known) if len(known) else b"", base.tobytes(), None))
    return out + [(-1, x, None, None, None, None, None) for x in sorted(needed)]


SUMS = "block long, x int, texts binary, score binary, known binary, base binary, docs binary"
GRAMS = "key long, n long, left double, gain double, x int"


def _in_bucket(root, scored: bool):
    def run(places: pa.Table, beside: pa.Table) -> pa.Table:
        rows = places.to_pylist()
        own = [r for r in rows if r["size"]]
        if not scored:
            none = pa.table({c: pa.array([], kind) for c, kind in (("key", pa.int64()), ("n", pa.int64()), ("left", pa.float64()), ("gain", pa.float64()), ("x", pa.int32()))})
            return pa.concat_tables([none, *(part.tree() for part in _parts(own, beside, root.value))])
        out = _scores(own, beside, root.value) + [(r["block"], 0, None, None, None, None, r["docs"]) for r in rows if not r["size"]]
        kinds = (pa.int64(), pa.int32(), *[pa.binary()] * 5)
        return pa.table([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], [c.split()[0] for c in SUMS.split(", ")])

    return run


@dataclass
class Dealt:
    """What the buckets of a corpus make, of one shuffle: GRAMS or SUMS, and what is known of very frequent contexts."""

    found: DataFrame
    root: Root
    pairs: DataFrame  # x, w, n, below: a very frequent symbol, the next one, and the root's probability of that

    flags: str  # the rows of `found` that name a very frequent symbol which a longer context needs

    def kept(self) -> list[int]:
        """The very frequent symbols that are retained contexts: by their own gain, or by a longer one's."""
        needed = {r.x for r in self.found.filter(self.flags).select("x").distinct().collect()}
        return sorted(set(np.flatnonzero(self.root.keep).tolist()) | needed)


def deal(rows: DataFrame, corpus: Corpus, scored: bool) -> Dealt:
    """rows: doc_id, held_out, learns, text."""
    spark, context = rows.sparkSession, rows.sparkSession.sparkContext
    dealt = Deal.of(corpus, max(2 * context.defaultParallelism, corpus.n_tokens // BUCKET_TOKENS))
    rare = corpus.words.filter((F.col("n") >= LEAST) & (F.col("n") < max(1.0, FREQUENT * corpus.n_tokens))).select(F.xxhash64("word").alias("key"))
    shared = context.broadcast((corpus.symbols, dealt, Filter.of(rare, FILTER_BITS)))
    every = corpus.words.select(F.xxhash64("word").alias("w"), F.col("n").alias("occurs"))
    every = every.unionByName(spark.createDataFrame([(END_HASH, corpus.ends)] if corpus.ends else [], "w long, occurs long"))
    beside = rows.select("learns", "text").mapInArrow(_beside(shared), "x int, bucket int, w long, n long").repartition("w").groupBy("w", "x", "bucket").agg(F.sum("n").alias("n"))
    # a bucket hears only of pairs and words that it has itself
    same = Window.partitionBy("w", "x")
    beside = beside.select("x", "bucket", "w", F.sum("n").over(same).alias("n"), (F.min("bucket").over(same) == F.col("bucket")).alias("once"))
    beside = written(beside.filter((F.col("x") == 0) | (F.col("n") >= LEAST)).join(every, "w"), "lm-beside")
    pairs = beside.filter("x > 0 and once").select("x", "w", "n", ((F.col("occurs") - corpus.discount) / float(max(1, corpus.n_tokens))).alias("below"))
    left, keep = np.ones(dealt.heavy + 1), np.zeros(dealt.heavy + 1, bool)
    for r in pairs.groupBy("x").agg(F.sum("n").alias("told"), F.count("*").alias("symbols"), F.sum("below").alias("below"), F.sum(F.col("n") * F.log(F.col("n") / F.col("below"))).alias("gain")).collect():
        total = int(corpus.symbols.counts[r.x])
        rest, rest_below = total - r.told, 1 - r.below
        gain = r.gain - r.told * math.log(total) + (rest * math.log(rest / total / rest_below) if rest > 0 and rest_below > 1e-12 else 0.0)
        left[r.x], keep[r.x] = (rest + DISCOUNT * r.symbols) / total, gain >= LEAST_GAIN + GAIN_A_SYMBOL * r.symbols
    root = Root(dealt.hashes, corpus.symbols.counts, corpus.n_tokens, corpus.n_distinct, corpus.discount, left, keep)
    names = beside.select("bucket", "x", "w", F.when(F.col("x") == 0, F.col("occurs")).otherwise(F.col("n")).alias("n"))
    places = rows.select("doc_id", "held_out", "learns", "text").mapInArrow(_places(shared, scored), PLACES)
    both = [t.repartition(dealt.buckets, "bucket").groupBy("bucket") for t in (places, names)]
    found = both[0].cogroup(both[1]).applyInArrow(_in_bucket(context.broadcast(root), scored), SUMS if scored else GRAMS)
    return Dealt(written(found, "lm-sums" if scored else "lm-grams"), root, pairs, "block < 0" if scored else "x > 0")


def grow(rows: DataFrame, corpus: Corpus) -> DataFrame:
    """The tree's grams (key, n, left, gain) of the texts of `rows`."""
    spark = rows.sparkSession
    dealt = deal(rows.select(F.lit(None).cast("long").alias("doc_id"), F.lit(False).alias("held_out"), F.lit(True).alias("learns"), "text"), corpus, False)
    root, kept = dealt.root, dealt.kept()
    first = longer(np.zeros(len(kept), np.int64), root.hashes[kept])
    contexts = [(int(key), int(root.counts[x]), math.log10(root.left[x]), 0.0) for key, x in zip(first, kept, strict=True)]

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, w, n, below = (c.to_numpy() for c in batch.columns)
            key = longer(longer(np.zeros(len(x), np.int64), root.hashes[x]), w)
            gain = np.log10(((n - DISCOUNT) / root.counts[x] + root.left[x] * below) / below) - np.log10(root.left[x])
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n), pa.array(np.zeros(len(x))), pa.array(gain)], ["key", "n", "left", "gain"])

    schema = "key long, n long, left double, gain double"
    whole = dealt.found.filter("x = 0").drop("x").unionByName(spark.createDataFrame(contexts, schema)).unionByName(dealt.pairs.filter(F.col("x").isin(kept)).mapInArrow(pairs, schema))
    tree = written(whole.groupBy("key").agg(F.max("n").alias("n"), F.sum("left").alias("left"), F.sum("gain").alias("gain")), "lm-tree")
    drop_written(dealt.found, dealt.pairs)
    return tree


def _docs_of(root: Root, kept: list[int]):
    """A block's sums to its rows."""

    def run(rows: pa.Table) -> pa.Table:
        found = rows.to_pylist()
        docs = pa.ipc.read_record_batch(next(r["docs"] for r in found if r["docs"] is not None), DOCS)
        score, base, known = np.zeros(docs.num_rows), docs.column("base").to_numpy().copy(), docs.column("n_known").to_numpy().copy()
        for r in found:
            if r["docs"] is None and (not r["x"] or r["x"] in kept):
                own = np.frombuffer(r["score"], np.float64)
                score[_unsqueezed(r["texts"], 1, len(own))[0]] += own
                more = np.frombuffer(r["base"], np.float64)
                at = _unsqueezed(r["known"], 1, len(more))[0]
                base += np.bincount(at, more, len(base))
                known += np.bincount(at, minlength=len(known))
        tokens = docs.column("n_tokens").to_numpy()
        base -= tokens * math.log10(root.n_tokens + root.n_distinct + 1)
        return pa.table([docs.column("doc_id"), docs.column("held_out"), docs.column("n_tokens"), pa.array(known), pa.array(np.full(len(base), root.n_tokens)), pa.array(base), pa.array(score)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def train_and_score(docs: DataFrame, learns: Column, held_out: Column) -> DataFrame:
    """score() of all rows of `docs` by train() of those where `learns` is true, at once: the bucket that makes a part of the tree
    tells its places too, so that no table of grams is written or joined."""
    corpus = corpus_of(docs.filter(learns))
    dealt = deal(docs.select("doc_id", held_out.alias("held_out"), F.coalesce(learns, F.lit(False)).alias("learns"), "text"), corpus, True)
    kept = dealt.kept()
    drop_written(dealt.pairs)
    n = docs.sparkSession.sparkContext.defaultParallelism
    sums = dealt.found.filter("block >= 0").repartition(max(2 * n, corpus.n_tokens // BUCKET_TOKENS), "block")
    small = Root(np.zeros(0, np.int64), np.zeros(0, np.int64), corpus.n_tokens, corpus.n_distinct, corpus.discount, np.zeros(0), np.zeros(0, bool))
    return sums.groupBy("block").applyInArrow(_docs_of(small, kept), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


@dataclass
class Model:
    tree: Tree  # its head
    grams: DataFrame  # key, value: the grams of the tree beyond the head
    frequent: dict[bytes, int]  # numbers of words
    words: DataFrame  # h (hash of the word), n: all words of the training texts that aren't frequent
    ends: int
    n_tokens: int
    n_distinct: int
    discount: float

    @property
    def unseen(self) -> float:
        """The root's probability of a word that the corpus lacks."""
        return self.discount * self.n_distinct / self.n_tokens if self.n_tokens else 1.0


def train(docs: DataFrame, learns: Column) -> Model:
    """A model of the whole texts of `docs` (doc_id, text) where `learns` is true."""
    rows = docs.filter(learns)
    corpus = corpus_of(rows)
    symbols, n_tokens, discount = corpus.symbols, corpus.n_tokens, corpus.discount
    rare = corpus.words.filter(F.col("n") < max(1.0, FREQUENT * n_tokens)).select(F.xxhash64("word").alias("h"), "n")
    whole = grow(rows, corpus)
    # halves of octaves of counts, the highest first, as many as fit the head
    octave = F.floor(2 * F.log2("n")).alias("octave")
    size, lowest = 0, None
    for r in whole.groupBy(octave).count().orderBy(F.desc("octave")).collect():
        size += r["count"]
        if size > HEAD:
            break
        lowest = r.octave
    in_head = F.lit(False) if lowest is None else octave >= lowest
    head = whole.filter(in_head).select("key", "left", "gain").toArrow()
    keys = head.column("key").to_numpy()
    order = np.argsort(keys)
    root = np.log10(np.maximum(np.maximum(symbols.counts - discount, 0) / max(1, n_tokens), 1e-300))
    root[0] = 0.0
    tree = Tree(symbols, keys[order], head.column("left").to_numpy()[order], head.column("gain").to_numpy()[order], root, Filter.of(whole.select("key"), FILTER_BITS))
    beyond = whole.filter(~in_head).select("key", (F.col("left") + F.col("gain")).alias("value"))
    return Model(tree, beyond, symbols.numbers, rare, corpus.ends, n_tokens, corpus.n_distinct, discount)


def _read(shared):
    """(doc_id, held_out, text) to what the broadcast part of the model says, and the text's other words by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tree = shared.value
        symbols = tree.symbols
        logs = np.log10(symbols.counts + 1.0)
        uid = TaskContext.get().partitionId() << 40
        known = Hashes()
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                texts = [words_of(t.as_py()) for t in part.column(2)]
                ids, starts = numbered(texts, symbols, known)
                numbers = ids[0]
                scores, places, keys = tree.read(ids, starts)
                sums = lambda x: np.add.reduceat(x, starts) if len(starts) else np.zeros(0)  # noqa: B023, E731
                others: list[list[int]] = [[] for _ in texts]
                times: list[list[int]] = [[] for _ in texts]
                rare = np.flatnonzero(numbers == 0)
                owner = np.searchsorted(starts, rare, "right") - 1
                lengths = np.array([len(words) for words in texts])
                inside = rare - starts[owner] < lengths[owner]  # the end may be a symbol 0 too
                rare, owner = rare[inside], owner[inside]
                groups: dict[int, Counter] = {}
                for i, k in zip(owner.tolist(), (rare - starts[owner]).tolist(), strict=True):
                    groups.setdefault(i, Counter())[texts[i][k]] += 1
                for i, rest in groups.items():
                    others[i] = [known[w] for w in rest]
                    times[i] = list(rest.values())
                places = np.searchsorted(starts, places, "right") - 1
                keys = keys[np.argsort(places, kind="stable")]
                ends = np.concatenate([[0], np.cumsum(np.bincount(places, minlength=len(texts)))])
                columns = [pa.array(np.arange(uid, uid + len(texts))), pa.array(sums(np.ones(len(numbers), np.int64))), pa.array(sums((numbers > 0).astype(np.int64))), pa.array(sums(logs[numbers])), pa.array(sums(scores)), pa.array(others, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int32())), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys))]
                uid += len(texts)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], ["doc_id", "held_out", "uid", "n_tokens", "n_known", "base", "score", "others", "times", "grams"])

    return run


def score(docs: DataFrame, held_out: Column, model: Model) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model.tree)
    schema = "doc_id long, held_out boolean, uid long, n_tokens long, n_known long, base double, score double, others array<long>, times array<int>, grams array<long>"
    rows = written(docs.select("doc_id", held_out.alias("held_out"), "text").mapInArrow(_read(shared), schema), "lm-rows")
    others = rows.select("uid", F.explode(F.arrays_zip(F.col("others").alias("h"), F.col("times").alias("times"))).alias("w")).select("uid", "w.h", "w.times")
    counted = others.join(model.words, "h")
    root = F.col("times") * F.log10((F.col("n") - model.discount) / float(max(1, model.n_tokens)))
    more = counted.groupBy("uid").agg(F.sum("times").cast("long").alias("known"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("base_more"), F.sum(root).alias("score_more"))
    grams_more = rows.select("uid", F.explode("grams").alias("key")).join(model.grams, "key").groupBy("uid").agg(F.sum("value").alias("grams_more"))
    joined = rows.select("doc_id", "held_out", "uid", "n_tokens", "n_known", "base", "score").join(more, "uid", "left").join(grams_more, "uid", "left")
    n_known = F.col("n_known") + F.coalesce("known", F.lit(0))
    base = F.col("base") + F.coalesce("base_more", F.lit(0.0)) - F.col("n_tokens") * math.log10(model.n_tokens + model.n_distinct + 1)
    whole = F.col("score") + F.coalesce("score_more", F.lit(0.0)) + F.coalesce("grams_more", F.lit(0.0)) + (F.col("n_tokens") - n_known) * math.log10(model.unseen)
    return joined.select("doc_id", "held_out", "n_tokens", n_known.alias("n_known"), F.lit(model.n_tokens).cast("long").alias("train_tokens"), base.alias("base_score"), whole.alias("score"))


def documents_of(docs: DataFrame) -> DataFrame:
    return pick(docs, doc_id="long", text="string")
