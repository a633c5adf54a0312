"""Benchmark decontamination: training passages queried against a BM25 index of test items.

The test items are the indexed side. One index holds up to SHARD_ITEMS items and SHARD_WORDS words (about
100 bytes a word where it is broadcast); only beyond that are there several, and a training text is
read once for each. Document frequencies and mean length are those of all items, so scores don't
depend on the shards. Items are held by classes of length, powers of two; for each class every text is cut into
overlapping passages that cover it whole: steps of twice the class's length, passages of two steps, so any
item lies inside one passage, also with as many words put in between, and one long item doesn't lengthen the
passages of the others. Each passage
is a query; items whose BM25 score is at least `threshold` of the item's score against itself are
retrieved by block-max WAND (weights are divided by that self score, so one threshold serves all) and
verified: at least 75 % of the distinct 5-word shingles of the whole item occur in the passage, or as
many of its question's and of its answer's each. So an edited or missing answer of few words doesn't
drop an item that is there otherwise, and an answer that stands apart from its question is found too.

An item's essential terms are its rarest ones, as many as weigh ESSENTIAL together; only they have lists of
blocks. A passage's words sum the block maxima of their lists; a block goes on if that sum and what its
items' other terms weigh at most reach the threshold. For those blocks the maxima of all terms (sparse: a
list for each block) are summed, and WAND goes through the blocks whose sum reaches the threshold. So the
frequent words, whose lists are long, are never gone through, however many items there are.

An item's answer is the last sentence of its text and the question what stands before it, unless
columns for them are named; an item of one sentence has only a question. The whole item is the
question's words and then the answer's. Words: A-Z lower-cased, split
at ASCII white space and punctuation. A part of fewer than five words is one shingle;
an item without words is never found. Null or empty texts match nothing. Rows with equal doc_id
are searched each for itself and give one result per (doc_id, item_id), the best. Equal items are
all reported. Texts of any length are searched whole, passages in bounded groups. An empty table on either
side: no results, and keep_clean keeps all. Extra columns, whatever their names, aren't read by
`contaminated` and pass through `keep_clean`.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, saved

K1, B = 1.2, 0.75
WORDS, SHARE, THRESHOLD = 5, 0.75, 0.6
#: Items to a block; bounds on a shard, and so on what is broadcast.
BLOCK, SHARD_ITEMS, SHARD_WORDS = 4, 100_000, 4_000_000
#: The shortest class of item lengths, the share of an item's weight that its essential terms have, and the
#: passages of a text, and (passage, block) pairs, that are bounded at once.
LEAST_STEP, ESSENTIAL, PASSAGES, PAIRS = 64, 0.8, 256, 2048
#: Items whose shingles a worker remembers.
PARTS = 10_000
#: Room for rounding in sums of single-precision bounds.
SLACK = 1e-4
_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_NO_MARKS = bytes.maketrans(_MARKS, b" " * len(_MARKS))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_NO_MARKS).split()


def shingles_of(words: list[bytes]) -> set[bytes]:
    if not words:
        return set()
    k = min(WORDS, len(words))
    return {b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)}


def shingles_of_size(words: list[bytes], k: int) -> set[bytes]:
    return {b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)}


def parts_of(text: str | None) -> tuple[str, str]:
    """(question, answer): all but the last sentence, and the last."""
    ends = [m.end() for m in re.finditer(r"[.!?]\s+", (text or "").rstrip())]
    return ((text or "")[: ends[-1]], (text or "")[ends[-1] :]) if ends else (text or "", "")


@dataclass
class Whole:
    """Figures of all items: number, mean length, and a saved table (word, n) of document frequencies."""

    n: int
    mean: float
    words: DataFrame

    @classmethod
    def of(cls, texts: DataFrame) -> Whole:
        """texts: one column. A row without a word stands for each item and has its length."""

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for t in batch.column(0):
                    if words := words_of(t.as_py()):
                        yield pa.RecordBatch.from_pydict({"word": pa.array([None, *sorted(set(words))], pa.binary()), "length": pa.array([len(words)] + [0] * len(set(words)), pa.int64())})

        grouped = map_batches(texts, count, "word binary, length long").groupBy("word")
        held = saved(grouped.agg(F.count("*").alias("n"), F.sum("length").alias("total")), "item-words")
        r = held.where("word is null").first()
        return cls(r.n, r.total / r.n, held.where("word is not null").select("word", "n")) if r else cls(0, 0.0, held.select("word", "n"))

    def frequencies(self, words: Iterable[bytes]) -> dict[bytes, int]:
        """Document frequencies of one shard's words, in their order."""
        some = self.words.sparkSession.createDataFrame([(bytearray(w),) for w in words], "word binary")
        n = {bytes(r.word): r.n for r in self.words.join(F.broadcast(some), "word", "left_semi").collect()}
        return {w: n[w] for w in words}


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers starts[i], starts[i] + 1, ... (counts[i] of them), one after the other."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


@dataclass
class LengthClass:
    """Items of at most `step` / 2 words. Block b has entries entry_at[b] .. entry_at[b + 1], one a term, in the
    order of the terms: `term`, `most` (the largest weight in the block) and postings post_at[e] ..
    post_at[e + 1] of items and weights. Blocks in which a term is essential to an item: `blocks` from
    essential_at[term] on, with its maxima for these items; `rest` is what the other terms of a block's
    items weigh at most."""

    step: int
    entry_at: np.ndarray
    term: np.ndarray
    most: np.ndarray
    post_at: np.ndarray
    item: np.ndarray
    weight: np.ndarray
    essential_at: np.ndarray
    blocks: np.ndarray
    maxima: np.ndarray
    rest: np.ndarray

    @classmethod
    def of(cls, step: int, items: list[int], weights: dict[int, dict[int, float]], essential: dict[int, list[int]], n_terms: int) -> LengthClass:
        entry_at, term, most, post_at, item, weight = [0], [], [], [0], [], []
        where: dict[int, list[tuple[int, float]]] = {}
        rest = []
        for b, lo in enumerate(range(0, len(items), BLOCK)):
            held: dict[int, list[tuple[int, float]]] = {}
            for i in items[lo : lo + BLOCK]:
                for t, x in weights[i].items():
                    held.setdefault(t, []).append((i, x))
            for t in sorted(held):
                term.append(t)
                most.append(max(x for _, x in held[t]))
                item += [i for i, _ in held[t]]
                weight += [x for _, x in held[t]]
                post_at.append(len(item))
            entry_at.append(len(term))
            tops: dict[int, float] = {}
            for i in items[lo : lo + BLOCK]:
                for t in essential[i]:
                    tops[t] = max(tops.get(t, 0.0), weights[i][t])
            for t, x in tops.items():
                where.setdefault(t, []).append((b, x))
            rest.append(max(1 - sum(weights[i][t] for t in essential[i]) for i in items[lo : lo + BLOCK]))
        counts = np.zeros(n_terms + 2, np.int64)
        for t, held_in in where.items():
            counts[t + 1] = len(held_in)
        return cls(step, np.array(entry_at), np.array(term, np.int64), np.array(most), np.array(post_at), np.array(item, np.int64), np.array(weight), np.cumsum(counts), np.array([b for t in sorted(where) for b, _ in where[t]], np.int64), np.array([x for t in sorted(where) for _, x in where[t]]), np.array(rest))

    def candidates(self, ids: np.ndarray, none: int, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
        """(first word of the passage, entries of one block that the passage's words have) for the passages and
        blocks whose summed maxima reach the threshold. ids: a term or `none` for each word of the text."""
        at = np.flatnonzero(ids < none)
        if not len(at) or not len(self.term):
            return
        # a word counts in the passage that starts at its step and in the one before
        passages, own, size = max(1, -(-len(ids) // self.step) - 1), at // self.step, none + 1
        key = np.concatenate([own * size + ids[at], (own - 1) * size + ids[at]])
        key = np.unique(key[(key >= 0) & (key < passages * size)])
        n_blocks = len(self.entry_at) - 1
        for lo in range(0, passages, PASSAGES):  # bounded memory for long texts
            held = key[slice(*np.searchsorted(key, (lo * size, (lo + PASSAGES) * size)))]
            where, terms = held // size, held % size
            n = self.essential_at[terms + 1] - self.essential_at[terms]
            at = _ranges(self.essential_at[terms], n)
            pairs, number = np.unique(np.repeat(where, n) * n_blocks + self.blocks[at], return_inverse=True)
            bound = np.bincount(number, self.maxima[at], len(pairs)) + self.rest[pairs % n_blocks]
            pairs = pairs[bound >= threshold - SLACK]
            for first in range(0, len(pairs), PAIRS):
                yield from self.bounded(pairs[first : first + PAIRS], key, size, threshold)

    def bounded(self, some: np.ndarray, key: np.ndarray, size: int, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
        """The pairs (passage, block) of `some` whose maxima over all terms reach the threshold."""
        n_blocks = len(self.entry_at) - 1
        passage, block = some // n_blocks, some % n_blocks
        n = self.entry_at[block + 1] - self.entry_at[block]
        entries, pair = _ranges(self.entry_at[block], n), np.repeat(np.arange(len(some)), n)
        wanted = passage[pair] * size + self.term[entries]
        found = key[np.minimum(np.searchsorted(key, wanted), len(key) - 1)] == wanted
        bound = np.bincount(pair[found], self.most[entries[found]], len(some))
        for k in np.flatnonzero(bound >= threshold - SLACK).tolist():
            yield int(passage[k]) * self.step, entries[found & (pair == k)]

    def search(self, entries: np.ndarray, threshold: float) -> list[tuple[int, float]]:
        """WAND inside one block, with its maxima as the terms' bounds: the items that score at least
        `threshold` against the terms of `entries`."""
        cursors = [[int(self.item[p]), e, p] for e in entries.tolist() for p in [int(self.post_at[e])]]
        out = []
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, None
            for item, e, _ in cursors:
                bound += float(self.most[e])
                if bound >= threshold - SLACK:
                    pivot = item
                    break
            if pivot is None:
                break
            if cursors[0][0] == pivot:
                score = sum(float(self.weight[p]) for item, _, p in cursors if item == pivot)
                if score >= threshold - SLACK:
                    out.append((pivot, score))
            to, left = pivot + (cursors[0][0] == pivot), []
            for item, e, p in cursors:
                end = int(self.post_at[e + 1])
                while p < end and self.item[p] < to:  # at most BLOCK postings
                    p += 1
                if p < end:
                    left.append([int(self.item[p]), e, p])
            cursors = left
        return out


@dataclass
class Index:
    """Items with the words of question and answer, the number of each term, and the classes of length with
    their postings of normalised BM25 weights."""

    items: list = field(default_factory=list)  # (item_id, question words, answer words)
    terms: dict[bytes, int] = field(default_factory=dict)
    classes: list[LengthClass] = field(default_factory=list)
    held: dict[int, tuple] = field(default_factory=dict)

    @classmethod
    def of(cls, rows: list[tuple], whole: Whole | None = None, threshold: float = THRESHOLD) -> Index:
        """rows: (item_id, question, answer); whole: of the items that `rows` is a shard of, if not all."""
        self, counts = cls(), []
        one: dict[bytes, bytes] = {}
        for item_id, question, answer in rows:
            q, a = ([one.setdefault(w, w) for w in words_of(x)] for x in (question, answer))
            if q + a:
                self.items.append((item_id, q, a))
                tf: dict[bytes, int] = {}
                for w in q + a:
                    tf[w] = tf.get(w, 0) + 1
                counts.append(tf)
        lengths = [len(q) + len(a) for _, q, a in self.items]
        n, mean = len(counts), sum(lengths) / max(1, len(lengths))
        df: dict[bytes, int] = {}
        for tf in counts:
            for w in tf:
                df[w] = df.get(w, 0) + 1
        if whole is not None and n:
            n, mean, df = whole.n, whole.mean, whole.frequencies(df)
        self.terms = {w: t for t, w in enumerate(df)}
        weights, essential, by_step = {}, {}, {}
        for i, tf in enumerate(counts):
            weight = {w: math.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * lengths[i] / mean)) for w, c in tf.items()}
            total = sum(weight.values())
            weights[i] = {self.terms[w]: x / total for w, x in weight.items()}
            held, essential[i] = 0.0, []
            for w in sorted(weight, key=lambda w: (df[w], w)):
                essential[i].append(self.terms[w])
                held += weight[w] / total
                if held >= ESSENTIAL:
                    break
            by_step.setdefault(max(LEAST_STEP, 1 << (2 * lengths[i] - 1).bit_length()), []).append(i)
        self.classes = [LengthClass.of(step, items, weights, essential, len(df)) for step, items in sorted(by_step.items())]
        return self

    def parts(self, i: int) -> tuple[set[bytes], set[bytes], set[bytes]]:
        """Shingles of an item's question, of its answer and of both together; remembered for PARTS items."""
        if i not in self.held:
            if len(self.held) >= PARTS:
                self.held.clear()
            _, q, a = self.items[i]
            self.held[i] = (shingles_of(q), shingles_of(a), shingles_of(q + a))
        return self.held[i]

    def found_in(self, text: str | None, threshold: float, share: float) -> dict[int, tuple[float, ...]]:
        """Verified items of a whole text: best (score, question share, answer share, item share) by
        item number."""
        words = words_of(text)
        if not words or not self.items:
            return {}
        none = len(self.terms)
        ids = np.fromiter(map(self.terms.get, words, repeat(none)), np.int64, len(words))
        out: dict[int, tuple[float, ...]] = {}
        for c in self.classes:
            windows: dict[tuple[int, int], set[bytes]] = {}  # of the present passage
            now = -1
            for begin, entries in c.candidates(ids, none, threshold):
                if begin != now:
                    windows, now = {}, begin
                for i, score in c.search(entries, threshold):
                    parts = self.parts(i)
                    inside = set()
                    for k in {next(iter(p)).count(b" ") + 1 for p in parts if p}:
                        if (begin, k) not in windows:
                            windows[begin, k] = shingles_of_size(words[begin : begin + 2 * c.step], k)
                        inside |= windows[begin, k]
                    q, a, both = (len(p & inside) / len(p) if p else 1.0 for p in parts)
                    if both >= share or min(q, a) >= share:
                        out[i] = max(out.get(i, ()), (score, q, a, both))
        return out


def shingles_of_window(words: list[bytes], parts) -> set[bytes]:
    """The window's shingles of every length that the parts' shingles have."""
    out: set[bytes] = set()
    for k in {next(iter(p)).count(b" ") + 1 for p in parts if p}:
        out |= shingles_of_size(words, k)
    return out


def shards(benchmark: DataFrame, item_id: str, text: str, question: str | None, answer: str | None, threshold: float) -> Iterator[Index]:
    """Indexes of bounded size over all items, in the order of their ids; rows come to the driver one
    partition at a time and are kept for two shards at most."""
    cols = [F.col(item_id).cast("long").alias("i"), F.col(text).alias("t") if question is None else F.struct(F.col(question).alias("q"), (F.col(answer) if answer else F.lit(None).cast("string")).alias("a")).alias("t")]
    items = benchmark.select(*cols)
    groups = _grouped(items, question is None)
    first = list(islice(groups, 2))
    # one shard has the figures of all items in itself
    whole = Whole.of(items.select("t" if question is None else F.concat_ws(" ", "t.q", "t.a").alias("t"))) if len(first) > 1 else None
    for rows in chain(first, groups):
        yield Index.of(rows, whole, threshold)


def _grouped(items: DataFrame, split: bool) -> Iterator[list[tuple]]:
    rows, size = [], 0
    for r in items.orderBy("i").toLocalIterator():
        q, a = parts_of(r.t) if split else (r.t.q, r.t.a)
        n = len((q or "").split()) + len((a or "").split())
        if rows and (len(rows) >= SHARD_ITEMS or size + n > SHARD_WORDS):
            yield rows
            rows, size = [], 0
        rows.append((r.i, q, a))
        size += n
    if rows:
        yield rows


MATCH = "doc_id long, item_id long, score double, question_share double, answer_share double, item_share double"


def contaminated(df: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", question: str | None = None, answer: str | None = None, threshold: float = THRESHOLD, share: float = SHARE) -> DataFrame:
    """doc_id, item_id, score and the shares of question, answer and whole item of every verified match."""
    spark, out = df.sparkSession, None
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    for index in shards(benchmark, item_id, item_text, question, answer, threshold):
        sent = spark.sparkContext.broadcast(index)

        def look(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            held = sent.value
            for batch in batches:
                rows = [(d, held.items[i][0], *x) for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for i, x in held.found_in(t.as_py(), threshold, share).items()]
                kinds = [pa.int64(), pa.int64(), *[pa.float64()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], [x.split()[0] for x in MATCH.split(", ")])

        part = map_batches(docs, look, MATCH)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], MATCH)
    best = F.max(F.struct("score", "question_share", "answer_share", "item_share")).alias("b")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", F.round("b.score", 6).alias("score"), "b.question_share", "b.answer_share", "b.item_share")


def keep_clean(df: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", question: str | None = None, answer: str | None = None, threshold: float = THRESHOLD, share: float = SHARE) -> DataFrame:
    """The rows of `df` that hold no test item, all columns as they are: a filter without a shuffle."""
    names = [f"_c{i}" for i in range(len(df.columns))]
    out, at = df.toDF(*names), df.columns.index(text)
    for index in shards(benchmark, item_id, item_text, question, answer, threshold):
        sent = df.sparkSession.sparkContext.broadcast(index)

        def clean(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not sent.value.found_in(t.as_py(), threshold, share) for t in batch.column(at)], pa.bool_()))

        out = map_batches(out, clean, out.schema)
    return out.toDF(*df.columns)
