"""Line deduplication over a whole corpus with two Bloom filters.

Texts are split at \\n. A line's key is the line without ASCII white space at both ends, A-Z lower-
cased. Keys of at least 10 code points found in at least two documents lose all their lines except in
the smallest doc_id that holds them.

1. One pass over the texts makes a 128-bit digest of each distinct key of a document. A window of digests
   (at most WINDOW of one task) finds by itself those that several of its documents hold: they are suspects
   at once, and one mark of each goes on. The others go on as (digest, doc_id), 24 bytes a line whatever its length,
   to the bucket of their first bits. So a line that a third of all documents hold costs its bucket
   one mark a window.
2. Each bucket puts its digests into a Bloom filter "seen once" or, if they are there already, into a second
   one, "seen twice", and then lets only those pass that the second one suspects. The number of buckets
   grows with the number of lines, so a bucket's filters stay within 12 bits for each of about
   BUCKET_LINES lines, and the share of lines that are suspected wrongly (under 1 %) is the same for
   corpora of all sizes. Buckets go through one after the other; nothing is broadcast.
3. Suspects are confirmed exactly, by a shuffle of (doc_id, digest): at least two documents, and the first
   of them. A fuller filter costs more suspects, never a wrong result.
4. Confirmed drops go back to their documents, which are joined by doc_id.

The exact step aggregates map-side and joins with a skew-tolerant join. Null or empty text: one empty line,
nothing dropped. Rows with equal doc_id count as one document (none of them loses a line to another). A null
doc_id comes after all others. Texts and lines of any length are taken whole; a text is held in memory by
the task that cuts it. Empty table: empty. Extra columns, whatever their names, aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, saved

MIN_CHARS = 10
#: Bits per line of a bucket and hash functions of the filters.
BITS_PER_LINE, HASHES = 12, 4
#: Lines to a bucket, and digests that a task looks through at once.
BUCKET_LINES, WINDOW, LEAST_BUCKETS = 1 << 21, 1 << 19, 64
DIGEST = np.dtype([("a", "<u8"), ("b", "<u8")])
LAST = (1 << 63) - 1


def keys_of(text: str | None) -> list[bytes]:
    """The key of each line; bytes.lower() and bytes.strip() are the A-Z and the white space rule."""
    return [x.strip() for x in (text or "").encode("utf-8", "surrogatepass").lower().split(b"\n")]


def long_enough(key: bytes) -> bool:
    return len(key) >= 4 * MIN_CHARS or len(key) >= MIN_CHARS and len(key.decode("utf-8", "surrogatepass")) >= MIN_CHARS


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _bits(digests: np.ndarray, bits: int) -> np.ndarray:
    """HASHES bit numbers of each digest, by double hashing of its second half (the first deals to buckets)."""
    a, b = digests["b"] & np.uint64(0xFFFFFFFF), (digests["b"] >> np.uint64(32)) | np.uint64(1)
    return ((a[None] + np.arange(HASHES, dtype=np.uint64)[:, None] * b[None]) & np.uint64(bits - 1)).astype(np.int64)


class Filter:
    def __init__(self, bits: int):
        self.bits = bits
        self.data = np.zeros(bits >> 3, np.uint8)

    def holds(self, at: np.ndarray) -> np.ndarray:
        return ((self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=0)

    def add(self, at: np.ndarray) -> None:
        flat = at.ravel()
        np.bitwise_or.at(self.data, flat >> 3, np.uint8(1) << (flat & 7).astype(np.uint8))


ASKED = "bucket int, digests binary, docs binary, marks binary"


def window_rows(digests: np.ndarray, docs: np.ndarray, buckets: int) -> Iterator[tuple]:
    """ASKED rows of one window: of each bucket the digests that one document of the window holds, and marks of
    those that several hold; and, under bucket -1, the latter with all their documents."""
    order = np.argsort(digests["a"], kind="stable")
    digests, docs = digests[order], docs[order]
    same = digests["a"][1:] == digests["a"][:-1]
    several = np.r_[False, same] | np.r_[same, False]
    if several.any():
        yield -1, digests[several].tobytes(), docs[several].tobytes(), b""
    marks = digests[several & ~np.r_[False, same]]
    digests, docs = digests[~several], docs[~several]
    shift = np.uint64(64 - (buckets - 1).bit_length())
    starts = np.arange(buckets, dtype=np.uint64) << shift
    at, mark_at = np.searchsorted(digests["a"], starts), np.searchsorted(marks["a"], starts)
    ends, mark_ends = np.r_[at[1:], len(digests)], np.r_[mark_at[1:], len(marks)]
    for i in np.flatnonzero((ends > at) | (mark_ends > mark_at)).tolist():
        yield i, digests[at[i] : ends[i]].tobytes(), docs[at[i] : ends[i]].tobytes(), marks[mark_at[i] : mark_ends[i]].tobytes()


def suspects(chunks: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(digests, docs) of one bucket that its filter "seen twice" suspects; chunks: (digests, docs, marks)."""
    n = sum(len(d) + len(m) for d, _, m in chunks)
    bits = max(64, 1 << int(n * BITS_PER_LINE).bit_length())
    once, twice = Filter(bits), Filter(bits)
    for digests, _, marks in chunks:
        at = _bits(digests, bits)
        twice.add(at[:, once.holds(at)])
        once.add(at)
        at = _bits(marks, bits)
        twice.add(at)
        once.add(at)
    for digests, docs, _ in chunks:
        hit = twice.holds(_bits(digests, bits))
        yield digests[hit], docs[hit]


def _pairs(digests: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
    raw = pa.py_buffer(np.ascontiguousarray(digests).tobytes())
    return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(digests), [None, raw]).cast(pa.binary())], ["doc", "key"])


def suspected(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text. doc, key (digest) of every line that may be a repeat; each document's once."""
    n = docs.select(F.sum(F.regexp_count(F.coalesce("text", F.lit("")), F.lit("\n")) + 1)).first()[0] or 0
    buckets = max(LEAST_BUCKETS, 1 << (n // BUCKET_LINES).bit_length())

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, ids, held = [], [], 0

        def window() -> pa.RecordBatch:
            rows = list(window_rows(np.frombuffer(b"".join(found), DIGEST), np.repeat(*(np.array(x, np.int64) for x in zip(*ids, strict=True))), buckets))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *[pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2, 3)]], ["bucket", "digests", "docs", "marks"])

        for batch in batches:
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys = [digest(k) for k in set(keys_of(t.as_py())) if long_enough(k)]
                if keys:
                    found += keys
                    ids.append((LAST if d is None else d, len(keys)))
                    held += len(keys)
                if held >= WINDOW:
                    yield window()
                    found, ids, held = [], [], 0
        if held:
            yield window()

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, chunks = None, []
        for batch in batches:
            for bucket, a, b, m in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now:
                    yield from (_pairs(*x) for x in suspects(chunks) if len(x[0]))
                    now, chunks = bucket, []
                chunks.append((np.frombuffer(a, DIGEST), np.frombuffer(b, np.int64), np.frombuffer(m, DIGEST)))
        yield from (_pairs(*x) for x in suspects(chunks) if len(x[0]))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield _pairs(np.frombuffer(a, DIGEST), np.frombuffer(b, np.int64))

    asked = saved(map_batches(docs, ask, ASKED), "line-digests")
    dealt = asked.where("bucket >= 0").repartition("bucket").sortWithinPartitions("bucket")
    pairs = "doc long, key binary"
    return map_batches(dealt, sift, pairs).union(map_batches(asked.where("bucket < 0").select("digests", "docs"), own, pairs))


def dedup_lines(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text (without the dropped lines), n_lines, n_dropped of every row."""
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    held = saved(suspected(docs), "suspects")
    # written, so that both sides of the join are plain exchanges, which the planner can split by skew
    repeats = saved(held.groupBy("key").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last"), "repeats")
    drops = held.join(repeats, "key").where("doc <> first").groupBy("doc").agg(F.collect_set("key").alias("drop"))  # a document's own lines

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lines, dropped = [], [], []
            for t, drop in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                t = t.as_py() or ""
                own = t.split("\n")
                if drop:
                    drop = set(drop)
                    kept = [x for x, k in zip(own, keys_of(t), strict=True) if not (long_enough(k) and digest(k) in drop)]
                    t = "\n".join(kept)
                    dropped.append(len(own) - len(kept))
                else:
                    dropped.append(0)
                lines.append(len(own))
                texts.append(t)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], ["doc_id", "text", "n_lines", "n_dropped"])

    joined = docs.join(drops, F.coalesce("doc_id", F.lit(LAST)) == F.col("doc"), "left").select("doc_id", "text", "drop")
    return map_batches(joined, cut, "doc_id long, text string, n_lines long, n_dropped long")
