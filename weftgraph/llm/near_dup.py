"""Near duplicates by tensored MinHash banding, every candidate verified on full shingle sets.

A document's set: its distinct 5-word shingles (A-Z lower-cased, split at ASCII white space); with
fewer words the whole sequence as one; without words empty, and linked with nothing. Documents with
a Jaccard similarity of 0.75 or more are linked; components of links are groups.

1. Equal sets collapse to a class (aggregation by a 128-bit digest of the set), so copies, however
   many, cost one row per task after the map-side combine.
2. Tensored banding: two collections of SIDE small sketches (PAIR minhashes each) give SIDE * SIDE
   table keys from 2 * SIDE * PAIR minhashes instead of SIDE * SIDE * 2 * PAIR. A pair shares a key if
   it agrees on any left and any right sketch; at similarity 0.75 it is missed with a chance below
   (1 - .75^PAIR)^SIDE * 2 = 1e-4. A sketch that only one class holds can't be part of a shared key,
   so keys are formed only from sketches that at least two classes hold.
3. Buckets are resolved without all pairs: first the class of each bucket that meets most others in
   all buckets, against the bucket's others. Verified links give components. The classes in buckets
   that still hold several components go on under exact keys: the rarest shingles of each set (the
   prefix filter with its position bound, which no pair of the similarity escapes), in rounds of 64,
   1024, ... pivots a key until no key holds two components with unmet members. Nothing is capped.
4. Components: alternating large-star and small-star rounds on minimum neighbours (aggregations with
   map-side combine), checkpointed, so a hub of any degree is never gathered in one task.

Result per row of the input: doc_id, n_shingles, component_id (smallest doc_id reachable), kept.
Rows with equal doc_id are one row each; such a document is linked by any of its sets. A null doc_id is its own group, is kept
and links nothing. An empty table gives an empty result. A text of any length is one set, held in memory by
the task that makes or compares it (8 bytes a distinct shingle). Extra columns, whatever their names, aren't
read by `near_duplicates` and pass through `keep_representatives`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .common import map_batches, saved, shared_dir

WORDS, SIDE, PAIR = 5, 12, 2
PERCENT = 75
_U = np.uint64
#: Odd multipliers of the word positions and of the minhash functions, from a fixed generator.
_RNG = np.random.Generator(np.random.PCG64(2024))
_POSITION = _RNG.integers(1, 1 << 63, WORDS, dtype=_U) * _U(2) + _U(1)
_MULT = _RNG.integers(1, 1 << 63, 2 * SIDE * PAIR, dtype=_U) * _U(2) + _U(1)
_ADD = _RNG.integers(0, 1 << 63, 2 * SIDE * PAIR, dtype=_U)
SIGNATURE = "doc_id long, n_shingles long, set_key binary, sketches array<long>"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_hashes(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles. bytes.lower() and bytes.split() are
    exactly the A-Z and the white space rule."""
    from xxhash import xxh3_64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, _U)
    h = np.fromiter(map(xxh3_64_intdigest, words), _U, len(words))
    k = min(WORDS, len(h))
    n = len(h) - k + 1
    total = np.full(n, k, _U)
    for i in range(k):
        total = _mixed(total ^ (h[i : i + n] * _POSITION[i]))
    return np.unique(total)


def sketches(shingles: np.ndarray) -> np.ndarray:
    """2 * SIDE values, each a mix of PAIR minhashes; long sets go through in pieces."""
    low = np.full(len(_MULT), np.iinfo(_U).max, _U)
    for i in range(0, len(shingles), 4096):
        low = np.minimum(low, ((shingles[None, i : i + 4096] ^ _ADD[:, None]) * _MULT[:, None]).min(axis=1))
    out = np.arange(2 * SIDE, dtype=_U) + _U(1)
    for j in range(PAIR):
        out = _mixed(out ^ low[j::PAIR])
    return out


def _sliced(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Arrow's batches in smaller ones: shingles take several times the room of their text."""
    for whole in batches:
        for lo in range(0, whole.num_rows, rows):
            yield whole.slice(lo, rows)


def signatures(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text. One row each with its set's size, digest and sketches."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            size, key, sketch = [], [], []
            for text in batch.column(1):
                s = shingle_hashes(text.as_py())
                size.append(len(s))
                key.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                sketch.append(sketches(s).view(np.int64) if len(s) else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(key, pa.binary()), pa.array(sketch, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_key", "sketches"])

    return map_batches(docs, sign, SIGNATURE)


def shingle_sets(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text. doc_id, shingles (array<long>)."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_hashes(t.as_py()).view(np.int64) for t in batch.column(1)], pa.list_(pa.int64()))], ["doc_id", "shingles"])

    return map_batches(docs, sets, "doc_id long, shingles array<long>")


def _edges(df: DataFrame) -> DataFrame:
    return df.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """links: u, v (long). node, component (smallest node reachable), for the nodes of links."""
    edges = cut(_edges(links))
    while True:
        # large star: every larger neighbour of a node moves to the smallest of the neighbourhood
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = cut(_edges(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))))
        # small star: every smaller neighbour, and the node itself
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
        edges = cut(_edges(small))
        # done when every node that isn't a root hangs on one root: no node is both, none hangs on two
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("root")).union(edges.select("v", F.lit(0), F.lit(1)))
        open_nodes = ends.groupBy("node").agg(F.sum("child").alias("children"), F.max("root").alias("root")).where("children > 1 or (children = 1 and root = 1)")
        if open_nodes.isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())


def joined_components(comp: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components after more links: only the components that the new links join are worked on."""
    if comp is None:
        return components(links)
    of = lambda c: F.coalesce(F.col(f"c{c}"), F.col(c))
    new = links.join(comp.select(F.col("node").alias("u"), F.col("component").alias("cu")), "u", "left").join(comp.select(F.col("node").alias("v"), F.col("component").alias("cv")), "v", "left")
    moved = components(new.select(of("u").alias("u"), of("v").alias("v")))
    old = comp.join(moved.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return old.union(moved.join(comp.select("node"), "node", "left_anti"))


def _possible() -> Column:
    """Whether two rows of one key can have the similarity: their overlap is at most the smaller `room`,
    what a set has from that key on (for the banding's keys the whole set)."""
    return (100 + PERCENT) * F.least("room", "p_room") >= PERCENT * (F.col("n") + F.col("p_n"))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs: u, v. Those whose full sets have the similarity. A class that is the pivot of many
    pairs is a skewed key of the first join; the adaptive skew join splits the pairs."""
    left = sets.select(F.col("doc_id").alias("u"), F.col("shingles").alias("su"))
    right = sets.select(F.col("doc_id").alias("v"), F.col("shingles").alias("sv"))
    both = F.size(F.array_intersect("su", "sv"))
    return pairs.join(right, "v").join(left, "u").where(100 * both >= PERCENT * (F.size("su") + F.size("sv") - both)).select("u", "v")


def prefix_keys(sets: DataFrame) -> DataFrame:
    """key, rep, n, room such that any two of `sets` with the similarity share a key: with all shingles in
    one order, rarest first, they share one among the first n - ceil(.75 n) + 1 of each, and the
    first they share leaves room for the overlap. A shingle that only one set has takes its place
    there but makes no key, so texts that have but a frequent passage in common don't meet."""
    n = F.size("shingles")
    each = sets.select(F.col("doc_id").alias("rep"), F.xxhash64("shingles").alias("set"), n.alias("n"), F.explode("shingles").alias("key"))
    often = each.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    own = Window.partitionBy("rep", "set")
    held = each.join(often, "key").withColumn("at", F.row_number().over(own.orderBy("df", "key"))).withColumn("m", F.count("*").over(own))
    return held.where(F.col("at") <= F.col("m") - F.ceil(F.col("n") * PERCENT / 100) + 1).select("key", "rep", F.col("n").cast("long").alias("n"), (F.col("m") - F.col("at") + 1).cast("long").alias("room"))


def near_duplicates(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    shared_dir(df.sparkSession)  # checkpoints go there
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = saved(signatures(docs), "signed")
    usable = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    classes = saved(signed.where(usable).groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sketches").alias("sketches")), "classes")

    half = classes.select("rep", "n", F.posexplode("sketches").alias("at", "half"))
    shared = half.groupBy("at", "half").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("at", "half")
    held = half.join(shared, ["at", "half"]).groupBy("rep", "n").agg(  # at most 2 * SIDE values a class
        F.collect_list(F.when(F.col("at") < SIDE, F.struct("at", "half"))).alias("a"), F.collect_list(F.when(F.col("at") >= SIDE, F.struct("at", "half"))).alias("b"))
    keyed = held.select("rep", "n", F.explode("a").alias("a"), "b").select("rep", "n", "a", F.explode("b").alias("b")).select(F.xxhash64("a", "b").alias("key"), "rep", "n")
    table = saved(keyed, "keys")

    def opened(rows: DataFrame) -> DataFrame:
        """rows: key, rep, n, room, comp. Those of buckets with several components (of buckets with the same
        members one), with each row's rank in its bucket: the class that meets most others comes first,
        as the text that copies were made from does."""
        buckets = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size"), F.sum(F.xxhash64("rep", "n", "room").cast("decimal(38,0)")).alias("mark"), F.min("rep").alias("first")).where("lo < hi")
        one = buckets.groupBy("size", "mark", "first").agg(F.min("key").alias("key")).select("key", "size")
        rows = cut(rows.join(one, "key"))
        met = rows.groupBy("rep").agg(F.sum("size").alias("met"))
        order = Window.partitionBy("key").orderBy(F.col("met").desc(), "rep", "n", "room")
        return cut(rows.join(met, "rep").withColumn("rank", F.row_number().over(order)).select("key", "rep", "n", "room", "comp", "rank"))

    table, comp, pivots, sets = opened(table.withColumn("room", F.col("n")).withColumn("comp", F.col("rep"))), None, 1, None
    while not table.isEmpty():
        if sets is None:  # sets of the classes in any shared bucket, once
            ids = table.select(F.col("rep").alias("doc_id")).distinct()
            sets = saved(shingle_sets(docs.join(ids, "doc_id")).distinct(), "sets")
        first = table.where(F.col("rank") <= pivots).select("key", F.col("rep").alias("p_rep"), F.col("n").alias("p_n"), F.col("room").alias("p_room"), F.col("comp").alias("p_comp"), F.col("rank").alias("p_rank"))
        pairs = table.join(first, "key").where((F.col("rank") > F.col("p_rank")) & (F.col("comp") != F.col("p_comp")) & _possible())
        pairs = pairs.select(F.least("rep", "p_rep").alias("u"), F.greatest("rep", "p_rep").alias("v")).distinct()
        comp = cut(joined_components(comp, cut(verified(pairs, sets))))
        rest = table.where(F.col("rank") > pivots).join(comp, F.col("rep") == F.col("node"), "left").select("key", "rep", "n", "room", F.coalesce("component", "rep").alias("comp"))
        if pivots == 1:  # what a star didn't settle goes on under exact keys
            left = opened(rest).select(F.col("rep").alias("doc_id")).distinct()
            exact = prefix_keys(sets.join(left, "doc_id"))
            rest = exact.join(comp, F.col("rep") == F.col("node"), "left").select("key", "rep", "n", "room", F.coalesce("component", "rep").alias("comp"))
        table = opened(rest)
        pivots = max(64, pivots * 16)

    spark = df.sparkSession
    if comp is None:
        comp = spark.createDataFrame([], "node long, component long")
    by_class = classes.select("set_key", "rep").join(comp, F.col("rep") == F.col("node"), "left").select("set_key", F.coalesce("component", "rep").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", F.when(usable, F.col("set_key")).alias("set_key")).join(by_class, "set_key", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_representatives(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `df` whose document stands for its group, with the columns of `df`. Of rows with
    one doc_id all stay if it stands for a group."""
    gone = near_duplicates(df, doc_id=doc_id, text=text).groupBy("doc_id").agg(F.max("kept").alias("kept")).where("not kept").select(F.col("doc_id").alias("_gone"))
    names = [f"_c{i}" for i in range(len(df.columns))]
    inner = df.toDF(*names)
    return inner.join(gone, inner[names[df.columns.index(doc_id)]].cast("long") == gone["_gone"], "left_anti").toDF(*df.columns)
