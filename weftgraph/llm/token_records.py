"""Token ids as length-delimited binary records, with a separate index of offsets.

File format. A shard `<n>-<attempt>.rec` is a run of records, each framed as
    u64 length | u32 masked crc32 of those 8 bytes | body | u32 masked crc32 of the body
with little-endian numbers; the mask is ((crc >> 15 | crc << 17) + 0xa282ead8) mod 2^32, so that the
checksum of data that holds checksums stays strong. A body is
    i64 doc_id | u8 flags (1: doc_id is null, 2: ids are u32, else u16) | ids
The index `<n>-<attempt>.idx` has one entry per record: u64 offset | u64 ids before it in the shard |
i64 doc_id | u32 number of ids. A shuffled read takes entries in any order and seeks.

Rows are dealt by ranges of (doc_id, text hash), so shards in order are ascending in doc_id, and rows of
one doc_id, however many, may fill several shards. Tasks write under names of their own and return
them; the manifest table lists those that the finished job returned, so files of lost or repeated
attempts are never read. Rows with equal doc_id are all written, next to one another, those without a
text first and the others in the order of their texts' hashes; null doc_id first; null text: empty.
Texts of any length are encoded in pieces that end at white space. An empty table: an empty manifest,
and no rows read back. Extra columns, whatever their names, aren't read.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import file_system, map_batches, new_dir
from .token_count import byte_symbols

ENTRY = np.dtype([("offset", "<u8"), ("start", "<u8"), ("doc_id", "<i8"), ("n", "<u4")])
MANIFEST = "shard int, path string, n_docs long, n_tokens long, n_bytes long"
#: Words a worker remembers (about 200 bytes each); the older half goes when it is full.
CACHE_WORDS = 800_000
#: Characters of a text that is handed to the library's model at once.
PIECE = 1 << 20
#: The steps of the vocabulary file that the plain path below follows.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
#: Lower-case letters, digits and white space up to U+017F; general punctuation has none of them.
_LETTERS, _DIGITS, _WHITE = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u017f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_TOKENS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^{_WHITE}{_LETTERS}{_DIGITS}]+")
#: What the plain path doesn't take: U+0130 has two lower-case characters, the rest is outside the ranges.
_FOREIGN = re.compile("[^\0-\u012f\u0131-\u017f\u2010-\u2027\u2030-\u205e\u20ac]")
_SHOWN = dict(enumerate(byte_symbols()))
_SPACE = re.compile("[ \t-\r]")


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def framed(body: bytes) -> bytes:
    head = struct.pack("<Q", len(body))
    return b"".join((head, struct.pack("<I", masked(head)), body, struct.pack("<I", masked(body))))


def unframed(data: bytes, at: int = 0) -> tuple[bytes, int]:
    """(body, offset of the next record); ValueError where a checksum fails."""
    head = data[at : at + 8]
    (n,) = struct.unpack("<Q", head)
    if masked(head) != struct.unpack_from("<I", data, at + 8)[0]:
        raise ValueError(f"bad length checksum at {at}")
    body = data[at + 12 : at + 12 + n]
    if masked(body) != struct.unpack_from("<I", data, at + 12 + n)[0]:
        raise ValueError(f"bad body checksum at {at}")
    return body, at + 16 + n


class WordEncoder:
    """Ids of whole texts by a tokenizers file of lower-cased words, the library called once for each
    distinct pre-token.

    A text of Latin letters and usual marks is normalised and cut here as the file says (its letters
    and classes are plain in that range); pre-tokens that aren't remembered go to the library's model
    many to a call. Any other text is cut at white space, which such a tokenizer never joins across,
    and its pieces go through the whole library. Texts that hold a special token go through it as
    they are.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.cache: dict[str, bytes] = {}
        self.cache_words = cache_words
        vocab = self.library.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        self.ends_word[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.kind = "<u2" if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
        # the same model for pre-tokens that are normalised and cut already
        self.model = Tokenizer.from_file(path)
        self.model.normalizer = normalizers.Sequence([])
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = [re.escape(t["content"]) for t in spec.get("added_tokens", [])]
        self.special = re.compile("|".join(special) or "(?!)")
        self.plain = spec["normalizer"] == NORMALIZER and spec["pre_tokenizer"] == PRE_TOKENIZER and spec["model"]["end_of_word_suffix"] == "</w>"

    def _learn_tokens(self, tokens: list[str]) -> None:
        """Remembers the ids of pre-tokens: joined by spaces and split again at the ids that end a word."""
        size = np.dtype(self.kind).itemsize
        shown = [t if t.isascii() and t.isprintable() else t.encode().decode("latin-1").translate(_SHOWN) for t in tokens]
        runs = range(0, len(tokens), 500)
        for lo, e in zip(runs, self.model.encode_batch_fast([" ".join(shown[lo : lo + 500]) for lo in runs], add_special_tokens=False), strict=True):
            some, ids = tokens[lo : lo + 500], np.array(e.ids, self.kind)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) != len(some):  # a token that no merge ends
                self._learn_pieces(some)
                continue
            raw, at = ids.tobytes(), 0
            for t, end in zip(some, (ends * size).tolist(), strict=True):
                self.cache[t] = raw[at:end]
                at = end

    def _learn_pieces(self, pieces: list[str], mark: str = "") -> None:
        for x, e in zip(pieces, self.library.encode_batch_fast(pieces, add_special_tokens=False), strict=True):
            self.cache[mark + x] = np.array(e.ids, self.kind).tobytes()

    def _pieces(self, pieces: list[str], plain: bool) -> list[bytes]:
        """Ids of distinct pieces; those of foreign texts are remembered behind a line feed, which no piece has."""
        cache = self.cache
        if len(cache) > self.cache_words:
            for k in list(cache)[: len(cache) // 2]:
                del cache[k]
        if not plain:
            pieces = ["\n" + x for x in pieces]
        out = list(map(cache.get, pieces))
        missing = [i for i, x in enumerate(out) if x is None]
        if missing and plain:
            cut = {i: _TOKENS.findall(p) for i in missing if not (p := pieces[i]).isalpha()}
            wanted = {pieces[i] for i in missing if i not in cut}
            wanted.update(t for tokens in cut.values() for t in tokens if t not in cache)
            self._learn_tokens(list(wanted))
            for i, tokens in cut.items():
                cache[pieces[i]] = b"".join([cache[t] for t in tokens])
        elif missing:
            self._learn_pieces([pieces[i][1:] for i in missing], "\n")
        for i in missing:
            out[i] = cache[pieces[i]]
        return out

    def _encoded(self, texts: list[str], plain: bool) -> Iterator[np.ndarray]:
        """Ids of each text: the distinct pieces of all are looked up, then gathered for every place."""
        lists = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        found = lists.flatten().dictionary_encode()
        held = self._pieces(found.dictionary.to_numpy(zero_copy_only=False).tolist(), plain)
        ids = np.frombuffer(b"".join(held), self.kind)
        sizes = np.fromiter(map(len, held), np.int64, len(held)) // ids.itemsize
        starts, at = np.cumsum(sizes) - sizes, found.indices.to_numpy()
        n = sizes[at]
        ends = np.cumsum(n)
        out = ids[np.repeat(starts[at] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.r_[0, ends][lists.offsets.to_numpy()]
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            yield out[lo:hi]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        out: list = [None] * len(texts)
        groups: dict[bool, tuple[list[int], list[str]]] = {True: ([], []), False: ([], [])}
        for i, t in enumerate(texts):
            if "<" in t and self.special.search(t):
                out[i] = np.array(self.library.encode(t, add_special_tokens=False).ids, self.kind).tobytes()
                continue
            plain = self.plain and (t.isascii() or not _FOREIGN.search(t))
            groups[plain][0].append(i)
            groups[plain][1].append(t.lower().replace("\x85", " ").replace("\xa0", " ") if plain else t)
        for plain, (where, some) in groups.items():
            if some:
                for i, ids in zip(where, self._encoded(some, plain), strict=True):
                    out[i] = ids.tobytes()
        return out

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """In groups of about PIECE characters; a longer text in pieces that end at white space."""
        group, size = [], 0
        for text in texts:
            if group and size + len(text) > PIECE:
                yield from self.encode_batch(group)
                group, size = [], 0
            if len(text) > PIECE:
                yield self.encode(text)
                continue
            group.append(text)
            size += len(text)
        yield from self.encode_batch(group)

    def encode(self, text: str) -> bytes:
        if len(text) <= PIECE or self.special.search(text):
            return self.encode_batch([text])[0]
        out, at = [], 0
        while at < len(text):
            found = _SPACE.search(text, at + PIECE)
            end = found.start() if found else len(text)
            out += self.encode_batch([text[at:end]])
            at = end
        return b"".join(out)


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One per worker process and file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def write_token_records(df: DataFrame, tokenizer: str, end_id: int | None = 2, *, doc_id: str = "doc_id", text: str = "text", order: list[Column] | None = None, directory: str | None = None) -> DataFrame:
    """Writes the records of all rows in ascending doc_id order, or in that of the `order` columns, and
    returns the manifest, one row per shard in order."""
    spark = df.sparkSession
    directory = directory or new_dir(spark, "records")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, enc = TaskContext.get().partitionId(), encoder(tokenizer)
        end = b"" if end_id is None else np.array([end_id], enc.kind).tobytes()
        wide, size = 2 * (enc.kind == "<u4"), np.dtype(enc.kind).itemsize
        system, root = file_system(directory)
        system.create_dir(root, recursive=True)
        name = f"{root}/{shard:06d}-{uuid.uuid4().hex}"
        n_docs = n_tokens = at = 0
        out = index = None
        for batch in batches:
            if out is None and batch.num_rows:
                out, index = system.open_output_stream(f"{name}.rec"), system.open_output_stream(f"{name}.idx")
            for key, ids in zip(batch.column(0).to_pylist(), enc.encode_all(t.as_py() or "" for t in batch.column(1)), strict=True):
                ids += end
                record = framed(struct.pack("<qB", key or 0, (key is None) + wide) + ids)
                n = len(ids) // size
                entry = np.array([(at, n_tokens, key or 0, n)], ENTRY)
                out.write(record)
                index.write(entry.tobytes())
                n_docs, n_tokens, at = n_docs + 1, n_tokens + n, at + len(record)
        if out is not None:
            out.close()
            index.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [name], "n_docs": [n_docs], "n_tokens": [n_tokens], "n_bytes": [at]})

    order = order or [F.col(doc_id).cast("long")]
    keys = [f"_k{i}" for i in range(len(order) + 2)]
    rows = df.select(*[c.alias(k) for c, k in zip([*order, F.col(text).isNotNull(), F.xxhash64(F.col(text))], keys, strict=True)], F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys, "text").select("doc_id", "text")
    map_batches(rows, write, MANIFEST).write.parquet(f"{directory}/manifest")
    scheme = directory.split("://", 1)[0]
    shards = spark.read.parquet(f"{directory}/manifest")
    return shards.withColumn("path", F.when(F.col("path").contains("://"), F.col("path")).otherwise(F.concat(F.lit(f"{scheme}://"), F.col("path"))))


def read_token_records(manifest: DataFrame, per_task: int = 20_000) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every record.

    A task reads a run of `per_task` records: the index gives it the byte range. Both checksums of
    every record and its index entry are verified."""
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per shard
    runs = manifest.withColumn("base", before).withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_docs") - 1, F.lit(per_task).cast("long"))))
    tasks = manifest.agg(F.sum(F.ceil(F.col("n_docs") / per_task))).first()[0] or 1
    # a stated number of partitions, which the planner doesn't coalesce: a run is a task's work however small its row is
    runs = runs.select("path", "base", "first").repartitionByRange(int(tasks), "base", "first")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, path = file_system(row["path"])
                with system.open_input_file(f"{path}.idx") as f:
                    size = f.size()
                    f.seek(row["first"] * ENTRY.itemsize)
                    raw = f.read((per_task + 1) * ENTRY.itemsize)
                    entries = np.frombuffer(raw, ENTRY)
                last = row["first"] + len(entries) == size // ENTRY.itemsize and len(entries) <= per_task
                use = entries[:per_task]
                with system.open_input_file(f"{path}.rec") as f:
                    end = f.size() if last else int(entries[len(use)]["offset"])
                    step, i = 1000, 0
                    while i < len(use):
                        part = use[i : i + step]
                        lo = int(part[0]["offset"])
                        hi = int(use[i + step]["offset"]) if i + step < len(use) else end
                        f.seek(lo)
                        data = f.read(hi - lo)
                        ids, starts, counts, sums = [], [], [], []
                        for e in part:
                            body, _ = unframed(data, int(e["offset"]) - lo)
                            key, flags = struct.unpack_from("<qB", body)
                            tokens = np.frombuffer(body, "<u4" if flags & 2 else "<u2", offset=9)
                            if len(tokens) != e["n"]:
                                raise ValueError(f"index and record differ in {path} at {e['offset']}")
                            ids.append(None if flags & 1 else key)
                            starts.append(row["base"] + int(e["start"]))
                            counts.append(len(tokens))
                            sums.append(zlib.crc32(tokens.astype("<u4").tobytes()))
                        yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "start": pa.array(starts, pa.int64()), "n_tokens": pa.array(counts, pa.int64()), "ids_crc32": pa.array(sums, pa.int64())})
                        i += step

    return map_batches(runs, read, "doc_id long, start long, n_tokens long, ids_crc32 long")
