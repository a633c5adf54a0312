"""Token counts by rank-synchronous array merging.

A byte-level BPE vocabulary (tokenizers .json) is loaded as arrays. Pre-tokens of a batch that have
not been met before are held as one ragged numpy array of symbols; in each round every pre-token's
lowest-ranked adjacent pair is merged at all its places at once, and the symbols that survive are
counted. In a trained merge list a pair is ranked after the pairs that make its parts, so the rounds
give what merging one pair at a time gives. A pre-token of over LONG symbols (a run of letters without any
space) keeps its places in buckets by rank instead, and after a round only the neighbours of merged
places are looked up again, so its cost grows with its length and not with length times rounds.

Text is split as the library does: at added special tokens first (each counts as one token), then by
the byte-level pattern. Pieces that the pattern never joins (a word with its leading space, or white
space) are remembered with their counts, in a bounded cache per worker.

Null or empty text: no tokens. Every row is counted for itself; order, ties, repeated rows and extra
columns, whatever their names, don't matter. A long text is counted in pieces of about PIECE characters that
end before a word's single space, where the library never joins, so its memory is bounded. An empty
table: empty.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: Fixed value: the byte-level pattern of this family of vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space as the pattern's \s has it; Python's differs by U+001C..U+001F.
_WHITE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: A word with one leading space, or a run of white space as the pattern cuts it.
_PIECE = re.compile(f" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]")
CACHE_PIECES = 1_200_000
#: Pieces are merged so many at a time; longer pre-tokens by themselves.
ROUND, LONG = 20_000, 256
#: Characters that are cut to pieces at once, and where a longer text may be cut.
PIECE = 1 << 20
_BETWEEN = re.compile(f"(?<=[^{_WHITE}]) (?=[^{_WHITE}])")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Sorted keys `left * size + right` of all merges, their ranks and what they make."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.size = max(vocab.values()) + 1
        key = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank = key[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)  # by rank
        self.byte_id = np.array([vocab[c] for c in byte_symbols()], np.int64)
        self.split = regex.compile(PATTERN, regex.V0).findall
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.cache: dict[str, int] = {}

    def merged_counts(self, tokens: list[bytes]) -> np.ndarray:
        """Symbols left of each pre-token (none empty)."""
        long = [i for i, t in enumerate(tokens) if len(t) > LONG]
        if long:
            out = np.zeros(len(tokens), np.int64)
            out[long] = [self.merged_count_of_long(tokens[i]) for i in long]
            rest = np.setdiff1d(np.arange(len(tokens)), long)
            if len(rest):
                out[rest] = self.merged_counts([tokens[i] for i in rest])
            return out
        none = len(self.key) + 1
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        symbols = self.byte_id[np.frombuffer(b"".join(tokens), np.uint8)]
        owner = np.repeat(np.arange(len(tokens)), lengths)
        counts = lengths.copy()
        while len(symbols) > 1:
            pair = symbols[:-1] * self.size + symbols[1:]
            at = np.minimum(np.searchsorted(self.key, pair), len(self.key) - 1)
            rank = np.where((self.key[at] == pair) & (owner[:-1] == owner[1:]), self.rank[at], none)
            rank = np.append(rank, none)
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            low = np.minimum.reduceat(rank, starts)
            low_of = np.repeat(low, np.diff(np.r_[starts, len(symbols)]))
            hit = (rank == low_of) & (low_of < none)
            if not hit.any():
                break
            # in a run of overlapping places (a a a) every other one from its start is taken
            place = np.flatnonzero(hit)
            run = np.cumsum(np.r_[True, np.diff(place) != 1])
            first = place[np.r_[True, run[1:] != run[:-1]]][run - 1]
            place = place[(place - first) % 2 == 0]
            symbols[place] = self.made[rank[place]]
            keep = np.ones(len(symbols), bool)
            keep[place + 1] = False
            # finished pre-tokens leave; the rest go on without the merged right parts
            counts -= np.bincount(owner[place], minlength=len(counts))
            keep &= low_of < none
            symbols, owner = symbols[keep], owner[keep]
        return counts

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left * self.size + right
        at = np.minimum(np.searchsorted(self.key, pair), len(self.key) - 1)
        return np.where(self.key[at] == pair, self.rank[at], len(self.key) + 1)

    def merged_count_of_long(self, token: bytes) -> int:
        """Symbols left of one long pre-token: places linked to their neighbours, in buckets by the rank of the
        pair that begins there; each round merges the lowest bucket."""
        symbols, none = self.byte_id[np.frombuffer(token, np.uint8)], len(self.key) + 1
        n = left = len(symbols)
        after, before = np.arange(1, n + 1), np.arange(-1, n)  # n: the end
        rank = np.append(self.ranks(symbols[:-1], symbols[1:]), none)
        buckets: dict[int, list[np.ndarray]] = {}
        order: list[int] = []

        def put(places: np.ndarray) -> None:
            places = places[rank[places] < none]
            places = places[np.argsort(rank[places], kind="stable")]
            cut = np.flatnonzero(np.diff(rank[places])) + 1
            for some in np.split(places, cut) if len(places) else ():
                r = int(rank[some[0]])
                if r not in buckets:
                    buckets[r] = []
                    heapq.heappush(order, r)
                buckets[r].append(some)

        put(np.arange(n))
        while order:
            r = heapq.heappop(order)
            places = np.unique(np.concatenate(buckets.pop(r)))
            places = places[rank[places] == r]
            if not len(places):
                continue
            if symbols[places[0]] == symbols[after[places[0]]]:  # in a run (a a a) every other one from its start
                run = np.cumsum(np.r_[True, after[places[:-1]] != places[1:]])
                start = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
                places = places[(np.arange(len(places)) - start[run - 1]) % 2 == 0]
            right = after[places]
            symbols[places] = self.made[r]
            rank[right] = none
            after[places] = after[right]
            before[after[places]] = places
            left -= len(places)
            touched = np.concatenate([places, before[places]])
            touched = np.unique(touched[touched >= 0])
            follow = after[touched]
            rank[touched] = np.where(follow < n, self.ranks(symbols[touched], symbols[np.minimum(follow, n - 1)]), none)
            put(touched)
        return left

    def learn(self, pieces: set[str]) -> None:
        if len(self.cache) + len(pieces) > CACHE_PIECES:
            for k in list(self.cache)[: len(self.cache) // 2]:
                del self.cache[k]
        every = list(pieces)
        for i in range(0, len(every), ROUND):
            some = every[i : i + ROUND]
            parts = [self.split(p) for p in some]
            counts = self.merged_counts([x.encode("utf-8", "surrogatepass") for p in parts for x in p])
            ends = np.cumsum([len(p) for p in parts])
            totals = np.diff(np.r_[0, np.cumsum(counts)[ends - 1]])
            self.cache.update(zip(some, totals.tolist(), strict=True))

    def count_texts(self, texts: Iterable[str | None]) -> list[int]:
        """Tokens of each text; texts and pieces of long ones go through in groups of about PIECE characters."""
        totals: list[int] = []
        group: list[str] = []
        owner: list[int] = []
        size = 0

        def flush() -> None:
            for i, c in zip(owner, self.count_batch(group), strict=True):
                totals[i] += c

        for text in texts:
            totals.append(0)
            text, at = text or "", 0
            while at < len(text):
                found = _BETWEEN.search(text, at + PIECE) if len(text) - at > PIECE else None
                end = found.start() if found else len(text)
                group.append(text[at:end])
                owner.append(len(totals) - 1)
                size += end - at
                at = end
                if size >= PIECE:
                    flush()
                    group, owner, size = [], [], 0
        flush()
        return totals

    def count_batch(self, texts: list[str | None]) -> list[int]:
        cut, extra = [], []
        for t in texts:
            segments = self.special.split(t) if t and self.special else [t or ""]
            extra.append(len(segments) - 1)
            cut.append([x for s in segments for x in _PIECE.findall(s)])
        get = self.cache.get
        found = [list(map(get, pieces)) for pieces in cut]
        missing = {p for pieces, c in zip(cut, found, strict=True) if None in c for p, x in zip(pieces, c, strict=True) if x is None}
        if missing:
            known = {p: x for pieces, c in zip(cut, found, strict=True) for p, x in zip(pieces, c, strict=True) if x is not None} if len(self.cache) + len(missing) > CACHE_PIECES else self.cache
            self.learn(missing)
            known = self.cache if known is self.cache else known | {p: self.cache[p] for p in missing}
            found = [[known[p] for p in pieces] if None in c else c for pieces, c in zip(cut, found, strict=True)]
        return [sum(c) + n for c, n in zip(found, extra, strict=True)]


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One per worker process and file."""
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def token_counts(df: DataFrame, tokenizer: str, *, limit: int = 512, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(tokenizer)
        for batch in batches:
            n = v.count_texts(t.as_py() for t in batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).alias("text"))
    out = map_batches(rows, count, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
