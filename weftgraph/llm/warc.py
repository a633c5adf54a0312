"""WARC archives: writing pages as gzip-member records, and a splittable reader.

Writing. Payloads of at least MIN_REVISIT bytes that several pages share are stored once, by the
smallest page_id; the others become `revisit` records that refer to it. Pages are first reduced to
(page_id, digest); only those narrow rows are grouped, so a payload that a third of all pages share
costs each task one row. Then each page meets its record type by (page_id, digest). Tasks write
archives of about ROTATE bytes under names of their own and return them; the manifest lists what the
finished job returned, so files of lost attempts are never read.

Reading. Archives are cut into byte ranges. A task scans its range for gzip magic, validates a candidate
member by decoding it (its own checksum, a WARC header, the content length, and the SHA-256 of a response's
payload), and from there goes from member to member; it owns the records that start inside its range and
reads past the range's end to finish the last one. A candidate is judged by itself alone, so what is
found doesn't depend on where ranges begin, nor on damage before or behind a record. Bytes that belong
to no record are skipped; `skipped_bytes` counts them for each archive.

Null html: empty payload. A page_id of null: always a response, and never referred to. Rows with equal
page_id and payload: all responses or all revisits of a smaller page_id. A payload of any length is one
record, held in memory while it is written and read; records that are longer than a range are read by
the task in whose range they start. An empty table: no archives, no records. Extra columns, whatever
their names, aren't read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import file_system, map_batches, new_dir, saved

MIN_REVISIT = 100
ROTATE, SPLIT, READ = 256 << 20, 32 << 20, 1 << 20
MAGIC = b"\x1f\x8b\x08"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, archive string, offset long, member_bytes long"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page_of(urn: str) -> int | None:
    x = urn.rsplit(":", 1)[1].rstrip(">")
    return None if x == "none" else int(x)


def _one_line(text: str | None) -> str:
    return (text or "").replace("\r", "%0D").replace("\n", "%0A")


def member(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzip member: WARC header, HTTP header, and the payload unless it is a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", "WARC-Date: 2024-01-01T00:00:00Z"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_one_line(url)}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    raw = "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def parsed(raw: bytes) -> tuple:
    """The RECORD fields, up to the payload, of a decoded member; ValueError if it isn't a whole record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    if not {"Content-Length", "WARC-Type", "WARC-Payload-Digest", "WARC-Record-ID"} <= fields.keys():
        raise ValueError("a field is missing")
    n = int(fields["Content-Length"])
    if len(rest) != n + 4:
        raise ValueError(f"record {fields.get('WARC-Record-ID')}: content length {n}, found {len(rest) - 4}")
    http, _, payload = rest[:n].partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']}: payload doesn't match its digest")
    return _page_of(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), size, digest, kind, _page_of(fields["WARC-Refers-To"]) if kind == "revisit" else None, payload if kind == "response" else None


def write_warc(df: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", directory: str | None = None) -> DataFrame:
    """Writes all rows and returns the manifest: path, n_bytes, n_records of each archive."""
    directory = directory or new_dir(df.sparkSession, "warc")
    pages = df.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(html, F.lit("")).alias("html"))
    digest, size = F.sha2(F.col("html"), 256), F.octet_length("html")
    narrow = saved(pages.where(size >= MIN_REVISIT).where("page_id is not null").select("page_id", digest.alias("digest")), "digests")
    # written, so that both sides of the join are plain exchanges, which the planner can split by skew
    shared = saved(narrow.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").select("digest", "first"), "shared")
    revisits = narrow.join(shared, "digest").where("page_id <> first").select("page_id", F.col("digest").alias("_digest"), "first").distinct()
    typed = pages.withColumn("digest", digest).join(revisits.withColumnRenamed("page_id", "_id"), (F.col("page_id") == F.col("_id")) & (F.col("digest") == F.col("_digest")), "left").select("page_id", "url", "html", "digest", "first")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(directory)
        system.create_dir(root, recursive=True)
        out, path, size, n = None, "", 0, 0

        def entry() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"path": [path], "n_bytes": [size], "n_records": [n]})

        for batch in batches:
            for i, u, h, d, first in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if out is None:
                    path, size, n = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = system.open_output_stream(path, compression=None)
                data = member(i, u, h.encode("utf-8", "surrogatepass"), d, first)
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= ROTATE:
                    yield entry()
                    out = None
        if out is not None:
            yield entry()

    map_batches(typed, write, "path string, n_bytes long, n_records long").write.parquet(f"{directory}/manifest")
    scheme = directory.split("://", 1)[0]
    made = df.sparkSession.read.parquet(f"{directory}/manifest")
    return made.withColumn("path", F.when(F.col("path").contains("://"), F.col("path")).otherwise(F.concat(F.lit(f"{scheme}://"), F.col("path"))))


class _Window:
    """Bytes of a file from any offset on, read ahead in pieces."""

    def __init__(self, file):
        self.file, self.size, self.at, self.data = file, file.size(), 0, b""

    def read(self, at: int, n: int = READ) -> bytes:
        if not (self.at <= at and at + n <= self.at + len(self.data)):
            self.file.seek(at)
            self.at, self.data = at, self.file.read(max(n, READ))
        return self.data[at - self.at : at - self.at + n]


def _decoded(w: _Window, at: int) -> tuple[tuple, int] | None:
    """(RECORD fields, end) of the gzip member at `at`; None if there is none or it isn't a whole record."""
    if w.read(at, 3) != MAGIC:
        return None
    unpack, out, pos, head = zlib.decompressobj(31), [], at, b""
    try:
        while not unpack.eof:
            data = w.read(pos, READ if head else 1 << 14)
            if not data:
                return None
            out.append(unpack.decompress(data))
            pos += len(data)
            if len(head) < 5:  # what doesn't begin like a record isn't decoded any further
                head = (head + out[-1])[:5]
                if not b"WARC/".startswith(head):
                    return None
        return parsed(b"".join(out)), pos - len(unpack.unused_data)
    except (zlib.error, ValueError, UnicodeDecodeError):
        return None


def records_from(file, start: int, stop: int) -> Iterator[tuple[int, int, tuple]]:
    """(offset, end, RECORD fields) of the records that start in [start, stop) of an open archive."""
    w = _Window(file)
    at = start
    while at < min(stop, w.size):
        if (got := _decoded(w, at)) is not None:
            yield at, got[1], got[0]
            at = got[1]
            continue
        data = w.read(at + 1, READ)  # not a record's begin: on to the next magic
        k = data.find(MAGIC)
        at += 1 + (k if k >= 0 else max(1, len(data) - 2))


def read_warc(manifest: DataFrame, *, split: int = SPLIT, payload: bool = True) -> DataFrame:
    """All records of the archives that `manifest` (path, n_bytes) names, as RECORD."""
    ranges = manifest.where("n_bytes > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_bytes") - 1, F.lit(split).cast("long"))).alias("start"))
    tasks = manifest.agg(F.sum(F.ceil(F.col("n_bytes") / split))).first()[0] or 1
    # a stated number of partitions, which the planner doesn't coalesce: a range is a task's work however small its row is
    ranges = ranges.repartitionByRange(int(tasks), "path", "start")
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

        for batch in batches:
            for row in batch.to_pylist():
                system, path = file_system(row["path"])
                rows, held = [], 0
                with system.open_input_file(path) as f:
                    for at, end, x in records_from(f, row["start"], row["start"] + split):
                        rows.append((*(x if payload else (*x[:-1], None)), row["path"], at, end - at))
                        held += x[2] + 200 if payload else 200
                        if held >= 4 << 20:
                            yield flush(rows)
                            rows, held = [], 0
                if rows:
                    yield flush(rows)

    return map_batches(ranges, read, RECORD)


def skipped_bytes(manifest: DataFrame, records: DataFrame) -> DataFrame:
    """archive, skipped: bytes of each archive that belong to none of its records (0 for a sound one)."""
    held = records.groupBy(F.col("archive").alias("path")).agg(F.sum("member_bytes").alias("held"))
    return manifest.select("path", "n_bytes").join(held, "path", "left").select(F.col("path").alias("archive"), (F.col("n_bytes") - F.coalesce("held", F.lit(0))).alias("skipped"))
