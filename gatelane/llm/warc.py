"""WARC archives with a two-level capture index.

Tasks write one compressed member per record into archive files in a shared folder.
The capture index is sorted by reversed-host url key: each index part is a file of compressed
blocks, with a sparse directory that holds the first key and the place of every block. A lookup
searches the parts' first keys, then the part's directory, by bisection, reads one block by
its byte range, and the record by its own. No file is read from its beginning.

Files go through ``pyarrow.fs``, so the folder may be any store it knows (file, hdfs, s3, gs,
abfss). A task that runs again writes a file of its own name; only places reported by
the task that succeeded enter the index.
"""

from __future__ import annotations

import gzip
import json
import re
import uuid
import zlib
from bisect import bisect_right
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import store_of, written
from .url_reputation import host_of

LEAST_REVISIT = 100  # bytes from which an equal payload is stored once
BLOCK = 1_000  # index entries per compressed block
FILE_BYTES = 256 << 20
SPAN = 4 << 20  # neighbouring records are fetched in ranges up to this size
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"  # pages carry no capture time
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_ENTRY = "page_id {kind}, capture string, file string, offset bigint, length bigint"


_store = lru_cache(maxsize=4)(store_of)


def _open(root: str, name: str, write: bool = False):
    store, base = _store(root)
    return store.open_output_stream(f"{base}/{name}", compression=None) if write else store.open_input_file(f"{base}/{name}")


def _folder(root: str) -> str:
    store, base = _store(root)
    store.create_dir(base, recursive=True)
    return root


def capture_key(url: str, ident: str) -> Column:
    """Reversed host, the rest of the url, a space and the identifier: sorts captures of a host and its subdomains together."""
    text = F.coalesce(F.col(url), F.lit(""))
    rest = F.regexp_extract(text, r"(?s)^.*?://[^/?#]*(.*)$", 1)
    host = F.array_join(F.reverse(F.split(host_of(url), r"\.")), ",")
    return F.concat(host, F.lit(")"), rest, F.lit(" "), F.coalesce(F.col(ident).cast("string"), F.lit("")))


def record_urn(ident) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page:{ident}')}>"


def record(ident, url: str | None, payload: bytes, digest: str, refers_to=None) -> bytes:
    """One record as its own gzip member."""
    revisit = refers_to is not None
    block = HTTP.encode() + (b"" if revisit else payload)
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_urn(ident),
        "WARC-Date": DATE,
        "WARC-Target-URI": target,
        "WARC-Payload-Digest": f"sha256:{digest}",
        "Content-Type": "application/http;msgtype=response",
        "Content-Length": str(len(block)),
        "X-Page-Id": "" if ident is None else str(ident),
    }
    if revisit:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_urn(refers_to), "X-Refers-To-Page": str(refers_to)}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


def parse_record(member: bytes) -> tuple[dict[str, str], bytes | None]:
    """Headers, and the payload of a response."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    return headers, None if headers["WARC-Type"] == "revisit" else block.partition(b"\r\n\r\n")[2]


def with_refers_to(pages: DataFrame, ident: str = "page_id", html: str = "html") -> DataFrame:
    """Adds ``digest`` (SHA-256 of the payload) and ``refers_to`` (the response's identifier, for revisits).

    Rows with the smallest identifier of an equal payload are responses, and so are rows
    without identifier and payloads under ``LEAST_REVISIT`` bytes. Digests are grouped
    without the payloads; the payloads move once, by identifier.
    """
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    digests = pages.filter(F.col(ident).isNotNull() & (F.octet_length(body) >= LEAST_REVISIT)).select(
        F.col(ident).alias("_page"), F.sha2(body, 256).alias("_digest")
    )
    first = digests.groupBy("_digest").agg(F.min("_page").alias("refers_to"), F.max("_page").alias("_last")).filter("refers_to < _last")
    revisits = digests.join(first, "_digest").filter("_page > refers_to").select("_page", "_digest", "refers_to").distinct()
    full = pages.withColumn("digest", F.sha2(body, 256))
    return full.join(revisits, (F.col(ident) == F.col("_page")) & (F.col("digest") == F.col("_digest")), "left").drop("_page", "_digest")


def write_archives(pages: DataFrame, root: str, ident: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One record per row; ``page_id, capture, file, offset, length`` of each, as a written table.

    Needs the columns of ``with_refers_to``. Null payloads are empty, null urls too.
    """
    kind = pages.schema[ident].dataType.simpleString()
    _folder(root)

    def run(batches):
        context, out, name, size, turn = TaskContext.get(), None, None, 0, 0
        for batch in batches:
            places = []
            for page, address, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns[:5])):
                if out is None or size >= FILE_BYTES:
                    if out:
                        out.close()
                    name = f"{context.partitionId():06d}-{context.taskAttemptId()}-{turn}.warc.gz"
                    out, size, turn = _open(root, name, write=True), 0, turn + 1
                member = record(page, address, payload or b"", digest, refers_to)
                out.write(member)
                places.append((name, size, len(member)))
                size += len(member)
            files, offsets, lengths = zip(*places) if places else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(5), pa.array(files, pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())],
                ["page_id", "capture", "file", "offset", "length"],
            )
        if out:
            out.close()

    rows = pages.select(ident, url, F.col(html).cast("binary").alias("payload"), "digest", "refers_to", capture_key(url, ident).alias("capture"))
    return written(rows.mapInArrow(run, _ENTRY.format(kind=kind)), "captures")


@dataclass(frozen=True)
class CaptureIndex:
    """``parts``: first key and file of each index part, in key order (as many as shuffle partitions)."""

    root: str
    parts: tuple[tuple[str, str], ...]
    kind: str


def build_index(captures: DataFrame, root: str, block: int = BLOCK) -> CaptureIndex:
    """Sort captures by key into parts; each part is a file of blocks and a directory file."""
    spark = captures.sparkSession
    kind = captures.schema["page_id"].dataType.simpleString()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    _folder(root)

    def run(batches):
        context, directory, pending, out, size, name = TaskContext.get(), [], [], None, 0, None

        def flush():
            nonlocal out, size, name, pending
            if out is None:
                name = f"{context.partitionId():06d}-{context.taskAttemptId()}"
                out = _open(root, f"{name}.cdx.gz", write=True)
            data = gzip.compress("\n".join(map(json.dumps, pending)).encode(), 6, mtime=0)
            out.write(data)
            directory.append((pending[0][0], size, len(data)))
            size += len(data)
            pending = []

        for batch in batches:
            for entry in zip(*(c.to_pylist() for c in batch.columns)):
                pending.append(entry)
                if len(pending) >= block:
                    flush()
        if pending:
            flush()
        if out is not None:
            out.close()
            with _open(root, f"{name}.dir.gz", write=True) as file:
                file.write(gzip.compress(json.dumps(directory).encode(), 6, mtime=0))
            yield pa.RecordBatch.from_arrays([pa.array([directory[0][0]]), pa.array([name])], ["first", "name"])

    ordered = captures.select("capture", "page_id", "file", "offset", "length").repartitionByRange(
        parts, "capture", "file", "offset"
    ).sortWithinPartitions("capture", "file", "offset")
    found = ordered.mapInArrow(run, "first string, name string").collect()  # one row per part
    return CaptureIndex(root, tuple(sorted((r["first"], r["name"]) for r in found)), kind)


class IndexReader:
    """Finds captures by bisection; remembers the latest directories and blocks."""

    def __init__(self, index: CaptureIndex):
        self.index, self.firsts = index, [first for first, _ in index.parts]
        self.directory = lru_cache(maxsize=4)(self._directory)
        self.block = lru_cache(maxsize=4)(self._block)

    def _directory(self, part: int):
        with _open(self.index.root, f"{self.index.parts[part][1]}.dir.gz") as file:
            rows = json.loads(gzip.decompress(file.read()))
        return [r[0] for r in rows], rows

    def _block(self, part: int, at: int) -> dict[str, list]:
        _, offset, length = self.directory(part)[1][at]
        with _open(self.index.root, f"{self.index.parts[part][1]}.cdx.gz") as file:
            lines = gzip.decompress(file.read_at(length, offset)).split(b"\n")
        found: dict[str, list] = {}
        for line in lines:
            entry = json.loads(line)
            found.setdefault(entry[0], []).append(entry[1:])
        return found

    def find(self, capture: str) -> list:
        """All entries of one key; those may go on from an earlier block or part."""
        part = bisect_right(self.firsts, capture) - 1
        out = []
        while part >= 0:
            firsts = self.directory(part)[0]
            at = bisect_right(firsts, capture) - 1
            while at >= 0:
                out.extend(self.block(part, at).get(capture, ()))
                if firsts[at] != capture:
                    return out
                at -= 1
            part -= 1
        return out


def lookup(requests: DataFrame, index: CaptureIndex) -> DataFrame:
    """``page_id, capture, file, offset, length`` of all captures with the keys in column ``capture``.

    Requests are sorted by key over all tasks, so each block is read about once. Repeated
    requests count once; keys that were not captured return nothing.
    """
    parts = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[index.kind]
    types = [kind, pa.string(), pa.string(), pa.int64(), pa.int64()]

    def run(batches):
        reader = IndexReader(index) if index.parts else None
        for batch in batches:
            rows = [(e[0], key, *e[1:]) for key in batch.column(0).to_pylist() for e in (reader.find(key) if reader else ())]
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], ["page_id", "capture", "file", "offset", "length"]
            )

    sorted_keys = requests.select("capture").distinct().repartitionByRange(parts, "capture").sortWithinPartitions("capture")
    return sorted_keys.mapInArrow(run, _ENTRY.format(kind=index.kind))


def read_records(places: DataFrame, root: str, kind: str = "bigint") -> DataFrame:
    """``page_id, url, record_type, payload, digest, refers_to`` of the records at ``file, offset, length``.

    Places are sorted by file and offset; neighbouring ones are fetched in one range.
    """
    parts = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cast = (lambda v: v or None) if kind == "string" else (lambda v: int(v) if v else None)
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    names = ["page_id", "url", "record_type", "payload", "digest", "refers_to"]
    types = [arrow, pa.string(), pa.string(), pa.binary(), pa.string(), arrow]

    def spans(rows):
        group = []
        for row in rows:
            if group and (row[0] != group[0][0] or row[1] != group[-1][1] + group[-1][2] or row[1] + row[2] - group[0][1] > SPAN):
                yield group
                group = []
            group.append(row)
        if group:
            yield group

    def run(batches):
        name, file = None, None
        for batch in batches:
            for group in spans(zip(*(c.to_pylist() for c in batch.columns))):
                if group[0][0] != name:
                    if file:
                        file.close()
                    name, file = group[0][0], _open(root, group[0][0])
                base = group[0][1]
                data, out = file.read_at(group[-1][1] + group[-1][2] - base, base), []
                for _, offset, length in group:
                    head, payload = parse_record(data[offset - base : offset - base + length])
                    out.append((
                        cast(head["X-Page-Id"]), head["WARC-Target-URI"], head["WARC-Type"], payload,
                        head["WARC-Payload-Digest"].removeprefix("sha256:"), cast(head.get("X-Refers-To-Page", "")),
                    ))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
        if file:
            file.close()

    ordered = places.select("file", "offset", "length").repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(
        run, f"page_id {kind}, url string, record_type string, payload binary, digest string, refers_to {kind}"
    )


def archive_and_read(pages: DataFrame, ident: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write all pages, index them, look every page up and read it back.

    ``page_id, payload_bytes, payload_digest, record_type, refers_to`` per record; size and
    digest are measured on the payload that was read, a revisit's on its response's.
    """
    spark, pages = pages.sparkSession, pages.select(ident, url, html)
    archive, catalogue = scratch_path(spark, "llm-warc"), scratch_path(spark, "llm-cdx")
    captures = write_archives(with_refers_to(pages, ident, html), archive, ident, url, html)
    index = build_index(captures, catalogue)
    places = lookup(pages.select(capture_key(url, ident).alias("capture")), index)
    read = read_records(places, archive, index.kind)
    facts = written(
        read.select(
            "page_id", "record_type", "refers_to", "digest",
            F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"),
        ),
        "records",
    )
    responses = facts.filter("record_type = 'response' AND page_id IS NOT NULL").select(
        F.col("page_id").alias("_page"), F.col("payload_bytes").alias("_bytes"), F.col("payload_digest").alias("_digest")
    ).distinct()
    own = facts.filter("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    again = facts.filter("record_type = 'revisit'").join(
        responses, (F.col("refers_to") == F.col("_page")) & (F.col("digest") == F.col("_digest"))
    ).select("page_id", F.col("_bytes").alias("payload_bytes"), F.col("_digest").alias("payload_digest"), "record_type", "refers_to")
    return own.unionByName(again)
