"""WARC archives: a deduplicating writer, and a reader whose tasks scan byte ranges for gzip members."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterloom.llm.common import pick, shared_dir
from clusterloom.llm.files import opened, splits, write_files

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
DATE = "1970-01-01T00:00:00Z"  # pages carry no time; a fixed one keeps archives reproducible
READ = 1 << 20


class Damaged(ValueError):
    """Bytes of an archive that no record decodes from."""


def with_revisits(pages: DataFrame, least: int = 100) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): refers_to is null for responses.

    Of the rows with equal payloads of ``least`` bytes or more, the smallest page id is the response (all its rows, if
    it is repeated); null ids never are, unless all are null.
    """
    own = pages.select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    own = own.withColumn("digest", F.sha2("payload", 256))
    long = F.octet_length("payload") >= least
    first = own.where(long).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("same")).where("same > 1")
    # Short payloads look for no other: they are dealt evenly under keys that match nothing.
    key = F.when(long, F.col("digest")).otherwise(F.concat(F.lit("-"), F.pmod(F.xxhash64("page_id"), F.lit(65536)).cast("string")))
    first = first.select(F.col("digest").alias("key"), "first_id")
    return own.withColumn("key", key).join(first, "key", "left").select(
        "page_id", "url", "payload", "digest", F.when(F.coalesce(F.col("first_id") != F.col("page_id"), F.col("first_id").isNotNull()), F.col("first_id")).alias("refers_to")
    )


def member(page_id, url: str | None, payload: bytes, digest: str, refers_to, level: int = 3) -> bytes:
    """One record as one gzip member. Its bytes hold no other record's start, so no split can mistake one."""
    heads = [f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        heads.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~-._"))
    heads.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
        heads += ["WARC-Type: response", "Content-Type: application/http; msgtype=response"]
    else:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        heads += ["WARC-Type: revisit", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>", "Content-Type: application/http; msgtype=response"]
    heads.append(f"Content-Length: {len(block)}")
    record = VERSION + "\r\n".join(heads).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    for strategy in (zlib.Z_DEFAULT_STRATEGY, zlib.Z_HUFFMAN_ONLY, zlib.Z_FIXED):
        c = zlib.compressobj(level if strategy == zlib.Z_DEFAULT_STRATEGY else 6, zlib.DEFLATED, 31, 8, strategy)
        out = c.compress(record) + c.flush()
        at = out.find(MAGIC, 1)
        while at >= 0 and not header_at(out[at:]):
            at = out.find(MAGIC, at + 1)
        if at < 0:
            return out
    raise ValueError(f"page {page_id}: every encoding of its record holds the start of another")


def header_at(data: bytes) -> bool:
    """Whether a gzip member that starts here decodes to a WARC header, as far as the bytes go."""
    try:
        return zlib.decompressobj(31).decompress(data[:4096], 64).startswith(b"WARC/1.")
    except zlib.error:
        return False


def write(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", *, least: int = 100, level: int = 3) -> DataFrame:
    """Writes a record for each row and returns the manifest of the archives. Null html is an empty payload, a null
    url leaves the header out, and other columns aren't read; an empty table gives an empty manifest."""

    def put(writer, batch, state):
        c = [batch.column(i) for i in range(5)]
        for i in range(len(batch)):
            writer.write(member(c[0][i].as_py(), c[1][i].as_py(), c[2][i].as_py(), c[3][i].as_py(), c[4][i].as_py(), level))
        state["n"] += len(batch)

    return write_files(with_revisits(pick(pages, page_id=page_id, url=url, html=html), least), folder, ".warc.gz", put)


class Members:
    """The gzip members of a file that start inside [start, end), decoded: (offset, bytes).

    Members follow each other without gaps. From the first one on, bytes that don't decode to a member are Damaged; so are
    the first one behind the range and the start of the next, without which the next range could take a record for a false
    start. So no damaged record is lost in silence.
    """

    def __init__(self, f, size: int, start: int, end: int):
        self.f, self.size, self.start, self.end = f, size, start, end
        self.at, self.buffer = start, b""  # buffer: the bytes from at on that have been read

    def _fill(self, n: int) -> None:
        while len(self.buffer) < n and (at := self.at + len(self.buffer)) < self.size:
            self.f.seek(at)
            if not (got := self.f.read(min(READ, self.size - at))):
                raise EOFError(f"the file ends at {at}, before its size {self.size}")
            self.buffer += got

    def _skip(self, n: int) -> None:
        self.at, self.buffer = self.at + n, self.buffer[n:]

    def _decode(self) -> tuple[bytes, int] | None:
        """The whole member at ``at`` and its length, or None if none with a WARC header is there."""
        d, out, used, first = zlib.decompressobj(31), [], 0, True
        try:
            while not d.eof:
                self._fill(used + 1)
                part = self.buffer[used : used + READ]
                if not part:
                    return None
                out.append(d.decompress(part))
                used += len(part) - len(d.unused_data)
                if first and len(got := b"".join(out)) >= 7:
                    first = False
                    if not got.startswith(b"WARC/1."):
                        return None
        except zlib.error:
            return None
        return None if first else (b"".join(out), used)

    def _follows(self, used: int) -> bool:
        """Whether the file ends behind this member, or another one with a WARC header starts there."""
        self._fill(used + 4096)
        rest = self.buffer[used : used + 4096]
        return not rest or rest.startswith(MAGIC) and header_at(rest)

    def __iter__(self) -> Iterator[tuple[int, bytes]]:
        aligned = self.start == 0
        while self.at < self.end:
            if not aligned:
                self._fill(READ)
                found = self.buffer.find(MAGIC)
                if found < 0:
                    keep = min(2, len(self.buffer)) if self.at + len(self.buffer) < self.size else 0
                    if len(self.buffer) == keep:
                        return
                    self._skip(len(self.buffer) - keep)
                    continue
                self._skip(found)
                if self.at >= self.end:
                    return
            got = self._decode()
            if got and (aligned or self._follows(got[1])):
                yield self.at, got[0]
                self._skip(got[1])
                aligned = True
            elif aligned:
                raise Damaged(f"no sound record starts at {self.at}")
            else:
                self._skip(1)
        if aligned and self.at < self.size and not ((got := self._decode()) and self._follows(got[1])):
            raise Damaged(f"no sound record starts at {self.at}, or none behind that")


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of the records of a decoded member."""
    at = 0
    while data.startswith(b"WARC/1.", at):
        stop = data.index(b"\r\n\r\n", at)
        heads = {}
        for line in data[at:stop].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            heads[name.strip().lower()] = value.strip()
        n = int(heads["content-length"])
        yield heads, data[stop + 4 : stop + 4 + n]
        at = stop + 4 + n + 4


def _page(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(m[1]) if m else None


def read(manifest: DataFrame, *, split: int = 8 << 20, payloads: bool = False) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri[, payload]) of all records.

    manifest: (path, size) of archives. Tasks take byte ranges of ``split`` bytes; a record belongs to the range where
    its member starts, wherever it ends. The payload of a response is hashed and held against its header (an error if
    they differ); bytes that hold no sound record are an error, too. A revisit has length and digest of the full payload in its headers and no payload (null).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri"] + ["payload"] * payloads
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()] + [pa.binary()] * payloads
        for batch in batches:
            for path, size, start, end in zip(*(batch.column(i).to_pylist() for i in range(4))):
                rows, held = [], 0
                with opened(path) as f:
                    for _, data in Members(f, size, start, end):
                        for heads, block in records(data):
                            http, _, payload = block.partition(b"\r\n\r\n")
                            digest = heads["warc-payload-digest"].removeprefix("sha256:")
                            revisit = heads["warc-type"] == "revisit"
                            if not revisit and hashlib.sha256(payload).hexdigest() != digest:
                                raise ValueError(f"{path}: a payload differs from its digest")
                            n = int(re.search(rb"(?i)content-length: *(\d+)", http)[1]) if revisit else len(payload)
                            row = [_page(heads.get("warc-record-id")), n, digest, heads["warc-type"], _page(heads.get("warc-refers-to")), heads.get("warc-target-uri")]
                            rows.append(row + [None if revisit else payload] * payloads)
                            held += len(payload) * payloads
                        if len(rows) >= 5000 or held > READ * 8:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    kind = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string"
    return splits(manifest.select("path", "size"), split).mapInArrow(run, kind + ", payload binary" * payloads)


def query(spark, sf_dir: str) -> DataFrame:
    manifest = write(spark.read.parquet(f"{sf_dir}/pages.parquet"), shared_dir(spark, "warc"))
    return read(manifest).drop("target_uri")


SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM q)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN first_id END AS refers_to
FROM f
"""
