"""Dictionary-compressed WARC archives.

Each task writes archives to the shared folder: a leading skippable frame with a
Zstandard dictionary built from the archive's own records, then a warcinfo record
and the page records, each a frame of its own that uses the dictionary. A
payload that occurs again becomes a revisit record without payload.

An archive's name is new for every attempt and reaches the manifest only from the
attempt that Spark commits, so a lost executor's half-written files are never read.

Defined results: a null html is an empty payload, a null url leaves the target out.
Of equal payloads of at least ``min_revisit`` bytes the largest page_id's record is
the response; rows that repeat it are responses too, and a null id is smaller than
any other. Columns other than id, url and html are not archived. An empty table
gives an empty manifest.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from towerfill.llm.common import cut_lineage, table
from towerfill.llm.hashing import utf8
from towerfill.session import scratch_path

#: Fixed by the WARC Zstandard convention: the skippable frame that holds the dictionary.
DICTIONARY_MAGIC = 0x184D2A5D
MIN_REVISIT = 1000
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payload bytes of an archive (one record more at most), and of its first records that build the dictionary.
ARCHIVE_BYTES = 64 << 20
SAMPLE_BYTES = 4 << 20
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
#: Beginnings of folder names of Spark's file systems, and what ``pyarrow.fs`` calls the same place.
STORES = {"s3a://": "s3://", "s3n://": "s3://"}
#: Bytes that are read from an archive, and that are decompressed, at a time.
READ_BYTES = 1 << 20
FEED_BYTES = 1 << 14


def record(kind: str, name: str, fields: list[tuple[str, str]], block: bytes, date: str) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{name}>"), ("WARC-Date", date), *fields, ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def page_name(page_id: int | None) -> str:
    return f"urn:page:{'none' if page_id is None else page_id}"


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A response, or with ``refers_to`` a revisit: the same HTTP head, no payload."""
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    target = [] if url is None else [("WARC-Target-URI", "".join(c if c > " " else f"%{ord(c):02X}" for c in url))]
    fields = [*target, ("WARC-Payload-Digest", digest), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is None:
        return record("response", page_name(page_id), fields, head + payload, date)
    fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{page_name(refers_to)}>")]
    return record("revisit", page_name(page_id), fields, head, date)


def build_dictionary(records: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A Zstandard dictionary built from ``records``; too few to train on are one raw-content dictionary."""
    try:
        return zstandard.train_dictionary(size, records).as_bytes()
    except zstandard.ZstdError:
        return b"".join(records)[-size:] or b"WARC/1.1\r\nWARC-Type: response\r\n"


def store_name(folder: str, stores: dict[str, str] | None = None) -> str:
    """The URI by which tasks open ``folder``; the longest beginning in ``stores`` or ``STORES`` counts."""
    known = STORES | (stores or {})
    old = max((x for x in known if folder.startswith(x)), key=len, default="")
    return known.get(old, "") + folder[len(old):]


class Archive:
    """One archive: it takes records until its sample is full, builds the dictionary, then writes frame by frame."""

    def __init__(self, folder: str, date: str):
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        self.files, path = fs.FileSystem.from_uri(folder)
        self.path, self.date = f"{path}/{self.name}", date
        self.out, self.waiting, self.sample, self.payload, self.records = None, [], 0, 0, 0

    def add(self, raw: bytes, payload: int) -> None:
        self.payload += payload
        self.records += 1
        if self.out is None:
            self.waiting.append(raw)
            self.sample += len(raw)
            if self.sample >= SAMPLE_BYTES:
                self._start()
        else:
            self.out.write(self.zip.compress(raw))

    def _start(self) -> None:
        words = build_dictionary(self.waiting)
        kind = zstandard.DICT_TYPE_AUTO
        self.zip = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(words, dict_type=kind), write_checksum=True)
        self.out = self.files.open_output_stream(self.path)
        self.out.write(struct.pack("<II", DICTIONARY_MAGIC, len(words)) + words)
        info = record("warcinfo", f"urn:archive:{self.name}", [("Content-Type", "application/warc-fields"), ("WARC-Filename", self.name)],
                      b"format: WARC File Format 1.1\r\n", self.date)
        for raw in (info, *self.waiting):
            self.out.write(self.zip.compress(raw))
        self.waiting = []

    def close(self) -> tuple[str, int, int]:
        if self.out is None:
            self._start()
        size = self.out.tell()
        self.out.close()
        return self.name, self.records, size


def _write(folder: str, date: str, archive_bytes: int):
    def run(batches):
        archive = None
        for b in batches:
            for page_id, url, payload, refers_to, revisit in zip(
                    b["page_id"].to_pylist(), b["url"].to_pylist(), utf8(b["html"]), b["refers_to"].to_pylist(), b["revisit"].to_pylist()):
                archive = archive or Archive(folder, date)
                archive.add(page_record(page_id, url, payload, refers_to if revisit else None, date), len(payload))
                if archive.payload >= archive_bytes:
                    yield _row(archive.close())
                    archive = None
        if archive:
            yield _row(archive.close())
    return run


def _row(closed: tuple[str, int, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x]) for x in closed], ["archive", "records", "bytes"])


def mark_revisits(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """``page_id, url, html`` with ``revisit`` and ``refers_to``.

    Only digests that occur more than once are joined back; a hot digest is one row
    there, and Spark splits the pages' side.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    small = F.concat(F.lit("small:"), F.xxhash64("page_id", "html").cast("string"))  # meets nothing, and spreads
    pages = pages.withColumn("_d", F.when(F.octet_length(payload) >= min_revisit, F.sha1(payload)).otherwise(small))
    again = (pages.filter(~F.col("_d").startswith("small:")).groupBy("_d").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n"))
             .filter("n > 1 and refers_to is not null").select(F.col("_d").alias("_e"), "refers_to"))
    other = F.coalesce(F.col("page_id") < F.col("refers_to"), F.col("refers_to").isNotNull())
    return pages.join(again, F.col("_d") == F.col("_e"), "left").select("page_id", "url", "html", "refers_to", other.alias("revisit"))


def write_warc(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html",
               date: str = "2000-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES, stores: dict[str, str] | None = None) -> DataFrame:
    """Writes ``pages`` to archives in ``folder`` (a URI that all executors share); returns the manifest: ``archive, records, bytes, folder``.

    Spark makes the folder; tasks write by ``pyarrow.fs``. ``stores`` maps the
    beginnings of names that only Spark knows to ones that pyarrow opens (say, a
    mount of the same store); the manifest carries the latter.
    """
    spark = pages.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    if "://" not in folder:
        folder = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().replace("file:/", "file:///", 1)
    folder = store_name(folder, stores)
    rows = mark_revisits(pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html")))
    manifest = rows.mapInArrow(_write(folder, date, archive_bytes), "archive string, records long, bytes long")
    return cut_lineage(manifest.withColumn("folder", F.lit(folder)), "manifest")


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of every record of an open archive."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != DICTIONARY_MAGIC:
        raise ValueError("not an archive with a leading dictionary frame")
    words = zstandard.ZstdCompressionDict(stream.read(size))
    buffer, done = b"", False
    while not done or buffer:
        one = zstandard.ZstdDecompressor(dict_data=words).decompressobj()
        raw = b""
        while not one.eof:
            if not buffer:
                buffer = stream.read(FEED_BYTES)
                if not buffer:
                    if raw:
                        raise EOFError("an archive ends inside a record")
                    return
            raw += one.decompress(buffer)
            buffer = one.unused_data if one.eof else b""
        head, _, rest = raw.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        yield fields, rest[:int(fields["Content-Length"])]


def _number(name: str) -> int | None:
    value = name.strip("<>").rpartition(":")[2]
    return None if value == "none" else int(value)


def _read(batches):
    for b in batches:
        for folder, name in zip(b["folder"].to_pylist(), b["archive"].to_pylist()):
            files, path = fs.FileSystem.from_uri(folder)
            with files.open_input_stream(f"{path}/{name}", buffer_size=READ_BYTES) as stream:
                rows: list[tuple] = []
                for fields, block in records(stream):
                    if fields["WARC-Type"] == "warcinfo":
                        continue
                    head, _, payload = block.partition(b"\r\n\r\n")
                    length = int(dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])["Content-Length"])
                    digest = base64.b32decode(fields["WARC-Payload-Digest"].partition(":")[2]).hex()
                    kind = fields["WARC-Type"]
                    if kind == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
                        raise ValueError(f"damaged record in {name}")
                    rows.append((_number(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), kind, length, digest,
                                 _number(fields["WARC-Refers-To"]) if kind == "revisit" else None,
                                 payload if kind == "response" else None))
                    if len(rows) >= 200:
                        yield _page_rows(rows)
                        rows = []
                if rows:
                    yield _page_rows(rows)


_PAGE = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()),
                   ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def _page_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _PAGE.types)], schema=_PAGE)


def read_warc(manifest: DataFrame) -> DataFrame:
    """The page records of a manifest's archives; responses are checked against their digest. Revisits have no payload."""
    n = max(1, manifest.count())
    return manifest.select("folder", "archive").repartition(min(n, 10_000)).mapInArrow(
        _read, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc", uuid.uuid4().hex)
    got = read_warc(write_warc(table(spark, sf_dir, "pages"), folder))
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
g AS (SELECT d, max(page_id) AS m FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN page_id < m THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < m THEN m END AS refers_to FROM p LEFT JOIN g USING (d)
"""
