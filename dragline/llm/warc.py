"""WARC archives: a writer, and a reader that splits archives by byte ranges.

**Writing.**  Each record is a gzip member of its own.  Spark's text sink writes the members as they are; the separator
it puts behind each of them is an empty gzip member, so the file is a plain sequence of members that any reader takes.
Records with equal payloads: the one with the largest page id is the response, the others are revisits that refer to it
and carry headers only.

**Reading.**  Spark splits the files into byte ranges.  A task scans its range for gzip magic (the text source with the
magic as line separator, read as raw bytes) and owns what starts inside: bytes between two places of magic are a
candidate member.  A candidate is validated by inflating its first bytes, which must be a WARC version line; magic
inside compressed data fails there and its bytes belong to the record before.  Where such false magic falls next to a
border of ranges, the beginning of a record and its remainder lie in different tasks: both are set aside, brought
together by file and put in order of their ranges.  That happens about once in 2^24 bytes; a file's leftovers are the
records it cuts, not the file.  (A payload that holds whole gzipped WARC records, stored without compression, cannot be
told from records by any reader of ranges.)

Files must not be named ``*.gz``, for Spark would unpack these itself before any range is read.

Defined cases: null html is an empty payload; equal payloads of any length, empty ones too, are grouped; of rows that
repeat page id and payload all are responses if their page id is the largest; a null page id never becomes the response
of a group that has ids, and is no target of a revisit; a null url is left out of the headers; an empty table gives an
empty archive and an empty table; other columns are not written.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from dragline.llm.shared import new_folder, stored
from dragline.scale import settle

MAGIC = b"\x1f\x8b\x08"
#: A whole gzip member without content.
EMPTY_MEMBER = MAGIC + bytes(5) + b"\x00\xff" + b"\x03\x00" + bytes(8)
_LATIN = "ISO-8859-1"  # one character for each byte in the separators
_VERSION = b"WARC/1."
_END = b"\r\n\r\n"
_NAMESPACE = uuid.UUID("7d444840-9dc0-11d1-b245-5ffdce74fad2")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()  # noqa: S324 the format's own digest


def record_id(page: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, str(page))}>"


def _member(content: bytes) -> bytes:
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(content) + pack.flush()


def record(page: object, url: str | None, payload: bytes, digest: str, refers_to: object | None) -> bytes:
    """One WARC record, uncompressed: a response, or a revisit where ``refers_to`` is given."""
    kind = "response" if refers_to is None else "revisit"
    block = (
        b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        + f"Content-Length: {len(payload)}\r\n\r\n".encode())
    if refers_to is None:
        block += payload
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page)}", "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page is not None:
        head.append(f"X-Page-ID: {page}")
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(url.split()))
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + _END + block + _END


def parse_record(content: bytes) -> dict | None:
    """Headers (names in lower case) and payload of a record; None for anything else."""
    head, found, rest = content.partition(_END)
    if not found or not head.startswith(_VERSION):
        return None
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    block = rest[: int(fields.get("content-length", 0))]
    http, _, payload = block.partition(_END)
    for line in http.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length":
            fields["http-length"] = value.strip().decode()
    return fields | {"payload": payload}


# ---- writing

def with_revisits(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, digest, refers_to) of a table of pages."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", body.alias("payload"), F.sha1(body).alias("digest"))
    groups = settle(
        rows.select("page_id", "digest").groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"))
        .filter((F.col("n") > 1) & F.col("keeper").isNotNull()).select("digest", "keeper"))
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper"))
    return rows.join(groups, "digest", "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def write_archives(pages: DataFrame, path: str) -> None:
    """Write a folder of archives, one for each task."""

    def run(batches):
        for batch in batches:
            out = []
            for page, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                name = base64.b32encode(bytes.fromhex(digest)).decode()
                out.append(_member(record(page, url, payload, name, refers_to)))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])

    members = with_revisits(pages).mapInArrow(run, "member binary")
    members.select(F.col("member").cast("string")).write.option("encoding", _LATIN).option(
        "lineSep", EMPTY_MEMBER.decode(_LATIN)).text(path)


# ---- reading

class Member:
    """A gzip member that is inflated as its bytes come in."""

    def __init__(self) -> None:
        self.unpack, self.content, self.raw = zlib.decompressobj(31), bytearray(), bytearray()

    def add(self, data: bytes) -> str:
        """"whole", "more" (it goes on beyond ``data``) or "not" (no record: only a version line may come first)."""
        self.raw += data
        try:
            if len(self.content) < len(_VERSION):  # validate by the first bytes before the rest is inflated
                self.content += self.unpack.decompress(data, len(_VERSION) - len(self.content))
                data = self.unpack.unconsumed_tail
            if not _VERSION.startswith(self.content[: len(_VERSION)]):
                return "not"
            self.content += self.unpack.decompress(data)
        except zlib.error:
            return "not"
        if self.unpack.unused_data:  # a member ends where the next one's magic begins
            return "not"
        return "whole" if self.unpack.eof else "more"


class Assembler:
    """Puts a range's fragments (each begins with magic) together into records."""

    def __init__(self, leads: bool) -> None:
        self.open: Member | None = None  # a record that goes on
        self.leads = leads  # no record has begun yet: fragments may belong to the range before
        self.orphans = bytearray()

    def add(self, fragment: bytes) -> list[bytes]:
        """Contents that this fragment completes."""
        member = self.open or Member()
        state = member.add(fragment)
        if len(member.content) >= len(_VERSION) and state != "not":
            self.leads = False
        if state == "more":
            self.open = member
            return []
        self.open = None
        if state == "whole" and (member.content or not self.leads):
            return [bytes(member.content)] if member.content else []
        # no record after all: its first fragment goes, what follows is looked at anew
        again = bytes(member.raw).find(MAGIC, 1) if len(member.raw) > len(fragment) else -1
        if self.leads:  # an empty member, too, may be bytes of the record before
            self.orphans += member.raw[:again] if again > 0 else member.raw
        done = []
        for piece in bytes(member.raw[again:]).split(MAGIC)[1:] if again > 0 else []:
            done += self.add(MAGIC + piece)
        return done


_ASIDE = "file string, start long, part string, rest binary"


def _scanned(spark: SparkSession, path: str, describe, schema: str) -> DataFrame:
    """What ``describe`` makes of the content of each record below ``path`` (a tuple for ``schema``; None: no row)."""
    raw = spark.read.option("encoding", _LATIN).option("lineSep", MAGIC.decode(_LATIN)).text(path).select(
        F.col("value").cast("binary").alias("bytes"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_block_length").alias("length"))
    kinds = to_arrow_schema(StructType.fromDDL(schema))
    aside = to_arrow_schema(StructType.fromDDL(_ASIDE))

    def table(records: list[bytes], left: list[tuple]) -> pa.RecordBatch:
        rows = [row for row in map(describe, records) if row is not None]
        fields = [*kinds, *aside]
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
        others = list(zip(*left, strict=True)) if left else [()] * len(aside)
        arrays = [pa.array([*c, *[None] * len(left)], f.type) for c, f in zip(columns, kinds, strict=True)]
        arrays += [pa.array([*[None] * len(rows), *c], f.type) for c, f in zip(others, aside, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names=[f.name for f in fields])

    def rest(now: Assembler, at: tuple) -> list[tuple]:
        rows = []
        if now.orphans:
            rows.append((*at, "remainder", bytes(now.orphans)))
        if now.open:
            rows.append((*at, "start", bytes(now.open.raw)))
        return rows

    def run(batches):
        now, at = None, None
        for batch in batches:
            whole, left = [], []
            files, starts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for data, file, start in zip(batch.column(0), files, starts, strict=True):
                first = (file, start) != at
                if first:
                    if now:
                        left += rest(now, at)
                    at, now = (file, start), Assembler(leads=start > 0)
                    if start == 0:  # what stands before the first magic of a file
                        continue
                whole += now.add(MAGIC + data.as_py())
            yield table(whole, left)
        if now:
            yield table([], rest(now, at))

    found = stored(raw.mapInArrow(run, f"{schema}, {_ASIDE}"), "warc-read")

    def join(cut: pa.Table) -> pa.Table:
        parts = sorted(zip(*(cut[c].to_pylist() for c in ("start", "part", "rest")), strict=True),
                       key=lambda x: (x[0], x[1] == "start"))
        now, whole = Assembler(leads=False), []
        for _, _, content in parts:
            for piece in content.split(MAGIC)[1:]:
                whole += now.add(MAGIC + piece)
        return pa.Table.from_batches([table(whole, [])]).select(kinds.names)

    torn = found.filter("part IS NOT NULL").groupBy("file").applyInArrow(join, schema)
    return found.filter("part IS NULL").select(*kinds.names).unionByName(torn)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Contents of all records of the archives below ``path``, one row each."""
    return _scanned(spark, path, lambda content: (content,), "content binary")


_PAGES = ("page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, "
          "intact boolean")


def _page(content: bytes) -> tuple | None:
    fields = parse_record(content)
    if fields is None or "warc-payload-digest" not in fields:
        return None
    digest, length = fields["warc-payload-digest"].removeprefix("sha1:"), int(fields["http-length"])
    intact = fields["warc-type"] != "response" or (
        len(fields["payload"]) == length and payload_digest(fields["payload"]) == digest)
    return (fields.get("x-page-id"), length, digest, fields["warc-type"], fields.get("x-refers-to-page-id"), intact)


def read_pages(spark: SparkSession, path: str, page_type: str = "bigint") -> DataFrame:
    """Of each record: page_id, payload_bytes, payload_digest, record_type, refers_to, intact (payload fits its digest)."""
    rows = _scanned(spark, path, _page, _PAGES)
    return rows.withColumns({c: F.col(c).cast(page_type) for c in ("page_id", "refers_to")})


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the archives of a table of pages to the shared folder, read them back and describe every record."""
    path = new_folder(pages.sparkSession, "warc")
    write_archives(pages, path)
    return read_pages(pages.sparkSession, path, pages.schema["page_id"].dataType.simpleString())
