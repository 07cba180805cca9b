import base64
import gzip
import hashlib
import random
import zlib

import pytest

from dragline.llm import shared, warc


@pytest.fixture
def pages(spark):
    def make(rows):
        return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, digest string, payload string")

    return make


def brute(rows):
    top = {}
    for page, _, html in rows:
        if page is not None:
            top[html or ""] = max(top.get(html or "", page), page)
    out = []
    for page, _, html in rows:
        body = (html or "").encode()
        keeper = top.get(html or "", page)
        name = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out.append((str(page), len(body), name, "response" if page == keeper else "revisit",
                    "None" if page == keeper else str(keeper)))
    return sorted(out)


def got(df):
    rows = df.collect()
    assert all(r.intact for r in rows)
    return sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in rows)


ROWS = [
    (1, "http://a/x y", "<p>é</p>"), (2, None, None), (3, "http://c", ""), (4, "http://d", "<p>é</p>"), (5, "http://e", "z" * 400_000),
    (6, "http://f", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n"), (None, "http://g", "<p>é</p>"), (None, None, "alone"),
    (7, "http://h", "\n\r\n\x00 a"), (8, "http://i", "z" * 400_000),
]


def test_round_trip(pages):
    assert got(warc.round_trip(pages(ROWS))) == brute(ROWS)
    assert warc.round_trip(pages([])).count() == 0


def test_archives_are_plain_gzip(spark, pages):
    path = shared.new_folder(spark, "warc-test")
    warc.write_archives(pages(ROWS).coalesce(2), path)
    whole = b"".join(gzip.decompress(bytes(r.content)) for r in spark.read.format("binaryFile").load(path + "/part-*").collect())
    assert whole.count(b"WARC-Type: ") == len(ROWS)


def test_small_ranges(spark, pages):
    rnd = random.Random(1)
    rows = [(i, f"http://x/{i}", "".join(rnd.choice("abcdefgh \n<>") for _ in range(rnd.randint(0, 3000)))) for i in range(300)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        assert got(warc.round_trip(pages(rows).coalesce(1))) == brute(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_magic_inside_records_over_range_borders(spark):
    """Stored (not compressed) members full of false magic, in ranges much shorter than a record."""
    rnd = random.Random(2)
    contents = []
    for i in range(40):
        noise = b"".join(rnd.choice([warc.MAGIC, b"WARC/1.", warc.EMPTY_MEMBER, rnd.randbytes(50)]) for _ in range(rnd.randint(0, 60)))
        contents.append(f"WARC/1.1\r\nX-Page-ID: {i}\r\n\r\n".encode() + noise)
    members = []
    for c in contents:
        pack = zlib.compressobj(0, zlib.DEFLATED, 31)
        members.append(pack.compress(c) + pack.flush())
    path = shared.new_folder(spark, "warc-false-magic")
    df = spark.createDataFrame([(bytearray(m),) for m in members], "member binary").coalesce(1)
    df.select(df.member.cast("string")).write.option("encoding", "ISO-8859-1").option(
        "lineSep", warc.EMPTY_MEMBER.decode("ISO-8859-1")).text(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("700", "2000", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            read = sorted(bytes(r.content) for r in warc.read_records(spark, path).collect())
            assert read == sorted(contents), size
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
