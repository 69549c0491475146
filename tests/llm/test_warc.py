import base64
import hashlib
import random

import zstandard

from mapweave.llm import warc
from mapweave.llm.common import new_path
from mapweave.llm.warc import _place, archive_pages, parse, read_archives, record, write_archives


def pages(spark):
    r = random.Random(3)
    html = [f"<html><title>{i}</title>" + "<p>word</p>" * r.randrange(60) + "é" * (i % 3) for i in range(150)]
    rows = [(i, f"http://a.example/{i}", html[i % 120]) for i in range(200)] + [(300, None, None), (301, "u r\nl", ""), (302, "x", ""), (303, "long", "z" * 3_000_000), (None, "n", html[0]), (400, "r", "same"), (400, "r", "same"), (401, "r", "other"), (401, "r", "third")]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string")


def test_round_trip(spark):
    rows, df = pages(spark)
    largest = {}
    for i, _, h in rows:
        largest[h or ""] = max(largest.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        response = i == largest[h or ""]
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if response else "revisit", None if response else largest[h or ""]))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in archive_pages(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_archives_stand_alone(spark):
    rows, df = pages(spark)
    folder = new_path(spark, "warc-test")
    archives = write_archives(df, folder)
    payloads = {r.payload_digest: r.payload for r in read_archives(archives, folder, payloads=True).collect() if r.payload is not None}
    assert set(payloads.values()) == {(h or "").encode() for _, _, h in rows}
    n = 0
    for a in archives.collect():
        system, _ = _place(folder)
        raw = system.open_input_stream(a.file, compression=None).read()
        assert raw[:4] == bytes.fromhex("5d2a4d18") and len(raw) >= a.bytes
        size = int.from_bytes(raw[4:8], "little")
        opener, rest = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw[8 : 8 + size])), raw[8 + size :]
        assert size > 0
        while rest:
            one = opener.decompressobj()
            assert parse(one.decompress(rest))["x-page-id"]
            rest, n = one.unused_data, n + 1
    assert n == len(rows)


def test_empty_and_few(spark):
    _, df = pages(spark)
    assert archive_pages(df.limit(0)).count() == 0
    assert [r.record_type for r in archive_pages(df.filter("page_id = 5").drop("url")).collect()] == ["response"]
    assert parse(record(1, "u", b"x\r\n\r\ny", None, False))["payload"] == b"x\r\n\r\ny"


def test_a_dictionary_from_long_pages_only(spark):
    """Pages beyond LONGEST, many or few, train a dictionary that makes archives smaller."""
    words = " ".join(f"<li class=entry>item {i % 50} of the list</li>" for i in range(3000))
    assert len(words) > warc.LONGEST
    for n in (3, 40):
        pages = spark.createDataFrame([(i, f"https://p.example/{i}", f"<html>{i}" + words + f"{i}</html>") for i in range(n)], "page_id long, url string, html string")
        assert len(warc.build_dictionary(pages)) > 256
    assert warc.build_dictionary(pages.limit(0)) == b""
