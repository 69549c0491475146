"""WARC archives of pages, each record compressed by itself with a dictionary built from the records.

Pages with equal payloads are archived once: the one with the largest page_id is the response, the others are revisits
that name it. A Zstandard dictionary is trained on a bounded sample of whole records (SAMPLE records of SAMPLE_BYTES at
most) and stands at the head of every archive, in a skippable frame, as its own format for compressed archives asks; so
any file can be read alone, from any record on.

The archives are files in the shared folder, one or more for each task, written under a passing name and then renamed, so
a task that is run again leaves no half file; the table of archives says which count. Reading gives one row a record.

Null payloads are empty. A null page_id comes after all others as a group's response; of rows that repeat in page_id and
payload each gets its record, and where the response's row itself repeats all of these rows are responses. An empty table
gives no archives and no rows; a missing or null url is written as a name made from the page_id; other columns are left
alone.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapweave.llm.common import new_path, written

#: Records the dictionary is trained on, the longest that is used whole, bytes of them all, bytes of the dictionary, and of pieces of a few records.
SAMPLE, LONGEST, SAMPLE_BYTES, DICTIONARY, PIECE = 2_000, 1 << 15, 8 << 20, 1 << 16, 512
#: Payloads with copies up to which their digests are broadcast.
BROADCAST = 500_000
#: Bytes after which a new archive is begun.
ARCHIVE = 256 << 20
#: The frame type that holds a dictionary, the profile of revisits, and one date for all records.
SKIPPABLE, PROFILE, DATE = 0x184D2A5D, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "2000-01-01T00:00:00Z"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{payload_digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record. Revisits hold the HTTP head, whose length is the payload's, and no payload."""
    sha, name = digest_of(payload), "none" if page_id is None else str(page_id)
    uri = "".join(c if c > " " else "%%%02X" % ord(c) for c in url) if url else f"page:{name}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, sha)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}",
        f"X-Page-ID: {name}", f"WARC-Payload-Digest: sha1:{sha}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, sha)}", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Headers of a record by lower-case name, its block under `block`, and the HTTP payload (None in revisits) with its stated length."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not version.startswith("WARC/1."):
        raise ValueError(f"not a WARC record: {version[:40]!r}")
    out = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}
    block, end = rest[: int(out["content-length"])], rest[int(out["content-length"]) :]
    if end != b"\r\n\r\n":
        raise ValueError("a record's length does not fit its block")
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = int(next(x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length")))
    if out["warc-type"] == "response" and (len(payload) != stated or f"sha1:{digest_of(payload)}" != out["warc-payload-digest"]):
        raise ValueError(f"payload of {out['warc-record-id']} is damaged")
    return out | {"block": block, "payload": payload if out["warc-type"] == "response" else None, "stated": stated}


def _place(path: str):
    """The file system and path that a URI names. Spark's own reading and writing has no raw files, so tasks use pyarrow's."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else fs.FileSystem.from_uri("file://" + path.removeprefix("file:"))


def build_dictionary(records: DataFrame) -> bytes:
    """Trained on at most SAMPLE records, the least by hash; of longer pages than LONGEST a piece, at a place that the hash gives. A few records are
    cut into pieces of PIECE bytes. Empty if there are no more than 16 of these, or the library finds them too alike to train on."""
    import zstandard

    drawn = F.xxhash64("page_id", "html")
    share = min(1.0, 2 * SAMPLE / max(records.count(), 1))  # so that no task sorts more than a few thousand
    start = F.pmod(drawn, F.greatest(F.length("html") - LONGEST // 4, F.lit(1))).cast("int") + 1
    piece = F.when(F.octet_length("html") <= LONGEST, F.col("html")).otherwise(F.substring("html", start, F.lit(LONGEST // 4)))
    few = records.filter(F.pmod(drawn, F.lit(1 << 30)) < int(share * (1 << 30))).select("page_id", "url", piece.alias("html"), drawn.alias("drawn"))
    rows = few.orderBy("drawn", "page_id", "html").limit(SAMPLE).toLocalIterator()
    samples, total = [], 0
    for r in rows:
        samples.append(record(r["page_id"], r["url"], (r["html"] or "").encode("utf-8", "surrogatepass"), None, False))
        total += len(samples[-1])
        if total > SAMPLE_BYTES:
            break
    if len(samples) < 16:
        samples = [s[k : k + PIECE] for s in samples for k in range(0, len(s), PIECE)]
    if len(samples) <= 16:
        return b""
    try:
        return zstandard.train_dictionary(min(DICTIONARY, max(total // 8, 1024)), samples).as_bytes()
    except zstandard.ZstdError:
        return b""  # samples too small or too alike to train on: records are compressed without


def frame(dictionary: bytes) -> bytes:
    return SKIPPABLE.to_bytes(4, "little") + len(dictionary).to_bytes(4, "little") + dictionary


def _as_text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def mark_revisits(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """page_id, url, html, and the response's page_id (null for responses) with revisit. Payloads below `least` bytes are all responses."""
    target = F.col(url).cast("string") if url in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col(key).cast("long").alias("page_id"), target.alias("url"), _as_text(html).alias("html")).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    copies = rows.filter(F.octet_length("html") >= least).groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).filter("n > 1").select("digest", "response")
    copies = written(copies, "copied-payloads")
    if copies.count() <= BROADCAST:  # else the payloads are shuffled to meet them
        copies = F.broadcast(copies)
    revisit = F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    return rows.join(copies, "digest", "left").select("page_id", "url", "html", F.when(revisit, F.col("response")).alias("refers_to"), revisit.alias("revisit"))


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0, level: int = 3) -> DataFrame:
    """Writes all pages to archives in folder; gives a table of them: file, records, bytes."""
    marked = mark_revisits(pages, key, url, html, least)
    dictionary = build_dictionary(pages.select(F.col(key).cast("long").alias("page_id"), (F.col(url).cast("string") if url in pages.columns else F.lit(None).cast("string")).alias("url"), _as_text(html).alias("html")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        task, done, out, tmp, n, size = TaskContext.get(), [], None, "", 0, 0
        system, root = _place(folder)
        packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                final = f"{root}/pages-{task.partitionId():06d}-{len(done):04d}-{uuid.uuid4().hex[:8]}.warc.zst"
                system.move(tmp, final)
                done.append((final, n, size))
                out = None

        for batch in batches:
            for page, uri, text, refers, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    system.create_dir(root, recursive=True)
                    tmp = f"{root}/.part-{task.taskAttemptId()}-{len(done)}"
                    out, n, size = system.open_output_stream(tmp, compression=None), 0, len(frame(dictionary))
                    out.write(frame(dictionary))
                packed = packer.compress(record(page, uri, (text or "").encode("utf-8", "surrogatepass"), refers, revisit))
                out.write(packed)
                n, size = n + 1, size + len(packed)
                if size >= ARCHIVE:
                    close()
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["file", "records", "bytes"])

    return written(marked.mapInArrow(write, "file string, records long, bytes long"), "archives")


def read_records(stream, dictionary_of=None) -> Iterator[dict]:
    """Records of an open archive, in order, a frame at a time."""
    import zstandard

    head = stream.read(8)
    if not head:
        return
    dictionary, held = b"", head
    if int.from_bytes(head[:4], "little") == SKIPPABLE:
        dictionary, held = stream.read(int.from_bytes(head[4:], "little")), b""
    opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    ended = False
    while held or not ended:
        one, parts = opener.decompressobj(), []
        while not one.eof:
            if not held:
                held = stream.read(1 << 20)
                if not held:
                    ended = True
                    break
            parts.append(one.decompress(held))
            held = one.unused_data if one.eof else b""
        if not one.eof:
            if any(parts):
                raise ValueError("an archive ends inside a record")
            break
        yield parse(b"".join(parts))


def read_archives(archives: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """A row for each record of the archives: page_id, payload_bytes, payload_digest, record_type, refers_to; with payloads also url and payload (null in revisits)."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + (", url string, payload binary" if payloads else "")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _place(folder)

        def batch_of(rows: list) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)], names=[x.split()[0] for x in schema.split(", ")])

        for batch in batches:
            for file in batch.column(0).to_pylist():
                rows: list = []
                with system.open_input_stream(file, compression=None) as stream:
                    for r in read_records(stream):
                        page = None if r["x-page-id"] == "none" else int(r["x-page-id"])
                        refers = int(r["x-refers-to-page-id"]) if r["warc-type"] == "revisit" else None
                        rows.append((page, r["stated"], r["warc-payload-digest"].removeprefix("sha1:"), r["warc-type"], refers, *((r["warc-target-uri"], r["payload"]) if payloads else ())))
                        if len(rows) >= 500:
                            yield batch_of(rows)
                            rows = []
                if rows:
                    yield batch_of(rows)

    files = archives.select("file")
    return files.repartition(max(1, archives.count()), "file").mapInArrow(read, schema)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Writes pages to archives in the shared folder and reads them back."""
    folder = new_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder), folder)
