"""WARC archives written and read as a table of chunk records.

Writing: a payload becomes rows (record id, chunk number), each a WARC record of its own of at most CHUNK payload
bytes: the first a response, the others continuations (the format's record segmentation), every one carrying the
digest of the payload up to its end. Spark's text writer puts the rows into gzip files, so no record is ever built
whole, and nothing but Spark touches the store. Of equal payloads of at least LEAST bytes only one is written, under
the smallest page id; the others are revisit records, without a payload, that refer to it.

Reading: the text reader splits files at the version line that opens each record, so a task holds one chunk at a
time. No chunk may contain that line: a payload that does is cut inside it. A payload in one chunk is digested where it
is read; the chunks of longer ones are sorted by number, and their digest is taken from one to the next.

A record is named by its page id and the digest of its payload, so a revisit can name the response that it refers to.
Rows that share both get a number of their own as well; a revisit of such names the page alone, in X-Refers-To-Page.
Addresses stand as they are; one with a line break or the version line in it is percent-escaped whole, which X-Escaped says.

Defined cases: a null payload is empty, a null url is left out; rows that share the smallest id among equal payloads
are responses each; a null page id is written as `null` and read back as null; an empty table makes an empty archive;
a payload of any length is written and read chunk by chunk. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._frames import partitions, scratch, written

CHUNK, LEAST = 1 << 20, 100
#: Revisits and repeated rows (about 150 bytes each with their 64 digits, so 30 MB) up to this count are broadcast to the
#: pages; beyond it both sides are shuffled.
BROADCAST_ROWS = 200_000
VERSION, HTTP = b"WARC/1.1", b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def chunks(payload: bytes, size: int = CHUNK) -> Iterator[bytes]:
    """Runs of at most `size` bytes that cut no UTF-8 character and don't contain the version line; one empty run for an empty payload."""
    view, at, n = memoryview(payload), 0, len(payload)
    while True:
        end = min(n, at + size)
        while at < end < n and payload[end] & 0xC0 == 0x80:
            end -= 1
        if end == at < n:  # no character fits: keep the bytes together
            end = min(n, at + size)
        inside = payload.find(VERSION, at, end)
        if inside >= 0:
            end = inside + 4
        yield bytes(view[at:end])
        at = end
        if at >= n:
            return


def _uri(key: int | None, digest: str, row: int | None, number: int = 1) -> str:
    return "<urn:page:" + ":".join(map(str, ("null" if key is None else key, digest, *([] if row is None else [f"r{row}"]), number))) + ">"


def _address(url: str) -> list[str]:
    if not re.search(r"[\r\n]|WARC/1\.1", url):
        return ["WARC-Target-URI: " + url]
    return ["WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A").replace("WARC/", "WARC%2F"), "X-Escaped: 1"]


def _records(key: int | None, row: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, target_many: bool) -> Iterator[bytes]:
    """The records of one page, without the line break that the writer adds. row: a number for rows alike in id and digest; refers_to: of a revisit."""
    revisit = refers_to is not None
    running, parts = hashlib.sha256(), [b""] if revisit else chunks(payload)
    done, parts = 0, iter(parts)
    part = next(parts)
    number = 1
    while part is not None:
        after = next(parts, None)
        running.update(part)
        done += len(part)
        head = ["WARC/1.1", f"WARC-Type: {('revisit' if revisit else 'response') if number == 1 else 'continuation'}", f"WARC-Record-ID: {_uri(key, digest, row, number)}", "WARC-Date: 1970-01-01T00:00:00Z"]
        if number == 1:
            if url:
                head += _address(url)
            head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http;msgtype=response"]
        else:
            head.append(f"WARC-Segment-Origin-ID: {_uri(key, digest, row)}")
        if revisit:
            head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers_to}"]
            if not target_many:
                head.append(f"WARC-Refers-To: {_uri(refers_to, digest, None)}")
        if number > 1 or after is not None:
            head.append(f"WARC-Segment-Number: {number}")
            if after is None:
                head.append(f"WARC-Segment-Total-Length: {done + len(HTTP)}")
        block = (HTTP if number == 1 else b"") + part
        head += [f"X-Running-Digest: sha256:{running.copy().hexdigest()}", f"Content-Length: {len(block)}", "", ""]
        yield "\r\n".join(head).encode() + block + b"\r\n"
        part, number = after, number + 1


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(rows, type=pa.binary())], names=["record"])
    for batch in batches:
        rows, size = [], 0
        for i in range(batch.num_rows):
            key, row, url, payload, digest, refers_to, many, target_many = (c[i].as_py() for c in batch.columns)
            for record in _records(key, row if many else None, url, payload or b"", digest, refers_to, target_many):
                rows.append(record)
                size += len(record)
                if size >= 4 * CHUNK:
                    yield pack(rows)
                    rows, size = [], 0
        if rows:
            yield pack(rows)


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST) -> None:
    """pages as gzipped WARC files under path."""
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    narrow = written(rows.select("page_id", "digest", F.octet_length("payload").alias("n")), "digests")
    alike = narrow.groupBy("page_id", "digest", "n").agg(F.count(F.lit(1)).alias("rows"))
    shared = alike.where(F.col("n") >= least).groupBy("digest").agg(F.min("page_id").alias("least"), F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "rows"))).alias("first"), F.sum("rows").alias("times")).where("times > 1")
    found = alike.join(shared.select("digest", "least", (F.col("first.rows") > 1).alias("target_many")), "digest", "left")
    revisit = F.coalesce(F.col("page_id") > F.col("least"), F.lit(False))
    marks = found.select("page_id", "digest", F.when(revisit, F.col("least")).alias("least"), (F.col("rows") > 1).alias("many"), F.when(revisit, F.col("target_many")).alias("target_many")).where("page_id is not null and (least is not null or many)")
    marks = written(marks, "marks")
    if marks.count() <= BROADCAST_ROWS:
        marks = F.broadcast(marks)
    marked = rows.join(marks, ["page_id", "digest"], "left")
    many = F.col("page_id").isNull() | F.coalesce("many", F.lit(False))
    records = marked.select("page_id", F.monotonically_increasing_id().alias("row"), "url", "payload", "digest", "least", many.alias("many"), F.coalesce("target_many", F.lit(False)).alias("target_many")).mapInArrow(_write, "record binary")
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\r\n").option("compression", "gzip").text(path)


def _key(uri: str) -> int | None:
    key = uri[1:-1].split(":")[2]
    return None if key == "null" else int(key)


_ROW = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("number", pa.int32()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("origin", pa.string()), ("chunk", pa.binary())])
_DDL = "page_id long, record_type string, refers_to long, url string, number int, payload_bytes long, payload_digest string, origin string, chunk binary"


def _parse(record: bytes) -> dict:
    head, _, block = record.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n") if ": " in x)
    block = block[: int(fields["Content-Length"])]
    kind, number = fields["WARC-Type"], int(fields.get("WARC-Segment-Number", 1))
    part = block if kind == "continuation" else block[block.index(b"\r\n\r\n") + 4 :]
    alone = "WARC-Segment-Number" not in fields
    out = {"page_id": _key(fields["WARC-Record-ID"]), "record_type": kind, "number": number, "refers_to": None, "url": None, "origin": None, "chunk": None, "payload_bytes": None, "payload_digest": None}
    if kind != "continuation":
        url = fields.get("WARC-Target-URI", "")
        out["url"] = (url.replace("%2F", "/").replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%") if "X-Escaped" in fields else url) or None
    if kind == "revisit":
        out |= {"refers_to": int(fields["X-Refers-To-Page"]), "payload_bytes": int(fields["X-Payload-Length"]), "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha256:")}
    elif alone:
        out |= {"payload_bytes": len(part), "payload_digest": hashlib.sha256(part).hexdigest()}
    else:
        out |= {"origin": fields.get("WARC-Segment-Origin-ID", fields["WARC-Record-ID"]), "chunk": part}
    return out


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            rows = [_parse(x.as_py()) for x in batch.column(0).slice(at, 64)]
            yield pa.RecordBatch.from_pylist(rows, schema=_ROW)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks in order of (origin, number): a row for each payload."""
    first, running, size = None, None, 0
    close = lambda: pa.RecordBatch.from_pylist([first | {"payload_bytes": size, "payload_digest": running.hexdigest(), "chunk": None}], schema=_ROW)
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: c[i].as_py() for n, c in zip(batch.schema.names, batch.columns, strict=True)}
            if row["number"] == 1:
                if first is not None:
                    yield close()
                first, running, size = row, hashlib.sha256(), 0
            running.update(row["chunk"])
            size += len(row["chunk"])
    if first is not None:
        yield close()


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row for each page in the archives: page_id, record_type, refers_to, url, payload_bytes, payload_digest."""
    lines = spark.read.option("lineSep", "WARC/1.1\r\n").text(path).where("value != ''").select(F.col("value").cast("binary").alias("record"))
    parsed = written(lines.mapInArrow(_read, _DDL), "records")
    split = parsed.where("chunk is not null").repartition(partitions(spark), "origin").sortWithinPartitions("origin", "number").mapInArrow(_joined, _DDL)
    keep = ["page_id", "record_type", "refers_to", "url", "payload_bytes", "payload_digest"]
    return parsed.where("chunk is null").select(keep).union(split.select(keep))


def round_trip(pages: DataFrame, path: str | None = None, **names: str) -> DataFrame:
    """pages written as archives (by default to the shared folder), and what reading them gives."""
    spark = pages.sparkSession
    path = path or scratch(spark, "archives")
    write(pages, path, **names)
    return read(spark, path)
