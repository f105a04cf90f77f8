"""Operator 4, WARC: a chunked record table.

An archive is a table of rows (archive, record_no, chunk_no, n_chunks, data).  The data of an archive's rows, in order,
are a WARC/1.1 file; a record's head and the first slice of its payload are chunk 0, and every further slice of at most
``CHUNK`` bytes is a row of its own, so neither writer nor reader holds a record whole beyond the cell that Spark hands
over.  Both carry a SHA-1 from slice to slice.  Records of one chunk are read where they lie; only those of several are
brought together, by record, and streamed in order.

Equal payloads are found by a digest that is aggregated before it is shuffled; the smallest id of a group is its
response and the others revisit it.  Payloads of which there are very many copies, at most ``HOT``, are named to the tasks
by broadcast, and their rows are spread over all tasks.  A record's id is its place, so repeated and null page ids still
have records of their own; pages are named in fields of their own.

Defined results: a null or empty payload is a record of 0 bytes; among rows that repeat the smallest id of a payload all
are responses; a row with a null id is a revisit wherever some row of its payload has an id, else a response; a null URL
becomes ``urn:page:<id>``; an empty table gives an empty archive; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.llm.common import cut, small_batches, utf8

#: Payload bytes of a chunk row, bytes that a task gathers before it passes them on, payloads whose rows are spread.
CHUNK, FLUSH, HOT = 1 << 16, 4 << 20, 4096
CHUNKS = "archive long, record_no long, chunk_no int, n_chunks int, data binary"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, digest_ok boolean"
#: A record without a date of its own; WARC-Date is mandatory.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _base32(sha1) -> str:
    return base64.b32encode(sha1.digest()).decode()


def _number(page: str | None) -> int | None:
    return None if page is None else int(page)


def classify(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """page_id, url, payload, first, first_url: the page with the smallest id among equal payloads."""
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), utf8(payload_col).alias("payload"))
    rows = rows.withColumn("key", F.concat(F.sha1("payload"), F.lit(":"), F.octet_length("payload").cast("string")))
    # A null id comes last; of equal ids the smallest URL.
    top = F.min(F.struct(F.col("page_id").isNull().alias("x"), "page_id", "url"))
    groups = cut(rows.groupBy("key").agg(top.alias("top"), F.count("*").alias("n")).where("n > 1").select("key", F.col("top.page_id").alias("first"), F.col("top.url").alias("first_url"), "n"), "groups")
    # No more than HOT groups can have a HOT-th part of all grouped rows each: a bounded broadcast.
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = groups.where(F.col("n") > total / HOT).select("key", F.col("first").alias("hot_first"), F.col("first_url").alias("hot_url"), F.lit(True).alias("hot"))
    cold = groups.where(F.col("n") <= total / HOT).select("key", "first", "first_url")
    rows = rows.join(F.broadcast(hot), "key", "left")
    spread = F.when(F.col("hot"), F.concat(F.lit("spread"), F.monotonically_increasing_id().cast("string"))).otherwise(F.col("key"))
    rows = rows.withColumn("key", spread).join(cold, "key", "left")
    return rows.select("page_id", "url", "payload", F.when(F.col("hot"), F.col("hot_first")).otherwise(F.coalesce("first", "page_id")).alias("first"), F.when(F.col("hot"), F.col("hot_url")).otherwise(F.col("first_url")).alias("first_url"))


def write_archive(classified: DataFrame) -> DataFrame:
    """Chunk rows of the archives, one archive for each task; no more than about ``FLUSH`` bytes are gathered at a time."""

    def write(batches):
        archive, record = TaskContext.get().partitionId(), 0
        for b in small_batches(batches):
            out: list[tuple] = []
            held, payloads = 0, b.column("payload")
            for i, (page, url, first, first_url) in enumerate(zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "first", "first_url")), strict=True)):
                body = memoryview(payloads[i].as_buffer())
                sha1 = hashlib.sha1()
                for at in range(0, len(body), CHUNK):
                    sha1.update(body[at : at + CHUNK])
                revisit = page != first
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
                head = [
                    "WARC/1.1",
                    f"WARC-Type: {'revisit' if revisit else 'response'}",
                    f"WARC-Record-ID: <urn:record:{archive}:{record}>",
                    f"WARC-Date: {DATE}",
                    f"WARC-Target-URI: {_uri(url, page)}",
                    f"WARC-Payload-Digest: sha1:{_base32(sha1)}",
                    *([] if page is None else [f"Page-ID: {page}"]),
                    *([f"WARC-Refers-To-Target-URI: {_uri(first_url, first)}", f"Refers-To-Page-ID: {first}", f"WARC-Profile: {PROFILE}"] if revisit else []),
                    "Content-Type: application/http; msgtype=response",
                    f"Content-Length: {len(http) + (0 if revisit else len(body))}",
                ]
                sent = 0 if revisit else len(body)
                n = max(1, -(-sent // CHUNK))
                for k in range(n):
                    data = bytes(body[k * CHUNK : min(sent, (k + 1) * CHUNK)])
                    data = ("\r\n".join(head).encode() + b"\r\n\r\n" + http + data) if k == 0 else data
                    out.append((archive, record, k, n, data + (b"\r\n\r\n" if k == n - 1 else b"")))
                    held += len(out[-1][4])
                    if held >= FLUSH:
                        yield _chunks(out)
                        out, held = [], 0
                record += 1
            if out:
                yield _chunks(out)

    return classified.mapInArrow(write, CHUNKS)


def _uri(url: str | None, page: int | None) -> str:
    return f"urn:page:{'null' if page is None else page}" if url is None else " ".join(url.split())


def _chunks(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in CHUNKS.split(", ")])


class _Reader:
    """One record at a time, fed chunk by chunk."""

    def begin(self, data: memoryview) -> None:
        raw = bytes(data[: 1 << 20]) if len(data) > 1 << 20 else bytes(data)
        end = raw.find(b"\r\n\r\n")
        if end < 0:
            raw = bytes(data)
            end = raw.find(b"\r\n\r\n")
        lines = raw[:end].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        self.head = dict(x.split(": ", 1) for x in lines[1:])
        stop = raw.find(b"\r\n\r\n", end + 4)
        if stop < 0:
            raw = bytes(data)
            stop = raw.find(b"\r\n\r\n", end + 4)
        self.http = dict(x.split(": ", 1) for x in raw[end + 4 : stop].decode().split("\r\n")[1:])
        self.left = int(self.head["Content-Length"]) - (stop + 4 - (end + 4))
        self.sha1, self.n = hashlib.sha1(), 0
        self.more(data[stop + 4 :])

    def more(self, data: memoryview) -> None:
        take = data[: min(len(data), self.left)]
        self.sha1.update(take)
        self.n += len(take)
        self.left -= len(take)

    def row(self) -> tuple:
        if self.left:
            raise ValueError(f"{self.left} bytes of {self.head['WARC-Record-ID']} are missing")
        kind, said = self.head["WARC-Type"], self.head["WARC-Payload-Digest"].removeprefix("sha1:")
        found = _base32(self.sha1) if kind == "response" else said
        n = self.n if kind == "response" else int(self.http["Content-Length"])
        return _number(self.head.get("Page-ID")), self.head["WARC-Target-URI"], n, found, kind, _number(self.head.get("Refers-To-Page-ID")), found == said


def read_archive(chunks: DataFrame) -> DataFrame:
    """``RECORDS`` of an archive table; a response's length and digest are those of the bytes read."""

    def parse(batches):
        reader, at = _Reader(), None
        for b in small_batches(batches):
            rows: list[tuple] = []
            data = b.column("data")
            for i, (a, r, k, n) in enumerate(zip(*(b.column(c).to_pylist() for c in ("archive", "record_no", "chunk_no", "n_chunks")), strict=True)):
                piece = memoryview(data[i].as_buffer())
                if k == 0:
                    reader.begin(piece)
                elif at != (a, r, k - 1):
                    raise ValueError(f"chunk {k} of record {r} of archive {a} is out of order")
                else:
                    reader.more(piece)
                at = (a, r, k)
                if k == n - 1:
                    rows.append(reader.row())
            if rows:
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in RECORDS.split(", ")])

    single = chunks.where("n_chunks = 1").mapInArrow(parse, RECORDS)
    several = chunks.where("n_chunks > 1").repartition("archive", "record_no").sortWithinPartitions("archive", "record_no", "chunk_no")
    return single.unionByName(several.mapInArrow(parse, RECORDS))


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write every page's record to archives in the shared folder and read them back."""
    return read_archive(cut(write_archive(classify(pages, id_col, url_col, payload_col)), "warc"))
