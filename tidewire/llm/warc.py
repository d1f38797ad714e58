"""WARC archives with revisit resolution.

Pages become WARC/1.1 response records. Tasks gather them to archives of bounded size, every record a
gzip member of its own, and Spark's text writer commits an archive per row to any store that it can
write to. Then tasks walk through the archives by path, one record in memory at a time, and recompute
the payloads' digests; headers alone are stored and shuffled by digest and length. Of equal payloads
the first is a response, the others are revisit records that refer to it. The places of the revisits
are shuffled to their archive's name, whose task reads it once more and writes it with fresh headers.
No payload is ever shuffled. Archives are opened with pyarrow's file systems (local and shared
folders, hdfs, s3, gs, abfs).

Defined results: a null html is an empty payload; a null url an empty target; line ends in a url
become spaces; very long payloads are written whole, in an archive of their own if need be. Of
records with one id, the one with the smallest record id comes first. A record without an id comes
after those with one. Only the three named columns are read, whatever others there are. An empty
table gives no rows. A payload that differs from its digest is an error.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import cleaned_shuffles, scratch_path, small_batches, stored

#: Fixed values of the format.
VERSION, CRLF, RECORD_END = "WARC/1.1", "\r\n", "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_TYPE = "text/html; charset=utf-8"


def base32_of_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 40 hex digits are eight groups of four base32 digits."""
    digits = []
    for i in range(8):
        five = F.conv(F.substring(F.sha1(payload), 5 * i + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            digits.append(F.substring(F.lit(BASE32), F.shiftright(five, shift).bitwiseAND(31) + 1, 1))
    return F.concat(*digits)


def response_records(pages: DataFrame, id_col: str, url_col: str, payload_col: str, date: str) -> DataFrame:
    """One column, value: a response record per row without its record end."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("string").alias("id"),
        F.regexp_replace(F.coalesce(F.col(url_col).cast("string"), F.lit("")), "[\r\n]", " ").alias("url"),
        payload.alias("payload"),
        F.octet_length(payload).alias("n"),
    )
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: {HTTP_TYPE}{CRLF}Content-Length: "), F.col("n"), F.lit(RECORD_END)
    )
    rows = rows.select("*", http.alias("http"), base32_of_sha1(F.col("payload")).alias("digest"))
    page = F.when(F.col("id").isNull(), "").otherwise(F.concat(F.lit("WARC-X-Page-Id: "), F.col("id"), F.lit(CRLF)))
    return rows.select(
        F.concat(
            F.lit(f"{VERSION}{CRLF}WARC-Type: response{CRLF}WARC-Record-ID: <urn:uuid:"),
            F.uuid(),
            F.lit(f">{CRLF}WARC-Date: {date}{CRLF}WARC-Target-URI: "),
            F.col("url"),
            F.lit(CRLF),
            page,
            F.lit("WARC-Payload-Digest: sha1:"),
            F.col("digest"),
            F.lit(f"{CRLF}Content-Type: application/http; msgtype=response{CRLF}Content-Length: "),
            F.octet_length(F.col("http")) + F.col("n"),
            F.lit(RECORD_END),
            F.col("http"),
            F.col("payload"),
        ).alias("value")
    )


#: A gzip member of nothing. The last byte of a member is the top byte of its length, 0 under 16 MB: that
#: byte is left to the writer as its line end, so that archives are plain members one after another.
EMPTY = gzip.compress(b"", mtime=0)


class Archive:
    """Records gathered to one archive; cut() gives its bytes without the writer's line end."""

    def __init__(self, codec: str):
        self.codec, self.parts, self.size = codec, [], 0

    def add(self, record: bytes) -> None:
        end = RECORD_END.encode()
        self.parts.append(record if self.codec == "none" else gzip.compress(record + end, 1, mtime=0))
        self.size += len(self.parts[-1])

    def cut(self) -> bytes:
        if self.codec == "none":
            out = RECORD_END.encode().join(self.parts)
        else:
            out = b"".join(self.parts)
            out = (out if out[-1] == 0 else out + EMPTY)[:-1]
        self.parts, self.size = [], 0
        return out


def gathered(rows: DataFrame, make: Callable[[dict], Iterator[bytes]], codec: str, file_bytes: int) -> DataFrame:
    """A row per archive (value): the records that make gives for each row, file_bytes of them or one longer one."""
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = Archive(codec)
        one = lambda: pa.RecordBatch.from_arrays([pa.array([archive.cut()], pa.binary())], names=["value"])
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                for record in make({n: v.as_py() for n, v in zip(batch.schema.names, row, strict=True)}):
                    if archive.parts and archive.size + len(record) // 4 > file_bytes:
                        yield one()
                    archive.add(record)
                    if archive.size > file_bytes:
                        yield one()
        if archive.parts:
            yield one()

    return rows.mapInArrow(run, "value binary")


def write_archives(archives: DataFrame, path: str, codec: str = "gzip") -> None:
    """Archives, one per row, as files of their own. A file's task commits it whole or not at all.

    The engine's first task leaves an empty file where it has no archive; it reads as an archive without records.
    """
    lines = "\0" if codec == "gzip" else RECORD_END
    writer = archives.select(F.col("value").cast("string").alias("value")).write.option("lineSep", lines)
    with cleaned_shuffles(archives.sparkSession):
        writer.option("maxRecordsPerFile", 1).text(path)


def archives(spark, path: str) -> DataFrame:
    """A row per archive file: path. What they hold is not read."""
    return spark.read.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").load(path).select("path")


def opened(path: str) -> io.BufferedIOBase:
    """An archive as a stream of its records; gzip archives may have one member or one per record."""
    local = re.match(r"(?:file:/*)?(/[^:]*)$", path)
    if local:
        raw: io.BufferedIOBase = open(re.sub("^file:/*", "/", path), "rb")
    else:
        system, inner = pyarrow.fs.FileSystem.from_uri(path)
        raw = io.BufferedReader(system.open_input_stream(inner), 1 << 20)
    return gzip.GzipFile(fileobj=raw) if raw.peek(2)[:2] == b"\x1f\x8b" else raw


def records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record, parted by Content-Length; one record is held at a time."""
    while first := stream.readline():
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no WARC record where one should start: {first[:40]!r}")
        headers = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode("utf-8", "replace").partition(": ")
            headers[name.lower()] = value
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) != size or stream.read(4) != b"\r\n\r\n":  # what ends a record
            raise ValueError(f"record {headers.get('warc-record-id')} is cut off")
        yield headers, block


def http_length(block: bytes) -> int:
    """Content-Length of the HTTP header in a block: the full payload's, for revisits too."""
    head = block[:4096].partition(b"\r\n\r\n")[0].decode("latin-1")
    return next(int(x.partition(":")[2]) for x in head.split(CRLF) if x.lower().startswith("content-length:"))


def digest_of(headers: dict[str, str], block: bytes) -> str:
    """The payload's digest: of a response computed anew, of a revisit, which has no payload, as its header says."""
    said = headers["warc-payload-digest"].removeprefix("sha1:")
    if headers["warc-type"] == "response":
        payload = memoryview(block)[block.index(b"\r\n\r\n") + 4 :]
        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != said:
            raise ValueError(f"the payload of record {headers['warc-record-id']} does not have its digest")
    return said


HEADERS = "file string, nth int, record_id string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
#: Rows of headers that are sent on at once.
HEADER_ROWS = 10_000


def read_headers(files: DataFrame) -> DataFrame:
    """A row of headers per record of the archives (path); payloads stay where they are."""
    names = [x.split()[0] for x in HEADERS.split(", ")]
    types = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    number = lambda x: None if x is None else int(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for file in batch.column(0).to_pylist():
                with opened(file) as stream:
                    for nth, (h, block) in enumerate(records(stream)):
                        rows.append(
                            (
                                file,
                                nth,
                                h["warc-record-id"],
                                number(h.get("warc-x-page-id")),
                                http_length(block),
                                digest_of(h, block),
                                h["warc-type"],
                                number(h.get("warc-x-refers-to-page-id")),
                            )
                        )
                        if len(rows) == HEADER_ROWS:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names=names)
                            rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names=names)

    return files.mapInArrow(run, HEADERS)


def resolve(headers: DataFrame, min_payload_bytes: int = 0) -> DataFrame:
    """The records that become revisits: file, nth, refers_to, refers_to_record.

    Digest and length are grouped with a map-side combine; the join back is a plain equi-join
    whose hot digests the engine can split.
    """
    first = F.min(F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "record_id"))
    origins = (
        headers.filter(F.col("payload_bytes") >= min_payload_bytes)
        .groupBy("payload_digest", "payload_bytes")
        .agg(first.alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("payload_digest", "payload_bytes", F.col("first.page_id").alias("refers_to"), F.col("first.record_id").alias("refers_to_record"))
    )
    return (
        headers.select("file", "nth", "record_id", "payload_digest", "payload_bytes")
        .join(origins, ["payload_digest", "payload_bytes"])
        .filter(F.col("record_id") != F.col("refers_to_record"))
        .select("file", "nth", "refers_to", "refers_to_record")
    )


def rewritten(headers: DataFrame, revisits: DataFrame, codec: str, file_bytes: int) -> DataFrame:
    """The new archives: responses as they were, revisits with fresh headers and no payload.

    A row per old archive is shuffled, with the places of its revisits; its records are read by path.
    An archive has some 10 000 records at most, as it is of bounded size. Tasks are numbered by archives:
    the engine would put these few small rows into one.
    """
    turned = F.struct("nth", "refers_to", "refers_to_record")
    every = headers.filter("nth = 0").select("file", F.lit(None).cast("struct<nth:int,refers_to:long,refers_to_record:string>").alias("turn"))
    files, cores = every.count(), headers.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(files, max(3 * cores, files // 4)))
    both = every.unionByName(revisits.select("file", turned.alias("turn"))).repartition(tasks, "file")
    places = both.groupBy("file").agg(F.collect_list("turn").alias("turns"))

    def make(row: dict) -> Iterator[bytes]:
        turns = {t["nth"]: (t["refers_to"], t["refers_to_record"]) for t in row["turns"]}
        with opened(row["file"]) as stream:
            for nth, (own, block) in enumerate(records(stream)):
                yield fresh(own, block, turns.get(nth))

    return gathered(places, make, codec, file_bytes)


#: Headers of a record in the order they are written, as they are spelled.
SPELLED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "WARC-Target-URI", "WARC-X-Page-Id", "WARC-Payload-Digest", "Content-Type")


def fresh(headers: dict[str, str], block: bytes, origin: tuple[int | None, str] | None) -> bytes:
    """A record for the new archive, without its record end."""
    body, own = block, dict(headers)
    extra = []
    if origin:
        body = body[: body.index(b"\r\n\r\n") + 4]  # the HTTP header alone
        own["warc-type"] = "revisit"
        extra = [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {origin[1]}"]
        if origin[0] is not None:
            extra.append(f"WARC-X-Refers-To-Page-Id: {origin[0]}")
    lines = [VERSION, *(f"{k}: {own[k.lower()]}" for k in SPELLED if k.lower() in own), *extra, f"Content-Length: {len(body)}"]
    return CRLF.join(lines).encode() + b"\r\n\r\n" + body


def archive_pages(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    min_payload_bytes: int = 0,
    date: str = "2024-01-01T00:00:00Z",
    path: str | None = None,
    codec: str = "gzip",
    file_bytes: int = 16 << 20,
) -> DataFrame:
    """Write, resolve, rewrite; the headers of the deduplicated archives, which lie at path.

    An archive has about file_bytes as it is written, or one record that is longer.
    """
    spark = pages.sparkSession
    raw, out = scratch_path(spark, "warc-raw"), path or scratch_path(spark, "warc")
    each = lambda row: iter([row["value"].encode()])
    write_archives(gathered(response_records(pages, id_col, url_col, payload_col, date), each, codec, file_bytes), raw, codec)
    headers = stored(read_headers(archives(spark, raw)), "warc-headers")
    write_archives(rewritten(headers, resolve(headers, min_payload_bytes), codec, file_bytes), out, codec)
    return read_headers(archives(spark, out)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
