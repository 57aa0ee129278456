"""WARC: revisit resolution. Headers are shuffled by payload digest, revisits are joined to the original response, archives get fresh headers.

Payloads are never dealt by digest: a header is a page's id, its url and its digest. Of pages with one digest the header of the smallest id is
found by partial minima; what the digests that occur more than once say of each page goes back to the payloads by id and digest, so a payload
that a third of all pages have is spread over all tasks.

write_archives() turns pages into records in gzipped WARC/1.1 files in a shared folder (one gzip member a record); of the
pages with one payload the smallest page_id becomes the response and the others revisits that refer to it and carry no
payload, only the HTTP headers with its length. read_archives() reads them back.

Defined cases: a null html is an empty payload; a null page_id comes after all others, and is a response if nothing else
has its payload; rows that repeat the smallest page_id are all responses; a null url is written without a target; payloads below
least_bytes are all responses; other columns of the pages are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vexil.llm.shared import local_path, new_folder, put_file, small_batches

_FILE_BYTES = 16 << 20
_SALTS = 16
_PIECE = 1 << 16
#: Archives are read by so many tasks at most, one file after the other.
_READERS = 10_000
#: The WARC 1.1 profile for payloads that were met before.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def base32_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _safe(url: str) -> str:
    """One line of printable ASCII: all else is percent-encoded."""
    return "".join(chr(b) if 0x21 <= b < 0x7F else f"%{b:02X}" for b in url.encode())


def make_record(page_id: int | None, url: str | None, payload: bytes, refers: tuple[int, str | None] | None) -> bytes:
    """One gzip member. refers: page_id and url of the response with the same payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{base32_digest(payload)}"]
    head += [f"WARC-Block-Digest: sha1:{base32_digest(block)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    head += [f"WARC-Page-ID: {page_id}"] if page_id is not None else []
    head += [f"WARC-Target-URI: {_safe(url)}"] if url is not None else []
    if refers:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers[0])}", f"WARC-Refers-To-Date: {DATE}", f"WARC-Refers-To-Page-ID: {refers[0]}"]
        head += [f"WARC-Refers-To-Target-URI: {_safe(refers[1])}"] if refers[1] is not None else []
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def parse_records(file: BinaryIO) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """(WARC headers, HTTP headers, payload) of every record of a gzipped archive; the file is read piece by piece, and one record is unpacked at a time."""
    data = file.read(_PIECE)
    while data:
        unpack, parts = zlib.decompressobj(31), []
        while data and not unpack.eof:
            parts.append(unpack.decompress(data))
            data = unpack.unused_data if unpack.eof else file.read(_PIECE)
        if not unpack.eof:
            raise ValueError("an archive is cut off")
        data = data or file.read(_PIECE)
        head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
        warc = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        block = rest[: int(warc["Content-Length"])]
        if warc["WARC-Block-Digest"] != f"sha1:{base32_digest(block)}":
            raise ValueError(f"record {warc['WARC-Record-ID']} is damaged")
        http, _, payload = block.partition(b"\r\n\r\n")
        yield warc, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def resolve(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, refers_to, refers_url of all rows of pages (page_id, url, html)."""
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    own = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    heads = own.where(F.length("payload") >= least_bytes).select("page_id", "url", "digest")
    known = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))
    first = heads.groupBy("digest").agg(F.min(known).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").drop("n")
    # Which pages revisit: a row for each id and digest, however often the page occurs. Salted, as one digest may have a third of the headers.
    salts = F.lit(_SALTS)
    pairs = heads.select("page_id", "digest").distinct().withColumn("salt", F.pmod(F.xxhash64("page_id"), salts))
    spread = first.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts.cast("long") - 1)))
    refers = pairs.join(spread, ["digest", "salt"]).where("page_id is null or page_id <> first.page_id")
    refers = refers.select(F.col("page_id").alias("own_id"), F.col("digest").alias("own_digest"), "first")
    joined = own.join(refers, F.col("page_id").eqNullSafe(F.col("own_id")) & (F.col("digest") == F.col("own_digest")), "left")
    return joined.select("page_id", "url", "payload", F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("refers_url"))


def write_archives(pages: DataFrame, least_bytes: int = 0) -> str:
    """Writes all records and gives the folder's URI. Files hold about 16 MB; a task that runs again writes new names and only the names returned count."""
    small_batches(pages.sparkSession)
    folder = new_folder(pages.sparkSession, "warc")
    path = local_path(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[str] = []
        held: list[bytes] = []
        size = records = 0
        counts: list[int] = []

        def end() -> None:
            nonlocal size, records
            if held:
                names.append(f"{uuid.uuid4().hex}.warc.gz")
                put_file(f"{path}/parts/{names[-1]}", b"".join(held))
                counts.append(records)
                held.clear()
                size = records = 0

        for b in batches:
            for page_id, url, payload, to, to_url in zip(*(b[x] for x in ("page_id", "url", "payload", "refers_to", "refers_url"))):
                body = payload.as_buffer().to_pybytes() if payload.is_valid else b""
                to = to.as_py()
                held.append(make_record(page_id.as_py(), url.as_py(), body, None if to is None else (to, to_url.as_py())))
                size, records = size + len(held[-1]), records + 1
                if size >= _FILE_BYTES:
                    end()
        end()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], ["name", "records"])

    # The manifest is itself written by Spark, so names of lost attempts aren't in it.
    resolve(pages, least_bytes).mapInArrow(run, "name string, records long").write.parquet(f"{folder}/manifest")
    return folder


def read_archives(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (and payload) of every record of the manifest's files."""
    path = local_path(folder)
    fields = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    names = [x.split(" ")[0] for x in fields.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name in f["name"]:
                rows = []
                size = 0
                with open(f"{path}/parts/{name}", "rb") as file:
                    for warc, http, payload in parse_records(file):
                        kind, digest = warc["WARC-Type"], warc["WARC-Payload-Digest"].removeprefix("sha1:")
                        if kind == "response" and (len(payload) != int(http["Content-Length"]) or base32_digest(payload) != digest):
                            raise ValueError(f"payload of {warc['WARC-Record-ID']} is damaged")
                        rows.append((warc.get("WARC-Page-ID"), int(http["Content-Length"]), digest, kind, warc.get("WARC-Refers-To-Page-ID"), *([payload] if with_payload else [])))
                        size += len(payload) if with_payload else 0
                        if len(rows) == 5000 or size > _FILE_BYTES:
                            yield _frame(rows, names)
                            rows, size = [], 0
                if rows:
                    yield _frame(rows, names)

    listed = spark.read.schema("name string, records long").parquet(f"{folder}/manifest")
    # A stated number of tasks, or Spark would put the short list of names into one.
    return listed.repartition(min(max(listed.count(), 1), _READERS)).mapInPandas(run, fields)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names)
    for x in ("page_id", "refers_to"):
        out[x] = pd.array([None if v is None else int(v) for v in out[x]], "Int64")
    return out


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Writes the pages' archives and reads them back."""
    return read_archives(pages.sparkSession, write_archives(pages))
