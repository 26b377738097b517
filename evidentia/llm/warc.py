"""WARC archives, index first: write records with an index of byte ranges, then read selected records by merged ranges.

Every record is a gzip member of its own, so a byte range of an archive can be
read alone. The index (file, offset, length, url, digest per record) is the
output of the writing tasks: a task that is run again writes a file of another
name, and only the files of finished tasks are named in the index.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_folder, stage
from .common import raw_texts, small_batches

#: Bytes after which a task begins another archive; of one read; and between two records that one read still spans.
FILE_BYTES, RANGE_BYTES, GAP_BYTES = 256_000_000, 4_000_000, 64_000
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, url string, payload_digest string, file string, offset long, length long"
FOUND = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def one_line(value: str | None) -> str:
    """A header value without line breaks or other control characters."""
    return "".join(c if c > " " else f"%{ord(c):02X}" for c in value or "")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, response: int | None, is_revisit: bool) -> bytes:
    """One record as a gzip member; a revisit holds the response's head only, and the length of the payload it stands for."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}",
            f"WARC-Target-URI: {one_line(url)}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
            f"Content-Length: {len(block)}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if is_revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(response, digest)}", f"X-Refers-To-Page: {response}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 4, mtime=0)


def parsed(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Headers of the record, of its HTTP message, and the payload."""
    head, _, rest = gzip.decompress(raw).partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError(f"not a record: {version[:40]!r}")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload


def write(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Write a record per row of ``pages`` into ``folder`` and return the index, itself a staged table.

    Of equal payloads of at least ``least`` bytes the row with the largest page_id
    is the response and the others revisit it; equal rows that share that id are
    each a response. Null html is an empty payload; rows without an id revisit, and
    are responses where no row of the group has one.
    """
    small_batches(pages.sparkSession)
    payload = F.coalesce("html", F.lit(""))
    own = pages.select("page_id", "url", "html", F.sha1(payload.cast("binary")).alias("sha1"), F.octet_length(payload).alias("bytes"))
    least_id = F.when(F.col("bytes") >= least, F.col("page_id"))
    largest = own.groupBy("sha1").agg(F.max(least_id).alias("response"), F.count("*").alias("n"))
    again = largest.filter((F.col("n") > 1) & F.col("response").isNotNull()).select("sha1", "response")
    # the few columns of repeated pages meet first; the payloads then move once, by page
    page = [F.col("page_id"), F.col("sha1")]
    revisits = own.select(*page).join(again, "sha1").filter(~F.col("page_id").eqNullSafe(F.col("response"))).distinct()
    revisits = stage(revisits.select(F.col("page_id").alias("p"), F.col("sha1").alias("s"), "response"), "revisits")
    rows = own.join(revisits, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("sha1") == F.col("s")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        out, name, offset = None, "", 0
        for batch in batches:
            rows = []
            for page_id, url, html, sha1, response in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), raw_texts(batch.column("html")),
                                                          batch.column("sha1").to_pylist(), batch.column("response").to_pylist()):
                if out is None or offset > FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                digest = base32(bytes.fromhex(sha1))
                raw = record(page_id, url, html, digest, response, response is not None)
                out.write(raw)
                rows.append((page_id, url, digest, name, offset, len(raw)))
                offset += len(raw)
            if rows:
                kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                                                 names=["page_id", "url", "payload_digest", "file", "offset", "length"])
        if out is not None:
            out.close()

    return stage(rows.select("page_id", "url", "html", "sha1", "response").mapInArrow(run, INDEX), "warc_index")


def ranges(selected: DataFrame) -> DataFrame:
    """file, start, stop, records: sorted byte ranges of the selected index rows, merged over small gaps up to a bounded size."""
    cell = F.floor(F.col("offset") / RANGE_BYTES)
    within = Window.partitionBy("file", "cell").orderBy("offset")
    gap = F.col("offset") - F.lag(F.col("offset") + F.col("length")).over(within)
    cut = selected.withColumn("cell", cell).withColumn("new", (F.coalesce(gap, F.lit(0)) > GAP_BYTES).cast("int"))
    cut = cut.withColumn("part", F.sum("new").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return cut.groupBy("file", "cell", "part").agg(
        F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("stop"),
        F.sort_array(F.collect_list(F.struct("offset", "length", "payload_digest"))).alias("records"))


def read(selected: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, read back from the archives of the selected index rows.

    A response's payload is hashed anew and held against its header and the index.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = FileSystem.from_uri(folder)
        for batch in batches:
            rows = []
            for file, start, stop, records in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "stop", "records"))):
                with fs.open_input_file(f"{root}/{file}") as f:
                    span = f.read_at(stop - start, start)
                for r in records:
                    fields, http, payload = parsed(span[r["offset"] - start : r["offset"] - start + r["length"]])
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    page, refers = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page")
                    if fields["WARC-Type"] == "response" and digest != base32(hashlib.sha1(payload).digest()) or digest != r["payload_digest"]:
                        raise ValueError(f"damaged record in {file} at {r['offset']}")
                    rows.append((None if page is None else int(page), int(http["Content-Length"]), digest, fields["WARC-Type"], None if refers is None else int(refers)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            cols = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)],
                                             names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return ranges(selected).select("file", "start", "stop", "records").mapInArrow(run, FOUND)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Archive all pages in a new folder of the shared ones and read all of them back; an empty table gives no rows."""
    folder = f"{shared_folder(pages.sparkSession)}/evidentia/warc-{uuid.uuid4().hex}"
    index = write(pages.select("page_id", "url", "html"), folder, least)
    return read(index, folder)
