"""WARC archives: a writer with revisit records, and a reader that splits compressed archives anywhere.

Writer: each task writes one ``.warc.gz`` whose records are gzip members of their own. Every attempt of a task writes a
file of its own, and the manifest, which Spark commits for one attempt of each task, names the file that counts; what a
lost attempt left is named nowhere and never read. Records with equal
payloads of at least ``least_bytes`` share one response (the largest id); the others are revisits without payload.

Reader: archives are cut into byte ranges. A task scans its range for the gzip magic, takes a candidate for a member only
if it inflates to a whole record with a WARC header, and owns the records that start inside its range, reading past the
end for the last of them. A false candidate (magic bytes inside compressed data) fails to inflate and is passed over.

Defined results: a null or empty html is an empty payload; a null url gives an empty target; rows with a null id are
written with an empty id and come last in the choice of a response; rows that repeat an id give a record each, and all
rows with a group's largest id are responses; an empty table gives no archive.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, scratch

MAGIC = b"\x1f\x8b\x08"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
CHUNK = 1 << 17
CONTROL = re.compile(r"[\x00-\x20\x7f]")
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, offset long, payload binary"


def opened(folder: str):
    """The file system and the path on it of a folder: a plain path, ``file:/``, ``file:///`` or another scheme."""
    from urllib.parse import unquote

    from pyarrow import fs

    if folder.startswith("file:/"):
        return fs.LocalFileSystem(), "/" + unquote(folder[len("file:") :]).lstrip("/")
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def record(page_id: int | None, url: str | None, html: str | None, refers_to: int | None, digest: str) -> bytes:
    payload = (html or "").encode("utf-8", "surrogatepass")
    kind = "response" if refers_to is None else "revisit"
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Target-URI: {CONTROL.sub(lambda m: f'%{ord(m[0]):02X}', url or '')}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http;msgtype=response",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    block = HTTP + (payload if refers_to is None else b"")
    raw = "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def choose_responses(pages: DataFrame, least_bytes: int) -> DataFrame:
    """page_id, url, html with digest and refers_to. Only keys and digests meet for the choice, counted before they shuffle."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("bytes"))
    shared = rows.filter(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("holder"), F.count("*").alias("n")).filter("n > 1").drop("n")
    refers = F.when((F.col("bytes") >= least_bytes) & ~F.col("holder").eqNullSafe(F.col("page_id")), F.col("holder"))
    return rows.join(shared, "digest", "left").withColumn("refers_to", refers).drop("holder", "bytes")


def write(pages: DataFrame, folder: str, *, least_bytes: int = 1000) -> DataFrame:
    """Write the archives below ``folder`` (any file system that pyarrow opens); returns path and size of each, read from a written manifest."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task = TaskContext.get()
        store, path = opened(folder)
        name, out, size = f"{path}/part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz", None, 0
        for pdf in batches:
            for page_id, url, html, refers_to, digest in zip(pdf["page_id"], pdf["url"], pdf["html"], pdf["refers_to"], pdf["digest"]):
                if out is None:
                    store.create_dir(path, recursive=True)
                    out = store.open_output_stream(name, compression=None)  # the records are compressed already
                size += out.write(record(None if page_id is None else int(page_id), url, html, None if refers_to is None else int(refers_to), digest))
        if out is not None:
            out.close()
            yield pd.DataFrame({"path": [name], "size": [size]})

    # ids travel as text: a column of numbers with gaps would come as floats
    rows = choose_responses(pages, least_bytes).select(F.col("page_id").cast("string").alias("page_id"), "url", "html", F.col("refers_to").cast("string").alias("refers_to"), "digest")
    rows.mapInPandas(run, "path string, size long").write.mode("overwrite").parquet(f"{folder}/manifest")
    return pages.sparkSession.read.parquet(f"{folder}/manifest")


def members(source, start: int, end: int, size: int) -> Iterator[tuple[int, bytes]]:
    """Records that start in [start, end) of an open file, with their offsets."""
    held, base = b"", start  # bytes of the file from base on

    def more() -> bool:
        nonlocal held
        at = base + len(held)
        if at >= size:
            return False
        source.seek(at)
        read = source.read(min(CHUNK, size - at))
        if not read:
            raise EOFError(f"the archive ends at byte {at} of {size}")
        held += read
        return True

    while base < end:
        at = held.find(MAGIC)
        if at < 0 or base + at >= end:
            if at >= 0 or base + len(held) >= end + len(MAGIC) or not more():
                return
            if at < 0 and len(held) > 2 * CHUNK:
                drop = len(held) - len(MAGIC)
                held, base = held[drop:], base + drop
            continue
        held, base = held[at:], base + at
        unpack, out, fed = zlib.decompressobj(31), [], 0
        fine = True
        try:
            while not unpack.eof:
                if fed == len(held) and not more():
                    fine = False
                    break
                out.append(unpack.decompress(held[fed:]))
                fed = len(held)
                if len(out) == 1 and out[0] and not b"WARC/".startswith(out[0][:5]):
                    fine = False
                    break
        except zlib.error:
            fine = False
        raw = b"".join(out)
        if fine and raw.startswith(b"WARC/") and b"\r\n\r\n" in raw:
            yield base, raw
            used = len(held) - len(unpack.unused_data)
        else:
            used = 1
        held, base = held[used:], base + used


def parse(raw: bytes) -> dict:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in x)
    block = rest[: int(fields.get("Content-Length", 0))]
    payload = block.partition(b"\r\n\r\n")[2]
    number = lambda x: int(x[len("<urn:page:") : -1]) if x and x != "<urn:page:>" else None
    revisit = fields.get("WARC-Type") == "revisit"
    return {
        "page_id": number(fields.get("WARC-Record-ID")), "url": fields.get("WARC-Target-URI", ""), "record_type": fields.get("WARC-Type"), "refers_to": number(fields.get("WARC-Refers-To")),
        "payload_bytes": int(fields["X-Payload-Length"]) if revisit else len(payload), "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else hashlib.sha1(payload).hexdigest(), "payload": None if revisit else payload,
    }


def read(spark: SparkSession, archives: DataFrame, folder: str, *, split_bytes: int = 4 << 20, with_payload: bool = True, most_tasks: int = 10_000) -> DataFrame:
    """``archives`` has path and size. One row per record. Splits go to as many tasks as there are, ``most_tasks`` at most: their
    number is given, as Spark would put so few bytes of paths into one task, whatever they stand for."""
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(split_bytes).cast("long")))
    splits = archives.withColumn("start", starts).withColumn("stop", F.least(F.col("start") + split_bytes, "size"))
    columns = [x.split()[0] for x in RECORD.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = opened(folder)
        for pdf in batches:
            for path, size, start, stop in zip(pdf["path"], pdf["size"], pdf["start"], pdf["stop"]):
                with store.open_input_file(path) as source:
                    rows = []
                    for offset, raw in members(source, int(start), int(stop), int(size)):
                        rows.append(parse(raw) | {"offset": offset} | ({} if with_payload else {"payload": None}))
                        if len(rows) >= 500:
                            yield pd.DataFrame(rows, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64"})
                            rows = []
                    if rows:
                        yield pd.DataFrame(rows, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64"})

    tasks = archives.agg(F.sum(F.ceil(F.col("size") / split_bytes))).first()[0] or 1
    return splits.repartition(min(int(tasks), most_tasks), "path", "start").mapInPandas(run, RECORD)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    bounded_batches(spark)
    folder = scratch(spark, "warc")
    return read(spark, write(pages, folder), folder, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
