"""WARC archives: writing, the monolithic gzip normaliser and reading by index.

Spark's text writer makes archives whose files are one gzip stream each, the line separator
being the blank lines that end a record. The normaliser inflates such a stream once from
begin to end, rewrites every record as a gzip member of its own and writes a sidecar index of
offsets, so that any record can be read alone.
"""

import hashlib
import json
import os
import re
import uuid
import zlib

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adloom.llm.common import new_folder

#: Payloads of at least so many bytes are stored once.
REVISIT_FROM = 1000
RECORDS_PER_FILE = 20_000
_PIECE = 1 << 20
_END = b"\r\n\r\n"
_NAMES = ("WARC-Type", "WARC-Record-ID", "WARC-Target-URI", "WARC-Date", "WARC-Payload-Digest", "Content-Length",
          "X-Payload-Length", "X-Page-Id", "X-Refers-To-Page")


def described(pages: DataFrame, least: int = REVISIT_FROM) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type and refers_to per row of `pages`."""
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload.cast("binary")).alias("payload_digest"),
    )
    large = pages.select(F.col("page_id").cast("long").alias("page_id"), payload.alias("payload"))
    large = large.filter(F.octet_length("payload") >= least)
    large = large.groupBy(F.sha1(F.col("payload").cast("binary")).alias("_digest")).agg(
        F.max("page_id").alias("_last"), F.count("*").alias("_n")
    )
    joined = rows.join(large.filter("_n > 1"), F.col("payload_digest") == F.col("_digest"), "left")
    again = F.col("_last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_last"))
    again = again & (F.col("payload_bytes") >= least)
    return joined.select(
        *rows.columns,
        F.when(again, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        F.when(again, F.col("_last")).alias("refers_to"),
    )


def _header(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))


def write_archives(records: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write the rows of `described` as WARC files, each one gzip stream."""
    again = F.col("record_type") == "revisit"
    body = F.when(again, F.lit("")).otherwise(F.col("payload"))
    name = lambda key: F.concat(F.lit("<urn:page:"), key.cast("string"), F.lit(">"))
    # a line end within an address would begin another header
    address = F.regexp_replace("url", r"[\r\n]", "%0A")
    text = F.concat(
        F.lit("WARC/1.0\r\n"), _header("WARC-Type", F.col("record_type")),
        _header("WARC-Record-ID", name(F.col("page_id"))), _header("WARC-Target-URI", address),
        _header("WARC-Date", F.lit(date)), _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        _header("WARC-Refers-To", name(F.col("refers_to"))), _header("X-Payload-Length", F.col("payload_bytes")),
        _header("X-Page-Id", F.col("page_id")), _header("X-Refers-To-Page", F.col("refers_to")),
        F.when(again, F.lit("WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\n"))
        .otherwise(F.lit("Content-Type: text/html; charset=utf-8\r\n")),
        _header("Content-Length", F.octet_length(body)), F.lit("\r\n"), body,
    )
    writer = records.select(text.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
    writer.option("maxRecordsPerFile", RECORDS_PER_FILE).text(folder)


def _inflated(file):
    """Pieces of the text of an open gzip file, also of several members; as much is inflated at once as is bounded."""
    stream, left = zlib.decompressobj(31), b""
    while left or (left := file.read(_PIECE)):
        if stream.eof:
            stream = zlib.decompressobj(31)
        yield stream.decompress(left, _PIECE)
        left = stream.unconsumed_tail or stream.unused_data


def _headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")[1:]
    return dict(line.split(": ", 1) for line in lines if ": " in line)


def _records(pieces):
    """(headers, whole record) one after the other; the stream is held only as far as one record."""
    held = bytearray()
    pieces = iter(pieces)

    def more() -> bool:
        for piece in pieces:
            held.extend(piece)
            return True
        return False

    while True:
        seen = 0
        while (end := held.find(_END, max(0, seen - 3))) < 0:
            seen = len(held)
            if not more():
                if held.strip():
                    raise ValueError("the archive ends within a record's headers")
                return
        headers = _headers(bytes(held[:end]))
        size = end + 4 + int(headers["Content-Length"]) + 4
        while len(held) < size:
            if not more():
                raise ValueError("the archive ends within a record")
        yield headers, bytes(held[:size])
        del held[:size]


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder that executors and driver share."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri) if ":" in uri else os.path.abspath(uri))


def normalise(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Rewrite each archive of `source` with a gzip member per record, and write an index beside it.

    Both are folders that the tasks can open by `pyarrow.fs`, as those in the shared folder.

    Returns the index, read back from the sidecar files: file, begin, length and the record's
    main headers. A file is written under a name of its own and renamed when whole, so a task
    that is run again, or twice at once, leaves one right copy.
    """

    def rewrite(batches):
        store, root = _store(target)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for path in batch["path"]:
                # from the name alone, the same for each run of the task
                name = hashlib.sha1(path.encode()).hexdigest()
                parts = [f"{root}/_part-{uuid.uuid4().hex}" for _ in range(2)]
                place = count = 0
                # an archive is read as a stream and held only as far as one record
                origin, inside = _store(path)
                with (
                    origin.open_input_stream(inside, compression=None) as archive,
                    store.open_output_stream(parts[0], compression=None) as out,
                    store.open_output_stream(parts[1], compression=None) as index,
                ):
                    for headers, record in _records(_inflated(archive)):
                        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = packer.compress(record) + packer.flush()
                        out.write(member)
                        line = {"file": f"{name}.warc.gz", "begin": place, "length": len(member)}
                        line["headers"] = {k: headers[k] for k in _NAMES if k in headers}
                        index.write((json.dumps(line) + "\n").encode())
                        place, count = place + len(member), count + 1
                store.move(parts[0], f"{root}/{name}.warc.gz")
                store.move(parts[1], f"{root}/{name}.index.json")
                yield pd.DataFrame({"file": [name], "records": [count]})

    # only the paths: without the column `content` Spark reads no file
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("path")
    done = files.mapInPandas(rewrite, "file string, records long").agg(F.sum("records").alias("n")).first()
    schema = "file string, begin long, length long, headers map<string,string>"
    if not done["n"]:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("pathGlobFilter", "*.index.json").json(target)


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """headers and payload of each record of `index`, read from its own gzip member alone."""

    def read(batches):
        store, root = _store(folder)
        opened = {}
        for batch in batches:
            headers, payloads, size = [], [], 0
            for file, begin, length in zip(batch["file"], batch["begin"], batch["length"]):
                if file not in opened:
                    for old in opened.values():
                        old.close()
                    opened = {file: store.open_input_file(f"{root}/{file}")}
                opened[file].seek(begin)
                record = zlib.decompress(opened[file].read(length), 31)
                end = record.find(_END)
                headers.append(_headers(record[:end]))
                payloads.append(record[end + 4 : -4])
                size += len(payloads[-1])
                if size > 16_000_000:
                    yield pd.DataFrame({"headers": headers, "payload": payloads})
                    headers, payloads, size = [], [], 0
            yield pd.DataFrame({"headers": headers, "payload": payloads})
        for old in opened.values():
            old.close()

    places = index.select("file", "begin", "length")
    return places.mapInPandas(read, "headers map<string,string>, payload binary")


def archived(pages: DataFrame) -> DataFrame:
    """Archives of `pages` (page_id, url, html; more are ignored) written, normalised and read back.

    Per row: page_id, payload_bytes, payload_digest, record_type, refers_to and `intact`,
    whether the payload read back has the digest and length of its headers (true for
    revisits, whose payload is elsewhere). Of equal payloads of at least 1000 bytes the row with
    the largest page_id is the response, repeated rows of it too; a row without page_id
    revisits it, or is a response if no row has one. Null html is an empty payload, a null url
    gives no address header. An empty table gives an empty result.
    """
    spark = pages.sparkSession
    first, second = new_folder(spark, "warc"), new_folder(spark, "members")
    write_archives(described(pages), first)
    records = read_records(normalise(spark, first, second), second)
    header = lambda name: F.element_at("headers", F.lit(name))
    digest = F.regexp_extract(header("WARC-Payload-Digest"), "^sha1:(.*)$", 1)
    again = header("WARC-Type") == "revisit"
    same = (F.sha1("payload") == digest) & (F.length("payload") == header("X-Payload-Length").cast("long"))
    return records.select(
        header("X-Page-Id").cast("long").alias("page_id"),
        F.when(again, header("X-Payload-Length").cast("long")).otherwise(F.length("payload").cast("long")).alias("payload_bytes"),
        F.when(again, digest).otherwise(F.sha1("payload")).alias("payload_digest"),
        header("WARC-Type").alias("record_type"),
        header("X-Refers-To-Page").cast("long").alias("refers_to"),
        (again | same).alias("intact"),
    )
