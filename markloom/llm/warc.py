"""WARC archives: writing, and reading by boundary chains (operator 6)."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from markloom.llm.common import land
from markloom.session import landing_path

#: Payloads below this many bytes are always written whole.
LEAST_BYTES = 1000
ROWS_PER_FILE = 20_000
#: A record starts a file or follows the two line breaks of the one before, so no two candidates share a blank line.
MAGIC = re.compile(rb"(?:\A|(?<=\r\n\r\n))WARC/1\.[01]\r\n")


def _headers(kind: str, fields: list[tuple[str, Column]], length: Column) -> Column:
    """Header lines and the blank line after them; a field with a null value is left out."""
    lines = [F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")) for name, value in fields]
    return F.concat(F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\n"), *[F.coalesce(x, F.lit("")) for x in lines],
                    F.lit("Content-Length: "), length.cast("string"), F.lit("\r\n\r\n"))


def decide(pages: DataFrame) -> DataFrame:
    """page_id, refers_to of every revisit. Digests are counted before they are joined, so a payload with many copies is one
    row for each task; only digests that occur twice come back."""
    sized = pages.select("page_id", F.coalesce("html", F.lit("")).alias("html"))
    small = sized.where(F.octet_length("html") >= LEAST_BYTES).select("page_id", F.sha2("html", 256).alias("digest"))
    last = small.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 AND refers_to IS NOT NULL").drop("n")
    return small.join(last, "digest").where("NOT page_id <=> refers_to").select("page_id", "refers_to").distinct()


def write(pages: DataFrame, path: str) -> None:
    """Write gzip archives with one record a page: responses with the payload, revisits with headers only.

    A record says page_id and url in its headers. Of records with equal payloads of at least 1000 bytes the one with the
    largest page_id is the response. A null html is empty; a null url is left out; rows with a null page_id are responses unless
    an equal payload has an id; rows that share a page_id share its kind. Line breaks in urls are percent-coded.
    """
    revisits = decide(pages)
    p = pages.select("page_id", F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("key", F.coalesce("page_id", F.lit(-1)))
    r = revisits.select(F.coalesce("page_id", F.lit(-1)).alias("key"), "refers_to")
    both = p.join(r, "key", "left").withColumns({"digest": F.sha1("html"), "n": F.octet_length("html")})
    name = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    common = [("WARC-Record-ID", name(F.col("page_id"))), ("WARC-Target-URI", F.col("url")),
              ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest"))]
    response = F.concat(_headers("response", common, F.col("n")), "html")
    revisit = _headers("revisit", [*common, ("WARC-Refers-To", name(F.col("refers_to"))), ("WARC-Payload-Length", F.col("n"))], F.lit(0))
    # The record ends with \r\n\r\n, whose last character is the line separator of the writer.
    record = F.concat(F.when(F.col("refers_to").isNull(), response).otherwise(revisit), F.lit("\r\n\r"))
    both.select(record.alias("value")).write.option("compression", "gzip").option("maxRecordsPerFile", ROWS_PER_FILE).text(path)


CANDIDATES = ("file string, offset bigint, successor bigint, page_id bigint, record_type string, refers_to bigint, "
              "payload_bytes bigint, payload_digest string")


def unpacked(content: bytes) -> bytes:
    """The data of a file: gzip members one after the other, as archives have one for each record, or the bytes as they are."""
    if content[:2] != b"\x1f\x8b":
        return bytes(content)
    data, out, at = memoryview(content), [], 0
    while at < len(data):
        member = zlib.decompressobj(31)
        while not member.eof and at < len(data):
            part = data[at:at + 65_536]
            out.append(member.decompress(part))
            at += len(part) - len(member.unused_data)
        if not member.eof:
            raise ValueError("a gzip member is cut off")
    return b"".join(out)


def _candidates(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Everything in a file that looks like the start of a record, with the offset at which the next must start, and a row
    without a type for the end of the file."""
    number = lambda m: int(m[1]) if m else None
    for batch in files:
        for path, content in zip(batch["path"], batch["content"]):
            data = unpacked(content)
            rows = []
            for m in MAGIC.finditer(data):
                end = data.find(b"\r\n\r\n", m.start())
                head = data[m.start():end + 2] if end >= 0 else b""
                length = number(re.search(rb"\r\nContent-Length: (\d+)\r\n", head))
                kind = re.search(rb"\r\nWARC-Type: (\w+)\r\n", head)
                if length is None or not kind or end + 4 + length > len(data):
                    continue
                payload = memoryview(data)[end + 4:end + 4 + length]
                revisit = kind[1] == b"revisit"
                digest = re.search(rb"\r\nWARC-Payload-Digest: sha1:([0-9a-f]{40})\r\n", head)
                rows.append((path, m.start(), end + 4 + length + 4, number(re.search(rb"\r\nWARC-Record-ID: <urn:page:(-?\d+)>", head)),
                             kind[1].decode(), number(re.search(rb"\r\nWARC-Refers-To: <urn:page:(-?\d+)>", head)),
                             number(re.search(rb"\r\nWARC-Payload-Length: (\d+)", head)) if revisit else length,
                             (digest[1].decode() if digest else None) if revisit else hashlib.sha1(payload).hexdigest()))
            rows.append((path, len(data), *[None] * 6))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in CANDIDATES.split(", ")])
            yield out.astype({c: "Int64" for c in ("successor", "page_id", "refers_to", "payload_bytes")})


def reachable(edges: DataFrame) -> DataFrame:
    """(file, offset) of the candidates that the chain of successors reaches from offset 0, by pointer jumping.

    Each round, what is reached marks what its pointer shows, and each pointer is replaced by the pointer it shows, so the
    reached part of a file doubles: rounds grow with the logarithm of the records in a file.
    """
    state = land(edges.select("file", "offset", F.col("successor").alias("jump"), (F.col("offset") == 0).alias("reached")), "chain")
    while True:
        to = state.select("file", F.col("offset").alias("jump"), F.col("jump").alias("onward"))
        marks = state.where("reached").select("file", F.col("jump").alias("offset"), F.lit(True).alias("marked"))
        jumped = state.join(to, ["file", "jump"], "left").select("file", "offset", F.col("onward").alias("jump"), "reached")
        after = land(jumped.join(marks.distinct(), ["file", "offset"], "left")
                     .select("file", "offset", "jump", (F.col("reached") | F.coalesce("marked", F.lit(False))).alias("reached")), "chain")
        state = after
        if not state.where("reached AND jump IS NOT NULL").limit(1).count():
            return state.where("reached").select("file", "offset")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives below ``path``: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Tasks list candidate records and their successors; only those on the chain from a file's start are records, so a record
    inside a payload is not one. A chain that does not reach the end of its file, as in a cut file, is an error, and so is a gzip member that is cut off; a file
    may have any number of members. Response digests and sizes are those of the payload as read; a revisit has those of its headers.
    A file is held whole in a task, so archives should be of bounded size, as ``write`` makes them.
    """
    # One file in an Arrow batch at a time would do; Spark packs files of a task up to maxPartitionBytes.
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    found = land(files.mapInPandas(_candidates, CANDIDATES), "candidates")
    reached = reachable(found)
    cut = found.where("record_type IS NULL").join(reached, ["file", "offset"], "left_anti").select("file").first()
    if cut:
        raise ValueError(f"no chain of records reaches the end of {cut.file}")
    return found.where("record_type IS NOT NULL").join(reached, ["file", "offset"]).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages to archives in the shared folder and read them back."""
    path = landing_path(pages.sparkSession, "llm-warc")
    write(pages, path)
    return read(pages.sparkSession, path)
