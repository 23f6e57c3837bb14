"""WARC 1.1: writing pages with revisit records, and a reader that salvages damaged archives.

The reader takes a whole file, plain or gzip by member. It parses a record, checks its length, its
closing blank lines and its digests, and if a check fails searches for the next place where a valid
gzip member or version line starts; the bytes between are reported as a quarantined gap, and all
records after it are still returned.

Null payloads are empty, null urls are empty. Repeated rows each give a record; of records with equal
payloads those with the largest page_id are responses and the others revisits. Pages without a
page_id never become the one that others refer to unless no equal page has one. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wellspring.llm.common import keep, same

VERSION = b"WARC/1.1\r\n"  # fixed value
_START = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")
FILE_BYTES = 16 << 20  # aimed size of an archive file: a reader holds one at a time
STEP = 1 << 16  # compressed bytes that the reader decompresses at a time
DATE = "2024-01-01T00:00:00Z"
_CRLF = "\r\n"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 SHA-1: 160 bits are 8 groups of 20, five hex digits or four base32 digits each."""
    digits = F.sha1(data)
    group = lambda i: F.lpad(F.conv(F.substring(digits, 5 * i + 1, 5), 16, 32), 4, "0")
    return F.translate(F.concat(*[group(i) for i in range(8)]), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def plan(pages: DataFrame, min_bytes: int = 0) -> tuple[DataFrame, int]:
    """page_id, url, payload, digest, bytes, ``refers_to`` (null for responses), and the mean payload.

    Digests that repeat are found without the payloads and kept as a table, whose size Spark checks
    before it broadcasts it; a larger one is joined by shuffling.
    """
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", base32_sha1(F.col("payload").cast("binary"))).withColumn("bytes", F.octet_length("payload").cast("long"))
    sums = keep(rows.groupBy(F.col("digest").alias("g_digest"), F.col("bytes").alias("g_bytes")).agg(F.max("page_id").alias("held_by"), F.count("*").alias("n")), "digests")
    mean = sums.agg(F.sum(F.col("g_bytes") * F.col("n")) / F.sum("n")).first()[0] or 0
    held = keep(sums.filter((F.col("n") > 1) & (F.col("g_bytes") >= min_bytes)).drop("n"), "repeats")
    joined = rows.join(held, (F.col("digest") == F.col("g_digest")) & (F.col("bytes") == F.col("g_bytes")), "left")
    revisit = F.col("held_by").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("held_by"))
    return joined.select("page_id", "url", "payload", "digest", "bytes", F.when(revisit, F.col("held_by")).alias("refers_to")), int(mean)


def record(page_id: Column, url: Column, payload: Column, digest: Column, refers_to: Column) -> Column:
    """A record's text, up to but without its last line feed."""
    urn = lambda x: F.concat(F.lit("<urn:page:"), F.coalesce(x.cast("string"), F.lit("")), F.lit(">"))
    head = F.concat(F.lit("HTTP/1.1 200 OK" + _CRLF + "Content-Type: text/html; charset=utf-8" + _CRLF * 2))
    revisit = refers_to.isNotNull()
    block = F.when(revisit, head).otherwise(F.concat(head, payload))
    safe_url = F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.concat(
        F.lit(VERSION.decode()),
        F.lit("WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit(_CRLF + "WARC-Record-ID: "), urn(page_id), F.lit(_CRLF + "WARC-Target-URI: "), safe_url,
        F.lit(_CRLF + "WARC-Date: " + DATE + _CRLF + "Content-Type: application/http; msgtype=response"),
        F.lit(_CRLF + "WARC-Payload-Digest: sha1:"), digest,
        F.when(revisit, F.concat(F.lit(_CRLF + "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" + _CRLF + "WARC-Refers-To: "), urn(refers_to))).otherwise(F.lit("")),
        F.lit(_CRLF + "WARC-Block-Digest: sha1:"), base32_sha1(block.cast("binary")),
        F.lit(_CRLF + "Content-Length: "), F.octet_length(block).cast("string"),
        F.lit(_CRLF * 2), block, F.lit(_CRLF + "\r"),
    )


def write(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Archive ``pages`` (page_id, url, html) under ``path``, plain WARC files of about ``FILE_BYTES``."""
    planned, mean = plan(pages, min_bytes)
    text = planned.select(record(*[F.col(c) for c in ("page_id", "url", "payload", "digest", "refers_to")]).alias("value"))
    text.write.option("lineSep", "\n").option("maxRecordsPerFile", max(1, FILE_BYTES // (mean + 700))).text(path)


def _sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _parse(data: bytes, at: int) -> tuple[dict, int] | None:
    """A plain record at ``at`` that passes all checks, and where it ends."""
    if not _START.match(data, at) or data[at : at + 1] != b"W":
        return None
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        return None
    head = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        head[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    length = head.get("content-length", "")
    if not length.isdigit() or "warc-type" not in head or "warc-record-id" not in head:
        return None
    start, stop = end + 4, end + 4 + int(length)
    if data[stop : stop + 4] != b"\r\n\r\n":
        return None
    block = data[start:stop]
    want = head.get("warc-block-digest", "")
    if want.startswith("sha1:") and want[5:] != _sha1(block):
        return None
    payload = block
    if head.get("content-type", "").startswith("application/http"):
        payload = block.partition(b"\r\n\r\n")[2]
    want = head.get("warc-payload-digest", "")
    if head["warc-type"] != "revisit" and want.startswith("sha1:") and want[5:] != _sha1(payload):
        return None
    return {"head": head, "payload": payload}, stop + 4


def _member(data: bytes, at: int) -> tuple[list[dict], int] | None:
    """Records of a gzip member at ``at``, all of them valid, and where the member ends."""
    box, parts, stop = zlib.decompressobj(31), [], at
    try:
        while not box.eof and stop < len(data):  # in steps: the rest of the file is not copied for each member
            parts.append(box.decompress(data[stop : stop + STEP]))
            stop += STEP
    except zlib.error:
        return None
    if not box.eof:
        return None
    plain, found, inner = b"".join(parts), [], 0
    while inner < len(plain):
        if (one := _parse(plain, inner)) is None:
            return None
        found.append(one[0])
        inner = one[1]
    return found, min(stop, len(data)) - len(box.unused_data)


def salvage(data: bytes) -> Iterator[tuple[int, int, dict | None]]:
    """(start, end, record) in file order; record is None for a quarantined gap."""
    at, bad = 0, None
    while at < len(data):
        got = _member(data, at) if data[at : at + 3] == b"\x1f\x8b\x08" else None
        if got is None and (one := _parse(data, at)) is not None:
            got = [one[0]], one[1]
        if got is None:
            bad = at if bad is None else bad
            later = _START.search(data, at + 1)
            at = later.start() if later else len(data)
            continue
        if bad is not None:
            yield bad, at, None
            bad = None
        for one in got[0]:
            yield at, got[1], one
        at = got[1]
    if bad is not None:
        yield bad, len(data), None


READ = "path string, start long, stop long, gap boolean, warc_type string, record_id string, url string, refers_to string, payload_digest string, payload binary"


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records and quarantined gaps (``gap``) of all files under ``path``; each file is read by one task."""

    def run(batches):
        import pyarrow as pa

        names = [c.split()[0] for c in READ.split(", ")]
        kinds = [{"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}[c.split()[1]] for c in READ.split(", ")]
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1)):
                data, file, out, held = content.as_py() or b"", file.as_py(), [], 0
                for start, stop, one in salvage(data):
                    h = one["head"] if one else {}
                    digest = h.get("warc-payload-digest", "").removeprefix("sha1:") or (_sha1(one["payload"]) if one else None)
                    out.append((file, start, stop, one is None, h.get("warc-type"), h.get("warc-record-id"), h.get("warc-target-uri"), h.get("warc-refers-to"), digest, one["payload"] if one else None))
                    held += stop - start
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, READ)


def resolve(records: DataFrame) -> DataFrame:
    """Per record read: page_id, record_type, refers_to, and the full payload's bytes and digest, which a
    revisit takes from the response it refers to."""
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    rows = records.filter("NOT gap").select(
        number("record_id").alias("page_id"), F.col("warc_type").alias("record_type"), number("refers_to").alias("refers_to"),
        F.octet_length("payload").cast("long").alias("own"), F.col("payload_digest").alias("digest"),
    )
    rows = keep(rows, "records")
    full = rows.filter("record_type = 'response'").groupBy(F.col("page_id").alias("of"), F.col("digest").alias("of_digest")).agg(F.max("own").alias("full"))
    joined = rows.join(full, same(rows, full, [("refers_to", "of"), ("digest", "of_digest")]) & rows["refers_to"].isNotNull(), "left")
    return joined.select(
        "page_id", F.when(F.col("record_type") == "revisit", F.col("full")).otherwise(F.col("own")).alias("payload_bytes"),
        F.col("digest").alias("payload_digest"), "record_type", "refers_to",
    )
