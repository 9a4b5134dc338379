"""WARC: write captures as request, response or revisit, and metadata records; read archives back.

A capture's three records share one transaction: request and metadata name the response (or
revisit) record in ``WARC-Concurrent-To``. Reading parses each archive record by record by its
``Content-Length`` and joins the three kinds through that identifier into one nested row.

Archives are ordinary gzipped WARC 1.1 text written by Spark's own writer, so they land in any store
that Spark can write and a lost executor's files are never committed.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, new_path, pick

#: Bytes of payload in one archive file, which one task reads whole; a larger capture is a file by itself.
ARCHIVE_BYTES = 64 << 20
#: Payloads up to this size are taken as so large, which bounds the captures of a file; larger ones are
#: dealt into classes, each GROWTH times the size of the one before.
LEAST_CLASS = 16 << 10
GROWTH = 4
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"
HEX32, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1, from the hex digest in four runs of 40 bits."""
    h = F.sha1(payload)
    runs = [F.translate(F.lpad(F.conv(F.substring(h, 1 + 10 * i, 10), 16, 32), 8, "0"), HEX32, BASE32) for i in range(4)]
    return F.concat(*runs)


def _urn(kind: str, *of: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.lit(kind), *[F.coalesce(c.cast("string"), F.lit("")) for c in of]).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _record(kind: Column, rid: Column, headers: list[Column], block: Column) -> Column:
    """``headers`` are whole lines or null."""
    head = F.concat_ws("\r\n", F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), rid), F.lit(f"WARC-Date: {DATE}"), *headers, F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(head, F.lit(END), block)


def with_references(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Adds payload, digest, n_bytes and ``first``: the (page_id, url) that equal payloads refer to.

    Equal payloads are pre-aggregated to their largest page_id, so a payload that a third of all
    pages share is one row before the shuffle; the join back is splittable by adaptive execution.
    """
    p = pick(pages, "page_id", "url", "html").select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    p = p.select("*", base32_sha1(F.col("payload")).alias("digest"), F.octet_length("payload").cast("long").alias("n_bytes"))
    first = p.groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("first"), F.count(F.lit(1)).alias("n"))
    first = first.where("n > 1").select("digest", "first")
    own = F.struct("page_id", "url")
    return p.join(first, "digest", "left").withColumn("first", F.when(F.col("n_bytes") >= min_bytes, F.coalesce("first", own)).otherwise(own))


def write_archives(spark: SparkSession, pages: DataFrame, path: str, min_bytes: int = 0) -> str:
    """Writes a transaction per row of ``pages`` (page_id, url, html) below ``path``; returns it.

    A file holds captures of one size class of one task and no more of them than fill ARCHIVE_BYTES.

    A null html is an empty payload, a null url gives no target header, a null page_id counts as
    the smallest. Rows tied on the largest page_id of a payload are all responses.
    """
    p = with_references(pages, min_bytes)
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    main = _urn("capture", F.col("page_id"), F.col("digest"), F.col("url"))
    revisit = ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    target = F.concat(F.lit("WARC-Target-URI: "), uri)
    concurrent = F.concat(F.lit("WARC-Concurrent-To: "), main)
    get = F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(" HTTP/1.1\r\nHost: "), F.regexp_extract(F.coalesce(uri, F.lit("")), "^[a-z]+://([^/?#]+)", 1), F.lit(END))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n_bytes").cast("string"), F.lit(END))
    request = _record(F.lit("request"), _urn("request", F.col("page_id"), F.col("digest"), F.col("url")), [target, concurrent, F.lit("Content-Type: application/http;msgtype=request")], get)
    capture = _record(
        F.when(revisit, "revisit").otherwise("response"),
        main,
        [
            target,
            F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
            F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _urn("capture", F.col("first.page_id"), F.col("digest"), F.col("first.url")))),
            F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
            F.lit("Content-Type: application/http;msgtype=response"),
        ],
        F.when(revisit, http).otherwise(F.concat(http, F.col("payload"))),
    )
    about = _record(F.lit("metadata"), _urn("metadata", F.col("page_id"), F.col("digest"), F.col("url")), [target, concurrent, F.lit("Content-Type: application/warc-fields")], F.concat(F.lit("page_id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\n")))
    out = p.select(F.concat(request, F.lit(END), capture, F.lit(END), about).alias("value"), *_file(F.col("n_bytes")))
    out.write.option("lineSep", END).option("compression", "gzip").partitionBy("size_class", "slot").text(path)
    return path


def _file(n_bytes: Column) -> list[Column]:
    """Size class, and number of the file within its class and task: rows of a task are numbered, so
    every run of as many numbers as a file may have captures has no more captures than that."""
    most, of, captures = LEAST_CLASS, F.lit(0), F.lit(max(1, ARCHIVE_BYTES // LEAST_CLASS))
    k = 0
    while most < ARCHIVE_BYTES:
        k, beyond = k + 1, n_bytes > most
        most *= GROWTH
        of, captures = F.when(beyond, k).otherwise(of), F.when(beyond, max(1, ARCHIVE_BYTES // most)).otherwise(captures)
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return [of.alias("size_class"), F.floor(row / captures).alias("slot")]


FIELDS = "type string, id string, concurrent_to string, refers_to string, uri string, stated_digest string, page_id long, payload_bytes long, payload_digest string, payload binary"


def _inflate(raw: bytes) -> bytes:
    if raw[:2] != b"\x1f\x8b":
        return raw
    out = []
    while raw:
        z = zlib.decompressobj(31)
        out.append(z.decompress(raw) + z.flush())
        raw = z.unused_data
    return b"".join(out)


def parse_archive(raw: bytes) -> Iterator[dict]:
    """Records of one archive, plain or gzipped in one or many members; cut only by Content-Length."""
    data, at = _inflate(raw), 0
    view = memoryview(data)
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.index(b"\r\n\r\n", at)
        head = {}
        for line in data[at:end].decode("utf-8").split("\r\n")[1:]:
            k, _, v = line.partition(":")
            head.setdefault(k.strip().lower(), v.strip())
        start = end + 4
        at = start + int(head["content-length"])
        yield {"head": head, "block": view[start:at]}


def _row(record: dict, keep: bool) -> dict:
    head, block = record["head"], bytes(record["block"])
    kind, digest = head.get("warc-type"), head.get("warc-payload-digest", "").removeprefix("sha1:") or None
    row = {"type": kind, "id": head.get("warc-record-id"), "concurrent_to": head.get("warc-concurrent-to"), "refers_to": head.get("warc-refers-to"), "uri": head.get("warc-target-uri"), "stated_digest": digest}
    if kind == "metadata":
        value = dict(x.partition(":")[::2] for x in block.decode("utf-8").split("\r\n")).get("page_id", "").strip()
        row["page_id"] = int(value) if value else None
    elif kind in ("response", "revisit"):
        http, _, payload = block.partition(b"\r\n\r\n")
        if kind == "response":
            row |= {"payload_bytes": len(payload), "payload_digest": base64.b32encode(hashlib.sha1(payload).digest()).decode(), "payload": payload if keep else None}
        else:  # the payload's length and digest are stated, its bytes are in the record it refers to
            fields = {k.strip().lower(): v for k, _, v in (x.partition(":") for x in http.decode("utf-8").split("\r\n")[1:])}
            row |= {"payload_bytes": int(fields["content-length"]), "payload_digest": digest}
    return row


def read_records(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """One row per record of the archives below ``path``."""
    names = [x.split()[0] for x in FIELDS.split(", ")]
    kinds = [{"long": pa.int64(), "binary": pa.binary()}.get(x.split()[1], pa.string()) for x in FIELDS.split(", ")]

    def flush(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0):
                rows, held = [], 0
                for record in parse_archive(raw.as_py()):
                    rows.append(_row(record, keep_payload))
                    held += len(record["block"])
                    if len(rows) >= 2000 or held > 8 << 20:
                        yield flush(rows)
                        rows, held = [], 0
                yield flush(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("content").mapInArrow(run, FIELDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: request, capture (response or revisit), metadata, refers_page_id,
    verified.

    Captures without a request or metadata keep a null there; equal captures repeat as often as
    their main record does. ``refers_page_id`` is the page of the response that a revisit names, and a
    revisit takes its payload's length and digest from that response. ``verified`` tells whether what
    the record states agrees with the payload (for a revisit, with the response's); a revisit whose
    response isn't there keeps what it states and is not verified. No records give no rows.

    Only revisits are joined to responses: responses refer to nothing, so their rows would meet in one
    task. ``records`` is read several times and should be a table that is written.
    """
    main = records.where("type in ('response', 'revisit')")
    inner = ["id", "type", "uri", "refers_to", "stated_digest", "payload_bytes", "payload_digest", "payload"]
    main = main.groupBy("id").agg(F.first(F.struct(*inner)).alias("capture"), F.count(F.lit(1)).alias("n"))
    request = records.where("type = 'request'").groupBy(F.col("concurrent_to").alias("id")).agg(F.first(F.struct(F.col("id").alias("id"), "uri")).alias("request"))
    about = records.where("type = 'metadata'").groupBy(F.col("concurrent_to").alias("id")).agg(F.first(F.struct(F.col("id").alias("id"), "page_id")).alias("metadata"))
    rows = main.join(request, "id", "left").join(about, "id", "left")
    own = F.col("capture")
    agree = F.coalesce(own["stated_digest"] == own["payload_digest"], F.lit(True))
    responses = rows.where("capture.type = 'response'").select("capture", "n", "request", "metadata", F.lit(None).cast("long").alias("refers_page_id"), agree.alias("verified"))
    to = rows.where("capture.type = 'response'").select(
        F.col("id").alias("to_id"), F.col("metadata.page_id").alias("refers_page_id"), own["payload_bytes"].alias("to_bytes"), own["payload_digest"].alias("to_digest")
    )
    revisits = rows.where("capture.type = 'revisit'").withColumn("names", F.col("capture.refers_to")).join(to, F.col("names") == F.col("to_id"), "left")
    same = F.coalesce((own["payload_bytes"] == F.col("to_bytes")) & (own["payload_digest"] == F.col("to_digest")), F.lit(False))
    full = own.withField("payload_bytes", F.coalesce("to_bytes", own["payload_bytes"])).withField("payload_digest", F.coalesce("to_digest", own["payload_digest"]))
    revisits = revisits.select(full.alias("capture"), "n", "request", "metadata", "refers_page_id", same.alias("verified"))
    rows = responses.unionByName(revisits)
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).drop("n", "copy")


def round_trip(spark: SparkSession, pages: DataFrame, keep_payload: bool = False) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) to new archives in the shared folder and reads them back,
    assembled; the archives are read once.

    A null html is an empty payload, a null url gives no target, a null page_id counts as the smallest.
    Repeated rows give repeated captures; rows tied on the largest page_id of a payload are all
    responses. Payloads may be of any length that fits in one row. An empty table gives no rows. Further
    columns are not read.
    """
    path = write_archives(spark, pages, new_path(spark, "warc"))
    return assemble(materialize(spark, read_records(spark, path, keep_payload), "warc-records"))
