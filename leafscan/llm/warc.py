"""WARC archives of pages, and transaction assembly: one nested row for each capture.

Every page gives three records: a request, the response (or a revisit of an equal payload) concurrent to it, and metadata. Request and metadata
name the response record in ``WARC-Concurrent-To``; a revisit names in ``WARC-Refers-To`` the response that holds its payload, that of the
smallest page id. Archives are gzip text files with records closed by two line breaks, written and read by Spark alone, so they may lie in any
store; a record is cut out by its ``Content-Length``, as a payload may hold any line. Reading parses each archive in one pass with one record in
memory, then joins the records of a transaction by their identifiers.

Null pages are empty. A null page id is a page of its own: it is response only where no page with an id has the same payload. Rows that
repeat a page id get records of their own; of several rows with the smallest id and the same payload the first (by url) is the response and the
others revisit it. Empty tables give empty archives and no rows; other columns are not looked at; line breaks in a url become blanks.
"""

from __future__ import annotations

import base64
import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from leafscan.llm import common as c
from leafscan.session import settle, shared_folder

END = "\r\n"
CLOSE = END + END
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"  # fixed value: the base32 alphabet
_JAVA32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"  # fixed value: the digits of base 32 in conv()


def payload_digest(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: twenty bits of the hexadecimal digest at a time."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*groups), _JAVA32, _BASE32)


def _record_id(kind: str, page: Column, digest: Column, nth: Column) -> Column:
    h = F.md5(F.encode(F.concat_ws("/", F.lit(kind), F.coalesce(page.cast("string"), F.lit("none")), digest, nth.cast("string")), "UTF-8"))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(kind: Column | str, record_id: Column, url: Column, date: str, more: list[Column], content_type: str, block: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    head = [F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), record_id), F.lit(f"WARC-Date: {date}"),
            F.concat(F.lit("WARC-Target-URI: "), url), *more, F.lit(f"Content-Type: {content_type}"),
            F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(END, F.lit("WARC/1.1"), *head), F.lit(CLOSE), block)


def roles(pages: DataFrame) -> DataFrame:
    """(page_id, digest, first_id) of the distinct pages; ``first_id`` is the smallest id with that payload. Payloads stay where they are."""
    slim = settle(pages.select("page_id", "digest").distinct(), "digests")
    first = settle(slim.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("_n")), "first")
    return c.join_once(slim, first, "digest", "_n")


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write request, response or revisit, and metadata records; payloads under ``min_bytes`` are always responses."""
    rows = pages.select(c.row_id(id_col).alias("page_id"), F.translate(c.text_of(url_col), "\r\n", "  ").alias("url"), F.encode(c.text_of(payload_col), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", payload_digest(F.col("payload")))
    # The page id as text, null as none: the join and the numbering then share one exchange of the payloads.
    key = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    rows = rows.withColumn("_page", key).join(roles(rows).withColumn("_page", key).drop("page_id"), ["_page", "digest"])
    nth = F.row_number().over(Window.partitionBy("_page", "digest").orderBy("url")) - 1
    rows = rows.withColumn("nth", nth)
    page, digest = F.col("page_id"), F.col("digest")
    is_first = page.eqNullSafe(F.col("first_id")) & (F.col("nth") == 0) | (F.octet_length("payload") < min_bytes)
    rows = rows.select(
        "*", is_first.alias("first"), _record_id("capture", page, digest, F.col("nth")).alias("id"),
        _record_id("capture", F.col("first_id"), digest, F.lit(0)).alias("first_record"))
    url = F.col("url")
    path_of = F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^#]*)", 1)
    host_of = F.regexp_extract(url, r"^[a-z]+://([^/?#]*)", 1)
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.octet_length("payload").cast("string"), F.lit(CLOSE))
    body = F.when(F.col("first"), F.concat(F.encode(http, "UTF-8"), F.col("payload")).cast("string")).otherwise(http)
    capture = _record(
        F.when(F.col("first"), "response").otherwise("revisit"), F.col("id"), url, date,
        [F.concat(F.lit("WARC-Payload-Digest: sha1:"), digest),
         F.when(~F.col("first"), F.concat(F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{END}WARC-Refers-To: "), F.col("first_record")))],
        "application/http; msgtype=response", body)
    beside = [F.concat(F.lit("WARC-Concurrent-To: "), F.col("id"))]
    request = _record("request", _record_id("request", page, digest, F.col("nth")), url, date, beside, "application/http; msgtype=request",
                      F.concat(F.lit("GET "), F.when(path_of == "", "/").otherwise(path_of), F.lit(f" HTTP/1.1{END}Host: "), host_of, F.lit(CLOSE)))
    metadata = _record("metadata", _record_id("metadata", page, digest, F.col("nth")), url, date, beside, "application/warc-fields",
                       F.concat(F.lit("page-id: "), F.coalesce(page.cast("string"), F.lit("")), F.lit(END)))
    rows.select(F.explode(F.array(request, capture, metadata)).alias("value")).write.option("compression", "gzip").option("lineSep", CLOSE).text(path)


HEAD = "kind string, record_id string, uri string, concurrent_to string, refers_to string, digest string, block_bytes long, http string, payload_bytes long, payload_digest string, fields string"


def _parsed(kind_block: tuple[dict[str, str], bytes], with_payload: bool) -> dict:
    head, block = kind_block
    kind = head.get("warc-type")
    row = {"kind": kind, "record_id": head.get("warc-record-id"), "uri": head.get("warc-target-uri"), "concurrent_to": head.get("warc-concurrent-to"),
           "refers_to": head.get("warc-refers-to"), "digest": head.get("warc-payload-digest", "").removeprefix("sha1:"), "block_bytes": len(block)}
    if kind in ("response", "revisit", "request"):
        http, _, payload = block.partition(b"\r\n\r\n")
        row["http"] = http.decode("utf-8", "replace")
        if kind == "response":
            row |= {"payload_bytes": len(payload), "payload_digest": base64.b32encode(hashlib.sha1(payload).digest()).decode()}
            if with_payload:
                row["payload"] = payload
        elif kind == "revisit":
            sizes = [x.split(":")[1] for x in row["http"].split("\r\n") if x.lower().startswith("content-length:")]
            row |= {"payload_bytes": int(sizes[0]) if sizes else None, "payload_digest": row["digest"]}
    else:
        row["fields"] = block.decode("utf-8", "replace")
    return row


def _records(pieces):
    """(head fields, block) of each record. The bytes between double line breaks are put together again and cut by each record's length,
    as a block may hold or end in such breaks; breaks before a record (an archive's end) are passed over."""
    pieces, buffer = iter(pieces), bytearray()
    close = CLOSE.encode()

    def more() -> bool:
        piece = next(pieces, None)
        if piece is not None:
            buffer.extend(piece)
            buffer.extend(close)
        return piece is not None

    while True:
        while (start := len(buffer) - len(buffer.lstrip(b"\r\n"))) == len(buffer):
            if not more():
                return
        del buffer[:start]
        while (end := buffer.find(close)) < 0:
            more()
        if not buffer.startswith(b"WARC/"):
            raise ValueError(f"not at the start of a record: {bytes(buffer[:60])!r}")
        lines = buffer[:end].decode("utf-8").split(END)
        head = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        stop = end + 4 + int(head["content-length"])
        while len(buffer) < stop:
            if not more():
                raise ValueError("a record ends before its length")
        yield head, bytes(buffer[end + 4:stop])
        del buffer[:stop]


def read_records(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row for each record. A compressed archive is read from its start to its end by one task."""
    schema = HEAD + ", payload binary" * with_payload
    names = [x.split()[0] for x in schema.split(", ")]

    def work(batches):
        rows, size = [], 0
        for head_block in _records(x.as_py() for batch in batches for x in batch.column(0)):
            rows.append(_parsed(head_block, with_payload))
            size += len(head_block[1])
            if size >= c.SLICE_BYTES or len(rows) >= 10_000:
                yield batch_of(rows)
                rows, size = [], 0
        yield batch_of(rows)

    def batch_of(rows):
        kind_of = {"block_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kind_of.get(n, pa.string())) for n in names], names)

    return spark.read.option("lineSep", CLOSE).text(path).select(F.col("value").cast("binary")).mapInArrow(work, schema)


def captures(records: DataFrame) -> DataFrame:
    """One row for each capture: record id, uri and the nested request, response (or revisit) and metadata, joined by concurrent-to."""
    def part(kinds: list[str], columns: list[str], name: str) -> DataFrame:
        return records.filter(F.col("kind").isin(kinds)).select(
            (F.col("record_id") if name == "response" else F.col("concurrent_to")).alias("capture"), F.struct(*columns).alias(name))

    payload = ["payload"] if "payload" in records.columns else []
    response = part(["response", "revisit"], ["kind", "record_id", "uri", "refers_to", "digest", "http", "payload_bytes", "payload_digest", *payload], "response")
    request = part(["request"], ["record_id", "http"], "request")
    metadata = part(["metadata"], ["record_id", "fields"], "metadata")
    return response.join(request, "capture", "left").join(metadata, "capture", "left")


def page_captures(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each capture in the archives; ``refers_to`` is a page id."""
    page = F.nullif(F.regexp_extract(F.col("metadata.fields"), r"page-id: (-?\d*)", 1), F.lit("")).cast("long")
    rows = captures(settle(read_records(spark, path), "records")).select(
        "capture", page.alias("page_id"), "response.payload_bytes", "response.payload_digest", F.col("response.kind").alias("record_type"), F.col("response.refers_to").alias("_to"))
    # Only revisits are joined; the others have no key that could meet anything.
    rows = settle(rows, "captures")
    result = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    revisits = rows.filter("_to IS NOT NULL")
    counts = revisits.groupBy("_to").agg(F.count(F.lit(1)).alias("_n"))
    targets = counts.join(rows.filter("record_type = 'response'").select(F.col("capture").alias("_to"), F.col("page_id").alias("refers_to")), "_to", "left")
    joined = c.join_once(revisits, settle(targets, "targets"), "_to", "_n")
    return joined.select(*result).unionByName(rows.filter("_to IS NULL").withColumn("refers_to", F.lit(None).cast("long")).select(*result))


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write all pages to a fresh folder below the shared one and read the archives back."""
    spark = pages.sparkSession
    path = f"{shared_folder(spark)}/leafscan/{uuid.uuid4().hex}/archives"
    write_archives(pages, path, id_col, url_col, payload_col, min_bytes)
    return page_captures(spark, path)
