"""WARC archives: writing, reading, and revisit resolution.

Headers (id, payload digest, length), never payloads, are shuffled by digest to find the response
that each other record of the same payload revisits. Archives are written by Spark's text writer,
one record per row, with the two line ends that close a record as row separator; each task writes
gzip files whose records would not take over `file_bytes` if all were as long as the longest. They are read as whole files and parsed by
Content-Length, so payloads may hold anything, record separators included.

A null payload is empty. A null or blank URL gives a record without WARC-Target-URI; line ends and
other control characters in URLs are percent-encoded. Of rows with one payload, all that have the
smallest id are responses (repeated rows too); rows with a null id are responses only if all are
null. An empty table gives no records. Other columns are dropped.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import importable

VERSION, END = "WARC/1.1", "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADERS = "record_id string, record_type string, page_id string, uri string, payload_digest string, block_digest string, refers_to_record string, refers_to string, block_bytes long, payload_bytes long"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of SHA-1, from the hexadecimal digest by five digits (four letters) at a time."""
    digest = F.sha1(F.encode(payload, "UTF-8"))
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def resolve_revisits(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(id, digest, n, record_type, refers_to) of headers (id, digest, n); payloads under min_bytes are all responses."""
    first = headers.where(F.col("n") >= min_bytes).groupBy("digest").agg(F.min("id").alias("first"))
    known = headers.join(first, "digest", "left")
    again = (F.col("n") >= min_bytes) & F.col("first").isNotNull() & ~F.coalesce(F.col("id") == F.col("first"), F.lit(False))
    return known.select("id", "digest", "n", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"))


def urn(page: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("/", F.coalesce(page.cast("string"), F.lit("")), digest))
    return F.concat(F.lit("<urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in ((F.lit("-") if a > 1 else F.lit("")), F.substring(h, a, n))], F.lit(">"))


def records(pages: DataFrame, id_col: str, payload_col: str, url_col: str | None, min_bytes: int, date: str) -> DataFrame:
    """One string per page: its record, without the line ends that close it."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    uri = F.trim(F.col(url_col)) if url_col else F.lit(None).cast("string")
    for code in (*range(0x21), 0x7F):
        uri = F.replace(uri, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    rows = pages.select(F.col(id_col).alias("id"), payload.alias("payload"), F.when(F.length(uri) > 0, uri).alias("uri"))
    rows = rows.withColumns({"digest": base32_sha1(F.col("payload")), "n": F.octet_length("payload").cast("long")})
    headers = rows.select("id", "digest", "n")
    again = resolve_revisits(headers, min_bytes).where("record_type = 'revisit'").select(F.col("id").alias("own"), F.col("digest").alias("same"), "refers_to").distinct()
    rows = rows.join(again, F.col("id").eqNullSafe(F.col("own")) & (F.col("digest") == F.col("same")), "left").drop("own", "same")
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("n"), F.lit(END * 2))
    block = F.when(revisit, F.col("http")).otherwise(F.concat("http", "payload"))

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(END)), F.lit(""))

    return rows.withColumn("http", http).select(
        F.concat(
            F.lit(VERSION + END),
            line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
            line("WARC-Record-ID", urn(F.col("id"), F.col("digest"))),
            line("WARC-Date", F.lit(date)),
            line("WARC-Target-URI", F.col("uri")),
            line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
            line("WARC-Refers-To", F.when(revisit, urn(F.col("refers_to"), F.col("digest")))),
            line("WARC-Profile", F.when(revisit, PROFILE)),
            line("X-Page-ID", F.col("id").cast("string")),
            line("X-Refers-To-Page-ID", F.col("refers_to").cast("string")),
            line("Content-Type", F.lit("application/http; msgtype=response")),
            F.lit("Content-Length: "), F.octet_length("http") + F.when(revisit, 0).otherwise(F.col("n")), F.lit(END * 2),
            block,
        ).alias("value")
    )


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", payload_col: str = "html", url_col: str | None = "url", min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", file_bytes: int = 256 << 20) -> None:
    """Write one response or revisit record per row to gzip archives under path, of about file_bytes before compression at most, or one record."""
    importable(pages.sparkSession)
    longest = pages.agg(F.max(F.octet_length(payload_col))).first()[0] or 0
    per_file = max(1, file_bytes // (longest + 2048))
    out = records(pages, id_col, payload_col, url_col, min_bytes, date)
    out.write.option("lineSep", END * 2).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", per_file).text(path)


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive (gzip, of one or many members, or plain)."""
    held, rest, done = bytearray(), content, False
    gz = content[:2] == b"\x1f\x8b"
    reader = zlib.decompressobj(31) if gz else None

    def more() -> bool:
        nonlocal rest, reader, done
        if not rest:
            return False
        if reader is None:
            held.extend(rest)
            rest = b""
            return True
        held.extend(reader.decompress(rest, 1 << 20))
        rest = reader.unconsumed_tail
        if reader.eof:
            rest = reader.unused_data
            reader = zlib.decompressobj(31)
        return True

    while True:
        while (cut := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held.strip():
                    raise ValueError("the archive ends within a record's headers")
                return
        lines = held[:cut].decode("utf-8").split(END)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record starts with {lines[0][:40]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        n = int(fields["content-length"])
        while len(held) < cut + 8 + n and more():
            pass
        if len(held) < cut + 4 + n:
            raise ValueError("the archive ends within a record")
        yield fields, bytes(held[cut + 4 : cut + 4 + n])
        del held[: cut + 8 + n]


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Headers of all records under path, digests computed anew from their payloads; with `payloads`, the payloads too."""
    schema = HEADERS + (", payload binary" if payloads else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows: list[tuple] = []
                for h, block in parse(content.as_py()):
                    payload = block.partition(b"\r\n\r\n")[2]
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    row = (h.get("warc-record-id"), h.get("warc-type"), h.get("x-page-id"), h.get("warc-target-uri"), h.get("warc-payload-digest", "").removeprefix("sha1:"), digest, h.get("warc-refers-to"), h.get("x-refers-to-page-id"), len(block), len(payload))
                    rows.append((*row, payload) if payloads else row)
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if n == "payload" else pa.int64() if n.endswith("_bytes") else pa.string()) for n, x in zip(names, zip(*rows))], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if n == "payload" else pa.int64() if n.endswith("_bytes") else pa.string()) for n, x in zip(names, zip(*rows))], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, schema)


def resolved(headers: DataFrame) -> DataFrame:
    """Headers with payload_bytes and payload_digest of the full payload: revisits take them from the response they refer to. A response whose payload is not what its header says is an error."""
    bad = F.raise_error(F.concat(F.lit("payload differs from its digest: "), "record_id")).cast("string")
    answers = headers.where("record_type = 'response'").withColumn("payload_digest", F.when(F.col("payload_digest") == F.col("block_digest"), F.col("block_digest")).otherwise(bad))
    original = answers.groupBy(F.col("record_id").alias("refers_to_record")).agg(F.max("payload_bytes").alias("full_bytes"), F.max("block_digest").alias("full_digest"))
    again = headers.where("record_type = 'revisit'").join(original, "refers_to_record", "left")
    again = again.withColumns({"payload_bytes": F.col("full_bytes"), "payload_digest": F.col("full_digest")}).select(*headers.columns)
    return answers.select(*headers.columns).unionByName(again)
