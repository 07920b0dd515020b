"""WARC archives: written with one gzip member per record, read back sequentially.

The reader takes a file in small pieces: each gzip member is inflated incrementally, the record's head is parsed, the
block is framed by Content-Length, and block and payload digests are verified while the bytes pass by.

Defined cases: a null payload is the empty one; payloads under `min_bytes` are never revisits; among equal payloads the
smallest id is the response (null ids last; repeated rows of that id are all responses); ids and URLs may be null; line
breaks in a URL are percent-encoded; an empty table gives no file and no row; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base, files

#: Digests that are broadcast at most, about 50 MB.
FIRSTS = 400_000
#: A file is closed beyond this size.
FILE_BYTES = 1 << 30
PIECE = 1 << 18
SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


class WarcError(ValueError):
    """A record whose framing or digest is wrong."""


def _uri(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def _id(uri: str | None) -> int | None:
    n = (uri or "").removeprefix("<urn:x-page:").removesuffix(">")
    return int(n) if n else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record as a gzip member. A revisit carries the HTTP head alone, whose Content-Length is the payload's."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_uri(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20%]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_uri(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + pack.flush()


def _members(stream) -> Iterator[Iterator[bytes]]:
    """For each gzip member its inflated pieces; a member is used up before the next begins."""
    rest = stream.read(PIECE)

    def pieces():
        nonlocal rest
        inflate = zlib.decompressobj(31)
        while not inflate.eof:
            if not rest and not (rest := stream.read(PIECE)):
                raise WarcError("the file ends within a record")
            out = inflate.decompress(rest, PIECE)
            rest = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
            if out:
                yield out

    while rest or (rest := stream.read(PIECE)):
        yield pieces()


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}


def read_records(stream, keep_payload: bool = False) -> Iterator[dict]:
    """The records of a file, verified; payloads only if asked for, else no more than a piece of one is held."""
    for pieces in _members(stream):
        head = b""
        while b"\r\n\r\n" not in head:
            head += next(pieces, None) or _fail("a record without a head")
        raw, _, body = head.partition(b"\r\n\r\n")
        if not raw.startswith(b"WARC/1."):
            raise WarcError("not a WARC record")
        h = _fields(raw)
        left, block, payload, n, http, kept = int(h["content-length"]), hashlib.sha256(), hashlib.sha256(), 0, b"", []
        in_head = True
        while True:
            part, extra = body[:left], body[left:]
            left -= len(part)
            block.update(part)
            if in_head:
                http += part
                if b"\r\n\r\n" in http:
                    http, _, part = http.partition(b"\r\n\r\n")
                    in_head = False
            if not in_head:
                payload.update(part)
                n += len(part)
                if keep_payload:
                    kept.append(part)
            if not left:
                break
            body = next(pieces, None) or _fail("a block shorter than its Content-Length")
        if extra + b"".join(pieces) != b"\r\n\r\n":
            raise WarcError("a record does not end after its block")
        revisit = h["warc-type"] == "revisit"
        digest = h["warc-payload-digest"].removeprefix("sha256:")
        if block.hexdigest() != h["warc-block-digest"].removeprefix("sha256:") or not revisit and payload.hexdigest() != digest:
            raise WarcError("a digest does not match")
        yield {
            "page_id": _id(h["warc-record-id"]), "url": re.sub("%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), u) if (u := h.get("warc-target-uri")) is not None else None,
            "payload_bytes": int(_fields(http)["content-length"]) if revisit else n, "payload_digest": digest,
            "record_type": h["warc-type"], "refers_to": _id(h.get("warc-refers-to")) if revisit else None,
        } | ({"payload": b"".join(kept)} if keep_payload else {})


def _fail(what: str):
    raise WarcError(what)


def marked(pages: DataFrame, min_bytes: int = 100, broadcast_rows: int = FIRSTS) -> DataFrame:
    """page_id, url, html, digest, first_id (the response's id; null where the row is no revisit).

    The smallest id per digest is a map-side combined minimum over narrow rows; digests that occur twice or more are
    written. While they are few they are broadcast, and no html is moved at all; beyond that they meet the pages in a merge
    join of two plain shuffles, of which AQE can split the side of a hot payload's pages.
    """
    rows = pages.select("page_id", "url", base.text_of("html").alias("html")).withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    some = (
        rows.filter(F.octet_length("html") >= min_bytes).groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    )
    firsts = base.saved(some, "warc-firsts")
    few = firsts.count() <= broadcast_rows
    return rows.join(F.broadcast(firsts) if few else firsts.hint("merge"), "digest", "left").withColumn(
        "first_id", F.when(F.col("first_id").isNotNull() & ~F.col("first_id").eqNullSafe(F.col("page_id")), F.col("first_id"))
    )


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 100, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes pages as archives into folder and returns the manifest (url, n_records, n_bytes).

    Files have names of their own and count once the manifest has them; what a lost or repeated task left is ignored.
    """

    def write(batches):
        out, url, n, size = None, "", 0, 0
        for b in batches:
            for page_id, link, html, digest, first in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if out is None:
                    url, out = files.new_file(folder, ".warc.gz")
                data = record(page_id, link, html.encode(), digest, first, first is not None)
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= file_bytes:
                    out.close()
                    yield _manifest(url, n, size)
                    out, n, size = None, 0, 0
        if out is not None:
            out.close()
            yield _manifest(url, n, size)

    rows = marked(pages, min_bytes).select("page_id", "url", "html", "digest", "first_id")
    return base.saved(rows.mapInArrow(write, "url string, n_records long, n_bytes long"), "warc-manifest")


def _manifest(url: str, n: int, size: int):
    import pyarrow as pa

    return pa.RecordBatch.from_pydict({"url": [url], "n_records": [n], "n_bytes": [size]})


def read_archives(manifest: DataFrame) -> DataFrame:
    """The records of the archives in the manifest, one task's worth of files at a time."""

    def read(batches):
        import pyarrow as pa

        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        for b in batches:
            for url, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows, seen = [], 0
                with files.read_from(url) as stream:
                    for r in read_records(stream):
                        rows.append(r)
                        seen += 1
                        if len(rows) == 1000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                if seen != n:
                    raise WarcError(f"{url} has {seen} records, the manifest says {n}")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    spark = manifest.sparkSession
    spread = manifest.select("url", "n_records").repartition(max(base.cores(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))), "url")
    return spread.mapInArrow(read, SCHEMA)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(base.table(spark, sf_dir, "pages"), base.scratch(spark, "warc"))
    return read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = {
    "op5_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first_id FROM p),
r AS (SELECT *, n >= 100 AND first_id <> page_id AS again FROM f)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first_id END AS refers_to FROM r
""",
}
QUERIES = {"op5_warc": op5_warc}
