"""WARC archives with an index first: offset, length, URL and digest of every record, then coalesced range reads.

Records are gzip members of their own, so a byte range of the index is a record. Archives are written to shared
storage under names that no other attempt of a task uses, and the index holds only the names of attempts that
were committed: a lost executor leaves an orphan file at worst. Reads of selected records are sorted by archive
and offset, and ranges close to each other become one read.

Of records with equal payloads of `least` bytes or more, that with the largest page id is the response and the
others are revisits of it. A page's id is a header of its own; a record's id is named by page id and payload, and by its place
in an archive too where several rows have both alike, so no two records share one. Defined cases: a null payload is empty; a
null id sorts below all others, leaves its header out and comes back as null; a null URL leaves the header out, and bytes that
no header can hold are percent-encoded; repeated rows are records each, of which those that hold the largest id are all
responses (their revisits name the page, not one of the records); an empty table gives an empty index; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, partitions, shared_root

INDEX = "page_id long, url string, payload_digest string, record_type string, archive string, `offset` long, length long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
#: Extension headers: the page's id, and for revisits that of the response's page.
PAGE, REFERS = "X-Page-ID", "X-Refers-To-Page-ID"
#: Rows (of a digest, ids and a URL) that are broadcast at most.
MARKED = 200_000
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(n.strip("`"), kinds[t]) for n, t in (c.split() for c in ddl.split(", "))])


def open_store(root: str):
    """File system and path of a folder that Spark names by URI."""
    from pyarrow import fs

    if root.startswith("file:"):
        root = "file:///" + root.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(root) if ":" in root else (fs.LocalFileSystem(), root)


def record_id(page: int | None, named: str, place: str = "") -> str:
    """Of the record of a page id with a payload of that digest; place: where there are several such."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{page} {named} {place}'.encode()).digest()[:16], version=5)}>"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def make_record(page: int | None, url: str | None, payload: bytes, keeper: int | None, keeper_url: str | None, date: str, place: str = "", many: bool = False) -> tuple[bytes, str]:
    """One record's bytes and its payload's digest; a keeper makes it a revisit (many: several records are the keeper's)."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block, named = http + payload if keeper is None else http, digest(payload)
    uri = lambda u: quote(u, safe="!#$%&'()*+,/:;=?@[]~-._")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if keeper is None else 'revisit'}", f"WARC-Record-ID: {record_id(page, named, place)}", f"WARC-Date: {date}"]
    if page is not None:
        lines.append(f"{PAGE}: {page}")
    if url is not None:
        lines.append(f"WARC-Target-URI: {uri(url)}")
    if keeper is not None:
        lines += [f"WARC-Profile: {_PROFILE}", f"{REFERS}: {keeper}", *[f"WARC-Refers-To: {record_id(keeper, named)}"] * (not many)]
        if keeper_url is not None:
            lines.append(f"WARC-Refers-To-Target-URI: {uri(keeper_url)}")
    lines += [f"WARC-Payload-Digest: sha1:{named}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", named


def parse_record(raw: bytes) -> dict:
    """Headers and payload of one record; raises when length or digest don't hold."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
    named = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = headers["WARC-Type"]
    if not version.startswith("WARC/") or rest[len(block) :] != b"\r\n\r\n" or kind == "response" and (len(payload) != size or digest(payload) != named):
        raise ValueError(f"damaged record {headers.get('WARC-Record-ID')}")
    number = lambda name: int(headers[name]) if name in headers else None
    return {"page_id": number(PAGE), "url": headers.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": named, "record_type": kind, "refers_to": number(REFERS), "payload": payload if kind == "response" else None}


def with_keepers(pages: DataFrame, scratch: Scratch, least: int, id_col: str, url_col: str, text_col: str) -> DataFrame:
    """page_id, url, payload; for revisits keeper, keeper_url and whether several rows are the keeper (many); and whether
    several rows have this id and payload (alike).

    All is found on digests (aggregates, so a hot payload is combined before the exchange) and written. What is marked is
    broadcast where it is at most MARKED rows; beyond, payloads move once, by page id and digest."""
    payload = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha", F.unhex(F.sha1("payload")))
    slim = rows.select("page_id", "url", "sha", F.octet_length("payload").alias("bytes"))
    each = scratch.table(slim.groupBy("sha", "bytes", "page_id").agg(F.max("url").alias("url"), F.count(F.lit(1)).alias("n")), "each")
    best = each.groupBy("sha", "bytes").agg(F.max(F.struct("page_id", "url", "n")).alias("best"), F.count(F.lit(1)).alias("pages")).filter(F.col("pages") > 1).filter(F.col("bytes") >= least)
    best = scratch.table(best.select(F.col("sha").alias("s"), "best"), "best")
    marks = each.join(best, F.col("sha") == F.col("s"), "left").withColumn("revisit", F.col("best").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("best.page_id")))
    when = lambda c: F.when(F.col("revisit"), F.col(c))
    marks = marks.filter("revisit or n > 1").select(F.col("page_id").alias("p"), F.col("sha").alias("s"), when("best.page_id").alias("keeper"), when("best.url").alias("keeper_url"), (F.col("best.n") > 1).alias("many"), (F.col("n") > 1).alias("alike"))
    marks = scratch.table(marks, "marks")
    marks = F.broadcast(marks) if marks.count() <= MARKED else marks
    out = rows.join(marks, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("sha") == F.col("s")), "left")
    return out.select("page_id", "url", "payload", "keeper", "keeper_url", F.coalesce("many", F.lit(False)).alias("many"), F.coalesce("alike", F.lit(False)).alias("alike"))


def write_archives(pages: DataFrame, root: str | None = None, least: int = 0, date: str = "1970-01-01T00:00:00Z", roll_bytes: int = 1 << 30, id_col: str = "page_id", url_col: str = "url", text_col: str = "html") -> DataFrame:
    """Write every row as a record and return the index, itself a written table under root."""
    spark = pages.sparkSession
    root = root or f"{shared_root(spark)}/warc-{uuid.uuid4().hex}"
    schema, scratch = _schema(INDEX), Scratch(spark, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = open_store(f"{root}/archives")
        out, name, at = None, "", 0
        try:
            for batch in batches:
                rows = []
                for page, url, payload, keeper, keeper_url, many, alike in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                    if out is None or at >= roll_bytes:
                        if out is not None:
                            out.close()
                        store.create_dir(folder, recursive=True)
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{folder}/{name}", compression=None)
                    raw, named = make_record(page, url, payload, keeper, keeper_url, date, f"{name} {at}" if alike else "", many)
                    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
                    raw = squeeze.compress(raw) + squeeze.flush()
                    out.write(raw)
                    rows.append((page, url, named, "response" if keeper is None else "revisit", name, at, len(raw)))
                    at += len(raw)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 7, schema, strict=True)], schema=schema)
        finally:
            if out is not None:
                out.close()

    index = with_keepers(pages, scratch, least, id_col, url_col, text_col).mapInArrow(run, INDEX)
    index.write.mode("overwrite").parquet(f"{root}/index")
    scratch.drop("each", "best", "marks")
    return spark.read.schema(INDEX).parquet(f"{root}/index").withColumn("root", F.lit(root))


def read_records(selected: DataFrame, payloads: bool = True, gap: int = 64 << 10, most: int = 8 << 20) -> DataFrame:
    """The records of some rows of the index, read from the archives in sorted, coalesced byte ranges."""
    schema = _schema(RECORDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, opened, source = None, None, None
        for batch in batches:
            rows = list(zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True))
            at = 0
            while at < len(rows):
                root, name, begin, _ = rows[at]
                end, to = begin, at
                while to < len(rows) and rows[to][:2] == (root, name) and rows[to][2] - end <= gap and (to == at or rows[to][2] + rows[to][3] - begin <= most):
                    end, to = max(end, rows[to][2] + rows[to][3]), to + 1
                if opened != (root, name):
                    if source is not None:
                        source.close()
                    store, folder = open_store(f"{root}/archives")
                    opened, source = (root, name), store.open_input_file(f"{folder}/{name}")
                raw = source.read_at(end - begin, begin)
                found = [parse_record(zlib.decompress(raw[o - begin : o - begin + n], 31)) for _, _, o, n in rows[at:to]]
                if not payloads:
                    found = [x | {"payload": None} for x in found]
                yield pa.RecordBatch.from_pylist(found, schema=schema)
                at = to
        if source is not None:
            source.close()

    spark = selected.sparkSession
    by_place = selected.select("root", "archive", "offset", "length").repartitionByRange(partitions(spark), "root", "archive", "offset").sortWithinPartitions("root", "archive", "offset")
    return by_place.mapInArrow(run, RECORDS)
