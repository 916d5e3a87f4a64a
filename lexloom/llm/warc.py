"""A deterministic, sharded WARC writer and its reader.

Records are range-sorted by id; each task writes its range as files that roll at a compressed size, under temporary
names that are renamed when a file is whole. What a task wrote goes to a manifest, written as a table; readers take
only files of the manifest and hold them to it. Record headers and digests are made anew from the payload, and the
ranges depend on the ids and payload sizes alone, so equal input gives equal files, however it is partitioned.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import fraction, hash_unit, new_path, texts, written

#: Compressed bytes from which a file is closed; payload bytes that a range has, roughly; the date of all records.
ROLL_BYTES, RANGE_BYTES, DATE = 32 << 20, 48 << 20, "2000-01-01T00:00:00Z"
#: Rows, chosen by a hash of their ids, whose payload sizes set the bounds of the ranges; all rows are written.
BOUND_ROWS = 500_000
_PAGE, _TEMPORARY = "urn:lexloom:page:", "_temporary"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _http_header(n: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()


def record(page_id: int | None, copy: int, url: str | None, payload: bytes, digest: str, refers_to: int | None, is_revisit: bool) -> bytes:
    """One WARC/1.1 record, uncompressed. A revisit holds the HTTP header only. copy tells apart records of one page and
    payload; a response that others revisit has copy 0."""
    http = _http_header(len(payload))
    block = http if is_revisit else http + payload
    clean = "".join(c for c in url or "" if c >= " ").strip()
    head = [
        ("WARC-Type", "revisit" if is_revisit else "response"),
        ("WARC-Record-ID", f"<{_PAGE}{'' if page_id is None else page_id}:{digest}:{copy}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", clean or "urn:lexloom:none"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{payload_digest(block)}"),
        ("X-Payload-Length", str(len(payload))),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if is_revisit:
        head[2:2] = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{_PAGE}{'' if refers_to is None else refers_to}:{digest}:0>")]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)  # a gzip header without a time
    return z.compress(data) + z.flush()


class _Shards:
    """The files of one task."""

    def __init__(self, where: str, part: int, roll: int):
        self.fs, self.dir = fs.FileSystem.from_uri(where)
        self.part, self.roll, self.n, self.out = part, roll, 0, None
        self.done: list[tuple] = []

    def add(self, data: bytes) -> None:
        if self.out is None:
            self.name = f"shard-{self.part:06d}-{self.n:05d}.warc.gz"
            self.temporary = f"{self.dir}/{_TEMPORARY}/{self.name}.{uuid.uuid4().hex}"
            self.out, self.size, self.records, self.sum = self.fs.open_output_stream(self.temporary, compression=None), 0, 0, hashlib.sha256()
            info = f"software: lexloom\r\nformat: WARC File Format 1.1\r\nisPartOf: {self.name}\r\n".encode()
            self._put(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:lexloom:file:{self.name}>\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode() + info + b"\r\n\r\n")
        self._put(data)
        self.records += 1
        if self.size >= self.roll:
            self.close()

    def _put(self, data: bytes) -> None:
        z = _member(data)
        self.out.write(z)
        self.sum.update(z)
        self.size += len(z)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.move(self.temporary, f"{self.dir}/{self.name}")
            self.done.append((self.name, self.records, self.size, self.sum.hexdigest()))
            self.out, self.n = None, self.n + 1


def _bounds(sizes: DataFrame) -> np.ndarray:
    """The first ids of all ranges but the first, from (page_id, n): ranges hold about RANGE_BYTES of payload each."""
    rows, total = sizes.agg(F.count("page_id"), F.sum("n")).first()
    picked = sizes.where("page_id IS NOT NULL").where(hash_unit("page_id") < fraction(rows, BOUND_ROWS))
    got = picked.groupBy("page_id").agg(F.sum("n").alias("n")).toArrow()
    ids, n = (got.column(i).to_numpy().astype(np.int64) for i in range(2))
    order = np.argsort(ids)
    before = np.cumsum(n[order]) - n[order]
    ranges = max(8, -(-(total or 0) // RANGE_BYTES))
    place = before * ranges // max(1, int(n.sum()))
    return ids[order][1:][place[1:] != place[:-1]]


def write_warc(pages: DataFrame, path: str | None = None, min_payload: int = 0, roll: int = ROLL_BYTES) -> str:
    """Writes pages (page_id, url, html) to path, a new folder under spark.checkpoint.dir by default; gives the path.

    Of the records with equal payloads of at least min_payload bytes, the one with the largest page_id is a response
    and the others are revisits of it; among rows that repeat that page_id too, the first written is. A null html is an
    empty payload. Null ids sort first and count as less than any id; if no copy has an id, refers_to is null. An empty
    table gives a manifest without files. Other columns are ignored.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    seen = written(rows.select("page_id", F.sha1("html").alias("sha"), F.octet_length("html").alias("n")), "payloads")
    last = seen.where(F.col("n") >= min_payload).groupBy("sha").agg(F.max("page_id").alias("last"), F.count("*").alias("copies")).where("copies > 1")
    # Only payloads with copies are looked up; those rows travel beside the pages and meet them in id order.
    links = seen.join(last, "sha").select("page_id", F.lit(0).alias("kind"), "sha", "last", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html")).distinct()
    full = rows.select("page_id", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("sha"), F.lit(None).cast("long").alias("last"), "url", "html")
    bounds = _bounds(seen.select("page_id", "n"))
    parts, shared = len(bounds) + 1, spark.sparkContext.broadcast(bounds)
    target = _made(path)
    where, folder = fs.FileSystem.from_uri(target)
    where.create_dir(f"{folder}/{_TEMPORARY}")

    @F.pandas_udf("int")
    def range_of(page_id: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(shared.value, page_id.to_numpy(np.int64), "right").astype(np.int32))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out = _Shards(target, TaskContext.get().partitionId(), roll)
        page, links_of, copies = object(), {}, Counter()
        for b in batches:
            ids, kinds, shas, lasts, urls = (b.column(i).to_pylist() for i in range(5))
            for i, html in enumerate(texts(b, "html")):
                if ids[i] != page:
                    page, links_of, copies = ids[i], {}, Counter()
                if kinds[i] == 0:
                    links_of[shas[i]] = lasts[i]
                    continue
                sha = hashlib.sha1(html).digest()
                again = sha.hex() in links_of and (links_of[sha.hex()] != page or copies[sha] > 0)
                out.add(record(page, copies[sha], urls[i], html, base64.b32encode(sha).decode(), links_of.get(sha.hex()), again))
                copies[sha] += 1
        out.close()
        cols = list(zip(*out.done, strict=True)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["file", "records", "bytes", "sha256"])

    least = F.lit(-(1 << 63))  # null ids belong to the first range
    placed = links.unionByName(full).withColumn("range", range_of(F.coalesce("page_id", least)))
    ordered = placed.repartitionById(parts, F.col("range")).drop("range").sortWithinPartitions("page_id", "kind", "url", "html")
    ordered.mapInArrow(write, "file string, records long, bytes long, sha256 string").write.parquet(f"{path}/manifest")
    where.delete_dir(f"{folder}/{_TEMPORARY}")  # what failed attempts left
    return path


def _made(path: str) -> str:
    """The path as a URI, its folder made."""
    uri = path if "://" in path else "file://" + path.removeprefix("file:")
    where, folder = fs.FileSystem.from_uri(uri)
    where.create_dir(folder, recursive=True)
    return uri


def parse_records(data: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a gzipped archive, one member at a time."""
    z, buffer = zlib.decompressobj(31), []
    for chunk in data:
        while chunk:
            buffer.append(z.decompress(chunk))
            chunk = z.unused_data if z.eof else b""
            if z.eof:
                head, _, rest = b"".join(buffer).partition(b"\r\n\r\n")
                lines = head.decode().split("\r\n")
                if lines[0] != "WARC/1.1":
                    raise ValueError(f"not a WARC record: {lines[0][:80]!r}")
                fields = dict(x.split(": ", 1) for x in lines[1:])
                yield fields, rest[: int(fields["Content-Length"])]
                z, buffer = zlib.decompressobj(31), []
    if any(buffer):
        raise ValueError("the archive ends within a record")


def read_warc(spark, path: str) -> DataFrame:
    """The page records of the files in the manifest: page_id, payload_bytes, payload_digest, record_type, refers_to,
    url and payload (null for revisits). Digests of blocks and payloads are checked, and each file's records, bytes and
    digest against the manifest; a wrong one fails the job."""
    target = _made(path)
    files = spark.read.parquet(f"{path}/manifest").select("file", "records", "bytes", "sha256")

    def number(urn: str | None) -> int | None:
        x = urn[1 + len(_PAGE) : -1].split(":")[0] if urn else ""
        return int(x) if x else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, folder = fs.FileSystem.from_uri(target)
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        for b in batches:
            for name, *wanted in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows, held, records, total, digest_of = [], 0, 0, 0, hashlib.sha256()

                def chunks(f, digest_of=digest_of) -> Iterator[bytes]:
                    nonlocal total
                    while chunk := f.read(1 << 20):
                        digest_of.update(chunk)
                        total += len(chunk)
                        yield chunk

                with where.open_input_stream(f"{folder}/{name}", compression=None) as f:
                    for h, block in parse_records(chunks(f)):
                        if h["WARC-Type"] == "warcinfo":
                            continue
                        digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                        payload = block.partition(b"\r\n\r\n")[2] if h["WARC-Type"] == "response" else None
                        if "sha1:" + payload_digest(block) != h["WARC-Block-Digest"] or (payload is not None and (payload_digest(payload) != digest or len(payload) != int(h["X-Payload-Length"]))):
                            raise ValueError(f"wrong digest in {name}: {h['WARC-Record-ID']}")
                        rows.append((number(h["WARC-Record-ID"]), int(h["X-Payload-Length"]), digest, h["WARC-Type"], number(h.get("WARC-Refers-To")), h["WARC-Target-URI"], payload))
                        held, records = held + len(block), records + 1
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                            rows, held = [], 0
                if wanted != [records, total, digest_of.hexdigest()]:
                    raise ValueError(f"{name} is not the file of the manifest: {records} records, {total} bytes")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return files.repartition(spark.sparkContext.defaultParallelism * 4).mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")
