"""WARC archives of web pages: a deterministic sharded writer, and the reader.

Records are sorted by page id. Shards are ranges of ids of about ``SHARD_BYTES`` of payload, cut from a
sample of ids that a hash picks, so the same pages give the same files byte for byte. A shard's task streams
its records: it makes headers and digests anew, compresses each record by itself and begins a new file
when the compressed size passes ``ROLL_BYTES``. Files are written under temporary names and renamed when
complete; an attempt that is repeated renames equal bytes to the same name. The manifest (file, records,
bytes, sha256, range of ids) is a table that Spark commits last; readers take only files it lists.

Of records with equal payloads of at least ``min_revisit`` bytes the one with the smallest page id is a
response, the others are revisits that name it. Equal payloads meet as digests: html is shuffled once.

Results in every case: a null html is an empty payload; a null or odd url is written as a valid URI; rows
that share id and payload are all written alike; rows without an id are left out; no rows give no files.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsforge.llm.tables import bounded_batches, tidy
from tsforge.session import shared_path

SHARD_BYTES, ROLL_BYTES = 32 << 20, 8 << 20
#: Ids, on average, that the shards are cut from; the most shards.
SAMPLE, MAX_SHARDS = 50_000, 8192
#: The date of all records, so that archives depend on the pages alone.
DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANIFEST = "shard long, file string, records long, bytes long, sha256 string, first_page long, last_page long"


def filesystem(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The store and path of a URI, in any store that Arrow reaches."""
    return pa.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri) if ":" in uri else f"file://{uri}")


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.sha256(f'{page_id} {payload_digest}'.encode()).hexdigest()[:32])}>"


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One compressed record; a gzip member of its own, so readers can start at any record."""
    lines = [("WARC-Type", kind), *headers, ("WARC-Date", DATE), ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head.encode() + block + b"\r\n\r\n") + z.flush()


def page_record(page_id: int, url: str | None, html: str | None, refers_to: int | None) -> bytes:
    payload = (html or "").encode()
    own = digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("WARC-Record-ID", record_id(page_id, own)), ("WARC-Target-URI", urllib.parse.quote(url or f"urn:page:{page_id}", safe=":/?#[]@!$&'()*+,;=%-._~")),
               ("WARC-Page-Number", str(page_id)), ("WARC-Payload-Digest", f"sha1:{own}"), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is None:
        return record("response", headers, http + payload)
    return record("revisit", [*headers, ("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(refers_to, own)),
                              ("WARC-Refers-To-Page", str(refers_to))], http)


class ShardWriter:
    """Writes a shard's files under temporary names; each is renamed when it is complete."""

    def __init__(self, out: str, shard: int, roll: int):
        self.fs, self.root = filesystem(out)
        self.shard, self.roll, self.sequence, self.file = shard, roll, 0, None

    def add(self, page_id: int, raw: bytes) -> Iterator[tuple]:
        if self.file is None:
            self.name = f"pages-{self.shard:06d}-{self.sequence:05d}.warc.gz"
            self.temporary = f"{self.root}/_temporary/{self.name}-{uuid.uuid4().hex}"
            self.file = self.fs.open_output_stream(self.temporary, compression=None)
            self.sha, self.size, self.records, self.first = hashlib.sha256(), 0, 0, page_id
            info = f"software: tsforge\r\nformat: WARC File Format 1.1\r\nisPartOf: {self.name}\r\n".encode()
            self._put(record("warcinfo", [("WARC-Record-ID", record_id(self.sequence, self.name)), ("WARC-Filename", self.name),
                                          ("Content-Type", "application/warc-fields")], info))
        self._put(raw)
        self.records, self.last = self.records + 1, page_id
        if self.size >= self.roll:
            yield from self.close()

    def _put(self, raw: bytes) -> None:
        self.file.write(raw)
        self.sha.update(raw)
        self.size += len(raw)

    def close(self) -> Iterator[tuple]:
        if self.file is not None:
            self.file.close()
            self.fs.move(self.temporary, f"{self.root}/{self.name}")
            yield self.shard, self.name, self.records, self.size, self.sha.hexdigest(), self.first, self.last
            self.file, self.sequence = None, self.sequence + 1


def shard_bounds(sizes: DataFrame, shard_bytes: int) -> list[float]:
    """Smallest page ids of the shards behind the first, from (page_id, size).

    They are cut from about SAMPLE ids that a hash picks, so they follow the ids however these lie and do not
    depend on partitions. There are at most MAX_SHARDS; a larger table has larger shards of more files.
    """
    n, total = sizes.agg(F.count("*"), F.sum("size")).first()
    if not n:
        return []
    share = max(1, int(min(1.0, SAMPLE / n) * 1_000_000))
    target = max(shard_bytes, total / MAX_SHARDS) * share / 1_000_000
    bounds, held = [], 0
    for r in sizes.where(F.pmod(F.xxhash64("page_id"), F.lit(1_000_000)) < share).orderBy("page_id").collect():
        if held >= target and float(r.page_id) > (bounds[-1] if bounds else -math.inf):
            bounds.append(float(r.page_id))
            held = 0
        held += r.size
    return bounds


def write(pages: DataFrame, out: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = 0,
          shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write the archives of ``pages`` under ``out``; returns the manifest."""
    spark = pages.sparkSession
    bounded_batches(spark)
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html")).where("page_id IS NOT NULL")
    base = base.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    meta = base.select("page_id", "sha", F.octet_length("html").cast("long").alias("size"))
    bounds = shard_bounds(meta, shard_bytes)
    repeated = meta.where(F.col("size") >= min_revisit).groupBy("sha", "size").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")) \
        .where("n > 1").drop("n", "size")
    revisits = meta.where(F.col("size") >= min_revisit).select("page_id", "sha").distinct().join(repeated, "sha").where("page_id > refers_to")
    # a revisit's mark is sorted in front of its page
    rows = base.select("page_id", "sha", F.lit(1).alias("kind"), "url", "html", F.lit(None).cast("long").alias("refers_to")).unionByName(
        revisits.select("page_id", "sha", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "refers_to"))

    def run(batches):
        writer, mark = None, None
        for b in batches:
            done = []
            columns = [b.column(c).to_pylist() for c in ("shard", "page_id", "sha", "kind", "url", "html", "refers_to")]
            for s, page, sha, kind, url, html, refers in zip(*columns, strict=True):
                if writer is None or writer.shard != s:
                    if writer is not None:
                        done += writer.close()
                    writer = ShardWriter(out, s, roll_bytes)
                if kind == 0:
                    mark = (page, sha, refers)
                    continue
                done += writer.add(page, page_record(page, url, html, mark[2] if mark and mark[:2] == (page, sha) else None))
            if done:
                yield flat(done)
        if writer is not None and (done := list(writer.close())):
            yield flat(done)

    def flat(done):
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)],
                                          names=["shard", "file", "records", "bytes", "sha256", "first_page", "last_page"])

    fs, root = filesystem(out)
    fs.create_dir(f"{root}/_temporary", recursive=True)
    if bounds:
        rows = Bucketizer(splits=[-math.inf, *bounds, math.inf], inputCol="place", outputCol="shard") \
            .transform(rows.withColumn("place", F.col("page_id").cast("double"))).drop("place").withColumn("shard", F.col("shard").cast("long"))
    else:
        rows = rows.withColumn("shard", F.lit(0).cast("long"))
    rows.repartition(len(bounds) + 1, "shard").sortWithinPartitions("shard", "page_id", "sha", "kind") \
        .mapInArrow(tidy(run), _MANIFEST).write.parquet(f"{out}/_manifest")
    return manifest(spark, out)


def manifest(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(_MANIFEST).parquet(f"{out}/_manifest")


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an open archive; the stream is read in pieces."""
    z, held = zlib.decompressobj(31), bytearray()

    def more() -> bool:
        nonlocal z
        raw = z.unused_data if z.eof else stream.read(1 << 20)
        if z.eof:
            z = zlib.decompressobj(31)
            raw = raw or stream.read(1 << 20)
        if not raw:
            return False
        held.extend(z.decompress(raw))
        return True

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held:
                    raise ValueError("an archive ends within a record")
                return
        head = held[:end].decode().split("\r\n")
        if head[0] != "WARC/1.1":
            raise ValueError(f"not a WARC record: {head[0][:40]!r}")
        headers = dict(line.split(": ", 1) for line in head[1:])
        size = end + 4 + int(headers["Content-Length"])
        while len(held) < size + 4:
            if not more():
                raise ValueError("an archive ends within a record")
        block = bytes(held[end + 4:size])
        if headers["WARC-Block-Digest"] != f"sha1:{digest(block)}":
            raise ValueError(f"a block differs from its digest: {headers['WARC-Record-ID']}")
        del held[:size + 4]
        yield headers, block


def read(spark: SparkSession, out: str, payload: bool = True) -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to[, payload]) of the files that the
    manifest lists; every block, and every response's payload, is held against its digest."""
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to"] + ["payload"] * payload
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long" + ", payload binary" * payload

    def run(batches):
        fs, root = filesystem(out)
        for b in batches:
            for name in b.column("file").to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for headers, block in records(stream):
                        if headers["WARC-Type"] == "warcinfo":
                            continue
                        http, _, body = block.partition(b"\r\n\r\n")
                        own = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        kind, refers = headers["WARC-Type"], headers.get("WARC-Refers-To-Page")
                        if kind == "response" and digest(body) != own:
                            raise ValueError(f"a payload differs from its digest: {headers['WARC-Record-ID']}")
                        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                        rows.append((int(headers["WARC-Page-Number"]), headers["WARC-Target-URI"], kind, size, own,
                                     int(refers) if refers else None) + ((body if kind == "response" else None,) if payload else ()))
                        held += len(body) if payload else 200
                        if held > 4 << 20:
                            yield flat(rows)
                            rows, held = [], 0
                if rows:
                    yield flat(rows)

    def flat(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=False)], names=names)

    files = manifest(spark, out).select("file")
    n = max(1, files.count())
    return files.repartition(n, "file").mapInArrow(tidy(run), schema)


def new_folder(spark: SparkSession) -> str:
    """A new folder for archives below the shared folder."""
    return shared_path(spark, f"llm-warc-{uuid.uuid4().hex}")
