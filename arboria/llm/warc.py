"""A deterministic sharded WARC writer and its reader [operator 3].

Records are range-sorted by page_id into shards whose bounds depend on the rows alone.  A shard's task writes
files that roll when their compressed size reaches `roll_bytes`; every record is a gzip member with headers and
digests made anew.  A file appears under its own name once it is whole, and the files that count are those of
the manifest, which Spark commits last; so a lost executor or a second attempt leaves no half file in sight.

Of records with equal payloads (of `least` bytes or more) that with the largest page_id is a response, the
others are revisits that refer to it and carry no payload.  Who refers to whom comes to the writer as narrow mark
rows, sorted just before the records they are about, so payloads are shuffled once.

Defined results: a null payload is empty; null page_ids come first and only respond where all of their group are
null; of repeated rows the first is the response and the others revisit that page_id; a null url becomes
urn:page:<page_id>; an empty table gives no files and no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

DATE = "1970-01-01T00:00:00Z"  # pages have no date; a fixed one keeps archives the same from run to run
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_MANIFEST = "shard int, file string, n_records long, bytes long, sha256 string"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record(kind: str, uri: str, key: str, block: bytes, more: list[tuple[str, str]]) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_SPACE, key)}>"), ("WARC-Date", DATE), ("WARC-Target-URI", uri), *more, ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return gzip.compress(text.encode() + block + b"\r\n\r\n", compresslevel=4, mtime=0)


def response(page_id, url, payload: bytes, refers_to: tuple | None = None) -> bytes:
    """A gzip member; refers_to: (page_id,) of the response that a revisit refers to."""
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url is not None else f"urn:page:{page_id}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    digest = base32_sha1(payload)
    more = [("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-Id", "" if page_id is None else str(page_id))]
    if refers_to is None:
        return _record("response", uri, f"response:{page_id}:{digest}", http + payload, more)
    to = "" if refers_to[0] is None else str(refers_to[0])
    more += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:uuid:{uuid.uuid5(_SPACE, f'response:{refers_to[0]}:{digest}')}>"), ("X-Refers-To-Page-Id", to)]
    return _record("revisit", uri, f"revisit:{page_id}:{digest}:{uri}", http, more)


class _Roll:
    """The files of one shard."""

    def __init__(self, folder: str, shard: int, roll_bytes: int):
        self.folder, self.shard, self.roll_bytes, self.n, self.file, self.rows = folder, shard, roll_bytes, 0, None, []

    def add(self, member: bytes) -> None:
        if self.file is None:
            self.name = f"part-{self.shard:06d}-{self.n:05d}.warc.gz"
            self.file, self.sha, self.records, self.n = C.Committed(self.folder, self.name), hashlib.sha256(), 0, self.n + 1
            fields = b"format: WARC/1.1\r\n"
            head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(_SPACE, self.name)}>\r\nWARC-Date: {DATE}\r\nWARC-Filename: {self.name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(fields)}\r\n\r\n"
            self._put(gzip.compress(head.encode() + fields + b"\r\n\r\n", compresslevel=4, mtime=0))
        self._put(member)
        self.records += 1
        if self.file.size >= self.roll_bytes:
            self.close()

    def _put(self, data: bytes) -> None:
        self.file.write(data)
        self.sha.update(data)

    def close(self) -> None:
        if self.file is not None:
            self.file.commit()
            self.rows.append((self.shard, self.name, self.records, self.file.size, self.sha.hexdigest()))
            self.file = None


def write_warc(pages: DataFrame, folder: str, shard_bytes: int = 64 << 20, roll_bytes: int = 16 << 20, least: int = 0) -> DataFrame:
    """Writes the archives of pages (page_id, url, html) and returns the manifest of their files."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    narrow = C.stash(rows.select("page_id", "digest", F.octet_length("payload").cast("long").alias("n")), "digests")
    bounds = C.range_bounds(narrow, "page_id", F.col("n") + 512, shard_bytes)
    many = narrow.where(F.col("n") >= least).groupBy("digest").agg(F.max("page_id").alias("to"), F.count("*").alias("c")).where("c > 1").select("digest", "to")
    marks = narrow.where(F.col("n") >= least).join(many, "digest").select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "digest", F.lit(0).alias("kind"), "to")
    both = rows.withColumns({"kind": F.lit(1), "to": F.lit(None).cast("long")}).unionByName(marks.distinct())
    both = both.withColumn("shard", C.shard_of(pages.sparkSession, "page_id", bounds))
    both = C.dealt_to_shards(both, len(bounds) + 1, F.col("page_id").asc_nulls_first(), "digest", "kind", F.col("url").asc_nulls_first())

    def run(batches):
        roll, done, mark, seen = None, [], None, False
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                for r in batch.slice(a, 256).to_pylist():
                    if roll is None or roll.shard != r["shard"]:
                        if roll is not None:
                            roll.close()
                            done += roll.rows
                        roll = _Roll(folder, r["shard"], roll_bytes)
                    key = r["page_id"], r["digest"]
                    if r["kind"] == 0:
                        mark, seen = (key, (r["to"],)), False
                        continue
                    refers = mark[1] if mark and mark[0] == key and (seen or mark[1][0] != key[0]) else None
                    seen = True
                    roll.add(response(r["page_id"], r["url"], r["payload"], refers))
        if roll is not None:
            roll.close()
            done += roll.rows
        cols = list(zip(*done, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["shard", "file", "n_records", "bytes", "sha256"])

    both.mapInArrow(run, _MANIFEST).write.parquet(f"{folder}/_manifest")
    C.swept(folder)
    C.drop(narrow)
    return pages.sparkSession.read.parquet(f"{folder}/_manifest")


def members(file, piece: int = 1 << 16):
    """The gzip members of a file, one after another."""
    rest = b""
    while True:
        d, parts = zlib.decompressobj(31), []
        data = rest or file.read(piece)
        if not data:
            return
        while not d.eof:
            if not data:
                raise ValueError("a record is cut off")
            parts.append(d.decompress(data))
            rest = d.unused_data
            data = b"" if d.eof else file.read(piece)
        yield b"".join(parts)


def parsed(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record."""
    head, _, rest = member.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return headers, rest[: int(headers["Content-Length"])]


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of the records of the manifest's files.

    Block and payload digests are made again and compared; a difference stops the query.
    """
    files = spark.read.parquet(f"{folder}/_manifest").select("file", "shard")
    n = max(1, files.count())
    number = lambda x: int(x) if x else None

    def record(headers: dict[str, str], block: bytes) -> tuple:
        http, _, payload = block.partition(b"\r\n\r\n")
        digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
        if f"sha1:{base32_sha1(block)}" != headers["WARC-Block-Digest"]:
            raise ValueError(f"block digest of page {headers['X-Page-Id']}")
        size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
        if headers["WARC-Type"] == "response" and (base32_sha1(payload) != digest or len(payload) != size):
            raise ValueError(f"payload digest of page {headers['X-Page-Id']}")
        return number(headers["X-Page-Id"]), headers["WARC-Target-URI"], size, digest, headers["WARC-Type"], number(headers.get("X-Refers-To-Page-Id"))

    def run(batches):
        kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
        for batch in batches:
            for name in batch.column("file").to_pylist():
                fs, root = C.file_system(folder)
                with fs.open_input_stream(f"{root}/{name}", compression=None) as f:
                    rows = [record(*p) for p in map(parsed, members(f)) if p[0]["WARC-Type"] != "warcinfo"]
                cols = list(zip(*rows, strict=True)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds.values(), strict=True)], list(kinds))

    return files.repartition(n, "file").mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = C.new_dir(spark, "warc")
    write_warc(C.table(spark, sf_dir, "pages"), folder)
    return read_warc(spark, folder).drop("url")


ORACLE_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS t, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), bits AS (
  SELECT DISTINCT h, (SELECT string_agg('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(
      '0b' || substr((SELECT string_agg(lpad(bin(('0x' || substr(h, k, 1))::INT)::VARCHAR, 4, '0'), '' ORDER BY k) FROM range(1, 41) t(k)), 5 * j + 1, 5))::INT + 1], '' ORDER BY j)
    FROM range(0, 32) s(j)) AS payload_digest FROM p
), m AS (SELECT h, max(page_id) AS top FROM p GROUP BY h)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM p JOIN bits USING (h) JOIN m USING (h)
"""
