"""WARC: a deterministic sharded writer with revisit records, and the reader of its archives."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import new_folder, with_stats

#: Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of payload to a range of ids, and the most ranges: a range is written by one task.
RANGE_BYTES, MOST_RANGES = 32 << 20, 10_000
MANIFEST = "file string, records bigint, bytes bigint, sha1 string"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(page, digest) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}:{digest}')}>"


def member(headers: list[tuple[str, str]], block: bytes, level=6) -> bytes:
    """One record as a gzip member of its own, without a time stamp: equal records give equal bytes."""
    head = "".join(f"{k}: {v}\r\n" for k, v in headers)
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(f"{VERSION}\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n") + z.flush()


def page_record(page, url, payload: bytes, refers_to, date: str, level=6) -> bytes:
    """A response record, or with ``refers_to`` a revisit record whose block has the HTTP head alone."""
    digest = hashlib.sha1(payload).hexdigest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _record_id(page, digest)), ("WARC-Date", date)]
    if url is not None:
        headers.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url)))
    if page is not None:
        headers.append(("X-Page-Id", str(page)))
    if refers_to is not None:
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _record_id(refers_to, digest)), ("X-Refers-To-Page", str(refers_to)),
                    ("X-Payload-Length", str(len(payload)))]
    headers += [("WARC-Payload-Digest", _sha1(payload)), ("WARC-Block-Digest", _sha1(block)), ("Content-Type", "application/http; msgtype=response")]
    return member(headers, block, level)


class _Shard:
    """Files of one task: written under a temporary name, renamed when full."""

    def __init__(self, folder, roll_bytes, date):
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.root, recursive=True)
        task = TaskContext.get()
        self.part, self.attempt = task.partitionId(), task.taskAttemptId()
        self.roll, self.date, self.seq, self.out, self.done = roll_bytes, date, 0, None, []

    def add(self, record: bytes):
        if self.out is None:
            self.name = f"part-{self.part:06d}-{self.seq:05d}.warc.gz"
            self.temp = f"{self.root}/_{self.name}.{self.attempt}.tmp"
            self.out, self.size, self.records, self.hash = self.fs.open_output_stream(self.temp, compression=None), 0, 0, hashlib.sha1()
            self._put(member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _record_id(self.name, "info")), ("WARC-Date", self.date),
                              ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
        self._put(record)
        self.records += 1
        if self.size >= self.roll:
            self.close()

    def _put(self, data):
        self.out.write(data)
        self.hash.update(data)
        self.size += len(data)

    def close(self):
        if self.out is None:
            return
        self.out.close()
        self.fs.move(self.temp, f"{self.root}/{self.name}")  # the same bytes from any attempt
        self.done.append((self.name, self.records, self.size, self.hash.hexdigest()))
        self.out, self.seq = None, self.seq + 1


def write(pages: DataFrame, folder: str, roll_bytes=64 << 20, least=1000, date="1970-01-01T00:00:00Z", level=6,
          key="page_id", url="url", payload="html", range_bytes=RANGE_BYTES) -> DataFrame:
    """Write one record per row to ``folder`` (a URI that all executors reach); the manifest as a DataFrame.

    Of equal payloads of at least ``least`` bytes, the row with the largest id is the response and the rest
    revisit it. Which rows revisit is found on ids and digests alone (a maximum per digest, partially
    aggregated); these decisions join the pages in one range sort by (id, digest), so the pages are moved
    once and a page's decision stands right before it. Files roll at ``roll_bytes`` of compressed size, get
    their name by a rename, and count only once the manifest lists them: Spark commits that table when all
    tasks have ended, and files of lost attempts are in no manifest.

    Equal tables give equal files, in any session and from any layout: the ranges of ids are as many as the payloads
    hold ``range_bytes``, and their cut points come from a sample drawn by the hash of (id, digest), about twenty a
    range. Cut points are one array of at most ``MOST_RANGES`` entries, in which the rows find their place in the JVM.

    Null payloads are empty, null ids and URLs leave out their header; a row with a null id may revisit but is
    never referred to. Rows that share the largest id are all responses. An empty table gives no files. Only id, URL
    and payload are read, so other columns may have any name.
    """
    body = F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary")
    of = lambda c, name: F.col(c).alias(name)
    narrow = pages.select(of(key, "page"), F.sha1(body).alias("digest"), F.octet_length(body).alias("n"))
    first = narrow.where(F.col("n") >= least).groupBy("digest", "n").agg(F.max("page").alias("refers"), F.count(F.lit(1)).alias("copies")).where(
        "copies > 1 and refers is not null")
    again = narrow.join(first, ["digest", "n"]).where("page is null or page < refers").select("page", "digest", "refers").distinct()
    kind = pages.schema[key].dataType
    both = pages.select(of(key, "page"), F.sha1(body).alias("digest"), F.lit(1).alias("tag"), F.col(url).cast("string").alias("url"), body.alias("body"),
                        F.lit(None).cast(kind).alias("refers")).unionByName(
        again.select("page", "digest", F.lit(0).alias("tag"), "refers"), allowMissingColumns=True)
    size, total = narrow.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    ranges = min(MOST_RANGES, max(1, -(-size // range_bytes)))
    at = F.struct(F.col("page").isNotNull().alias("full"), "page", "digest")
    drawn = narrow.where(F.pmod(F.xxhash64("page", "digest"), F.lit(1 << 40)) < F.lit(min(1 << 40, (20 * ranges << 40) // max(1, total)))).select(at.alias("at")).distinct()
    cuts = drawn.agg(F.sort_array(F.collect_list("at")).alias("all")).select(F.transform(
        F.sequence(F.lit(1), F.lit(ranges)), lambda i: F.get("all", (F.floor(i * F.size("all") / ranges) - 1).cast("int"))).alias("cuts"))
    cuts = cuts.select(F.array_distinct(F.filter("cuts", lambda x: x.isNotNull())).alias("cuts"))
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(int(ranges).bit_length()))])
    # the number of cuts below the row, by halving
    place = F.aggregate(steps, F.lit(0), lambda p, step: F.when(F.get("cuts", p + step - 1) < F.col("at"), p + step).otherwise(p))
    placed = with_stats(both.withColumn("at", at), cuts).withColumn("_p", place).drop("at", "cuts")
    ranged = placed.repartitionById(int(ranges) + 1, "_p").sortWithinPartitions("page", "digest", "tag", "url").drop("_p")
    names = [x.split()[0] for x in MANIFEST.split(", ")]

    def run(batches):
        shard, decided = _Shard(folder, roll_bytes, date), (None, None, None)
        for batch in batches:
            for page, digest, tag, link, data, refers in zip(*[c.to_pylist() for c in batch.columns]):
                if tag == 0:
                    decided = (page, digest, refers)
                else:
                    shard.add(page_record(page, link, data, decided[2] if decided[:2] == (page, digest) else None, date, level))
        shard.close()
        yield pa.RecordBatch.from_pydict({n: pa.array([x[i] for x in shard.done], pa.string() if n in ("file", "sha1") else pa.int64())
                                          for i, n in enumerate(names)})

    spark = pages.sparkSession
    ranged.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/_manifest")
    return spark.read.parquet(f"{folder}/_manifest")


def records(stream, size=1 << 20):
    """(headers, block) of each record of a gzip stream, one member at a time."""
    data = b""
    while True:
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            if not data:
                data = stream.read(size)
                if not data:
                    if parts:
                        raise ValueError("the archive ends inside a record")
                    return
            parts.append(z.decompress(data))
            data = z.unused_data
        raw = b"".join(parts)
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if lines[0] != VERSION:
            raise ValueError(f"no WARC record: {lines[0][:40]}")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        n = int(headers["Content-Length"])
        if rest[n:] != b"\r\n\r\n":
            raise ValueError("a record's length doesn't match its header")
        yield headers, rest[:n]


def read_back(manifest: DataFrame, folder: str, key_type, payloads=False) -> DataFrame:
    """One row per page record of the manifest's files, digests checked; with ``payloads`` also the payload
    (null for revisits). Each file is one unit of work and is streamed."""
    spark = manifest.sparkSession
    ddl = "page string, url string, record_type string, payload_bytes bigint, payload_digest string, refers string" + ", payload binary" * payloads
    names = [x.split()[0] for x in ddl.split(", ")]
    kinds = {"payload_bytes": pa.int64(), "payload": pa.binary()}

    def rows(stream):
        for h, block in records(stream):
            if h["WARC-Type"] not in ("response", "revisit"):
                continue
            if _sha1(block) != h["WARC-Block-Digest"]:
                raise ValueError(f"block digest of {h['WARC-Record-ID']}")
            body = block.partition(b"\r\n\r\n")[2]
            own = h["WARC-Type"] == "response"
            if own and _sha1(body) != h["WARC-Payload-Digest"]:
                raise ValueError(f"payload digest of {h['WARC-Record-ID']}")
            yield (h.get("X-Page-Id"), h.get("WARC-Target-URI"), h["WARC-Type"], len(body) if own else int(h["X-Payload-Length"]),
                   base64.b32decode(h["WARC-Payload-Digest"][5:]).hex(), h.get("X-Refers-To-Page"), body if own else None)

    def flush(held):
        return pa.RecordBatch.from_pydict({n: pa.array([x[i] for x in held], kinds.get(n, pa.string())) for i, n in enumerate(names)})

    def run(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                held, size = [], 0
                with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for row in rows(stream):
                        held.append(row)
                        size += 500 + payloads * row[3]
                        if size > 4 << 20:
                            yield flush(held)
                            held, size = [], 0
                if held:
                    yield flush(held)

    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    out = manifest.select("file").repartition(n).mapInArrow(run, ddl)
    return out.select(F.col("page").cast(key_type).alias("page_id"), "url", "record_type", "payload_bytes", "payload_digest",
                      F.col("refers").cast(key_type).alias("refers_to"), *(["payload"] if payloads else []))


def qualified(spark, folder: str) -> str:
    """The folder as a URI; without a scheme it lies in Spark's default file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return "file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri


def archive(pages: DataFrame, folder=None, payloads=False, **options) -> DataFrame:
    """Write all pages to ``folder`` (default: a new one in the work folder) and read the archives back."""
    folder = folder or new_folder(pages.sparkSession, "warc")
    folder = qualified(pages.sparkSession, folder)
    kind = pages.schema[options.get("key", "page_id")].dataType
    return read_back(write(pages, folder, **options), folder, kind, payloads)


#: What the written archives hold.
SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
m AS (SELECT *, strlen(body)::BIGINT AS n, max(page_id) OVER (PARTITION BY body) AS top FROM p)
SELECT page_id, n AS payload_bytes, sha1(body) AS payload_digest,
  CASE WHEN n >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id < top THEN top END AS refers_to
FROM m"""
