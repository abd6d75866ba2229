"""WARC archives from a table of pages, through a chunked record table, and back.

A page's payload becomes rows of record identifier and chunk number in files that tasks write, a chunk at
a time: each row carries its bytes, and size and SHA-1 of the payload so far, so that the last row's are
the payload's. One row a record (where its chunks lie, page, url, size, digest) goes on through Spark, which
decides which records revisit which; payloads are never shuffled. A task then goes through a chunk file and
its records side by side and writes one gzip archive, a member a record, holding one chunk and checking
the digests carried. Files have fresh names, and manifests of finished tasks name those to read.

Of records with equal payloads of at least ``least_bytes``, that with the smallest page_id is the
response and the others revisit it. Reading checks payloads against their digests, and takes a revisit's
size and digest from the response that it refers to, which must have the digest that the revisit tells.

Defined cases: a null payload is empty; a null page_id ranks last; rows that repeat the response's
page_id and payload are responses too; a null url is written as ``about:blank``; record identifiers are
unique however often a page_id repeats; an empty table gives no archive. Columns other than page_id, url
and html are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editloom.llm.base import new_path, save, ship
from editloom.llm.records import open_store
from editloom.llm.text import buffers

CHUNK, LEVEL, DATE = 1 << 18, 4, "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "part int, file string, record long, page_id long, url string, bytes long, sha1 string"
CHUNKS = pa.schema([("record", pa.int64()), ("number", pa.int32()), ("bytes", pa.int64()), ("sha1", pa.binary(20)), ("last", pa.bool_()), ("data", pa.binary())])
FOUND = "name string, page_id long, payload_bytes long, payload_digest string, record_type string, refers string"


def chunk_rows(payload: memoryview, record: int, size: int) -> Iterator[tuple]:
    """Rows of CHUNKS of one payload: digests are carried on from chunk to chunk."""
    seen, at, number = hashlib.sha1(), 0, 0
    while True:
        data = payload[at : at + size]
        seen.update(data)
        at += len(data)
        yield record, number, at, seen.digest(), at == len(payload), data
        number += 1
        if at == len(payload):
            return


def write_chunks(pages: DataFrame, size: int = CHUNK) -> DataFrame:
    """Write the chunk files; RECORDS, saved: a row a page."""
    ship(pages.sparkSession)
    folder = new_path(pages.sparkSession, "chunks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        file = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.parquet"
        store, path = open_store(file)
        writer, stream, record = None, None, 0

        def put(rows: list[tuple]) -> None:
            writer.write_batch(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), CHUNKS)], schema=CHUNKS))

        for batch in batches:
            if writer is None and batch.num_rows:
                store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                stream = store.open_output_stream(path)
                writer = pq.ParquetWriter(stream, CHUNKS, compression="zstd", use_dictionary=False, write_statistics=False)
            raw, off = buffers(batch.column(2))
            view, told, held, weight = memoryview(raw), [], [], 0
            for i in range(batch.num_rows):
                for row in chunk_rows(view[off[i] : off[i + 1]], record, size):
                    held.append(row)
                    weight += len(row[5])
                    if weight >= 16 * size:
                        put(held)
                        held, weight = [], 0
                told.append((row[2], row[3].hex()))
                record += 1
            if held:
                put(held)
            n = batch.num_rows
            columns = [pa.array([part] * n, pa.int32()), pa.array([file] * n, pa.string()), pa.array(range(record - n, record), pa.int64()), batch.column(0), batch.column(1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([t[0] for t in told], pa.int64()), pa.array([t[1] for t in told], pa.string())], names=["part", "file", "record", "page_id", "url", "bytes", "sha1"])
        if writer is not None:
            writer.close()
            stream.close()

    chosen = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return save(chosen.mapInArrow(run, RECORDS), "warc-records")


def decided(records: DataFrame, least_bytes: int = 0) -> DataFrame:
    """RECORDS with ``refers``, the name of the response that a record revisits, or null."""
    name = F.concat(F.lit("<urn:loom:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(":"), F.col("part").cast("string"), F.lit("-"), F.col("record").cast("string"), F.lit(">"))
    named = records.withColumn("name", name)
    rank = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "part", "record", "name")
    shared = named.where(F.col("bytes") >= least_bytes).groupBy("sha1").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1")
    told = named.join(shared.select("sha1", F.col("first.page_id").alias("first_id"), F.col("first.name").alias("first_name")), "sha1", "left")
    revisit = (F.col("bytes") >= least_bytes) & F.col("first_name").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return told.withColumn("refers", F.when(revisit, F.col("first_name"))).drop("first_id", "first_name")


def _page(name: str) -> int | None:
    found = name.split(":")[3]
    return None if found == "none" else int(found)


def _digest(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def header(row: dict) -> bytes:
    """The header of a record and of its HTTP response."""
    revisit = row["refers"] is not None
    url = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in row["url"] or "about:blank")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {row['name']}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {url}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{_digest(bytes.fromhex(row['sha1']))}",
        f"Content-Length: {len(HTTP) + (0 if revisit else row['bytes'])}",
    ]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {row['refers']}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + HTTP


def _chunks(file: str) -> Iterator[dict]:
    store, path = open_store(file)
    with store.open_input_file(path) as stream, pq.ParquetFile(stream) as table:
        for batch in table.iter_batches(batch_size=16):
            for i in range(batch.num_rows):
                yield {f.name: batch.column(f.name)[i] for f in CHUNKS}


def write_archives(records: DataFrame) -> DataFrame:
    """Write the records of ``decided``; the manifest, saved: part, file, records."""
    spark = records.sparkSession
    folder = new_path(spark, "warc")
    parts = records.agg(F.max("part")).first()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = source = chunks = stream = None
        count = 0
        for batch in batches:
            for row in batch.to_pylist():
                if stream is None:
                    part = row["part"]
                    file = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.warc.gz"
                    store, path = open_store(file)
                    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    stream = store.open_output_stream(path, buffer_size=1 << 20)
                if row["file"] != source:
                    source, chunks = row["file"], _chunks(row["file"])
                member, seen = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), hashlib.sha1()
                stream.write(member.compress(header(row)))
                last = False
                while not last:
                    chunk = next(chunks)
                    data = chunk["data"].as_buffer()
                    seen.update(data)
                    if chunk["record"].as_py() != row["record"] or seen.digest() != chunk["sha1"].as_py():
                        raise ValueError(f"chunks of record {row['name']} are not its payload")
                    if row["refers"] is None:
                        stream.write(member.compress(data))
                    last = chunk["last"].as_py()
                if seen.hexdigest() != row["sha1"]:
                    raise ValueError(f"chunks of record {row['name']} are not its payload")
                stream.write(member.compress(b"\r\n\r\n") + member.flush())
                count += 1
        if stream is not None:
            stream.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([file]), pa.array([count], pa.int64())], names=["part", "file", "records"])

    lined = records.repartitionById((parts if parts is not None else 0) + 1, F.col("part")).sortWithinPartitions("file", "record")
    return save(lined.mapInArrow(run, "part int, file string, records long"), "warc-manifest")


def records(stream) -> Iterator[tuple]:
    """Rows of FOUND from one archive, in blocks of 64 KiB; payloads are checked against their digests."""
    reader = io.BufferedReader(gzip.GzipFile(fileobj=stream, mode="rb"), 1 << 16)
    while line := reader.readline():
        if line.rstrip() != b"WARC/1.1":
            raise ValueError("no WARC record where one should begin")
        fields = {}
        while (line := reader.readline().strip()):
            key, _, value = line.decode().partition(": ")
            fields[key] = value
        left = int(fields["Content-Length"])
        while (line := reader.readline()) != b"\r\n":
            left -= len(line)
        left -= 2
        seen, size = hashlib.sha1(), 0
        while left:
            block = reader.read(min(left, 1 << 16))
            if not block:
                raise ValueError("cut record")
            seen.update(block)
            size += len(block)
            left -= len(block)
        if reader.read(4) != b"\r\n\r\n":
            raise ValueError("a record doesn't end where its length says")
        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        refers, name = fields.get("WARC-Refers-To"), fields["WARC-Record-ID"]
        if refers is None and _digest(seen.digest()) != digest:
            raise ValueError(f"payload of {name} fails its digest")
        yield name, _page(name), size, digest, fields["WARC-Type"], refers


def read_records(manifest: DataFrame) -> DataFrame:
    """FOUND of every record of the archives: a task an archive; the archives stay in the cluster's folder."""
    parts = manifest.agg(F.max("part")).first()[0]
    arrow = pa.schema([("name", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, path = open_store(row["file"])
                out, n = [], 0
                with store.open_input_stream(path, buffer_size=1 << 20) as stream:
                    for record in records(stream):
                        out.append(record)
                        n += 1
                        if len(out) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)
                            out = []
                if n != row["records"]:
                    raise ValueError(f"{path} holds {n} records, not {row['records']}")
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return manifest.repartitionById((parts if parts is not None else 0) + 1, F.col("part")).mapInArrow(run, FOUND)


def read_archives(manifest: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record. A revisit has the size and
    digest of its response; one without a response, or with another digest than it tells, fails the job."""
    found = save(read_records(manifest), "warc-found")
    plain = found.where("refers is null").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    named = found.where("refers is not null").select(F.col("refers").alias("of")).distinct()
    heads = found.where("refers is null").join(named, F.col("name") == F.col("of"), "left_semi")
    heads = heads.select(F.col("name").alias("of"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("its_bytes"), F.col("payload_digest").alias("its_digest"))
    both = found.where("refers is not null").join(heads, F.col("refers") == F.col("of"), "left")
    good = F.when(F.col("its_digest") == F.col("payload_digest"), F.col("its_digest")).otherwise(F.raise_error(F.concat(F.lit("no response with the payload of "), F.col("name"))).cast("string"))
    return plain.unionByName(both.select("page_id", F.col("its_bytes").alias("payload_bytes"), good.alias("payload_digest"), "record_type", "refers_to"))


def archived(pages: DataFrame, least_bytes: int = 0, chunk: int = CHUNK) -> DataFrame:
    """The manifest of archives written from ``pages`` (page_id, url, html)."""
    return write_archives(decided(write_chunks(pages, chunk), least_bytes))


def op9_warc(spark, sf_dir: str) -> DataFrame:
    return read_archives(archived(spark.read.parquet(f"{sf_dir}/pages.parquet")))


OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first, sha1(coalesce(html, '')) AS h FROM pages)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((((strpos('0123456789abcdef', substr(h, 5 * k // 4 + 1, 1)) - 1) * 16
    + strpos('0123456789abcdef', substr(h, 5 * k // 4 + 2, 1)) - 1) >> (3 - 5 * k % 4)) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p
"""
