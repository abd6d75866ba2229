"""Length-delimited binary records of token ids, with a separate offset index.

A record: length of the payload (u64), masked checksum of those 8 bytes (u32), payload, masked
checksum of the payload (u32). A payload: doc_id (i64), one byte 1 if doc_id is null, one byte of id
width (2 or 4), then the ids. All little-endian; checksums are crc32, rotated right by 15 bits plus
0xA282EAD8, so that a checksum stored among data does not check itself.

The index holds a row a record: file, part, offset, doc_id, n_tokens. Writing tasks name their files
afresh, and only files that the index of finished tasks lists are ever read: a task that died or ran
twice leaves a file nobody opens.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from editloom.llm.base import new_path, save, ship
from editloom.llm.tokens import encoder

_HEAD = struct.Struct("<QI")
_META = struct.Struct("<q?B")
INDEX = "doc_id long, file string, part int, offset long, n_tokens long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


def pack(doc_id: int | None, ids: np.ndarray) -> bytes:
    return _META.pack(doc_id or 0, doc_id is None, ids.dtype.itemsize) + ids.tobytes()


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, null, width = _META.unpack_from(payload)
    return None if null else doc_id, np.frombuffer(payload, f"<u{width}", offset=_META.size)


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def read_record(stream, where: str) -> bytes | None:
    """The next payload, checked; None at the end of the file."""
    head = stream.read(_HEAD.size)
    if not head:
        return None
    if len(head) < _HEAD.size:
        raise ValueError(f"cut record in {where}")
    size, check = _HEAD.unpack(head)
    if masked(head[:8]) != check:
        raise ValueError(f"length checksum fails in {where}")
    body = stream.read(size + 4)
    if len(body) < size + 4 or masked(body[:size]) != struct.unpack_from("<I", body, size)[0]:
        raise ValueError(f"payload checksum fails in {where}")
    return body[:size]


def write_tokens(docs: DataFrame, tokenizer_file: str, end_id: int, name: str, ordinary: bool = False) -> DataFrame:
    """Encode ``text`` of each row, append ``end_id``, write record files in the order of the partitions'
    rows; the index, saved. Columns of ``docs`` other than doc_id and text are carried into the index.
    ``ordinary``: strings of special tokens are encoded like other text, not as those tokens."""
    spark = docs.sparkSession
    ship(spark)
    folder = new_path(spark, name)
    extra = [f for f in docs.schema.fields if f.name not in ("doc_id", "text")]
    schema = T._parse_datatype_string(INDEX)
    for f in extra:
        schema = schema.add(f)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        file = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.rec"
        store, path = open_store(file)
        encode, stream, at = encoder(tokenizer_file, ordinary), None, 0
        for batch in batches:
            if stream is None:
                store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                stream = store.open_output_stream(path)
            ids, sizes, offsets = batch.column(0).to_pylist(), [], []
            for step in range(0, batch.num_rows, 1024):
                blocks = []
                for doc_id, tokens in zip(ids[step : step + 1024], encode.encode(batch.column(1).slice(step, 1024))):
                    record = frame(pack(doc_id, np.append(tokens, encode.dtype.type(end_id))))
                    blocks.append(record)
                    sizes.append(len(tokens) + 1)
                    offsets.append(at)
                    at += len(record)
                stream.write(b"".join(blocks))
            n = batch.num_rows
            columns = [batch.column(0), pa.array([file] * n), pa.array([part] * n, pa.int32()), pa.array(offsets, pa.int64()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, *(batch.column(2 + i) for i in range(len(extra)))], names=schema.names)
        if stream is not None:
            stream.close()

    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *[f.name for f in extra])
    return save(chosen.mapInArrow(run, schema), f"{name}-index")


def read_files(index: DataFrame, schema: str, rows: Callable[[int | None, np.ndarray, dict], tuple], start: bool = True) -> DataFrame:
    """Read every record of the files in ``index``, a file to a task, in file order. ``rows`` makes an output
    row of doc_id, ids and a dict with ``start``: the ids of all records before it. The driver holds one
    row a file, as many as writing tasks had."""
    spark = index.sparkSession
    files = index.groupBy("part", "file").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("records")).orderBy("part").collect()
    before, listed = 0, []
    for f in files:
        listed.append((len(listed), f.file, before, f.records))
        before += f.n
    table = spark.createDataFrame(listed, "at int, file string, before long, records long")
    target = T._parse_datatype_string(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, path = open_store(row["file"])
                state, out, seen = {"start": row["before"]}, [], 0
                with store.open_input_stream(path, buffer_size=1 << 20) as stream:
                    while (payload := read_record(stream, path)) is not None:
                        doc_id, ids = unpack(payload)
                        out.append(rows(doc_id, ids, state))
                        state["start"] += len(ids)
                        seen += 1
                        if len(out) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), arrow)], schema=arrow)
                            out = []
                if seen != row["records"]:
                    raise ValueError(f"{path} holds {seen} records, not {row['records']}")
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), arrow)], schema=arrow)

    return table.repartitionById(max(len(listed), 1), F.col("at")).mapInArrow(run, target)


def read_some(wanted: DataFrame, parts: int, schema: T.StructType, rows: Callable[[np.ndarray, dict], dict]) -> DataFrame:
    """Shuffled reads: ``wanted`` has file, part, offset and more columns; each task opens its files and goes
    through them by offset, holding one record. ``rows`` adds columns made of a record's ids to a batch."""
    names = wanted.columns
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, file, stream, ids = None, None, None, None
        for batch in batches:
            table = dict(zip(names, (c.to_pylist() for c in batch.columns)))
            made = []
            for i, (name, offset) in enumerate(zip(table["file"], table["offset"])):
                if (name, offset) != at:
                    if name != file:
                        if stream is not None:
                            stream.close()
                        store, path = open_store(name)
                        stream, file = store.open_input_file(path), name
                    stream.seek(offset)
                    ids, at = unpack(read_record(stream, name))[1], (name, offset)
                made.append(rows(ids, {k: v[i] for k, v in table.items()}))
            yield pa.RecordBatch.from_arrays([pa.array([m[f.name] for m in made], f.type) for f in arrow], schema=arrow)
        if stream is not None:
            stream.close()

    return wanted.repartitionById(max(parts, 1), F.col("part")).sortWithinPartitions("file", "offset").mapInArrow(run, schema)


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
