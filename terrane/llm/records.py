"""Token ids in length-delimited binary records, with an offset index beside each data file.

A record is: payload length (8 bytes, little endian), masked checksum of those 8 bytes (4), payload, masked checksum of the
payload (4). The checksum is CRC-32, turned right by 15 bits plus a constant, so that files whose bytes hold checksums
themselves keep good ones. A payload is: a byte that says whether there is a document id, the id (8 bytes, signed), a byte
with the width of a token id (2 or 4), the token ids. An index file has three 8-byte numbers per record (place of its first
byte, its whole length, number of ids), so a reader that shuffles can fetch any record with one seek.

Files are written under the shared folder through pyarrow's file systems, under names of the task's attempt. The attempts whose
results Spark takes are the files; what others have left is deleted at the end, so a task may die anywhere and run again.
Documents go to files in ascending doc_id order (nulls first, then by text), about FILE_BYTES of text to a file.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm import tokens
from terrane.llm.staging import shared_folder

MASK = 0xA282EAD8
HEAD = struct.Struct("<QI")
BODY = struct.Struct("<BqB")
INDEX = struct.Struct("<QQQ")
END_ID = 0
FILE_BYTES = 128 << 20


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def read_records(stream) -> Iterator[bytes]:
    """Payloads of a data file, one after the other; a checksum that does not fit raises ValueError."""
    while head := stream.read(HEAD.size):
        if len(head) < HEAD.size:
            raise ValueError("a record's head is cut off")
        length, crc = HEAD.unpack(head)
        if masked(head[:8]) != crc:
            raise ValueError("a record's length does not fit its checksum")
        payload, tail = stream.read(length), stream.read(4)
        if len(payload) < length or len(tail) < 4 or masked(payload) != struct.unpack("<I", tail)[0]:
            raise ValueError("a record does not fit its checksum")
        yield payload


def record_at(fs, path: str, number: int) -> bytes:
    """The payload of one record, found by the index file."""
    with fs.open_input_file(f"{path}.idx") as f:
        place, length, _ = INDEX.unpack(f.read_at(INDEX.size, number * INDEX.size))
    with fs.open_input_file(f"{path}.rec") as f:
        return next(read_records(pa.BufferReader(f.read_at(length, place))))


def payload(doc_id: int | None, ids: bytes, width: int) -> bytes:
    return BODY.pack(doc_id is not None, doc_id or 0, width) + ids


def unpack(data: bytes) -> tuple[int | None, np.ndarray]:
    known, doc_id, width = BODY.unpack_from(data)
    return doc_id if known else None, np.frombuffer(data, f"<u{width}", offset=BODY.size)


def file_name(part: int, attempt: int) -> str:
    return f"part-{part:06d}-{attempt}"


def _write(rows: Iterator[pa.RecordBatch], folder: str, vocabulary: str) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    encode = tokens.encoder(vocabulary)
    width, end = encode.dtype.itemsize, np.array([END_ID], encode.dtype).tobytes()
    attempt = TaskContext.get().taskAttemptId()
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    own = f"{root}/{file_name(part, attempt)}"
    n = total = place = 0
    with fs.open_output_stream(f"{own}.rec") as rec, fs.open_output_stream(f"{own}.idx") as idx:
        for batch in rows:
            doc_ids, texts = batch.column(0).to_pylist(), [x or "" for x in batch.column(1).to_pylist()]
            for a, b in tokens.batches(texts):
                for doc_id, ids in zip(doc_ids[a:b], encode.encode(texts[a:b])):
                    ids += end
                    data = frame(payload(doc_id, ids, width))
                    rec.write(data)
                    idx.write(INDEX.pack(place, len(data), len(ids) // width))
                    n, total, place = n + 1, total + len(ids) // width, place + len(data)
    yield pa.RecordBatch.from_pydict({"part": [part], "attempt": [attempt], "docs": [n], "ids": [total]})


def write_records(docs: DataFrame, vocabulary: str, folder: str | None = None, partitions: int | None = None) -> list[tuple]:
    """Encodes every text (null: empty), with END_ID at the end, and writes the files.

    Returns (path without suffix, documents, ids of all files before it) per file that holds any, in order. There are as many
    files as `partitions`, or as shuffle partitions and FILE_BYTES ask for; the list of them is what comes to the driver.
    Columns other than doc_id and text are not written; repeated rows are written as often as they come.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/records-{uuid.uuid4().hex}"
    if not partitions:
        size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).head()[0]
        partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id", "text")
    files = sorted(ordered.mapInArrow(lambda rows: _write(rows, folder, vocabulary), "part long, attempt long, docs long, ids long").collect())  # one row per file
    fs, root = pafs.FileSystem.from_uri(folder)
    named = {f"{file_name(part, attempt)}.{kind}" for part, attempt, _, _ in files for kind in ("rec", "idx")}
    for left in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
        if left.base_name not in named and left.is_file:
            fs.delete_file(left.path)
    out, before = [], 0
    for part, attempt, n, total in files:
        if n:
            out.append((f"{folder}/{file_name(part, attempt)}", n, before))
        before += total
    return out


def _read(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            fs, at = pafs.FileSystem.from_uri(path)
            cols: list[list] = [[], [], [], []]
            with fs.open_input_stream(f"{at}.rec", buffer_size=1 << 20) as f:
                for data in read_records(f):
                    doc_id, ids = unpack(data)
                    for col, x in zip(cols, (doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))):
                        col.append(x)
                    start += len(ids)
                    if len(cols[0]) == 8192:
                        yield _batch(cols)
                        cols = [[], [], [], []]
            yield _batch(cols)


def read_files(spark: SparkSession, files: list[tuple]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every record, a task per file, from the files alone."""
    listed = spark.createDataFrame([(path, start) for path, _, start in files], "path string, start long")
    return listed.repartitionByRange(max(1, len(files)), "start").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _batch(cols: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "n_tokens", "ids_crc32"])
