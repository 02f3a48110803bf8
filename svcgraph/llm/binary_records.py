"""Operator 4: token sequences as length-delimited binary records with an offset index.

Format of a shard (all integers little-endian): records one after another, each
    u64 payload length | u32 masked crc32 of those 8 bytes | payload | u32 masked crc32 of the payload
and of its index file: for each record u64 offset, u64 payload length, i64 key (the smallest i64 stands
for null), u32 masked crc32 of these 24 bytes. A payload is the sequence's ids, u16 or u32. A crc is masked by
rotating it right by 15 bits and adding 0xa282ead8, so that a crc stored in a payload doesn't
disturb its own check.

Writing: rows are dealt by range of the key and sorted, each task streams one shard to a name
of its own attempt in the shared folder and then renames it, so a task that runs again after
an executor is lost writes the same file again. Readers get a manifest with one row for each
shard and can read any record by its index entry, in any order.

Defined results: null texts are empty (the end id alone); equal keys keep one record each, in
the order of their ids; null keys come first; an empty table gives no record; columns beyond
the named two are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import _pieces, arrow_schema, crc32_u32, materialize, scratch_path, word_tokenizer

END_ID = 1
INDEX = "<QQq"
INDEX_BYTES = struct.calcsize(INDEX)
NO_KEY = -(1 << 63)


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def unframe(data: bytes, at: int = 0) -> tuple[bytes, int]:
    """The payload of the record at `at`, and where the next one starts."""
    head = data[at : at + 8]
    if len(head) < 8 or masked(head) != int.from_bytes(data[at + 8 : at + 12], "little"):
        raise ValueError(f"damaged length at {at}")
    stop = at + 12 + int.from_bytes(head, "little")
    payload = data[at + 12 : stop]
    if len(data) < stop + 4 or masked(payload) != int.from_bytes(data[stop : stop + 4], "little"):
        raise ValueError(f"damaged record at {at}")
    return payload, stop + 4


def open_store(url: str):
    """The file system of a shared folder and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(url) if "://" in url or url.startswith("file:") else (fs.LocalFileSystem(), url)


def local_url(url: str) -> str:
    """file:/x and file:///x are the same; pyarrow knows the second."""
    return "file://" + url[5:] if url.startswith("file:/") and not url.startswith("file://") else url


def write_shards(rows: DataFrame, folder: str, make: Callable[[], Callable[[list], list[bytes]]]) -> DataFrame:
    """rows (key long, value), each partition sorted -> one shard and index a partition.

    make() gives, once in a task, the function that turns a list of values into payloads; it runs in
    the process that writes, so a task holds one set of tokenizer tables and not two.
    Returns the manifest: shard int, path string, records long, payload_bytes long.
    """
    import pyarrow as pa

    schema = "shard int, path string, records long, payload_bytes long"
    folder = local_url(folder)

    def run(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, root = open_store(folder)
        shard = TaskContext.get().partitionId()
        name, own = f"{root}/shard-{shard:06d}", f"{root}/.{shard:06d}-{uuid.uuid4().hex}"
        at = records = size = 0
        data = index = None
        encode = make()
        for whole in batches:
            for b in _pieces(whole):
                if data is None:
                    store.create_dir(root, recursive=True)
                    data, index = store.open_output_stream(own), store.open_output_stream(own + ".idx")
                for key, ids in zip(b.column(0).to_pylist(), encode(b.column(1).to_pylist()), strict=True):
                    framed = frame(ids)
                    entry = struct.pack(INDEX, at, len(ids), NO_KEY if key is None else key)
                    data.write(framed)
                    index.write(entry + struct.pack("<I", masked(entry)))
                    at, records, size = at + len(framed), records + 1, size + len(ids)
        if data is not None:
            data.close()
            index.close()
            store.move(own, name + ".rec")
            store.move(own + ".idx", name + ".idx")
            out = arrow_schema(schema)
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((shard, name, records, size), out.types, strict=True)], schema=out)

    return rows.mapInArrow(run, schema)


def write_tokens(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, vocabulary: str | None = None, keep_words: int = 900_000) -> DataFrame:
    """Encode, deal by key range, sort, write; the manifest, written as a table beside the shards."""

    def make():
        tokenizer, end = word_tokenizer(vocabulary, keep_words), np.array([end_id], "<u2").tobytes()
        return lambda texts: [x + end for x in tokenizer.encode(texts)]

    texts = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).cast("string").alias("text"))
    # The range is that of (key, salt): copies of one key can't fill a task.
    dealt = texts.withColumn("salt", F.xxhash64("text")).repartitionByRange("key", "salt")
    sorted_rows = dealt.sortWithinPartitions("key", "salt", "text").select("key", "text")
    return materialize(write_shards(sorted_rows, folder, make), "manifest")


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """Every record by way of its index entry: shard, at (ids before it in the shard), key, n, crc, ids (u16)."""
    import pyarrow as pa

    schema = "shard int, at long, key long, n long, crc long, ids binary"
    folder = local_url(folder)

    def run(batches) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(folder)
        out = arrow_schema(schema)
        for b in batches:
            for shard, path in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at = 0
                with store.open_input_stream(path + ".idx") as index, store.open_input_file(path + ".rec") as data:
                    step = INDEX_BYTES + 4
                    while entries := index.read(step * 2048):
                        rows = []
                        for i in range(0, len(entries), step):
                            entry = entries[i : i + INDEX_BYTES]
                            if masked(entry) != int.from_bytes(entries[i + INDEX_BYTES : i + step], "little"):
                                raise ValueError(f"damaged index of {path}")
                            offset, length, key = struct.unpack(INDEX, entry)
                            data.seek(offset)
                            ids, _ = unframe(data.read(length + 16))
                            rows.append((shard, at, None if key == NO_KEY else key, len(ids) // 2, crc32_u32(ids), ids))
                            at += len(ids) // 2
                        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), out.types, strict=True)], schema=out)

    # Shards are read apart from each other: one task for each, by an explicit number that isn't coalesced.
    return manifest.select("shard", "path").repartitionByRange(max(1, manifest.count()), "shard").mapInArrow(run, schema)


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (ids of all records before it), n_tokens, ids_crc32, ids, in the files' order of keys."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    bases = manifest.select("shard", F.coalesce(F.sum(F.expr("payload_bytes div 2")).over(before), F.lit(0)).cast("long").alias("base"))
    start = (F.col("base") + F.col("at")).alias("start")
    return read_shards(manifest, folder).join(F.broadcast(bases), "shard").select(F.col("key").alias("doc_id"), start, F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"), "ids")


def op4_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "records")
    manifest = write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    return read_tokens(manifest, folder).drop("ids")
