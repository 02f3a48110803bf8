"""Operator 9: concatenate-and-cut packing with two-pass prefix sums.

Pass 1 tokenises each input partition where it lies, and numbers its tokens from 0; the
tokenised rows are written once. The partitions' totals (one small row each) become global
offsets by a prefix sum. Pass 2 adds a partition's offset to each row and cuts the global
token line into windows of `length` ids: a document that crosses a window's border gets one
boundary record (piece) on each side. No document moves between machines.

Defined results: a null text is an empty one and gives the end id alone, so every row, also
one with a null doc_id or repeated doc_id, gives at least one piece; an empty table gives no
piece; columns beyond the named two are ignored. Only the very last sequence can be short.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, crc32_u32, give_back, map_rows, materialize, word_tokenizer, _pieces

END_ID = 2
LENGTH = 4096
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def tokenize_partitions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, vocabulary: str | None = None, keep_words: int = 100_000) -> DataFrame:
    """Pass 1: doc_id, part (input partition), at (its first token there), n, ids (u16 little-endian)."""
    import pyarrow as pa

    schema = "doc_id long, part int, at long, n long, ids binary"

    def run(batches):
        from pyspark import TaskContext

        part, at, tokenizer, out = TaskContext.get().partitionId(), 0, word_tokenizer(vocabulary, keep_words), arrow_schema(schema)
        end = np.array([end_id], "<u2").tobytes()
        for whole in batches:
            for b in _pieces(whole):
                keys, texts = (c.to_pylist() for c in b.columns)
                ids = [x + end for x in tokenizer.encode(texts)]
                n = np.array([len(x) // 2 for x in ids], "i8")
                starts = at + np.cumsum(n) - n
                at += int(n.sum())
                cols = (keys, [part] * len(keys), starts, n, ids)
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, out.types, strict=True)], schema=out)
        give_back()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, schema)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID, vocabulary: str | None = None, keep_words: int = 100_000) -> DataFrame:
    """Boundary records of all sequences: PIECES, ids as unsigned 16-bit little-endian integers."""
    tokens = materialize(tokenize_partitions(docs, id_col, text_col, end_id, vocabulary, keep_words), "packing")
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    # One row for each input partition: small however large the table is, as partitions hold many documents.
    from pyspark.sql import Window

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).cast("long").alias("base"))
    placed = tokens.join(F.broadcast(bases), "part").select("doc_id", "n", (F.col("base") + F.col("at")).alias("at"), "ids")

    def make():
        def fn(keys, ns, ats, ids):
            out = ([], [], [], [], [], [], [], [])
            for key, n, at, raw in zip(keys, ns, ats, ids, strict=True):
                start = 0
                while start < n:
                    where = (at + start) % length
                    took = min(n - start, length - where)
                    piece = raw[2 * start : 2 * (start + took)]
                    for column, value in zip(out, (key, start, took, crc32_u32(piece), n, (at + start) // length, where, piece), strict=True):
                        column.append(value)
                    start += took
            return out

        return fn

    return map_rows(placed, make, PIECES)


def op9_pack_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs all documents; the ids themselves stay in the operator's result, the query returns their digest."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_words=900_000).drop("ids")
