"""Operator 2: exact top-k inner-product search on a bit-sliced index.

Index: rows are packed where they lie into blocks; a block keeps, for each component, the `bits` most
significant bits of its values' range as bit slices (one bitmap of rows a bit), and the exact values.
Search: a query's score is summed over all rows of a block at once by bitmap arithmetic (slices
shifted by the set bits of the query's weights, added by full adders; negative weights take
complements). From the most significant slice of the sum downward the k-th largest sum is found; the
cut bits bound each true score, so rows that can't reach the top k go, and the rest, the boundary
rows, are scored exactly.

Queries (the stated set) meet all rows in a grid of blocks: index blocks fall into cells,
query blocks into groups, each (cell, group) is one bounded task. Each gives k rows a query, a window
ranks them. The index covers every row; recall is 1 by construction.

Defined results: vectors that are null or hold null or non-finite components take no part, neither as
query nor as candidate, nor do rows with a null id; shorter vectors count as padded by zeros; a
candidate with the query's own id is never returned; repeated rows are candidates each;
a repeated query asks once for each distinct vector; fewer than k candidates give all; an empty table
gives no row; columns beyond the named two are ignored.
"""

from __future__ import annotations


import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_schema, materialize

BLOCK_ROWS = 16_384
CELL_BLOCKS = 8
GROUP_QUERIES = 64
BLOCK = "uid long, rows int, dims int, keys binary, vectors binary, shift int, low binary, slices binary"


def _pack(df: DataFrame, rows: int, bits: int) -> DataFrame:
    """(key, v array<long>) -> BLOCK rows of at most `rows` vectors; bits 0: without slices."""
    import pyarrow as pa

    def blocks(part: int, seq: int, keys: np.ndarray, lists: list) -> tuple:
        dims = max(map(len, lists), default=0)
        v = np.zeros((len(lists), dims), "i8")
        for i, x in enumerate(lists):
            v[i, : len(x)] = x
        shift, low, slices = 0, np.zeros(dims, "i8"), b""
        if bits and v.size:
            low = v.min(0)
            spread = int((v.max(0) - low).max())
            shift = max(0, spread.bit_length() - bits)
            u = (v - low) >> shift
            slices = b"".join([np.packbits((u[:, d] >> i & 1).astype(bool), bitorder="little").tobytes() for d in range(dims) for i in range(bits)])
        return part << 32 | seq, len(lists), dims, keys.tobytes(), v.tobytes(), shift, low.tobytes(), slices

    def run(batches):
        from pyspark import TaskContext

        out, part, seq = arrow_schema(BLOCK), TaskContext.get().partitionId(), 0
        keys, lists = [], []

        def give(k: list, x: list):
            row = blocks(part, seq, np.array(k, "i8"), x)
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, out.types, strict=True)], schema=out)

        for b in batches:
            keys += b.column(0).to_pylist()
            lists += b.column(1).to_pylist()
            while len(keys) >= rows:
                yield give(keys[:rows], lists[:rows])
                keys, lists, seq = keys[rows:], lists[rows:], seq + 1
        if keys:
            yield give(keys, lists)

    return df.mapInArrow(run, BLOCK)


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """key, v: floor(scale * x) of each component as a double; unusable rows left out."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    fine = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.where(F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("key"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"))


def build_index(rows: DataFrame, block_rows: int = BLOCK_ROWS, bits: int = 5) -> DataFrame:
    """rows (key, v) -> the written index, one row a block."""
    return materialize(_pack(rows, block_rows, bits), "slices")


class Block:
    """One index block: bitmaps are Python integers, bit r stands for row r."""

    def __init__(self, rows: int, dims: int, keys: bytes, vectors: bytes, shift: int, low: bytes, slices: bytes, bits: int) -> None:
        self.rows, self.dims, self.shift, self.bits = rows, dims, shift, bits
        self.keys = np.frombuffer(keys, "i8")
        self.vectors = np.frombuffer(vectors, "i8").reshape(rows, dims)
        self.huge = bool(self.vectors.size) and int(np.abs(self.vectors).max()) >= 1 << 27
        size, self.all = -(-rows // 8), (1 << rows) - 1
        self.slices = [[int.from_bytes(slices[(d * bits + i) * size : (d * bits + i + 1) * size], "little") for i in range(bits)] for d in range(dims)]
        self.complements = [[s ^ self.all for s in own] for own in self.slices]

    def sums(self, weights: list[int]) -> list[int]:
        """Bit slices (least first) of each row's weighted sum of quantised values, complements for negative weights."""
        columns: list[list[int]] = [[] for _ in range(self.bits + 1)]
        for d, w in enumerate(weights):
            own, p = self.slices[d] if w >= 0 else self.complements[d], 0
            w = abs(w)
            while w:
                if w & 1:
                    while len(columns) < p + self.bits + 1:
                        columns.append([])
                    for i, s in enumerate(own):
                        if s:
                            columns[p + i].append(s)
                w >>= 1
                p += 1
        out, at = [], 0
        while at < len(columns):
            column = columns[at]
            if len(column) > 1 and at + 1 == len(columns):
                columns.append([])
            while len(column) > 2:  # full adders: three bitmaps of a weight give one, and a carry
                a, b, c = column.pop(), column.pop(), column.pop()
                x = a ^ b
                column.insert(0, x ^ c)
                columns[at + 1].append(a & b | x & c)
            if len(column) == 2:
                a, b = column
                column[:] = [a ^ b]
                columns[at + 1].append(a & b)
            out.append(column[0] if column else 0)
            at += 1
        return out

    def boundary(self, weights: list[int], k: int, among: int) -> np.ndarray:
        """Rows of the bitmap `among` that may be in its top k."""
        if among.bit_count() > k:
            slices = self.sums(weights)
            certain, open_, kth = 0, among, 0
            for i in range(len(slices) - 1, -1, -1):
                high = open_ & slices[i]
                if (certain | high).bit_count() >= k:
                    open_, kth = high, kth | 1 << i
                else:
                    certain, open_ = certain | high, open_ & ~slices[i]
            # A true score is 2^shift times the sum, and off by less than 2^shift - 1 times the weights' sum.
            least = kth - (((1 << self.shift) - 1) * sum(map(abs, weights)) >> self.shift) - 1
            if least > 0:
                above, equal = 0, among
                for i in range(max(len(slices), least.bit_length()) - 1, -1, -1):
                    s = slices[i] if i < len(slices) else 0
                    if least >> i & 1:
                        equal &= s
                    else:
                        above, equal = above | equal & s, equal & ~s
                among = above | equal
        raw = np.frombuffer(among.to_bytes(-(-self.rows // 8), "little"), "u1")
        return np.flatnonzero(np.unpackbits(raw, bitorder="little")[: self.rows])

    def top(self, key: int, vector: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(score, key) of the block's k best rows for the query, ties to smaller keys."""
        weights = [int(x) for x in vector[: self.dims]]
        among = self.all
        for r in np.flatnonzero(self.keys == key).tolist():
            among ^= 1 << r
        rows = self.boundary(weights, k, among)
        if self.huge or any(abs(w) >= 1 << 27 for w in weights):
            scores = [sum(x * w for x, w in zip(v, weights, strict=False)) for v in self.vectors[rows].tolist()]
            return sorted(zip(scores, self.keys[rows].tolist(), strict=True), key=lambda x: (-x[0], x[1]))[:k]
        scores = self.vectors[rows][:, : len(weights)] @ np.array(weights, "i8")
        order = np.lexsort((self.keys[rows], -scores))[:k]
        return list(zip(scores[order].tolist(), self.keys[rows][order].tolist(), strict=True))


def search(index: DataFrame, queries: DataFrame, k: int = 10, bits: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: for each row (key, v) of queries the k best rows of the index."""
    import pyarrow as pa

    asked = materialize(_pack(queries.distinct(), 256, 0), "asked")
    blocks, groups = index.count(), max(1, -(-asked.count() // GROUP_QUERIES))
    cells = max(1, min(blocks, max(64, -(-blocks // CELL_BLOCKS))))

    def dealt(n: int) -> Column:
        return F.pmod(F.xxhash64("uid"), F.lit(n)).cast("int")

    left = index.withColumn("cell", dealt(cells)).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = asked.select("uid", "rows", "dims", "keys", "vectors").withColumn("part", dealt(groups)).withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
    schema = "query_id long, asked long, vec_id long, score long"

    def meet(rows: pa.Table, questions: pa.Table) -> pa.Table:
        out, found = arrow_schema(schema), []
        wanted = []
        for q in questions.to_pylist():
            keys = np.frombuffer(q["keys"], "i8").tolist()
            vectors = np.frombuffer(q["vectors"], "i8").reshape(q["rows"], q["dims"])
            wanted += [(key, q["uid"] << 8 | i, vectors[i]) for i, key in enumerate(keys)]
        best: dict[int, list] = {}
        for row in rows.select(["rows", "dims", "keys", "vectors", "shift", "low", "slices"]).to_pylist() if wanted else []:
            block = Block(**{n: row[n] for n in row}, bits=bits)
            for key, name, vector in wanted:
                got = best.get(name, []) + block.top(key, vector, k)
                best[name] = sorted(got, key=lambda x: (-x[0], x[1]))[:k]
        for key, name, _ in wanted:
            found += [(key, name, own, score) for score, own in best.get(name, [])]
        return pa.Table.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate(out.types)], schema=out)

    partial = left.groupBy("cell", "part").cogroup(right.groupBy("cell", "part")).applyInArrow(meet, schema)
    rank = F.row_number().over(Window.partitionBy("query_id", "asked").orderBy(F.desc("score"), "vec_id"))
    return partial.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return search(build_index(rows), rows.where("key % 100 = 0"))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
