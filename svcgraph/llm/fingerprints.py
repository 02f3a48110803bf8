"""Operator 13: document fingerprints by one-permutation MinHash with optimal densification and packed low-order bits.

A document's distinct 5-word shingles are hashed once to 64 bits; the top bits name one of `BINS` bins, and each bin keeps its smallest
hash. An empty bin takes the value of the first filled bin in a random order of its own (the same order
for every document), so two documents that fill the same bins fill their empty ones alike. Of each bin the low
`BITS` bits are stored, a hex digit a bin. Two fingerprints agree in a bin with probability J + (1 - J) / 2^BITS, so
the likeness is (share of agreeing bins - 2^-BITS) / (1 - 2^-BITS), between 0 and 1.

Each document is also compared with the next one by id, and with an edit of its own text that borrows from the next one. Neighbours
meet in one shuffle of the texts: a first job over ids alone cuts their order into parts of about `PART_BYTES` of text and keeps each part's first
row's key (a row a part); the second sends a part's first row to the part before it as well, so that every row has its successor in its own part.

Defined results: a null text is an empty one; a text without words has the empty fingerprint, which is like another empty one (1.0) and
unlike all others (0.0); under five words the whole sequence is one shingle; rows with a null id come first, equal ids are in the
order of their texts' hashes, and equal rows follow each other, each with a result; after the last row comes the first one, a single
row follows itself; an empty table gives no row; columns beyond the named two are ignored. The rows must be the same in the
same partitions when docs is read twice, as those of a stored table are.
"""

from __future__ import annotations

import bisect
import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _pieces, arrow_schema, give_back, map_rows, process_table, text_of, utf8
from .ngram_join import Shingler

BINS, BITS = 512, 4
#: Rounds in which all empty bins ask their next one; those still empty then find their first filled one at once.
ASKED = 12
#: Text bytes of one part, about.
PART_BYTES = 16 << 20

U = np.uint64


class Fingerprinter:
    """Fingerprints of whole texts; texts with the same shingles have the same one."""

    def __init__(self) -> None:
        self.shingler = Shingler()
        self.starts = np.arange(BINS, dtype=U) << U(64 - BINS.bit_length() + 1)
        # asked[k, i]: the bin that bin i, being empty, asks as its k-th, every bin in a random order of its own; order[i, j]: when i asks j
        asked = np.random.Generator(np.random.PCG64(13)).random((BINS, BINS)).argsort(1)
        self.asked, self.order = np.ascontiguousarray(asked.T), asked.argsort(1).astype("u2")

    def minima(self, features: np.ndarray) -> np.ndarray:
        """For each bin the smallest of the (sorted, distinct, at least one) hashes that fall into it, else that of another bin."""
        at = np.searchsorted(features, self.starts)
        filled = np.diff(at, append=len(features)) > 0
        out = features[np.minimum(at, len(features) - 1)]
        empty = np.flatnonzero(~filled)
        for k in range(ASKED):
            if not len(empty):
                return out
            from_ = self.asked[k, empty]
            good = filled[from_]
            out[empty[good]] = out[from_[good]]
            empty = empty[~good]
        if len(empty):
            full = np.flatnonzero(filled)
            out[empty] = out[full[self.order[empty[:, None], full].argmin(1)]]
        return out

    def packed(self, features: np.ndarray) -> str:
        if not len(features):
            return ""
        low = (self.minima(features) & U((1 << BITS) - 1)).astype("u1")
        return (low[::2] << 4 | low[1::2]).tobytes().hex()

    def of(self, texts: list[str | None]) -> list[str]:
        return [self.packed(f) for f in self.shingler.features(texts)]


def likeness(a: str, b: str) -> float:
    """The estimated Jaccard similarity of two fingerprints' shingle sets."""
    if not a or not b:
        return float(a == b)
    if a == b:
        return 1.0
    same = np.count_nonzero(np.frombuffer(a.encode(), "u1") == np.frombuffer(b.encode(), "u1")) / BINS
    chance = 2.0**-BITS
    return min(1.0, max(0.0, (same - chance) / (1 - chance)))


def edited(text: str, following: str) -> str:
    """The text with its last quarter of code points replaced by the first as many (or all) of another text."""
    m = len(text) // 4
    return text[: len(text) - m] + following[:m]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint of every row; a narrow pass."""

    def make():
        made = process_table("fingerprinter", Fingerprinter)
        return lambda keys, texts: (keys, made.of(texts))

    return map_rows(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), make, "doc_id long, fingerprint string")


# --- neighbours ----------------------------------------------------------------------------------

KEYED = "part int, ghost boolean, key long, salt long, line long, text string"


def _order_key(key, salt, line) -> tuple:
    return (key is not None, key or 0, salt, line)


def _with_successors(docs: DataFrame, part_bytes: int) -> DataFrame:
    """KEYED rows, dealt by part and sorted: each part's rows in ascending order, then (ghost) the row after its last one."""
    import pyarrow as pa

    keyed = docs.select("key", F.xxhash64("text").alias("salt"), F.monotonically_increasing_id().alias("line"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(8, size // part_bytes)
    keys = keyed.select("key", "salt", "line").repartitionByRange(parts, F.col("key").asc_nulls_first(), "salt", "line")
    firsts = keys.groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("key", "salt", "line")).alias("first")).collect()  # one row a part
    bounds = sorted(_order_key(*r.first) for r in firsts)
    count = len(bounds)

    def run(batches):
        out = arrow_schema(KEYED)
        for b in batches:
            keys, salts, lines, texts = (b.column(k) for k in range(4))
            part, copies, before = [], [], []
            for i, row in enumerate(zip(keys.to_pylist(), salts.to_pylist(), lines.to_pylist(), strict=True)):
                key = _order_key(*row)
                p = max(0, bisect.bisect_right(bounds, key) - 1)
                part.append(p)
                if bounds[p] == key:
                    copies.append(i)
                    before.append((p - 1) % count)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([False] * len(part)), keys, salts, lines, texts], schema=out)
            if copies:
                few = [c.take(pa.array(copies)) for c in (keys, salts, lines, texts)]
                yield pa.RecordBatch.from_arrays([pa.array(before, pa.int32()), pa.array([True] * len(copies)), *few], schema=out)

    dealt = keyed.mapInArrow(run, KEYED).repartitionById(max(1, count), "part")
    return dealt.sortWithinPartitions("part", "ghost", F.col("key").asc_nulls_first(), "salt", "line")


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """RESULT for each row: its fingerprint, that of its edited text, and their likeness to each other and to the next row's."""
    import pyarrow as pa

    rows = _with_successors(docs.select(F.col(id_col).cast("long").alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")), part_bytes)

    def run(batches):
        made, out = process_table("fingerprinter", Fingerprinter), arrow_schema(RESULT)
        last = None  # part, key, text, fingerprint of the row that waits for its successor
        for whole in batches:
            for b in _pieces(whole):
                parts, ghosts, keys, texts = (b.column(k).to_pylist() for k in (0, 1, 2, 5))
                pairs = []
                for part, ghost, key, text, own in zip(parts, ghosts, keys, map(text_of, texts), made.of(texts), strict=True):
                    if last is not None and last[0] == part:
                        pairs.append((*last[1:], text, own))
                    last = None if ghost else (part, key, text, own)
                changed = [edited(text, following) for _, text, _, following, _ in pairs]
                prints = made.of(changed)
                cols = (
                    [p[0] for p in pairs], [len(p[1]) for p in pairs], [hashlib.sha256(utf8(t)).hexdigest() for t in changed], [p[2] for p in pairs], prints,
                    [likeness(p[2], e) for p, e in zip(pairs, prints, strict=True)], [likeness(p[2], p[4]) for p in pairs],
                )
                if pairs:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, out.types, strict=True)], schema=out)
        give_back()

    return rows.mapInArrow(run, RESULT)


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_neighbours(spark.read.parquet(f"{sf_dir}/documents.parquet"))
