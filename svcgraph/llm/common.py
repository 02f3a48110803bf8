"""What the training-data operators share: scratch tables, Arrow row functions, words, token ids.

Nothing here decides a result on its own. All helpers treat null texts as empty and keep
integer keys as integers even when a column holds nulls (rows travel as Arrow, not pandas).
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that one call of a row function sees. Texts may be very long, so batches are cut
#: again by bytes: a function never holds more than about this many bytes of input text.
BATCH_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a local one only where all tasks run in this process's machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="svcgraph-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; every call gives another one."""
    return f"{shared_dir(spark)}/svcgraph/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once and read it back: cuts the lineage, and survives the loss of any executor."""
    path = scratch_path(df.sparkSession, name)
    small_batches(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def arrow_schema(schema: str) -> pa.Schema:
    """Arrow types of a plain "name type, name type" schema; also works where no session is."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split() for field in schema.split(", "))])


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch, cut so that no part holds many more than BATCH_BYTES bytes (one row at least)."""
    if batch.nbytes <= BATCH_BYTES or batch.num_rows <= 1:
        yield batch
        return
    half = batch.num_rows // 2
    # a slice's nbytes counts only what the slice covers
    yield from _pieces(batch.slice(0, half))
    yield from _pieces(batch.slice(half))


#: Rows that Spark hands to Python at once, where the session doesn't say otherwise; a batch lies in the JVM's and in Python's memory, and texts are long.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches from Spark's default of 10,000 rows; a number that was set stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def map_rows(df: DataFrame, make: Callable[[], Callable[..., tuple | Iterator[tuple]]], schema: str) -> DataFrame:
    """A narrow Spark stage: make() runs once in each task and gives fn(*columns as lists).

    fn returns lists for the columns of schema (a tuple of them), one call per part of a batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, fn = arrow_schema(schema), make()
        for whole in batches:
            for batch in _pieces(whole):
                got = fn(*(c.to_pylist() for c in batch.columns))
                if got is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(got, out.types, strict=True)], schema=out)
        give_back()

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def append_columns(df: DataFrame, column: str, make: Callable[[], Callable[[list], tuple]], extra: str) -> DataFrame:
    """df with the columns of `extra` ("name type, ..."), made from one column's values; all else passes through.

    A narrow stage: rows stay where they are. Names of extra must not be df's own.
    """
    from pyspark.sql.types import StructType

    fields = [f.split() for f in extra.split(", ")]
    schema = df.select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in fields]).schema
    if len({f.name.lower() for f in schema}) != len(schema):
        raise ValueError(f"columns {extra!r} clash with {df.columns}")
    at = df.columns.index(column)
    loose = StructType([type(f)(f.name, f.dataType, True) for f in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, fn = arrow_schema(extra), make()
        for whole in batches:
            for b in _pieces(whole):
                got = fn(b.column(at).to_pylist())
                added = [pa.array(v, t) for v, t in zip(got, kinds.types, strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns, *added], names=[*b.schema.names, *kinds.names])
        give_back()

    small_batches(df.sparkSession)
    return df.mapInArrow(run, loose)


def may_hold(df: DataFrame, column: str, ids: DataFrame, bits: int = 22, name: str = "may") -> DataFrame:
    """df with a new column: false only where the (long) column is null or surely none of ids' one column; native expressions.

    The bitmap of the ids' hashes has 2^bits bits however many ids there are (512 KB for 22), so it is broadcast: with very
    many ids nearly all bits are set and nothing is told apart, at no cost but this one.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits))
    _, bucket, at, bitmap = fresh_names(df, "bucket", "at", "bitmap")
    maps = ids.select(place(F.col(ids.columns[0])).alias("h")).groupBy(F.bitmap_bucket_number("h").alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias(bitmap))
    put = df.withColumn(bucket, F.bitmap_bucket_number(place(F.col(column)))).withColumn(at, F.bitmap_bit_position(place(F.col(column)))).join(F.broadcast(maps), bucket, "left")
    byte = F.conv(F.hex(F.expr(f"substring({bitmap}, CAST({at} DIV 8 AS INT) + 1, 1)")), 16, 10).cast("int")
    bit = byte.bitwiseAND(F.expr(f"shiftleft(1, CAST({at} % 8 AS INT))")) != 0
    return put.withColumn(name, F.coalesce(bit, F.lit(False)) & F.col(column).isNotNull()).drop(bucket, at, bitmap)


def fresh_names(df: DataFrame, *stems: str) -> list:
    """df itself and, for each stem, a column name that df doesn't have yet."""
    taken, names = {c.lower() for c in df.columns}, []
    for stem in stems:
        name = f"_{stem}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        names.append(name)
    return [df, *names]


def text_of(text: str | None) -> str:
    return text if text is not None else ""


_TABLE: list[tuple] = []


def give_back() -> None:
    """Return this process's freed memory to the system; allocators keep it otherwise, beside the next table."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim is not None:
        trim(0)


def process_table(key: object, make: Callable[[], object]):
    """The process's one large table, made when first asked for under a key; another key's takes its place.

    Python workers live on between tasks and stages, so tables of several operators would add up.
    """
    if not _TABLE or _TABLE[0][0] != key:
        if _TABLE:
            _TABLE.clear()
            give_back()
        _TABLE.append((key, make()))
    return _TABLE[0][1]


# --- words -----------------------------------------------------------------------------------

#: Bytes that are no part of a licence word become spaces; A-Z become a-z.
_LICENSE_TABLE = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


def utf8(text: str | None) -> bytes:
    """UTF-8, with lone surrogates kept as they are."""
    return text_of(text).encode("utf-8", "surrogatepass")


def plain_words(text: str | None) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z in lower case, as UTF-8."""
    return utf8(text).translate(_LICENSE_TABLE).split()


def space_words(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of the text with A-Z in lower case, as UTF-8."""
    return utf8(text).lower().split()


# --- token ids -------------------------------------------------------------------------------

VOCABULARY = "word_bpe_49k.json"


class WordTokenizer:
    """Ids of whole texts under the public 49k-word vocabulary, each distinct piece encoded once.

    The vocabulary's pre-tokenizer drops white space and never merges across it, so a text's
    ids are those of its space-separated chunks one after another. Chunks, and the pieces in
    them, are kept with their ids; the library encodes whatever is new, many pieces a call.
    The two tables are emptied beyond KEEP entries, which bounds memory and changes no result.
    """

    KEEP = 300_000
    #: Characters whose words lie in lists at once (one text at least): a word there takes some ten times its text.
    AT_ONCE = 1_000_000
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str | None = None) -> None:
        import re

        import regex
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(VOCABULARY)
        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab()
        if max(vocabulary.values()) >= 1 << 16:
            raise ValueError("ids of this vocabulary don't fit 16 bits")
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.chunks: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.find = regex.compile(self.PATTERN).findall
        # Pieces are found here only where normal forms and classes can't differ; other chunks go whole.
        self.unusual = re.compile("[^\x00-ɏ]|İ|<\\|").search

    def _whole(self, chunk: str) -> bytes:
        return np.array(self.library.encode(chunk, add_special_tokens=False).ids, "<u2").tobytes()

    def _learn(self, words: set[str]) -> None:
        if len(self.chunks) > self.KEEP:
            self.chunks.clear()
        if len(self.parts) > self.KEEP:
            self.parts.clear()
        # Chunks of known pieces are done at once; only those with a new piece wait.
        chunks, parts, find, unusual = self.chunks, self.parts, self.find, self.unusual
        waiting: list[str] = []
        new: set[str] = set()
        for word in words:
            if unusual(word):
                chunks[word] = self._whole(word)
                continue
            low = word.lower()
            if low.isalpha():
                known = parts.get(low)
                if known is not None:
                    chunks[word] = known
                else:
                    new.add(low)
                    waiting.append(word)
                continue
            pieces = (low[:-1], low[-1]) if low[-1:] in (".", ",") and low[:-1].isalpha() else find(low)
            known = [parts.get(p) for p in pieces]
            if None in known:
                new.update([p for p, k in zip(pieces, known, strict=True) if k is None])
                waiting.append(word)
            else:
                chunks[word] = b"".join(known)
        pieces = list(new)
        groups = [pieces[i : i + 256] for i in range(0, len(pieces), 256)]
        encode = self.library.encode_batch_fast
        for i in range(0, len(groups), 64):
            some = groups[i : i + 64]
            for group, coded in zip(some, encode([" ".join(g) for g in some], add_special_tokens=False), strict=True):
                ids = np.array(coded.ids, "<u2")
                stops = np.flatnonzero(self.ends[ids]) + 1
                if len(stops) != len(group):
                    parts.update((p, self._whole(p)) for p in group)
                    continue
                raw, at = ids.tobytes(), 0
                for piece, stop in zip(group, (2 * stops).tolist(), strict=True):
                    parts[piece] = raw[at:stop]
                    at = stop
        for word in waiting:
            low = word.lower()
            chunks[word] = parts[low] if low.isalpha() else b"".join([parts[p] for p in find(low)])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 16-bit integers."""
        out: list[bytes] = []
        some: list[str] = []
        held = 0
        for text in map(text_of, texts):
            some.append(text)
            held += len(text)
            if held >= self.AT_ONCE:
                out += self._encode(some)
                some, held = [], 0
        return out + self._encode(some)

    def _encode(self, texts: list[str]) -> list[bytes]:
        split = [t.replace("\n", " ").split(" ") for t in texts]
        new: set[str] = set()
        for words in split:
            new.update(words)
        new = new.difference(self.chunks)
        if new:
            if len(self.chunks) > self.KEEP:
                new = {w for words in split for w in words}
            self._learn(new)
        get = self.chunks.__getitem__
        return [b"".join(map(get, words)) for words in split]


def word_tokenizer(path: str | None = None, keep: int = WordTokenizer.KEEP) -> WordTokenizer:
    """This process's tokenizer: Python workers live on between tasks, and so do its tables, of `keep` words about (more: less time, more memory)."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"

    def make() -> WordTokenizer:
        made = WordTokenizer(path)
        made.KEEP = keep
        return made

    return process_table(("tokenizer", path, keep), make)


def crc32_u32(ids16: bytes) -> int:
    """Unsigned crc32 of 16-bit ids written as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.frombuffer(ids16, "<u2").astype("<u4").tobytes())
