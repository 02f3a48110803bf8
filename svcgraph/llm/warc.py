"""Operator 5: WARC archives with a two-level capture index.

Writing: equal payloads (by SHA-1) agree on the largest page_id as their response through an aggregate,
joined back by digest with as many salts as a payload's rows need. Each task writes one archive of single-record gzip
members and gives a capture row for each. Captures are dealt by range of (reversed-host key,
page_id) and sorted; each task writes an index shard: compressed blocks of `BLOCK_LINES` lines, and a sparse directory with
each block's first key. One manifest row a shard is the upper level.

Reading: a task with sorted keys binary-searches the manifest (one row a shard), the shard's
directory, and the block's lines; block and record are range reads. All files lie in the shared
folder, under a name of their attempt until complete, so lost tasks can run again.

Defined results: a null html is an empty payload; a null url has no target and the empty key; rows with a null
page_id are stored; they revisit a response with an id, and are responses where no row of the
group has one; repeated rows with the largest id are all responses; payloads under
`least_bytes` bytes are always responses; an empty table gives no file; columns beyond
page_id, url and html are ignored. Payload bytes and digest of a revisit are those of the full payload.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import json
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .binary_records import local_url, open_store
from .common import arrow_schema, materialize, scratch_path, text_of

BLOCK_LINES = 1024
#: Rows of one payload that go to one place, about.
SHARE = 50_000
#: Lines of the index that one looking-up task covers, about.
LOOKUP_LINES = 4096
CAPTURE = "surt string, page_id long, file string, at long, size long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def surt_key(url: Column) -> Column:
    """Reversed-host key: example.com/a?b -> "com,example)/a?b"; scheme, user, port and fragment go."""
    text = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(text, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rest = F.regexp_extract(text, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^#]*)", 1)
    plain = F.regexp_extract(text, r"^([^#]*)", 1)
    return F.when(text.rlike("^[A-Za-z][A-Za-z0-9+.\\-]*://"), F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)).otherwise(plain)


def typed(pages: DataFrame, least_bytes: int = 0, share: int = SHARE) -> DataFrame:
    """page_id, url, surt, html, refers_to (null for responses)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1("html")).withColumn("surt", surt_key(F.col("url")))
    groups = rows.where(F.octet_length("html") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("many")).where("many > 1 AND first IS NOT NULL")
    # Only payloads that occur twice; a hot one is sent to as many places as its rows need, where a share of them goes.
    groups = materialize(groups.withColumn("salts", F.ceil(F.col("many") / share).cast("int")), "payloads")
    hot = groups.where("salts > 1").select("digest", "salts")  # one row for each `share` rows at most
    wide = groups.select("digest", "first", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    salted = rows.join(F.broadcast(hot), "digest", "left").withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.coalesce("salts", F.lit(1))).cast("int"))
    joined = salted.join(wide, ["digest", "salt"], "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return joined.select("page_id", "url", "surt", "html", refers.alias("refers_to"))


def _header(value: str) -> str:
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def record_bytes(page_id: int | None, url: str | None, html: str | None, refers_to: int | None, date: str) -> bytes:
    """One WARC record; a revisit has the HTTP header alone."""
    import hashlib

    payload = text_of(html).encode("utf-8", "surrogatepass")
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload if refers_to is None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}", f"Payload-Length: {len(payload)}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header(url)}")
    if page_id is not None:
        lines.append(f"Page-ID: {page_id}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"Refers-To-Page-ID: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple:
    """A RECORD row from one uncompressed WARC record."""
    import hashlib

    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
    if payload is not None and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError(f"damaged payload of {fields.get('WARC-Record-ID')}")
    url = fields.get("WARC-Target-URI")
    number = lambda name: int(fields[name]) if name in fields else None
    return number("Page-ID"), None if url is None else url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"), int(fields["Payload-Length"]), digest, kind, number("Refers-To-Page-ID"), payload


def write_archives(rows: DataFrame, folder: str, date: str) -> DataFrame:
    """Typed rows -> one archive a task; CAPTURE rows."""
    import pyarrow as pa

    folder = local_url(folder)

    def run(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, root = open_store(folder)
        # Captures name their own attempt's file: rows of another attempt may come in another order, at other offsets.
        out, name = arrow_schema(CAPTURE), f"pages-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        sink, at = None, 0
        for b in batches:
            if sink is None:
                store.create_dir(root, recursive=True)
                sink = store.open_output_stream(f"{root}/{name}", compression=None)  # members are compressed one by one
            found = []
            for page_id, url, surt, html, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                member = gzip.compress(record_bytes(page_id, url, html, refers_to, date), 4, mtime=0)
                sink.write(member)
                found.append((surt, page_id, name, at, len(member)))
                at += len(member)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*found), out.types, strict=True)], schema=out)
        if sink is not None:
            sink.close()

    return rows.select("page_id", "url", "surt", "html", "refers_to").mapInArrow(run, CAPTURE)


def _order(surt: str, page_id: int | None) -> tuple:
    return surt, page_id is not None, page_id or 0


def write_index(captures: DataFrame, folder: str) -> DataFrame:
    """CAPTURE rows -> index shards; the manifest: path, first and last key, lines."""
    import pyarrow as pa

    schema = "path string, first_surt string, first_id long, last_surt string, last_id long, lines long"
    folder = local_url(folder)

    def run(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, root = open_store(folder)
        name = f"{root}/index-{TaskContext.get().partitionId():06d}"
        own, sink, at, lines, directory, first, last = f"{root}/.{uuid.uuid4().hex}", None, 0, [], [], None, None
        count = 0

        def flush() -> int:
            block = zlib.compress("\n".join(json.dumps(x) for x in lines).encode(), 6)
            sink.write(block)
            directory.append((lines[0][0], lines[0][1], at, len(block)))
            return len(block)

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if sink is None:
                    store.create_dir(root, recursive=True)
                    sink = store.open_output_stream(own)
                    first = row[:2]
                lines.append(row)
                last, count = row[:2], count + 1
                if len(lines) == BLOCK_LINES:
                    at += flush()
                    lines = []
        if sink is not None:
            if lines:
                at += flush()
            sink.close()
            with store.open_output_stream(own + ".dir") as sparse:
                sparse.write(json.dumps(directory).encode())
            store.move(own, name + ".blocks")
            store.move(own + ".dir", name + ".dir")
            out = arrow_schema(schema)
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((name, *first, *last, count), out.types, strict=True)], schema=out)

    dealt = captures.repartitionByRange("surt", "page_id").sortWithinPartitions("surt", "page_id", "file", "at")
    return materialize(dealt.mapInArrow(run, schema), "manifest")


class CaptureIndex:
    """Lookups in one task: what was read last is kept, as keys come in order."""

    def __init__(self, folder: str, shards: list[tuple]) -> None:
        self.store, self.root = open_store(folder)
        self.shards = sorted((_order(*s[1:3]), _order(*s[3:5]), s[0]) for s in shards)
        self.firsts = [s[0] for s in self.shards]
        self.lasts = [s[1] for s in self.shards]
        self.directory: tuple = (None, [], [])
        self.block: tuple = (None, [], [])
        self.files: dict = {}

    def _directory(self, path: str) -> tuple:
        if self.directory[0] != path:
            with self.store.open_input_stream(path + ".dir") as f:
                entries = json.loads(f.read())
            self.directory = (path, [_order(e[0], e[1]) for e in entries], entries)
        return self.directory

    def _open(self, path: str):
        if path not in self.files:
            if len(self.files) >= 64:
                self.files.pop(next(iter(self.files))).close()
            self.files[path] = self.store.open_input_file(path)
        return self.files[path]

    def _block(self, path: str, at: int, size: int) -> tuple:
        if self.block[0] != (path, at):
            source = self._open(path + ".blocks")
            source.seek(at)
            lines = [json.loads(x) for x in zlib.decompress(source.read(size)).split(b"\n")]
            self.block = ((path, at), [_order(x[0], x[1]) for x in lines], lines)
        return self.block

    def captures(self, surt: str, page_id: int | None) -> Iterator[list]:
        """All captures of a key: binary search by shard, by block, and in the block; then on to the first other key."""
        key = _order(surt, page_id)
        for s in range(bisect.bisect_left(self.lasts, key), bisect.bisect_right(self.firsts, key)):
            path, firsts, entries = self._directory(self.shards[s][2])
            for e in entries[max(0, bisect.bisect_left(firsts, key) - 1) : bisect.bisect_right(firsts, key)]:
                _, keys, lines = self._block(path, e[2], e[3])
                yield from lines[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]

    def record(self, file: str, at: int, size: int) -> tuple:
        source = self._open(f"{self.root}/{file}")
        source.seek(at)
        return parse_record(gzip.decompress(source.read(size)))

    def close(self) -> None:
        for f in self.files.values():
            f.close()


def lookup(keys: DataFrame, manifest: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """RECORD rows of all captures of keys (surt, page_id); without payload if not asked for."""
    import pyarrow as pa

    folder = local_url(folder)
    shards = [tuple(r) for r in manifest.select("path", "first_surt", "first_id", "last_surt", "last_id").collect()]  # a row a shard
    lines = manifest.agg(F.coalesce(F.sum("lines"), F.lit(0))).first()[0]
    tasks = max(1, len(shards), -(-lines // LOOKUP_LINES))  # an explicit number: keys are tiny, what they make tasks read is not

    def run(batches) -> Iterator[pa.RecordBatch]:
        index, out = CaptureIndex(folder, shards), arrow_schema(RECORD)

        def give(found: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*found), out.types, strict=True)], schema=out)

        for b in batches:
            found = []
            for surt, page_id in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for capture in index.captures(surt, page_id):
                    row = index.record(*capture[2:])
                    found.append(row if payload else (*row[:6], None))
                    if len(found) == 500:
                        yield give(found)
                        found = []
            if found:
                yield give(found)
        index.close()

    asked = keys.select("surt", "page_id").distinct().repartitionByRange(tasks, "surt", "page_id").sortWithinPartitions("surt", "page_id")
    return asked.mapInArrow(run, RECORD)


def archive(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", least_bytes: int = 0) -> DataFrame:
    """Write archives and index of pages into folder; the manifest."""
    captures = materialize(write_archives(typed(pages, least_bytes), folder, date), "captures")
    return write_index(captures, folder)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, folder = spark.read.parquet(f"{sf_dir}/pages.parquet"), scratch_path(spark, "warc")
    manifest = archive(pages, folder)
    keys = pages.select(surt_key(F.col("url").cast("string")).alias("surt"), F.col("page_id").cast("long"))
    return lookup(keys, manifest, folder, payload=False).drop("payload", "url")


SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages
), d AS (
  SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
    array_to_string(list_transform(range(0, 8), lambda i: array_to_string(list_transform([32768, 1024, 32, 1],
      lambda m: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(hex, CAST(5 * i + 1 AS BIGINT), 5) AS BIGINT) // m) % 32 + 1 AS BIGINT), 1)), '')), '') AS payload_digest,
    max(page_id) OVER (PARTITION BY hex) AS response
  FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> response THEN response END AS refers_to FROM d
"""
