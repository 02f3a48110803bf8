"""Recorded answers of other programs as data sources: git logs (SRC11) and advisory answers (SRC12); and documents in ordered parts (SNK01, SNK02, SNK04).

    register(spark)
    spark.read.format("git_log").load(folder)            # <folder>/repo_id=<n>/*: git log --format=%aI --name-only
    spark.read.format("advisory_answers").load(folder)   # <folder>/batch=<name>/*: a JSON answer a line
    rows.write.format("ordered_documents").mode("append").save(folder)

Files are opened through pyarrow's file systems, so a folder can be in any store that both driver and executors reach.
"""

from __future__ import annotations

import importlib
import json
import re
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage


def open_folder(url: str):
    """The file system of a folder and the path in it."""
    from pyarrow import fs

    if url.startswith("file:"):
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", url)
    return fs.FileSystem.from_uri(url) if "://" in url else (fs.LocalFileSystem(), url)


def files_by_key(url: str, key: str) -> list[tuple[str, str]]:
    """(value, path) of the files below folders key=value, in order."""
    from pyarrow import fs

    store, root = open_folder(url)
    found = []
    for info in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
        m = re.search(rf"/{key}=([^/]*)/[^/]*$", info.path)
        if m and info.type == fs.FileType.File and not info.base_name.startswith(("_", ".")):
            found.append((m[1], info.path))
    return sorted(found)


@dataclass
class KeyedFiles(InputPartition):
    """One task's files with the value of their folder."""

    files: list[tuple[str, str]]


class KeyedReader(DataSourceReader):
    """Files below key=value folders, some to a task; equality filters on the key are pushed, so other folders aren't opened."""

    def __init__(self, options: dict, key: str, cast: Callable[[str], object]) -> None:
        self.url, self.key, self.cast = options["path"], key, cast
        self.per_task = max(1, int(options.get("filespertask", "16")))
        self.wanted: set | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == (self.key,):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = values if self.wanted is None else self.wanted & values
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        files = [(v, p) for v, p in files_by_key(self.url, self.key) if self.wanted is None or self.cast(v) in self.wanted]
        return [KeyedFiles(files[i : i + self.per_task]) for i in range(0, len(files), self.per_task)] or [KeyedFiles([])]


# --- git logs --------------------------------------------------------------------------------------


def parse_log(lines: Iterator[str]) -> Iterator[tuple[str, datetime]]:
    """(file, time) of a log with a line for each commit's ISO time and lines for its files; lines before the first time are none."""
    at = None
    for line in lines:
        line = line.rstrip("\r\n")
        if re.match(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d", line):
            try:
                at = datetime.fromisoformat(line)
                continue
            except ValueError:
                pass
        if line and at is not None:
            yield line, at


class GitLogReader(KeyedReader):
    def read(self, partition: KeyedFiles) -> Iterator[tuple]:
        from datetime import timezone

        store, _ = open_folder(self.url)
        for value, path in partition.files:
            with store.open_input_stream(path) as raw:
                import io

                for file, at in parse_log(io.TextIOWrapper(raw, encoding="utf-8", errors="replace")):
                    yield int(value), file, at if at.tzinfo else at.replace(tzinfo=timezone.utc)


class GitLog(DataSource):
    """SRC11: repo_id, file, ts of every commit that touched a file."""

    @classmethod
    def name(cls) -> str:
        return "git_log"

    def schema(self) -> str:
        return "repo_id int, file string, ts timestamp"

    def reader(self, schema) -> DataSourceReader:
        return GitLogReader(self.options, "repo_id", int)


# --- advisory answers ------------------------------------------------------------------------------

#: Attempts after a refusal, and the first delay in seconds.
RETRIES, DELAY = 3, 1.0


class Refused(Exception):
    """The other side asks to come later."""


def with_retries(ask: Callable[[], str], retries: int = RETRIES, delay: float = DELAY, wait: Callable[[float], None] = time.sleep) -> str:
    """ask(), again after each refusal, with delays that grow by `delay`; other errors, and the last refusal, are raised."""
    for attempt in range(retries + 1):
        try:
            return ask()
        except Refused:
            if attempt == retries:
                raise
            wait(delay * (attempt + 1))
    raise AssertionError


def read_text(path: str, url: str) -> str:
    """The default transport: the recorded file itself."""
    store, _ = open_folder(url)
    with store.open_input_stream(path) as raw:
        return raw.read().decode("utf-8")


def advisories_in(answer: dict) -> Iterator[tuple]:
    """Rows of one answer: the queries of a batch and, in their order, what was found."""
    for query, result in zip(answer["queries"], answer.get("results") or [], strict=False):
        for at, found in enumerate((result or {}).get("vulns") or []):
            fixed = None
            for event in next(iter((next(iter(found.get("affected") or []), {}) or {}).get("ranges") or []), {}).get("events") or []:
                if event.get("fixed"):
                    fixed = event["fixed"]
                    break
            urls = [x.get("url") for x in found.get("references") or [] if x.get("url")]
            scores = [{"score": None if s.get("score") is None else float(s["score"]), "severity": s.get("severity")} for s in found.get("severity") or []]
            summary = found.get("summary") if found.get("summary") is not None else found.get("details")
            yield query["package"]["ecosystem"], query["package"]["name"], query.get("version"), at, found.get("id"), summary, scores, list(found.get("aliases") or []), fixed, next(iter(urls), f"https://osv.dev/vulnerability/{found.get('id')}")


class AnswerReader(KeyedReader):
    """A batch whose transport keeps failing, or whose answer can't be read, gives one row that says so; the others count."""

    def __init__(self, options: dict) -> None:
        super().__init__(options, "batch", str)
        self.transport, self.delay = options.get("transport"), float(options.get("retrydelay", DELAY))

    def read(self, partition: KeyedFiles) -> Iterator[tuple]:
        ask = read_text
        if self.transport:
            module, _, name = self.transport.partition(":")
            ask = getattr(importlib.import_module(module), name)
        for value, path in partition.files:
            try:
                text = with_retries(lambda path=path: ask(path, self.url), delay=self.delay)
                rows = [row for line in text.splitlines() if line.strip() for row in advisories_in(json.loads(line))]
            except Exception as error:  # one batch's failure leaves a partial result
                yield value, False, f"{type(error).__name__}: {error}", *[None] * 10
                continue
            for row in rows:
                yield value, True, None, *row


class AdvisoryAnswers(DataSource):
    """SRC12: what was answered to batches of (ecosystem, name, version): a row for each advisory, and one for each failed batch."""

    @classmethod
    def name(cls) -> str:
        return "advisory_answers"

    def schema(self) -> str:
        return "batch string, ok boolean, error string, advisory_ecosystem string, name string, version string, at int, id string, summary string, scores array<struct<score:double,severity:string>>, aliases array<string>, fixed_version string, url string"

    def reader(self, schema) -> DataSourceReader:
        return AnswerReader(self.options)


# --- documents -------------------------------------------------------------------------------------


@dataclass
class Part(WriterCommitMessage):
    """One task's data file and index."""

    name: str | None
    documents: int


class DocumentWriter(DataSourceWriter):
    """Each task writes the documents' parts that it has, in the order of its rows, to one file of its own attempt, and an index: document, first place, offset, bytes.

    Only commit() makes them visible, by a manifest that names the files of the tasks that count; abort() takes the job's files away.
    """

    def __init__(self, options: dict) -> None:
        self.url, self.job = options["path"], uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Part:
        store, root = open_folder(self.url)
        name, index, now, size, out = f"part-{self.job}-{uuid.uuid4().hex}", [], None, 0, None
        for row in iterator:
            if out is None:
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(f"{root}/{name}.txt")
            if row["document"] != now:
                now = row["document"]
                index.append([now, row["place"], size, 0])
            line = (row["line"] or "").encode("utf-8", "surrogatepass") + b"\n"
            out.write(line)
            size += len(line)
            index[-1][3] += len(line)
        if out is None:
            return Part(None, 0)
        out.close()
        with store.open_output_stream(f"{root}/{name}.idx") as f:
            for entry in index:
                f.write(json.dumps(entry).encode() + b"\n")
        return Part(name, len(index))

    def commit(self, messages: list) -> None:
        store, root = open_folder(self.url)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/manifest-{self.job}.json") as f:
            f.write(json.dumps([m.name for m in messages if m and m.name]).encode())

    def abort(self, messages: list) -> None:
        from pyarrow import fs

        store, root = open_folder(self.url)
        for info in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if info.base_name.startswith(f"part-{self.job}-"):
                store.delete_file(info.path)


@dataclass
class Written(InputPartition):
    name: str | None


class DocumentReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.url = options["path"]

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, root = open_folder(self.url)
        found = []
        for info in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if info.base_name.startswith("manifest-"):
                with store.open_input_stream(info.path) as f:
                    found += json.loads(f.read())
        return [Written(name) for name in sorted(found)] or [Written(None)]

    def read(self, partition: Written) -> Iterator[tuple]:
        store, root = open_folder(self.url)
        if partition.name is None:
            return
        with store.open_input_stream(f"{root}/{partition.name}.idx") as f:
            index = [json.loads(line) for line in f.read().splitlines()]
        with store.open_input_file(f"{root}/{partition.name}.txt") as data:
            for document, place, at, size in index:
                data.seek(at)
                yield document, place, data.read(size).decode("utf-8", "surrogatepass")


class OrderedDocuments(DataSource):
    """Rows (document, place, line), sorted within tasks, become files; reading gives document, place (of its first line) and text of each part."""

    @classmethod
    def name(cls) -> str:
        return "ordered_documents"

    def schema(self) -> str:
        return "document string, place long, text string"

    def reader(self, schema) -> DataSourceReader:
        return DocumentReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return DocumentWriter(self.options)


def register(spark: SparkSession) -> None:
    """Makes the formats known to the session, and lets Spark push filters into them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (GitLog, AdvisoryAnswers, OrderedDocuments):
        spark.dataSource.register(source)


def write_documents(lines: DataFrame, document: str, order: list[str], folder: str, parts: int | None = None) -> None:
    """Lines (document, *order, line) as documents in ordered parts: a range sort deals them, so a long document spans several tasks."""
    from pyspark.sql import functions as F

    register(lines.sparkSession)
    keys = [F.col(document), *[F.col(c) for c in order]]
    dealt = (lines.repartitionByRange(parts, *keys) if parts else lines.repartitionByRange(*keys)).sortWithinPartitions(*keys)
    numbered = dealt.select(F.col(document).cast("string").alias("document"), F.monotonically_increasing_id().alias("place"), "line")
    numbered.write.format("ordered_documents").mode("append").save(folder)


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """document, place, text: the parts of all documents; a document is its parts' texts in the order of place."""
    register(spark)
    return spark.read.format("ordered_documents").load(folder)
