"""Archives of line files as a Spark source and sink: tar and zip, a partition a member (or a stretch of a large one).

Reading.  Only the table of contents is read at first: tar headers, skipping from one to the next, or the directory at a zip's end.
Members, by name, become partitions; members of a plain tar lie in it as they are, so large ones are dealt by SPLIT_BYTES, each
stretch with the lines that begin in it.  A member that can't be read or is no UTF-8 becomes one row with an error, and the others
are not touched.  A compressed tar has no places to go to: it is one partition.

Writing.  Each task writes an archive under a temporary name, its rows in members of about MEMBER_BYTES; the driver's commit gives
the archives their names, and a failed job leaves none.
"""

from __future__ import annotations

import fnmatch
import io
import tarfile
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..functions.lineage import scratch
from ..functions.workers import ship
from ..operators.registry import query

SPLIT_BYTES = 64 << 20
MEMBER_BYTES = 8 << 20
#: What a damaged archive or one with unknown features raises.
BAD = (tarfile.TarError, zipfile.BadZipFile, zlib.error, EOFError, OSError, ValueError, RuntimeError)


def store(path: str):
    """File system and path in it: a local one, or any that pyarrow knows by its scheme."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listed(path: str) -> list[str]:
    """The archives: the path itself, or the tar and zip files of a folder, by name."""
    from pyarrow import fs

    where, at = store(path)
    info = where.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [at]
    return sorted(f.path for f in where.get_file_info(fs.FileSelector(at)) if f.type == fs.FileType.File and f.base_name[0] != "_" and f.base_name.endswith((".tar", ".tar.gz", ".tgz", ".zip")))


@dataclass
class Stretch(InputPartition):
    """Bytes of a member; start and end are within it, offset is where its ``size`` bytes lie in a plain tar (-1: not there)."""

    archive: str
    member: str
    offset: int = -1
    size: int = 0
    start: int = 0
    end: int = -1


def lines(stream, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Place and bytes of the lines (split at LF alone) that begin from ``start`` to before ``end``; the stream stands at ``start``."""
    at = start
    while end < 0 or at < end:
        line = stream.readline()
        if not line:
            return
        yield at, line.removesuffix(b"\n")
        at += len(line)


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.pattern, self.split = options["path"], options.get("members", "*"), int(options.get("splitBytes", SPLIT_BYTES))

    def partitions(self) -> list[Stretch]:
        where, _ = store(self.path)
        out = []
        for archive in listed(self.path):
            if archive.endswith((".gz", ".tgz")):
                out.append(Stretch(archive, ""))
                continue
            try:
                with where.open_input_file(archive) as f:
                    if archive.endswith(".zip"):
                        with zipfile.ZipFile(Seekable(f)) as z:
                            out += [Stretch(archive, m.filename) for m in z.infolist() if not m.is_dir() and self.wanted(m.filename)]
                    else:
                        with tarfile.open(fileobj=f, mode="r:") as t:
                            for m in t:
                                if m.isfile() and self.wanted(m.name):
                                    out += [Stretch(archive, m.name, m.offset_data, m.size, a, min(a + self.split, m.size)) for a in range(0, max(1, m.size), self.split)]
            except BAD:
                out.append(Stretch(archive, ""))  # reported when it is read
        return sorted(out, key=lambda s: (s.member, s.archive, s.start))

    def wanted(self, name: str) -> bool:
        return fnmatch.fnmatchcase(name, self.pattern)

    def read(self, part: Stretch | None) -> Iterator[tuple]:
        if part is None:  # Spark's one partition where there is none
            return
        where, _ = store(self.path)
        try:
            with where.open_input_file(part.archive) as f:
                yield from self.rows(part, f)
        except BAD as e:
            yield part.archive, part.member, None, None, f"{type(e).__name__}: {e}"

    def rows(self, part: Stretch, f) -> Iterator[tuple]:
        if part.offset >= 0:
            back = min(1, part.start)  # whether a line begins at the start shows in the byte before
            f.seek(part.offset + part.start - back)
            if part.end > f.size() - part.offset:
                raise EOFError("the archive ends within the member")
            stream, start = io.BufferedReader(Region(f, part.size - part.start + back)), part.start
            if back:
                start += len(stream.readline()) - 1
            yield from self.told(part, part.member, lines(stream, start, part.end))
        elif part.archive.endswith(".zip"):
            with zipfile.ZipFile(Seekable(f)) as z, z.open(part.member) as stream:
                yield from self.told(part, part.member, lines(io.BufferedReader(stream), 0, -1))
        else:
            with tarfile.open(fileobj=f, mode="r:*") as t:
                for m in t:
                    if m.isfile() and self.wanted(m.name):
                        yield from self.told(part, m.name, lines(io.BufferedReader(t.extractfile(m)), 0, m.size))

    def told(self, part: Stretch, member: str, found: Iterator[tuple[int, bytes]]) -> Iterator[tuple]:
        for at, line in found:
            try:
                yield part.archive, member, at, line.decode("utf-8"), None
            except UnicodeDecodeError as e:
                yield part.archive, member, at, None, f"{type(e).__name__}: {e.reason}"


class Seekable(io.BufferedReader):
    """A file for zipfile, which asks for places before the beginning of short ones and takes OSError for an answer."""

    def __init__(self, f):
        super().__init__(Places(f))


class Places(io.RawIOBase):
    def __init__(self, f):
        self.f = f

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, at: int, whence: int = 0) -> int:
        try:
            return self.f.seek(at, whence)
        except ValueError as e:
            raise OSError(str(e)) from e

    def tell(self) -> int:
        return self.f.tell()

    def readinto(self, buffer) -> int:
        got = self.f.read(len(buffer))
        buffer[: len(got)] = got
        return len(got)


class Region(io.RawIOBase):
    """So many bytes of a file from where it stands, for buffered reading."""

    def __init__(self, f, left: int):
        self.f, self.left = f, left

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        got = self.f.read(min(len(buffer), self.left))
        self.left -= len(got)
        buffer[: len(got)] = got
        return len(got)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class ArchiveWriter(DataSourceWriter):
    """Rows (member, value): lines of the member of that name."""

    def __init__(self, options: dict):
        self.path, self.kind, self.most = options["path"], options.get("kind", "tar"), int(options.get("memberBytes", MEMBER_BYTES))

    def write(self, rows: Iterator) -> Written:
        first = next(rows, None)
        if first is None:
            return Written([])  # a task without rows leaves no archive
        where, folder = store(self.path)
        where.create_dir(folder, recursive=True)
        name = f"{uuid.uuid4().hex}.{self.kind}"
        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}
        parts: dict[str, int] = {}
        with where.open_output_stream(f"{folder}/_{name}") as f, (zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) if self.kind == "zip" else tarfile.open(fileobj=f, mode="w|")) as archive:

            def flush(member: str) -> None:
                body, k = b"".join(held.pop(member)), parts.get(member, 0)
                parts[member] = k + 1
                title = f"data/{member}-{k:05d}.jsonl"
                if self.kind == "zip":
                    archive.writestr(title, body)
                else:
                    info = tarfile.TarInfo(title)
                    info.size = len(body)
                    archive.addfile(info, io.BytesIO(body))

            for row in chain((first,), rows):
                line = row["value"].encode("utf-8") + b"\n"
                held.setdefault(row["member"], []).append(line)
                size[row["member"]] = size.get(row["member"], 0) + len(line)
                if size[row["member"]] >= self.most:
                    flush(row["member"])
                    size[row["member"]] = 0
            for member in sorted(held):
                flush(member)
        return Written([name])

    def commit(self, messages: list[Written | None]) -> None:
        where, folder = store(self.path)
        where.create_dir(folder, recursive=True)
        for m in messages:
            for name in m.names if m else ():
                where.move(f"{folder}/_{name}", f"{folder}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        where, folder = store(self.path)
        for m in messages:
            for name in m.names if m else ():
                where.delete_file(f"{folder}/_{name}")


class Archive(DataSource):
    @classmethod
    def name(cls) -> str:
        return "line_archive"

    def schema(self) -> str:
        return "archive string, member string, at long, value string, error string"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(dict(self.options))


def read_archive(spark: SparkSession, path: str, members: str = "*", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """archive, member, at (the line's place in its member, in bytes), value and error of the lines of all members that match.

    Blank lines go; an archive, a member or a line that can't be read is a row with its error and no value.
    """
    ship(spark)
    spark.dataSource.register(Archive)
    return spark.read.format("line_archive").option("members", members).option("splitBytes", split_bytes).load(path).where("error IS NOT NULL OR trim(value) <> ''")


def write_archive(df: DataFrame, path: str, kind: str = "tar", member_bytes: int = MEMBER_BYTES) -> None:
    """Writes rows (member, value) as archives in a folder, one by each task."""
    ship(df.sparkSession)
    df.sparkSession.dataSource.register(Archive)
    df.select("member", "value").write.format("line_archive").mode("append").option("kind", kind).option("memberBytes", member_bytes).save(path)


def _archived(spark: SparkSession, sf_dir: str, kind: str, members: str) -> DataFrame:
    path = scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    write_archive(docs.select(F.coalesce("lang", F.lit("und")).alias("member"), F.to_json(F.struct("doc_id", "lang", "text")).alias("value")), path, kind, 1 << 20)
    got = read_archive(spark, path, members, 1 << 18)
    return got.select(F.from_json("value", "doc_id long, lang string, text string").alias("r"), "error").select("r.*", "error")


@query("S07_tar_jsonl", "SELECT doc_id, lang, text, NULL AS error FROM documents")
def tar_jsonl(spark, sf_dir):
    """Documents written to tar archives, a member a language and MB, and read back in stretches."""
    return _archived(spark, sf_dir, "tar", "data/*.jsonl")


@query("S08_zip_members", "SELECT doc_id, lang, text, NULL AS error FROM documents WHERE lang = 'en'")
def zip_members(spark, sf_dir):
    """The same in zip archives, of which only the members of one language are opened."""
    return _archived(spark, sf_dir, "zip", "data/en-*.jsonl")
