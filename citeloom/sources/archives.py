"""Zip archives as a source and a sink of Spark: ``spark.read.format("zip_members")`` after ``register``.

An archive's directory, which stands at its end, says where its members are. So an archive is read by as many tasks as
the bytes of its members ask for. A task reads its own slice of the directory and seeks its own members only; the planner
steps over the entries of large archives, and of small ones reads the last bytes. The sink begins another archive where one
is as large as a task. Paths are those of the file systems that pyarrow knows, local or shared ones, without a scheme or with it.
"""

from __future__ import annotations

import io
import struct
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "path string, content binary"
#: Bytes of members that a task reads, and members that it lists, by default.
TASK_BYTES, TASK_MEMBERS = 64 << 20, 1_000
#: Larger members fail loudly instead of filling memory.
MAX_BYTES = 1 << 30


def _files(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), path)


def _opened(fs: pafs.FileSystem, path: str):
    """The archive as a file that can seek; an archive of hardly any bytes whole, as the end of a directory is looked for before its start."""
    f = fs.open_input_file(path)
    return f if f.size() > 64 else io.BytesIO(f.read())


@dataclass
class _Run(InputPartition):
    """Members of an archive: where their entries begin in the file, the entries' bytes and number, and the bytes before the archive proper."""

    archive: str
    start: int
    size: int
    members: int
    before: int


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]


def _directory(f) -> tuple[int, int, int, int]:
    """Where the directory of an archive begins, its bytes, its entries, and the bytes before the archive proper."""
    whole = f.seek(0, 2)
    begin = max(0, whole - 22 - 0xFFFF)
    f.seek(begin)
    tail = f.read(whole - begin)
    at = tail.rfind(b"PK\5\6")
    if at < 0 or len(tail) < at + 22:
        raise zipfile.BadZipFile("File is not a zip file")
    members, size, offset = struct.unpack_from("<H2L", tail, at + 10)
    end = begin + at
    if at >= 20 and tail[at - 20 : at - 16] == b"PK\6\7":  # the end of large archives; its record stands right before its locator
        f.seek(end - 76)
        record = f.read(56)
        if record[:4] == b"PK\6\6":
            members, size, offset = struct.unpack_from("<3Q", record, 32)
            end -= 76
    if size > end or offset + size > end:
        raise zipfile.BadZipFile("Bad offset for central directory")
    return end - size, size, members, end - size - offset


class _Part(io.RawIOBase):
    """The next bytes of a file, for a buffer in front of it."""

    def __init__(self, f, size: int):
        self.f, self.left = f, size

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        data = self.f.read(min(len(into), self.left))
        into[: len(data)] = data
        self.left -= len(data)
        return len(data)


class _Slice(io.RawIOBase):
    """An archive with a slice of its directory in place of the whole: ``zipfile`` reads the bytes before it from the file."""

    def __init__(self, f, run: _Run):
        f.seek(run.start)
        entries, offset = f.read(run.size), run.start - run.before
        end = struct.pack("<4sQ2H2L4Q", b"PK\6\6", 44, 45, 45, 0, 0, run.members, run.members, run.size, offset)
        end += struct.pack("<4sLQL", b"PK\6\7", 0, offset + run.size, 1) + struct.pack("<4s4H2LH", b"PK\5\6", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
        self.f, self.start, self.tail, self.at = f, run.start, entries + end, 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = 0) -> int:
        self.at = max(0, offset + (0, self.at, self.start + len(self.tail))[whence])
        return self.at

    def read(self, n: int = -1) -> bytes:
        stop = self.start + len(self.tail)
        stop = stop if n is None or n < 0 else min(stop, self.at + n)
        out = b""
        if self.at < min(stop, self.start):
            self.f.seek(self.at)
            out = self.f.read(min(stop, self.start) - self.at)
        if stop > self.start:
            out += self.tail[max(self.at - self.start, 0) : stop - self.start]
        self.at += len(out)
        return out


class _Members:
    """What both readers share: archives below a path, runs of their members, and the members of a run."""

    def __init__(self, options: dict):
        self.path, self.suffix = options["path"].rstrip("/"), options.get("suffix", "")
        self.task_bytes, self.max_bytes = int(options.get("taskBytes", TASK_BYTES)), int(options.get("maxBytes", MAX_BYTES))

    def archives(self) -> list[pafs.FileInfo]:
        """The archives by the time of their last change, then by path."""
        fs, path = _files(self.path)
        if fs.get_file_info(path).type == pafs.FileType.File:
            return [fs.get_file_info(path)]
        found = fs.get_file_info(pafs.FileSelector(path, recursive=True))
        kept = [f for f in found if f.is_file and f.base_name.endswith(".zip") and "/_" not in f.path[len(path) :]]
        return sorted(kept, key=lambda f: (f.mtime_ns or 0, f.path))

    def runs(self, archives: list[pafs.FileInfo]) -> list[_Run]:
        fs = _files(self.path)[0]
        return [run for archive in archives for run in self._runs_of(fs, archive.path)]

    def _runs_of(self, fs: pafs.FileSystem, archive: str) -> Iterator[_Run]:
        """Steps over the entries of an archive that is larger than a task, and keeps none of them."""
        with _opened(fs, archive) as f:
            start, size, members, before = _directory(f)
            if members and members <= TASK_MEMBERS and start - before <= self.task_bytes:
                yield _Run(archive, start, size, members, before)
            elif members:
                f.seek(start)
                entries = io.BufferedReader(_Part(f, size), 1 << 20)
                first = at = start
                count = held = 0
                for _ in range(members):
                    entry = entries.read(46)
                    if entry[:4] != b"PK\1\2":
                        raise zipfile.BadZipFile("Bad magic number for central directory")
                    stored, _, name, extra, comment = struct.unpack_from("<2L3H", entry, 20)
                    if count and (held + stored > self.task_bytes or count >= TASK_MEMBERS):
                        yield _Run(archive, first, at - first, count, before)
                        first, count, held = at, 0, 0
                    entries.read(name + extra + comment)
                    at += 46 + name + extra + comment
                    count, held = count + 1, held + stored
                yield _Run(archive, first, at - first, count, before)

    def members(self, run: _Run) -> Iterator[tuple[str, bytes]]:
        with _opened(_files(self.path)[0], run.archive) as f, zipfile.ZipFile(_Slice(f, run)) as z:
            for m in z.infolist():
                if m.is_dir() or not m.filename.endswith(self.suffix):
                    continue
                if m.file_size > self.max_bytes:
                    raise ValueError(f"{run.archive}!{m.filename} has {m.file_size} bytes")
                yield f"{run.archive}!{m.filename}", z.read(m)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.held = _Members(options)

    def partitions(self) -> list[_Run]:
        return self.held.runs(self.held.archives()) or [_Run("", 0, 0, 0, 0)]

    def read(self, partition: _Run) -> Iterator[tuple[str, bytes]]:
        return self.held.members(partition) if partition.archive else iter(())


class _StreamReader(DataSourceStreamReader):
    """Archives in the order of their last change; an offset is the time and the path of the last one that was read.

    An archive that is put in place later must not have an earlier time than one that was read, as when it is written or
    renamed by this sink.
    """

    def __init__(self, options: dict):
        self.held = _Members(options)

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        found = self.held.archives()
        return {"time": found[-1].mtime_ns, "path": found[-1].path} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[_Run]:
        after, until = (start["time"], start["path"]), (end["time"], end["path"])
        return self.held.runs([f for f in self.held.archives() if after < (f.mtime_ns, f.path) <= until])

    def read(self, partition: _Run) -> Iterator[tuple[str, bytes]]:
        return self.held.members(partition)


class _Writer(DataSourceWriter):
    """Archives of a task's size, one a task at least that has rows, below ``_temporary`` until all tasks are done; what failed tasks left there goes at the end."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.run = options["path"].rstrip("/"), overwrite, uuid.uuid4().hex
        self.task_bytes = int(options.get("taskBytes", TASK_BYTES))

    def write(self, rows) -> _Written:
        fs, path = _files(self.path)
        names, z, out, count = [], None, None, 0
        fs.create_dir(f"{path}/_temporary/{self.run}", recursive=True)
        for row in rows:
            if z is not None and (count >= TASK_MEMBERS or out.tell() >= self.task_bytes):
                z.close()
                out.close()
                z = None
            if z is None:
                names.append(f"part-{uuid.uuid4().hex}.zip")
                out, count = fs.open_output_stream(f"{path}/_temporary/{self.run}/{names[-1]}"), 0
                z = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
            z.writestr(zipfile.ZipInfo(row["path"]), bytes(row["content"]), zipfile.ZIP_DEFLATED)
            count += 1
        if z is not None:
            z.close()
            out.close()
        return _Written(names)

    def commit(self, messages: list) -> None:
        fs, path = _files(self.path)
        fs.create_dir(path, recursive=True)
        if self.overwrite:
            for f in _Members({"path": self.path}).archives():
                fs.delete_file(f.path)
        for name in (name for m in messages if m is not None for name in m.names):
            fs.move(f"{path}/_temporary/{self.run}/{name}", f"{path}/{name}")
        self.abort(messages)

    def abort(self, messages: list) -> None:
        fs, path = _files(self.path)
        if fs.get_file_info(f"{path}/_temporary/{self.run}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{path}/_temporary/{self.run}")


class ZipMembers(DataSource):
    """Options: ``path``, ``suffix`` of members, ``taskBytes``, ``maxBytes`` of a member. Members are written as ``(path, content)``."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self._own())

    def streamReader(self, schema) -> _StreamReader:
        return _StreamReader(self._own())

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self._own(), overwrite)

    def _own(self) -> dict:
        given = {k.lower(): v for k, v in self.options.items()}
        return {name: given[name.lower()] for name in ("path", "suffix", "taskBytes", "maxBytes") if name.lower() in given}


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ZipMembers)


def read_zip(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """``(path, content)`` of the members of all archives below ``path``; a member's path is ``archive!member``."""
    register(spark)
    return spark.read.format("zip_members").option("suffix", suffix).load(path)


def write_zip(members: DataFrame, path: str) -> None:
    """Archives below ``path``, of a task's size and one at least for every partition that has rows, in place of those that are there."""
    register(members.sparkSession)
    members.select("path", "content").write.format("zip_members").mode("overwrite").save(path)
