"""Documents in tar and zip archives (SRC4) as a Spark data source.

Many small documents in few files: an archive is planned by its index (the headers of a tar are read by seeking from
one to the next, a zip has its directory at the end), and its members are dealt to partitions of about
``PART_BYTES`` bytes, so one large archive is read by many tasks and each member by exactly one. Only uncompressed
tars can be read from the middle; ``.tar.gz`` and the like are one partition each, read as a stream.

A member that cannot be read is a row with ``error`` and no content, and a broken archive gives what stands before
the break and one such row; neither stops the job. Archives must lie in a folder that the driver and all executors
see under the same path.

Writing puts the rows of each task in one tar under a temporary name; the driver gives the finished ones of
successful attempts their final names, so a repeated or lost task leaves no half archive.
"""

from __future__ import annotations

import io
import os
import tarfile
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

PART_BYTES = 64 << 20
READ_SCHEMA = "archive string, member string, bytes long, content binary, error string"
_ENDINGS = (".tar", ".zip", ".tar.gz", ".tgz", ".tar.bz2", ".tar.xz")


def _local(path: str) -> str:
    if path.startswith("file:"):
        path = path[5:]
        return "/" + path.lstrip("/")
    if "://" in path:
        raise ValueError(f"{path}: archives are read from folders that all machines see, not by URL")
    return path


def _archives(path: str) -> list[str]:
    if not os.path.isdir(path):
        return [path]
    found = [os.path.join(folder, n) for folder, _, names in os.walk(path) for n in names
             if n.endswith(_ENDINGS) and not n.startswith(("_", "."))]
    return sorted(found)


class Members(InputPartition):
    """Members of one archive: (name, offset, size), or the whole archive as a stream, or a reason."""

    def __init__(self, archive: str, kind: str, members: list[tuple[str, int, int]], error: str | None = None):
        super().__init__(None)
        self.archive, self.kind, self.members, self.error = archive, kind, members, error


def _index(archive: str) -> tuple[str, list[tuple[str, int, int]], str | None]:
    """(kind, members in order of their places, what broke off the index)."""
    if archive.endswith(".zip"):
        with zipfile.ZipFile(archive) as z:
            return "zip", [(i.filename, i.header_offset, i.file_size) for i in
                           sorted(z.infolist(), key=lambda i: i.header_offset) if not i.is_dir()], None
    if not archive.endswith(".tar"):
        return "stream", [], None
    found: list[tuple[str, int, int]] = []
    size = os.path.getsize(archive)
    with tarfile.open(archive, "r:") as t:
        try:
            for m in t:
                if m.isfile():
                    found.append((m.name, m.offset_data, m.size))
        except (tarfile.TarError, EOFError, ValueError) as e:
            return "tar", found, f"{type(e).__name__}: {e}"
        # a header that does not parse ends the walk like the end of the archive does
        with open(archive, "rb") as f:
            f.seek(min(t.offset, size))
            if f.read(512).strip(b"\0"):
                return "tar", found, f"no member header at {t.offset}"
    return "tar", found, None


def _parts(archive: str, limit: int) -> list[Members]:
    try:
        kind, members, broken = _index(archive)
    except (OSError, tarfile.TarError, zipfile.BadZipFile, EOFError) as e:
        return [Members(archive, "error", [], f"{type(e).__name__}: {e}")]
    out = [Members(archive, kind, [])] if kind == "stream" else []
    held: list[tuple[str, int, int]] = []
    size = 0
    for m in members:
        if held and size + m[2] > limit:
            out.append(Members(archive, kind, held))
            held, size = [], 0
        held.append(m)
        size += m[2]
    if held:
        out.append(Members(archive, kind, held))
    if broken:
        out.append(Members(archive, "error", [], broken))
    return out


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, limit: int):
        self.path, self.limit = _local(path), limit

    def partitions(self) -> list[Members]:
        return [p for a in _archives(self.path) for p in _parts(a, self.limit)] or [Members("", "none", [])]

    def read(self, partition: Members) -> Iterator[tuple]:
        p = partition
        if p.kind == "error":
            yield p.archive, None, None, None, p.error
        elif p.kind == "stream":
            yield from _streamed(p.archive)
        elif p.kind == "tar":
            with open(p.archive, "rb") as f:
                for name, offset, size in p.members:
                    f.seek(offset)
                    data = f.read(size)
                    if len(data) < size:
                        yield p.archive, name, size, None, f"truncated: {len(data)} of {size} bytes"
                    else:
                        yield p.archive, name, size, data, None
        elif p.kind == "zip":
            with zipfile.ZipFile(p.archive) as z:
                places = {i.header_offset: i for i in z.infolist()}
                for name, offset, size in p.members:
                    try:
                        yield p.archive, name, size, z.read(places[offset]), None
                    except Exception as e:  # noqa: BLE001 - whatever a damaged member raises is its reason
                        yield p.archive, name, size, None, f"{type(e).__name__}: {e}"


def _streamed(archive: str) -> Iterator[tuple]:
    try:
        with tarfile.open(archive, "r|*") as t:
            for m in t:
                if m.isfile():
                    yield archive, m.name, m.size, t.extractfile(m).read(), None
    except Exception as e:  # noqa: BLE001 - a damaged stream ends here, with its reason
        yield archive, None, None, None, f"{type(e).__name__}: {e}"


@dataclass
class Written(WriterCommitMessage):
    temporary: str | None
    final: str | None


class ArchiveWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path = _local(path)
        if overwrite and os.path.isdir(self.path) and os.listdir(self.path):
            raise ValueError(f"{path} is not empty; archives are only added to a folder")

    def write(self, iterator: Iterator) -> Written:
        os.makedirs(self.path, exist_ok=True)
        name = f"part-{uuid.uuid4().hex}.tar"
        temporary, count = os.path.join(self.path, f"_{name}"), 0
        with tarfile.open(temporary, "w:", format=tarfile.PAX_FORMAT) as t:
            for row in iterator:
                data = bytes(row[1]) if row[1] is not None else b""
                info = tarfile.TarInfo(row[0])
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))
                count += 1
        if not count:
            os.remove(temporary)
            return Written(None, None)
        return Written(temporary, os.path.join(self.path, name))

    def commit(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m is not None and m.temporary:
                os.replace(m.temporary, m.final)

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m is not None and m.temporary and os.path.exists(m.temporary):
                os.remove(m.temporary)


class ArchiveSource(DataSource):
    """``spark.read.format("archive").load(folder or file)``; option ``partBytes``."""

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], int(self.options.get("partBytes", PART_BYTES)))

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"], overwrite)


def write_archives(docs: DataFrame, path: str, name_col: str, content_col: str) -> None:
    """Write one member a row (text as UTF-8, or bytes; null is an empty member) into tar archives under ``path``."""
    docs.sparkSession.dataSource.register(ArchiveSource)
    content = F.col(content_col)
    if docs.schema[content_col].dataType.simpleString() != "binary":
        content = F.encode(content, "UTF-8")
    rows = docs.select(F.col(name_col).cast("string").alias("member"), content.alias("content"))
    rows.write.format("archive").mode("append").save(path)


def read_archives(spark: SparkSession, path: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """SRC4: (archive, member, bytes, text, rejected, error) of all members of the archives under ``path``.

    ``text`` is the member as UTF-8. Empty members are rejected, as are those that are not UTF-8, truncated or
    damaged; ``error`` says why (``empty``, ``not UTF-8``, or what the reader met).
    """
    spark.dataSource.register(ArchiveSource)
    raw = spark.read.format("archive").option("partBytes", part_bytes).load(path)
    text = F.col("content").cast("string")
    reason = F.coalesce("error", F.when(F.col("bytes") == 0, F.lit("empty")),
                        F.when(~F.is_valid_utf8(text), F.lit("not UTF-8")))
    told = raw.withColumn("error", reason)
    return told.select("archive", "member", "bytes", F.when(F.col("error").isNull(), text).alias("text"),
                       F.col("error").isNotNull().alias("rejected"), "error")
