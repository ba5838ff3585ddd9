"""CSV with missing-value tokens (SRC1) and document files as bytes (SRC4)."""

from __future__ import annotations

import fnmatch
import json
import os
import re
import shutil
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

# The strings pandas ``read_csv`` reads as missing by default.
PANDAS_NA = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
             "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
# R ``read.csv`` default ``na.strings``.
R_NA = ["NA"]


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
             na_values: Sequence[str] = PANDAS_NA, infer_numeric: bool = True) -> DataFrame:
    """SRC1: header CSV; NA tokens become null; string columns whose non-null values all
    parse as numbers become double (one aggregate pass decides)."""
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    df = reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", False).csv(path)
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    tokens = list(na_values)
    for c in strings:
        df = df.withColumn(c, F.when(F.col(c).isin(tokens), None).otherwise(F.col(c)))
    if schema is None and infer_numeric and strings:
        bad = df.agg(*[F.sum((F.col(c).isNotNull() & F.col(c).try_cast("double").isNull()).cast("long")).alias(c)
                       for c in strings]).first()
        ints = df.agg(*[F.sum((F.col(c).isNotNull() & F.col(c).try_cast("long").isNull()).cast("long")).alias(c)
                        for c in strings]).first()
        for c in strings:
            nonnull = True
            if bad[c] == 0 and nonnull:
                df = df.withColumn(c, F.col(c).try_cast("bigint" if ints[c] == 0 else "double"))
    return df


FOLDERS = 64   # least number of folders: more than Spark lists on the driver
_NO_KEY = "__HIVE_DEFAULT_PARTITION__"   # as Spark names the folder of a null or empty key
_ESCAPED = re.compile("[\x01-\x1f\x7f\"#%'*/:=?\\\\{\\[\\]^]")


_MAGIC = re.compile(r"[*?{}\[\]\\]")         # of patterns in paths, which Spark's reader resolves
READ_BYTES = 8 << 20                         # of documents handed to Spark at once


def _local(path: str, default: str = "file:///") -> str | None:
    """The plain path of a folder in a file system that is mounted; None for a store that is reached by URL.

    ``default`` is the store of paths without a scheme.
    """
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", path) or not default.startswith("file:"):
        return None
    return os.path.abspath(path)


@dataclass
class Folder(WriterCommitMessage):
    temporary: str | None


class DocumentWriter(DataSourceArrowWriter):
    """A folder a task, a file a row of (key, content); the driver names the folders of successful attempts."""

    def __init__(self, path: str, key: str, overwrite: bool):
        self.path, self.key, self.overwrite = path, key, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Folder:
        own, count = os.path.join(self.path, f"_{uuid.uuid4().hex}"), 0
        try:
            for batch in iterator:
                for key, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                    name = _ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", key) if key else _NO_KEY
                    folder = os.path.join(own, f"{self.key}={name}")
                    os.makedirs(folder, exist_ok=True)
                    with open(os.path.join(folder, f"part-{count:09d}.txt"), "xb") as f:
                        f.write(content.as_buffer() or b"")
                        f.write(b"\n")
                    count += 1
        except BaseException:
            shutil.rmtree(own, ignore_errors=True)
            raise
        return Folder(own if count else None)

    def commit(self, messages: list[Folder | None]) -> None:
        made = [m.temporary for m in messages if m is not None and m.temporary]
        os.makedirs(self.path, exist_ok=True)
        if self.overwrite:
            for name in set(os.listdir(self.path)) - {os.path.basename(x) for x in made}:
                old = os.path.join(self.path, name)
                shutil.rmtree(old) if os.path.isdir(old) else os.remove(old)
        for k, folder in enumerate(made):
            os.replace(folder, os.path.join(self.path, f"folder={k}"))

    def abort(self, messages: list[Folder | None]) -> None:
        for m in messages:
            if m is not None and m.temporary:
                shutil.rmtree(m.temporary, ignore_errors=True)


class Place(InputPartition):
    def __init__(self, path: str | None):
        super().__init__(None)
        self.path = path


def _hidden(name: str) -> bool:
    """Names that Spark's readers pass over."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _files(path: str) -> Iterator[str]:
    if not os.path.isdir(path):
        yield path
        return
    with os.scandir(path) as found:
        entries = sorted((x.name, x.is_dir()) for x in found if not _hidden(x.name))
    for name, folder in entries:
        if folder:
            yield from _files(os.path.join(path, name))
        else:
            yield os.path.join(path, name)


class DocumentReader(DataSourceReader):
    """Each path is listed and read by one task; of fewer than ``FOLDERS`` paths, what lies in them."""

    def __init__(self, paths: list[str], glob: str):
        self.paths, self.glob = paths, glob

    def partitions(self) -> list[Place]:
        paths = self.paths
        while len(paths) < FOLDERS and any(os.path.isdir(p) for p in paths):
            paths = [x for p in paths for x in
                     ([os.path.join(p, n) for n in sorted(os.listdir(p)) if not _hidden(n)] if os.path.isdir(p) else [p])]
        return [Place(p) for p in paths] or [Place(None)]

    def read(self, partition: Place) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, bytes]] = []
        size = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([
                pa.array([f"file:{p}" for p, _ in held], pa.string()), pa.array([len(x) for _, x in held], pa.int64()),
                pa.array([x for _, x in held], pa.binary())], names=["path", "length", "content"])

        for path in _files(partition.path) if partition.path else ():
            if not fnmatch.fnmatchcase(os.path.basename(path), self.glob):
                continue
            with open(path, "rb") as f:
                data = f.read()
            if held and size + len(data) > READ_BYTES:
                yield batch()
                held, size = [], 0
            held.append((path, data))
            size += len(data)
        if held:
            yield batch()


class DocumentSource(DataSource):
    """Document files in mounted folders.

    Written from columns (key string, content binary) under ``path``, option ``key``; read from ``paths`` (JSON) as
    (path, length, content), of files whose names match ``glob``.
    """

    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return "path string, length long, content binary"

    def reader(self, schema) -> DocumentReader:
        return DocumentReader(json.loads(self.options["paths"]), self.options["glob"])

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options["path"], self.options["key"], overwrite)


def _default_store(spark: SparkSession) -> str:
    return spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")


def write_documents(docs: DataFrame, path: str, key: str, text: str) -> list[str]:
    """SRC4: one text file a row, under ``path/folder=N/<key>=value``; returns the folders, for :func:`read_documents`.

    All files of a folder are written by one task, so the driver gives whole folders their final place and not file by
    file, and as the folders are read as so many paths, Spark lists them in tasks. In a mounted folder (one that the
    driver and all executors see under the same path) the tasks write the files themselves: Hadoop's writer starts
    ``chmod`` as a process for each file and for its checksum file. Stores reached by URL get Spark's text writer.
    """
    spark = docs.sparkSession
    n = max(FOLDERS, int(spark.conf.get("spark.sql.shuffle.partitions", "200")), 2 * spark.sparkContext.defaultParallelism)
    mounted = _local(path, _default_store(spark))
    if mounted is not None:
        spark.dataSource.register(DocumentSource)
        rows = docs.select(F.col(key).cast("string").alias("key"), F.col(text).cast("binary").alias("content"))
        (rows.repartition(n, "key", "content").write.format("documents").option("key", key).mode("overwrite").save(mounted))
        return [f"{path}/{x}" for x in sorted(os.listdir(mounted))] or [path]
    rows = docs.select(F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias("folder"), key, text)
    (rows.repartition(n, "folder").write.partitionBy("folder", key).option("maxRecordsPerFile", 1).mode("overwrite").text(path))
    return [f"{path}/folder={r.folder}" for r in rows.select("folder").distinct().collect()] or [path]


def read_documents(spark: SparkSession, path: str | list[str], glob: str = "*") -> DataFrame:
    """SRC4: files as bytes -> UTF-8 text; empty files are kept with ``rejected = true``.

    In mounted folders every path is listed and read by one task (one path alone: what lies in it), so no list of files
    reaches the driver and the number of tasks is not that of the files; Spark's reader, which counts every file as
    4 MB at least, takes what is reached by URL or named by a pattern.
    """
    paths = [path] if isinstance(path, str) else list(path)
    mounted = [_local(p, _default_store(spark)) for p in paths]
    if any(m is None or _MAGIC.search(m) or not os.path.exists(m) for m in mounted) or re.search(r"[{}\\^!]", glob):
        raw = (spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True)
               .load(path))
    else:
        spark.dataSource.register(DocumentSource)
        raw = spark.read.format("documents").option("paths", json.dumps(mounted)).option("glob", glob).load()
    return raw.select("path", F.col("length").alias("bytes"),
                      F.when(F.col("length") > 0, F.decode("content", "UTF-8")).alias("text"),
                      (F.col("length") == 0).alias("rejected"))
