"""Summaries, ROUGE-N and document files on rows of their own: results, and no word or n-gram becomes a row."""

import os

from pyspark.sql import functions as F

from statfold.operators import rouge, text
from statfold.sources import files

DOCS = [(1, "a b a. c! a"), (2, None), (3, " ... "), (None, "x y."), (4, "b a. a a a. c c"), (5, "One two.\nOne."), (5, "two two.")]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_summary_scores_a_document_where_it_is(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").repartition(3)
    s = text.extractive_summary(docs, "doc_id", "text", 4)
    assert "Generate" not in _plan(s) and _plan(s).count("Exchange hashpartitioning") == 1
    got = {r.doc_id: (r.summary, r.summary_words) for r in s.collect()}
    # scores of 1: (3 + 1 + 3) / 3, 1, 3; of 4: (1 + 4) / 2, 4, 2; the rows of 5 share their key's counts and numbers
    assert got == {1: ("a b a. a", 4), 4: ("a a a.", 3), 5: ("One two. two two.", 4)}
    assert text.extractive_summary(docs.where("doc_id = 2"), "doc_id", "text").count() == 0


def test_rouge_n_counts_where_the_pair_is(spark):
    pairs = spark.createDataFrame([(1, "a b a b", "a b c"), (2, None, "x"), (3, "x", ""), (None, "q", "q"), (4, "a", "b"), (4, "b b", "a")],
                                  "id long, c string, r string").repartition(3)
    def rows(n, mode):
        scored = rouge.rouge_n(pairs, "id", "c", "r", n, mode)
        assert "Generate" not in _plan(scored)
        return sorted(((r.id, round(r.precision, 4), round(r.recall, 4)) for r in scored.collect()), key=str)
    # pairs of one key share their overlap, a null key meets nothing
    assert rows(1, "clipped") == [(1, 0.5, 0.6667), (2, 0.0, 0.0), (3, 0.0, 0.0), (4, 1.0, 2.0), (4, 2.0, 2.0), (None, 0.0, 0.0)]
    assert rows(2, "clipped") == [(1, 0.3333, 0.5), (2, 0.0, 0.0), (3, 0.0, 0.0), (4, 0.0, 0.0), (4, 0.0, 0.0), (None, 0.0, 0.0)]
    assert rows(1, "unique") == [(1, 1.0, 0.6667), (2, 0.0, 0.0), (3, 0.0, 0.0), (4, 2.0, 2.0), (4, 2.0, 2.0), (None, 0.0, 0.0)]


def test_document_files_of_a_folder_are_written_by_one_task(spark, tmp_path):
    docs = spark.range(300).select((F.col("id") % 280).alias("page_id"), F.concat(F.lit("t"), "id").alias("html")).repartition(4)
    folders = files.write_documents(docs, str(tmp_path / "docs"), "page_id", "html")
    assert len(folders) > 32   # more paths than Spark lists on the driver
    back = files.read_documents(spark, folders, "*.txt")
    got = sorted((int(r.path.split("page_id=")[1].split("/")[0]), r.text) for r in back.collect())
    assert got == sorted((i % 280, f"t{i}\n") for i in range(300))   # a file a row, also for repeated keys
    none = files.write_documents(docs.limit(0), str(tmp_path / "none"), "page_id", "html")
    assert files.read_documents(spark, none, "*.txt").count() == 0


def test_document_files_are_written_without_a_process_a_file(spark, tmp_path):
    """Hadoop's local writer, which starts ``chmod`` for each file, leaves a checksum file beside each."""
    rows = [("a", "x"), ("a", "x"), ("a", None), (None, "n"), ("", "e"), ("b:/%c d", "größe\nzwei"), ("z", "")]
    docs = spark.createDataFrame(rows, "k string, t string").repartition(3)
    path = tmp_path / "docs"
    (path / "folder=999").mkdir(parents=True)
    (path / "folder=999" / "old.txt").write_text("goes")
    folders = files.write_documents(docs, f"file://{path}", "k", "t")
    names = [f for _, _, found in os.walk(path) for f in found]
    assert len(names) == len(rows) and all(f.endswith(".txt") for f in names)
    none = "__HIVE_DEFAULT_PARTITION__"
    named = {"a": "a", None: none, "": none, "b:/%c d": "b%3A%2F%25c d", "z": "z"}
    got = [(r.path.split("/k=")[1].split("/")[0], r.text, r.bytes, r.rejected) for r in files.read_documents(spark, folders, "*.txt").collect()]
    want = [(named[k], (t or "") + "\n", len((t or "").encode()) + 1, False) for k, t in rows]
    assert sorted(got) == sorted(want)
    # as Spark's own writer names the folders
    docs.write.partitionBy("k").text(str(tmp_path / "spark"))
    assert {f[2:] for f in os.listdir(tmp_path / "spark") if f.startswith("k=")} == set(named.values())


def test_paths_of_mounted_folders_and_of_stores():
    assert files._local("file:/a/b") == files._local("file:///a/b") == files._local("/a/b") == "/a/b"
    assert files._local("hdfs://host/a") is None and files._local("s3a://b/a") is None
    assert files._local("/a/b", "hdfs://host") is None and files._local("file:/a/b", "hdfs://host") == "/a/b"


def test_document_files_are_read_by_as_many_tasks_as_folders(spark, tmp_path):
    docs = spark.range(2000).select(F.col("id").alias("page_id"), F.col("id").cast("string").alias("html"))
    folders = files.write_documents(docs, f"file:{tmp_path}/docs", "page_id", "html")
    back = files.read_documents(spark, folders, "*.txt")
    assert back.count() == 2000 and back.rdd.getNumPartitions() == len(folders) <= 128   # not a task for 32 files


def test_document_files_are_those_of_the_binary_reader(spark, tmp_path):
    tree = {"a.txt": b"one", "empty.txt": b"", "b.md": b"two", "_hidden.txt": b"no", ".dot.txt": b"no", "deep/k=1/c.txt": "größe".encode(),
            "_x=1/d.txt": b"yes", "_no/e.txt": b"no", "deep/bad.txt": b"a\xffb", "deep/sp ace%41.txt": b"s"}
    for name, data in tree.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    whole, parts = str(tmp_path), [f"file:{tmp_path}/deep", f"{tmp_path}/a.txt", f"file://{tmp_path}/_x=1"]
    for path in (whole, parts):
        for glob in ("*", "*.txt", "?.txt", "[a-c].*", "{a,b}.*"):
            raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
            want = sorted((r.path, r.length) for r in raw.select("path", "length").collect())
            got = sorted((r.path, r.bytes) for r in files.read_documents(spark, path, glob).select("path", "bytes").collect())
            assert want and [x for x in got if x[1]] == want   # Spark's reader leaves empty files out
            assert [x for x in got if not x[1]] == [(f"file:{tmp_path}/empty.txt", 0)] * (path == whole and glob in ("*", "*.txt"))
    text = {os.path.basename(r.path): (r.text, r.rejected) for r in files.read_documents(spark, whole, "[ace]*.txt").collect()}
    assert text == {"a.txt": ("one", False), "c.txt": ("größe", False), "empty.txt": (None, True)}
