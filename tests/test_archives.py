import io
import os
import tarfile
import zipfile

import pytest

from statfold.sources.archives import ArchiveReader, read_archives, write_archives


def _rows(df):
    return {(os.path.basename(r["archive"]), r["member"]): (r["bytes"], r["text"], r["rejected"], r["error"]) for r in df.collect()}


def _tar(path, members, mode="w:"):
    with tarfile.open(path, mode) as t:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))


MEMBERS = [("a.txt", b"alpha"), ("empty.txt", b""), ("deep/" + "n" * 150 + ".txt", "größe 語".encode()), ("bad.txt", b"\xff\xfe\x00"),
           ("a.txt", b"again"), ("inner.tar", None)]


@pytest.fixture
def folder(tmp_path):
    inner = io.BytesIO()
    with tarfile.open(fileobj=inner, mode="w:") as t:
        info = tarfile.TarInfo("not a member of the outer archive")
        info.size = 3
        t.addfile(info, io.BytesIO(b"abc"))
    MEMBERS[-1] = ("inner.tar", inner.getvalue())
    _tar(tmp_path / "plain.tar", MEMBERS)
    _tar(tmp_path / "packed.tar.gz", MEMBERS[:3], "w:gz")
    with zipfile.ZipFile(tmp_path / "z.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in MEMBERS[:4]:
            z.writestr(name, data)
    return tmp_path


def test_members_of_all_kinds(spark, folder):
    got = [tuple(r) for r in read_archives(spark, str(folder)).collect()]
    assert len(got) == 6 + 3 + 4
    plain = sorted((r[1], r[3], r[5]) for r in got if r[0].endswith("plain.tar") and r[1] != "inner.tar")
    assert plain == sorted([("a.txt", "alpha", None), ("a.txt", "again", None), ("empty.txt", None, "empty"),
                            ("deep/" + "n" * 150 + ".txt", "größe 語", None), ("bad.txt", None, "not UTF-8")], key=str)
    assert all(r[4] == (r[5] is not None) for r in got)
    zipped = {r[1]: r[3] for r in got if r[0].endswith("z.zip")}
    assert zipped["a.txt"] == "alpha" and zipped["bad.txt"] is None


def test_one_archive_is_read_in_parts(folder):
    parts = ArchiveReader(str(folder / "plain.tar"), 8).partitions()
    assert len(parts) > 3
    names = [m[0] for p in parts for m in p.members]
    assert names == [m[0] for m in MEMBERS]   # each member once, none from the archive inside
    data = [r[3] for p in parts for r in ArchiveReader(str(folder), 8).read(p)]
    assert data == [m[1] for m in MEMBERS]


def test_broken_archives_give_rows(spark, folder):
    whole = (folder / "plain.tar").read_bytes()
    (folder / "plain.tar").write_bytes(whole[:512 + 512 + 512 + 3])       # ends inside a header
    (folder / "cut.tar").write_bytes(whole[:512 + 3])                     # ends inside the first member
    (folder / "zero.tar").write_bytes(b"")
    (folder / "no.zip").write_bytes(b"PK but not really")
    gz = (folder / "packed.tar.gz").read_bytes()
    (folder / "packed.tar.gz").write_bytes(gz[:len(gz) // 2])
    damaged = bytearray((folder / "z.zip").read_bytes())
    damaged[40] ^= 0xFF
    (folder / "z.zip").write_bytes(bytes(damaged))
    got = [tuple(r) for r in read_archives(spark, str(folder)).collect()]
    by = {}
    for r in got:
        by.setdefault(os.path.basename(r[0]), []).append(r)
    assert ("a.txt", "alpha") in [(r[1], r[3]) for r in by["plain.tar"]] and any(r[1] is None and r[4] for r in by["plain.tar"])
    assert any(r[4] and "truncated" in r[5] for r in by["cut.tar"])
    assert [(r[1], r[4]) for r in by["no.zip"]] == [(None, True)] and by["packed.tar.gz"][-1][4] and by["zero.tar"][0][4]
    assert any(r[4] and r[5] not in ("empty", "not UTF-8") for r in by["z.zip"]) and len(by["z.zip"]) == 4


def test_round_trip(spark, tmp_path):
    path = str(tmp_path / "out")
    data = [(f"d/{i}", None if i == 5 else f"text {i} ü" * i) for i in range(300)]
    write_archives(spark.createDataFrame(data, "n string, t string").repartition(4), path, "n", "t")
    files = os.listdir(path)
    assert 1 <= len(files) <= 4 and all(f.startswith("part-") for f in files)
    got = {r["member"]: (r["text"], r["error"]) for r in read_archives(spark, "file://" + path, 1000).collect()}
    assert got == {n: (None, "empty") if not t else (t, None) for n, t in data}
    with pytest.raises(ValueError):
        ArchiveReader("s3://x/y", 1)


def test_empty_folder(spark, tmp_path):
    assert read_archives(spark, str(tmp_path)).count() == 0
