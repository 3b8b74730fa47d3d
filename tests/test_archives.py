"""Archives: members by name, stretches of large members, bad members as rows, atomic writes."""

import io
import tarfile
import zipfile

import pytest
from loomspark.sources import archive


def tar(path, members, mode="w"):
    with tarfile.open(path, mode) as t:
        for name, body in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(body)
            t.addfile(info, io.BytesIO(body))


def rows(spark, path, **options):
    return [(r.member, r.at, r.value) for r in archive.read_archive(spark, str(path), **options).orderBy("member", "at").collect()]


def test_archives_in_member_order(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("b.jsonl", "3\n4\n")
        z.writestr("a.jsonl", "1\n\n2\n")
        z.writestr("skip.txt", "9\n")
    tar(tmp_path / "b.tar", {"c.jsonl": b"5\n", "d.jsonl": b""})
    tar(tmp_path / "c.tar.gz", {"e.jsonl": b"6\nlast"}, "w:gz")
    got = archive.read_archive(spark, str(tmp_path), members="*.jsonl").orderBy("member", "at").collect()
    assert [(r.value, r.error) for r in got] == [(x, None) for x in ("1", "2", "3", "4", "5", "6", "last")]
    assert [r.at for r in got] == [0, 3, 0, 2, 0, 0, 2]


@pytest.mark.parametrize("split", [1, 2, 3, 7, 1000])
def test_stretches_hold_each_line_once(spark, tmp_path, split):
    body = "a\nbb\n\nÉccc\r\nd\x0be\n".encode() + b"last without end"
    tar(tmp_path / "x.tar", {"m": body, "n": b"\n\nz"})
    want, at = [], 0
    for line in body.split(b"\n"):
        want += [("m", at, line.decode())] if line.strip() else []
        at += len(line) + 1
    assert rows(spark, tmp_path / "x.tar", split_bytes=split) == [*want, ("n", 2, "z")]


def test_bad_members_are_told(spark, tmp_path):
    tar(tmp_path / "a.tar", {"good": b"1\n", "odd": b"2\n\xff\xfe\n3\n"})
    tar(tmp_path / "cut.tar", {"whole": b"4\n", "torn": b"x" * 5000})
    torn = (tmp_path / "cut.tar").read_bytes()[:3000]
    (tmp_path / "cut.tar").write_bytes(torn)
    (tmp_path / "none.zip").write_bytes(b"no archive")
    with zipfile.ZipFile(tmp_path / "z.zip", "w", zipfile.ZIP_STORED) as z:
        z.writestr("bad", "abcdefgh\n")
        z.writestr("fine", "5\n")
    broken = (tmp_path / "z.zip").read_bytes().replace(b"abcdefgh", b"abcdefgX")
    (tmp_path / "z.zip").write_bytes(broken)
    got = archive.read_archive(spark, str(tmp_path)).collect()
    assert {r.value for r in got if r.error is None} >= {"1", "2", "3", "5"}
    assert {r.member for r in got if r.error} >= {"odd", "bad"}
    assert any(r.archive.endswith("none.zip") and r.error for r in got) and any(r.archive.endswith("cut.tar") and r.error for r in got)


def test_written_and_read(spark, tmp_path):
    data = [(f"m{i % 3}", f"line {i} é") for i in range(200)]
    df = spark.createDataFrame(data, "member string, value string").repartition(4)
    for kind in ("tar", "zip"):
        archive.write_archive(df, str(tmp_path / kind), kind, member_bytes=300)
        assert sorted(r[2] for r in rows(spark, tmp_path / kind)) == sorted(v for _, v in data)
        assert {r[0].split("-")[0] for r in rows(spark, tmp_path / kind, members="data/m1-*")} == {"data/m1"}


def test_a_failed_write_leaves_no_archive(spark, tmp_path):
    df = spark.range(100).repartition(4).selectExpr("'m' AS member", "CASE WHEN id = 57 THEN raise_error('stop') ELSE 'x' END AS value")
    with pytest.raises(Exception, match="stop"):
        archive.write_archive(df, str(tmp_path / "out"))
    (tmp_path / "out").mkdir(exist_ok=True)
    assert archive.listed(str(tmp_path / "out")) == []


def test_no_such_path(spark, tmp_path):
    with pytest.raises(Exception, match="FileNotFound"):
        archive.read_archive(spark, str(tmp_path / "nothing")).collect()


def test_tasks_without_rows_and_empty_zips(spark, tmp_path):
    df = spark.range(8).repartition(8).where("id = 3").selectExpr("'m' AS member", "'x' AS value")
    archive.write_archive(df, str(tmp_path / "out"), "zip")
    assert len(archive.listed(str(tmp_path / "out"))) == 1
    with zipfile.ZipFile(tmp_path / "out" / "empty.zip", "w"):
        pass
    got = archive.read_archive(spark, str(tmp_path / "out")).collect()
    assert [(r.value, r.error) for r in got] == [("x", None)]
    archive.write_archive(df.where("value = 'y'"), str(tmp_path / "none"), "zip")
    assert archive.read_archive(spark, str(tmp_path / "none")).count() == 0
