"""Archives read by range and streamed, ZIP archives written, tables with proved row groups."""

import hashlib
import io
import random
import tarfile
import zipfile

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quernstone.sources import archives, readers, sinks


def zipped(path, files, links=()):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo("folder/"), b"")
        for name, data in files:
            info = zipfile.ZipInfo(name)
            if name in links:
                info.external_attr = 0o120777 << 16
            z.writestr(info, data)
    return str(path)


@pytest.fixture
def files():
    r = random.Random(5)
    return [(f"d/{k:03d}.bin", r.randbytes(r.choice((0, 1, 9000)))) for k in range(40)]


def test_members_by_range_equal_the_whole_read(spark, tmp_path, files):
    zipped(tmp_path / "a.zip", files)
    with tarfile.open(tmp_path / "b.tar.gz", "w:gz") as t:
        for name, data in files:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    zipped(tmp_path / "none.zip", [])
    plain = {(name, len(data), hashlib.sha256(data).hexdigest(), data if name.endswith("7.bin") else None) for name, data in files}
    for path, tasks in ((tmp_path / "a.zip", 5), (f"file://{tmp_path}/b.tar.gz", 1), (f"file:{tmp_path}/a.*", 5)):
        rows = archives.members(spark, str(path), r"7\.bin$", split=20_000)
        assert rows.rdd.getNumPartitions() >= tasks
        got = rows.collect()
        assert {(r.member, r.size, r.sha256, r.payload and bytes(r.payload) if r.payload is not None else None) for r in got} == plain and len(got) == len(files)
    assert archives.members(spark, str(tmp_path / "none.zip")).collect() == []
    (tmp_path / "empty").mkdir()
    assert archives.members(spark, str(tmp_path / "empty")).collect() == []
    both = archives.members(spark, str(tmp_path)).groupBy("archive").count().collect()
    assert sorted(r["count"] for r in both) == [40, 40]
    old = readers.archive_members(spark, str(tmp_path / "a.zip")).select("member", "size", "sha256")
    assert old.exceptAll(archives.members(spark, str(tmp_path / "a.zip"), split=1).select("member", "size", "sha256")).count() == 0


def test_runs_cover_an_archive_once(tmp_path, files):
    path = zipped(tmp_path / "a.zip", files)
    parts = archives.runs(path, 10**9, 30_000)
    assert [p.first for p in parts][1:] == [p.last for p in parts][:-1] and parts[0].first == 0 and parts[-1].last == len(files) and len(parts) > 3
    with pytest.raises(FileNotFoundError):
        archives.archive_files(str(tmp_path / "gone"))


@pytest.mark.parametrize("name", ["../x", "/x", "a/../../x"])
def test_unsafe_members_fail(spark, tmp_path, files, name):
    for split in (1, 10**9):
        with pytest.raises(Exception, match="unsafe"):
            archives.members(spark, zipped(tmp_path / "u.zip", [*files, (name, b"1")]), split=split).collect()


def test_links_repeated_names_and_other_files_fail(spark, tmp_path):
    with pytest.raises(Exception, match="link"):
        archives.members(spark, zipped(tmp_path / "l.zip", [("a", b"b")], links=("a",))).collect()
    with pytest.warns(UserWarning), pytest.raises(Exception, match="repeated"):
        archives.members(spark, zipped(tmp_path / "r.zip", [("a", b"1"), ("a", b"2")])).collect()
    with tarfile.open(tmp_path / "s.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("s")
        info.type, info.linkname = tarfile.SYMTYPE, "/etc/x"
        t.addfile(info)
    with pytest.raises(Exception, match="link"):
        archives.members(spark, str(tmp_path / "s.tar.gz")).collect()
    (tmp_path / "text.zip").write_text("no archive")
    with pytest.raises(Exception):
        archives.members(spark, str(tmp_path / "text.zip")).collect()


def test_lines_and_tables_of_members(spark, tmp_path):
    long = "x" * 3_000_000
    path = zipped(tmp_path / "t.zip", [("t.tsv", f"a\tb\r\n1\tü\r\n\n2\t{long}"), ("u.tsv", "a\tb\n"), ("none.tsv", ""), ("s.txt", "z")])
    lines = archives.member_lines(spark, path, r"\.tsv$").where("member = 't.tsv'").orderBy("ordinal").collect()
    assert [r.line for r in lines] == ["a\tb", "1\tü", "", f"2\t{long}"] and [r.ordinal for r in lines] == [0, 1, 2, 3]
    rows = archives.member_table(spark, path, r"[tu]\.tsv$", ["a", "b"]).orderBy("ordinal").collect()
    assert [(r.member, r.ordinal, r.a, r.b) for r in rows] == [("t.tsv", 1, "1", "ü"), ("t.tsv", 3, "2", long)]
    assert archives.member_table(spark, path, r"none", ["a", "b"]).count() == 0
    with pytest.raises(Exception, match="another header"):
        archives.member_table(spark, path, r"u\.tsv$", ["a", "c"]).select("member").collect()
    with pytest.raises(Exception, match="another width"):
        archives.member_table(spark, zipped(tmp_path / "w.zip", [("w.tsv", "a\tb\n1\n")]), "w", ["a", "b"]).select("a").collect()


def test_interactions_of_divided_archives(spark, tmp_path):
    one = lambda k: f'<entrySet><entry><interactionList><interaction id="{k}"><participantList><participant id="p{k}"><interactorRef>1</interactorRef></participant></participantList></interaction></interactionList></entry></entrySet>'
    path = zipped(tmp_path / "x.zip", [(f"d/{k}.xml", one(k)) for k in range(9)] + [("readme.txt", "no")])
    rows = archives.interactions(spark, path, split=200)
    assert rows.schema == readers.interaction_records(spark, path).schema and rows.rdd.getNumPartitions() > 2
    assert sorted(r.interaction_id for r in rows.collect()) == [str(k) for k in range(9)]
    assert rows.exceptAll(readers.interaction_records(spark, path)).count() == 0


def test_zip_archives_round_trip(spark, tmp_path):
    df = spark.range(300).select((F.col("id") % 3).alias("archive"), F.format_string("m/%04d", "id").alias("member"), F.encode(F.repeat(F.col("id").cast("string"), 50), "UTF-8").alias("payload"))
    for folder in ("one", "two"):
        sinks.zip_archives(df.repartition(7 if folder == "one" else 2), f"file://{tmp_path}/{folder}")
    assert sorted(p.name for p in (tmp_path / "one").iterdir() if not p.name.startswith(".")) == ["0.zip", "1.zip", "2.zip"]
    assert all((tmp_path / "one" / f"{k}.zip").read_bytes() == (tmp_path / "two" / f"{k}.zip").read_bytes() for k in range(3))
    got = archives.members(spark, str(tmp_path / "one"), ".").select(F.regexp_extract("archive", r"(\d+)\.zip$", 1).cast("long").alias("archive"), "member", "payload")
    assert got.count() == 300 and got.exceptAll(df).count() == 0
    with pytest.raises(Exception, match="repeated"):
        sinks.zip_archives(df.union(df), str(tmp_path / "twice"))


def test_row_groups_and_order_are_proved(spark, tmp_path):
    df = spark.range(5000).select(F.when(F.col("id") % 50 > 0, F.sha2(F.col("id").cast("string"), 256)).alias("k"), "id").repartition(5)
    total = sinks.publish_ordered(df, str(tmp_path / "t"), ["k", "id"], rows_per_group=300, rows_per_part=900)
    names = sorted(p.name for p in (tmp_path / "t").iterdir() if p.suffix == ".parquet")
    assert names == [f"part-{k:05d}.parquet" for k in range(len(names))] and total["parts"] == len(names) and total["rows"] == 5000
    tables = [pq.ParquetFile(tmp_path / "t" / n) for n in names]
    assert all(t.metadata.row_group(g).num_rows <= 300 for t in tables for g in range(t.metadata.num_row_groups)) and total["groups"] == sum(t.metadata.num_row_groups for t in tables)
    read = [(r["k"], r["id"]) for t in tables for r in t.read().to_pylist()]
    assert read == sorted(read, key=lambda r: (r[0] is not None, r[0] or "", r[1])) and len(read) == 5000
    assert sinks.publish_ordered(df.limit(0), str(tmp_path / "none"), ["k"], 300)["rows"] == 0
    with pytest.raises(FileExistsError):
        sinks.publish_ordered(df, str(tmp_path / "t"), ["k"], 300)
    with pytest.raises(ValueError, match="float"):
        sinks.publish_ordered(df.select(F.rand(1).alias("x")), str(tmp_path / "x"), ["x"], 300)


def test_footer_faults(spark, tmp_path):
    put = lambda name, values, **o: pq.write_table(__import__("pyarrow").table({"k": values}), tmp_path / "t" / name, **o)
    (tmp_path / "t").mkdir()
    put("part-00000.parquet", [None, 1, 2, 3], row_group_size=2)
    put("part-00001.parquet", [3, 4, 2, None], row_group_size=2)
    put("part-00003.parquet", [1, 2, 3], row_group_size=9)
    faults = {tuple(r) for r in sinks.footer_faults(sinks.footers(spark, str(tmp_path / "t"), "k"), 2).collect()}
    assert faults == {(1, 1, "order"), (3, 0, "rows"), (None, None, "numbers")}
    put("part-00002.parquet", [2], write_statistics=False)
    faults = {tuple(r) for r in sinks.footer_faults(sinks.footers(spark, str(tmp_path / "t"), "k"), 3).collect()}
    assert faults == {(1, 1, "order"), (2, 0, "bounds")}


@pytest.mark.parametrize("ahead", [b"", b"some bytes before the archive"])
def test_runs_read_their_part_of_the_directory(tmp_path, monkeypatch, ahead):
    many = [(f"d/{k:05d}.tsv", f"a\tb\n{k}\t{k % 7}\n".encode() * (1 + k % 3)) for k in range(70_000)]  # more than a ZIP directory counts without ZIP64
    path = tmp_path / "many.zip"
    path.write_bytes(ahead)
    with zipfile.ZipFile(path, "a", zipfile.ZIP_STORED) as z:
        for name, data in many:
            z.writestr(zipfile.ZipInfo(name), data)
    monkeypatch.setattr(archives, "_directory", lambda z, p, whole=archives._directory: whole(z, p) if len(z.filelist) < 10_000 else pytest.fail("a whole directory was read"))
    parts = archives.runs(str(path), 10**9, 100_000)
    assert 10 < len(parts) < 40 and sum(p.last - p.first for p in parts) == len(many)
    assert [(m, stream.read()) for p in parts for m, stream in archives.streams(p)] == many
    with zipfile.ZipFile(path, "a") as z, pytest.warns(UserWarning):
        z.writestr("d/00007.tsv", b"again")
    with pytest.raises(ValueError, match="repeated"):
        archives.runs(str(path), 10**9, 100_000)


def test_small_members_share_batches(tmp_path):
    path = str(tmp_path / "s.zip")
    with zipfile.ZipFile(path, "w") as z:
        for k in range(5000):
            z.writestr(f"{k:04d}.tsv", f"a\n{k}\n")
    run = archives.Run(path)
    for reader, n in ((archives.MemberRows, 5000), (archives.LineRows, 10_000)):
        got = list(reader({"path": path, "wanted": "tsv"}, None).rows(run))
        assert len(got) <= 3 and sum(b.num_rows for b in got) == n
