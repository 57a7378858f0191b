"""Archives of any size as a Spark data source: ZIP members are read by range, TAR streams forward, nothing is held whole.

A ZIP archive's central directory names its members and their places. Archives above one partition's size are divided
among tasks by runs of members, each task reads its members' bytes alone; smaller archives, and compressed TAR streams, which have no
directory, are one task each. Files are opened through ``pyarrow.fs`` (local, HDFS and object stores); where only Spark's own readers reach a
file, ``readers.archive_members`` reads it, within the limits of ``binaryFile``.

Defined cases: an archive without members gives no rows; members of no bytes have size 0, and no lines; folders are not members. An unsafe name, a name met before
in the archive, a link, an encrypted member or a file that is no archive fails the job, wherever in the archive it stands.
"""

from __future__ import annotations

import io
import stat
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .readers import RECORD, interaction_rows, safe_member

PIECE = 2**20
SPLIT = 64 * 2**20
BATCH = 4096

MEMBERS = "archive string, member string, size long, sha256 string, payload binary"
LINES = "archive string, member string, ordinal long, line string"


def _store(path: str):
    """The file system of a path, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def archive_files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files that a path, a folder or a pattern in the last part names, hidden ones aside."""
    import fnmatch
    import posixpath

    from pyarrow import fs

    store, inner = _store(path)
    prefix = path[: len(path) - len(inner)] if "://" in path and path.endswith(inner) else ""
    folder, last = posixpath.split(inner.rstrip("/"))
    if any(c in last for c in "*?["):
        found = [f for f in store.get_file_info(fs.FileSelector(folder)) if fnmatch.fnmatchcase(f.base_name, last)]
    else:
        info = store.get_file_info(inner)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        found = store.get_file_info(fs.FileSelector(inner)) if info.type == fs.FileType.Directory else [info]
    return sorted((prefix + f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))


def _opened(path: str):
    store, inner = _store(path)
    return store.open_input_file(inner)


def _directory(z, path: str) -> list:
    """The members of an open ZIP archive in the order of their names in its directory; what must not be there is an error."""
    seen, out = set(), []
    for i in z.infolist():
        if i.is_dir():
            continue
        if i.filename in seen:
            raise ValueError(f"{path}: the member {i.filename!r} is unsafe or repeated")
        _fine(path, i.filename, i.flag_bits, i.external_attr)
        seen.add(i.filename)
        out.append(i)
    return out


@dataclass
class Run(InputPartition):
    """Members first to last - 1 of an archive, folders not counted, with the bytes low to high - 1 of its central directory and the records there; no last: all of it."""

    path: str
    first: int = 0
    last: int | None = None
    low: int = 0
    high: int = 0
    records: int = 0


#: A record of the central directory without its name, extra field and comment; its signature.
RECORD_BYTES, SIGNATURE = 46, b"PK\x01\x02"


def _directory_place(f) -> tuple[int, int, int]:
    """(start, bytes, start as the end record says it) of the central directory of an open ZIP archive; nothing of the directory is held."""
    import zipfile

    end = zipfile._EndRecData(f)
    if not end:
        raise zipfile.BadZipFile("no end record")
    size, at = end[zipfile._ECD_SIZE], end[zipfile._ECD_LOCATION]
    if end[zipfile._ECD_SIGNATURE] == zipfile.stringEndArchive64:
        at -= zipfile.sizeEndCentDir64 + zipfile.sizeEndCentDir64Locator
    return at - size, size, end[zipfile._ECD_OFFSET]


def _directory_records(f, start: int, size: int):
    """(place, flags, attributes, compressed bytes, name as in the directory) of each record, read in pieces."""
    import struct

    f.seek(start)
    held, at, left = b"", 0, size
    done = 0  # bytes of the directory before held
    while True:
        if left and len(held) - at < PIECE // 4:
            piece = f.read(min(PIECE, left))
            if not piece:
                raise ValueError("the central directory ends early")
            left -= len(piece)
            done, held, at = done + at, held[at:] + piece, 0
        if at >= len(held):
            return
        record = held[at : at + RECORD_BYTES]
        if len(record) < RECORD_BYTES or record[:4] != SIGNATURE:
            raise ValueError("a broken central directory")
        flags, packed = struct.unpack_from("<H", record, 8)[0], struct.unpack_from("<I", record, 20)[0]
        n, extra, comment = struct.unpack_from("<3H", record, 28)
        name = held[at + RECORD_BYTES : at + RECORD_BYTES + n]
        if packed == 0xFFFFFFFF:  # ZIP64: the sizes that are too large stand in the extra field, the whole one first
            field = held[at + RECORD_BYTES + n : at + RECORD_BYTES + n + extra]
            while len(field) >= 4:
                kind, k = struct.unpack_from("<2H", field)
                if kind == 1:
                    packed = struct.unpack_from("<Q", field, 4 + 8 * (struct.unpack_from("<I", record, 24)[0] == 0xFFFFFFFF))[0]
                field = field[4 + k :]
        yield done + at, flags, struct.unpack_from("<I", record, 38)[0], packed, name
        at += RECORD_BYTES + n + extra + comment


def runs(path: str, size: int, split: int) -> list[Run]:
    """The partitions of one archive: one, or runs of members of about ``split`` compressed bytes. The directory is read in pieces; of a member eight bytes are kept,
    and names only of members whose eight bytes are there twice."""
    import zipfile
    from array import array

    import numpy as np

    if size <= split:
        return [Run(path)]
    with _opened(path) as f:
        if not zipfile.is_zipfile(f):
            return [Run(path)]
        start, length, _ = _directory_place(f)
        out, first, low, held, records, names = [], 0, 0, 0, 0, array("q")
        for at, flags, attributes, packed, raw in _directory_records(f, start, length):
            name = _member_name(raw, flags)
            member = not name.endswith("/")
            if member:
                _fine(path, name, flags, attributes)
                if len(names) > first and held + packed > split:
                    out.append(Run(path, first, len(names), low, at, records))
                    first, low, held, records = len(names), at, 0, 0
                names.append(hash(name))
                held += packed
            records += 1
        met = np.sort(np.frombuffer(names, np.int64)) if names else np.zeros(0, np.int64)
        twice = set(met[1:][met[1:] == met[:-1]].tolist())
        if twice:
            seen = set()
            for _, flags, _, _, raw in _directory_records(f, start, length):
                name = _member_name(raw, flags)
                if hash(name) in twice and not name.endswith("/"):
                    if name in seen:
                        raise ValueError(f"{path}: the member {name!r} is unsafe or repeated")
                    seen.add(name)
    return [*out, Run(path, first, len(names), low, length, records)]


def _member_name(raw: bytes, flags: int) -> str:
    """A name as ``zipfile`` reads it: up to a zero byte."""
    return raw.decode("utf-8" if flags & 0x800 else "cp437").split("\0", 1)[0]


def _fine(path: str, name: str, flags: int, attributes: int) -> None:
    if not safe_member(name):
        raise ValueError(f"{path}: the member {name!r} is unsafe or repeated")
    if stat.S_ISLNK(attributes >> 16):
        raise ValueError(f"{path}: {name} is a link")
    if flags & 1:
        raise ValueError(f"{path}: {name} is encrypted")


class _Part(io.RawIOBase):
    """A ZIP archive with a part of its directory: the bytes before the directory, then the records of a run and an end record for these."""

    def __init__(self, f, run: Run):
        import struct

        start, _, said = _directory_place(f)
        f.seek(start + run.low)
        records, n = f.read(run.high - run.low), run.records
        whole = struct.pack("<4sQ2H2I4Q", b"PK\x06\x06", 44, 45, 45, 0, 0, n, n, len(records), said)
        locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, start + len(records), 1)
        end = struct.pack("<4s4H2IH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
        self.f, self.start, self.tail, self.at = f, start, records + whole + locator + end, 0

    def readable(self):
        return True

    def seekable(self):
        return True

    def tell(self):
        return self.at

    def seek(self, offset, whence=0):
        self.at = max(0, offset + (0, self.at, self.start + len(self.tail))[whence])
        return self.at

    def read(self, n=-1):
        if self.at >= self.start:
            out = self.tail[self.at - self.start :][: None if n is None or n < 0 else n]
        else:
            self.f.seek(self.at)
            left = self.start - self.at
            out = self.f.read(left if n is None or n < 0 else min(n, left))
            if n is None or n < 0 or n > left:
                out += self.tail[: None if n is None or n < 0 else n - left]
        self.at += len(out)
        return out


def streams(run: Run):
    """(member, open stream) of each member of a run."""
    import tarfile
    import zipfile

    with _opened(run.path) as f:
        if zipfile.is_zipfile(f):
            with zipfile.ZipFile(f if run.last is None else _Part(f, run)) as z:
                for i in _directory(z, run.path):
                    with z.open(i) as stream:
                        yield i.filename, stream
            return
        f.seek(0)
        seen = set()
        with tarfile.open(fileobj=f, mode="r|*") as t:
            for m in t:
                if m.issym() or m.islnk():
                    raise ValueError(f"{run.path}: {m.name} is a link")
                if not m.isfile():
                    continue
                if not safe_member(m.name) or m.name in seen:
                    raise ValueError(f"{run.path}: the member {m.name!r} is unsafe or repeated")
                seen.add(m.name)
                yield m.name, t.extractfile(m)


class Members(DataSourceReader):
    """Partitions are runs of members; subclasses make rows of the streams."""

    def __init__(self, options, schema):
        self.schema = schema
        self.path, self.wanted, self.split = options["path"], options.get("wanted") or None, int(options.get("split", SPLIT))

    def partitions(self):
        from concurrent.futures import ThreadPoolExecutor

        with ThreadPoolExecutor(4) as pool:  # each holds a piece of a directory and eight bytes a member
            some = pool.map(lambda f: runs(*f, self.split), archive_files(self.path))
            return [r for one in some for r in one] or [Run("")]

    def matches(self, member: str) -> bool:
        import re

        return bool(self.wanted and re.search(self.wanted, member))

    def read(self, run):
        if run.path:
            yield from self.rows(run)


class MemberRows(Members):
    def rows(self, run):
        import hashlib

        import pyarrow as pa

        held, weight = [], 0

        def batch():
            kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held), kinds)], names=["archive", "member", "size", "sha256", "payload"])

        for member, stream in streams(run):
            digest, size, kept = hashlib.sha256(), 0, [] if self.matches(member) else None
            while piece := stream.read(PIECE):
                digest.update(piece)
                size += len(piece)
                if kept is not None:
                    kept.append(piece)
            held.append((run.path, member, size, digest.hexdigest(), None if kept is None else b"".join(kept)))
            weight += size if kept is not None else 0
            if len(held) >= BATCH or weight >= PIECE:
                yield batch()
                held, weight = [], 0
        if held:
            yield batch()


class LineRows(Members):
    def rows(self, run):
        import io
        from itertools import batched

        import pyarrow as pa

        names, ordinals, rows = [], [], []

        def batch():
            columns = [pa.array([run.path] * len(rows)), pa.array(names), pa.array(ordinals, pa.int64()), pa.array(rows, pa.string())]
            return pa.RecordBatch.from_arrays(columns, names=["archive", "member", "ordinal", "line"])

        for member, stream in streams(run):
            if not self.matches(member):
                continue
            text = io.TextIOWrapper(io.BufferedReader(stream, PIECE), encoding="utf-8", newline="\n")
            at = 0
            for some in batched(text, BATCH):
                rows += [x.removesuffix("\n").removesuffix("\r") for x in some]
                names += [member] * len(some)
                ordinals += range(at, at + len(some))
                at += len(some)
                if len(rows) >= BATCH:  # lines of small members go together
                    yield batch()
                    names, ordinals, rows = [], [], []
        if rows:
            yield batch()


class InteractionRows(Members):
    def rows(self, run):
        from itertools import batched

        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(self.schema)
        for member, stream in streams(run):
            if self.matches(member):
                for some in batched(interaction_rows(stream), 1000):
                    yield pa.RecordBatch.from_pylist(list(some), schema=kinds)


class ArchiveSource(DataSource):
    """``spark.read.format("quernstone_archive").option("path", …)``; option rows: members, lines or interactions."""

    #: The forms of rows: schema and reader.
    FORMS = {"members": (MEMBERS, MemberRows), "lines": (LINES, LineRows), "interactions": (RECORD, InteractionRows)}

    @classmethod
    def name(cls):
        return "quernstone_archive"

    def schema(self):
        return self.FORMS[self.options.get("rows", "members")][0]

    def reader(self, schema):
        return self.FORMS[self.options.get("rows", "members")][1](self.options, schema)


def _read(spark: SparkSession, path: str, rows: str, wanted: str | None, split: int) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("quernstone_archive").option("path", path).option("rows", rows).option("wanted", wanted or "").option("split", split).load()


def members(spark: SparkSession, path: str, wanted: str | None = None, split: int = SPLIT) -> DataFrame:
    """archive, member, size and sha256 of each member, and the payload of those that ``wanted`` finds (they must fit a row)."""
    return _read(spark, path, "members", wanted, split)


def member_lines(spark: SparkSession, path: str, wanted: str, split: int = SPLIT) -> DataFrame:
    """archive, member, ordinal from 0 and line of each line of the members that ``wanted`` finds, of any size; an empty last line is none."""
    return _read(spark, path, "lines", wanted, split)


def member_table(spark: SparkSession, path: str, wanted: str, columns: list[str], split: int = SPLIT) -> DataFrame:
    """Rows of the tab-separated members that ``wanted`` finds: archive, member, ordinal from 1 and ``columns``, the exact header of each.

    Empty lines are skipped, an ordinal counts them. Another header, or a row of another width, fails the job.
    """
    lines = member_lines(spark, path, wanted, split)
    f = F.split("line", "\t", -1)
    fault = lambda what: F.raise_error(F.concat("member", F.lit(": "), F.lit(what))).cast("boolean")
    # one predicate: a selection of columns or rows leaves no check out
    header = F.when(F.col("line") == "\t".join(columns), False).otherwise(fault("another header"))
    kept = F.when(F.col("ordinal") == 0, header).when(F.col("line") == "", False).when(F.size(f) == len(columns), True).otherwise(fault("a row of another width"))
    rows = lines.where(kept).withColumn("f", f)
    return rows.select("archive", "member", "ordinal", *[F.get("f", F.lit(i)).alias(c) for i, c in enumerate(columns)])


def interactions(spark: SparkSession, path: str, wanted: str = r"(?i)\.xml$", split: int = SPLIT) -> DataFrame:
    """``readers.interaction_records`` of the XML members of archives of any size, members spread over tasks."""
    return _read(spark, path, "interactions", wanted, split)
