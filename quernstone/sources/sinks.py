"""Writers: contract-checked Parquet, atomic publication, manifests, FASTA and deterministic archives."""

from __future__ import annotations

import hashlib
import io
import json
import tarfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def publish(df: DataFrame, path: str, contract=None, order: list[str] | None = None, rows_per_part: int = 0) -> None:
    """Write to a sibling folder and rename it: readers see all of the table or none. An existing table is an error.

    Violations of the contract fail before anything is published; ``order`` ranges the rows over the parts in order, and
    ``rows_per_part`` bounds their rows (0: no bound).
    """
    from ..operators.contracts import assert_valid

    spark = df.sparkSession
    fs, final = _path(spark, path)
    if fs.exists(final):
        raise FileExistsError(path)
    if contract is not None:
        df = contract.conform(df)
        assert_valid(df, contract)
    if order:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    temp = f"{path.rstrip('/')}.tmp-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("maxRecordsPerFile", rows_per_part).parquet(temp)
    if not fs.rename(_path(spark, temp)[1], final):
        raise OSError(f"{temp} could not be renamed")


def publish_ordered(df: DataFrame, path: str, order: list[str], rows_per_group: int, rows_per_part: int = 0, contract=None) -> dict:
    """Write a table in the order of its columns ``order`` over the parts part-00000.parquet and so on, with row groups of at most ``rows_per_group`` rows.

    What was written is read back from the footers alone, and only a table without ``footer_faults`` is published. The first column of the order must have
    an exact order (no float); nulls come first. Returns the numbers of parts, row groups and rows.
    """
    from ..operators.contracts import assert_valid

    spark = df.sparkSession
    fs, final = _path(spark, path)
    if fs.exists(final):
        raise FileExistsError(path)
    if df.schema[order[0]].dataType.typeName() in ("float", "double"):
        raise ValueError(f"{order[0]} is a float: its row groups have no exact bounds")
    if contract is not None:
        df = contract.conform(df)
        assert_valid(df, contract)
    temp = f"{path.rstrip('/')}.tmp-{uuid.uuid4().hex}"
    written = df.repartitionByRange(*order).sortWithinPartitions(*order).write.option("compression", "zstd").option("maxRecordsPerFile", rows_per_part)
    written.option("parquet.block.row.count.limit", rows_per_group).parquet(temp)
    # Spark's names sort by task, then by the file of the task: the order of the rows
    names = sorted(n for n in (f.getPath().getName() for f in fs.listStatus(_path(spark, temp)[1])) if n.endswith(".parquet"))
    for k, n in enumerate(names):
        if not fs.rename(_path(spark, f"{temp}/{n}")[1], _path(spark, f"{temp}/part-{k:05d}.parquet")[1]):
            raise OSError(f"{n} could not be renamed")
    groups = footers(spark, temp, order[0]).persist()
    try:
        faults = footer_faults(groups, rows_per_group).limit(20).collect()
        total = groups.agg(F.count_distinct("part").alias("parts"), F.count("row_group").alias("groups"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).first()
    finally:
        groups.unpersist()
    if faults:
        raise ValueError(f"{path} isn't published: {[tuple(f) for f in faults]}")
    if not fs.rename(_path(spark, temp)[1], final):
        raise OSError(f"{temp} could not be renamed")
    return total.asDict()


def footers(spark: SparkSession, path: str, column: str) -> DataFrame:
    """A row for each row group of a table's parts, from their footers: part (number in the name), file_name, schema, row_group, rows, bytes, nulls, low and high of ``column``.

    Tasks read footers only, by range. A part without rows has one row without a group.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fs, folder = _path(spark, path)
    names = sorted(str(f.getPath()) for f in fs.listStatus(folder) if f.getPath().getName().endswith(".parquet"))
    kind = spark.read.parquet(path).schema[column].dataType
    schema = f"part int, file_name string, schema string, row_group int, rows long, bytes long, nulls long, low {kind.simpleString()}, high {kind.simpleString()}"

    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def work(batches):
        import re

        import pyarrow as pa
        import pyarrow.parquet as pq

        from .archives import _opened

        for batch in batches:
            for name in batch.column(0).to_pylist():
                with _opened(name) as f:
                    meta = pq.read_metadata(f)
                base = name.rpartition("/")[2]
                number = re.match(r"part-(\d+)", base)
                fixed = {"part": int(number[1]) if number else None, "file_name": base, "schema": hashlib.sha256(str(meta.schema.to_arrow_schema().remove_metadata()).encode()).hexdigest()}
                at = [i for i in range(meta.num_columns) if meta.schema.column(i).path == column]
                rows = []
                for g in range(meta.num_row_groups):
                    group = meta.row_group(g)
                    s = group.column(at[0]).statistics if at else None
                    known = s is not None and s.has_min_max
                    rows.append(fixed | {"row_group": g, "rows": group.num_rows, "bytes": group.total_byte_size, "nulls": s.null_count if s is not None and s.has_null_count else None, "low": s.min if known else None, "high": s.max if known else None})
                yield pa.RecordBatch.from_pylist(rows or [fixed], schema=kinds)

    files = spark.createDataFrame([(n,) for n in names], "file string")
    return files.repartition(max(1, min(len(names), 256))).mapInArrow(work, schema)


def footer_faults(groups: DataFrame, rows_per_group: int) -> DataFrame:
    """(part, row_group, fault) of row groups as ``footers`` has them: too many rows, a number left out, another schema, no bounds, or out of order.

    Groups are compared with the next one of their part, the last with the first of the next part; parts are numbered, so no window spans the table.
    """
    full = groups.where("row_group is not null")
    of_part = W.partitionBy("part").orderBy("row_group")
    bounds = lambda c: F.struct("low", "high", "nulls", "row_group").alias(c)
    inner = full.select("part", bounds("x"), F.lead(F.struct("low", "high", "nulls", "row_group")).over(of_part).alias("y")).where("y is not null")
    ends = full.groupBy("part").agg(F.max_by(F.struct("low", "high", "nulls", "row_group"), "row_group").alias("x"), F.min_by(F.struct("low", "high", "nulls", "row_group"), "row_group").alias("y"))
    between = ends.select((F.col("part") + 1).alias("part"), "x").join(ends.select("part", "y"), "part")
    steps = inner.unionByName(between)
    disorder = steps.where((F.col("x.high") > F.col("y.low")) | (F.col("x.high").isNotNull() & (F.col("y.nulls") > 0))).select("part", F.col("y.row_group").alias("row_group"), F.lit("order").alias("fault"))
    single = full.select("part", "row_group", F.when(F.col("rows") > rows_per_group, "rows").when(F.col("low").isNull() & (F.coalesce("nulls", F.lit(0)) < F.col("rows")), "bounds").alias("fault")).where("fault is not null")
    every = groups.agg(F.count_distinct("part").alias("n"), F.count_distinct("file_name").alias("files"), F.max("part").alias("last"), F.count_distinct("schema").alias("schemas"))
    whole = every.select(F.explode(F.array_compact(F.array(F.when((F.col("n") != F.col("last") + 1) | (F.col("files") != F.col("n")), "numbers"), F.when(F.col("schemas") > 1, "schema")))).alias("fault"))
    return disorder.unionByName(single).unionByName(whole.select(F.lit(None).cast("int").alias("part"), F.lit(None).cast("int").alias("row_group"), "fault"))


def positions(spark: SparkSession, path: str, column: str) -> DataFrame:
    """The rows of a table of ``publish_ordered`` with their position, from 0, in the order of the whole table.

    A part begins behind the rows of the parts before it, whose numbers the footers hold: a sum over one row a part, none over rows.
    """
    sizes = footers(spark, path, column).groupBy("part", "file_name").agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("file_name", before.alias("start"))
    rows = spark.read.parquet(path).select("*", F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.row_index").alias("at"))
    return rows.join(starts, "file_name").withColumn("position", F.col("start") + F.col("at")).drop("file_name", "start", "at")


def zip_archives(df: DataFrame, path: str, archive: str = "archive", member: str = "member", payload: str = "payload") -> None:
    """Write ZIP archives <path>/<archive>.zip, their members in the order of the names; bytes depend on names and payloads only.

    Rows stream into the archive of their task, one at a time; an archive is written under a name of its attempt and then renamed, so a task may be
    repeated. Repeated or unsafe members and null payloads fail the job.
    """
    from .readers import safe_member

    def work(batches):
        import zipfile

        import pyarrow as pa

        from .archives import _store

        store, folder = _store(path)
        store.create_dir(folder, recursive=True)
        name = out = sink = last = None
        done = []

        def close():
            out.close()
            sink.close()
            store.move(temp, f"{folder}/{name}.zip")
            done.append(name)

        for batch in batches:
            for a, m, p in zip(*(batch.column(i) for i in range(3))):
                a, m = a.as_py(), m.as_py()
                if a != name:
                    if out:
                        close()
                    name, last, temp = a, None, f"{folder}/.{a}-{uuid.uuid4().hex}"
                    sink = store.open_output_stream(temp)
                    out = zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED)
                if not safe_member(m) or m == last or not p.is_valid:
                    raise ValueError(f"{a}: the member {m!r} is unsafe, repeated or null")
                last = m
                value = p.as_py()
                info = zipfile.ZipInfo(m, (1980, 1, 1, 0, 0, 0))
                info.compress_type = zipfile.ZIP_DEFLATED
                out.writestr(info, value)
        if out:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], names=["archive"])

    rows = df.select(F.col(archive).cast("string").alias("a"), F.col(member).alias("m"), F.col(payload).alias("p"))
    rows.repartition("a").sortWithinPartitions("a", "m").mapInArrow(work, "archive string").write.format("noop").mode("overwrite").save()


def part_digests(spark: SparkSession, path: str) -> DataFrame:
    """file_name, file_size, sha256 of the contents and rows of each part of a written table; parts are digested where they are read."""
    name = F.element_at(F.split("path", "/"), -1)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select(name.alias("file_name"), F.col("length").alias("file_size"), F.sha2("content", 256).alias("sha256"))
    rows = spark.read.parquet(path).select(F.col("_metadata.file_name").alias("file_name")).groupBy("file_name").agg(F.count("*").alias("rows"))
    return files.join(rows, "file_name", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))


def manifest(spark: SparkSession, path: str, **notes) -> dict:
    """Rows, schema and parts (name, bytes, rows, digest of the contents) of a written table; sha256 goes by contents, not by the parts' random names.

    A row for each file comes to the driver.
    """
    parts = part_digests(spark, path).orderBy("file_name").collect()
    body = {"rows": sum(p.rows for p in parts), "schema": spark.read.parquet(path).schema.jsonValue(), **notes}
    contents = body | {"contents": sorted([p.sha256, p.file_size, p.rows] for p in parts)}
    digest = hashlib.sha256(json.dumps(contents, sort_keys=True).encode()).hexdigest()
    return body | {"parts": [[p.file_name, p.file_size, p.rows, p.sha256] for p in parts], "sha256": digest}


def manifest_differences(spark: SparkSession, path: str, document: dict) -> DataFrame:
    """(file_name, problem) of a table against its manifest: missing, unlisted, size, rows or content. No rows: the table is as it was."""
    if spark.read.parquet(path).schema.jsonValue() != document["schema"]:
        raise ValueError(f"{path} has another schema than its manifest")
    if len({p[0] for p in document["parts"]}) != len(document["parts"]):
        raise ValueError("the manifest names a part twice")
    listed = spark.createDataFrame([tuple(p) for p in document["parts"]], "file_name string, size_then long, rows_then long, sha256_then string")
    j = part_digests(spark, path).join(listed, "file_name", "full_outer")
    problem = F.when(F.col("sha256").isNull(), "missing").when(F.col("sha256_then").isNull(), "unlisted").when(F.col("file_size") != F.col("size_then"), "size")
    problem = problem.when(F.col("rows") != F.col("rows_then"), "rows").when(F.col("sha256") != F.col("sha256_then"), "content")
    return j.select("file_name", problem.alias("problem")).where("problem is not null")


def fasta_lines(df: DataFrame, header: str = "header", sequence: str = "sequence", width: int = 80) -> DataFrame:
    """One text value for each record, its sequence wrapped; for write.text."""
    wrapped = F.rtrim(F.regexp_replace(sequence, f"(.{{{width}}})", "$1\n"))
    return df.select(F.concat(F.lit(">"), header, F.lit("\n"), wrapped).alias("value"))


def deterministic_tar(files: dict[str, bytes]) -> bytes:
    """A TAR whose bytes depend on names and contents only."""
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.USTAR_FORMAT) as t:
        for name in sorted(files):
            info = tarfile.TarInfo(name)
            info.size, info.mode = len(files[name]), 0o444
            t.addfile(info, io.BytesIO(files[name]))
    return out.getvalue()


def replaced_prefix(value, old: str, new: str):
    """A document in which every path below ``old`` lies below ``new``."""
    if isinstance(value, dict):
        return {k: replaced_prefix(v, old, new) for k, v in value.items()}
    if isinstance(value, list):
        return [replaced_prefix(v, old, new) for v in value]
    return new + value[len(old) :] if isinstance(value, str) and (value == old or value.startswith(f"{old}/")) else value
