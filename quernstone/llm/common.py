"""What the operators share: table access, durable intermediate tables and worker set-up."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters: what separates words everywhere in this subpackage.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table, and no others, so that clashing extra columns cannot matter."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where the session names none (tests, local mode)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
    if not hasattr(shared_dir, "own"):
        shared_dir.own = tempfile.mkdtemp(prefix="quernstone-")
        atexit.register(shutil.rmtree, shared_dir.own, True)
    return f"file://{shared_dir.own}"


def durable(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: lineage ends there, and a lost executor loses nothing.

    A table without a path of its own goes when the session's process ends; ``discard`` removes it earlier.
    """
    spark, own = df.sparkSession, path is None
    path = path or f"{shared_dir(spark)}/quernstone/{label}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    if own:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    written = spark.read.schema(df.schema).parquet(path)
    written.written_to = path
    return written


def discard(*tables: DataFrame) -> None:
    """Remove tables of ``durable`` that no later step reads: what was made of them is written too."""
    for t in tables:
        folder = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.written_to)
        folder.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def lower_ascii(col):
    """A-Z lower-cased, every other character kept."""
    return F.translate(col, UPPER, LOWER)


def quiet_worker() -> None:
    """One task has one core: no thread pools of its own; many small objects that make no cycles: few collections."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    gc.set_threshold(200_000, 20, 20)


class Generations:
    """A bounded cache of two generations: a full young one becomes the old one between two slices, and the old one goes."""

    def __init__(self, limit: int):
        self.limit, self.young, self.old = limit, {}, {}

    def missing(self, keys) -> list:
        """The distinct keys that neither generation has; the rest are in ``young`` afterwards, where the caller puts the missing ones."""
        if len(self.young) >= self.limit:
            self.old, self.young = self.young, {}
        out = []
        for k in set(keys).difference(self.young):
            if k in self.old:
                self.young[k] = self.old[k]
            else:
                out.append(k)
        return out


def slices(batch, text: int, chars: int = 2_000_000, rows: int = 512):
    """An Arrow batch in runs of rows of bounded text: (first row, texts). A longer text is a run of its own; null is empty."""
    at, run, held = 0, [], 0
    for i in range(batch.num_rows):
        t = batch.column(text)[i].as_py() or ""
        if run and (held + len(t) > chars or len(run) >= rows):
            yield at, run
            at, run, held = i, [], 0
        run.append(t)
        held += len(t)
    if run:
        yield at, run
