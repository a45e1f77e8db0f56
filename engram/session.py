"""Session helpers: defaults for local work, shared folders, shipping the package to executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

_SHIPPED: set[str] = set()


def local_session(cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("engram")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of every executor (once per application)."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="engram-")) / "engram_pkg.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, else the context's checkpoint folder.

    Where neither is set a local master takes a temporary folder; on a cluster, whose machines don't share those, it raises.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return os.path.dirname(current.get())
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    return f"file://{tempfile.gettempdir()}/engram-shared"


_WRITTEN: dict[str, list[str]] = {}


def new_path(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder, which ``release`` deletes."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialize(df: DataFrame, name: str = "stage", block: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    It cuts the lineage: a lost executor costs no recomputation of what lies above, and several readers share it. What is
    written stays until ``release``, as results may be read at any later time. ``block``: bytes of a row group, which a writing
    task holds, where rows are wide.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("compression", "zstd")
    (writer.option("parquet.block.size", block) if block else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete what lies under ``new_path`` for this application, stages, indexes and stores, once nobody reads them; how many."""
    sc = spark.sparkContext
    paths = _WRITTEN.pop(sc.applicationId, [])
    for p in paths:
        path = sc._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    return len(paths)


#: Bytes of rows that are broadcast at most.
BROADCAST_BYTES = 16 << 20


def _width(col: str, kind: DataType) -> Column:
    if isinstance(kind, StructType):
        return sum((_width(f"{col}.`{f.name}`", f.dataType) for f in kind.fields), F.lit(8))
    wide = kind.simpleString() in ("string", "binary")
    return F.coalesce(F.octet_length(col), F.lit(0)) + 8 if wide else F.lit(8)


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """``df``, a written table, to be broadcast if its rows have BROADCAST_BYTES at most, else as it is, to be shuffled."""
    width = sum((_width(f"`{f.name}`", f.dataType) for f in df.schema.fields), F.lit(16))
    return F.broadcast(df) if (df.agg(F.sum(width)).first()[0] or 0) <= BROADCAST_BYTES else df
