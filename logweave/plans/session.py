"""What operators need from the session: a folder every executor sees, and this package on the workers."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = Path(__file__).resolve().parent.parent


#: Bytes of Parquet files up to which a written table is broadcast.
BROADCAST_BYTES = 16 << 20
#: Bytes of an Arrow batch that a Python task gets at most (beyond one row).
BATCH_BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset, a new local one is set, but on one machine only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jvm_dir.isDefined():
            return jvm_dir.get()
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="logweave-shared-")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder inside the shared one for tables that only other written tables are made from; it is deleted at the end."""
    path = f"{shared_folder(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        deleted(spark, path)


def deleted(spark: SparkSession, path: str) -> None:
    """Delete a file or folder in whatever file system it lies."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def written(frame: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Write ``frame`` as Parquet to the shared folder (or a ``scratch`` one) and read it back: cuts lineage, survives lost executors."""
    spark = frame.sparkSession
    path = f"{(folder or shared_folder(spark)).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    frame.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def small(frame: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """A written table, marked for broadcast if its files hold at most so many bytes; beyond, Spark shuffles both sides of its join."""
    context = frame.sparkSession
    total = 0
    for name in frame.inputFiles():
        place = context._jvm.org.apache.hadoop.fs.Path(name)
        total += place.getFileSystem(context._jsc.hadoopConfiguration()).getFileStatus(place).getLen()
        if total > most:
            return frame
    return F.broadcast(frame)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _bytes(amount: str) -> int:
    """A size as Spark's settings give it, in bytes."""
    number = amount.rstrip("bkmgtBKMGT")
    return int(number) << {"": 0, "b": 0, "k": 10, "m": 20, "g": 30, "t": 40}[amount[len(number) :].lower()[:1]]


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once for each Spark context, and bound their batches by bytes."""
    context, bound = spark.sparkContext, "spark.sql.execution.arrow.maxBytesPerBatch"
    if _bytes(spark.conf.get(bound)) > BATCH_BYTES:
        spark.conf.set(bound, str(BATCH_BYTES))
    if getattr(context, "_logweave_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="logweave-py-")) / f"logweave_{uuid.uuid4().hex[:8]}.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted(PACKAGE.rglob("*.py")):
            archive.write(source, f"{PACKAGE.name}/{source.relative_to(PACKAGE)}")
    context.addPyFile(str(target))
    context._logweave_shipped = True
