"""Shared scratch storage: the one folder that driver and executors both see.

A cluster names it in ``spark.checkpoint.dir``.  Only where that is unset (tests
on one machine) do we choose a folder ourselves.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
_shipped: set[str] = set()


def shipped(spark: SparkSession) -> None:
    """Sends this package's source to the executors, once an application, so that workers can import it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    top = Path(__file__).parent
    path = f"{tempfile.mkdtemp(prefix='brindle-')}/brindle_source.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    sc.addPyFile(path)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder; set to a local one only if the session names none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that the cluster's machines share")
        root = "file://" + tempfile.mkdtemp(prefix="brindle-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, removed when the driver exits."""
    path = f"{scratch_root(spark)}/brindle-{uuid.uuid4().hex}/{name}"
    _written.append((spark, path.rsplit("/", 1)[0]))
    return path


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Writes ``df`` to the shared folder and returns it as a new scan.

    This cuts the lineage: a lost executor costs the reread of a few files, not
    the recomputation of everything before.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a path by the Hadoop file system that owns it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def dropped(df: DataFrame) -> None:
    """Deletes the table behind a frame that ``stored`` returned and nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()[:1]}:
        removed(df.sparkSession, path)


@atexit.register
def _sweep() -> None:
    for spark, path in _written:
        try:
            removed(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone already
            return


def parallelism(spark: SparkSession) -> int:
    """Partitions of a shuffle, as the session sets them."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
