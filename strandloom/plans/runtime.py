"""Session plumbing shared by all operators: lineage cuts, worker import path, table loading."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``; where that is unset, a local session gets a temporary
    folder of this machine, once for each application, and a cluster is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = "file://" + tempfile.mkdtemp(prefix="strandloom-")
    return _own_dir[app]


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet under :func:`shared_dir` and reread it.

    Cuts the lineage like ``checkpoint()``, survives lost executors, and keeps only columnar data.
    """
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def discard(*cuts: DataFrame) -> None:
    """Delete what :func:`cut` wrote for these; nothing that is still to run may read it."""
    for df in cuts:
        if path := df.__dict__.pop("_cut_path", None):
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Rows and bytes that Python workers get at once: texts are long, and small batches keep workers small.
ARROW_ROWS, ARROW_BYTES = "1000", str(8 << 20)


#: Workers live through many stages: one allocator that gives memory back, and no threads of their own.
WORKER_ENVIRONMENT = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "1", "MALLOC_TRIM_THRESHOLD_": "1048576", "OPENBLAS_NUM_THREADS": "1"}


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from the driver's source folder, and keep their batches small."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "67108864b":
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    for name, value in WORKER_ENVIRONMENT.items():
        env.setdefault(name, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def plain_columns(docs: DataFrame, *names: str) -> tuple[DataFrame, list[str], Callable[[DataFrame], DataFrame]]:
    """``docs`` with columns c0, c1, ..., so that no name clashes with an operator's own; the new ``names``; the way back."""
    columns = docs.columns
    fresh = [f"c{i}" for i in range(len(columns))]
    return docs.toDF(*fresh), [f"c{columns.index(n)}" for n in names], lambda df: df.select(*fresh).toDF(*columns)
