"""What operators need of a session."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Temporary folders of sessions on one machine that name none, by application.
_LOCAL: dict[str, str] = {}
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where it is, whatever folder the session was started in.

    On a cluster whose machines don't share that folder, ship the package with ``--py-files`` as usual.
    """
    environment = spark.sparkContext.environment
    path = environment.get("PYTHONPATH", "")
    if ROOT not in path.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, path]))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only a session on one machine may lack the setting; it then gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        name = spark.sparkContext.applicationId
        if name not in _LOCAL:
            path = tempfile.mkdtemp(prefix="checkpoints-")
            atexit.register(shutil.rmtree, path, ignore_errors=True)
            _LOCAL[name] = f"file://{path}"
        folder = _LOCAL[name]
    return folder


def fresh_path(spark: SparkSession) -> str:
    """A path in the shared folder that nothing uses."""
    return f"{shared_folder(spark).rstrip('/')}/t-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: what reads it more than once computes it once, and no lost executor
    makes it anew."""
    spark = df.sparkSession
    importable(spark)
    path = fresh_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hinted(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows, else as it is (a shuffle join follows)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
