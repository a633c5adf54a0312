"""Cutting the lineage of iterative plans through the shared checkpoint folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def _shared(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; made here only where the session names none and runs
    in one process (local tests)."""
    sc = spark.sparkContext
    conf = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if conf is None:
        if not is_local(sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        conf = tempfile.mkdtemp(prefix="weft-checkpoint-")
        _made.append(conf)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(conf)
    return conf


def is_local(master: str) -> bool:
    """Whether driver and executors are one process (local-cluster has executors of their own)."""
    return master == "local" or master.startswith("local[")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder's path below the shared one; what is local goes when the driver ends."""
    path = f"{_shared(spark).rstrip('/')}/weft-{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


@atexit.register
def _clean() -> None:
    for path in _made:
        shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint to spark.checkpoint.dir, so a lost executor doesn't replay the loop; a folder is set
    here only where the session names none (local tests)."""
    _shared(df.sparkSession)
    return df.checkpoint(eager=True)
