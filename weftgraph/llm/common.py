"""Helpers that the operators of this subpackage share: the cluster's shared folder, lineage cuts
through it, and file access that works from any executor."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..plans.lineage import is_local
from ..shipping import ship_package

#: The white space of every word and line rule here: space and U+0009..U+000D.
SPACE = " \t\n\x0b\x0c\r"
#: The same as a Java and RE2 character class body.
SPACE_CLASS = r"\x20\x09-\x0D"

_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which the driver and all executors share.

    Only where the setting is absent (local tests) a temporary folder is made and set.
    """
    ship_package(spark)
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        base = conf
    elif spark.sparkContext.getCheckpointDir():
        base = spark.sparkContext.getCheckpointDir()
    else:
        if not is_local(spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="weft-shared-")
        _made.append(base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/") if "://" in base else "file://" + base.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/weft-{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def saved(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet below the shared folder and read back: cuts the lineage, so a lost
    executor costs no recomputation of what came before."""
    path = new_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, function, schema: str) -> DataFrame:
    """mapInArrow with this package at hand in the workers."""
    ship_package(df.sparkSession)
    return df.mapInArrow(function, schema)


def file_system(uri: str):
    """(pyarrow file system, path) of a URI; works the same in the driver and in a Python worker."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def drop_dir(uri: str) -> None:
    """Removes a folder below the shared one, if it is there."""
    system, path = file_system(uri)
    try:
        system.delete_dir(path)
    except (FileNotFoundError, OSError):
        return


@atexit.register
def _clean() -> None:
    for uri in _made:
        try:
            drop_dir(uri)
        except Exception:  # the store may be gone when the interpreter ends
            continue
