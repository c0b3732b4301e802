"""Written tables that cut lineage: Parquet under the cluster's shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: list[str] = []
# On the local file system each file would get a second one of checksums, and either one a process that sets its mode.
_PLAIN = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
_OPEN: list[list[str]] = []  #: paths written inside the scratch blocks that are open now


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset, a temporary folder serves a session whose tasks all run in
    this process; on a cluster other machines could not see it, so there it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    if not _FALLBACK:
        _FALLBACK.append("file://" + tempfile.mkdtemp(prefix="corvata-"))
    return _FALLBACK[0]


def spool(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df once and read it back: (DataFrame, path). Every executor sees the files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(path)
    df.write.options(**_PLAIN).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete spooled tables that no later plan reads."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes at its end the tables spooled inside it, but for those whose path was put on the list that it gives."""
    keep: list[str] = []
    _OPEN.append([])
    try:
        yield keep
    finally:
        made = _OPEN.pop()
        discard(spark, *[p for p in made if p not in keep])
        if _OPEN:
            _OPEN[-1].extend(p for p in made if p in keep)
