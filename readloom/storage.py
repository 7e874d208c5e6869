"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Unset, a local master gets a temporary folder; on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_readloom_shared", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="readloom-")
        spark._readloom_shared = root
    return root.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh URI under the shared root; nothing is created yet."""
    return f"{shared_root(spark)}/readloom/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str, by: tuple[str, ...] = (), **options: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage, survives lost executors.

    Rows of each value of the columns ``by``, which should be few, are in files of their own.
    """
    spark = df.sparkSession
    path = new_dir(spark, name)
    df.write.options(**options).partitionBy(*by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that :func:`materialise` returned and that no plan reads any more, such as those of a loop's last round."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._stored)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def store(uri: str):
    """The pyarrow file system of a URI and the path in it (file, hdfs, s3, gs, ...)."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def put(fs, draft: str, final: str) -> None:
    """Move a finished file to its name, in place of what an earlier attempt or run has left there.

    Some stores replace the target of a move, others refuse to; there it is deleted first.
    """
    try:
        fs.move(draft, final)
    except OSError:
        fs.delete_file(final)
        fs.move(draft, final)
