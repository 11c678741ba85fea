"""Folders for intermediate tables and files, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a local session gets a folder of its own; on a
    cluster that is an error, as executors wouldn't see it."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spanloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


_cleaned: set[str] = set()


def work_path(spark: SparkSession) -> str:
    """A new path for an intermediate table, in the application's own folder within the shared one; the folder goes when the driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _cleaned:
        _cleaned.add(app)
        atexit.register(clean_up, spark)
    return f"{shared_dir(spark)}/spanloom-{app}/{uuid.uuid4().hex}"


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt over as many tasks as shuffles have: few bytes but much work a row. By a number of its own, the shuffle isn't coalesced to the bytes, and a
    small file isn't one task."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def written(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: what isn't decided by the rows alone stays as it was when a task runs again."""
    path = work_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean_up(spark: SparkSession) -> None:
    """Deletes all intermediate tables of this application; results that still read them must have been written by then."""
    with contextlib.suppress(Exception):  # at the driver's end the JVM may be gone before
        delete(spark, f"{shared_dir(spark)}/spanloom-{spark.sparkContext.applicationId}")


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at this path; where it isn't there (or was left half written), made and written first."""
    if not exists(spark, f"{path}/_SUCCESS"):
        made = make()
        made.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def qualified(spark: SparkSession, path: str) -> str:
    """A path as a URI that pyarrow's file systems understand."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return "file://" + out.removeprefix("file:").replace("//", "/") if out.startswith("file:") else out


def write_files(rows: DataFrame, folder: str) -> DataFrame:
    """Writes rows (name, content) as a file each into a folder, and gives (name, bytes), a row for each file that was written.

    A task that is run again writes the same files again under their own names. Two rows of one name would overwrite each other, so they
    fail the job beforehand.
    """
    spark = rows.sparkSession
    twice = rows.groupBy("name").count().filter("count > 1").first()
    if twice:
        raise ValueError(f"{twice['count']} rows are named {twice['name']}")
    where = qualified(spark, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(where)
        store.create_dir(base, recursive=True)
        for batch in batches:
            sizes = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = (content or "").encode()
                with store.open_output_stream(f"{base}/{name}", compression=None) as out:
                    out.write(raw)
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["name", "bytes"])

    manifest = work_path(spark)
    spread(rows.select(F.col("name").cast("string").alias("name"), F.col("content").alias("content"))).mapInArrow(run, "name string, bytes bigint").write.parquet(manifest)
    return spark.read.parquet(manifest)


#: Bytes of files that a task holds before it gives them on.
_HELD = 1 << 22


def read_files(names: DataFrame, folder: str) -> DataFrame:
    """(name, content): the files of a folder that names (name) tells, as write_files gives them. The tasks open them by name, so the driver
    lists none, and there are as many tasks as shuffles have, whatever the number of files. One that isn't there fails the job."""
    where = qualified(names.sparkSession, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(where)

        def given() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held, pa.string()), pa.array(contents, pa.string())], names=["name", "content"])

        for batch in batches:
            held, contents, size = [], [], 0
            for name in batch.column(0).to_pylist():
                with store.open_input_stream(f"{base}/{name}", compression=None) as file:
                    raw = file.read()
                held.append(name)
                contents.append(raw.decode(errors="replace"))
                size += len(raw)
                if size >= _HELD:
                    yield given()
                    held, contents, size = [], [], 0
            if held:
                yield given()

    return spread(names.select("name")).mapInArrow(run, "name string, content string")
