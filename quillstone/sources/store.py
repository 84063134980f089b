"""The passage store: Parquet by hash bucket of the document, published version by version.

A write puts the buckets that it touches into a folder of its own and then publishes a
manifest: a small numbered file that names, for each bucket, the folder to read.  The
manifest is renamed into place as the last step, so a reader sees all of a write or
nothing of it, and a writer whose base has been superseded is refused.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


class Superseded(RuntimeError):
    """Another writer has published a version since this one read its base."""


def bucket(document: str = "document_id"):
    return F.pmod(F.xxhash64(document), F.lit(BUCKETS)).cast("int")


def replaced(store: DataFrame, batch: DataFrame, document: str = "document_id") -> DataFrame:
    """The store after each document of ``batch`` has its rows replaced by the batch's; safe to repeat."""
    return store.join(batch.select(document).distinct(), document, "left_anti").unionByName(batch)


def _files(spark: SparkSession, path: str):
    """(Hadoop's file system of the path, a maker of paths)."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsc.hadoopConfiguration()), make


def _content(spark: SparkSession, path: str) -> str:
    fs, make = _files(spark, path)
    stream = fs.open(make(path))
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def versions(spark: SparkSession, path: str) -> list[int]:
    """The published versions, ascending."""
    folder = f"{path.rstrip('/')}/manifests"
    fs, make = _files(spark, folder)
    if not fs.exists(make(folder)):
        return []
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(make(folder)) if f.getPath().getName().isdigit())


def manifest(spark: SparkSession, path: str, version: int) -> dict:
    """``buckets``: folder by bucket; ``schema``; ``writers``: the last batch of each named writer."""
    if version < 0:
        return {"buckets": {}, "schema": None, "writers": {}}
    return json.loads(_content(spark, f"{path.rstrip('/')}/manifests/{version:012d}"))


def publish(spark: SparkSession, path: str, version: int, content: dict) -> None:
    """Make ``content`` version ``version``, unless there is one already."""
    folder = f"{path.rstrip('/')}/manifests"
    fs, make = _files(spark, folder)
    fs.mkdirs(make(folder))
    draft, final = make(f"{folder}/draft-{uuid.uuid4().hex}"), make(f"{folder}/{version:012d}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    jvm = spark._jvm
    plain = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    plain[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE  # never over a file that is there
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(draft, final, plain)
    except Exception as e:
        fs.delete(draft, False)
        if fs.exists(final):
            raise Superseded(f"version {version} of {path} has been published by another writer") from e
        raise


def read_store(spark: SparkSession, path: str, version: int | None = None, only: list[int] | None = None) -> DataFrame | None:
    """The passages of a version (the last one); None if nothing has been published.  ``only``: of some buckets."""
    there = versions(spark, path)
    if not there:
        return None
    held = manifest(spark, path, there[-1] if version is None else version)
    schema = spark._jvm.org.apache.spark.sql.types.DataType.fromJson(json.dumps(held["schema"])).toDDL()
    folders = [f"{path.rstrip('/')}/data/{folder}/doc_bucket={b}" for b, folder in held["buckets"].items() if only is None or int(b) in only]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def write_replaced(spark: SparkSession, path: str, batch: DataFrame, document: str = "document_id", removed: DataFrame | None = None, writer: tuple[str, int] | None = None, base: int | None = None, written: bool = False) -> int:
    """Publish a version in which the batch's documents have the batch's rows, and those of ``removed`` none; returns its number.

    ``writer``: a name and the number of its batch; a batch that it has published before
    changes nothing.  ``base``: the version that the caller has read; if another one has
    been published since, the write is refused (``Superseded``).  ``written``: the batch
    is read from a written table, so it need not be written down before it is used twice.
    """
    there = versions(spark, path)
    last = there[-1] if there else -1
    if base is not None and base != last:
        raise Superseded(f"the last version of {path} is {last}, not {base}")
    held = manifest(spark, path, last)
    if writer and held["writers"].get(writer[0], -1) >= writer[1]:
        return last
    work = f"{path.rstrip('/')}/work/{uuid.uuid4().hex}"
    rows = batch.withColumn("doc_bucket", bucket(document))
    if not written:
        rows.write.parquet(f"{work}/batch")
        rows = spark.read.schema(rows.schema).parquet(f"{work}/batch")
    gone = rows.select(document)
    if removed is not None:
        gone = gone.unionByName(removed.select(document))
    gone.distinct().write.parquet(f"{work}/gone")
    gone = spark.read.schema(gone.schema).parquet(f"{work}/gone")
    touched = [r.b for r in gone.select(bucket(document).alias("b")).distinct().collect()]  # BUCKETS at most
    folder = uuid.uuid4().hex
    after = rows
    if (old := read_store(spark, path, last, touched) if last >= 0 else None) is not None:
        after = old.join(gone, document, "left_anti").withColumn("doc_bucket", bucket(document)).unionByName(rows)
    # rebalanced: small buckets share a task, a large one is split over several
    after.hint("rebalance", "doc_bucket").write.partitionBy("doc_bucket").parquet(f"{path.rstrip('/')}/data/{folder}")
    fs, make = _files(spark, path)
    written = [b for b in touched if fs.exists(make(f"{path.rstrip('/')}/data/{folder}/doc_bucket={b}"))]
    buckets = {b: f for b, f in held["buckets"].items() if int(b) not in touched} | {str(b): folder for b in written}
    publish(spark, path, last + 1, {"buckets": buckets, "schema": json.loads(batch.schema.json()), "writers": held["writers"] | ({writer[0]: writer[1]} if writer else {})})
    fs.delete(make(work), True)
    return last + 1


def forget(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Delete the versions before the last ``keep``, and the folders that no version left names.

    For a time when nothing is written: folders of a write under way belong to no version yet.
    """
    there = versions(spark, path)
    named = {folder for v in there[-keep:] for folder in manifest(spark, path, v)["buckets"].values()}
    fs, make = _files(spark, path)
    for v in there[:-keep]:
        fs.delete(make(f"{path.rstrip('/')}/manifests/{v:012d}"), False)
    data = make(f"{path.rstrip('/')}/data")
    for f in fs.listStatus(data) if fs.exists(data) else []:
        if f.getPath().getName() not in named:
            fs.delete(f.getPath(), True)


def append_answers(answers: DataFrame, path: str, created: str = "created_at") -> None:
    """Append finished questions to the history, partitioned by day."""
    answers.withColumn("day", F.to_date(created)).write.mode("append").partitionBy("day").parquet(path)
