"""Shared intermediate tables: they cut lineage and outlive the executors that wrote them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; a local one only where that is unset, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = f"file://{tempfile.gettempdir()}/vigilake-scratch"
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return named.rstrip("/")


#: Tables made in each open scope, innermost last.
_scopes: list[list[DataFrame]] = []


@contextmanager
def scope() -> Iterator[list[DataFrame]]:
    """Tables of :func:`materialise` made inside are deleted at the end, but for those put on the list it gives, which the scope around it has then."""
    made: list[DataFrame] = []
    kept: list[DataFrame] = []
    _scopes.append(made)
    try:
        yield kept
    finally:
        _scopes.pop()
        release(*[t for t in made if not any(t is k for k in kept)])
        if _scopes:
            _scopes[-1].extend(kept)


#: Shuffle files of a write that is done are of no more use: nothing runs it again.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def joint_shuffles(spark: SparkSession) -> Iterator[None]:
    """Tables made inside are shuffled to 201 partitions where the session has 100 to 200: up to 200, each task opens a file for every partition, which costs more than small rows themselves. AQE joins the partitions as before."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    if 100 <= int(before) <= 200:
        spark.conf.set("spark.sql.shuffle.partitions", "201")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


#: The small map before the hash map of an aggregate's first half: of use only where keys come again soon.
FRONT = "spark.sql.codegen.aggregate.map.twolevel.enabled"


@contextmanager
def rare_keys(spark: SparkSession) -> Iterator[None]:
    """Tables made inside are grouped without FRONT, for keys most of which come once."""
    before = spark.conf.get(FRONT, "true")
    spark.conf.set(FRONT, "false")
    try:
        yield
    finally:
        spark.conf.set(FRONT, before)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder, drop the shuffles that took, and return a scan of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN, "false")
    spark.conf.set(CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch = path
    if _scopes:
        _scopes[-1].append(table)
    return table


def release(*tables: DataFrame | None) -> None:
    """Delete tables of :func:`materialise` that nothing will read again."""
    for table in tables:
        if table is not None:
            spark = table.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(table._scratch)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    """The cluster's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
