"""Readers and sinks: log files with fixed schemas, tables by suffix, JSON reports, fold checkpoints, digests."""

from __future__ import annotations

import json
from datetime import date, datetime
from pathlib import PurePath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.functions.scalar import parse_ts

#: The columns of each log, in order; all are text but those named in NUMBERS.
LOGS = {
    "logon": ["id", "date", "user", "pc", "activity"],
    "device": ["id", "date", "user", "pc", "activity"],
    "file": ["id", "date", "user", "pc", "filename", "content"],
    "http": ["id", "date", "user", "pc", "url", "content"],
    "email": ["id", "date", "user", "pc", "to", "cc", "bcc", "from", "size", "attachments", "content"],
    "psychometric": ["employee_name", "user_id", "O", "C", "E", "A", "N"],
    "insiders": ["dataset", "scenario", "details", "user", "start", "end"],
    "ldap": ["employee_name", "user_id", "email", "role", "business_unit", "functional_unit", "department", "team", "supervisor"],
}
#: Texts that stand for a missing value in a raw log.
MISSING = ("", "null")
NUMBERS = {"size": "int", "attachments": "int", "O": "int", "C": "int", "E": "int", "A": "int", "N": "int", "scenario": "int", "dataset": "decimal(3,1)"}


def log_schema(name: str) -> str:
    return ", ".join(f"`{c}` {NUMBERS.get(c, 'string')}" for c in LOGS[name])


def read_log(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A raw CSV log with its fixed schema, and ``ts`` and ``day`` where it has a date.

    Empty text and the text ``null`` are null, and so are unreadable dates; ``user`` is also
    there as ``user_id``, the name that the operators use.
    """
    df = spark.read.schema(log_schema(name)).option("header", True).option("nullValue", "").option("multiLine", False).csv(path)
    for c, kind in df.dtypes:
        if kind == "string":
            df = df.withColumn(c, F.when(~F.col(c).isin(*MISSING), F.col(c)))
    if "date" in df.columns:
        df = df.withColumn("ts", parse_ts(F.col("date"))).withColumn("day", F.to_date("ts"))
    if "user" in df.columns:
        df = df.withColumn("user_id", F.col("user"))
    return df


def read_ldap(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(snapshot_month, user_id, role, department) of monthly directory snapshots, given as {"2010-01": path}."""
    found = None
    for month, path in sorted(paths.items()):
        one = read_log(spark, "ldap", path).select(F.to_date(F.lit(f"{month}-01")).alias("snapshot_month"), "user_id", "role", "department").filter("user_id is not null")
        found = one if found is None else found.unionByName(one)
    if found is None:
        raise ValueError("no snapshot given")
    return found


def latest_roles(snapshots: DataFrame) -> DataFrame:
    """(user_id, role, department) of each user's last snapshot."""
    last = F.max_by(F.struct("role", "department"), "snapshot_month").alias("x")
    return snapshots.groupBy("user_id").agg(last).select("user_id", "x.role", "x.department")


def read_features(spark: SparkSession, folder: dict[str, str], start, end, users: DataFrame | None = None, window_days: int = 28) -> DataFrame:
    """The dense user-day table from the raw logs ``logon``, ``device``, ``file`` and ``http`` (paths by name).

    The users are those of the logon log unless ``users`` (user_id) names them.
    """
    from vigilake.operators.features import user_day_grid, user_day_table

    logs = {name: read_log(spark, name, folder[name]) for name in ("logon", "device", "file", "http")}
    own = logs["logon"].filter("user_id is not null") if users is None else users
    return user_day_table(logs, user_day_grid(own, start, end), window_days)


def read_insiders(spark: SparkSession, path: str, release: str | None = "4.2") -> DataFrame:
    """The answer key of one release (all, if None), its start and end parsed from mixed formats."""
    formats = ("MM/dd/yyyy HH:mm:ss", "M/d/yyyy HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "MM/dd/yyyy", "yyyy-MM-dd")
    df = read_log(spark, "insiders", path)
    if release is not None:
        df = df.filter(F.col("dataset") == F.lit(release).cast("decimal(3,1)"))
    return df.withColumn("start", F.to_date(parse_ts(F.col("start"), *formats))).withColumn("end", F.to_date(parse_ts(F.col("end"), *formats)))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A csv, parquet or json table, by suffix."""
    kind = PurePath(path.rstrip("/")).suffix.lstrip(".").lower()
    if kind == "csv":
        return spark.read.option("header", True).csv(path)
    if kind in ("parquet", "json", "jsonl", "orc"):
        return spark.read.format("json" if kind == "jsonl" else kind).load(path)
    raise ValueError(f"unknown kind of file: {path}")


def distinct_users(df: DataFrame, user_col: str = "user") -> DataFrame:
    return df.select(F.col(user_col).cast("string").alias("user")).distinct()


def json_safe(value):
    """Rows, dates, numpy values and sets as what JSON holds."""
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return {str(k): json_safe(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [json_safe(v) for v in (sorted(value) if isinstance(value, set) else value)]
    if isinstance(value, (date, datetime)):
        return value.isoformat()
    if hasattr(value, "item"):
        return value.item()
    return None if isinstance(value, float) and value != value else value


def canonical_json(value) -> str:
    return json.dumps(json_safe(value), sort_keys=True, separators=(",", ":"))


def write_report(df: DataFrame, path: str) -> None:
    """A report table as JSON lines."""
    df.write.mode("overwrite").json(path)


def save_report(spark: SparkSession, report, path: str) -> str:
    """One report as canonical JSON, in a single file of any file system that Spark writes to; returns what was written."""
    text = canonical_json(report)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    return text


def canonical_digest(df: DataFrame) -> DataFrame:
    """One row: how many rows, and digests that don't depend on their order; a repeated row counts each time.

    The digests are sums of two 60-bit words of each row's hash, so equal rows don't cancel.
    """
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    word = lambda at: F.conv(F.substring(row, at, 15), 16, 10).cast("decimal(20,0)")
    total = lambda at: F.coalesce(F.sum(word(at)), F.lit(0)).cast("decimal(38,0)").cast("string")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), total(1).alias("digest_1"), total(16).alias("digest_2"))


BLOCK = 1 << 22


def file_md5(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, md5) of each file of any length; a task streams its files in blocks through the cluster's file system."""
    names = spark.read.format("binaryFile").load(path).select("path", "length")  # the content column is not read
    fs = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    rows = []
    for name, length in names.collect():  # a list of files, not of rows
        at = fs(name)
        stream, digest = at.getFileSystem(conf).open(at), spark._jvm.java.security.MessageDigest.getInstance("MD5")
        through = spark._jvm.java.security.DigestInputStream(stream, digest)
        spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(through, spark._jvm.java.io.OutputStream.nullOutputStream(), BLOCK, True)
        rows.append((name, length, "".join(f"{b % 256:02x}" for b in digest.digest())))
    return spark.createDataFrame(rows, "path string, length long, md5 string")


def write_fold(df: DataFrame, folder: str, run_id: int, fold: int, source_hash: str, allocation_hash: str = "") -> None:
    """One fold's results, with the hashes of the table and of the allocation of users that they rest on."""
    df.withColumns({"source_hash": F.lit(source_hash), "allocation_hash": F.lit(allocation_hash)}).write.mode("overwrite").parquet(f"{folder}/run={run_id}/fold={fold}")


def read_folds(spark: SparkSession, folder: str, run_id: int, source_hash: str | None = None, allocation_hash: str | None = None) -> DataFrame:
    """The folds written so far that rest on the table and allocation named; :func:`verify_folds` fails where others are there."""
    df = spark.read.option("basePath", f"{folder}/run={run_id}").parquet(f"{folder}/run={run_id}")
    for name, want in (("source_hash", source_hash), ("allocation_hash", allocation_hash)):
        if want is not None:
            df = df.filter(F.col(name) == want)
    return df


def verify_folds(spark: SparkSession, folder: str, run_id: int, source_hash: str, allocation_hash: str = "") -> None:
    """Fails if a fold rests on another table or allocation."""
    same = (F.col("source_hash") == source_hash) & (F.col("allocation_hash") == allocation_hash)
    other = [r[0] for r in read_folds(spark, folder, run_id).filter(~same).select("fold").distinct().orderBy("fold").collect()]
    if other:
        raise ValueError(f"folds {other} rest on another table or allocation")


def done_folds(spark: SparkSession, folder: str, run_id: int, source_hash: str, allocation_hash: str = "") -> list[int]:
    """The folds that a resumed run can skip, none if nothing is written yet; fails like :func:`verify_folds`."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/run={run_id}")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return []
    verify_folds(spark, folder, run_id, source_hash, allocation_hash)
    return [r[0] for r in read_folds(spark, folder, run_id).select("fold").distinct().orderBy("fold").collect()]
