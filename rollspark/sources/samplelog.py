"""The sample log: JSON lines, the only table kept between runs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from rollspark.schemas import METRIC_FIELDS, SAMPLE_FIELDS, SAMPLE_LOG

BROKEN = "broken_line"


def read_lines(reader, schema: T.StructType, path: str, broken: str = "fail") -> DataFrame:
    """JSON lines from a batch or stream reader.

    A line that is no JSON object, as the torn last line of a log that is still
    written: ``fail`` raises when it is read, ``skip`` leaves it out, ``keep`` gives
    a row of nulls with the line in the column ``broken_line``, null in all others.
    """
    modes = {"fail": "FAILFAST", "skip": "DROPMALFORMED", "keep": "PERMISSIVE"}
    if broken not in modes:
        raise ValueError(f"unknown treatment of broken lines {broken!r}")
    if broken == "keep":
        schema = T.StructType([*schema.fields, T.StructField(BROKEN, T.StringType())])
    # Appends under a name of their own are folders in the log's folder.
    reader = reader.option("recursiveFileLookup", "true")
    return reader.schema(schema).option("mode", modes[broken]).option("columnNameOfCorruptRecord", BROKEN).json(path)


def to_log_rows(rows: DataFrame) -> DataFrame:
    """Log columns in log order; a metric the table lacks becomes null, sample columns must exist."""
    metrics = [
        (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in METRIC_FIELDS
    ]
    samples = [F.col(f.name).cast(f.dataType).alias(f.name) for f in SAMPLE_FIELDS]
    return rows.select(*metrics, *samples)


def _publish(spark: SparkSession, staged: str, target: str) -> None:
    """Move a written folder to its place in one step, unless there is one already."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    source, place = jvm.org.apache.hadoop.fs.Path(staged), jvm.org.apache.hadoop.fs.Path(target)
    files = place.getFileSystem(conf)
    if files.exists(place) or not files.rename(source, place):
        files.delete(source, True)


def append_log(rows: DataFrame, path: str | None, commit: str | None = None) -> None:
    """B1. Append to the log folder, one object per line with explicit nulls; no path or no rows, no log.

    ``commit`` names what is appended, say a run and step. It is written aside and moved
    into the log as one folder of that name, so that readers see all of it or nothing, and an append that
    is tried again, after a failure or by mistake, leaves the log as it is.
    """
    if not path:
        return
    spark = rows.sparkSession
    held = to_log_rows(rows).persist()  # samples are few; both looks at them cost one run
    try:
        if held.isEmpty():
            return
        if commit is None:
            held.write.mode("append").option("ignoreNullFields", "false").json(path)
            return
        if "/" in commit or commit[:1] in ("", "_", "."):
            raise ValueError(f"{commit!r} cannot name a part of the log")
        # Readers skip names that begin with an underscore.
        staged = f"{path.rstrip('/')}/_staged-{uuid.uuid4().hex}"
        held.write.option("ignoreNullFields", "false").json(staged)
        _publish(spark, staged, f"{path.rstrip('/')}/{commit}")
    finally:
        held.unpersist()


def read_log(spark: SparkSession, path: str, broken: str = "fail") -> DataFrame:
    """A7. The log with its fixed schema."""
    return read_lines(spark.read, SAMPLE_LOG, path, broken)
