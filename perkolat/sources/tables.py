"""Sources and sinks: typed CSV, JSON lists, CSV in ZIP files, file manifests, keyed sinks that resume."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql import types as T

from perkolat.functions.columns import finite
from perkolat.operators.records import pending


def read_csv(spark: SparkSession, path: str, columns: dict[str, str], missing: str = "-") -> DataFrame:
    """The named columns of a CSV with a header, cast to the types given; a byte order mark is dropped; blanks, `missing`, cells that
    do not parse, NaN and infinities are null."""
    raw = spark.read.csv(path, header=True, inferSchema=False, encoding="UTF-8")
    raw = raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns])
    cell = lambda c: F.when(~F.trim(F.col(c)).isin("", missing), F.trim(F.col(c)))
    typed = [(finite(cell(c).try_cast("double")) if t == "double" else cell(c).try_cast(t)).alias(c) for c, t in columns.items()]
    return raw.select(*typed)


def json_items(df: DataFrame, col: str, item_schema: str, required: list[str]) -> DataFrame:
    """One row for each item of a JSON list whose required fields are all there."""
    out = df.select(F.inline(F.from_json(F.col(col), f"array<struct<{item_schema}>>")))
    for c in required:
        out = out.where(F.col(c).isNotNull())
    return out


def zipped_csv(spark: SparkSession, path: str, skip: str = "{th}") -> DataFrame:
    """(path, member, line_no, line) of the first CSV member, without `skip` in its name, of each ZIP file."""

    def work(batches):
        import io
        import zipfile

        for batch in batches:
            for p, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist()):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    member = next((n for n in z.namelist() if n.lower().endswith(".csv") and skip not in n), None)
                    lines = z.read(member).decode("utf-8-sig").splitlines() if member else []
                yield pa.RecordBatch.from_arrays([pa.array([p] * len(lines), pa.string()), pa.array([member] * len(lines), pa.string()), pa.array(range(len(lines)), pa.int64()), pa.array(lines, pa.string())], ["path", "member", "line_no", "line"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(work, "path string, member string, line_no long, line string")


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of each file."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split(F.translate("path", "\\", "/"), "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def append_new(df: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Append the rows whose key the table at path lacks, so that a job that was cut off can run again; returns the table."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        df = pending(df, spark.read.schema(df.schema).parquet(path), keys)
    df.write.mode("append").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_csv(df: DataFrame, path: str, places: int = 6, mode: str = "errorifexists") -> None:
    """df as CSV files with headers in the folder at path: floating-point numbers to so many places, NaN and infinities as empty cells."""
    cell = lambda f: F.round(finite(F.col(f.name)), places).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
    df.select(*[cell(f) for f in df.schema]).write.mode(mode).csv(path, header=True, emptyValue="")


def not_finite(c: Column, kind: T.DataType) -> Column | None:
    """Whether a NaN or an infinity is anywhere in a value; None for types that cannot hold one."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return c.isNotNull() & finite(c).isNull()
    if isinstance(kind, T.ArrayType):
        return None if not_finite(c, kind.elementType) is None else F.coalesce(F.exists(c, lambda x: F.coalesce(not_finite(x, kind.elementType), F.lit(False))), F.lit(False))
    if isinstance(kind, T.MapType):
        return not_finite(F.map_values(c), T.ArrayType(kind.valueType))
    found = None
    for f in kind.fields if isinstance(kind, T.StructType) else []:
        own = not_finite(c[f.name], f.dataType)
        found = own if found is None else found if own is None else found | own
    return found


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """df as JSON lines in the folder at path, nulls kept. A NaN or an infinity anywhere fails the job, as JSON has neither."""
    out = []
    for f in df.schema:
        bad = not_finite(F.col(f.name), f.dataType)
        out.append((F.col(f.name) if bad is None else F.when(bad, F.raise_error(F.lit(f"{f.name}: not finite")).cast(f.dataType)).otherwise(F.col(f.name))).alias(f.name))
    df.select(*out).write.mode(mode).option("ignoreNullFields", False).json(path)
