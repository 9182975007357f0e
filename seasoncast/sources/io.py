"""Delimited scans and sinks, forecast files and the spec store.

Paths are parameters (D3).  Scratch output goes under the shared checkpoint
folder named by ``spark.checkpoint.dir`` — never a machine-local folder.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seasoncast.session import scratch_folder


def scratch_path(spark: SparkSession, name: str) -> str:
    return scratch_folder(spark, f"seasoncast-{name}")


# Quotes inside a field are doubled, as spreadsheet and data-frame tools write them; blanks belong to the field.
_FIELDS = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def read_delimited(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
                   sep: str = ";", header: bool = True, multi_line: bool = True, malformed: str = "FAILFAST") -> DataFrame:
    """Delimited scan with an explicit schema.

    Fields may be quoted, hold doubled quotes, separators and line breaks.  A
    file is then one task; ``multi_line=False`` lets Spark split large files
    that are known to have no line break in a field.  Rows that don't fit the
    schema stop the read; ``malformed`` takes Spark's other modes.
    """
    r = spark.read.options(sep=sep, header=header, multiLine=multi_line, mode=malformed, **_FIELDS)
    if schema is not None:
        r = r.schema(schema)
    return r.csv(path)


def write_delimited(df: DataFrame, path: str, sep: str = ";", header: bool = True,
                    mode: str = "overwrite") -> str:
    """CSV sink without an index column (S3); one file per partition, quoted where :func:`read_delimited` needs it."""
    df.write.mode(mode).options(sep=sep, header=header, **_FIELDS).csv(path)
    return path


def read_forecasts(spark: SparkSession, path: str | list[str], sep: str = ",", key: str = "ID",
                   value: str = "Production") -> DataFrame:
    """Forecast file -> ``(ID, Production)``, header names matched case-insensitively.

    ``path`` may be a list of candidate locations tried in order (the first one
    that exists is read)."""
    from pyspark.errors import AnalysisException
    candidates = [path] if isinstance(path, str) else list(path)
    df = None
    for p in candidates:
        try:
            df = read_delimited(spark, p, sep=sep, multi_line=False)
            path = p
            break
        except AnalysisException:
            continue
    if df is None:
        raise FileNotFoundError(f"none of the forecast paths exist: {candidates}")
    names = {c.lower(): c for c in df.columns}
    if key.lower() not in names or value.lower() not in names:
        raise ValueError(f"{path} has columns {df.columns}; {key} and {value} are needed")
    return df.select(F.col(f"`{names[key.lower()]}`").cast("long").alias(key),
                     F.col(f"`{names[value.lower()]}`").cast("double").alias(value))


def write_bucketed(df: DataFrame, path: str, key: str = "ID", buckets: int = 16) -> str:
    """A table in ``buckets`` hash buckets of ``key``, sorted inside.

    Tables written with the same key and number of buckets join and aggregate on
    the key without an exchange.  The layout is stored beside the data.
    """
    spark, name = df.sparkSession, f"bucketed_{uuid.uuid4().hex}"
    (df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key)
     .option("path", f"{path}/data").saveAsTable(name))
    spark.sql(f"DROP TABLE {name}")  # an external table: the files stay
    layout = [(key, buckets, df.schema.json())]
    save_spec(spark.createDataFrame(layout, "key string, buckets int, schema string").coalesce(1), path, "layout")
    return path


def read_bucketed(spark: SparkSession, path: str) -> DataFrame:
    """A table of :func:`write_bucketed` with its layout, in any session."""
    key, buckets, schema = load_spec(spark, path, "layout").first()
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in T.StructType.fromJson(json.loads(schema)).fields)
    name = f"bucketed_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{path}/data'")
    return spark.table(name)


def save_spec(spec: DataFrame, root: str, name: str) -> str:
    """Persist a fitted spec under its own name (S4, D10): Parquet, overwrite."""
    path = f"{root.rstrip('/')}/{name}"
    spec.write.mode("overwrite").parquet(path)
    return path


def load_spec(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Load a spec written by ``save_spec``."""
    return spark.read.parquet(f"{root.rstrip('/')}/{name}")
