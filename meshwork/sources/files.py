"""CSV, TSV, Parquet, JSON and NPY files as DataFrames, and back."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class LoadError(ValueError):
    """A file that doesn't fit the table."""


def format_of(path: str, given: str | None = None) -> str:
    if given:
        return given.lower()
    name = path.rstrip("/").lower().removesuffix(".gz")
    for ending, kind in ((".csv", "csv"), (".tsv", "csv"), (".txt", "csv"), (".parquet", "parquet"), (".json", "json"), (".jsonl", "json"), (".ndjson", "json"), (".orc", "orc"), (".npy", "npy")):
        if name.endswith(ending):
            return kind
    return "parquet"


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None, options: dict[str, Any]) -> DataFrame:
    """Strict: a row with too few or too many fields, or a value that doesn't fit its type, raises. Fields are trimmed;
    empty ones and `null` are null."""
    sep = options.get("delim") or options.get("sep") or ("\t" if ".tsv" in path.lower() else ",")
    header = options.get("header", True)
    r = spark.read.option("sep", sep).option("header", bool(header)).option("quote", options.get("quote", '"')).option("escape", options.get("escape", '"')).option("multiLine", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).option("mode", "FAILFAST").option("enforceSchema", True)
    if schema is None:
        df = r.option("inferSchema", True).csv(path)
    else:
        raw = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
        df = r.schema(raw).csv(path)
    clean = [F.when(~F.lower(F.col(f"`{f.name}`")).isin("", "null"), F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in df.schema]
    df = df.select(*clean)
    return df if schema is None else typed(df, schema)


def typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df's text columns as schema's types; lists, maps and structs are read as JSON."""

    def cast(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            return F.from_json(c, f.dataType).alias(f.name)
        return c.cast(f.dataType).alias(f.name)

    return df.select(*map(cast, schema))


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """(row, values): the rows of NumPy arrays of any dimension, each flattened. Files are read where they lie."""
    import numpy as np
    import pandas as pd

    def parse(batches):
        import io

        for b in batches:
            for content in b["content"]:
                a = np.load(io.BytesIO(content), allow_pickle=False)
                a = a.reshape(len(a), -1).astype(float) if a.ndim else a.reshape(1, 1).astype(float)
                for at in range(0, len(a), 4096):
                    part = a[at : at + 4096]
                    yield pd.DataFrame({"row": range(at, at + len(part)), "values": list(part)})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, "row long, values array<double>")


def read(spark: SparkSession, path: str, options: dict[str, Any] | None = None, schema: T.StructType | None = None) -> DataFrame:
    options = options or {}
    kind = format_of(path, options.get("format"))
    if kind == "csv":
        return read_csv(spark, path, schema, options)
    if kind == "npy":
        return read_npy(spark, path)
    if kind == "json":
        r = spark.read.option("mode", "FAILFAST").option("multiLine", not path.lower().removesuffix(".gz").endswith(("jsonl", "ndjson")) if "multiline" not in options else bool(options["multiline"]))
        return (r.schema(schema) if schema else r).json(path)
    df = spark.read.format(kind).load(path)
    if schema is not None:
        missing = [f.name for f in schema if f.name not in df.columns]
        if missing:
            raise LoadError(f"{path} has no column {missing[0]}")
        df = df.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema))
    return df


def write(df: DataFrame, path: str, options: dict[str, Any] | None = None) -> None:
    options = options or {}
    kind = format_of(path, options.get("format"))
    w = df.write.mode("overwrite")
    if kind == "csv":
        nested = [f.name for f in df.schema if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
        df.withColumns({c: F.to_json(F.col(f"`{c}`")) for c in nested}).write.mode("overwrite").option("header", bool(options.get("header", True))).option("sep", options.get("delim", ",")).option("escape", '"').csv(path)
    else:
        w.format(kind).save(path)
