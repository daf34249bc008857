"""Files in and out: newest CSV of a source, JSON, samples and filtered outputs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def listed(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, none if it is not there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV file in UTF-8, or in Latin-1 if its bytes are not UTF-8 (they then show as replacement characters); a byte
    order mark before the first value goes."""
    read = lambda encoding: spark.read.schema(schema).csv(path, header=True, encoding=encoding, multiLine=True, escape='"')
    rows = read("utf-8")
    strings = [f.name for f in schema.fields if isinstance(f.dataType, T.StringType)]
    broken = F.lit(False)
    for c in strings:
        broken = broken | F.coalesce(F.contains(F.col(c), F.lit("\ufffd")), F.lit(False))
    return read("iso-8859-1") if rows.where(broken).limit(1).count() else rows


def newest_csv(spark: SparkSession, folder: str, source: str, schema: T.StructType) -> DataFrame:
    """The rows of ``<source>_latest.csv`` if there is one, else of the last ``<source>_products_*.csv`` by name, else none."""
    names = listed(spark, folder)
    dated = sorted(n for n in names if n.startswith(f"{source}_products_") and n.endswith(".csv"))
    chosen = f"{source}_latest.csv" if f"{source}_latest.csv" in names else dated[-1] if dated else None
    return read_csv(spark, f"{folder}/{chosen}", schema) if chosen else spark.createDataFrame([], schema)


def read_required(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV that has to be there."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return read_csv(spark, path, schema)


def read_or_empty(spark: SparkSession, paths: Mapping[str, tuple[str, T.StructType]]) -> dict[str, DataFrame]:
    """Several CSVs by name; one that is not there is an empty table of its schema."""
    return {name: read_csv(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema) for name, (path, schema) in paths.items()}


def read_features(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """A table of features and its number of rows."""
    rows = spark.read.parquet(path)
    return rows, rows.count()


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_sample(df: DataFrame, key: str, path: str, rows: int = 100) -> None:
    write_csv(df.orderBy(key).limit(rows), path)


def write_fakes(predictions: DataFrame, path: str) -> None:
    write_csv(predictions.where("is_fake"), path)


def write_versioned(df: DataFrame, folder: str, stamp: str) -> None:
    """The newest copy and one under a time stamp, which is what was computed. ``sources.published`` has versions that
    readers never see half written."""
    df.write.mode("overwrite").parquet(f"{folder}/{stamp}")
    df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{stamp}").write.mode("overwrite").parquet(f"{folder}/latest")


def write_csv_with_bom(df: DataFrame, path: str) -> None:
    """CSV files that begin with a byte order mark, as spreadsheets ask for; it goes before the header's first name."""
    first, *others = df.columns
    write_csv(df.select(F.col(first).alias("\ufeff" + first), *others), path)


def with_bom_removed(df: DataFrame) -> DataFrame:
    """Column names without the byte order mark that some shops write."""
    return df.toDF(*[c.removeprefix("﻿") for c in df.columns])


def as_json_records(df: DataFrame) -> DataFrame:
    """Records as JSON strings; nulls and NaN are left out."""
    plain = [F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    return df.select(F.to_json(F.struct(*plain)).alias("record"))


def as_json_arrays(df: DataFrame, key: str, records: int = 1000) -> DataFrame:
    """(part, array): the records in the order of a numeric key, as JSON arrays of a bounded number of records."""
    from ..operators.catalog import with_ids

    plain = [F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    rows = with_ids(df.select(key, F.struct(*plain).alias("record")), key, "_i", "%d").select(F.floor((F.col("_i").cast("long") - 1) / records).alias("part"), F.col("_i").cast("long").alias("i"), "record")
    listed = rows.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("i", "record"))).alias("x"))  # at most that many records
    return listed.select("part", F.to_json(F.transform("x", lambda x: x["record"])).alias("array"))


def write_matches(matches: DataFrame, unmatched: Mapping[str, DataFrame], folder: str) -> None:
    """Matches and the rows of either side without one; without any match these are empty files with headers."""
    write_csv(matches, f"{folder}/price_comparison")
    for name, df in unmatched.items():
        write_csv(df, f"{folder}/unmatched_{name}")


def report(tables: Mapping[str, DataFrame], rows: int = 50) -> str:
    """A text report of small tables of aggregates, at most ``rows`` of each; NaN and nulls show as dashes."""
    lines = []
    for title, df in tables.items():
        lines += [title, "-" * len(title), "\t".join(df.columns)]
        lines += ["\t".join("-" if v is None or v != v else str(v) for v in r) for r in df.limit(rows).collect()]
        lines.append("")
    return "\n".join(lines)


def statistics_json(tables: Mapping[str, DataFrame], rows: int = 1000) -> str:
    """The same as a JSON object of lists of records."""
    import json

    return json.dumps({name: [json.loads(r[0]) for r in as_json_records(df.limit(rows)).collect()] for name, df in tables.items()}, ensure_ascii=False)
