"""Tables that are published version by version, of which only what a merge changes is written again.

Rows lie in buckets of a hash of their key. A version is a folder of its own that holds the buckets it changed, and a small
pointer file says in which version's folder each bucket is to be read. The pointer is replaced by one atomic rename after
all data are written: readers see the version before or the new one whole, and a write that fails leaves the one before.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import new_folder

POINTER = "_newest"
#: Buckets of a table, fixed when it is first published.
BUCKETS = 64


def _pointer(spark: SparkSession, folder: str) -> dict | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder, POINTER)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    stream = fs.open(path)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _point(spark: SparkSession, folder: str, state: dict) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    new, old = (jvm.org.apache.hadoop.fs.Path(folder, n) for n in (f"{POINTER}.{state['version']}", POINTER))
    stream = new.getFileSystem(conf).create(new, True)
    try:
        stream.write(bytearray(json.dumps(state).encode()))
    finally:
        stream.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.getFileSystem(conf).getUri(), conf).rename(new, old, how)


def version(spark: SparkSession, folder: str) -> str | None:
    """The version that readers see, None before the first."""
    state = _pointer(spark, folder)
    return state["version"] if state else None


def _read(spark: SparkSession, folder: str, state: dict, only: Sequence[int] | None = None) -> DataFrame:
    schema = T.StructType.fromJson(state["schema"])
    homes: dict[str, list[int]] = {}
    for bucket, home in state["homes"].items():
        if only is None or int(bucket) in only:
            homes.setdefault(home, []).append(int(bucket))
    out = spark.createDataFrame([], schema)
    for home in sorted(homes):  # columns that an older version lacks are nulls
        out = out.union(spark.read.schema(schema).parquet(*[f"{folder}/{home}/bucket={b}" for b in sorted(homes[home])]))
    return out


def read_newest(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the newest version. What was read stays readable: versions are never written over."""
    state = _pointer(spark, folder)
    if state is None:
        raise FileNotFoundError(f"{folder}/{POINTER}")
    return _read(spark, folder, state)


def _dealt(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """The rows with their bucket, after one shuffle: a bucket lies in a few tasks, and a slice of its keys whole in one."""
    slices = -(-int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // buckets)
    return df.withColumns({"bucket": bucket_of(key, buckets), "_slice": F.pmod(F.hash(key), F.lit(slices))}).repartition("bucket", "_slice")


def _write(rows: DataFrame, folder: str, stamp: str) -> list[int]:
    """Write rows that are dealt to buckets as a version; the buckets, of which there is one entry each."""
    at = f"{folder}/{stamp}"
    rows.drop("_slice").write.mode("overwrite").partitionBy("bucket").parquet(at)
    from .files import listed

    return sorted(int(n.removeprefix("bucket=")) for n in listed(rows.sparkSession, at) if n.startswith("bucket="))


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def newest(df: DataFrame, key: str, time: str, ties: Sequence[str] = (), near: Sequence[str] = ()) -> DataFrame:
    """One row for each key: that of the latest time, null times last, then of the least ties; all of its columns.

    Rows without a key are left out. This is an aggregate that tasks begin before the shuffle, so a key that holds very many
    rows costs no task more than others, and newest(newest(a) + b) is newest(a + b). ``near`` are columns that the key
    decides; where rows lie together by them already, as after a join, they are not shuffled again.
    """
    late = F.coalesce(-F.unix_micros(F.col(time).cast("timestamp")), F.lit(2**63 - 1))
    row = F.struct(*[F.col(c) for c in df.columns if c not in near])
    best = df.where(F.col(key).isNotNull()).groupBy(*near, key).agg(F.min_by(row, F.struct(late, *[F.col(t) for t in ties])).alias("_row"))
    return best.select(*near, "_row.*").select(*df.columns)


def publish(df: DataFrame, folder: str, stamp: str, key: str, buckets: int = BUCKETS) -> None:
    """Write all rows as version ``stamp`` and point to it. Rows are computed once."""
    spark = df.sparkSession
    state = _pointer(spark, folder)
    _new(state, stamp)
    homes = {str(b): stamp for b in _write(_dealt(df, key, buckets), folder, stamp)}
    _point(spark, folder, {"version": stamp, "buckets": buckets, "key": key, "schema": df.schema.jsonValue(), "homes": homes})


def merge(scrape: DataFrame, folder: str, stamp: str, key: str, time: str, ties: Sequence[str] = (), buckets: int = BUCKETS, unique: bool = False) -> int:
    """Bring a scrape into the published table, newest row of each key first, as version ``stamp``; the number of buckets
    that were written.

    Only buckets that the scrape has keys of are read and written; the pointer takes the others over where they are. The
    result has the rows of newest() over all scrapes so far, in whatever order they came. Columns that only one side has
    are null on the other. Rows that are invalid but newest stay, for a product that became invalid must not come back;
    readers filter. There is one writer at a time. An empty scrape writes no bucket, and into no table makes an empty one.

    Of a ``unique`` scrape there is one row for each key already. Both sides are so when they meet: a key has two rows at
    most, and they are shuffled once, by bucket.
    """
    spark = scrape.sparkSession
    state = _pointer(spark, folder)
    _new(state, stamp)
    fresh = scrape.where(F.col(key).isNotNull()) if unique else newest(scrape, key, time, ties)
    if state is None:
        publish(fresh, folder, stamp, key, buckets)
        return len(_pointer(spark, folder)["homes"])
    if state["key"] != key:
        raise ValueError(f"{folder} is kept by {state['key']}, not by {key}")
    at = new_folder(spark, "scrape")  # computed once, and packed
    fresh = fresh.withColumn("bucket", bucket_of(key, state["buckets"]))
    fresh.write.parquet(at)
    written = spark.read.schema(fresh.schema).parquet(at)
    touched = {r[0] for r in written.select("bucket").distinct().collect()}  # numbers of buckets
    both = _read(spark, folder, state, touched).unionByName(written.drop("bucket"), allowMissingColumns=True)
    rows = newest(_dealt(both, key, state["buckets"]), key, time, ties, near=["bucket", "_slice"])
    changed = _write(rows, folder, stamp) if touched else []
    _point(spark, folder, state | {"version": stamp, "schema": both.schema.jsonValue(), "homes": state["homes"] | {str(b): stamp for b in changed}})
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(changed)


def _new(state: dict | None, stamp: str) -> None:
    if state and (stamp == state["version"] or stamp in state["homes"].values()):
        raise ValueError(f"version {stamp} is published already")


def changes(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change, old_<value>, new_<value>) of every key of either table, unique in each: new, changed, same or gone."""
    a, b = (df.select(F.col(key), F.lit(True).alias(f"_{side}"), F.col(value).alias(f"{side}_{value}")) for side, df in (("old", before), ("new", after)))
    both = a.join(b, key, "full")
    same = F.col(f"old_{value}").eqNullSafe(F.col(f"new_{value}"))
    kind = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "gone").when(same, "same").otherwise("changed")
    return both.select(key, kind.alias("change"), f"old_{value}", f"new_{value}")
