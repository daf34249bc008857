"""What the operators of this subpackage share: reading tables, shared storage for cut lineage, and row identity."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; on a local master one of our own if unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not (sc.master or "").startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="martlens-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows from reliable shared storage: lineage ends here, and a lost executor costs no recomputation before it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bound of an Arrow batch where the session has none of its own but Spark's default of 64 MB.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lets batches that go to Python workers hold at most BATCH_BYTES: a task has a batch in the JVM's direct memory, in the
    worker, and as what the worker makes of it, all at once. A bound that the session has set stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) in ("64MB", "67108864b", "67108864"):
        spark.conf.set(name, str(BATCH_BYTES))


def row_keys(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a column that tells its rows apart, and that column's name: doc_id itself where it does.

    If ids repeat or lack, rows get numbers of their own and are written out, so that all that follows sees the same ones.
    """
    if docs.groupBy("doc_id").count().where("doc_id is null or count > 1").isEmpty():
        return docs, "doc_id"
    key = free_name(docs, "row_key")
    return cut(docs.withColumn(key, F.monotonically_increasing_id())), key


class WrittenTables:
    """Parquet tables in the shared folder for one computation; leaving the context deletes them.

    Unlike a checkpoint they are compressed and can be dropped, whole or by partition, as soon as nothing needs them.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"

    def __enter__(self) -> WrittenTables:
        return self

    def __exit__(self, *_) -> None:
        self.drop("")

    def write(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """The rows of df, read back from a table; with ``by`` a folder for each value of that column."""
        writer = df.write.partitionBy(by) if by else df.write
        writer.parquet(f"{self.folder}/{name}")
        schema = df.schema if by is None else df.drop(by).schema.add(df.schema[by])
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    def drop(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}".rstrip("/"))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def held_out(doc_id: str = "doc_id"):
    """Whether a row is kept from learning: crc32 of the id as text, modulo 5, is 0. A null id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def free_name(df: DataFrame, name: str) -> str:
    """The name, or one made from it, that no column of df has, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Copies of a row that each_copy makes at a time.
CHUNK = 4096


def each_copy(rows: DataFrame, times: str, index: str, parts: int | None = None) -> DataFrame:
    """Every row as often as its column ``times`` says, with the copies numbered from 0 in ``index`` and ``times`` dropped.

    Copies are made CHUNK at a time; with ``parts`` these are dealt to so many tasks, as rows of very many copies need.
    """
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col(times) - 1, F.lit(CHUNK).cast("long")))
    chunks = rows.withColumn(index, first)
    if parts is not None:
        chunks = chunks.repartition(parts, *chunks.columns)
    last = F.least(F.col(times), F.col(index) + CHUNK) - 1
    return chunks.withColumn(index, F.explode(F.sequence(F.col(index), last))).drop(times)
