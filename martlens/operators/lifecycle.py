"""Model registry as a table of versions (name, version, stage, created_at): every change is a function of that table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import STAGES


def latest(versions: DataFrame) -> DataFrame:
    return versions.groupBy("name").agg(F.max("version").alias("version"), F.max_by("stage", "version").alias("stage"))


def register(versions: DataFrame, new: DataFrame) -> DataFrame:
    """new (name, created_at) gets the next versions, stage None."""
    last = versions.groupBy("name").agg(F.max("version").alias("_v"))
    order = Window.partitionBy("name").orderBy("created_at")
    rows = new.join(last, "name", "left").select("name", (F.coalesce("_v", F.lit(0)) + F.row_number().over(order)).cast("int").alias("version"), F.lit("None").alias("stage"), "created_at")
    return versions.unionByName(rows)


def transition(versions: DataFrame, name, version: int, stage: str, archive_existing: bool = False) -> DataFrame:
    """A version moved to a stage, the stage's other versions archived if asked for; an unknown stage is an error."""
    if stage not in STAGES:
        raise ValueError(f"stage must be one of {', '.join(STAGES)}")
    mine = (F.col("name") == name) & (F.col("version") == version)
    moved = F.when(mine, stage)
    if archive_existing:
        moved = moved.when((F.col("name") == name) & (F.col("stage") == stage), "Archived")
    return versions.withColumn("stage", moved.otherwise(F.col("stage")))


def promote(versions: DataFrame) -> DataFrame:
    """For each model the latest Staging version goes to Production and, where there is one, the latest Production version to Archived."""
    w = Window.partitionBy("name")
    at = lambda s: F.max(F.when(F.col("stage") == s, F.col("version"))).over(w)
    v = versions.withColumn("_s", at("Staging")).withColumn("_p", at("Production"))
    stage = F.when(F.col("version") == F.col("_s"), "Production").when(F.col("_s").isNotNull() & (F.col("version") == F.col("_p")), "Archived").otherwise(F.col("stage"))
    return v.withColumn("stage", stage).drop("_s", "_p")


def keep_last(versions: DataFrame, n: int = 3) -> DataFrame:
    """All but the last n versions of each model are Archived."""
    i = F.row_number().over(Window.partitionBy("name").orderBy(F.col("version").desc()))
    return versions.withColumn("stage", F.when(i > n, "Archived").otherwise(F.col("stage")))


def serving(versions: DataFrame, stage: str = "Production") -> DataFrame:
    """(name, uri) of the latest version in a stage, `local` where a model has none."""
    found = versions.groupBy("name").agg(F.max(F.when(F.col("stage") == stage, F.col("version"))).alias("v"))
    return found.select("name", F.coalesce(F.concat(F.lit("models:/"), F.col("name").cast("string"), F.lit("/"), F.col("v").cast("string")), F.lit("local")).alias("uri"))


def transitions(versions: DataFrame, moves: DataFrame) -> DataFrame:
    """transition for many models at once; moves has (name, version, stage, archive_existing), one row for a name at most."""
    to = moves.select("name", F.col("version").alias("_v"), F.col("stage").alias("_s"), F.col("archive_existing").alias("_a"))
    rows = versions.join(to, "name", "left")
    stage = F.when(F.col("version") == F.col("_v"), F.col("_s")).when(F.col("_a") & (F.col("stage") == F.col("_s")), "Archived").otherwise(F.col("stage"))
    return rows.withColumn("stage", stage).select(*versions.columns)


def archive(versions: DataFrame, name, version: int) -> DataFrame:
    return transition(versions, name, version, "Archived")


def backfill(versions: DataFrame, new: DataFrame) -> DataFrame:
    """Existing models (name, created_at) registered as next versions and moved to Staging."""
    rows = register(versions, new)
    mine = new.groupBy("name").agg(F.count("*").alias("_k"))
    last = rows.groupBy("name").agg(F.max("version").alias("_last"))
    rows = rows.join(last.join(mine, "name"), "name", "left")
    fresh = F.col("version") > F.col("_last") - F.col("_k")
    return rows.withColumn("stage", F.when(fresh, "Staging").otherwise(F.col("stage"))).select(*versions.columns)


def models(versions: DataFrame) -> DataFrame:
    """(name, latest_version, production_version, staging_version) of every model; null where no version is in the stage."""
    at = lambda s: F.max(F.when(F.col("stage") == s, F.col("version")))
    return versions.groupBy("name").agg(F.max("version").alias("latest_version"), at("Production").alias("production_version"), at("Staging").alias("staging_version"))


def details(versions: DataFrame, wanted: DataFrame) -> DataFrame:
    """The versions asked for: wanted has (name, version), a null version stands for the latest one."""
    last = versions.groupBy("name").agg(F.max("version").alias("_last"))
    asked = wanted.join(last, "name").select("name", F.coalesce("version", "_last").alias("version")).distinct()
    return versions.join(asked, ["name", "version"])


INPUT_SCHEMA = '{"type":"object","properties":{"text":{"type":"string"}},"required":["text"]}'
OUTPUT_SCHEMA = '{"type":"object","properties":{"prediction":{"type":"integer"},"probability":{"type":"number"},"label":{"type":"string"}}}'


def serving_config(wanted: DataFrame) -> DataFrame:
    """(model_uri, model_name, version, framework, input_schema, output_schema) of (name, version); a null version stands for
    the one in production."""
    name, version = F.col("name").cast("string"), F.col("version").cast("string")
    uri = F.concat_ws("/", F.lit("models:"), name, version)
    return wanted.select(uri.alias("model_uri"), name.alias("model_name"), F.coalesce(version, F.lit("production")).alias("version"), F.lit("mlflow").alias("framework"), F.lit(INPUT_SCHEMA).alias("input_schema"), F.lit(OUTPUT_SCHEMA).alias("output_schema"))


def info(versions: DataFrame) -> DataFrame:
    """(name, version, stage) that a service reports: the production version, ``local`` where there is none."""
    found = models(versions)
    has = F.col("production_version").isNotNull()
    return found.select("name", F.when(has, F.col("production_version").cast("string")).otherwise("local").alias("version"), F.when(has, "Production").otherwise("None").alias("stage"))


def log_metrics(log: DataFrame, new: DataFrame) -> DataFrame:
    """The metrics table (run_id, key, value, step) with new rows."""
    return log.unionByName(new.select(*log.columns))


def last_metrics(log: DataFrame) -> DataFrame:
    """(run_id, key, value, step): the value of the highest step of each run's metrics, of equal steps the largest."""
    return log.groupBy("run_id", "key").agg(F.max(F.struct("step", "value")).alias("m")).select("run_id", "key", F.col("m.value").alias("value"), F.col("m.step").alias("step"))


def run_by_tag(runs: DataFrame, tag: str, value: str) -> DataFrame:
    """The newest run whose tags map has that value; none if there is none."""
    return runs.where(F.try_element_at("tags", F.lit(tag)) == value).orderBy(F.col("start_time").desc(), F.col("run_id").desc()).limit(1)
