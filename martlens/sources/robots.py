"""What robots.txt files allow: rules are parsed by groups of agents, and a url meets them by its prefixes."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote, unquote, urlparse, urlunparse
from urllib.robotparser import RobotFileParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_RULES = "host string, place int, path string, allow boolean"


def _rule_rows(agent: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for host, text in zip(batch.column("host"), batch.column("text"), strict=True):
                parser = RobotFileParser()
                parser.parse((text.as_py() or "").splitlines())
                group = next((e for e in parser.entries if e.applies_to(agent)), parser.default_entry)
                lines = [] if group is None else group.rulelines
                yield pa.RecordBatch.from_arrays([pa.array([host.as_py()] * len(lines), pa.string()), pa.array(range(len(lines)), pa.int32()), pa.array([r.path for r in lines], pa.string()), pa.array([r.allowance for r in lines], pa.bool_())], ["host", "place", "path", "allow"])

    return run


def parsed_rules(files: DataFrame, agent: str = "*") -> DataFrame:
    """(host, place, path, allow) of the group of rules that is meant for an agent: the first group that names it, or else
    that of all agents; files has (host, text). A null or empty text, or one without such a group, has no rules."""
    return files.select("host", "text").mapInArrow(_rule_rows(agent), _RULES)


@F.arrow_udf(T.StringType())
def _asked(urls: pa.Array) -> pa.Array:
    """The part of a url that rules are about, quoted as they are."""

    def one(url: str) -> str:
        try:
            return quote(urlunparse(("", "", *urlparse(unquote(url))[2:]))) or "/"
        except ValueError:  # no url
            return "/"

    return pa.array([None if u is None else one(u) for u in urls.to_pylist()], pa.string())


def allowed_by_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (url) with ``allowed``: the first rule of the host, by place, whose path begins the url's path and query decides.

    A rule ``*`` is about all urls; without a rule, or a host, a url is allowed. A url joins rules on the host and each of
    its prefixes whose length some rule of the host has, so a host with very many rules costs its urls a join by key, and
    of rules with the same path only the first is looked at.
    """
    first = rules.groupBy("host", F.when(F.col("path") == "*", "").otherwise(F.col("path")).alias("prefix")).agg(F.min("place").alias("place"), F.min_by("allow", "place").alias("allow"))
    lengths = first.groupBy("host").agg(F.collect_set(F.length("prefix")).alias("lengths"))  # no more than a path is long
    asked = urls.select("url").distinct().withColumns({"host": F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), "path": _asked(F.col("url"))})
    tried = asked.join(lengths, "host").select("url", "host", "path", F.explode("lengths").alias("n")).where(F.col("n") <= F.length("path"))
    hit = tried.select("url", "host", F.expr("substring(path, 1, n)").alias("prefix")).join(first, ["host", "prefix"])
    decided = hit.groupBy("url").agg(F.min_by("allow", "place").alias("_allow"))
    return urls.join(decided, "url", "left").withColumn("allowed", F.coalesce("_allow", F.lit(True))).drop("_allow")
