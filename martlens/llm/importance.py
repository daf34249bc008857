"""Importance resampling towards a target distribution, over hashed n-grams from a position table.

Every text is turned into a table of positions: ``posexplode`` gives each word a row, and a window over a document's rows
takes the words that follow with ``lead``, so a row knows the n-grams of each order that start at it. Features fall into
a fixed number of buckets by CRC-32. The counts of a bucket in the corpus and in the target give its gain, the logarithm
of how much more of the target falls into it; a document's weight is the sum of gains over its features. Weights with
seeded Gumbel noise are drawn from the top, which is sampling without replacement in proportion to exp(weight).

A document's rows stay in the partition that its text was sent to: text is shuffled once, and words never are. Their
buckets are written out once, for they are needed again when gains are known. Gains have one row for each bucket and
are broadcast. Ranks come from a range partitioning whose parts count their own rows, so no task sees all documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WrittenTables, cut

ORDERS, BUCKETS, SEED, LEAST_WORDS, PERCENT = 3, 10_000, 42, 20, 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs of ASCII characters that belong to no word; A-Z are lower-cased, so they do.
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def position_table(texts: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """(key, doc_id, b1, b2, ...): for each word of texts (doc_id, text) the buckets of the n-grams that start at it.

    key tells rows of texts apart. bN is null where fewer than N words are left. A text without words, or null, has one
    row without buckets.
    """
    keyed = texts.select(F.monotonically_increasing_id().alias("key"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # sorted before words are taken apart: the window's sort then meets one ascending run
    placed = keyed.repartition("key").sortWithinPartitions("key")
    words = placed.select("key", "doc_id", F.posexplode(F.split("text", _BETWEEN)).alias("pos", "w")).where("w <> '' or pos = 0")
    lowered = F.when(F.col("w").rlike("[A-Z]"), F.translate("w", _UPPER, _LOWER)).when(F.col("w") != "", F.col("w"))
    words = words.select("key", "doc_id", "pos", lowered.alias("w0"))
    here = Window.partitionBy("key").orderBy("pos")
    ahead = words.select("key", "doc_id", "w0", *[F.lead("w0", i).over(here).alias(f"w{i}") for i in range(1, orders)])
    spaced = lambda n: F.concat(*[c for i in range(n) for c in (F.lit(" "), F.col(f"w{i}"))][1:])  # noqa: E731  null if one is
    return ahead.select("key", "doc_id", *[(F.crc32(spaced(n).cast("binary")) % buckets).cast("int").alias(f"b{n}") for n in range(1, orders + 1)])


def _counted(positions: DataFrame, orders: int) -> DataFrame:
    """(bucket, n) of all features."""
    return positions.select(F.explode(F.array(*[f"b{n}" for n in range(1, orders + 1)])).alias("bucket")).where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of every bucket from the counts (bucket, n) of both sides, in thousandths of a natural logarithm, rounded down."""
    spark = corpus.sparkSession
    counts = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0, ["s", "t"])
    counts = cut(counts)  # as many rows as there are buckets
    total = counts.agg(F.coalesce(F.sum("s"), F.lit(0)).cast("double"), F.coalesce(F.sum("t"), F.lit(0)).cast("double")).first()
    d = lambda c: F.col(c).cast("double")
    ratio = (d("t") + 1) * F.lit(total[0] + buckets) / ((d("s") + 1) * F.lit(total[1] + buckets))
    return counts.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain"))


def noise(doc_id: str, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, rounded down, from the first 32 bits of a digest of seed and id; a null id counts as an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def with_ranks(rows: DataFrame, order: list[Column], rank: str = "rank") -> DataFrame:
    """Rows of a written table with their number in the order, from 1: each part of a range partitioning numbers its own
    rows and starts after the rows of those before it. The order must tell rows apart, so that any run of them can be cut."""
    placed = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33).alias("_part")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    starts = placed.groupBy(part).agg(F.count("*").alias("n")).select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    numbered = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return numbered.withColumn(rank, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_part", "_at", "_before")


def importance_resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, orders: int = ORDERS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of docs (doc_id, text), weighed towards the texts of target (text).

    Words are runs of digits, letters a-z (A-Z are lower-cased) and characters beyond ASCII. weight sums the gains of the
    n-grams of up to ``orders`` words, score adds noise, and rank numbers the ``percent`` of 100 documents drawn, by
    falling score, among those of at least ``least_words`` words; equal scores go to the smaller id, a null id last, then
    to fewer features. It is null for others. A text that is null or has no words has no features and weight 0. Repeated
    rows and null ids are documents like others; an empty target gives gains of its smoothing alone; other columns are
    ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    buckets_of = [f"b{n}" for n in range(1, orders + 1)]
    with WrittenTables(spark) as tables:
        positions = tables.write(position_table(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), orders, buckets), "positions")
        wanted = position_table(target.select(F.lit(0).cast("long").alias("doc_id"), "text"), orders, buckets)
        gains = cut(bucket_gains(_counted(positions, orders), _counted(wanted, orders), buckets))
        gained = positions
        for n, b in enumerate(buckets_of):
            gained = gained.join(F.broadcast(gains.select(F.col("bucket").alias(b), F.col("gain").alias(f"g{n}"))), b, "left")
        total = sum((F.coalesce(F.col(f"g{n}"), F.lit(0)) for n in range(orders)), F.lit(0).cast("long"))
        some = sum((F.col(b).isNotNull().cast("long") for b in buckets_of), F.lit(0).cast("long"))
        each = gained.groupBy("key", "doc_id").agg(F.sum(total).alias("weight"), F.sum(some).alias("n_features"), F.count(buckets_of[0]).alias("n_words"))
        scored = cut(each.withColumn("score", F.col("weight") + noise("doc_id", seed)).withColumn("able", F.col("n_words") >= least_words))
    drawn = (scored.where("able").count() * percent) // 100
    ranked = with_ranks(scored, [F.col("able").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("key")])
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(F.col("able") & (F.col("rank") <= drawn), F.col("rank")).alias("rank"))


def importance_sql(documents: str, target: str, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> str:
    """DuckDB SQL for importance_resample with three orders over tables with distinct ids; CRC-32 goes by half bytes."""
    steps = []
    for x in range(16):
        for _ in range(4):
            x = (x >> 1) ^ (0xEDB88320 if x & 1 else 0)
        steps.append(x)
    words = lambda t: f"regexp_extract_all(translate(coalesce({t}, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    grams = lambda t, k: " UNION ALL ".join(f"SELECT {k}, array_to_string(w[i:i + {n}], ' ') AS f FROM (SELECT {k}, w, unnest(range(1, len(w) - {n} + 1)) AS i FROM {t})" for n in range(3))
    return f"""
WITH texts AS MATERIALIZED (SELECT doc_id, {words('text')} AS w FROM {documents}), wanted AS (SELECT 0 AS doc_id, {words('text')} AS w FROM {target}),
own AS MATERIALIZED ({grams('texts', 'doc_id')}), theirs AS MATERIALIZED ({grams('wanted', 'doc_id')}),
hexed AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM own UNION SELECT f FROM theirs)),
halves AS (SELECT f, list_transform(range(length(h)), lambda j: CAST(strpos('0123456789ABCDEF', substr(h, j - j % 2 + 2 - j % 2, 1)) - 1 AS BIGINT)) AS x FROM hexed),
buckets AS MATERIALIZED (SELECT f, CAST(xor(list_reduce(list_prepend(4294967295::BIGINT, x), lambda c, n: xor(xor(c, n) >> 4, list_extract({steps}::BIGINT[], (xor(c, n) & 15) + 1))), 4294967295::BIGINT) % {buckets} AS INTEGER) AS b FROM halves),
s AS (SELECT b, count(*) AS s FROM own JOIN buckets USING (f) GROUP BY 1), t AS (SELECT b, count(*) AS t FROM theirs JOIN buckets USING (f) GROUP BY 1),
gains AS (SELECT b, CAST(floor(1000 * ln((CAST(coalesce(t, 0) AS DOUBLE) + 1) * ((SELECT CAST(count(*) AS DOUBLE) FROM own) + {buckets}) / ((CAST(s AS DOUBLE) + 1) * ((SELECT CAST(count(*) AS DOUBLE) FROM theirs) + {buckets})))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (b)),
weights AS (SELECT doc_id, count(*) AS n, CAST(sum(gain) AS BIGINT) AS weight FROM own JOIN buckets USING (f) JOIN gains USING (b) GROUP BY 1),
scored AS (SELECT doc_id, len(w) >= {least_words} AS able, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{seed}:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM texts LEFT JOIN weights USING (doc_id)),
ranked AS (SELECT *, row_number() OVER (ORDER BY able DESC, score DESC, doc_id) AS r FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND r <= (SELECT count(*) FROM scored WHERE able) * {percent} // 100 THEN r END AS rank FROM ranked
"""
