"""Document fingerprints: a homomorphic multiset hash of paragraphs, with DataFrame functions only.

Every paragraph (a line, cut further at sentence ends) is hashed to a wide vector and a text's fingerprint is the sum of
these vectors, lane by lane, modulo powers of two. So the order of paragraphs does not count, adding or taking away a
paragraph adds or subtracts its vector, and the fingerprint of two texts put together is the sum of theirs. The lanes:

* the number of paragraphs;
* eight lanes modulo 2^32 from SHA-256, for equality;
* 120 lanes modulo 2^30 that count how many paragraphs have a 1 at one bit of their MD5. Read as sums of +1 and -1 they
  are a sketch of the multiset whose inner products estimate those of the multisets, and so how alike two texts are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, each_copy

DENSE, PACKED = 8, 60
#: Two lanes of 30 bits lie in one long; bits 0 and 30 of a shifted hash are their increments. No text that fits in a row
#: has the 2^30 paragraphs that would carry from one lane into the other.
_BITS = 30
_LANE, _ONES = (1 << _BITS) - 1, 1 | 1 << _BITS
SUMS = ["n", *[f"d{i}" for i in range(DENSE)], *[f"s{i}" for i in range(PACKED)]]


def paragraphs(text: Column) -> Column:
    """The non-blank paragraphs of a text, an array."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), "([.!?])[ \\t]+", "$1\n")
    return F.filter(F.split(marked, "\n"), lambda p: F.trim(p) != "")


def _terms(p: Column) -> tuple[Column, Column]:
    return F.sha2(p.cast("binary"), 256), F.md5(p.cast("binary"))


def _long(hex_digits: Column) -> Column:
    return F.conv(hex_digits, 16, 10).cast("long")


def paragraph_sums(rows: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """(keys..., SUMS) of an array column of paragraphs; keys must tell rows apart."""
    each = rows.select(*keys, F.explode_outer(column).alias("p"))
    sha, md5 = _terms(F.col("p"))
    each = each.select(*keys, "p", sha.alias("sha"), md5.alias("md5"))
    each = each.select(*keys, "p", *[_long(F.substring("sha", 8 * i + 1, 8)).alias(f"d{i}") for i in range(DENSE)], *[_long(F.substring("md5", 15 * i + 1, 15)).alias(f"h{i}") for i in range(2)])
    zero = F.lit(0).cast("long")
    sums = [F.count("p").alias("n"), *[F.coalesce(F.sum(f"d{i}"), zero).bitwiseAND(0xFFFFFFFF).alias(f"d{i}") for i in range(DENSE)]]
    sums += [F.coalesce(F.sum(F.shiftright(f"h{i // _BITS}", i % _BITS).bitwiseAND(_ONES)), zero).alias(f"s{i}") for i in range(PACKED)]
    return each.groupBy(*keys).agg(*sums)


def fingerprint(prefix: str = "") -> Column:
    """The lanes as one hexadecimal string."""
    return F.concat(*[F.lpad(F.lower(F.hex(F.col(prefix + c))), 8 if c[0] in "nd" else 15, "0") for c in SUMS])


def combined(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint of a text with paragraphs inserted (``sign`` 1) or deleted (-1), from its own, a, and theirs, b.

    Lane by lane the sum or difference modulo the lane's power of two, so the order of changes does not count; null if
    either is null.
    """
    widths = [8 if c[0] in "nd" else 15 for c in SUMS]
    out, at = [], 1
    for width in widths:
        x, y = (_long(F.substring(f, at, width)) for f in (a, b))
        at += width
        if width == 8:
            value = (x + y * sign).bitwiseAND(0xFFFFFFFF)
        else:
            low, high = ((F.shiftright(x, s).bitwiseAND(_LANE) + F.shiftright(y, s).bitwiseAND(_LANE) * sign).bitwiseAND(_LANE) for s in (0, _BITS))
            value = low.bitwiseOR(F.shiftleft(high, _BITS))
        out.append(F.lpad(F.lower(F.hex(value)), width, "0"))
    return F.concat(*out)


def likeness_sql(a: str, b: str) -> str:
    """SQL, in Spark and DuckDB, for the cosine of two sketches, from 0 to 1; texts without paragraphs are like each other only."""
    value = lambda p, i, j: f"(2 * (({p}s{i} >> {_BITS * j}) & {_LANE}) - {p}n)"
    total = lambda p, q: " + ".join(f"{value(p, i, j)} * {value(q, i, j)}" for i in range(PACKED) for j in range(2))
    return (
        f"CASE WHEN {' AND '.join(f'{a}{c} = {b}{c}' for c in SUMS)} THEN CAST(1 AS DOUBLE) WHEN {a}n = 0 OR {b}n = 0 THEN CAST(0 AS DOUBLE) "
        f"ELSE greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), CAST({total(a, b)} AS DOUBLE) / sqrt(greatest(CAST(1 AS DOUBLE), CAST({total(a, a)} AS DOUBLE) * CAST({total(b, b)} AS DOUBLE))))) END"
    )


def id_buckets(docs: DataFrame, parts: int) -> Column:
    """A bucket number for doc_id, not null, that falls as doc_id rises: 256 quantiles of the ids, each cut into equal widths."""
    coarse = min(256, parts)
    marks = docs.agg(F.percentile_approx("doc_id", [i / coarse for i in range(coarse + 1)], 10_000)).first()[0] or [0, 0]
    marks = sorted({int(m) for m in marks})
    fine = -(-parts // coarse)
    bounds = F.array(*[F.lit(m).cast("long") for m in marks])
    i = F.greatest(F.lit(1), F.least(F.lit(max(1, len(marks) - 1)), F.size(F.filter(bounds, lambda m: m <= F.col("doc_id")))))
    low, high = F.get(bounds, i - 1), F.coalesce(F.get(bounds, i), F.get(bounds, i - 1))
    step = F.greatest(F.lit(0), F.least(F.lit(fine - 1), F.floor((F.col("doc_id") - low).cast("double") * fine / F.greatest(F.lit(1), high - low).cast("double")))).cast("int")
    return (F.lit(1_000_000_000) - (i * fine + step)).cast("int")


def _followed(rows: DataFrame, values: Sequence[str]) -> DataFrame:
    """Rows (bucket, ord, values...) with next_<value>: those of the row after, and after the last row those of the first."""
    window = Window.partitionBy("bucket").orderBy("ord")
    last = F.lead("ord").over(window).isNull().alias("is_last")
    ahead = rows.select("*", last, *[F.lead(v).over(window).alias(f"_{v}") for v in values])
    heads = rows.where("ord = 1").select("bucket", *[F.col(v).alias(f"head_{v}") for v in values])
    names = heads.select("bucket")
    order = Window.orderBy("bucket")  # one row for each bucket
    after = names.select("bucket", F.coalesce(F.lead("bucket").over(order), F.min("bucket").over(Window.partitionBy(F.lit(0)))).alias("after"))
    heads = after.join(heads.withColumnRenamed("bucket", "after"), "after").drop("after")
    joined = ahead.join(heads, "bucket")
    return joined.select(*rows.columns, *[F.when(F.col("is_last"), F.col(f"head_{v}")).otherwise(F.col(f"_{v}")).alias(f"next_{v}") for v in values])


def edited_fingerprints(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last half is the start of the next document's.

    One row for each row of docs (doc_id, text): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. The next document is the one of the next smaller doc_id, after the last the first; of rows
    with one doc_id the smaller text comes first, a null doc_id comes last. A null text is empty. A single row is its
    own next document. Other columns are ignored; an empty table gives an empty result. However many rows share an id or
    have none, they are spread over tasks by their texts, and equal rows count as one until the end.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = parts or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if docs.groupBy("doc_id").count().where("doc_id is null or count > 1").isEmpty():
        order = Window.partitionBy("bucket").orderBy(F.col("doc_id").desc())
        return _fingerprints(docs.withColumn("bucket", id_buckets(docs, parts)).withColumn("ord", F.row_number().over(order)), [])
    order = Window.partitionBy("bucket").orderBy(F.col("doc_id").desc_nulls_last(), "text", F.col("times").desc())
    found = _fingerprints(ranged(docs, parts).withColumn("ord", F.row_number().over(order)), ["times"])
    return each_copy(found, "times", "copy", parts).drop("copy")


#: Characters of a text by which rows of one id are put in ranges.
RANGE_CHARS = 64


def ranged(docs: DataFrame, parts: int) -> DataFrame:
    """Rows (doc_id, text, times, bucket) in ranges along the order of documents, where ids repeat or lack.

    Equal rows are counted first: all but the last of them are followed by the same text, so they are one row of that many
    times, before one that stands for the last. Ranges are written out, so that all that follows sees the same ones.
    Only different texts of one id that begin with the same RANGE_CHARS characters cannot be put apart.
    """
    counted = docs.groupBy("doc_id", "text").agg(F.count("*").alias("n"))
    one = F.lit(1).cast("long")
    times = F.when(F.col("n") > 1, F.array(F.col("n") - 1, one)).otherwise(F.array(one))
    spread = counted.repartitionByRange(parts, F.col("doc_id").desc_nulls_last(), F.substring("text", 1, RANGE_CHARS))
    return cut(spread.select("doc_id", "text", F.explode(times).alias("times"), F.spark_partition_id().alias("bucket")))


def _fingerprints(rows: DataFrame, carried: Sequence[str]) -> DataFrame:
    """The result's columns and those carried, of rows (doc_id, text, bucket, ord, carried...)."""
    rows = _followed(rows, ["text"])
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)))
    rows = rows.select("bucket", "ord", "doc_id", *carried, n.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.explode(F.array(F.struct(F.lit(0).alias("v"), F.col("text").alias("t")), F.struct(F.lit(1).alias("v"), F.col("edited").alias("t")))).alias("x"))
    keys = ["bucket", "ord", "doc_id", *carried, "n_chars", "edited_sha256", "v"]
    sums = paragraph_sums(rows.select(*keys[:-1], F.col("x.v").alias("v"), paragraphs(F.col("x.t")).alias("ps")), keys, "ps")
    flat = sums.groupBy(*keys[:-1]).agg(*[F.max(F.when(F.col("v") == i, F.col(c))).alias(p + c) for i, p in ((0, "a_"), (1, "b_")) for c in SUMS])
    flat = _followed(flat, [f"a_{c}" for c in SUMS if c[0] != "d"] + [f"a_{c}" for c in SUMS if c[0] == "d"])
    flat = flat.withColumnsRenamed({f"next_a_{c}": f"c_{c}" for c in SUMS})
    return flat.select("doc_id", "n_chars", "edited_sha256", fingerprint("a_").alias("fingerprint"), fingerprint("b_").alias("edited_fingerprint"), F.expr(likeness_sql("a_", "b_")).alias("near_edited"), F.expr(likeness_sql("a_", "c_")).alias("near_next"), *carried)


def edited_fingerprints_sql(documents: str) -> str:
    """DuckDB SQL for edited_fingerprints over a table with doc_id and text."""
    hexed = lambda p: " || ".join(f"lpad(format('{{:x}}', {p}{c}), {8 if c[0] in 'nd' else 15}, '0')" for c in SUMS)
    lanes = ", ".join(
        ["CAST(count(p) AS BIGINT) AS n"]
        + [f"CAST(coalesce(sum(CAST('0x' || substr(sha, {8 * i + 1}, 8) AS BIGINT)), 0) AS BIGINT) & 4294967295 AS d{i}" for i in range(DENSE)]
        + [f"CAST(coalesce(sum((CAST('0x' || substr(m, {15 * (i // _BITS) + 1}, 15) AS BIGINT) >> {i % _BITS}) & {_ONES}), 0) AS BIGINT) AS s{i}" for i in range(PACKED)]
    )
    columns = lambda t, p: ", ".join(f"{t}.{c} AS {p}{c}" for c in SUMS)
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id DESC NULLS LAST, coalesce(text, '')) AS r FROM {documents}),
sized AS (SELECT d.*, length(d.text) AS n, (SELECT count(*) FROM docs) AS k FROM docs d),
edits AS (SELECT d.r, d.doc_id, d.n AS n_chars, d.r % d.k + 1 AS r_next, d.text, substr(d.text, 1, CAST(d.n - d.n // 2 AS BIGINT)) || substr(e.text, 1, CAST(d.n // 2 AS BIGINT)) AS edited FROM sized d JOIN docs e ON e.r = d.r % d.k + 1),
both_texts AS (SELECT r, 0 AS v, text AS t FROM edits UNION ALL SELECT r, 1, edited FROM edits),
units AS (SELECT r, v, p, sha256(p) AS sha, md5(p) AS m FROM (SELECT r, v, unnest(string_split(regexp_replace(t, '([.!?])[ \\t]+', '\\1' || chr(10), 'g'), chr(10))) AS p FROM both_texts) WHERE trim(p, ' ') <> ''),
summed AS (SELECT b.r, b.v, {lanes} FROM both_texts b LEFT JOIN units u ON u.r = b.r AND u.v = b.v GROUP BY b.r, b.v),
joined AS (SELECT e.doc_id, e.n_chars, sha256(e.edited) AS edited_sha256, {columns('a', 'a_')}, {columns('b', 'b_')}, {columns('c', 'c_')} FROM edits e JOIN summed a ON a.r = e.r AND a.v = 0 JOIN summed b ON b.r = e.r AND b.v = 1 JOIN summed c ON c.r = e.r_next AND c.v = 0)
SELECT doc_id, n_chars, edited_sha256, {hexed('a_')} AS fingerprint, {hexed('b_')} AS edited_fingerprint, {likeness_sql('a_', 'b_')} AS near_edited, {likeness_sql('a_', 'c_')} AS near_next FROM joined
"""
