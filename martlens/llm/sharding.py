"""Sharding by a k-d tree over document metadata, with DataFrame functions only.

The documents are points in a small space of metadata. A node with more than one shard's share of bytes is split at its
weighted median along its widest dimension, again and again, so shards hold documents that are alike and are nearly
equal in bytes. A median is found without sorting: rows carry a 63-bit key (coordinate, crc32 of the text, hash of the
id) and each round sums the bytes of one 16-bit digit of the key, within the digits already settled. Coordinates belong
to texts, not rows: all copies of a text have those of its least source and language, so they lie next to each other and
a cut passes beside them. Only a group of copies that outweighs ``SNAP`` of a shard on both sides of the cut is parted.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import CHUNK, cut, each_copy

#: Shifts and masks of the digits of a key; the first three settle coordinate and text.
_DIGITS = ((47, 0xFFFF), (31, 0xFFFF), (15, 0xFFFF), (0, 0x7FFF))
#: A cut goes beside a group of equal texts if that moves it by at most this share of a shard. Cuts of three levels add up
#: to 1.75 times that, and a group of up to twice that share is never parted.
SNAP = 0.015
#: Rows of a shard for each bucket by which they are numbered.
SLOT_ROWS = 10_000
#: Nodes up to which what is known of them is broadcast, at some 50 bytes each.
MOST_BROADCAST = 1 << 16


def _category(name: str) -> Column:
    return (F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % 65536).cast("int")


def by_text(rows: DataFrame) -> DataFrame:
    """Rows (text_key, lang, source, ...) with lang and source of their text: the least of all its copies, null before others.

    Texts with one row keep their own. The table of the others has one row for each text that repeats; the join with it is
    on a written table, so that copies of a very frequent text can be dealt to several tasks.
    """
    rows = cut(rows)
    least = F.min(F.struct(F.col("source").isNotNull().alias("a"), "source", F.col("lang").isNotNull().alias("b"), "lang"))
    texts = rows.groupBy("text_key").agg(F.count("*").alias("copies"), least.alias("m")).where("copies > 1")
    texts = cut(texts.select("text_key", F.lit(True).alias("again"), F.col("m.source").alias("text_source"), F.col("m.lang").alias("text_lang")))
    own = lambda c: F.when(F.col("again"), F.col(f"text_{c}")).otherwise(F.col(c)).alias(c)
    return rows.join(texts, "text_key", "left").select(*[own(c) if c in ("lang", "source") else F.col(c) for c in rows.columns])


def metadata_dimensions() -> Mapping[str, Column]:
    """Coordinates from 0 to 65535: the logarithm of the size, source and language."""
    return {"by_size": (F.log2(F.col("size").cast("double")) * 2048).cast("int"), "by_source": _category("source"), "by_lang": _category("lang")}


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row of docs (doc_id, text, lang, source).

    There are ``shards`` leaves, or as many as bring leaves to ``target_bytes``. size is the text's UTF-8 bytes plus 1,
    a null text having none and counting as the same text as an empty one. Shards are numbered from 0; slot numbers a
    shard's rows without gaps from 0. Rows of equal text are in one shard unless they weigh more than twice SNAP of it.
    Null language or source is a category of its own; repeated rows and null ids are rows like others; other columns are
    ignored; an empty table gives an empty result.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "lang",
        "source",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_key"),
    )
    rows = by_text(rows)
    dims = metadata_dimensions()
    rows = cut(rows.select("doc_id", "size", "text_crc32", *[c.alias(n) for n, c in dims.items()], F.lit(0).alias("node")))
    if shards is None:
        shards = max(1, -(-(rows.agg(F.sum("size")).first()[0] or 1) // (target_bytes or 1 << 27)))
    rows = rows.withColumn("k", F.lit(shards))
    for level in range((shards - 1).bit_length()):
        rows = cut(_split(rows, list(dims), 1 << level))
    return number_rows(rows.select("doc_id", "size", "text_crc32", F.col("node").alias("shard")))


def _split(rows: DataFrame, dims: list[str], nodes: int) -> DataFrame:
    """Rows of at most ``nodes`` nodes, each with k shards below it, in the children of the nodes that have more than one.

    What is known of a node (its axis, the digits of its cut so far, the bytes left of it that these do not settle) is a
    row of a table. A left child keeps the node's number, a right one follows after the shards of the left.
    """
    ends = [f(d).alias(f"{f.__name__}_{d}") for d in dims for f in (F.min, F.max)]
    stats = rows.where("k > 1").groupBy("node", "k").agg(F.sum("size").alias("bytes"), *ends)
    widths = F.array(*[F.col(f"max_{d}") - F.col(f"min_{d}") for d in dims])
    axis = (F.array_position(widths, F.array_max(widths)) - 1).cast("int")
    left = (F.col("bytes") * F.floor(F.col("k") / 2) / F.col("k")).cast("double")
    state = cut(stats.select("node", axis.alias("axis"), left.alias("left"), (SNAP * F.col("bytes") / F.col("k")).alias("snap"), F.lit(0).cast("long").alias("prefix"), F.lit(None).cast("long").alias("cut")))
    for depth, (shift, mask) in enumerate(_DIGITS):
        asked = state.where("cut is null")
        if depth == 3 and asked.isEmpty():
            break
        keyed = _keyed(rows, asked, dims, nodes)
        keyed = keyed if depth == 0 else keyed.where(F.shiftright("key", shift + mask.bit_length()) == F.col("prefix"))
        sums = keyed.groupBy("node", F.shiftright("key", shift).bitwiseAND(mask).alias("digit"), "left").agg(F.sum("size").alias("w"))
        upto = Window.partitionBy("node").orderBy("digit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        found = sums.withColumn("cum", F.sum("w").over(upto)).where("cum >= left and cum - w < left").select("node", "digit", "w", (F.col("left") - F.col("cum") + F.col("w")).alias("rest"))
        prefix = F.shiftleft("prefix", mask.bit_length()).bitwiseOR(F.col("digit"))
        beside = F.lit(depth == 3) if depth != 2 else F.least("rest", F.col("w") - F.col("rest")) <= F.col("snap")
        at = F.shiftleft(prefix + F.when(F.col("rest") <= F.col("w") - F.col("rest"), 0).otherwise(1), shift)
        new = {"left": F.coalesce("rest", "left"), "prefix": F.coalesce(prefix, "prefix"), "cut": F.coalesce("cut", F.when(beside, at))}
        state = cut(state.join(found, "node", "left").select(*[new.get(c, F.col(c)).alias(c) for c in state.columns]))
    placed = _keyed(rows, state, dims, nodes, "left")
    low, right = F.floor(F.col("k") / 2).cast("int"), F.col("key") >= F.col("cut")
    node = F.when(right, F.col("node") + low).otherwise(F.col("node"))
    k = F.when(F.col("k") == 1, 1).when(right, F.col("k") - low).otherwise(low)
    return placed.select("doc_id", "size", "text_crc32", *dims, node.alias("node"), k.alias("k"))


def _keyed(rows: DataFrame, state: DataFrame, dims: list[str], nodes: int, how: str = "inner") -> DataFrame:
    """Rows with what is known of their node, and the key along its axis; with "left", rows of other nodes have a null key.

    The table of nodes is broadcast while there are at most MOST_BROADCAST; later a node is a small share of the rows.
    """
    known = F.broadcast(state) if nodes <= MOST_BROADCAST else state
    coordinate = F.element_at(F.array(*[F.col(d) for d in dims]), F.col("axis") + 1).cast("long")
    mine = F.xxhash64("doc_id").bitwiseAND(0x7FFF)
    key = F.shiftleft(coordinate, 47).bitwiseOR(F.shiftleft(F.col("text_crc32"), 15)).bitwiseOR(mine)
    return rows.join(known, "node", how).withColumn("key", key)


def number_rows(rows: DataFrame) -> DataFrame:
    """Rows with slot: their number within the shard, without gaps from 0, from counts of small buckets.

    A shard has a bucket for every SLOT_ROWS of the rows of the largest one. Equal rows count as one until the end.
    """
    same = cut(rows.groupBy("shard", "doc_id", "text_crc32", "size").agg(F.count("*").alias("n")))
    most, copies = same.groupBy("shard").agg(F.sum("n").alias("rows"), F.max("n").alias("copies")).agg(F.max("rows"), F.max("copies")).first()
    buckets = -(-(most or 1) // SLOT_ROWS)
    same = same.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets)))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = same.groupBy("shard", "bucket").agg(F.sum("n").alias("m")).select("shard", "bucket", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    slots = same.withColumn("i", F.coalesce(F.sum("n").over(within), F.lit(0))).join(starts, ["shard", "bucket"])
    slots = slots.select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("i")).alias("start"), "n")
    dealt = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) if (copies or 0) > CHUNK else None
    return each_copy(slots, "n", "copy", dealt).select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("copy")).cast("long").alias("slot"))
