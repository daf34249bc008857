"""How document filters act on each other: what every filter removes in every order, alone and after the others.

One pass over the Arrow buffers of the texts decides all filters. NumPy classes of bytes and their prefix sums count
words, capitals, symbols and code points of a whole slice of texts at once; the words of each document are sorted by a
hash, and neighbours of equal hash are compared byte by byte, so the number of distinct words is exact. A document comes
out as a mask of the filters that it fails and a digest of its text. Masks are then counted by part of the corpus, and
everything in the report follows from these counts: 32 masks for a part at most, however many documents there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .shingles import SLICE_BYTES, _SPACE, _STEP, mix64

#: The filters in the order of their bits; E compares rows and is decided after the scan.
LETTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 200, 50, 3, "#$%&*|"
#: A text of more bytes is taken in pieces that end at white space.
PIECE_BYTES = 4 * SLICE_BYTES

_CAPITAL, _SYMBOL, _POINT = (np.zeros(256, bool) for _ in range(3))
_CAPITAL[65:91] = True
_SYMBOL[list(SYMBOLS.encode())] = True
_POINT[[*range(128), *range(192, 256)]] = True  # the first byte of each code point
_VALUE = mix64(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)
_GROWTH = np.uint64(0x9E3779B97F4A7C15)


def word_table(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, 64-bit hash) of the words of texts that lie one after the other; no word goes on over a bound."""
    none = np.zeros(0, np.int64)
    if not len(data):
        return none, none, none.astype(np.uint64)
    inside, first = ~_SPACE[data], np.zeros(len(data) + 1, bool)
    first[bounds] = True
    before, after = np.roll(inside, 1), np.roll(inside, -1)
    start = np.flatnonzero(inside & (first[:-1] | ~before))
    length = np.flatnonzero(inside & (first[1:] | ~after)) + 1 - start
    if not len(start):
        return start, length, none.astype(np.uint64)
    place = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    powers = np.full(int(length.max()), _GROWTH, np.uint64)
    powers[0] = 1
    terms = _VALUE[data[np.repeat(start, length) + place]] * np.multiply.accumulate(powers)[place]
    return start, length, mix64(np.add.reduceat(terms, np.cumsum(length) - length) + length.astype(np.uint64) * _STEP)


def distinct_words(data: np.ndarray, owner: np.ndarray, start: np.ndarray, length: np.ndarray, names: np.ndarray, texts: int) -> np.ndarray:
    """The number of distinct words of each text: words sorted by hash within a text, equal neighbours verified by their bytes."""
    total = np.bincount(owner, minlength=texts)
    if len(owner) < 2:
        return total
    order = np.lexsort((names, owner))
    owner, start, length, names = owner[order], start[order], length[order], names[order]
    same = np.flatnonzero((names[1:] == names[:-1]) & (owner[1:] == owner[:-1]))
    if not len(same):
        return total
    odd = length[same] != length[same + 1]
    size = np.minimum(length[same], length[same + 1])
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    differs = data[np.repeat(start[same], size) + place] != data[np.repeat(start[same + 1], size) + place]
    odd |= np.logical_or.reduceat(differs, np.cumsum(size) - size)
    found = total - np.bincount(owner[same], minlength=texts)
    for text in np.unique(owner[same[odd]]):  # two words of one hash: this text's words are told apart by themselves
        mine = np.flatnonzero(owner == text)
        found[text] = len({data[a : a + n].tobytes() for a, n in zip(start[mine], length[mine], strict=True)})
    return found


def _failures(words, distinct, capitals, points, symbols) -> np.ndarray:
    return (words < LEAST_WORDS) * 1 + (100 * distinct < LEAST_DISTINCT * words) * 2 + (100 * capitals > MOST_CAPITALS * points) * 4 + (symbols > 0) * 8


def _counts(data: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Capitals, code points and symbols of each text, by prefix sums of byte classes."""
    out = []
    for kind in (_CAPITAL, _POINT, _SYMBOL):
        sums = np.concatenate([[0], np.cumsum(kind[data])])
        out.append(sums[bounds[1:]] - sums[bounds[:-1]])
    return out


def _long_text(data: np.ndarray) -> tuple:
    """Words, distinct words, capitals, code points and symbols of one long text, in pieces."""
    tables, counts, at = [], np.zeros(3, np.int64), 0
    while at < len(data):
        to = min(at + PIECE_BYTES, len(data))
        while to < len(data) and not (gap := _SPACE[data[to : to + PIECE_BYTES]]).any():
            to = min(to + PIECE_BYTES, len(data))
        to += int(gap.argmax()) if to < len(data) else 0
        piece, whole = data[at:to], np.array([0, to - at])
        start, length, names = word_table(piece, whole)
        tables.append((start + at, length, names))
        counts += [int(c[0]) for c in _counts(piece, whole)]
        at = to
    start, length, names = (np.concatenate(x) for x in zip(*tables, strict=True))
    return len(start), int(distinct_words(data, np.zeros(len(start), np.int64), start, length, names, 1)[0]), *counts


def scan_texts(texts: pa.Array) -> np.ndarray:
    """The mask of failed filters A to D of each text; a null text counts as empty."""
    if not len(texts):
        return np.zeros(0, np.int64)
    texts = texts.fill_null("").cast(pa.large_string())
    _, offsets, buffer = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    out, at = np.zeros(len(texts), np.int64), 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + SLICE_BYTES, side="right")) - 1)
        part, own = data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at]
        if len(part) > PIECE_BYTES:
            out[at:to] = _failures(*map(np.array, _long_text(part)))
        else:
            start, length, names = word_table(part, own)
            owner = np.searchsorted(own, start, side="right") - 1
            words = np.bincount(owner, minlength=to - at)
            out[at:to] = _failures(words, distinct_words(part, owner, start, length, names, to - at), *_counts(part, own))
        at = to
    return out


def _scan_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        digests = [hashlib.blake2b((t.as_py() or "").encode(), digest_size=32).digest() for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(scan_texts(texts), pa.int32()), pa.array(digests, pa.binary())], ["doc_id", "part", "fails", "digest"])


def failed_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): the documents of each part that fail just the filters of a mask, and how many of them
    are labelled of quality 1 and as toxic."""
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    known = cut(known)  # narrow; a written side lets Spark split the rows of a frequent id
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), "text")
    rows = rows.mapInArrow(_scan_rows, "doc_id long, part string, fails int, digest binary")
    rows = rows.join(known.select(F.col("doc_id").cast("long").alias("doc_id"), "good", "toxic"), "doc_id", "left").fillna(False, ["good", "toxic"])
    # copies are counted before they meet: by id, then for each kind of a text with the least id, then for the text
    kind = ["digest", "part", "fails", "good", "toxic"]
    by_id = rows.groupBy(*kind, "doc_id").agg(F.count("*").alias("n"))
    kinds = by_id.groupBy(*kind).agg(F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.coalesce(F.min_by("n", "doc_id"), F.lit(0)).alias("n_least"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_null"))
    first = F.min("least").over(Window.partitionBy("digest"))  # a text has as many kinds as it has parts and labels
    passes = F.col("n_null") + F.when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(0)
    kinds = kinds.withColumn("first", first).select("part", "fails", "good", "toxic", "n", passes.alias("passes"))
    both = F.array(F.struct(F.col("fails").alias("mask"), F.col("passes").alias("n")), F.struct((F.col("fails") + 16).alias("mask"), (F.col("n") - F.col("passes")).alias("n")))
    each = kinds.select("part", "good", "toxic", F.explode(both).alias("x")).select("part", "good", "toxic", "x.*").where("n > 0")
    of = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0))
    return each.groupBy("part", "mask").agg(F.sum("n").alias("n"), of("good").alias("good"), of("toxic").alias("toxic"))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): a row for each
    part of docs (doc_id, text, lang), order of the five filters, and step in it, zeros included.

    Documents fail A with under 200 words, B where distinct words are under half of all, C with capitals over 3 % of the
    code points, D with any of ``#$%&*|``, E where a smaller doc_id has the same text. part is lang, '' for null; a null
    text is empty. A row without doc_id has none smaller and is none, so it passes E and fails no other; rows of one id and
    text do not fail E for each other. labels (doc_id, quality, toxic) may repeat or lack ids: one label of 1 is enough.
    Other columns are ignored; an empty table gives an empty result.
    """
    counts = failed_filters(docs, labels)
    orders = F.array(*[F.lit("".join(p)) for p in permutations(LETTERS)])
    steps = counts.select("*", F.explode(orders).alias("filter_order")).select("*", F.posexplode(F.split("filter_order", "")).alias("at", "letter"))
    bit = sum((F.when(F.col("letter") == x, 1 << i).otherwise(0) for i, x in enumerate(LETTERS)), F.lit(0))
    before = sum((F.when(F.instr("filter_order", x) <= F.col("at"), 1 << i).otherwise(0) for i, x in enumerate(LETTERS)), F.lit(0))
    steps = steps.select("*", bit.alias("bit"), before.alias("before"))
    fails, earlier = F.col("mask").bitwiseAND(F.col("bit")) > 0, F.col("mask").bitwiseAND(F.col("before")) > 0
    total = lambda when, c="n": F.sum(F.when(when, F.col(c)).otherwise(0))
    report = steps.groupBy("part", "filter_order", (F.col("at") + 1).cast("int").alias("step"), "letter").agg(
        total(~fails & ~earlier).alias("kept"), total(fails & ~earlier).alias("removed"), total(fails & earlier).alias("redundant"), total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(fails & ~earlier, "good").alias("good_lost"), total(fails & ~earlier, "toxic").alias("toxic_lost"),
    )
    return report.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter"))).drop("letter")


def audit_sql(documents: str, labels: str) -> str:
    """DuckDB SQL for filter_audit over tables with distinct ids."""
    bits = "list_transform(string_split(filter_order, ''), lambda x: 1 << (strpos('ABCDE', x) - 1))"
    return f"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM {documents}),
masks AS (SELECT part, quality IS NOT DISTINCT FROM 1 AS good, toxic IS NOT DISTINCT FROM 1 AS toxic, CAST(len(w) < 200 AS INTEGER) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INTEGER) + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS INTEGER)
 + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INTEGER) + 16 * CAST(row_number() OVER (PARTITION BY t ORDER BY doc_id) > 1 AS INTEGER) AS mask FROM texts LEFT JOIN {labels} USING (doc_id)),
counts AS (SELECT part, mask, count(*) AS n, count(CASE WHEN good THEN 1 END) AS good, count(CASE WHEN toxic THEN 1 END) AS toxic FROM masks GROUP BY ALL),
l AS (SELECT unnest(string_split('ABCDE', '')) AS x), orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, step, {bits}[step] AS bit, CAST(coalesce(list_sum({bits}[1:step - 1]), 0) AS INTEGER) AS before FROM orders, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step)),
report AS (SELECT part, filter_order, step, bit, CAST(sum(CASE WHEN mask & (bit | before) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
 CAST(sum(CASE WHEN mask & bit > 0 AND mask & before > 0 THEN n ELSE 0 END) AS BIGINT) AS redundant, CAST(sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
 CAST(sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost FROM counts, steps GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM report
"""
