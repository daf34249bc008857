"""N-gram Jaccard join with adaptive multi-match prefixes.

Two texts link when the Jaccard similarity of their sets of k-word shingles reaches a threshold. Every set is ordered
rarest shingle first. With prefix length ``n - ceil(t n) + l`` two similar sets must share at least ``l`` prefix
shingles, for any ``l``; each document takes the ``l`` for which scanning its prefix lists and verifying its estimated
candidates costs least, and a pair must share as many prefix shingles as the smaller of its two ``l``.

Steps, none of which meets a group in one place:

1. One scan gives each text's set size and 128-bit set digest, another a frequency sketch, sized by the number of
   shingles. Any order of the shingles gives exact results; the sketch keeps frequent ones out of the prefixes.
2. Texts with the same set are one class; all later steps work on one representative of each. A set so small that one
   more shingle takes it below the threshold is only ever like itself and has no prefix.
3. Prefix shingles are dealt by shingle. A list of up to ``hot`` classes gives its pairs of compatible size; those that
   share enough prefix shingles are verified on whole texts. Their number is at most ``hot / 2`` for each prefix entry.
4. Longer lists give no pairs. Their classes are compared in blocks by exact overlap counts: bands of set size, each in
   chunks of bounded bytes, and the chunks of neighbouring bands with each other. The lists of a group of near copies
   overlap, so what is compared is the union of lists that are connected, unless that has more pairs than its lists have
   together; then each list is compared by itself. So no more pairs are compared than the lists hold. A block returns a
   spanning forest of its links, so its output is as long as its input, however many links there are.
5. Components over representatives, carried back to all documents.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WrittenTables, cut, row_keys
from .components import connected_components
from .shingles import shingle_sets

#: Buckets of the frequency sketch, as bits: one for every 64 shingles of the corpus between these bounds, so that the
#: sketch that is broadcast has 1 to 16 MB and that of a task 4 to 64 MB.
SKETCH_BITS, MOST_SKETCH_BITS = 20, 24
_SEGMENT = 1 << 16
#: Lists of more classes than this are compared in blocks.
HOT = 32
#: Bounds of a block side: classes, and shingles over all of them.
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 1 << 20
#: Largest number of shared prefix shingles that a document may require, and the cost of a verification in list entries.
MOST_MATCHES, VERIFY_COST = 4, 16.0


def _ceil_share(n, num: int, den: int):
    return -(-num * n // den)


def _digest(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def _class(digest: bytes) -> int:
    """The short name of a class in lists. Should two classes share one, both are taken as candidates."""
    return int.from_bytes(digest[:8], "little", signed=True)


def _set_rows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column("text"), k))
            digests = [_digest(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array([None if d is None else _class(d) for d in digests], pa.int64())],
                ["doc_id", "n_shingles", "digest", "cls"],
            )

    return run


def set_digests(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n_shingles, digest, cls); an empty set has neither digest nor class."""
    return docs.select("doc_id", "text").mapInArrow(_set_rows(k), "doc_id long, n_shingles long, digest binary, cls long")


def sketch_bits(shingles: int) -> int:
    return min(MOST_SKETCH_BITS, max(SKETCH_BITS, (shingles // 64).bit_length()))


def _packed(counts: np.ndarray) -> bytes:
    """Counts of a segment for the shuffle: most are 0 or 1, so they shrink well."""
    return zlib.compress(np.minimum(counts, 0xFFFFFFFF).astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


def _sketch_rows(k: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint32)

        one = np.uint32(1)
        for batch in batches:
            for s in shingle_sets(batch.column("text"), k):
                np.add.at(counts, (s >> np.uint64(64 - bits)).astype(np.int64), one)
        segment = [i for i in range(0, len(counts), _SEGMENT) if counts[i : i + _SEGMENT].any()]
        data = [_packed(counts[i : i + _SEGMENT]) for i in segment]
        salt = [zlib.crc32(data[0]) % 256 if data else 0] * len(segment)
        yield pa.RecordBatch.from_arrays([pa.array([i // _SEGMENT for i in segment], pa.int32()), pa.array(salt, pa.int32()), pa.array(data, pa.binary())], ["segment", "salt", "data"])

    return run


def _sum_segments(key: tuple, table: pa.Table) -> pa.Table:
    total = np.zeros(_SEGMENT, np.uint64)
    for data in table.column("data"):
        total += _unpacked(data.as_py())
    return pa.table({"segment": pa.array([key[0].as_py()], pa.int32()), "salt": pa.array([0], pa.int32()), "data": pa.array([_packed(total)], pa.binary())})


def shingle_sketch(docs: DataFrame, k: int, bits: int = SKETCH_BITS) -> np.ndarray:
    """How many sets hold a shingle, by the shingle's leading bits, as eighths of an octave: 2 ** bits bytes."""
    schema = "segment int, salt int, data binary"
    parts = docs.select("text").mapInArrow(_sketch_rows(k, bits), schema)
    parts = parts.groupBy("segment", "salt").applyInArrow(_sum_segments, schema).groupBy("segment").applyInArrow(_sum_segments, schema)
    counts = np.zeros(1 << bits, np.float32)
    for segment, _, data in parts.toLocalIterator():
        counts[segment * _SEGMENT : (segment + 1) * _SEGMENT] = _unpacked(bytes(data))
    over = np.maximum(counts - counts.mean(dtype=np.float64), 0.0)
    return np.minimum(np.round(8 * np.log2(1 + over)), 255).astype(np.uint8)


def adaptive_prefix(grams: np.ndarray, sketch: np.ndarray, num: int, den: int) -> tuple[np.ndarray, int]:
    """The prefix of a set in rarest-first order and the number of prefix shingles that a partner must share."""
    level = sketch[(grams >> np.uint64(64 - (len(sketch) - 1).bit_length())).astype(np.int64)]
    n, need = len(grams), int(_ceil_share(len(grams), num, den))
    most = min(MOST_MATCHES, need)
    longest = n - need + most
    order = np.lexsort((grams, level))[:longest]
    reach = np.cumsum(np.exp2(level[order] / 8.0))[n - need :]
    matches = np.arange(1, most + 1)
    best = int(np.argmin(reach + VERIFY_COST * reach / matches**2)) + 1
    return grams[order[: n - need + best]], best


def _prefix_rows(k: int, sketch, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            held: list[tuple[np.ndarray, int, int, int]] = []
            rows = 0
            for s in shingle_sets(batch.column("text"), k):
                if den * len(s) < num * (len(s) + 1):  # no other set is like it
                    continue
                cls = _class(_digest(s))
                if cls in seen:
                    continue
                seen.add(cls)
                prefix, least = adaptive_prefix(s, sketch.value, num, den)
                held.append((prefix, cls, len(s), least))
                rows += len(prefix)
                if rows > 200_000:
                    yield _prefix_batch(held)
                    held, rows = [], 0
            if held:
                yield _prefix_batch(held)

    return run


def _prefix_batch(held: list) -> pa.RecordBatch:
    lengths = [len(x[0]) for x in held]
    token = np.concatenate([x[0] for x in held]).view(np.int64)
    cls, n, least = (np.repeat(np.array([x[i] for x in held], t), lengths) for i, t in ((1, np.int64), (2, np.int32), (3, np.int8)))
    return pa.RecordBatch.from_arrays([pa.array(token), pa.array(cls), pa.array(n), pa.array(least)], ["token", "cls", "n", "least"])


_PAIR = "a long, b long, least byte, token long, n int"


def _list_rows(num: int, den: int, hot: int):
    """Rows sorted by (token, n, cls) to candidate pairs, or to (cls, token) with a null partner for the members of hot lists."""

    def emit(token, cls, n, least) -> Iterator[pa.RecordBatch]:
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        size = np.diff(np.append(first, len(token)))
        size = np.repeat(size, size)
        big = size > hot
        if big.any():
            yield _pair_batch(cls[big], None, least[big], token[big], n[big])
        i = np.flatnonzero((size > 1) & ~big)
        token, cls, n, least = token[i], cls[i], n[i].astype(np.int64), least[i]
        a, b, c = [], [], []
        for shift in range(1, hot):
            same = np.flatnonzero(token[shift:] == token[:-shift])
            if not len(same):
                break
            same = same[den * n[same] >= num * n[same + shift]]
            a.append(np.minimum(cls[same], cls[same + shift]))
            b.append(np.maximum(cls[same], cls[same + shift]))
            c.append(np.minimum(least[same], least[same + shift]))
        if a and sum(map(len, a)):
            yield _pair_batch(np.concatenate(a), np.concatenate(b), np.concatenate(c), None, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, running = None, None
        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if rest is not None:
                now = [np.concatenate(x) for x in zip(rest, now, strict=True)]
            new = np.ones(len(now[0]), bool)
            new[1:] = (now[0][1:] != now[0][:-1]) | (now[1][1:] != now[1][:-1])
            now = [x[new] for x in now]
            if running is not None and len(now[0]):  # a list that was hot before this batch goes on
                on = now[0] == running
                if on.any():
                    yield _pair_batch(now[1][on], None, now[3][on], now[0][on], now[2][on])
                    now = [x[~on] for x in now]
            rest = None
            if not len(now[0]):
                continue
            running = None
            last = int(np.searchsorted(now[0], now[0][-1]))
            if last:
                yield from emit(*(x[:last] for x in now))
            rest = [x[last:] for x in now]
            if len(rest[0]) > hot:
                running = rest[0][-1]
                yield _pair_batch(rest[1], None, rest[3], rest[0], rest[2])
                rest = None
        if rest is not None and len(rest[0]):
            yield from emit(*rest)

    return run


def _pair_batch(a, b, least, token, n) -> pa.RecordBatch:
    none = lambda kind: pa.nulls(len(a), kind)
    return pa.RecordBatch.from_arrays(
        [pa.array(a, pa.int64()), none(pa.int64()) if b is None else pa.array(b, pa.int64()), pa.array(least, pa.int8()), none(pa.int64()) if token is None else pa.array(token, pa.int64()), none(pa.int32()) if n is None else pa.array(n, pa.int32())],
        ["a", "b", "least", "token", "n"],
    )


def _verify_rows(k: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = shingle_sets(batch.column("text_a"), k), shingle_sets(batch.column("text_b"), k)
            keep = np.fromiter((_similar(x, y, num, den) for x, y in zip(left, right, strict=True)), bool, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))

    return run


def _similar(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    both = np.concatenate([x, y])
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return common > 0 and den * common >= num * (len(both) - common)


def _block_rows(k: int, num: int, den: int):
    def run(table: pa.Table) -> pa.Table:
        ids, side = table.column("doc_id").to_numpy(), table.column("side").to_numpy()
        sets = list(shingle_sets(table.column("text").combine_chunks(), k))
        n = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(sets)), n)
        grams, token = np.unique(np.concatenate(sets), return_inverse=True)
        order = np.argsort(token, kind="stable")
        postings, bounds = owner[order], np.searchsorted(token[order], np.arange(len(grams) + 1))
        at = np.concatenate([[0], np.cumsum(n)])
        root = np.arange(len(sets))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        a, b = [], []
        for i in range(len(sets)):
            own = token[at[i] : at[i + 1]]
            common = np.bincount(np.concatenate([postings[bounds[t] : bounds[t + 1]] for t in own]), minlength=len(sets))
            hit = np.flatnonzero(den * common >= num * (n + n[i] - common))
            for j in hit[(hit > i) & ((side[hit] != side[i]) | (side[i] == 0))]:
                x, y = find(i), find(int(j))
                if x != y:
                    root[y] = x
                    a.append(ids[i])
                    b.append(ids[j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _hot_groups(hot: DataFrame) -> DataFrame:
    """(by_list, key, cls, n): the groups of classes to compare; hot has (cls, n, token), the members of hot lists.

    Lists connected by their members are one group, or each is its own where the union has more pairs than they have.
    """
    lists = cut(hot.groupBy("token").agg(F.min("cls").alias("hub"), F.count("*").cast("double").alias("size")))
    unions = cut(connected_components(hot.join(lists, "token").select("cls", "hub"), "cls", "hub").withColumnRenamed("id", "cls"))
    pairs = lists.join(unions, lists["hub"] == unions["cls"]).groupBy("component_id").agg(F.sum(F.pow("size", F.lit(2))).alias("listed"))
    wide = unions.groupBy("component_id").agg(F.count("*").cast("double").alias("all")).join(pairs, "component_id").where(F.col("all") * F.col("all") > F.col("listed")).select("component_id")
    wide = cut(unions.join(wide, "component_id").select("cls"))
    own = hot.join(wide, "cls").select(F.lit(True).alias("by_list"), F.col("token").alias("key"), "cls", "n")
    joint = unions.join(hot.select("cls", "n").distinct(), "cls").join(wide, "cls", "left_anti")
    return own.unionByName(joint.select(F.lit(False).alias("by_list"), F.col("component_id").alias("key"), "cls", "n"))


def _hot_links(hot: DataFrame, reps: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links between the classes of hot lists; hot has (cls, n, token)."""
    width = float(np.log(den / num))
    group = ["by_list", "key"]
    members = cut(_hot_groups(hot).join(reps, "cls").select(*group, "doc_id", "n", F.floor(F.log(F.col("n").cast("double")) / width + 1e-9).cast("int").alias("band")))
    bands = members.groupBy(*group, "band").agg(F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("chunks"))
    near = bands.select(*group, (F.col("band") - 1).alias("band"), F.col("chunks").alias("above")), bands.select(*group, (F.col("band") + 1).alias("band"), F.col("chunks").alias("below"))
    placed = members.join(bands, [*group, "band"]).join(near[0], [*group, "band"], "left").join(near[1], [*group, "band"], "left")
    placed = placed.withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("chunks")).cast("int"))
    block = lambda band, i, j, side: F.struct(band.alias("band"), i.alias("i"), j.alias("j"), side.alias("side"))
    count = lambda c: F.when(F.coalesce(c, F.lit(0)) > 0, F.sequence(F.lit(0), c - 1)).otherwise(F.array().cast("array<int>"))
    zero, one, two = F.lit(0), F.lit(1), F.lit(2)
    within = F.transform(count(F.col("chunks")), lambda j: block(F.col("band") * 2, F.least("own", j), F.greatest("own", j), F.when(F.col("own") == j, zero).when(F.col("own") < j, one).otherwise(two)))
    up = F.transform(count(F.col("above")), lambda j: block(F.col("band") * 2 + 1, F.col("own"), j, one))
    down = F.transform(count(F.col("below")), lambda j: block(F.col("band") * 2 - 1, j, F.col("own"), two))
    dealt = placed.select(*group, "doc_id", F.explode(F.concat(within, up, down)).alias("at")).select(*group, "doc_id", "at.*")
    return dealt.join(docs, "doc_id").groupBy(*group, "band", "i", "j").applyInArrow(_block_rows(k, num, den), "a long, b long")


def ngram_jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, hot: int = HOT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs (doc_id, text); other columns are ignored.

    Texts link when ``den * |intersection| >= num * |union|`` over their sets of k-word shingles. Null, empty and blank
    texts have no shingles and link with nothing; a text of fewer than k words has its word sequence as its one shingle.
    Equal texts have equal components. Rows of one doc_id, or without one, are nodes of their own; component_id is the
    smallest doc_id of all rows that can be reached, null if none of them has one. An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows, key = row_keys(docs)
    found = row_components(rows.select(F.col(key).alias("doc_id"), "text"), k, num, den, hot)
    if key == "doc_id":
        return found
    found = cut(rows.select(F.col(key).alias("key"), "doc_id").join(found.withColumnsRenamed({"doc_id": "key", "component_id": "node"}), "key"))
    least = cut(found.groupBy("node").agg(F.min("doc_id").alias("component_id")))
    return found.join(least, "node").select("doc_id", "n_shingles", "component_id")


def row_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, hot: int = HOT) -> DataFrame:
    """ngram_jaccard_components of rows that doc_id tells apart: no two have the same, none lacks it."""
    named = docs.select("doc_id", "text").where("text is not null")
    sets = cut(set_digests(docs, k))
    bits = sketch_bits(sets.agg(F.sum("n_shingles")).first()[0] or 0)
    sketch = docs.sparkSession.sparkContext.broadcast(shingle_sketch(named, k, bits))
    # written out: a join with rows of one digest can then be split where a class has very many copies
    classes = cut(sets.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min("cls").alias("cls")))
    reps = classes.select("cls", F.col("rep").alias("doc_id"))
    prefixes = named.mapInArrow(_prefix_rows(k, sketch, num, den), "token long, cls long, n int, least byte")
    lists = prefixes.repartition("token").sortWithinPartitions("token", "n", "cls").mapInArrow(_list_rows(num, den, hot), _PAIR)
    lists = cut(lists.groupBy("a", "b", F.when(F.col("b").isNull(), F.col("token")).alias("token")).agg(F.min("least").alias("least"), F.min("n").alias("n"), F.count("*").alias("shared")).where("b is null or shared >= least"))
    pairs = lists.where("b is not null").select("a", "b").join(reps.select(F.col("cls").alias("a"), F.col("doc_id").alias("x")), "a").join(reps.select(F.col("cls").alias("b"), F.col("doc_id").alias("y")), "b").select("x", "y").where("x <> y")
    met = lists.select(F.col("a").alias("cls")).unionByName(lists.where("b is not null").select(F.col("b").alias("cls"))).distinct()
    with WrittenTables(docs.sparkSession) as tables:
        # most texts meet no other: all are shuffled once, and only those of pairs and hot lists again
        texts = tables.write(named.join(reps.join(met, "cls").select("doc_id").distinct(), "doc_id", "left_semi"), "texts")
        both = pairs.join(texts.select(F.col("doc_id").alias("x"), F.col("text").alias("text_a")), "x").join(texts.select(F.col("doc_id").alias("y"), F.col("text").alias("text_b")), "y")
        cold = both.select(F.col("x").alias("a"), F.col("y").alias("b"), "text_a", "text_b").mapInArrow(_verify_rows(k, num, den), "a long, b long")
        hot_rows = lists.where("b is null").select(F.col("a").alias("cls"), "n", "token")
        links = cold.unionByName(_hot_links(hot_rows, reps, texts, k, num, den))
        found = connected_components(links).withColumnRenamed("id", "rep")
    return (
        sets.join(classes.select("digest", "rep"), "digest", "left")
        .join(found, "rep", "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "rep", "doc_id").alias("component_id"))
    )


def ngram_jaccard_sql(documents: str, k: int, num: int, den: int) -> str:
    """DuckDB SQL for ngram_jaccard_components over a small table with distinct ids: all pairs with a common shingle are counted."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH RECURSIVE texts AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^ \\t\\n\\x0B\\f\\r]+') AS w FROM {documents}),
grams AS MATERIALIZED (SELECT DISTINCT doc_id, CASE WHEN len(w) < {k} THEN md5(array_to_string(w, ' ')) ELSE md5(array_to_string(w[i:i + {k - 1}], ' ')) END AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {k - 2}, 2))) AS i FROM texts WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY 1),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
near AS (SELECT a, b FROM common JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE {den} * c >= {num} * (s.n + t.n - c)),
links AS MATERIALIZED (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
reach(id, other) AS (SELECT doc_id, doc_id FROM {documents} UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, root AS component_id FROM {documents} d LEFT JOIN sizes USING (doc_id) JOIN (SELECT id, min(other) AS root FROM reach GROUP BY id) r ON r.id = d.doc_id
"""
