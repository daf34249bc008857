"""Embedding near-duplicates by an epsilon grid order join.

Vectors of one label link when their cosine reaches a threshold, that is when their unit vectors are at most
``eps = sqrt(2 - 2 t)`` apart. Unit vectors are sorted by the cells of a grid of width eps over leading principal
dimensions, and the sorted sequence is cut into blocks. Pairs of sequence intervals are then split again and again,
from the whole sequence down to blocks, and a pair whose bounding boxes are over eps apart is dropped: projections
never lengthen distances, so no link is lost. Each remaining pair of blocks is one matrix product in double precision.
Pairs of blocks are dealt as tiles, squares of the sequence with itself, so a block is sent once for a tile and not once
for a pair. A tile returns, for each vector, how many it links with, and a spanning forest: both are as long as its
blocks, however many links there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import connected_components

#: Rows of a block, principal dimensions of the grid and of bounding boxes, and how many intervals an interval is split
#: into (as bits).
BLOCK, GRID_DIMS, BOX_DIMS, SPLIT_BITS = 512, 6, 16, 3
#: Bound of the vectors on one side of a tile.
TILE_BYTES = 1 << 24


def _binary(flat: np.ndarray, sizes: np.ndarray, some: np.ndarray | None = None) -> pa.Array:
    """Doubles as one binary value for each size (in doubles); null where ``some`` is false."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]) * 8
    valid = None if some is None else pa.array(some).buffers()[1]
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [valid, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat))]).cast(pa.binary())


def _by_size(flat: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(d, rows, matrix) for each size d over 0 of the vectors that lie one after the other in ``flat``."""
    start = np.cumsum(sizes) - sizes
    for d in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == d)
        yield d, rows, flat[start[rows][:, None] + np.arange(d)]


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The doubles of a column of binary vectors and their numbers."""
    sizes = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) // 8
    return np.frombuffer(b"".join(v for v in column.to_pylist() if v)), sizes


def _unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("embedding")
        sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten().fill_null(float("nan")).to_numpy(zero_copy_only=False)
        some, start, out = np.zeros(len(batch), bool), np.cumsum(sizes) - sizes, np.zeros(len(flat))
        digests: list[bytes | None] = [None] * len(batch)
        for d, rows, x in _by_size(flat, sizes):
            top = np.abs(x).max(1)
            good = np.isfinite(top) & (top > 0)
            rows, x = rows[good], x[good] / top[good][:, None]
            some[rows] = True
            for i, row in zip(rows.tolist(), x, strict=True):
                digests[i] = hashlib.blake2b(row.tobytes(), digest_size=16).digest()
            out[start[rows][:, None] + np.arange(d)] = x / np.sqrt((x * x).sum(1))[:, None]
        kept = np.repeat(some, sizes)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), _binary(out[kept], np.where(some, sizes, 0), some), pa.array(digests, pa.binary())], ["vec_id", "label", "unit", "digest"])


def _moment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for d, _, x in _by_size(*_vectors(batch.column("unit"))):
            sums[d] = sums.get(d, 0) + x.T @ x
    yield pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["d", "data"])


def _sum_moments(key: tuple, table: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(x) for x in table.column("data").to_pylist()], axis=0)
    return pa.table({"d": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([total.tobytes()], pa.binary())})


def principal_axes(units: DataFrame) -> dict[int, np.ndarray]:
    """For each number of dimensions, the leading eigenvectors of the second moments: a bounded matrix for each."""
    schema = "d int, data binary"
    parts = units.select("unit").mapInArrow(_moment_rows, schema)
    parts = parts.groupBy("d", F.pmod(F.crc32("data"), F.lit(64))).applyInArrow(_sum_moments, schema).groupBy("d").applyInArrow(_sum_moments, schema)
    axes = {}
    for d, data in parts.collect():
        _, vectors = np.linalg.eigh(np.frombuffer(bytes(data)).reshape(d, d))
        axes[d] = np.ascontiguousarray(vectors[:, ::-1][:, :BOX_DIMS])
    return axes


def _cell_rows(axes: dict[int, np.ndarray], eps: float):
    names = [f"c{i}" for i in range(GRID_DIMS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, sizes = _vectors(batch.column("unit"))
            cells = np.zeros((len(batch), GRID_DIMS), np.int32)
            for d, rows, x in _by_size(flat, sizes):
                at = np.floor(x @ axes[d][:, :GRID_DIMS] / eps)
                cells[rows, : at.shape[1]] = at
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("rep", "label", "unit", "copies")] + [pa.array(sizes.astype(np.int32))] + [pa.array(np.ascontiguousarray(cells[:, j])) for j in range(GRID_DIMS)], ["rep", "label", "unit", "copies", "d", *names])

    return run


_BLOCK_SCHEMA = pa.schema([("number", pa.int64()), ("label", pa.int64()), ("d", pa.int32()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("ids", pa.binary()), ("copies", pa.binary()), ("units", pa.binary())])


def _block_rows(axes: dict[int, np.ndarray], size: int):
    def make(label: int, ids: np.ndarray, copies: np.ndarray, x: np.ndarray, number: int) -> pa.RecordBatch:
        p = np.zeros((len(x), BOX_DIMS))
        y = x @ axes[x.shape[1]]
        p[:, : y.shape[1]] = y
        row = {"number": number, "label": label, "d": x.shape[1], "low": p.min(0).tolist(), "high": p.max(0).tolist(), "ids": ids.tobytes(), "copies": copies.tobytes(), "units": x.tobytes()}
        return pa.RecordBatch.from_pylist([row], _BLOCK_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, held, number = None, None, 0
        for batch in batches:
            ids, label, copies, d = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("rep", "label", "copies", "d"))
            flat, sizes = _vectors(batch.column("unit"))
            start = np.concatenate([[0], np.cumsum(sizes)])
            edge = np.flatnonzero((label[1:] != label[:-1]) | (d[1:] != d[:-1])) + 1
            for i, j in zip([0, *edge], [*edge, len(ids)], strict=True):
                if i == j:
                    continue
                now = [ids[i:j], copies[i:j], flat[start[i] : start[j]].reshape(j - i, -1)]
                if kind == (label[i], d[i]):
                    now = [np.concatenate(x) for x in zip(held, now, strict=True)]
                elif held is not None:
                    yield make(int(kind[0]), *held, number)
                    number += 1
                kind, held = (label[i], d[i]), now
                while len(held[0]) > size:
                    yield make(int(kind[0]), *(x[:size] for x in held), number)
                    held, number = [x[size:] for x in held], number + 1
        if held is not None:
            yield make(int(kind[0]), *held, number)

    return run


def _least_reached(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n rows the smallest row that it reaches over the links a, b."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        for side in (a, b, root[a], root[b]):
            np.minimum.at(new, side, least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _links(x: np.ndarray, y: np.ndarray, threshold: float, same: bool) -> np.ndarray | None:
    """Which rows of x link with which of y; None if none does."""
    hit = x @ y.T >= threshold
    if same:
        np.fill_diagonal(hit, False)
    return hit if hit.any() else None


def _tile_rows(threshold: float, eps: float):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        tile_a, tile_b = (k.as_py() for k in key)
        rows = sorted(table.to_pylist(), key=lambda r: r["number"])
        ids, copies = (np.concatenate([np.frombuffer(r[c], np.int64) for r in rows]) for c in ("ids", "copies"))
        at = np.cumsum([0, *(len(r["ids"]) // 8 for r in rows)])
        units = [np.frombuffer(r["units"]).reshape(-1, r["d"]) for r in rows]
        low, high = (np.array([r[c] for r in rows]) for c in ("low", "high"))
        n, ends = np.zeros(len(ids)), []
        for i, r in enumerate(rows):
            if r["tile"] != tile_a:
                continue
            gap = np.maximum(0, np.maximum(low[i] - high, low - high[i]))
            near = (gap * gap).sum(1) <= (eps + 1e-9) ** 2
            for j in np.flatnonzero(near[i:]) + i:
                q = rows[j]
                if q["tile"] != tile_b or (q["label"], q["d"]) != (r["label"], r["d"]):
                    continue
                hit = _links(units[i], units[j], threshold, i == j)
                if hit is None:
                    continue
                mine, other = slice(at[i], at[i + 1]), slice(at[j], at[j + 1])
                n[mine] += hit @ copies[other].astype(np.float64)
                if i != j:
                    n[other] += copies[mine].astype(np.float64) @ hit
                # one link of every row, and for each of its partners' blocks what joins them: a forest of the block pair
                a, b = np.nonzero(hit)
                root = _least_reached(len(hit) + len(hit[0]), a, len(hit) + b) if i != j else _least_reached(len(hit), a, b)
                place = np.concatenate([np.arange(at[i], at[i + 1]), np.arange(at[j], at[j + 1])]) if i != j else np.arange(at[i], at[i + 1])
                moved = root != np.arange(len(root))
                ends.append((place[moved], place[root[moved]]))
        some = np.flatnonzero(n)
        root = _least_reached(len(ids), *(np.concatenate([e[k] for e in ends]) for k in (0, 1))) if ends else np.arange(len(ids))
        return pa.table({"a": pa.array(ids[some]), "b": pa.array(ids[root[some]]), "n": pa.array(n[some].astype(np.int64))})

    return run


def _near_blocks(blocks: DataFrame, eps: float) -> DataFrame:
    """(a, b): numbers of the blocks, a <= b, of one label whose boxes are at most eps apart."""
    boxes = cut(blocks.select("number", "label", "d", *[F.get("low", i).alias(f"l{i}") for i in range(BOX_DIMS)], *[F.get("high", i).alias(f"h{i}") for i in range(BOX_DIMS)]))
    most = boxes.agg(F.max("number")).first()[0] or 0
    levels = max(1, -(-most.bit_length() // SPLIT_BITS))

    def nodes(level: int) -> DataFrame:
        return boxes.groupBy(F.shiftright("number", SPLIT_BITS * level).alias("node")).agg(
            F.min("label").alias("label_from"), F.max("label").alias("label_to"), *[F.min(f"l{i}").alias(f"l{i}") for i in range(BOX_DIMS)], *[F.max(f"h{i}").alias(f"h{i}") for i in range(BOX_DIMS)]
        )

    pairs = nodes(levels).select(F.col("node").alias("a"), F.col("node").alias("b"))
    for level in range(levels - 1, -1, -1):
        own = nodes(level).withColumn("parent", F.shiftright("node", SPLIT_BITS))
        left, right = (own.select(*[F.col(c).alias(f"{s}_{c}") for c in own.columns]) for s in "xy")
        gap = sum((F.pow(F.greatest(F.lit(0.0), F.col(f"x_l{i}") - F.col(f"y_h{i}"), F.col(f"y_l{i}") - F.col(f"x_h{i}")), 2) for i in range(BOX_DIMS)), F.lit(0.0))
        pairs = pairs.join(left, F.col("a") == F.col("x_parent")).join(right, F.col("b") == F.col("y_parent"))
        pairs = pairs.where((F.col("x_node") <= F.col("y_node")) & (F.col("x_label_from") <= F.col("y_label_to")) & (F.col("y_label_from") <= F.col("x_label_to")) & (gap <= (eps + 1e-9) ** 2))
        pairs = cut(pairs.select(F.col("x_node").alias("a"), F.col("y_node").alias("b")))
    return pairs


def _tile_bits(blocks: int, parts: int, d: int) -> int:
    """The side of a tile in blocks, as bits: tiles enough for all tasks, of bounded bytes."""
    side = min(TILE_BYTES // (BLOCK * d * 8), int(blocks / np.sqrt(8 * parts)))
    return max(0, side.bit_length() - 1)


def embedding_components(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors (vec_id, embedding, label).

    Rows link when their labels are equal and not null and the cosine of their vectors, in double precision, is at least
    the threshold. A vector that is null, empty, zero or holds a null or non-finite component links with nothing, and so
    do vectors of different lengths. n_links counts the other rows linked directly, equal vectors included; kept marks
    the smallest id of a component. A null vec_id links with nothing; a repeated one is one node whose rows count as
    vectors. Other columns are ignored; an empty table gives an empty result.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = cut(rows.mapInArrow(_unit_rows, "vec_id long, label long, unit binary, digest binary"))
    valid = rows.where("unit is not null and label is not null and vec_id is not null")
    classes = cut(valid.groupBy("label", "digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.min("unit").alias("unit")))
    axes = principal_axes(classes)
    eps = float(np.sqrt(max(0.0, 2 - 2 * threshold))) or 1e-6
    cells = [f"c{i}" for i in range(GRID_DIMS)]
    sequence = classes.mapInArrow(_cell_rows(axes, eps), "rep long, label long, unit binary, copies long, d int, " + ", ".join(f"{c} int" for c in cells))
    parts = max(1, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sequence = sequence.repartitionByRange(parts, "label", "d", *cells, "rep").sortWithinPartitions("label", "d", *cells, "rep")
    blocks = sequence.mapInArrow(_block_rows(axes, BLOCK), "number long, label long, d int, low array<double>, high array<double>, ids binary, copies binary, units binary")
    blocks = cut(blocks.withColumn("part", F.spark_partition_id().cast("long")))
    most, total = blocks.agg(F.coalesce(F.max("number"), F.lit(0)), F.count("*")).first()
    width = most.bit_length()
    blocks = blocks.withColumn("number", F.shiftleft("part", width).bitwiseOR(F.col("number"))).drop("part")
    bits = _tile_bits(total, parts, max(axes, default=1))
    tile = lambda number: F.shiftright(number, bits)
    near = _near_blocks(blocks, eps).select(tile("a").alias("tile_a"), tile("b").alias("tile_b"), F.explode(F.array("a", "b")).alias("number")).distinct()
    dealt = near.join(blocks.withColumn("tile", tile("number")), "number")
    found = cut(dealt.groupBy("tile_a", "tile_b").applyInArrow(_tile_rows(threshold, eps), "a long, b long, n long"))
    links = found.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    components = connected_components(found.select("a", "b")).withColumnRenamed("id", "rep")
    reps = classes.select("label", "digest", "rep", "copies").join(links, "rep", "left").join(components, "rep", "left")
    reps = reps.select("label", "digest", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component_id", "rep").alias("root"))
    every = rows.select("vec_id", "label", F.when(F.col("vec_id").isNotNull(), F.col("digest")).alias("digest")).join(reps, ["label", "digest"], "left")
    component = F.coalesce("root", "vec_id")
    return every.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))


def embedding_components_sql(vectors: str, threshold: float) -> str:
    """DuckDB SQL for embedding_components over a small table with distinct ids: every pair of a label is compared."""
    return f"""
WITH RECURSIVE given AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM {vectors}),
scaled AS (SELECT vec_id, label, list_transform(e, lambda x: abs(x)) AS sizes, e FROM given WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
tops AS (SELECT vec_id, label, list_transform(e, lambda x: x / list_max(sizes)) AS e FROM scaled WHERE list_max(sizes) > 0),
units AS MATERIALIZED (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS u FROM tops),
links AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM units x JOIN units y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.u) = len(y.u) WHERE list_inner_product(x.u, y.u) >= {threshold}),
reach(id, other) AS (SELECT vec_id, vec_id FROM {vectors} UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a),
roots AS (SELECT id, min(other) AS root FROM reach GROUP BY id),
degrees AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, root AS component_id, vec_id = root AS kept FROM {vectors} JOIN roots ON id = vec_id LEFT JOIN degrees ON a = vec_id
"""
