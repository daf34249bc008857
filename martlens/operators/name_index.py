"""An exact index for the best match of names by their longest common subsequence.

Names of la and lb characters with a common subsequence of c have the ratio 200 c / (la + lb), and la + lb - 2 c insertions
and deletions lie between them. At least as many as their counts of characters differ by in all, for each of them changes
one count by one. So the counts bound a ratio from above, and merging characters into a few kinds keeps that true. A k-d
tree over the counts parts the names into leaves of like names. Each left name is first compared with right names of its
own leaf; what it finds there is the score that any other name must reach. Pairs of leaves whose boxes differ by too much
for that score are never compared, and within a pair of leaves only names whose own counts allow it. The better the
matches are, the less there is to compare, and nothing that could win or tie is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import staged

#: Kinds of characters: letters, digits, and others by their code; and the most leaves: the driver holds a tree, and while
#: it is made four sampled names for each leaf.
KINDS, LEAVES = 40, 1 << 13
#: Lower ends of the ranges of scores that the left names of a block have found at home.
_TIERS = (0, 80, 90, 97)


class NameBits:
    """Names as arrays of characters, for comparing one name with all of them at once.

    A row of bits for each name holds the state of a longest common subsequence, 64 characters to a word: after a step
    for every character of the other name its zeros are the subsequence.
    """

    def __init__(self, names: list[str]):
        self.lengths = np.fromiter(map(len, names), np.int64, len(names))
        self.words = max(1, -(-int(self.lengths.max()) // 64))
        self.alphabet = {c: i for i, c in enumerate(sorted(set("".join(names))))}
        self.places = np.zeros((len(self.alphabet) + 1, self.words, len(names)), np.uint64)
        for n, name in enumerate(names):
            for i, c in enumerate(name):
                self.places[self.alphabet[c], i // 64, n] |= np.uint64(1 << (i % 64))

    def common(self, name: str, among: np.ndarray | None = None) -> np.ndarray:
        """The length of the longest common subsequence with every name, or with those of the given places."""
        lengths = self.lengths if among is None else self.lengths[among]
        rows = np.full((self.words, len(lengths)), ~np.uint64(0))
        for c in name:
            hits = self.places[self.alphabet.get(c, len(self.alphabet))]
            hits = hits if among is None else hits[:, among]
            carry = np.zeros(len(lengths), np.uint64)
            for w in range(self.words):
                row = rows[w]
                hit = row & hits[w]
                total = row + hit
                over = total < row
                total += carry
                carry = (over | (total < carry)).astype(np.uint64)
                rows[w] = total | (row - hit)
        held = np.arange(self.words)[:, None] * 64
        used = np.clip(lengths[None, :] - held, 0, 64).astype(np.uint64)
        mask = np.where(used == 64, ~np.uint64(0), (np.uint64(1) << np.minimum(used, np.uint64(63))) - np.uint64(1))
        return np.bitwise_count(~rows & mask).sum(0, dtype=np.int64)

    def ratios(self, name: str, among: np.ndarray | None = None) -> np.ndarray:
        """100 * 2 * LCS / (sum of lengths) with every name, rounded to even."""
        lengths = self.lengths if among is None else self.lengths[among]
        return np.rint(200.0 * self.common(name, among) / (lengths + len(name))).astype(np.int64)


def character_counts(names: list[str]) -> np.ndarray:
    """How many characters of each kind each name has."""
    codes = np.frombuffer("".join(names).encode("utf-32-le"), "<u4").astype(np.int64)
    letter, digit = (codes >= 97) & (codes < 123), (codes >= 48) & (codes < 58)
    kind = np.where(letter, codes - 97, np.where(digit, codes - 22, 36 + codes % 4))
    owner = np.repeat(np.arange(len(names)), np.fromiter(map(len, names), np.int64, len(names)))
    return np.bincount(owner * KINDS + kind, minlength=len(names) * KINDS).reshape(-1, KINDS).astype(np.int32)


def kd_tree(points: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(axis, threshold) of the inner nodes of a tree in heap order: medians along the axis of the greatest variance."""
    axis, threshold = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1)
    held = {0: points}
    for node in range(len(axis)):
        own = held.pop(node)
        if len(own):
            axis[node] = int(own.var(axis=0).argmax())
            threshold[node] = np.median(own[:, axis[node]])
        right = own[:, axis[node]] > threshold[node]
        if 2 * node + 2 < len(axis):
            held[2 * node + 1], held[2 * node + 2] = own[~right], own[right]
    return axis, threshold


def leaf_of(points: np.ndarray, axis: np.ndarray, threshold: np.ndarray) -> np.ndarray:
    node = np.zeros(len(points), np.int64)
    for _ in range((len(axis) + 1).bit_length() - 1):
        node = 2 * node + 1 + (points[np.arange(len(points)), axis[node]] > threshold[node])
    return node - len(axis)


def within(need, lengths):
    """The greatest distance at which names of this sum of lengths have a rounded score of at least ``need``."""
    return (1 - (need - 0.5) / 100) * lengths + 1e-9


def _points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = character_counts(batch.column("tokens").to_pylist())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x.tobytes() for x in counts], pa.binary())], [*batch.schema.names, "at"])


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int32).reshape(-1, KINDS)


def _with_leaf(tree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf_of(_matrix(batch.column("at")), *tree), pa.int32())], [*batch.schema.names, "leaf"])

    return run


def best_of(left: pa.Table, right: pa.Table) -> tuple[np.ndarray, np.ndarray, int]:
    """(scores, right ids, comparisons): for each left name, of a score it ``need``s, the best right name that reaches it, or 0.

    Right names whose counts rule that score out are not compared; of equals the least right_id counts.
    """
    score, found, compared = np.zeros(left.num_rows, np.int64), np.zeros(left.num_rows, np.int64), 0
    if left.num_rows and right.num_rows:
        right = right.sort_by("right_id")
        bits, ids, theirs = NameBits(right.column("tokens").to_pylist()), right.column("right_id").to_numpy(), _matrix(right.column("at"))
        sums = theirs.sum(1)
        own, need = _matrix(left.column("at")), left.column("need").to_numpy()
        for n, name in enumerate(left.column("tokens").to_pylist()):
            apart = np.abs(theirs - own[n]).sum(1)
            able = np.flatnonzero(apart <= within(need[n], sums + len(name)))
            if len(able):
                compared += len(able)
                got = bits.ratios(name, able)
                best = int(got.argmax())  # the first of equals has the least right_id
                if got[best] >= need[n]:
                    score[n], found[n] = got[best], ids[able[best]]
    return score, found, compared


def _home(left: pa.Table, right: pa.Table) -> pa.Table:
    """The left names with what they find in a block of their own leaf: ``need`` becomes its score."""
    score, found, _ = best_of(left, right)
    need = np.maximum(left.column("need").to_numpy(), score)
    keep = left.select(["tokens", "at", "leaf"])
    return keep.append_column("need", pa.array(need, pa.int32())).append_column("score", pa.array(score, pa.int32())).append_column("right_id", pa.array(found, pa.int64()))


def _away(left: pa.Table, right: pa.Table) -> pa.Table:
    score, found, _ = best_of(left, right)
    some = np.flatnonzero(score)
    return pa.table({"tokens": left.column("tokens").take(pa.array(some)), "score": pa.array(score[some], pa.int32()), "right_id": pa.array(found[some], pa.int64())})


_BOX = "block int, low binary, high binary, longest int, need int, n long"


def _part_boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if len(batch):
            at, key = _matrix(batch.column("at")), batch.column("block").to_numpy()
            order = np.argsort(key, kind="stable")
            blocks, first = np.unique(key[order], return_index=True)
            over = lambda f, x: f.reduceat(x[order], first, axis=0)
            low, high = over(np.minimum, at), over(np.maximum, at)
            yield _boxes(blocks, low, high, over(np.maximum, at.sum(1)), over(np.minimum, batch.column("need").to_numpy()), np.diff(np.append(first, len(key))))


def _boxes(blocks, low, high, longest, need, n) -> pa.RecordBatch:
    raw = lambda x: pa.array([r.astype(np.int32).tobytes() for r in x], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), raw(low), raw(high), pa.array(longest, pa.int32()), pa.array(need, pa.int32()), pa.array(n, pa.int64())], ["block", "low", "high", "longest", "need", "n"])


def _whole_box(key: tuple, parts: pa.Table) -> pa.Table:
    of = lambda c: parts.column(c).to_numpy()
    low, high = _matrix(parts.column("low")).min(0), _matrix(parts.column("high")).max(0)
    return pa.Table.from_batches([_boxes([key[0].as_py()], [low], [high], [of("longest").max()], [of("need").min()], [of("n").sum()])])


def boxes(rows: DataFrame, block: str) -> DataFrame:
    """One row for each block of names: the least and greatest counts, the longest name, the least score needed, and how many there are."""
    return rows.select(F.col(block).alias("block"), "at", "need").mapInArrow(_part_boxes, _BOX).groupBy("block").applyInArrow(_whole_box, _BOX)


def _reachable(low, high, longest, names, chunks, size: int):
    """Boxes of left blocks to the leaves of right names, of these bounds, that they can reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lows, highs = _matrix(batch.column("low")), _matrix(batch.column("high"))
            u, need, most, n = (batch.column(c).to_numpy() for c in ("block", "need", "longest", "n"))
            for k in range(len(batch)):
                gap = np.maximum(np.maximum(lows[k] - high, low - highs[k]), 0).sum(1)
                near = np.flatnonzero(gap <= within(need[k], most[k] + longest))
                near = near[(names[near] != u[k] // len(_TIERS)) | (chunks[near] > 1)]  # a leaf of one chunk was met at home
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(near), u[k]), pa.int32()), pa.array(names[near], pa.int32()), pa.array(np.full(len(near), -(-n[k] // size)), pa.int32()), pa.array(chunks[near], pa.int32())], ["u", "v", "of_u", "of_v"])

    return run


def _chunk(column: str):
    return F.pmod(F.xxhash64("tokens"), F.col(column)).cast("int")


def _places(column: str):
    return F.explode(F.sequence(F.lit(0), F.col(column) - 1))


def _again(df: DataFrame) -> DataFrame:
    """The same rows with columns of their own, for the other side of a cogroup."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def placed(names: DataFrame) -> DataFrame:
    """names (tokens, ...) with their counts of characters, from a written table."""
    return staged(names.mapInArrow(_points, ", ".join(f"{n} {t}" for n, t in names.dtypes) + ", at binary"))


def leaves(names: DataFrame, tree) -> DataFrame:
    return names.mapInArrow(_with_leaf(tree), ", ".join(f"{n} {t}" for n, t in names.dtypes) + ", leaf int")


def block_pairs(seeded: DataFrame, right: DataFrame, block: int) -> DataFrame:
    """(u, v, of_u, of_v): pairs of left blocks and right leaves that must be compared, and in how many chunks each lies."""
    found = boxes(right.withColumn("need", F.lit(0)), "leaf").collect()  # one row for each leaf
    low, high = (np.frombuffer(b"".join(bytes(b[c]) for b in found), np.int32).reshape(-1, KINDS) for c in ("low", "high"))
    longest, names, n = (np.array([b[c] for b in found], np.int64) for c in ("longest", "block", "n"))
    return boxes(seeded, "u").mapInArrow(_reachable(low, high, longest, names, -(-n // block), block), "u int, v int, of_u int, of_v int")


def best_names(left: DataFrame, right: DataFrame, accept: int, block: int) -> DataFrame:
    """(tokens, right_id, score): for each name of left (tokens) its best of right (tokens, right_id) with at least ``accept``.

    Names are distinct on both sides and not empty; of equal scores the least right_id counts. Tasks compare a chunk of at
    most about ``block`` names of either side and give back one row at most for each left name.
    """
    by_hash = lambda df, n: df.orderBy(F.xxhash64("tokens")).limit(n)
    a, b = placed(left), placed(right)
    wanted = max(1, min(LEAVES, -(-max(a.count(), b.count()) // block)))
    depth = (wanted - 1).bit_length()
    sample = by_hash(a.select("tokens", "at").unionByName(b.select("tokens", "at")), 4 << depth).select("at").collect() if depth else []
    tree = kd_tree(np.frombuffer(b"".join(bytes(r[0]) for r in sample), np.int32).reshape(-1, KINDS), depth)
    a, b = leaves(a, tree).withColumn("need", F.lit(accept)), staged(leaves(b, tree))
    # at home: a chunk of a leaf's left names meets one chunk of its right names
    count = lambda df, n: df.groupBy("leaf").agg(F.ceil(F.count("*") / block).cast("int").alias(n))
    sizes = staged(count(a, "of_u").join(count(b, "of_v"), "leaf", "full").fillna(1))  # one row for each leaf
    x = a.join(F.broadcast(sizes), "leaf").withColumn("i", _chunk("of_u")).withColumn("j", F.pmod("i", F.col("of_v")))
    y = b.join(F.broadcast(_again(sizes)), "leaf").withColumn("j", _chunk("of_v")).withColumn("i", _places("of_u")).where(F.pmod("i", F.col("of_v")) == F.col("j"))
    kept = "tokens string, at binary, leaf int, need int, score int, right_id long"
    seeded = staged(x.groupBy("leaf", "i", "j").cogroup(y.groupBy("leaf", "i", "j")).applyInArrow(_home, kept))
    if wanted == 1:  # a chunk of either side: all have met
        return seeded.where("score > 0").select("tokens", "right_id", "score")
    tier = sum(((F.col("score") >= t).cast("int") for t in _TIERS[1:]), F.lit(0))
    seeded = seeded.withColumn("u", (F.col("leaf") * len(_TIERS) + tier).cast("int"))
    pairs = staged(block_pairs(seeded, b, block))
    keys = ["u", "v", "i", "j"]
    x = seeded.drop("score", "right_id", "leaf").join(pairs, "u").withColumn("i", _chunk("of_u")).withColumn("j", _places("of_v"))
    y = b.withColumnRenamed("leaf", "v").join(_again(pairs), "v").withColumn("j", _chunk("of_v")).withColumn("i", _places("of_u"))
    found = x.groupBy(*keys).cogroup(y.groupBy(*keys)).applyInArrow(_away, "tokens string, score int, right_id long")
    found = found.unionByName(seeded.where("score > 0").select("tokens", "score", "right_id"))
    best = found.groupBy("tokens").agg(F.min(F.struct((-F.col("score")).alias("s"), "right_id")).alias("m"))
    return best.select("tokens", F.col("m.right_id").alias("right_id"), (-F.col("m.s")).alias("score"))
