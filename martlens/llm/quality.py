"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network with a temperature.

A word (a run of letters, digits and non-ASCII bytes, or a run of other visible bytes) falls in one of a fixed number of
buckets. Each bucket has a sparse random index vector, and its word vector is the sum of the index vectors of its
neighbours up to two words away over the whole corpus. A document's features are moments of its words' vectors. The
network is trained in numpy on a bounded sample of labelled rows; a temperature fitted on rows that it was not trained
on turns its outputs into calibrated probabilities.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shingles import _BYTE, _power_tables, mix64, slices

#: Buckets of words (as bits), dimensions, non-zero components of an index vector, and reach of a context.
WORD_BITS, DIMS, NONZERO, REACH = 14, 32, 4, 2
_SEGMENT = 1 << 10
#: Splits of the input that one task turns into one table, and tables (256 KB a segment) that one group adds up.
SPLITS_A_TASK, TABLES_A_GROUP = 4, 64
#: Bound of the training sample.
SAMPLE_ROWS = 12_000
_KIND = np.full(256, 2, np.int8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero components of each bucket's index vector."""
    rng = np.random.default_rng(11)
    places = np.argsort(rng.random((1 << WORD_BITS, DIMS)), 1)[:, :NONZERO]
    return places, rng.choice([-1.0, 1.0], places.shape)


def words(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last + 1, buckets of the words, where each text's words start and the end) of runs of texts."""
    for first, last, data, bounds in slices(texts):
        kind = _KIND[data]
        edge = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]))
        start, stop = edge, np.append(edge[1:], len(data))
        seen = kind[start] > 0
        start, stop = start[seen], stop[seen]
        up, down = _power_tables(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[:-1], out=sums[1:])
        bucket = (mix64((sums[stop] - sums[start]) * down[start]) >> np.uint64(64 - WORD_BITS)).astype(np.int64)
        yield first, last, bucket, np.searchsorted(start, bounds)


def _context_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    places, signs = index_vectors()
    total = np.zeros((1 << WORD_BITS) * DIMS)
    for batch in batches:
        for _, _, bucket, at in words(batch.column("text")):
            owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
            for gap in range(1, REACH + 1):
                same = owner[gap:] == owner[:-gap]
                a, b = bucket[:-gap][same], bucket[gap:][same]
                for x, y in ((a, b), (b, a)):
                    for j in range(NONZERO):
                        total += np.bincount(x * DIMS + places[y, j], signs[y, j], len(total))
    total = total.reshape(-1, _SEGMENT * DIMS)
    rows = [(i, zlib.crc32(t.tobytes()), t.tobytes()) for i, t in enumerate(total) if t.any()]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["segment", "salt", "data"])


def _sum_rows(key: tuple, table: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(x) for x in table.column("data").to_pylist()], axis=0)
    return pa.table({"segment": pa.array([key[0].as_py()], pa.int32()), "salt": pa.array([key[1].as_py()], pa.int64()), "data": pa.array([total.tobytes()], pa.binary())})


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The vectors of all buckets, of unit length about their mean: a table of fixed size, from all texts of docs."""
    schema = "segment int, salt long, data binary"
    texts = docs.select("text")
    # each task returns one table; tasks grow with the input, so that each reads a bounded part of it
    tasks = max(4 * docs.sparkSession.sparkContext.defaultParallelism, -(-texts.rdd.getNumPartitions() // SPLITS_A_TASK))
    parts = texts.coalesce(tasks).mapInArrow(_context_rows, schema)
    groups = tasks
    while groups > 1:  # a tree of sums: at most about TABLES_A_GROUP tables in one group, however many tasks there are
        groups = -(-groups // TABLES_A_GROUP)
        parts = parts.withColumn("salt", F.col("salt") % groups).groupBy("segment", "salt").applyInArrow(_sum_rows, schema)
    vectors = np.zeros((1 << WORD_BITS, DIMS))
    for segment, _, data in parts.toLocalIterator():
        vectors[segment * _SEGMENT : (segment + 1) * _SEGMENT] = np.frombuffer(bytes(data)).reshape(-1, DIMS)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    vectors -= vectors[vectors.any(1)].mean(0) if vectors.any() else 0
    return (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled_features(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Features of each text: mean and mean square of its words' vectors, mean products of words 1 to 3 apart, and its length."""
    out = np.zeros((len(texts), 2 * DIMS + 7))
    for first, last, bucket, at in words(texts):
        if not len(bucket):
            continue
        n = np.diff(at)
        some = np.flatnonzero(n)
        starts = at[:-1][some]
        v = vectors[bucket]
        rows = out[first:last]
        share = 1.0 / n[some][:, None]
        rows[some, :DIMS] = np.add.reduceat(v, starts, axis=0) * share
        rows[some, DIMS : 2 * DIMS] = np.add.reduceat(v * v, starts, axis=0) * share
        owner = np.repeat(np.arange(len(n)), n)
        for gap in range(1, 4):
            same = owner[gap:] == owner[:-gap]
            dots = np.einsum("ij,ij->i", v[gap:], v[:-gap]) * same
            equal = (bucket[gap:] == bucket[:-gap]) & same
            for column, values in ((gap - 1, dots), (gap + 2, equal)):
                rows[:, 2 * DIMS + column] = np.bincount(owner[gap:], values, len(n)) / np.maximum(n - gap, 1)
        rows[:, -1] = np.log1p(n) / 10
    return out


@dataclass
class QualityModel:
    vectors: np.ndarray
    center: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        return self.probability(pooled_features(texts, self.vectors))

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.center) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -50, 50)))


def fit_network(x: np.ndarray, y: np.ndarray, vectors: np.ndarray, hidden: int = 32, epochs: int = 60, seed: int = 3) -> QualityModel:
    """Two layers trained with Adam on four fifths of the rows; the temperature minimises the log loss of the others."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    cut = max(1, len(x) // 5)
    held, own = (order[:cut], order[cut:]) if len(x) > 50 else (order, order)
    center, scale = x[own].mean(0), x[own].std(0) + 1e-3
    z = (x - center) / scale
    p = {"w1": rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), "b1": np.zeros(hidden), "w2": rng.normal(0, 1 / np.sqrt(hidden), hidden), "b2": np.zeros(1)}
    m = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    step, batch = 0, 128
    for _ in range(epochs):
        rng.shuffle(own)
        for i in range(0, len(own), batch):
            b, step = own[i : i + batch], step + 1
            h = np.tanh(z[b] @ p["w1"] + p["b1"])
            d = (1 / (1 + np.exp(-(h @ p["w2"] + p["b2"]))) - y[b]) / len(b)
            dh = np.outer(d, p["w2"]) * (1 - h * h)
            grads = {"w1": z[b].T @ dh + 1e-4 * p["w1"], "b1": dh.sum(0), "w2": h.T @ d + 1e-4 * p["w2"], "b2": np.array([d.sum()])}
            for k, g in grads.items():
                a, q = m[k]
                a += 0.1 * (g - a)
                q += 0.001 * (g * g - q)
                p[k] = p[k] - 0.003 * (a / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.999**step)) + 1e-8)
    model = QualityModel(vectors, center, scale, p["w1"], p["b1"], p["w2"], float(p["b2"][0]), 1.0)
    logit, target = model.logit(x[held]), y[held]
    grid = np.exp(np.linspace(-1.5, 2.5, 81))
    loss = [np.mean(np.logaddexp(0, logit / t) - target * logit / t) for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    return model


def train_quality_model(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> QualityModel | None:
    """A model with word vectors from all texts of docs, fitted on the up to ``rows`` labelled rows whose doc_id has the
    smallest hashes. labels has doc_id and quality; None if no text has a label."""
    vectors = word_vectors(docs)
    held = docs.sparkSession.sparkContext.broadcast(vectors)
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pooled_features(batch.column("text"), held.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "quality", "x"])

    # one row of features for each label, so at most ``rows``; of rows that repeat an id the least features count
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").mapInArrow(features, "doc_id long, quality int, x binary")
    sample = known.groupBy("doc_id", "quality").agg(F.min("x").alias("x")).collect()
    sample.sort(key=lambda r: (r[0], bytes(r[2])))
    if not sample:
        return None
    x = np.array([np.frombuffer(bytes(r[2])) for r in sample])
    return fit_network(x, np.array([float(r[1] > 0) for r in sample]), vectors)


def quality_score(docs: DataFrame, model: QualityModel | None, text: str = "text") -> Column:
    """A column of the calibrated probability that docs[text] has quality 1; a null text counts as empty, without a model it is 0.5."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            yield pa.array(held.value.scores(texts) if held.value is not None else np.full(len(texts), 0.5), pa.float64())

    return score(docs[text])


def score_quality(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) of every row of docs (doc_id, text), learning from labels (doc_id, quality).

    predicted is 1 if the score is at least ``least``. Empty and null texts have a score as well; repeated rows and null
    ids are rows like others; other columns are ignored; an empty table gives an empty result.
    """
    model = train_quality_model(docs, labels)
    scored = docs.select("doc_id", quality_score(docs, model).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= least, 1).otherwise(0))
