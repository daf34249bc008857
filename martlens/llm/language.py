"""Language identification by a bidirectional gated recurrent network over bytes.

The text's UTF-8 bytes are read in windows; a forward and a backward GRU run over each window, every position is
labelled from both states, and the label probabilities are averaged over all positions of the text. The network is
trained in numpy by backpropagation through time: windows of a bounded sample of labelled texts give it a start, and from
there each task goes on over windows of all labelled texts that it reads; what tasks have learned is averaged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import quantiles
from .common import cut
from .shingles import slices

#: State size of each direction, bytes of a window, windows run together.
HIDDEN, WINDOW, BATCH = 8, 96, 2048
#: Windows of a step over all labelled texts, its rate, and the unit of the sums of what tasks have learned.
STEP_WINDOWS, STEP_RATE, UNIT = 512, 0.002, 1 << 20
#: Bounds of the sample for the start: labelled texts for each language, over all languages, and windows of a text.
SAMPLE_TEXTS, SAMPLE_ROWS, SAMPLE_WINDOWS = 400, 80_000, 6
#: Share of a language's labelled texts that may fall under its least score.
LOST_SHARE = 0.005
_LETTER = re.compile(r"[^\W\d_]")


class ByteGru:
    """Weights of both directions; gates lie side by side as update, reset, candidate."""

    def __init__(self, labels: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        h, k = HIDDEN, len(labels)
        self.labels = labels
        self.w: dict[str, np.ndarray] = {}
        for d in "fb":
            self.w[f"x{d}"] = rng.normal(0, 0.3, (256, 3 * h)).astype(np.float32)
            self.w[f"u{d}"] = rng.normal(0, 0.3, (h, 3 * h)).astype(np.float32)
            self.w[f"o{d}"] = rng.normal(0, 0.3, (h, k)).astype(np.float32)
        self.w["bias"] = np.zeros(k, np.float32)

    def states(self, x: np.ndarray, d: str, keep: bool = False):
        """States after each step of (steps, windows) bytes in one direction, (steps, state, windows); with keep also the
        states before each step, update, reset and candidate.

        Windows lie side by side in memory. Of exp(-a) + 1 a gate is the inverse, and exp(2 a) gives the tanh of the
        candidate, at a third of the time that tanh takes itself; past the range of floats both end where they should.
        """
        h, n, steps = HIDDEN, x.shape[1], range(len(x)) if d == "f" else range(len(x) - 1, -1, -1)
        scale = np.repeat(np.array([-1, -1, 2], np.float32), h)
        wx, u = (np.ascontiguousarray((self.w[f"{k}{d}"] * scale).T, np.float32) for k in "xu")
        path, kept = np.empty((len(x) + 1, h, n), np.float32), np.empty((len(x) if keep else 1, 3 * h, n), np.float32)
        before, out = (path[:-1], path[1:]) if d == "f" else (path[1:], path[:-1])
        s = path[0 if d == "f" else -1]
        s[:] = 0
        a, held = np.empty((3 * h, n), np.float32), np.empty((h, n), np.float32)
        x = x.astype(np.intp)
        with np.errstate(over="ignore"):
            for t in steps:
                np.take(wx, x[t], axis=1, out=a, mode="clip")
                own = kept[t if keep else 0]
                g, c = own[: 2 * h], own[2 * h :]
                np.matmul(u[: 2 * h], s, out=g)
                g += a[: 2 * h]
                np.exp(g, out=g)
                g += 1
                np.divide(s, g[h:], out=held)
                np.matmul(u[2 * h :], held, out=c)
                c += a[2 * h :]
                np.exp(c, out=c)
                c += 1
                np.divide(-2, c, out=c)
                c += 1
                new = out[t]
                np.subtract(c, s, out=new)
                new /= g[:h]
                new += s
                s = new
        if not keep:
            return out
        np.reciprocal(kept[:, : 2 * h], out=kept[:, : 2 * h])
        return out, before, kept[:, :h], kept[:, h : 2 * h], kept[:, 2 * h :]

    def _softmax(self, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
        """Label probabilities (steps, labels, windows) from the states of both directions."""
        p = np.matmul(self.w["of"].T, forward)
        p += np.matmul(self.w["ob"].T, backward)
        p += self.w["bias"][:, None]
        p -= p.max(1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(1, keepdims=True)
        return p

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Label probabilities (steps, labels, windows)."""
        return self._softmax(self.states(x, "f"), self.states(x, "b"))

    def gradients(self, x: np.ndarray, y: np.ndarray, weights: np.ndarray | None = None) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over all positions, and its gradients by backpropagation through time, of windows of these
        weights, whose mean is 1."""
        h, total, windows = HIDDEN, x.size, np.arange(x.shape[1])
        kept = {d: self.states(x, d, True) for d in "fb"}
        p = self._softmax(kept["f"][0], kept["b"][0])
        loss = float(-np.log(np.maximum(p[:, y, windows], 1e-9)).mean())
        p[:, y, windows] -= 1
        p /= total
        if weights is not None:
            p *= weights.astype(np.float32)
        over = lambda a, b: np.matmul(a, b.transpose(0, 2, 1)).sum(0)  # noqa: E731  of all positions
        grads = {"bias": p.sum((0, 2))}
        for d in "fb":
            state, before, z, r, c = kept[d]
            grads[f"o{d}"] = over(state, p)
            u, out, da = self.w[f"u{d}"], np.matmul(self.w[f"o{d}"], p), np.empty((3 * h, *x.shape), np.float32)
            by_c, by_z, by_r, stays = z * (1 - c * c), (c - before) * z * (1 - z), before * r * (1 - r), 1 - z
            ds = np.zeros((h, x.shape[1]), np.float32)
            for t in range(len(x) - 1, -1, -1) if d == "f" else range(len(x)):
                ds += out[t]
                np.multiply(ds, by_c[t], out=da[2 * h :, t])
                drs = u[:, 2 * h :] @ da[2 * h :, t]
                np.multiply(ds, by_z[t], out=da[:h, t])
                np.multiply(drs, by_r[t], out=da[h : 2 * h, t])
                ds *= stays[t]
                drs *= r[t]
                ds += drs
                ds += u[:, : 2 * h] @ da[: 2 * h, t]
            by_step = da.transpose(1, 0, 2)
            grads[f"u{d}"] = np.concatenate([over(before, by_step[:, : 2 * h]), over(r * before, by_step[:, 2 * h :])], 1)
            grads[f"x{d}"] = np.stack([np.bincount(x.ravel(), row.ravel(), 256) for row in da], 1).astype(np.float32)
        return loss, grads

    def fit(self, windows: np.ndarray, labels: np.ndarray, steps: int = 260, batch: int = 192, rate: float = 0.03, seed: int = 9) -> ByteGru:
        """Adam over batches with equal shares of the labels; windows is (windows, bytes)."""
        rng = np.random.default_rng(seed)
        by = [np.flatnonzero(labels == k) for k in range(len(self.labels))]
        step = self.stepper()
        for i in range(1, steps + 1):
            pick = np.concatenate([rng.choice(of, max(1, batch // len(by))) for of in by if len(of)])
            step(windows[pick], labels[pick], rate * min(1.0, 2 * (1 - i / (steps + 1))))
        return self

    def stepper(self):
        """Adam's step(windows, labels, rate, weights) with its own moments."""
        m = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.w.items()}
        steps = 0

        def step(windows: np.ndarray, labels: np.ndarray, rate: float, weights: np.ndarray | None = None) -> None:
            nonlocal steps
            steps += 1
            _, grads = self.gradients(np.ascontiguousarray(windows.T), labels, weights)
            for k, g in grads.items():
                a, b = m[k]
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                self.w[k] = self.w[k] - rate * (a / (1 - 0.9**steps)) / (np.sqrt(b / (1 - 0.99**steps)) + 1e-7)

        return step

    def flat(self) -> np.ndarray:
        return np.concatenate([self.w[k].ravel() for k in sorted(self.w)]).astype(np.float64)

    def moved(self, by: np.ndarray) -> ByteGru:
        """The network with its weights moved by a flat array."""
        out, at = ByteGru(self.labels), 0
        for k in sorted(self.w):
            n = self.w[k].size
            out.w[k] = (self.w[k] + by[at : at + n].reshape(self.w[k].shape)).astype(np.float32)
            at += n
        return out

    def pooled(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first, last + 1, mean label probabilities of each text) of runs of texts."""
        for first, last, data, bounds in slices(texts):
            n = np.diff(bounds)
            many = -(-n // WINDOW)
            owner = np.repeat(np.arange(len(n)), many)
            start = bounds[owner] + WINDOW * (np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many))
            size = np.minimum(WINDOW, bounds[owner + 1] - start)
            order = np.argsort(size, kind="stable")
            sums = np.zeros((len(owner), len(self.labels)))
            for i in range(0, len(order), BATCH):
                w = order[i : i + BATCH]
                longest = int(size[w].max())
                at = start[w][None, :] + np.arange(longest)[:, None]
                inside = np.arange(longest)[:, None] < size[w][None, :]
                x = np.where(inside, data[np.minimum(at, len(data) - 1)], 10)
                p = self.probabilities(x)
                if not inside.all():
                    p *= inside[:, None, :]
                sums[w] = p.sum(0, dtype=np.float64).T
            total = np.add.reduceat(sums, np.cumsum(many) - many, axis=0)
            yield first, last, total / n[:, None]


def sample_texts(docs: DataFrame, texts: int = SAMPLE_TEXTS, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, lang) of the labelled texts with the smallest hashes of doc_id, up to ``texts`` for each language.

    Over all languages they are at most ``rows``: those that come first in their languages, so that none is left out for
    its name.
    """
    from pyspark.sql import Window

    found = docs.where("lang is not null and text is not null and doc_id is not null").select("doc_id", "lang").distinct().withColumn("h", F.xxhash64("doc_id"))
    # first within salted parts of a language, so that no task gets what all tasks have kept of one
    for part in ([F.col("lang"), F.pmod("h", F.lit(64))], [F.col("lang")]):
        order = Window.partitionBy(*part).orderBy("h", "doc_id")
        found = found.withColumn("i", F.row_number().over(order)).where(F.col("i") <= texts)
    return found.orderBy("i", "h", "doc_id", "lang").limit(rows).select("doc_id", "lang")


def spread_windows() -> Column:
    """Different windows spread over the whole text."""
    n = F.octet_length("text")
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(SAMPLE_WINDOWS - 1)), lambda i: F.substring(F.col("text").cast("binary"), (F.greatest(F.lit(0), n - WINDOW) * i / (SAMPLE_WINDOWS - 1)).cast("int") + 1, F.lit(WINDOW))))


def training_windows(docs: DataFrame, texts: int = SAMPLE_TEXTS, rows: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, windows, index of each window's language) from docs (doc_id, text, lang): windows spread over each whole
    text of the sample. Of rows that repeat an id and language the least list of windows counts."""
    chosen = sample_texts(docs, texts, rows)
    # one row for each of the sample, at most ``rows`` of bounded size
    found = docs.join(F.broadcast(chosen), ["doc_id", "lang"]).select("doc_id", "lang", spread_windows().alias("w")).groupBy("doc_id", "lang").agg(F.min("w").alias("w")).select("lang", "w").collect()
    found.sort(key=lambda r: (r[0], r[1]))
    labels = sorted({r[0] for r in found})
    index = {name: i for i, name in enumerate(labels)}
    pieces = [(bytes(w).ljust(WINDOW, b"\n"), index[r[0]]) for r in found for w in r[1] if len(w)]
    windows = np.frombuffer(b"".join(p for p, _ in pieces), np.uint8).reshape(-1, WINDOW)
    return labels, windows, np.array([i for _, i in pieces], np.int64)


def train_language_model(docs: DataFrame, **bounds) -> ByteGru | None:
    """A network fitted on all rows of docs (doc_id, text, lang) with a language; None if no text has one."""
    labels, windows, index = training_windows(docs, **bounds)
    return learn_from_all(docs, ByteGru(labels).fit(windows, index)) if len(windows) else None


def learn_from_all(docs: DataFrame, start: ByteGru) -> ByteGru:
    """The network after one pass over windows of all labelled texts of docs (text, lang).

    Each task takes steps from the start over what it reads, in which languages weigh alike by their numbers of texts, and
    gives back by how much it moved each weight; the mean of these, by windows, is as many rows as there are weights,
    however many tasks there are. Sums are of whole numbers, so they do not depend on an order.
    """
    known = docs.where(F.col("text") != "").where(F.col("lang").isin(start.labels))
    texts = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}  # one row for each language
    if not texts:
        return start
    weight = np.array([sum(texts.values()) / len(texts) / texts.get(name, np.inf) for name in start.labels])
    held = docs.sparkSession.sparkContext.broadcast((start, weight))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, weight = held.value
        own, index = start.moved(np.zeros(len(start.flat()))), {name: i for i, name in enumerate(start.labels)}
        step, seen, pieces, labels = own.stepper(), 0, [], []

        def take() -> None:
            y = np.array(labels, np.int64)
            step(np.frombuffer(b"".join(pieces), np.uint8).reshape(-1, WINDOW), y, STEP_RATE, weight[y] / weight[y].mean())
            pieces.clear()
            labels.clear()

        for batch in batches:
            for lang, spread in zip(batch.column("lang").to_pylist(), batch.column("w").to_pylist(), strict=True):
                pieces += [w.ljust(WINDOW, b"\n") for w in spread]
                labels += [index[lang]] * len(spread)
                seen += len(spread)
                if len(labels) >= STEP_WINDOWS:
                    take()
        if labels:
            take()
        if seen:
            moved = np.rint((own.flat() - start.flat()) * UNIT).astype(np.int64) * seen
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(moved))), pa.array(np.concatenate([[seen], moved]))], ["at", "moved"])

    sums = known.select("lang", spread_windows().alias("w")).mapInArrow(learn, "at long, moved long").groupBy("at").agg(F.sum("moved").alias("moved"))
    found = dict(map(tuple, sums.collect()))  # one row for each weight
    seen = found.pop(-1)
    return start.moved(np.array([found[i] for i in range(len(found))]) / seen / UNIT)


def predict_language(docs: DataFrame, model: ByteGru | None, text: str = "text") -> Column:
    """A column struct(lang, score) for docs[text]: the label with the highest mean probability over all positions of the
    whole text, and that probability. ``und`` and 0 for a null text, one without letters, and if there is no model."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = "lang string, score double"

    @F.arrow_udf(kind)
    def predict(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            for first, last, p in held.value.pooled(texts) if held.value is not None else ():
                best = p.argmax(1)
                for i in range(first, last):
                    if (t := texts[i].as_py()) and _LETTER.search(t):
                        lang[i], score[i] = held.value.labels[best[i - first]], min(1.0, p[i - first, best[i - first]])
            yield pa.StructArray.from_arrays([pa.array(lang), pa.array(score)], ["lang", "score"])

    # else a filter on the column runs the network once more than the projection
    return predict.asNondeterministic()(docs[text])


def least_scores(scored: DataFrame, share: float = LOST_SHARE) -> dict[str, float]:
    """For each lang of scored (lang, score), labelled texts that were rightly predicted, the score that all but ``share`` of
    them reach: an exact quantile of all rows. A language without such texts is left out."""
    # less a little, for scores of one value differ in their last digits
    return {lang: least - 1e-6 for lang, least in quantiles(cut(scored.select("lang", "score")), "score", [share], ["lang"]).collect()}


def identify_languages(docs: DataFrame, learn: DataFrame) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of docs (doc_id, text), learning from the rows of learn (doc_id, text, lang).

    Repeated rows and null ids are rows like others; other columns are ignored; an empty table gives an empty result.
    """
    model = train_language_model(learn)
    return docs.select("doc_id", predict_language(docs, model).alias("p")).select("doc_id", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))
