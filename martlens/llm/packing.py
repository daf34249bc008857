"""Packing by power-of-two decomposition.

A document's ids, with the end id, are cut into full windows and then by the binary digits of what is left, so every
piece has a power of two as its length and is a sequence of its own: no sequence crosses documents and none needs
padding. Pieces of equal length belong to one bucket; a training batch takes sequences of one bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import encode_slices

_SCHEMA = "doc_id long, start long, length long, doc_tokens long, ids binary"


def binary_cuts(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length) of the pieces of documents of these lengths: full windows, then falling powers of two."""
    full, rest = lengths // window, lengths % window
    digits = window.bit_length() - 1
    bits = 1 << np.arange(digits - 1, -1, -1)
    has = (rest[:, None] & bits[None, :]) > 0
    doc = np.concatenate([np.repeat(np.arange(len(lengths)), full), np.nonzero(has)[0]])
    size = np.concatenate([np.full(int(full.sum()), window, np.int64), np.broadcast_to(bits, has.shape)[has]])
    order = np.argsort(doc, kind="stable")
    doc, size = doc[order], size[order]
    before = np.cumsum(size) - size
    return doc, before - (np.cumsum(lengths) - lengths)[doc], size


def _pieces(path: str, window: int, end_id: int, added: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_id, texts = batch.column("doc_id"), batch.column("text")
            for first, last, ids, edges in encode_slices(texts, path, added):
                ids = np.insert(ids, edges[1:], end_id).astype("<u4")
                lengths = np.diff(edges) + 1
                doc, start, size = binary_cuts(lengths, window)
                ends = np.concatenate([[0], np.cumsum(size)]) * 4
                for i in range(0, len(doc), 20_000):
                    j = min(i + 20_000, len(doc))
                    data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(np.ascontiguousarray(ends[i : j + 1] - ends[i])), pa.py_buffer(ids[ends[i] // 4 : ends[j] // 4])])
                    yield pa.RecordBatch.from_arrays(
                        [doc_id.slice(first, last - first).take(pa.array(doc[i:j])), pa.array(start[i:j]), pa.array(size[i:j]), pa.array(lengths[doc[i:j]]), data.cast(pa.binary())],
                        ["doc_id", "start", "length", "doc_tokens", "ids"],
                    )

    return run


def pack_documents(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, added: bool = False) -> DataFrame:
    """Pieces of all documents: (doc_id, start, length, doc_tokens, ids, sequence_id, offset, bucket).

    ``ids`` holds the piece's ids as little-endian unsigned 32-bit integers, ``start`` the number of the document's ids
    before it, ``doc_tokens`` the document's ids with the end id, ``bucket`` the sequence's length. Each piece is a
    sequence of its own, so ``offset`` is 0. ``sequence_id`` is unique. With ``added`` the tokenizer's added tokens get their
    own ids wherever a text holds them, else they are ordinary text. A null or empty text has the end id alone. Every
    row is a document, also rows that repeat and rows without doc_id; other columns are ignored; an empty table gives an
    empty result. The window must be a power of two.
    """
    if window < 1 or window & (window - 1):
        raise ValueError("the window must be a power of two")
    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pieces(tokenizer, window, end_id, added), _SCHEMA)
    return pieces.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long")).withColumn("bucket", F.col("length"))


def bucket_report(pieces: DataFrame) -> DataFrame:
    """(bucket, sequences, tokens): what a training schedule by length draws from."""
    return pieces.groupBy("bucket").agg(F.count("*").alias("sequences"), F.sum("length").alias("tokens"))
