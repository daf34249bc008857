"""Byte-level BPE ids of whole texts, encoding each distinct piece of a slice of texts once.

A byte-level BPE first cuts a text by a pattern, and no cut-out piece crosses the place where white space follows
something else; so a text's ids are the ids of its segments (a run of white space and what follows it) one after the
other. Words repeat, so numpy finds the distinct segments of a slice and only these are encoded.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

from .shingles import _BYTE, _STEP, _power_tables, mix64, slices, word_spans

#: Texts are encoded in slices of about this many bytes.
ENCODE_BYTES = 3 << 19
#: White space beyond ASCII; a text that holds any is encoded in one go.
_WIDE_SPACE = re.compile("[" + "".join(map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))) + "]")
#: The pattern by which this family of tokenizers cuts a text before merging bytes.
_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"

_EXACT = _BYTE.copy()
_EXACT[65:91] = mix64(np.arange(65, 91, dtype=np.uint64)) | np.uint64(1)
_CHECK = mix64(_EXACT)


def _byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in byte-level vocabularies: printable Latin-1 stands for itself, others follow from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.cache
def encoder(path: str):
    """The encoding in a tokenizers JSON file, its merges read as ranks; strings of special tokens are ordinary text."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    special = {t["content"] for t in model.get("added_tokens", ())}
    back = _byte_alphabet()
    vocab = {bytes(back[c] for c in piece): i for piece, i in model["model"]["vocab"].items() if piece not in special}
    merged = [vocab[bytes(back[c] for c in "".join(m if isinstance(m, list) else m.split(" ")))] for m in model["model"]["merges"]]
    if model["model"]["type"] != "BPE" or model.get("normalizer") or merged != sorted(merged):
        raise ValueError(f"{path} is not a byte-level BPE whose ids follow its merges")
    return tiktoken.Encoding("file", pat_str=_PATTERN, mergeable_ranks=vocab, special_tokens={})


@functools.cache
def added_tokens(path: str) -> dict[str, int]:
    """The added tokens of a tokenizers JSON file and their ids, longest first; they are found in a text before it is cut."""
    with open(path, encoding="utf-8") as f:
        tokens = json.load(f).get("added_tokens", ())
    if any(t.get(flag) for t in tokens for flag in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"{path} has added tokens that take in more than their own text")
    return {t["content"]: t["id"] for t in sorted(tokens, key=lambda t: -len(t["content"]))}


def _encode_around(enc, text: str, added: dict[str, int]) -> list[int]:
    """Ids of a text whose added tokens stand for themselves; what lies between two of them is encoded on its own."""
    if not added:
        return enc.encode_ordinary(text)
    parts = re.split("(" + "|".join(map(re.escape, added)) + ")", text)
    return [i for n, part in enumerate(parts) for i in ([added[part]] if n % 2 else enc.encode_ordinary(part))]


def _segments(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the segments and the first segment of each text; texts end with a line feed, which is left out."""
    _, ends = word_spans(data)
    cuts = np.sort(np.concatenate([bounds[:-1], ends]))
    cuts = cuts[np.concatenate([[True], cuts[1:] != cuts[:-1]]) & (cuts < bounds[-1])]
    at = np.searchsorted(cuts, bounds)
    stop = np.append(cuts[1:], bounds[-1])
    stop[at[1:] - 1] = bounds[1:] - 1
    return cuts, stop, at


class SegmentIds:
    """The ids of segments seen so far, by their two 64-bit names; forgotten when there are more than ``most``."""

    def __init__(self, path: str, most: int = 300_000):
        self.enc, self.most = encoder(path), most
        ranks = self.enc._mergeable_ranks
        self.width = np.zeros(max(ranks.values()) + 1, np.int64)
        self.width[list(ranks.values())] = [len(b) for b in ranks]
        self.clear()

    def clear(self) -> None:
        self.names = pd.Index(np.zeros(0, np.uint64))
        self.check, self.begin, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def add(self, names: np.ndarray, check: np.ndarray, pieces: list[bytes]) -> None:
        """Encode new segments: those between white space in one go, for they are cut apart again where they were joined."""
        plain = np.fromiter((p[0] in b"\t\n\v\f\r " and p[-1] not in b"\t\n\v\f\r " if p else False for p in pieces), bool, len(pieces))
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        chosen = [pieces[i] for i in order]
        n = int(plain.sum())
        ids = np.array(self.enc.encode_ordinary(b"".join(chosen[:n]).decode()), np.uint32)
        length = np.cumsum(np.fromiter(map(len, chosen[:n]), np.int64, n))
        stop = np.searchsorted(np.cumsum(self.width[ids]), length) + 1
        size = np.diff(np.concatenate([[0], stop]))
        rest = [self.enc.encode_ordinary(p.decode()) for p in chosen[n:]]
        size = np.concatenate([size, np.fromiter(map(len, rest), np.int64, len(rest))])
        self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, ids, np.array([i for r in rest for i in r], np.uint32)])
        self.names, self.check = pd.Index(np.concatenate([self.names.to_numpy(), names[order]])), np.concatenate([self.check, check[order]])

    def find(self, names: np.ndarray, check: np.ndarray, raw: bytes, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Where each segment stands among those known, new ones included; -1 where two segments share a first name."""
        codes, distinct = pd.factorize(names)
        which = np.empty(len(distinct), np.int64)
        which[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        if len(self.names) + len(distinct) > self.most:
            self.clear()
        at = self.names.get_indexer(distinct)
        new = which[at < 0]
        if len(new):
            known = len(self.names)
            self.add(names[new], check[new], [raw[a:b] for a, b in zip(start[new].tolist(), stop[new].tolist(), strict=True)])
            at[at < 0] = self.names[known:].get_indexer(distinct[at < 0]) + known
        at = at[codes]
        return np.where(self.check[at] == check, at, -1)


@functools.cache
def _known(path: str) -> SegmentIds:
    return SegmentIds(path)


def encode_slices(texts: pa.Array, path: str, added: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last + 1, ids of these texts one after the other, where each text's ids start and the end); null counts as empty.

    With ``added`` the file's added tokens get their own ids wherever a text holds them, else they are ordinary text.
    """
    enc, known = encoder(path), _known(path)
    special = added_tokens(path) if added else {}
    held = re.compile("|".join(map(re.escape, special)).encode()) if special else None
    for first, last, data, bounds in slices(texts, ENCODE_BYTES):
        start, stop, at = _segments(data, bounds)
        up, down = _power_tables(len(data) + 1)
        names = []
        for values in (_EXACT, _CHECK):
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(values[data] * up[:-1], out=sums[1:])
            names.append(mix64((sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64) * _STEP))
        raw = data.tobytes()
        found = known.find(names[0], names[1], raw, start, stop)
        many = known.size[found]
        to = np.concatenate([[0], np.cumsum(many)])
        ids = known.flat[np.repeat(known.begin[found] - to[:-1], many) + np.arange(to[-1])]
        edges = to[at]
        whole = set((np.searchsorted(at, np.flatnonzero(found < 0), side="right") - 1).tolist())
        whole |= {i for i in range(last - first) if (t := texts[first + i].as_py()) and not t.isascii() and _WIDE_SPACE.search(t)}
        if held is not None:
            whole |= set((np.searchsorted(bounds, [m.start() for m in held.finditer(raw)], side="right") - 1).tolist())
        if whole:
            parts = [ids[edges[i] : edges[i + 1]] for i in range(last - first)]
            for i in whole:
                parts[i] = np.array(_encode_around(enc, texts[first + i].as_py() or "", special), np.uint32)
            ids, edges = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        yield first, last, ids, edges
