"""Byte-level BPE encoding and decoding by monoid tree reduction.

An element of the monoid is a stretch of text with its ids. A long text is halved until the pieces are
at most ``leaf`` code points long, each is encoded by itself, and neighbours are joined on the way up. Joining re-encodes
a window around the cut, which grows on either side until it ends where ids provably don't depend on what is beyond.

Such a place is one where a character that isn't white space is followed by white space: the split pattern has no
match that goes on from the former to the latter, and what it matches from any place on depends on the text from
there only. So ids before and after the place are those of the two sides alone, and joining drops the ids of the
window's halves and puts those of the whole window in their place. A pattern has to be such a one: on a few texts the constructor sees whether a match goes on
across such a place, or changes with what is before it, and raises an error.

Decoding halves the ids and concatenates bytes up the tree.

Nulls are as empty texts (no ids); any other column is ignored; repeated rows give repeated results.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

#: A place between the two characters of a match. \S leaves out what either library takes for white space.
_SAFE = re.compile(r"\S(?=[ \n\t\r])")
EMPTY = np.empty(0, np.uint32)
#: Texts on which a pattern is tried: letters, digits, marks and breaks in turn, with all kinds of white space between.
_PROBES = [f"{a}{gap}{b}" for a in ("it's", "x1", "12", "é!", "...", "中", "don't 3") for gap in (" ", "  ", "\n", " \n ", "\t", "\r\n") for b in ("we'll", "2b", "34", "?é", "--", "文")]


class TreeBPE:
    """``rank_file``: base64 token and rank by line. ``pattern``: what splits text before merging."""

    def __init__(self, rank_file: str, pattern: str, leaf: int = 1 << 12, window: int = 64):
        import regex
        import tiktoken

        split = regex.compile(pattern)
        for probe in _PROBES:
            for m in _SAFE.finditer(probe):
                if split.findall(probe) != split.findall(probe[: m.end()]) + split.findall(probe[m.end() :]):
                    raise ValueError("the pattern doesn't end a match where white space follows")
        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self._bytes[rank] = token
        self.leaf, self.window = leaf, window

    def _plain(self, text: str) -> np.ndarray:
        return self._encoding.encode_to_numpy(text) if text else EMPTY

    def encode(self, text: str) -> np.ndarray:
        return self._encode(text, 0, len(text))

    def _encode(self, text: str, a: int, b: int) -> np.ndarray:
        if b - a <= self.leaf:
            return self._plain(text[a:b])
        cut = (a + b) // 2
        return self._join(text, a, cut, b, self._encode(text, a, cut), self._encode(text, cut, b))

    def _join(self, text: str, a: int, cut: int, b: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        lo, hi = self._stable_before(text, a, cut), self._stable_after(text, cut, b)
        old_left, old_right = len(self._plain(text[lo:cut])), len(self._plain(text[cut:hi]))
        return np.concatenate([left[: len(left) - old_left], self._plain(text[lo:hi]), right[old_right:]])

    def _stable_before(self, text: str, a: int, cut: int) -> int:
        """The last provably stable place in (a, cut], sought in growing windows; a if there is none."""
        w = self.window
        while cut - w > a:
            if found := [m.end() for m in _SAFE.finditer(text, cut - w, cut)]:
                return found[-1]
            w *= 2
        return max((m.end() for m in _SAFE.finditer(text, a, cut)), default=a)

    def _stable_after(self, text: str, cut: int, b: int) -> int:
        """The first provably stable place in (cut, b), sought in growing windows; b if there is none."""
        w = self.window
        while True:
            if m := _SAFE.search(text, cut, min(b, cut + w)):
                return m.end()
            if cut + w >= b:
                return b
            w *= 2

    def decode(self, ids: np.ndarray | list[int]) -> bytes:
        if len(ids) <= self.leaf:
            return b"".join(map(self._bytes.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def bpe_encode(docs: DataFrame, rank_file: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and ``ids`` array<int> of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = TreeBPE(rank_file, pattern)
        for batch in batches:
            ids = [bpe.encode(t or "") for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int64)
            values = pa.array(np.concatenate(ids).astype(np.int32) if ids else EMPTY.astype(np.int32))
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(id_col, text_col), run, f"{id_col} {kind}, ids array<int>")


def bpe_decode(encoded: DataFrame, rank_file: str, pattern: str, *, id_col: str = "doc_id") -> DataFrame:
    """id_col and ``bytes`` binary of each row of what bpe_encode returns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = TreeBPE(rank_file, pattern)
        for batch in batches:
            out = [bpe.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=[id_col, "bytes"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return map_arrow(encoded.select(id_col, "ids"), run, f"{id_col} {kind}, bytes binary")


def bpe_digests(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 in one pass; decoded from the ids that were hashed."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = TreeBPE(rank_file, pattern)
        for batch in batches:
            n, ids_sha, out_sha = [], [], []
            for t in batch.column(1):
                ids = bpe.encode(t.as_py() or "")
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(ids.astype("<u4", copy=False)).hexdigest())
                out_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(out_sha)], schema=schema)

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
