"""Vectorised text helpers that run inside Arrow batches.

A task never holds more than one block of texts (a few MB, or one document if it is longer) beside
its Arrow batch. Words are `[^\\x20\\x09-\\x0D]+` throughout, found on the UTF-8 bytes.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 1_000_000
#: Digests of longer words aren't kept.
LONG_BYTES = 64
WORD = r"[^\x20\x09-\x0D]+"

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


@dataclass(frozen=True)
class Key:
    """What hashes of words depend on. Where equal hashes count as equal words, a run draws its own (`draw`), so that no text can be
    made to collide; FIXED is for features and for candidates whose words are compared afterwards."""

    secret: bytes

    def numbers(self, which: int, n: int) -> np.ndarray:
        """n odd 64-bit numbers of the secret, for each of two independent hashes."""
        raw = b"".join(hashlib.blake2b(bytes([which, i]), key=self.secret, digest_size=64).digest() for i in range(-(-n // 8)))
        return np.frombuffer(raw, "<u8")[:n] | np.uint64(1)


FIXED = Key(b"words of texts")


def draw() -> Key:
    return Key(os.urandom(32))


_LOW_BYTES = np.array([(1 << 8 * i) - 1 for i in range(8)], np.uint64)
#: The digests of words that a worker keeps, for the key that it used last.
_digests: dict[bytes, bytes] = {}
_digests_of = [b""]
MOST_DIGESTS = 40_000


def _long_hashes(words: list[bytes], key: Key, which: int) -> np.ndarray:
    if _digests_of[0] != key.secret or len(_digests) > MOST_DIGESTS:
        _digests.clear()
        _digests_of[0] = key.secret
    out = []
    for w in words:
        digest = _digests.get(w)
        if digest is None:
            digest = hashlib.blake2b(w, digest_size=16, key=key.secret).digest()
            if len(w) <= LONG_BYTES:
                _digests[w] = digest
        out.append(digest)
    return np.frombuffer(b"".join(out), "<u8")[which::2]


def byte_hashes(blob: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0, key: Key = FIXED) -> np.ndarray:
    """A 64-bit hash of blob[start:end] for every span; which: one of two independent ones.

    Spans of up to 7 bytes are told apart for certain: their bytes and their length are mixed by a bijection. Longer ones
    go through BLAKE2b with the key.
    """
    eights = np.ndarray((len(blob) + 1,), "<u8", np.concatenate([blob, np.zeros(8, np.uint8)]), strides=(1,))
    size = ends - starts
    short = np.minimum(size, 7)
    h = mix((eights[starts] & _LOW_BYTES[short] | short.astype(np.uint64) << np.uint64(56)) ^ key.numbers(which, 64)[-1])
    long = np.flatnonzero(size > 7)
    if len(long):
        raw = blob.tobytes()
        h[long] = _long_hashes([raw[a:b] for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)], key, which)
    return h


def window_hashes(words: np.ndarray, width: int, which: int = 0, key: Key = FIXED) -> np.ndarray:
    """A hash of words[i:i+width] for every i that has so many words after it: a sum of the words times numbers of the key, mixed.

    Two windows that differ in a word agree for few of all keys (one in 2^64, or 2^64 / 2^t where the hashes of the words differ
    in the 64 - t highest bits only).
    """
    n = len(words) - width + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    factors = key.numbers(which, width)
    total = words[:n] * factors[0]
    for i in range(1, width):
        total += words[i : n + i] * factors[i]
    return mix(total)


class TextBlock:
    """Some texts side by side, with the places of their words."""

    def __init__(self, texts: list[bytes | None], lower: bool = False):
        texts = [t or b"" for t in texts]
        self.n_docs = len(texts)
        self.blob = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        if lower:
            self.blob = LOWER[self.blob]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.sizes = sizes
        self.doc_end = np.cumsum(sizes + 1) - 1
        self.doc_start = self.doc_end - sizes
        inside = np.zeros(len(self.blob) + 1, bool)
        np.logical_not(IS_SPACE[self.blob], out=inside[1:])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = edges[0::2], edges[1::2]
        self.first = np.searchsorted(self.starts, self.doc_start)
        self.n_words = np.diff(np.append(self.first, len(self.starts)))

    def word_hashes(self, which: int = 0, key: Key = FIXED) -> np.ndarray:
        return byte_hashes(self.blob, self.starts, self.ends, which, key)

    def text(self, doc: int) -> bytes:
        return self.blob[self.doc_start[doc] : self.doc_end[doc]].tobytes()

    def words(self, doc: int) -> list[bytes]:
        """The words of one document: bytes.split() cuts at the same blanks."""
        return self.text(doc).split()

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), self.n_words)

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all windows of so many words within one document, and their documents."""
        many = np.maximum(self.n_words - width + 1, 0)
        docs = np.repeat(np.arange(self.n_docs), many)
        before = np.cumsum(many) - many
        return np.arange(many.sum()) - np.repeat(before - self.first, many), docs


def sums_by_doc(values: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of values[first:first+n] for every document (0 where n is 0)."""
    out = np.zeros((len(n), *values.shape[1:]), np.float64 if values.dtype.kind == "f" else np.int64)
    some = np.flatnonzero(n > 0)
    if len(some):
        out[some] = np.add.reduceat(values, first[some], axis=0, dtype=out.dtype)
    return out


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch where its texts reach the limit."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(sizes, dtype=np.int64), 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def map_texts(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, limit: int = BLOCK_BYTES) -> DataFrame:
    """Apply fn to blocks of the rows of df, which has the bytes of its texts in column `text`."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", limit):
                yield fn(part)

    return df.mapInArrow(run, schema)


def texts_of(docs: DataFrame, *keep: str) -> DataFrame:
    """The named columns, and the text as bytes (no decoding in the worker)."""
    return docs.select(*keep, F.col("text").cast("string").cast("binary").alias("text"))


def doc_id_type(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def crc_of_id() -> F.Column:
    """crc32 of doc_id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
