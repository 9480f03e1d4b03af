"""Substring de-duplication with a count-min prefilter (operator 8).

A window is `WIDTH` consecutive words of one document. Words covered by a window whose words also start earlier (in a
document of smaller id, or earlier in the same one) go.

1. Every task adds its windows, some at a time, to partial count-min sketches: the sorted cells that they hit once or
   more often, in each of `DEPTH` rows. Partial sketches meet by block of cells and are added up, saturating at 2. What
   is left is one bit a cell, "2 or more": at most `DEPTH` * `MOST_CELLS` bits, whatever the corpus, which is broadcast.
   The counts never fall short, so no repeated window is lost; in a corpus too large for `MOST_CELLS` the sketch only
   lets more single windows through.
2. A second pass over the texts keeps windows that every row estimates at 2 or more. Within a task's chunk the first of
   equal windows stands for all, and the others are known to go. The rest is grouped exactly by a 96-bit hash of the
   words, dealt by hash, and all but the first go.
3. The starts that go meet by document, become intervals of words, and are joined to the texts.

The two parts of a window's 96 bits come from two independent hashes of its words, under a key that is drawn for each run
(see `textops`): no words can be chosen so that different windows agree, and n windows agree by chance at n^2 / 2^97.

Order is by (doc_id, a hash of the text, start); documents without an id come last, by 126 bits of hashes of their
texts. Rows with one doc_id and one text are the same document: they lose the same words. Cases: a null, empty or short
text (fewer than `WIDTH` words) has no window, loses nothing and covers nothing; a very long text is cut into windows
whole, alone in its block; an empty table gives an empty result; ids that aren't whole numbers are refused, as are
columns with the names of the three that are added; all other columns are kept, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timetide.operators.lineage import cut
from timetide.llm.textops import Key, TextBlock, draw, slices, window_hashes

WIDTH = 20
DEPTH = 2
LEAST_CELLS, MOST_CELLS = 1 << 16, 1 << 28
BLOCK_BITS = 20
CHUNK_WINDOWS = 1_200_000
#: Windows of one exact group of hashes, and removed starts of one group of documents, on average.
PER_SHARD, PER_BUCKET = 2_000_000, 2_000_000
#: From here on, numbers stand for documents without an id.
NAMELESS = 1 << 62


def keys(doc_id: Column | None = None, text: Column | None = None) -> list[Column]:
    """__id and __th, which tell documents apart, in their order: the id, or 62 bits of a hash of the text where there is none, and 64 other bits of the text."""
    doc_id, text = F.col("doc_id") if doc_id is None else doc_id, (F.col("text") if text is None else text).cast("string")
    nameless = F.lit(NAMELESS) + F.pmod(F.xxhash64(F.lit(1), text), F.lit(NAMELESS))
    return [F.coalesce(doc_id.cast("long"), nameless).alias("__id"), F.xxhash64(text).alias("__th")]


def require_ids(docs: DataFrame) -> None:
    """Ids must be whole numbers (ValueError), as the smallest of a group counts."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint", "void"):
        raise ValueError(f"doc_id must be a whole number, not {kind}")


def squeeze(x: np.ndarray) -> bytes:
    """An integer array by byte planes, compressed: small or sorted values take little."""
    raw = np.ascontiguousarray(x)
    planes = raw.view(np.uint8).reshape(-1, raw.itemsize).T.tobytes()
    return pa.compress(planes, codec="zstd", asbytes=True) if planes else b""


def unsqueeze(data: bytes, dtype: type, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, dtype)
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(pa.decompress(data, decompressed_size=n * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(dtype).ravel()


def cells_of(h: np.ndarray, row: int, cells: int) -> np.ndarray:
    """The cell of each hash in one row of the sketch."""
    return ((h >> np.uint64(4 + 31 * row)) & np.uint64(cells - 1)).astype(np.uint32)


class Chunk:
    """Windows of some documents: hashes, and the place of each."""

    def __init__(self, key: Key) -> None:
        self.key = key
        self.ids, self.ths, self.docs, self.starts, self.h, self.g = [], [], [], [], [], []
        self.n_windows = self.n_docs = 0

    def add(self, part: pa.RecordBatch, width: int, places: bool) -> None:
        block = TextBlock(part.column("text").to_pylist())
        firsts, docs = block.windows(width)
        if not len(firsts):
            return
        self.h.append(window_hashes(block.word_hashes(0, self.key), width, 0, self.key)[firsts])
        if places:
            self.g.append((window_hashes(block.word_hashes(1, self.key), width, 1, self.key)[firsts] >> np.uint64(32)).astype(np.uint32))
            self.docs.append((docs + self.n_docs).astype(np.int32))
            self.starts.append((firsts - block.first[docs]).astype(np.int32))
            self.ids.append(part.column("__id").to_numpy(zero_copy_only=False))
            self.ths.append(part.column("__th").to_numpy(zero_copy_only=False))
            self.n_docs += part.num_rows
        self.n_windows += len(firsts)


def chunks(batches: Iterator[pa.RecordBatch], width: int, places: bool, key: Key) -> Iterator[Chunk]:
    chunk = Chunk(key)
    for batch in batches:
        for part in slices(batch):
            chunk.add(part, width, places)
            if chunk.n_windows >= CHUNK_WINDOWS:
                yield chunk
                chunk = Chunk(key)
    if chunk.n_windows:
        yield chunk


def cells_for(n: int) -> int:
    """Cells of a row for about n hashes: two each or more, between the two bounds."""
    return min(MOST_CELLS, max(LEAST_CELLS, 1 << (2 * n).bit_length()))


def window_runs(width: int, key: Key) -> Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]]:
    """The hashes of all windows, some at a time."""
    return lambda batches: (np.concatenate(c.h) for c in chunks(batches, width, False, key))


def sketch(texts: DataFrame, runs: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], cells: int) -> np.ndarray:
    """(DEPTH, cells / 8): for every row one bit a cell, set where the count of the hashes of the texts is 2 or more.

    runs: what gives the hashes of Arrow batches of texts, an array at a time.
    """
    blocks = max(1, cells >> BLOCK_BITS)
    per_block = cells // blocks

    def partial(batches):
        for h in runs(batches):
            out = {"block": [], "n": [], "cells": [], "twice": [], "m": []}
            for row in range(DEPTH):
                x = np.sort(cells_of(h, row, cells))
                head = np.flatnonzero(np.diff(x, prepend=x[0] + 1))
                more = np.diff(np.append(head, len(x))) > 1
                x = x[head]
                cut = np.searchsorted(x, np.arange(blocks + 1, dtype=np.uint64) * per_block)
                for b in range(blocks):
                    lo, hi = cut[b], cut[b + 1]
                    if lo == hi:
                        continue
                    own = x[lo:hi] - np.uint32(b * per_block)
                    twice = np.flatnonzero(more[lo:hi]).astype(np.uint32)
                    out["block"].append(row * blocks + b)
                    out["n"].append(hi - lo)
                    out["cells"].append(squeeze(np.diff(own, prepend=np.uint32(0))))
                    out["m"].append(len(twice))
                    out["twice"].append(squeeze(np.diff(twice, prepend=np.uint32(0))))
            yield pa.RecordBatch.from_arrays([pa.array(out["block"], pa.int32()), pa.array(out["n"], pa.int32()), pa.array(out["cells"], pa.binary()), pa.array(out["m"], pa.int32()), pa.array(out["twice"], pa.binary())], ["block", "n", "cells", "m", "twice"])

    def merge(batches):
        """Partial sketches of a few blocks, as they come: a task holds one byte a cell of its blocks."""
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, n, data, m, more in zip(*(batch.column(c).to_pylist() for c in ("block", "n", "cells", "m", "twice")), strict=True):
                if block not in counts:
                    counts[block] = np.zeros(per_block, np.uint8)
                own = np.cumsum(unsqueeze(data, np.uint32, n), dtype=np.uint32)
                own_counts = np.minimum(counts[block][own] + 1, 2)
                own_counts[np.cumsum(unsqueeze(more, np.uint32, m), dtype=np.uint32)] = 2
                counts[block][own] = own_counts
        for block, c in counts.items():
            bits = np.packbits(c >= 2, bitorder="little").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([bits], pa.binary())], ["block", "bits"])

    parts = texts.select("text").mapInArrow(partial, "block int, n int, cells binary, m int, twice binary")
    tasks = min(DEPTH * blocks, max(8, DEPTH * blocks // 8))
    merged = parts.repartition(tasks, "block").coalesce(tasks).mapInArrow(merge, "block int, bits binary")
    out = np.zeros((DEPTH * blocks, per_block // 8), np.uint8)
    for r in merged.toLocalIterator(prefetchPartitions=True):  # at most DEPTH * MOST_CELLS bits in all
        out[r["block"]] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(DEPTH, cells // 8)


def estimated_repeated(h: np.ndarray, bits: np.ndarray, cells: int) -> np.ndarray:
    """Whether every row of the sketch estimates a window at 2 or more."""
    out = np.ones(len(h), bool)
    for row in range(DEPTH):
        at = np.flatnonzero(out)
        c = cells_of(h[at], row, cells)
        out[at] = (bits[row][c >> np.uint32(3)] >> (c & np.uint32(7)).astype(np.uint8)) & 1
    return out


def _later(h: np.ndarray, g: np.ndarray, ids: np.ndarray, ths: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the first of each distinct window, and of all that start later than their first."""
    order = np.lexsort((starts, ths, ids, g, h))
    h, g = h[order], g[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
    head = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    same = (ids[order] == ids[head]) & (ths[order] == ths[head]) & (starts[order] == starts[head])
    return order[new], order[~same]


def _removed(bucket_of: np.ndarray, ids: np.ndarray, ths: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, bytes, bytes, bytes]]:
    """(bucket, n, ids, hashes of texts, starts) of removed windows."""
    order = np.lexsort((starts, ths, ids, bucket_of))
    for part in np.split(order, np.flatnonzero(np.diff(bucket_of[order])) + 1):
        if len(part):
            yield int(bucket_of[part[0]]), len(part), squeeze(np.diff(ids[part], prepend=0)), squeeze(ths[part]), squeeze(np.diff(starts[part], prepend=np.int32(0)))


def removed_intervals(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """__id, __th, __starts, __ends: the word intervals that each document loses (only documents that lose any)."""
    texts = docs.select(*keys(), F.col("text").cast("string").cast("binary").alias("text"))
    # About six bytes a word: only the sizes of the sketch and of the groups hang on it.
    about = (docs.select(F.sum(F.octet_length(F.col("text").cast("string"))).alias("n")).first()["n"] or 0) // 6
    cells, key = cells_for(about), draw()
    bits = docs.sparkSession.sparkContext.broadcast(sketch(texts, window_runs(width, key), cells))  # DEPTH * MOST_CELLS bits at most
    n_shards, n_buckets = max(16, about // PER_SHARD), max(16, about // PER_BUCKET)
    schema = "key int, n int, h binary, g binary, ids binary, ths binary, starts binary"
    names = ["key", "n", "h", "g", "ids", "ths", "starts"]

    def bucket(ids: np.ndarray) -> np.ndarray:
        return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(n_buckets)).astype(np.int32)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int32(), pa.int32()] + [pa.binary()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def candidates(batches):
        for chunk in chunks(batches, width, True, key):
            h = np.concatenate(chunk.h)
            at = np.flatnonzero(estimated_repeated(h, bits.value, cells))
            if not len(at):
                continue
            h, g = h[at], np.concatenate(chunk.g)[at]
            doc, starts = np.concatenate(chunk.docs)[at], np.concatenate(chunk.starts)[at]
            ids, ths = np.concatenate(chunk.ids)[doc], np.concatenate(chunk.ths)[doc]
            first, later = _later(h, g, ids, ths, starts)
            shard = (h[first] >> np.uint64(36)) % np.uint64(n_shards)
            order = first[np.lexsort((starts[first], ths[first], ids[first], shard))]
            shard = ((h[order] >> np.uint64(36)) % np.uint64(n_shards)).astype(np.int32)
            rows = []
            for part in np.split(np.arange(len(order)), np.flatnonzero(np.diff(shard)) + 1):
                o = order[part]
                rows.append((int(shard[part[0]]), len(o), h[o].tobytes(), g[o].tobytes(), squeeze(np.diff(ids[o], prepend=0)), squeeze(ths[o]), squeeze(starts[o])))
            # What goes already here travels under keys below 0.
            rows += [(-1 - b, n, None, None, i, t, s) for b, n, i, t, s in _removed(bucket(ids[later]), ids[later], ths[later], starts[later])]
            yield batch_of(rows)

    def exact(shard, table):
        if shard[0].as_py() < 0:
            return table.set_column(0, "key", pa.array([-1 - shard[0].as_py()] * table.num_rows, pa.int32()))
        rows = table.to_pylist()
        h = np.concatenate([np.frombuffer(r["h"], np.uint64) for r in rows])
        g = np.concatenate([np.frombuffer(r["g"], np.uint32) for r in rows])
        ids = np.concatenate([np.cumsum(unsqueeze(r["ids"], np.int64, r["n"])) for r in rows])
        ths = np.concatenate([unsqueeze(r["ths"], np.int64, r["n"]) for r in rows])
        starts = np.concatenate([unsqueeze(r["starts"], np.int32, r["n"]) for r in rows])
        _, later = _later(h, g, ids, ths, starts)
        out = [(b, n, None, None, i, t, s) for b, n, i, t, s in _removed(bucket(ids[later]), ids[later], ths[later], starts[later])]
        return pa.Table.from_batches([batch_of(out)]) if out else table.slice(0, 0)

    def intervals(_, table):
        rows = table.to_pylist()
        ids = np.concatenate([np.cumsum(unsqueeze(r["ids"], np.int64, r["n"])) for r in rows])
        ths = np.concatenate([unsqueeze(r["ths"], np.int64, r["n"]) for r in rows])
        starts = np.concatenate([np.cumsum(unsqueeze(r["starts"], np.int32, r["n"]), dtype=np.int32) for r in rows])
        order = np.lexsort((starts, ths, ids))
        ids, ths, starts = ids[order], ths[order], starts[order].astype(np.int64)
        doc = np.ones(len(ids), bool)
        doc[1:] = (ids[1:] != ids[:-1]) | (ths[1:] != ths[:-1])
        run = doc.copy()
        run[1:] |= starts[1:] > starts[:-1] + width
        lo = np.flatnonzero(run)
        hi = np.append(lo[1:], len(starts)) - 1
        offsets = np.append(np.searchsorted(lo, np.flatnonzero(doc)), len(lo)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.astype(np.int32))) for x in (starts[lo], starts[hi] + width)]
        return pa.table([pa.array(ids[doc]), pa.array(ths[doc]), *lists], ["__id", "__th", "__starts", "__ends"])

    found = texts.mapInArrow(candidates, schema).groupBy("key").applyInArrow(exact, schema)
    lost = cut(found.select("key", "n", "ids", "ths", "starts").groupBy("key").applyInArrow(intervals, "__id long, __th long, __starts array<int>, __ends array<int>"))
    bits.destroy()
    return lost


def cut_words(text: bytes | None, starts: list[int] | None, ends: list[int] | None) -> tuple[int, int, bytes]:
    """Words, words removed, and the kept words joined by one space."""
    words = (text or b"").split()
    if not starts:
        return len(words), 0, b" ".join(words)
    kept, at = [], 0
    for a, b in zip(starts, ends, strict=True):
        kept += words[at:a]
        at = b
    kept += words[at:]
    return len(words), len(words) - len(kept), b" ".join(kept)


def dedup_substrings(docs: DataFrame, width: int = WIDTH, digest: bool = False) -> DataFrame:
    """All columns of docs, and __n_words, __n_removed, __kept (the words left, joined by one space; with digest, their sha256)."""
    require_ids(docs)
    added = ["__n_words", "__n_removed", "__kept"]
    if set(added) & set(docs.columns):
        raise ValueError(f"docs has columns of the names {', '.join(added)}")
    lost = removed_intervals(docs, width)
    at = [f"c{i}" for i in range(len(docs.columns))]  # by place, so that no name of docs can clash
    text = F.col(at[docs.columns.index("text")])
    keep = [c for c, f in zip(at, docs.schema, strict=True) if not (digest and f.name == "text")]
    rows = docs.toDF(*at).select("*", *keys(F.col(at[docs.columns.index("doc_id")]), text), text.cast("string").cast("binary").alias("__text"))
    joined = rows.select(*keep, "__id", "__th", "__text").join(lost, ["__id", "__th"], "left").select(*keep, "__starts", "__ends", "__text")
    own = [f for f in docs.schema if not (digest and f.name == "text")]
    schema = T.StructType([T.StructField(c, f.dataType) for c, f in zip(keep, own, strict=True)] + [T.StructField(added[0], T.LongType()), T.StructField(added[1], T.LongType()), T.StructField(added[2], T.StringType())])

    def run(batches):
        for batch in batches:
            for part in slices(batch, "__text"):
                done = [cut_words(t, a, b) for t, a, b in zip(part.column("__text").to_pylist(), part.column("__starts").to_pylist(), part.column("__ends").to_pylist(), strict=True)]
                kept = [hashlib.sha256(k).hexdigest() if digest else k.decode("utf-8", "replace") for _, _, k in done]
                columns = [*part.columns[: len(own)], pa.array([n for n, _, _ in done], pa.int64()), pa.array([r for _, r, _ in done], pa.int64()), pa.array(kept, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, keep + added)

    return joined.mapInArrow(run, schema).toDF(*[f.name for f in own], *added)


#: The rows of op8_substring_dedup in DuckDB; ids are unique there.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
u AS (SELECT doc_id, unnest(range(greatest(len(w) - 19, 0))) AS i, unnest(list_transform(range(greatest(len(w) - 19, 0)), lambda i: array_to_string(w[i + 1 : i + 20], ' '))) AS k FROM d),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM u) WHERE n > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS pos FROM r),
x AS (SELECT doc_id, unnest(range(len(w))) AS pos, unnest(w) AS word FROM d),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept, count(*) AS n FROM x ANTI JOIN c USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
