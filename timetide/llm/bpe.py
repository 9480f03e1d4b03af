"""Byte-level BPE encoding and decoding (operator 9).

A text is cut at spaces before a non-space, which no piece of the pre-tokenizer crosses; a chunk's ids are
kept in a bounded cache. The pieces of unknown chunks are merged together: each short word is a row of a
contiguous array of parts, beside an array of the ranks of adjacent parts. The minimum of each rank row is
found by a scan, its boundary deleted, and the two neighbouring ranks refreshed, until no pair has a rank.
Words over `SHORT` bytes take a heap over linked parts, which merges in the same order.

Cases: a null text counts as empty (no tokens); very long texts are encoded whole, alone in their block, and very long
words by the heap, in memory that grows with the word; an empty table gives no rows; repeated rows give repeated rows;
other columns are ignored.
"""

from __future__ import annotations

import heapq
import json

import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from timetide.llm.textops import doc_id_type, map_texts, texts_of

SHORT = 48
CACHE_CHUNKS = 400_000
NONE = np.int32(1 << 30)

# The white space and the pieces of the byte-level pre-tokenizer.
_S = r"\t-\r \x85\xa0  -     　"
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+"


def printable_bytes() -> dict[str, int]:
    """The characters that stand for bytes in the vocabulary file: printable Latin-1 stands for itself, the rest follows from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class BpeCodec:
    """Encodes and decodes with a byte-level BPE vocabulary in the tokenizers JSON format."""

    def __init__(self, vocabulary: bytes):
        told = json.loads(vocabulary)
        model, byte_of = told["model"], printable_bytes()
        cut = told.get("pre_tokenizer") or {}
        if cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or cut.get("use_regex") is False:
            raise ValueError("only byte-level vocabularies without a prefix blank, cut by the usual pieces, can be used")
        if len(model["vocab"]) >= 1 << 16:
            raise ValueError("pairs of ids are kept in 32 bits: a vocabulary may have up to 65,535 entries")
        raw = lambda token: bytes(byte_of[c] for c in token)
        ids = model["vocab"]
        self.special = {t["content"]: t["id"] for t in told.get("added_tokens", [])}
        self.tokens = [b""] * (1 + max([*ids.values(), *self.special.values()]))
        for token, i in ids.items():
            self.tokens[i] = raw(token)
        for token, i in self.special.items():
            self.tokens[i] = token.encode()
        self.byte_id = np.zeros(256, np.int32)
        for c, b in byte_of.items():
            self.byte_id[b] = ids[c]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        key = np.array([ids[a] << 16 | ids[b] for a, b in pairs], np.uint32)
        made = np.array([ids[a + b] for a, b in pairs], np.int32)
        self.made = made
        self.rank_of = {int(k): r for r, k in enumerate(key)}
        order = np.argsort(key)
        self.keys, self.ranks = key[order], order.astype(np.int32)
        self.pieces = regex.compile(PIECES)
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.glued = regex.compile(rf" (?:[{_S}]|\Z)")
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; NONE where they don't merge or a part is missing (below 0)."""
        ok = (left >= 0) & (right >= 0)
        key = np.where(ok, left, 0).astype(np.uint32) << np.uint32(16) | np.where(ok, right, 0).astype(np.uint32)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(ok & (self.keys[at] == key), self.ranks[at], NONE)

    def merge_short(self, words: list[bytes]) -> list[bytes]:
        """The ids of words of up to SHORT bytes, as little-endian uint32."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        width = int(sizes.max())
        parts = np.full((len(words), width + 2), -1, np.int32)
        parts[:, :width][np.arange(width) < sizes[:, None]] = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        ranks = self._rank(parts[:, :-1], parts[:, 1:])
        out, who, columns = [b""] * len(words), np.arange(len(words)), np.arange(width + 2)
        while len(who):
            at = ranks.argmin(axis=1)
            rows = np.arange(len(who))
            best = ranks[rows, at]
            done = best == NONE
            if done.any():
                ended = parts[done]
                lengths = (ended >= 0).sum(axis=1)
                for w, row, n in zip(who[done].tolist(), ended.astype("<u4"), lengths.tolist(), strict=True):
                    out[w] = row[:n].tobytes()
                go = ~done
                who, parts, ranks, at, best = who[go], parts[go], ranks[go], at[go], best[go]
                rows = np.arange(len(who))
                if not len(who):
                    break
            # The boundary between parts `at` and `at + 1` goes.
            parts[rows, at] = self.made[best]
            last = parts.shape[1] - 1
            parts = np.take_along_axis(parts, np.minimum(columns + (columns > at[:, None]), last), axis=1)
            parts[:, -1] = -1
            ranks = np.take_along_axis(ranks, np.minimum(columns[:-1] + (columns[:-1] > at[:, None]), last - 1), axis=1)
            ranks[:, -1] = NONE
            ranks[rows, at] = self._rank(parts[rows, at], parts[rows, at + 1])
            left = at > 0
            r, a = rows[left], at[left]
            ranks[r, a - 1] = self._rank(parts[r, a - 1], parts[r, a])
        return out

    def merge_long(self, word: bytes) -> bytes:
        ids = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = lambda i, j: self.rank_of.get(ids[i] << 16 | ids[j])
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank(i, i + 1)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = int(self.made[r]), -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (x := rank(i, k)) is not None:
                    heapq.heappush(heap, (x, i, ids[i], ids[k]))
            if (p := before[i]) >= 0 and (x := rank(p, i)) is not None:
                heapq.heappush(heap, (x, p, ids[p], ids[i]))
        return np.array([i for i in ids if i >= 0], "<u4").tobytes()

    def _learn(self, chunks: list[str]) -> list[bytes]:
        """The ids of chunks: their pieces, merged all together."""
        found = [self.pieces.findall(c) for c in chunks]
        known, coded = self.later, {}
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for p in {p for ps in found for p in ps}:
            if p[0] == " " and (ids := known.get(p[1:])):
                coded[p] = ids
                continue
            raw = p.encode()
            if len(raw) <= SHORT:
                by_width.setdefault((len(raw) + 3) // 4, []).append((p, raw))
            else:
                coded[p] = self.merge_long(raw)
        for group in by_width.values():
            for at in range(0, len(group), 8192):
                part = group[at : at + 8192]
                coded.update(zip([p for p, _ in part], self.merge_short([raw for _, raw in part]), strict=True))
        return [b"".join([coded[p] for p in ps]) for ps in found]

    def _chunks(self, text: str) -> list[str]:
        """The first chunk as it is, each later one without the space before it."""
        parts = text.split(" ")
        if not self.glued.search(text):
            return parts
        out = [parts[0]]
        for p in parts[1:]:
            if not p or self.glued.match(" " + p):
                out[-1] += " " + p
            else:
                out.append(p)
        return out

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian uint32."""
        if len(self.first) + len(self.later) > CACHE_CHUNKS:
            self.first, self.later = {}, {}
        runs: list[list] = []
        for text in texts:
            cut = self.split.split(text) if self.split and any(s in text for s in self.special) else [text]
            runs.append([self.special[c] if i % 2 else self._chunks(c) for i, c in enumerate(cut)])
        first = {x[0] for run in runs for x in run if isinstance(x, list)} - self.first.keys()
        later = {c for run in runs for x in run if isinstance(x, list) for c in x[1:]} - self.later.keys()
        if first or later:
            first, later = list(first), list(later)
            ids = self._learn(first + [" " + c for c in later])
            self.first.update(zip(first, ids[: len(first)], strict=True))
            self.later.update(zip(later, ids[len(first) :], strict=True))
        known, out = self.later, []
        for run in runs:
            bits = []
            for x in run:
                if isinstance(x, int):
                    bits.append(x.to_bytes(4, "little"))
                else:
                    bits.append(self.first[x[0]])
                    bits += [known[c] for c in x[1:]]
            out.append(b"".join(bits))
        return out

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_codecs: dict[int, BpeCodec] = {}


def codec_of(vocabulary) -> BpeCodec:
    """One codec for each broadcast vocabulary and worker."""
    key = getattr(vocabulary, "id", None) or id(vocabulary)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = BpeCodec(vocabulary.value)
    return _codecs[key]


def bpe_encode(docs: DataFrame, vocabulary_path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, ids (little-endian uint32 blob, if with_ids), n_tokens, ids_sha256, decoded (if with_ids), decoded_sha256 of every row.

    The vocabulary file is read by the driver and broadcast: its size is that of the file, whatever the corpus.
    """
    with open(vocabulary_path, "rb") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        codec = codec_of(vocabulary)
        ids = codec.encode_batch([(t or b"").decode("utf-8", "replace") for t in part.column("text").to_pylist()])
        decoded = [codec.decode(x) for x in ids]
        columns = [
            part.column("doc_id"),
            pa.array([len(x) // 4 for x in ids], pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
            pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string()),
        ]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if with_ids:
            columns += [pa.array(ids, pa.binary()), pa.array(decoded, pa.string())]
            names += ["ids", "decoded"]
        return pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc_id {doc_id_type(docs)}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_texts(texts_of(docs, "doc_id"), run, schema + ", ids binary, decoded string" * with_ids)
