"""Encoding and decoding with a SentencePiece BPE vocabulary (operator 12).

A text's blanks become "▁", with one more before it, and it is cut before each of them: no piece crosses there but those
that are blanks only. Each different chunk is encoded once (a bounded cache keeps its ids), by backtracking: an
Aho-Corasick automaton gives the longest piece at every place; a piece is taken if it may stand after the one before it,
else the next shorter one is tried, and where none is left the place is marked in a bit field of failed places and the
piece before is shortened. Two pieces may stand side by side if merging would never join anything across their border:
both are taken apart again in the order of the merges, and at each step the two parts at the border must not make a piece
that would have been merged earlier (the left one first where ranks are equal). A sequence all of whose neighbours are
compatible is the one that merging gives, so the result is exact.

The method needs pieces that merging can make, each from pieces of higher score: the tables are checked for that.
Only pieces of blanks may tie below all others, as they are merged last, from the left: they are joined by that rule.
Characters that are no piece become one id for each of their bytes.

Cases: a null text counts as empty and has no ids; a blank one has ids of blanks; texts and words may be of any length
(chunks beyond KEEP_CHARS are not kept, the bit field and the matches of a chunk grow with it); repeated rows give
repeated rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from timetide.llm.textops import doc_id_type, map_texts, texts_of

BLANK = "▁"
#: Chunks and pairs kept by a worker, and the longest chunk that is kept.
CACHE_CHUNKS, CACHE_PAIRS, KEEP_CHARS = 500_000, 1_000_000, 48

# Kinds of pieces, and the numbers of the fields that are read, in the model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
PIECES, TRAINER, NORMALIZER = 1, 2, 3
MODEL_TYPE, BYTE_FALLBACK, AS_SUFFIX = 3, 35, 24
CHARSMAP, DUMMY_PREFIX, REMOVE_EXTRA, ESCAPE = 2, 3, 4, 5

codecs.register_error("each byte", lambda e: ("�" * (e.end - e.start), e.end))


def fields(blob: bytes) -> list[tuple[int, int | bytes]]:
    """The fields of a protocol buffer message: number and value (an integer or raw bytes)."""
    out, at = [], 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = blob[at]
            value, shift, at = value | (byte & 127) << shift, shift + 7, at + 1
            if byte < 128:
                return value

    while at < len(blob):
        tag = number()
        if tag & 7 == 0:
            out.append((tag >> 3, number()))
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or number()
            out.append((tag >> 3, blob[at : at + size]))
            at += size
    return out


class PieceCodec:
    """Encodes and decodes as a SentencePiece BPE model file says."""

    def __init__(self, model: bytes):
        told = fields(model)
        trainer, normal = (dict(fields(dict(told).get(part, b""))) for part in (TRAINER, NORMALIZER))
        if trainer.get(MODEL_TYPE) != 2 or not trainer.get(BYTE_FALLBACK) or trainer.get(AS_SUFFIX):
            raise ValueError("only BPE models whose unknown characters become bytes can be used")
        if normal.get(CHARSMAP) or not normal.get(DUMMY_PREFIX, 1) or normal.get(REMOVE_EXTRA, 1) or not normal.get(ESCAPE, 1):
            raise ValueError("only models that keep texts as they are, with a blank before each, can be used")
        entries = [dict(fields(v)) for k, v in told if k == PIECES]
        names = [e[1].decode() for e in entries]
        scores = [float(np.frombuffer(e.get(2, bytes(4)), "<f4")[0]) for e in entries]
        kinds = [e.get(3, NORMAL) for e in entries]
        if {USER_DEFINED, UNUSED} & set(kinds):
            raise ValueError("models with pieces of their users, or unused ones, can't be used")
        self.raw = [bytes([int(n[1:-1], 16)]) if k == BYTE else b"" if k == CONTROL else n.replace(BLANK, " ").encode() for n, k in zip(names, kinds, strict=True)]
        self.opens = [k == NORMAL and n.startswith(BLANK) for n, k in zip(names, kinds, strict=True)]
        self.byte_ids = [0] * 256
        for i, k in enumerate(kinds):
            if k == BYTE:
                self.byte_ids[self.raw[i][0]] = i
            elif k == UNKNOWN:
                self.raw[i] = " ⁇ ".encode()
        self.digits = list(map(str, range(len(names))))
        pieces = {n: i for i, (n, k) in enumerate(zip(names, kinds, strict=True)) if k == NORMAL}
        self._blanks(pieces, scores)
        self._ranks({n: i for n, i in pieces.items() if len(n) == 1 or n.strip(BLANK)}, scores)
        self.known: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    def _blanks(self, pieces: dict[str, int], scores: list[float]) -> None:
        """Pieces of several blanks: their ids by length. They tie below all others, so that leftmost blanks are joined first, at last."""
        own = {len(n): i for n, i in pieces.items() if not n.strip(BLANK)}
        low = {scores[i] for n, i in own.items() if n > 1}
        rest = [scores[i] for n, i in pieces.items() if len(n) > 1 and n.strip(BLANK)]
        if 1 not in own or len(low) > 1 or (low and rest and max(low) >= min(rest)):
            raise ValueError("only models whose pieces of blanks tie below all others can be used")
        if any(BLANK in n[1:] for n in pieces if n.strip(BLANK)):
            raise ValueError("only models whose pieces have a blank in front at most can be used")
        self.blanks = own

    def _ranks(self, pieces: dict[str, int], scores: list[float]) -> None:
        """Pieces by rank (single characters first, then as they are merged), and how each is made."""
        order = sorted(pieces, key=lambda n: (len(n) > 1, -scores[pieces[n]] if len(n) > 1 else 0))
        rank = {n: r for r, n in enumerate(order)}
        if len({scores[pieces[n]] for n in order if len(n) > 1}) < sum(len(n) > 1 for n in order):
            raise ValueError("pieces of one score can't be put in order")
        self.ids, self.single = [pieces[n] for n in order], sum(len(n) == 1 for n in order)
        self.size = list(map(len, order))
        self.left, self.right = list(range(len(order))), list(range(len(order)))
        self.joined: dict[tuple[int, int], int] = {}
        for name in order[self.single :]:
            parts = [rank.get(c, -1) for c in name]
            if min(parts) < 0:
                raise ValueError("a piece has a character that is no piece")
            while len(parts) > 1:
                # Ranks before this one have their joins already, so all but the last merge of this piece are known.
                best = min(((self.joined.get(pair, len(order)), i) for i, pair in enumerate(zip(parts, parts[1:]))), default=None)
                if best[0] == len(order):
                    break
                parts[best[1] : best[1] + 2] = [best[0]]
            if len(parts) != 2:
                raise ValueError("a piece isn't made of two earlier ones")
            r = rank[name]
            self.left[r], self.right[r] = parts
            self.joined[parts[0], parts[1]] = r
        self.alphabet = set(order[: self.single])
        self.automaton = ahocorasick.Automaton()
        for name, r in rank.items():
            self.automaton.add_word(name, r)
        self.automaton.make_automaton()
        # The longest piece that a piece starts with, beside itself.
        self.shorter = [next((rank[n[:k]] for k in range(len(n) - 1, 0, -1) if n[:k] in rank), -1) for n in order]

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging leaves a border between pieces a and b: the later made of the two parts at the border is taken apart,
        step by step, and what the parts would make must not come before the merges taken apart so far."""
        x, y, first, ok = a, b, len(self.left) + 1, True
        while ok := self.joined.get((x, y), first) >= first:
            if max(x, y) < self.single:
                break
            # The right part is the later one where both are equal: equal merges go from left to right.
            if x > y:
                first, x = x, self.right[x]
            else:
                first, y = y + 1, self.left[y]
        if len(self.pairs) >= CACHE_PAIRS:
            self.pairs.clear()
        self.pairs[a, b] = ok
        return ok

    def _backtrack(self, text: str) -> list[int]:
        """The ranks of the pieces of a text whose characters are all pieces."""
        n, size, known = len(text), self.size, self.pairs
        longest = [-1] * n
        for end, r in self.automaton.iter(text):
            longest[end + 1 - size[r]] = r  # later ones are longer
        failed, any_failed = bytearray(n // 8 + 1), False
        taken: list[int] = []
        at, last, piece = 0, -1, longest[0]
        while True:
            end = at + size[piece]
            if not (any_failed and failed[end >> 3] >> (end & 7) & 1):
                ok = last < 0 or known.get((last, piece))
                if ok or ok is None and self.compatible(last, piece):
                    taken.append(piece)
                    if end == n:
                        return taken
                    at, last, piece = end, piece, longest[end]
                    continue
            piece = self.shorter[piece]
            while piece < 0:
                # No piece can stand here after what was taken.
                any_failed = True
                failed[at >> 3] |= 1 << (at & 7)
                at -= size[last]
                piece = self.shorter[taken.pop()]
                last = taken[-1] if taken else -1

    def encode_chunk(self, chunk: str) -> list[int]:
        """The ids of a blank and a chunk without any."""
        text, out, at = BLANK + chunk, [], 0
        if not self.alphabet.issuperset(chunk):
            for i, c in enumerate(text):
                if c not in self.alphabet:
                    if at < i:
                        out += [self.ids[r] for r in self._backtrack(text[at:i])]
                    out += [self.byte_ids[b] for b in c.encode()]
                    at = i + 1
        if at < len(text):
            out += [self.ids[r] for r in self._backtrack(text[at:])]
        return out

    def encode_blanks(self, n: int) -> list[int]:
        """The ids of n blanks: the leftmost two neighbours that make a piece are joined, until none do."""
        own, lengths = self.blanks, []
        for _ in range(n):
            lengths.append(1)
            while len(lengths) > 1 and lengths[-2] + lengths[-1] in own:
                lengths[-2:] = [lengths[-2] + lengths[-1]]
        return [own[k] for k in lengths]

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        known, chunks = self.known, text.replace(" ", BLANK).split(BLANK)
        if len(known) > CACHE_CHUNKS:
            known.clear()
        long = {}
        for c in {c for c in chunks if c not in known}:
            (known if len(c) <= KEEP_CHARS else long)[c] = tuple(self.encode_chunk(c)) if c else ()
        found = [known[c] for c in chunks] if not long else [known[c] if c in known else long[c] for c in chunks]
        if "" not in chunks:
            return list(chain.from_iterable(found))
        out, blanks, one = [], 0, self.blanks[1]
        for c, ids in zip(chunks, found, strict=True):
            if not c:
                blanks += 1
            elif not blanks:
                out += ids
            else:
                # A chunk's own blank joins those before it, unless it is part of a piece.
                alone = ids[0] == one
                out += self.encode_blanks(blanks + alone)
                out += ids[alone:]
                blanks = 0
        return out + self.encode_blanks(blanks)

    def decode(self, ids: list[int]) -> str:
        """The text of ids, without the blank before it; bytes that make no character become U+FFFD one by one."""
        raw = b"".join(map(self.raw.__getitem__, ids))
        return raw[bool(ids) and self.opens[ids[0]] :].decode("utf-8", "each byte")


_codecs: dict[int, PieceCodec] = {}


def codec_of(model) -> PieceCodec:
    """One codec for each broadcast model and worker."""
    key = getattr(model, "id", None) or id(model)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = PieceCodec(model.value)
    return _codecs[key]


def piece_encode(docs: DataFrame, model_path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids and commas), decoded_sha256 and, if with_ids, ids and decoded of every row.

    The model file is read by the driver and broadcast: its size is that of the file, whatever the corpus.
    """
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        codec = codec_of(model)
        ids = [codec.encode((t or b"").decode("utf-8", "replace")) for t in part.column("text").to_pylist()]
        decoded = [codec.decode(x).encode() for x in ids]
        listed = [",".join(map(codec.digits.__getitem__, x)).encode() for x in ids]
        columns = [
            part.column("doc_id"),
            pa.array(list(map(len, ids)), pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in listed], pa.string()),
            pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string()),
        ]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if with_ids:
            columns += [pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.binary()).cast(pa.string())]
            names += ["ids", "decoded"]
        return pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc_id {doc_id_type(docs)}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_texts(texts_of(docs, "doc_id"), run, schema + ", ids array<int>, decoded string" * with_ids)
