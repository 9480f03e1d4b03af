"""N-gram Jaccard join with set-relation skipping (operator 7).

A document is its set of distinct 5-word shingles (ASCII capitals folded); with fewer words, its whole sequence is its
one shingle. Two documents link at a Jaccard similarity of `PER_CENT` or more, and the result is the component of each.

1. A set of n shingles links only if at most n - ceil(`PER_CENT` % of n) of them are its own. The half of all shingles with the
   smaller hashes is dealt by hash, and those that only one document has are counted: sets with more of them
   leave (`may_link`). That takes no table that would fill up as the corpus grows; the sets that stay are told to the second pass by a
   filter of some bits each, which only ever lets more stay. Equal sets are one class from here on. The classes that stay count their
   shingles, in a table of `MOST_LEVELS` bytes at most, and order them from rare to common: two sets that link share a
   shingle of their prefixes in any common order, and passages that many
   groups share move out of the prefixes. Collisions in that table change the order for all sets alike, so no link is
   lost. Only prefix shingles that may be in several of these classes are posted.
2. Answers from similar sets: sets with an equal least hash over their shared shingles stand together, at most
   `MOST_SETS` at a time, ordered by size. The overlaps of one set with the others come from its index lists; those of the next set, which
   links with it, are derived from them: only the lists of the shingles by which the two differ are read. Sets out of
   reach by size are skipped as a block. Linked sets get one component each time and are not compared again.
3. Skipping by index lists: in each list the sets of one component are a block, known by its sizes and by the best
   position in it. Two blocks of one list are passed over if no position and size in them leaves room for a link, and
   lists of one component make no block pair at all. From each pair of components that is left, the sets that meet
   in most lists are compared first, turn by turn, as each link makes blocks one.
4. What no turn settles is listed set by set, by position, and decided by bounds: the overlap of two sets lies near that of
   the sets that they are derived from, give or take the shingles by which each differs. Only pairs that this
   doesn't decide are compared themselves.

`links` and `link_counts` give the join itself: all pairs of classes that link, those inside a component too. They pass
over step 3 and take every pair of a list that fits by size and position.

Shingles are told apart by 64 bits of their words under a key that is drawn for each run (see `textops`), sets by 128: no
words can be chosen so that different shingles agree; one pair of unequal sets of a hundred shingles is misjudged with a
chance of about 1e-15.

Cases: null, empty and blank texts have the empty set, size 0, and are a component of their own; very long texts are
cut into shingles whole, alone in their block; equal rows are in one class; ties in size go by class number; a null
doc_id gets the smallest id of its component (null if it has none); ids that aren't whole numbers are refused; an empty
table gives an empty result; columns besides doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timetide.operators.graph import components
from timetide.operators.lineage import cut
from timetide.llm.substrings import PER_SHARD, cells_for, estimated_repeated, keys, require_ids, sketch, squeeze, unsqueeze
from timetide.llm.textops import Key, TextBlock, draw, mix, slices, window_hashes

N_GRAM = 5
PER_CENT = 80
LEAST_LEVELS, MOST_LEVELS = 1 << 20, 1 << 25
CHUNK_HASHES = 1_200_000
#: Hashes below this are dealt (half of them), without so many of their lowest bits.
HALF, CUT_BITS = np.uint64(1 << 63), np.uint64(20)
NEVER = 1 << 40
#: Least hashes by which sets come together for their first answers, and how many sets stand together at most.
KEYS = 2
MOST_SETS, MOST_TOKENS = 1000, 1_000_000
#: Turns of comparing pairs of components; what they leave open is compared in any case, so this only bounds the rounds.
TURNS = 4
ASKED = 4
#: Turns end where so many pairs of sets, for each set, stand behind the pairs of blocks at most.
OPEN_PAIRS = 20
#: The sets of fewer pairs than this are told to all tasks, so that others needn't be shuffled.
FEW_PAIRS = 50_000
#: Rows of sets, or of their pairs, for each task.
PER_TASK = 20_000
#: Sets of one index list that meet in one piece when all links are listed.
PER_PIECE = 500


class ShingleBlock:
    """The sets of some texts: distinct shingle hashes, ordered by document."""

    def __init__(self, texts: list[bytes | None], n_gram: int, key: Key):
        block = TextBlock(texts, lower=True)
        words = block.word_hashes(0, key)
        firsts, docs = block.windows(n_gram)
        h = window_hashes(words, n_gram, 0, key)[firsts] if len(firsts) else np.zeros(0, np.uint64)
        # Shorter texts: a hash of the whole sequence, by its length.
        for n in range(1, n_gram):
            short = np.flatnonzero(block.n_words == n)
            if len(short):
                own = mix(window_hashes(words, n, 0, key)[block.first[short]] ^ np.uint64(0xE7037ED1A0B428DB + 2 * n))
                h, docs = np.concatenate([h, own]), np.concatenate([docs, short])
        self.h, self.docs, self.n_docs = h, docs, block.n_docs

    def ordered(self, key: np.ndarray) -> None:
        """Keep each document's distinct hashes, ordered by key (equal keys only for equal hashes)."""
        order = np.argsort(key, kind="stable")
        order = order[np.argsort(self.docs[order], kind="stable")]
        h, docs = self.h[order], self.docs[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (docs[1:] != docs[:-1])
        self.h, self.docs = h[new], docs[new]
        self.n = np.bincount(self.docs, minlength=self.n_docs)
        self.first = np.cumsum(self.n) - self.n

    def fingerprints(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit sums over each set."""
        out = []
        for odd in (0x2545F4914F6CDD1D, 0xC2B2AE3D27D4EB4F):
            total = np.zeros(len(self.h) + 1, np.uint64)
            np.cumsum(mix(self.h ^ np.uint64(odd)), out=total[1:])
            out.append((total[self.first + self.n] - total[self.first]).view(np.int64))
        return out[0], out[1]


def _own(sets: ShingleBlock, per_cent: int) -> tuple[np.ndarray, np.ndarray]:
    """Of ordered sets: how many shingles are of the half that is dealt, and how many a set that links may have for itself at most."""
    return np.bincount(sets.docs[sets.h < HALF], minlength=sets.n_docs), sets.n + -per_cent * sets.n // 100


def _doc_keys(part: pa.RecordBatch) -> np.ndarray:
    """One number for the two that tell a document apart."""
    x, th = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for c in ("__id", "__th"))
    return mix(mix(x) ^ th)


def may_link(texts: DataFrame, n_gram: int, per_cent: int, key: Key, about: int) -> tuple[np.ndarray, int]:
    """A filter (see substrings.sketch) of the documents that may link, and its cells: sets that have too many shingles of their own aren't in it, but by chance.

    Hashes of the smaller half go, without their lowest bits, from each chunk of documents to the shard of their range. One that several documents of a
    chunk have goes there once. Shards answer which of the others are somewhere else too; what hashes have in common by chance only
    lets more sets stay. about: how many shingles there are, which sets the number of shards only.
    """
    shards = max(16, about // 2 // PER_SHARD)
    width = -(-int(HALF >> CUT_BITS) // shards)
    names, schema = ["key", "chunk", "n", "x", "who"], "key long, chunk long, n int, x binary, who binary"

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names)

    def dealt(number: int, h: list, docs: list, keys_: list, lack: list) -> pa.RecordBatch:
        h, docs, keys_, lack = map(np.concatenate, (h, docs, keys_, lack))
        order = np.argsort(h, kind="stable")
        h, docs = h[order], docs[order]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        many = np.diff(np.append(first, len(h)))
        lack = lack - np.bincount(docs[np.repeat(many > 1, many)], minlength=len(lack))
        # Documents count from 1; 0 stands for several, which know already.
        x, who = h[first], np.where(many > 1, 0, docs[first] + 1).astype(np.uint32)
        at = np.searchsorted(x, np.arange(shards + 1, dtype=np.uint64) * np.uint64(width))
        rows = [(s, number, hi - lo, squeeze(np.diff(x[lo:hi], prepend=np.uint64(s * width))), squeeze(who[lo:hi])) for s, (lo, hi) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)) if hi > lo]
        return batch_of([*rows, (-1 - number, number, len(keys_), keys_.tobytes(), squeeze(lack))])

    def deal(batches):
        number, n, base, rest = TaskContext.get().partitionId() << 32, 0, 0, ([], [], [], [])
        for batch in batches:
            for part in slices(batch):
                sets = ShingleBlock(part.column("text").to_pylist(), n_gram, key)
                sets.ordered(sets.h)
                half, most = _own(sets, per_cent)
                own = sets.h < HALF
                # Sets that are too small to be judged stay in any case, without the filter.
                lack = np.where(half > most, half - most, NEVER)
                for some, more in zip(rest, (sets.h[own] >> CUT_BITS, sets.docs[own] + base, _doc_keys(part), lack), strict=True):
                    some.append(more)
                base += sets.n_docs
                n += int(own.sum())
                if n >= CHUNK_HASHES:
                    yield dealt(number, *rest)
                    number, n, base, rest = number + 1, 0, 0, ([], [], [], [])
        if n:
            yield dealt(number, *rest)

    def answer(key_, table):
        """Of a shard: for each chunk the documents whose hashes come again, as often as they do."""
        if key_[0].as_py() < 0:
            return table
        rows = table.to_pylist()
        x = np.concatenate([np.cumsum(unsqueeze(r["x"], np.uint64, r["n"]), dtype=np.uint64) for r in rows])
        who = np.concatenate([unsqueeze(r["who"], np.uint32, r["n"]) for r in rows])
        order = np.argsort(x, kind="stable")
        same = x[order][1:] == x[order][:-1]
        again = np.zeros(len(x), bool)
        again[order] = np.append(same, False) | np.append(False, same)
        ends = np.cumsum([r["n"] for r in rows])[:-1]
        told = [w[a & (w > 0)] for w, a in zip(np.split(who, ends), np.split(again, ends), strict=True)]
        out = [(-1 - r["chunk"], r["chunk"], len(t), None, squeeze(t)) for r, t in zip(rows, told, strict=True) if len(t)]
        return pa.Table.from_batches([batch_of(out)]) if out else table.slice(0, 0)

    def stay(_, table):
        """Of a chunk: the documents whose hashes come again often enough."""
        rows = table.to_pylist()
        docs = next(r for r in rows if r["x"] is not None)
        lack = unsqueeze(docs["who"], np.int64, docs["n"])
        for r in rows:
            if r["x"] is None:
                lack = lack - np.bincount(unsqueeze(r["who"], np.uint32, r["n"]).astype(np.int64) - 1, minlength=len(lack))
        kept = np.frombuffer(docs["x"], np.uint64)[lack <= 0]
        return pa.table({"n": pa.array([len(kept)], pa.int64()), "text": pa.array([kept.tobytes()], pa.binary())})

    def twice(batches):
        return (np.repeat(np.frombuffer(x, np.uint64), 2) for batch in batches for x in batch.column("text").to_pylist() if x)

    staying = cut(texts.select("__id", "__th", "text").mapInArrow(deal, schema).groupBy("key").applyInArrow(answer, schema).groupBy("key").applyInArrow(stay, "n long, text binary"))
    cells = cells_for(8 * (staying.agg(F.sum("n").alias("s")).first()["s"] or 0))
    return sketch(staying, twice, cells), cells


def least_overlap(a: np.ndarray, b: np.ndarray, per_cent: int) -> np.ndarray:
    """The least overlap at which sets of these sizes link: 100 o >= per_cent (a + b - o)."""
    return -(-per_cent * (a + b) // (100 + per_cent))


def _need(a: Column, b: Column, per_cent: int) -> Column:
    return F.ceil(F.lit(per_cent) * (a + b) / F.lit(100 + per_cent)).cast("long")


def _parts(spark: SparkSession, rows: int) -> int:
    """Tasks for so many rows of sets or their links."""
    return max(spark.sparkContext.defaultParallelism, rows // PER_TASK)


def described(docs: DataFrame, n_gram: int, per_cent: int) -> tuple[DataFrame, int]:
    """The number of rows, and of every row: doc_id, __id and __th (see substrings.keys), n, f1, f2 (of the set) and, where it may link, own (the set, packed)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keys(), F.col("text").cast("string").cast("binary").alias("text"))
    size = docs.select(F.sum(F.octet_length(F.col("text").cast("string"))).alias("n"), F.count(F.lit(1)).alias("rows")).first()
    key = draw()
    found, cells = may_link(texts, n_gram, per_cent, key, (size["n"] or 0) // 6)
    bits = docs.sparkSession.sparkContext.broadcast(found)  # at most DEPTH * MOST_CELLS bits

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                sets = ShingleBlock(part.column("text").to_pylist(), n_gram, key)
                sets.ordered(sets.h)
                f1, f2 = sets.fingerprints()
                half, most = _own(sets, per_cent)
                stays = (sets.n > 0) & ((half <= most) | estimated_repeated(_doc_keys(part), bits.value, cells))
                packed = [squeeze(np.diff(sets.h[a : a + n], prepend=np.uint64(0))) if s else None for a, n, s in zip(sets.first.tolist(), sets.n.tolist(), stays.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "__id", "__th")), pa.array(sets.n, pa.int64()), pa.array(f1), pa.array(f2), pa.array(packed, pa.binary())], ["doc_id", "__id", "__th", "n", "f1", "f2", "own"])

    rows = cut(texts.mapInArrow(run, "doc_id long, __id long, __th long, n long, f1 long, f2 long, own binary"))
    bits.destroy()
    return rows, size["rows"]


def _packed(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    for cid, n, own in zip(*(batch.column(c).to_pylist() for c in ("cid", "n", "own")), strict=True):
        yield cid, np.cumsum(unsqueeze(own, np.uint64, n), dtype=np.uint64)


def _slot(h: np.ndarray, slots: int) -> np.ndarray:
    return (mix(h) & np.uint64(slots - 1)).astype(np.int64)


def frequencies(sets: DataFrame, slots: int) -> np.ndarray:
    """A byte for each slot of the shingle hashes: 0 where one set at most has such a shingle, else the more the more sets do (two steps a doubling)."""
    blocks = max(1, slots >> 20)
    per_block = slots // blocks

    def emit(kept):
        x, c = np.unique(np.concatenate(kept), return_counts=True)
        cut_at = np.searchsorted(x, np.arange(blocks + 1) * per_block)
        some = [(b, int(lo), int(hi)) for b, (lo, hi) in enumerate(zip(cut_at[:-1], cut_at[1:], strict=True)) if hi > lo]
        return pa.RecordBatch.from_arrays(
            [pa.array([b for b, _, _ in some], pa.int32()), pa.array([hi - lo for _, lo, hi in some], pa.int32()), pa.array([squeeze(np.diff(x[lo:hi], prepend=b * per_block)) for b, lo, hi in some], pa.binary()), pa.array([squeeze(c[lo:hi]) for _, lo, hi in some], pa.binary())],
            ["block", "n", "x", "c"],
        )

    def partial(batches):
        kept, n = [], 0
        for batch in batches:
            for _, h in _packed(batch):
                kept.append(_slot(h, slots))
                n += len(h)
                if n >= CHUNK_HASHES:
                    yield emit(kept)
                    kept, n = [], 0
        if n:
            yield emit(kept)

    def merge(batches):
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, n, x, c in zip(*(batch.column(k).to_pylist() for k in ("block", "n", "x", "c")), strict=True):
                if block not in counts:
                    counts[block] = np.zeros(per_block, np.int64)
                counts[block][np.cumsum(unsqueeze(x, np.int64, n))] += unsqueeze(c, np.int64, n)
        for block, c in counts.items():
            level = np.where(c > 1, np.floor(2 * np.log2(np.maximum(c, 1))), 0).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([pa.compress(level.tobytes(), codec="zstd", asbytes=True)], pa.binary())], ["block", "levels"])

    parts = sets.select("cid", "n", "own").mapInArrow(partial, "block int, n int, x binary, c binary")
    out = np.zeros((blocks, per_block), np.uint8)
    for r in parts.repartition(max(1, blocks // 2), "block").coalesce(max(1, blocks // 2)).mapInArrow(merge, "block int, levels binary").toLocalIterator(prefetchPartitions=True):  # at most MOST_LEVELS bytes in all
        out[r["block"]] = np.frombuffer(pa.decompress(r["levels"], decompressed_size=per_block, codec="zstd", asbytes=True), np.uint8)
    return out.ravel()


def prefixes(sets: DataFrame, per_cent: int) -> DataFrame:
    """Of the sets that post any shingle: cid, n, own, the posted shingles of the prefix (from rare to common) with their positions, and the KEYS by which they come together."""
    about = sets.agg(F.sum("n").alias("s")).first()["s"] or 0
    slots = min(MOST_LEVELS, max(LEAST_LEVELS, 1 << int(about // 4).bit_length()))
    levels = sets.sparkSession.sparkContext.broadcast(frequencies(sets, slots))  # at most MOST_LEVELS bytes

    def run(batches):
        for batch in batches:
            out = []
            for (cid, h), own in zip(_packed(batch), batch.column("own").to_pylist(), strict=True):
                level = levels.value[_slot(h, slots)]
                order = np.lexsort((h, level))[: len(h) - -(-per_cent * len(h) // 100) + 1]
                at = np.flatnonzero(level[order])
                if len(at):
                    shared = h[level > 0]
                    together = [int(mix(shared ^ np.uint64(k + 1)).min().view(np.int64)) for k in range(KEYS)]
                    out.append((cid, len(h), own, len(at), h[order[at]].tobytes(), at.astype(np.int32).tobytes(), together))
            if out:
                types = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["cid", "n", "own", "posted", "tokens", "places", "together"])

    posting = cut(sets.select("cid", "n", "own").mapInArrow(run, "cid long, n long, own binary, posted long, tokens binary, places binary, together array<long>"))
    levels.destroy()
    return posting


class Answers:
    """Overlaps of one set at a time with all sets of a group, each derived from the answers before it where that reads fewer lists."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = np.fromiter(map(len, sets), np.int64, len(sets))
        self.first = np.cumsum(self.n) - self.n
        _, self.token = np.unique(np.concatenate(sets), return_inverse=True)
        order = np.argsort(self.token, kind="stable")
        self.owner = np.repeat(np.arange(len(sets)), self.n)[order]
        self.lists = np.searchsorted(self.token[order], np.arange(self.token.max() + 2))
        self.overlap = np.zeros(len(sets), np.int64)
        self.current: np.ndarray | None = None
        self.mark = np.zeros(len(self.lists), bool)
        self.read = 0

    def tokens_of(self, x: int) -> np.ndarray:
        return self.token[self.first[x] : self.first[x] + self.n[x]]

    def _count(self, tokens: np.ndarray) -> np.ndarray:
        """How many of the tokens each set has."""
        starts, many = self.lists[tokens], self.lists[tokens + 1] - self.lists[tokens]
        self.read += int(many.sum())
        at = np.repeat(starts - (np.cumsum(many) - many), many) + np.arange(many.sum())
        return np.bincount(self.owner[at], minlength=len(self.n))

    def of(self, x: int) -> np.ndarray:
        mine = self.tokens_of(x)
        if self.current is not None:
            self.mark[self.current] = True
            more = mine[~self.mark[mine]]
            self.mark[self.current] = False
            self.mark[mine] = True
            less = self.current[~self.mark[self.current]]
            self.mark[mine] = False
            if len(more) + len(less) < len(mine):
                self.overlap = self.overlap + self._count(more) - self._count(less)
                self.current = mine
                return self.overlap
        self.overlap, self.current = self._count(mine), mine
        return self.overlap


def group_answers(sets: list[np.ndarray], per_cent: int) -> list[tuple[int, int, int, int]]:
    """(set, root, head, overlap with its head) of the sets of a group (by increasing size) that link: a head links with its set, a root is what a component's heads start from."""
    answers, out = Answers(sets), []
    n, free = answers.n, np.ones(len(sets), bool)
    for root in range(len(sets) - 1, -1, -1):
        if not free[root]:
            continue
        free[root], todo = False, [root]
        while todo and free.any():
            x = todo.pop()
            # Sets out of reach by size lie before lo and from hi on.
            lo, hi = np.searchsorted(n, -(-per_cent * n[x] // 100)), np.searchsorted(n, n[x] * 100 // per_cent, "right")
            near = np.flatnonzero(free[lo:hi]) + lo
            if not len(near):
                continue
            o = answers.of(x)[near]
            linked = near[100 * o >= per_cent * (n[near] + n[x] - o)]
            free[linked] = False
            out += [(y, root, x, int(answers.overlap[y])) for y in linked.tolist()]
            todo += linked.tolist()
    return out


def first_answers(posting: DataFrame, per_cent: int) -> DataFrame:
    """u, root, head, o, nu, nh: links of sets with their heads, found among sets that stand together."""
    together = posting.select("cid", "n", "own", F.explode("together").alias("g")).withColumn("lot", F.xxhash64("cid"))
    parts = _parts(posting.sparkSession, KEYS * posting.count())

    def settle(rows):
        rows.sort(key=lambda r: r[1])
        return [(rows[u][0], rows[root][0], rows[head][0], o, rows[u][1], rows[head][1]) for u, root, head, o in group_answers([h for _, _, h in rows], per_cent)]

    def batch_of(out):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["u", "root", "head", "o", "nu", "nh"])

    def run(batches):
        last, rows, tokens, out = None, [], 0, []
        for batch in batches:
            for g, (cid, h) in zip(batch.column("g").to_pylist(), _packed(batch), strict=True):
                if rows and (g != last or len(rows) >= MOST_SETS or tokens + len(h) > MOST_TOKENS):
                    if len(rows) > 1:
                        out += settle(rows)
                    rows, tokens = [], 0
                    if len(out) > 10_000:
                        yield batch_of(out)
                        out = []
                last = g
                rows.append((cid, len(h), h))
                tokens += len(h)
        if len(rows) > 1:
            out += settle(rows)
        if out:
            yield batch_of(out)

    # By ranges of (key, lot): a key of many sets takes as many tasks as it needs.
    dealt = together.repartitionByRange("g", "lot").sortWithinPartitions("g", "lot").select("g", "cid", "n", "own").coalesce(parts)
    return cut(dealt.mapInArrow(run, "u long, root long, head long, o long, nu long, nh long"))


def overlaps(sets: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """a, b, na, nb, o: the sizes and the exact overlap of the sets of each pair of classes. n: how many pairs there are at most."""
    some = sets.select("cid", "n", "own")
    if n < FEW_PAIRS:
        some = some.join(F.broadcast(pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()), "cid", "left_semi")
    side = lambda x: some.select(F.col("cid").alias(x), F.col("n").alias(f"n{x}"), F.col("own").alias(f"x{x}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "xa", "xb")

    def count(batches):
        for batch in batches:
            last, cached, out = None, None, []
            for na, nb, xa, xb in zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "xa", "xb")), strict=True):
                if xb != last:
                    last, cached = xb, np.cumsum(unsqueeze(xb, np.uint64, nb), dtype=np.uint64)
                mine = np.cumsum(unsqueeze(xa, np.uint64, na), dtype=np.uint64)
                at = np.minimum(np.searchsorted(cached, mine), max(nb - 1, 0))
                out.append(int((cached[at] == mine).sum()) if nb else 0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("a", "b", "na", "nb")), pa.array(out, pa.int64())], ["a", "b", "na", "nb", "o"])

    return both.coalesce(_parts(sets.sparkSession, n)).mapInArrow(count, "a long, b long, na long, nb long, o long")


def _prepared(docs: DataFrame, n_gram: int, per_cent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows with their sets' fingerprints, the classes of equal sets, and the sets that may link with their postings."""
    require_ids(docs)
    rows, n = described(docs, n_gram, per_cent)
    classes = rows.filter("n > 0").groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.count(F.lit(1)).alias("docs"), F.first("own").alias("own"))
    classes = cut(classes.coalesce(_parts(docs.sparkSession, n)).withColumn("cid", F.monotonically_increasing_id()))
    return rows, classes, prefixes(classes.filter("own IS NOT NULL").select("cid", "n", "own"), per_cent)


def _single(posting: DataFrame, *more: str) -> DataFrame:
    """t, cid, n, p and what else is named, of every posted shingle."""

    def spread(batches):
        for batch in batches:
            tokens = [np.frombuffer(x, np.int64) for x in batch.column("tokens").to_pylist()]
            if not tokens:
                continue
            many = np.fromiter(map(len, tokens), np.int64, len(tokens))
            places = np.concatenate([np.frombuffer(x, np.int32) for x in batch.column("places").to_pylist()])
            rest = [pa.array(np.repeat(batch.column(c).to_numpy(zero_copy_only=False), many)) for c in ("cid", "n", *more)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(places), *rest], ["t", "p", "cid", "n", *more])

    return posting.select("cid", "n", "tokens", "places", *more).mapInArrow(spread, "t long, p int, cid long, n long" + "".join(f", {c} long" for c in more))


def block_pairs(single: DataFrame, per_cent: int, turn: int) -> DataFrame:
    """t, la, lb, a, b, pairs: the blocks of different components in a list that may hold a link by size and position, with a set of each drawn by lot, and how many pairs of sets they hold."""
    blocks = single.groupBy("t", "label").agg(F.count(F.lit(1)).alias("sets"), F.max(F.col("n") - F.col("p")).alias("rest"), F.min("n").alias("least"), F.max("n").alias("most"), F.min_by("cid", F.xxhash64("cid", F.lit(turn))).alias("lead"))
    side = lambda x: blocks.select("t", F.col("label").alias(f"l{x}"), F.col("lead").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("rest", "least", "most", "sets")])
    room = (F.least("rest_a", "rest_b") >= _need(F.col("least_a"), F.col("least_b"), per_cent)) & (F.col("most_a") * 100 >= F.col("least_b") * per_cent) & (F.col("most_b") * 100 >= F.col("least_a") * per_cent)
    return side("a").join(side("b"), "t").filter((F.col("la") < F.col("lb")) & room).select("t", "la", "lb", "a", "b", (F.col("sets_a") * F.col("sets_b")).alias("pairs"))


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (cid and more, label) with those of connected classes brought together along links (la, lb)."""
    way = components(links.select(F.col("la").alias("a"), F.col("lb").alias("b"))).select(F.col("node").alias("label"), F.col("component").alias("to"))
    return cut(labels.join(way, "label", "left").withColumn("label", F.coalesce("to", "label")).drop("to").coalesce(labels.rdd.getNumPartitions()))


def connected(posting: DataFrame, heads: DataFrame, per_cent: int, turns: int = TURNS, open_pairs: int = OPEN_PAIRS) -> DataFrame:
    """cid, label of every set: sets have one label if links connect them. heads: links that are known (first_answers)."""
    n = posting.count()
    parts = _parts(posting.sparkSession, n)
    labels = _relabelled(posting.select("cid", "n", "tokens", "places").withColumn("label", F.col("cid")), heads.select(F.col("u").alias("la"), F.col("root").alias("lb")))
    met = cut(block_pairs(_single(labels, "label"), per_cent, 0).coalesce(parts))
    for turn in range(turns):
        # Few pairs of sets may stand behind the pairs of blocks: they are decided at once.
        if (met.agg(F.sum("pairs").alias("s")).first()["s"] or 0) <= open_pairs * n:
            break
        count = met.groupBy("la", "lb", "a", "b").agg(F.count(F.lit(1)).alias("c"))
        order = Window.partitionBy("la", "lb").orderBy(F.desc("c"), "a", "b")
        asked = cut(count.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= ASKED).select("la", "lb", "a", "b").coalesce(parts))
        found = overlaps(posting, asked, asked.count()).filter(F.col("o") >= _need(F.col("na"), F.col("nb"), per_cent)).select("a", "b")
        found = cut(asked.join(found, ["a", "b"]).select("la", "lb").distinct().coalesce(parts))
        if found.isEmpty():
            break
        labels = _relabelled(labels, found)
        met = cut(block_pairs(_single(labels, "label"), per_cent, turn + 1).coalesce(parts))
    single = _single(labels, "label")
    side = lambda x: single.select("t", F.col("label").alias(f"l{x}"), *[F.col(c).alias(f"{c}{x}" if c != "cid" else x) for c in ("cid", "n", "p")])
    need = _need(F.col("na"), F.col("nb"), per_cent)
    pairs = met.select("t", "la", "lb").join(side("a"), ["t", "la"]).join(side("b"), ["t", "lb"]).filter(F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= need)
    pairs = cut(pairs.select("la", "lb", "a", "b", need.alias("need")).distinct().coalesce(parts))
    last = _further(posting, pairs, heads)
    if not last.isEmpty():
        labels = _relabelled(labels, last.join(pairs, ["a", "b"]).select("la", "lb").distinct())
    return labels.select("cid", "label")


def _components(docs: DataFrame, n_gram: int, per_cent: int) -> tuple[DataFrame, DataFrame]:
    """The rows (see described) with node, a number of their component, for all that have words; and those without."""
    rows, classes, posting = _prepared(docs, n_gram, per_cent)
    labels = connected(posting, first_answers(posting, per_cent), per_cent)
    named = classes.select("cid", "f1", "f2", "rep").join(labels, "cid", "left").select("f1", "f2", "rep", F.coalesce("label", "cid").alias("node"))
    narrow = rows.drop("own")
    return narrow.filter("n > 0").join(named, ["f1", "f2"]), narrow.filter("n = 0")


def near_duplicates(docs: DataFrame, n_gram: int = N_GRAM, per_cent: int = PER_CENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (see the module)."""
    known, rest = _components(docs, n_gram, per_cent)
    names = known.groupBy("node").agg(F.min("rep").alias("component_id"))
    known = known.join(names, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return known.unionByName(rest.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def candidates(posting: DataFrame, per_cent: int, piece: int = PER_PIECE) -> DataFrame:
    """a, b, na, nb, need: every pair of classes, of one component or not, that may link by size and position.

    A list of more than `piece` sets is cut into pieces by a hash of the set, and each two pieces meet under a key of their own.
    """

    single = _single(posting)
    lists = single.groupBy("t").agg(F.ceil(F.count(F.lit(1)) / F.lit(piece)).cast("int").alias("pieces"), F.count(F.lit(1)).alias("k")).filter("k > 1").drop("k")
    dealt = single.join(lists, "t").withColumn("own", F.pmod(F.xxhash64("cid"), F.col("pieces")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))
    side = lambda x: [F.col(c).alias(f"{c}{x}" if c != "cid" else x) for c in ("cid", "n", "p")]
    left = dealt.select("t", F.col("own").alias("i"), every.alias("j"), *side("a"))
    right = dealt.select("t", every.alias("i"), F.col("own").alias("j"), *side("b"))
    need = _need(F.col("na"), F.col("nb"), per_cent)
    met = left.join(right, ["t", "i", "j"]).filter((F.col("a") < F.col("b")) & (F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= need))
    return met.select("a", "b", "na", "nb").distinct().withColumn("need", need)


def _links(docs: DataFrame, n_gram: int, per_cent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows, classes, and all links a, b between the classes, each proved by the overlap or by the bounds from heads."""
    rows, classes, posting = _prepared(docs, n_gram, per_cent)
    return rows, classes, _further(posting, cut(candidates(posting, per_cent)), first_answers(posting, per_cent))


def links(docs: DataFrame, n_gram: int = N_GRAM, per_cent: int = PER_CENT) -> DataFrame:
    """rep_a, rep_b, docs_a, docs_b: every link between two classes of equal sets, by the smallest doc_id of each (null if it has none) and the rows of each.

    All rows of one class link with each other besides, and a link of two classes is one of each row with each of the other.
    """
    _, classes, found = _links(docs, n_gram, per_cent)
    side = lambda x: classes.select(F.col("cid").alias(x), F.col("rep").alias(f"rep_{x}"), F.col("docs").alias(f"docs_{x}"))
    return found.join(side("a"), "a").join(side("b"), "b").select("rep_a", "rep_b", "docs_a", "docs_b")


def link_counts(docs: DataFrame, n_gram: int = N_GRAM, per_cent: int = PER_CENT) -> DataFrame:
    """doc_id, n_shingles, n_links (the other rows that it links with) of every row of docs; the empty set links with none."""
    rows, classes, found = _links(docs, n_gram, per_cent)
    both = found.select("a", "b").unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(classes.select(F.col("cid").alias("b"), "docs"), "b").groupBy(F.col("a").alias("cid")).agg(F.sum("docs").alias("others"))
    counted = classes.join(others, "cid", "left").select("f1", "f2", (F.col("docs") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    known = rows.filter("n > 0").join(counted, ["f1", "f2"]).select("doc_id", F.col("n").alias("n_shingles"), "n_links")
    return known.unionByName(rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.lit(0).cast("long").alias("n_links")))


def _further(sets: DataFrame, pairs: DataFrame, heads: DataFrame) -> DataFrame:
    """The links a, b among pairs (computed before): by bounds from their heads' overlap where those decide, by comparison elsewhere."""
    n = pairs.count()
    if not n:
        return pairs.select("a", "b")
    parts = _parts(pairs.sparkSession, n)
    best = heads.groupBy("u").agg(F.max_by(F.struct("head", "o", "nu", "nh"), F.struct("o", "head")).alias("x")).select("u", "x.*")
    lead = best.select(F.col("u").alias("cid"), F.col("head").alias("lead"), (F.col("nu") - F.col("o")).alias("more"), (F.col("nh") - F.col("o")).alias("less"))
    side = lambda c: lead.select(*[F.col(x).alias(f"{x}_{c}" if x != "cid" else c) for x in lead.columns])
    p = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    p = p.withColumns({f"lead_{c}": F.coalesce(f"lead_{c}", c) for c in "ab"} | {f"{x}_{c}": F.coalesce(f"{x}_{c}", F.lit(0)) for x in ("more", "less") for c in "ab"})
    p = cut(p.withColumns({"la": F.least("lead_a", "lead_b"), "lb": F.greatest("lead_a", "lead_b")}).coalesce(parts))
    known = overlaps(sets, p.select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct(), n).select("a", "b", "o")
    p = p.join(known.select(F.col("a").alias("la"), F.col("b").alias("lb"), "o"), ["la", "lb"])
    # An element in both sets is in both heads or among what one of them has more than its head.
    p = cut(p.withColumn("most", F.col("o") + F.col("more_a") + F.col("more_b")).withColumn("least", F.col("o") - F.col("less_a") - F.col("less_b")).filter("most >= need").select("a", "b", "need", "least").coalesce(parts))
    sure, open_ = p.filter("least >= need").select("a", "b"), p.filter("least < need").select("a", "b", "need")
    done = overlaps(sets, open_, n).select("a", "b", "o").join(open_, ["a", "b"]).filter("o >= need").select("a", "b")
    return cut(sure.unionByName(done).coalesce(parts))


def keep_one(docs: DataFrame, n_gram: int = N_GRAM, per_cent: int = PER_CENT) -> DataFrame:
    """The rows of docs less near duplicates: of each component one document stays, the one of the smallest id.

    Documents without an id come last, by a hash of their text; of equal ids or equal rows one stays. Documents without
    words all stay. All columns are kept.
    """
    known, _ = _components(docs.select("doc_id", "text"), n_gram, per_cent)
    stay = known.groupBy("node").agg(F.min(F.struct("__id", "__th")).alias("first")).select("first.*")
    own = docs.columns
    places = docs.toDF(*[f"c{i}" for i in range(len(own))])  # by place, so that no name of docs can clash
    text = F.col(f"c{own.index('text')}")
    wordy = F.coalesce(text.cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    keyed = places.filter(wordy).select("*", *keys(F.col(f"c{own.index('doc_id')}"), text))
    kept = keyed.join(stay, ["__id", "__th"], "left_semi").dropDuplicates(["__id", "__th"]).drop("__id", "__th")
    return kept.unionByName(places.filter(~wordy)).toDF(*own)


#: The rows of op7_jaccard_join in DuckDB; ids are unique there.
ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1 : i + 5], ' '))) END AS own FROM d
), n AS (SELECT doc_id, len(own) AS n_shingles FROM s),
u AS (SELECT doc_id, unnest(own) AS k FROM s),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM u a JOIN u b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n_shingles + y.n_shingles - c)),
g AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(doc_id, pos) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, g.b FROM reach r JOIN g ON g.a = r.pos)
SELECT doc_id, n_shingles, min(pos) AS component_id FROM reach JOIN n USING (doc_id) GROUP BY doc_id, n_shingles
"""
