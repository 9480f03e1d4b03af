"""Quality rules as a short-circuit cascade (operator 5).

`CascadeRule`s look at one document's statistics or text; a document is kept if every rule passes it. On a bounded
sample the cascade measures each rule's seconds a document and the share that it rejects, and orders the rules by
rejection per cost. Each rule then sees only the documents that all rules before it passed. The order changes what
is computed, never the verdict.

The base statistics of every whole text are always computed, as they are results themselves.

Cases: a null or empty text has no words, so the base rule rejects it; a very long text is looked at whole, alone in
its block; repeated rows get equal answers; rules of equal rejection per cost keep their given order; a table without
rows gives an empty result; columns besides doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timetide.llm.textops import TextBlock, doc_id_type, map_texts, mix, sums_by_doc, texts_of, window_hashes

SAMPLE_ROWS = 1000
SAMPLE_CHARS = 20_000
REPEAT_WINDOW = 8

# The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"

IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[list(SYMBOLS)] = True
IS_UPPER = np.zeros(256, bool)
IS_UPPER[65:91] = True
IS_LETTER = np.zeros(256, bool)
IS_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
IS_CONTINUATION = np.zeros(256, bool)
IS_CONTINUATION[128:192] = True
IS_DIGIT = np.zeros(256, bool)
IS_DIGIT[48:58] = True


def repeats_within(hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values occur twice or more within their document, and which are not the first there.

    docs must not decrease.
    """
    key = mix(hashes ^ mix(docs.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    same = ordered[1:] == ordered[:-1]
    many, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    many[order[1:][same]] = True
    later[order[1:][same]] = True
    many[order[:-1][same]] = True
    return many, later


def counts_by_doc(flags: np.ndarray, block: TextBlock) -> np.ndarray:
    """How many bytes of each document have their flag set."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[block.doc_end] - total[block.doc_start]


def dup_lines(text: bytes) -> int:
    """How many lines with a word equal an earlier line; the lines themselves are compared."""
    lines = text.split(b"\n")
    if len(set(lines)) == len(lines):
        return 0
    lines = [x for x in lines if x.strip()]
    return len(lines) - len(set(lines))


def repeated_windows(block: TextBlock, width: int = REPEAT_WINDOW) -> np.ndarray:
    """First words of the windows that are found twice or more in their document.

    Hashes tell which windows may be; the words of those are then compared.
    """
    firsts, docs = block.windows(width)
    if not len(firsts):
        return firsts
    may = repeats_within(window_hashes(block.word_hashes(), width)[firsts], docs)[0]
    firsts, docs = firsts[may], docs[may]
    out = []
    for doc in np.split(np.arange(len(docs)), np.flatnonzero(np.diff(docs)) + 1) if len(docs) else []:
        words = block.words(docs[doc[0]])
        own = (firsts[doc] - block.first[docs[doc[0]]]).tolist()
        keys = [tuple(words[i : i + width]) for i in own]
        many = Counter(keys)
        out.append(firsts[doc[[many[k] > 1 for k in keys]]])
    return np.concatenate(out) if out else firsts


@dataclass
class TextStats:
    """The base statistics of a block of texts, one array entry a document."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray

    @classmethod
    def of(cls, block: TextBlock) -> TextStats:
        blob, n = block.blob, block.n_docs
        chars = counts_by_doc(~IS_CONTINUATION[blob], block) - counts_by_doc((blob == 32) | (blob >= 9) & (blob <= 13), block)
        dup = np.array([dup_lines(block.text(i)) for i in range(n)], np.int64)
        covered = np.zeros(len(block.starts) + 1, np.int64)
        repeated_at = repeated_windows(block)
        np.add.at(covered, repeated_at, 1)
        np.add.at(covered, repeated_at + REPEAT_WINDOW, -1)
        repeated = sums_by_doc((np.cumsum(covered)[:-1] > 0).astype(np.int64), block.first, block.n_words)
        return cls(block.n_words, chars, counts_by_doc(IS_SYMBOL[blob], block), dup, repeated)

    def base_failed(self) -> np.ndarray:
        return (self.n_words < 20) | (100 * self.n_repeat_words > 30 * self.n_words)


@dataclass(frozen=True)
class CascadeRule:
    """`passes(block, stats, rows)`: for the rows asked for, whether the document passes."""

    name: str
    passes: Callable[[TextBlock, TextStats, np.ndarray], np.ndarray]


def _short_words(block: TextBlock, s: TextStats, rows: np.ndarray) -> np.ndarray:
    n = s.n_words[rows]
    return (s.word_chars[rows] >= 2 * n) & (s.word_chars[rows] <= 16 * n)


def _symbols(block: TextBlock, s: TextStats, rows: np.ndarray) -> np.ndarray:
    return 100 * s.n_symbols[rows] <= 10 * s.n_words[rows]


def _dup_lines(block: TextBlock, s: TextStats, rows: np.ndarray) -> np.ndarray:
    return 2 * s.n_dup_lines[rows] <= np.maximum(_line_count(block, rows), 1)


def _line_count(block: TextBlock, rows: np.ndarray) -> np.ndarray:
    return np.array([np.count_nonzero(block.blob[block.doc_start[r] : block.doc_end[r]] == 10) + 1 for r in rows], np.int64)


def _share(table: np.ndarray, per_cent: int) -> Callable[[TextBlock, TextStats, np.ndarray], np.ndarray]:
    """At most so many of 100 bytes of the words are in the table."""

    def passes(block: TextBlock, s: TextStats, rows: np.ndarray) -> np.ndarray:
        found = np.array([np.count_nonzero(table[block.blob[block.doc_start[r] : block.doc_end[r]]]) for r in rows], np.int64)
        return 100 * found <= per_cent * np.maximum(s.word_chars[rows], 1)

    return passes


def _runs(block: TextBlock, s: TextStats, rows: np.ndarray) -> np.ndarray:
    """At most 30 of 100 words equal the word before."""
    out = np.ones(len(rows), bool)
    for i, r in enumerate(rows):
        lo, n = block.first[r], block.n_words[r]
        size = block.ends[lo : lo + n] - block.starts[lo : lo + n]
        alike = np.flatnonzero(size[1:] == size[:-1])
        a, b = block.starts[lo : lo + n][alike], block.starts[lo : lo + n][alike + 1]
        same = sum(block.blob[x : x + k].tobytes() == block.blob[y : y + k].tobytes() for x, y, k in zip(a.tolist(), b.tolist(), size[alike].tolist(), strict=True)) if 100 * len(alike) > 30 * n else 0
        out[i] = 100 * same <= 30 * n
    return out


RULES = [
    CascadeRule("mean word length within 2 to 16", _short_words),
    CascadeRule("at most 10 symbols in 100 words", _symbols),
    CascadeRule("at most half of the lines repeat an earlier one", _dup_lines),
    CascadeRule("at most 60 % capital letters", _share(IS_UPPER, 60)),
    CascadeRule("at most 40 % digits", _share(IS_DIGIT, 40)),
    CascadeRule("at most 30 % of the words equal the word before", _runs),
]


@dataclass(frozen=True)
class RuleEstimate:
    name: str
    seconds: float  # a document
    rejects: float  # share of the documents

    @property
    def rank(self) -> float:
        return self.rejects / max(self.seconds, 1e-9)


def estimate(rules: list[CascadeRule], texts: list[bytes]) -> list[RuleEstimate]:
    """Cost and selectivity of every rule on the sample, each over all of it."""
    if not texts:
        return [RuleEstimate(r.name, 0.0, 0.0) for r in rules]
    block = TextBlock(texts)
    stats, rows, out = TextStats.of(block), np.arange(block.n_docs), []
    for rule in rules:
        began = time.perf_counter()
        passed = rule.passes(block, stats, rows)
        out.append(RuleEstimate(rule.name, (time.perf_counter() - began) / len(texts), float(1 - passed.mean())))
    return out


def order_rules(rules: list[CascadeRule], estimates: list[RuleEstimate]) -> list[CascadeRule]:
    """By rejection per cost, best first; ties keep the given order."""
    return [r for _, r in sorted(zip(estimates, rules, strict=True), key=lambda x: -x[0].rank)]


def cascade(rules: list[CascadeRule], block: TextBlock, stats: TextStats, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which documents pass every rule, and the place of the rule that rejected each other (-1 for none)."""
    alive, by = alive.copy(), np.full(block.n_docs, -1, np.int32)
    for place, rule in enumerate(rules):
        rows = np.flatnonzero(alive)
        if not len(rows):
            break
        out = rows[~rule.passes(block, stats, rows)]
        alive[out], by[out] = False, place
    return alive, by


def sample_texts(docs: DataFrame, rows: int = SAMPLE_ROWS) -> list[bytes]:
    """Texts of about so many rows, chosen by a hash of doc_id, for estimates only."""
    n = docs.count()
    if not n:
        return []
    chosen = docs.filter((F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(23)), F.lit(1 << 30)) < int(min(1, rows / n) * (1 << 30))) & (F.length("text") <= SAMPLE_CHARS))
    return [bytes(r["text"]) for r in texts_of(chosen).collect()]


def apply_rules(docs: DataFrame, rules: list[CascadeRule] = RULES) -> DataFrame:
    """doc_id, the base statistics, base_failed, kept and rejected_by (a rule's name, null if kept or failed at base) of every row."""
    ordered = order_rules(rules, estimate(rules, sample_texts(docs)))
    names = np.array([r.name for r in ordered] + [None], object)

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        block = TextBlock(part.column("text").to_pylist())
        s = TextStats.of(block)
        failed = s.base_failed()
        kept, by = cascade(ordered, block, s, ~failed)
        columns = [part.column("doc_id"), *(pa.array(x, pa.int64()) for x in (s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words))]
        return pa.RecordBatch.from_arrays([*columns, pa.array(failed), pa.array(kept), pa.array(names[by], pa.string())], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by"])

    return map_texts(texts_of(docs, "doc_id"), run, f"doc_id {doc_id_type(docs)}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string")


#: The same rows in DuckDB; ids are unique there.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), b AS (
  SELECT doc_id, t, w, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    list_transform(range(greatest(len(w) - 7, 0)), lambda i: array_to_string(w[i + 1 : i + 8], ' ')) AS windows
  FROM d
), u AS (SELECT doc_id, unnest(windows) AS k, unnest(range(len(windows))) AS i FROM b),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM u) WHERE c > 1),
v AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS pos FROM r) GROUP BY doc_id),
s AS (
  SELECT doc_id, n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(v.n, 0) AS n_repeat_words,
    length(t) - length(replace(t, chr(10), '')) + 1 AS n_lines, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS upper, length(t) - length(regexp_replace(t, '[0-9]', '', 'g')) AS digits,
    coalesce(list_sum(list_transform(range(greatest(len(w) - 1, 0)), lambda i: CAST(w[i + 1] = w[i + 2] AS BIGINT))), 0) AS same
  FROM b LEFT JOIN v USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND word_chars BETWEEN 2 * n_words AND 16 * n_words AND 100 * n_symbols <= 10 * n_words AND 2 * n_dup_lines <= n_lines
    AND 100 * upper <= 60 * greatest(word_chars, 1) AND 100 * digits <= 40 * greatest(word_chars, 1) AND 100 * same <= 30 * n_words AS kept
FROM s
"""
