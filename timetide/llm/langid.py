"""Language identification (operator 1): averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its hashed byte 3-grams and 4-grams (within words, with the blanks
beside them); a linear softmax sits on the mean, and both are fitted by stochastic gradient descent in numpy.
As mean and softmax input are linear, the fitted model is one table of logits a bucket, which scoring averages
over the whole text. A part of the sample that the fit doesn't see sets the softmax temperature and the
confidence under which a text is rejected, so that accepted ones are right at the rate asked for.

Cases: a null text, or one without a letter, gets `und`, score 0 and is not accepted; a text with letters but no
3-gram gets the prior's answer; repeated rows get equal answers; no labelled row at all gives `und` everywhere;
very long texts are read whole, alone in their block, when they are judged, and in pieces from all over them when the model
learns; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timetide.llm.samples import sample_by_class, spread
from timetide.llm.textops import IS_SPACE, LOWER, TextBlock, doc_id_type, map_texts, sums_by_doc, texts_of

BUCKETS = 8192
#: The fit takes at most about so many documents of each language, each of at most so many characters.
SAMPLE_PER_LANGUAGE = 600
SAMPLE_CHARS = 20_000

_CODE = LOWER.copy()
_CODE[IS_SPACE] = 32


def subword_buckets(blob: np.ndarray) -> list[np.ndarray]:
    """Bucket (1 and up) of the 3-gram and 4-gram that start at each byte, 0 where a blank lies inside one."""
    b = _CODE[blob].astype(np.uint32)
    blank = b == 32
    n = len(b)
    out = []
    for size, odd in ((3, 0x9E3779B1), (4, 0x85EBCA6B)):
        code = np.zeros(n, np.uint32)
        if n >= size:
            x = np.zeros(n - size + 1, np.uint32)
            bad = np.zeros(n - size + 1, bool)
            for i in range(size):
                x *= np.uint32(0x01000193)
                x += b[i : n - size + 1 + i]
                if 0 < i < size - 1:
                    bad |= blank[i : n - size + 1 + i]
            x *= np.uint32(odd)
            x >>= np.uint32(19)
            x %= np.uint32(BUCKETS - 1)
            x += np.uint32(1)
            x[bad] = 0
            code[: n - size + 1] = x
        out.append(code)
    return out


@dataclass
class LanguageModel:
    languages: list[str]
    logits: np.ndarray  # (BUCKETS, languages); row 0 is zero
    bias: np.ndarray
    temperature: float
    least: float  # confidence under which an answer is rejected

    def predict(self, texts: list[bytes]) -> np.ndarray:
        """Probabilities of every language for every text."""
        block = TextBlock(texts)
        total = np.zeros((block.n_docs, len(self.languages)))
        n = np.zeros(block.n_docs)
        for code in subword_buckets(block.blob):
            total += sums_by_doc(self.logits[code], block.doc_start, block.sizes)
            n += sums_by_doc((code > 0).astype(np.int32), block.doc_start, block.sizes)
        z = (total / np.maximum(n, 1)[:, None] + self.bias) / self.temperature
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        return p / p.sum(axis=1, keepdims=True)


def fit(texts: list[bytes], labels: list[str], dims: int = 16, epochs: int = 25, rate: float = 2.0, precision: float = 0.99, seed: int = 7) -> LanguageModel:
    """Fit by stochastic gradient descent on four fifths, calibrate on the rest."""
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    y = np.array([languages.index(x) for x in labels])
    x = np.zeros((len(texts), BUCKETS), np.float32)
    for i, t in enumerate(texts):
        for code in subword_buckets(np.frombuffer(b"\n" + t + b"\n", np.uint8)):
            x[i] += np.bincount(code, minlength=BUCKETS)
    x[:, 0] = 0
    x /= np.maximum(x.sum(axis=1, keepdims=True), 1)
    order = rng.permutation(len(texts))
    held, train = order[: len(order) // 5], order[len(order) // 5 :]
    e = rng.normal(0, 0.1, (BUCKETS, dims)).astype(np.float32)
    w = rng.normal(0, 0.1, (dims, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)
    step, total = 0, epochs * -(-max(len(train), 1) // 16)
    for _ in range(epochs):
        rng.shuffle(train)
        for at in range(0, len(train), 16):
            rows = train[at : at + 16]
            xs = x[rows]
            h = xs @ e
            z = h @ w + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p /= len(rows)
            lr = rate * (1 - step / total)
            used = np.flatnonzero(xs.any(axis=0))
            grad = xs[:, used].T @ (p @ w.T)
            w -= lr * (h.T @ p)
            bias -= lr * p.sum(axis=0)
            e[used] -= lr * 50 * grad
            step += 1
    table = (e @ w).astype(np.float32)
    table[0] = 0
    z = x[held] @ table + bias
    temperature, least = calibrate(z, y[held], precision) if len(held) else (1.0, 0.0)
    return LanguageModel(languages, table, bias.astype(np.float64), temperature, least)


def calibrate(z: np.ndarray, y: np.ndarray, precision: float) -> tuple[float, float]:
    """The temperature of least log loss, and the least confidence from which on answers are right at the given rate."""

    def probabilities(t: float) -> np.ndarray:
        p = np.exp((z - z.max(axis=1, keepdims=True)) / t)
        return p / p.sum(axis=1, keepdims=True)

    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 60))
    loss = [-np.log(probabilities(t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
    t = float(grid[int(np.argmin(loss))])
    p = probabilities(t)
    sure, right = p.max(axis=1), p.argmax(axis=1) == y
    order = np.argsort(-sure)
    rate = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(rate >= precision)
    return t, float(sure[order][good[-1]]) if len(good) else 1.0


def fit_on(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel | None:
    """Fit on a bounded sample of the rows of docs that have lang and text, in an order of its own: however the rows are dealt, the model is the same."""
    rows = docs.select("doc_id", "lang", "text").filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    chosen = sample_by_class(rows, "lang", "doc_id", per_language).select("lang", spread(F.col("text").cast("string"), SAMPLE_CHARS).alias("text"))
    got = sorted((r["lang"], r["text"]) for r in chosen.collect())
    return fit([t.encode() for _, t in got], [g for g, _ in got]) if got else None


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """doc_id, lang_pred, score (confidence, 0 to 1) and accepted of every row of docs; only the text is used."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages floats
    rows = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text"), F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False)).alias("letters"))

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        m = sent.value
        letters = part.column("letters").to_numpy(zero_copy_only=False)
        names, score = np.full(part.num_rows, "und", object), np.zeros(part.num_rows)
        if m is not None:
            p = m.predict(part.column("text").to_pylist())
            names[letters] = np.array(m.languages, object)[p.argmax(axis=1)][letters]
            score[letters] = p.max(axis=1)[letters]
        ok = letters & (score >= (m.least if m else 2))
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(score), pa.array(ok)], ["doc_id", "lang_pred", "score", "accepted"])

    return map_texts(rows, run, f"doc_id {doc_id_type(docs)}, lang_pred string, score double, accepted boolean")
