"""Quality classifier (operator 4): regularised quadratic discriminant analysis over document statistics.

Each text gives a vector of transformed statistics (logs of counts, log-odds of shares). Each class has a mean and a
covariance shrunk towards the diagonal of the pooled one; its Cholesky factor is computed once and kept, so a score is
the difference of two Mahalanobis log densities plus the log prior. A logistic scale, fitted on the part of the sample
that the densities didn't see, turns the difference into a score from 0 to 1.

Cases: a null or empty text has the statistics of an empty text and a score like any other; a very long text is scored
whole, alone in its block (only the fit passes over it); repeated rows get equal scores; an empty table gives an empty
result; without labelled rows of both classes every score is the share of class 1 in the sample (0.5 without rows);
columns besides doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timetide.llm.quality_rules import IS_DIGIT, IS_LETTER, IS_SYMBOL, IS_UPPER, TextStats, counts_by_doc
from timetide.llm.samples import sample_by_class
from timetide.llm.textops import TextBlock, doc_id_type, map_texts, sums_by_doc, texts_of

#: The fit takes at most about so many labelled documents of each class, each of at most so many characters.
SAMPLE_PER_CLASS = 1500
SAMPLE_CHARS = 20_000

STATISTICS = [
    "log words", "log characters a word", "log characters a line", "symbols", "capitals", "digits", "marks", "end marks",
    "first words of a sentence", "repeated words", "words in repeated windows", "repeated lines", "distinct lengths", "short words",
]

# Characters that end a sentence.
IS_END = np.zeros(256, bool)
IS_END[list(b".!?")] = True
IS_BANG = np.zeros(256, bool)
IS_BANG[list(b"!?")] = True


def _log_odds(part: np.ndarray, whole: np.ndarray, weight: float = 1.0) -> np.ndarray:
    """The log-odds of a share, drawn towards a small one where there is little text."""
    return np.log((part + 0.1 * weight) / (np.maximum(whole - part, 0) + 4 * weight))


def statistics(block: TextBlock) -> np.ndarray:
    """(documents, statistics): the transformed statistics of each text."""
    blob, s = block.blob, TextStats.of(block)
    count = lambda flags: counts_by_doc(flags, block).astype(float)
    words, chars = s.n_words.astype(float), s.word_chars.astype(float)
    letters, lines = count(IS_LETTER[blob]), count(blob == 10) + 1
    upper, digits = count(IS_UPPER[blob]), count(IS_DIGIT[blob])
    bang, ends = count(IS_BANG[blob]), count(IS_END[blob])
    size = block.ends - block.starts
    hashes = block.word_hashes()
    docs = block.doc_of_word()
    repeats = np.zeros(len(size), np.int64)
    repeats[1:] = (hashes[1:] == hashes[:-1]) & (docs[1:] == docs[:-1])
    same_size = np.zeros(len(size), np.int64)
    same_size[1:] = size[1:] == size[:-1]
    starts_upper = IS_UPPER[blob[block.starts]].astype(np.int64) if len(size) else repeats
    by_doc = lambda v: sums_by_doc(v, block.first, block.n_words).astype(float)
    return np.column_stack([
        np.log1p(words), np.log1p(chars / np.maximum(words, 1)), np.log1p(chars / lines),
        _log_odds(s.n_symbols, chars), _log_odds(upper, letters), _log_odds(digits, chars), _log_odds(bang, chars), _log_odds(ends, chars),
        _log_odds(by_doc(starts_upper), words), _log_odds(by_doc(repeats), words), _log_odds(s.n_repeat_words, words), _log_odds(s.n_dup_lines, lines),
        _log_odds(by_doc(same_size), words), _log_odds(by_doc((size <= 2).astype(np.int64)), words),
    ])


@dataclass
class QuadraticDiscriminant:
    """Two Gaussians with shrunk covariances. Their Cholesky factors, the inverses of these and the log determinants are computed once."""

    shrinkage: float = 0.1
    centre: np.ndarray | None = None
    scale: np.ndarray | None = None
    means: list[np.ndarray] = field(default_factory=list)
    factors: list[np.ndarray] = field(default_factory=list)
    inverses: list[np.ndarray] = field(default_factory=list)  # of the factors
    log_dets: list[float] = field(default_factory=list)  # of the covariances
    log_prior: float = 0.0
    logistic: tuple[float, float] = (1.0, 0.0)
    constant: float | None = None

    def fit(self, x: np.ndarray, y: np.ndarray, prior: float | None = None, seed: int = 3) -> QuadraticDiscriminant:
        prior = float(y.mean()) if prior is None and len(y) else 0.5 if prior is None else prior
        if len(y) < 8 or min((y == 0).sum(), (y == 1).sum()) < 4:
            self.constant = prior
            return self
        order = np.random.default_rng(seed).permutation(len(y))
        held, train = order[: len(y) // 4], order[len(y) // 4 :]
        if len(set(y[train])) < 2 or len(set(y[held])) < 2:
            held = train = order
        self.centre, self.scale = x[train].mean(axis=0), x[train].std(axis=0) + 1e-3
        z = (x - self.centre) / self.scale
        parts = [z[train][y[train] == c] for c in (0, 1)]
        pooled = np.diag(np.mean([p.var(axis=0) for p in parts], axis=0) + 1e-2)
        for p in parts:
            self.means.append(p.mean(axis=0))
            own = np.cov(p.T, bias=True)
            self.factors.append(np.linalg.cholesky((1 - self.shrinkage) * own + self.shrinkage * pooled))
            self.inverses.append(inverse_of_lower(self.factors[-1]))
            self.log_dets.append(2 * float(np.log(np.diag(self.factors[-1])).sum()))
        self.log_prior = float(np.log(prior / (1 - prior)))
        d = self.difference(x[held])
        # The sample is balanced by class; weights give the classes their shares in all labelled rows.
        w = np.where(y[held] == 1, prior / max(y[held].mean(), 1e-9), (1 - prior) / max(1 - y[held].mean(), 1e-9))
        self.logistic = fit_logistic(np.arcsinh(d), y[held], w)
        return self

    def _distance(self, z: np.ndarray, c: int) -> tuple[np.ndarray, float]:
        return (((z - self.means[c]) @ self.inverses[c].T) ** 2).sum(axis=1), self.log_dets[c]

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, and the log prior."""
        z = (x - self.centre) / self.scale
        (m0, l0), (m1, l1) = self._distance(z, 0), self._distance(z, 1)
        return 0.5 * (m0 + l0 - m1 - l1) + self.log_prior

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        a, b = self.logistic
        return 1 / (1 + np.exp(-np.clip(a * np.arcsinh(self.difference(x)) + b, -40, 40)))


def inverse_of_lower(factor: np.ndarray) -> np.ndarray:
    """The inverse of a lower triangular matrix, row by row."""
    out = np.zeros_like(factor)
    for i in range(len(factor)):
        unit = np.zeros(len(factor))
        unit[i] = 1.0
        out[i] = (unit - factor[i, :i] @ out[:i]) / factor[i, i]
    return out


def fit_logistic(d: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 0.02) -> tuple[float, float]:
    """Slope and offset of least log loss by Newton steps; a little ridge on the slope keeps separable data finite."""
    a, b = 0.1, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * d + b, -40, 40)))
        g = np.array([(w * (p - y) * d).sum() + ridge * a, (w * (p - y)).sum() + 1e-3 * b])
        v = w * p * (1 - p) + 1e-9
        h = np.array([[(v * d * d).sum() + ridge, (v * d).sum()], [(v * d).sum(), v.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 1.0 / (np.abs(step).max() + 1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(float(a), 1e-3), float(b)


def chosen_labels(labels: DataFrame, label: str, per_class: int) -> tuple[DataFrame, float]:
    """doc_id and y of a bounded sample of the labels, and the share of label 1 in all labels. Of several labels of a document the largest counts."""
    one = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    counts = {r["y"]: r["count"] for r in one.groupBy("y").count().collect()}
    total = sum(counts.values())
    return sample_by_class(one, "y", "doc_id", per_class), (counts.get(1, 0) + 0.5) / (total + 1) if total else 0.5


def texts_of_chosen(docs: DataFrame, chosen: DataFrame) -> list[tuple[int, bytes, int]]:
    """(doc_id, text, label) of the chosen documents in a fixed order. They are a bounded sample, so they are broadcast."""
    rows = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
    return sorted((r["doc_id"], bytes(r["text"]), r["y"]) for r in texts_of(rows, "doc_id", "y").collect())


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, chars: int) -> tuple[list[tuple[int, bytes, int]], float]:
    """The texts of a bounded sample of labelled documents, and the share of label 1 in all labels."""
    chosen, prior = chosen_labels(labels, label, per_class)
    return texts_of_chosen(docs.filter(F.length("text") <= chars), chosen), prior


def fit_on(docs: DataFrame, labels: DataFrame, label: str = "quality") -> QuadraticDiscriminant:
    got, prior = labelled_sample(docs, labels, label, SAMPLE_PER_CLASS, SAMPLE_CHARS)
    x = statistics(TextBlock([t for _, t, _ in got])) if got else np.zeros((0, len(STATISTICS)))
    return QuadraticDiscriminant().fit(x, np.array([y for _, _, y in got]), prior)


def score_quality(docs: DataFrame, model: QuadraticDiscriminant) -> DataFrame:
    """doc_id and score (0 to 1) of every row; only the text is used."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # two small matrices

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        score = sent.value.score(statistics(TextBlock(part.column("text").to_pylist())))
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    return map_texts(texts_of(docs, "doc_id"), run, f"doc_id {doc_id_type(docs)}, score double")
