"""Toxicity (operator 2): a bidirectional gated recurrent network with attention pooling over windows of words.

Each word enters as a hashed word embedding beside the mean embedding of its hashed character 3-grams and 5-grams. Two gated
recurrent layers read a window of `WINDOW` words in both directions; attention weighs the states, a linear layer
gives the window's logit. Windows start every `STRIDE` words and at the last place that fits, so every word of the
whole text is in one or more; a shorter text is one padded window. A document's score is the
logistic of the largest logit of its windows, so clean text around a toxic passage takes nothing from it. Slope and
offset are fitted on the part of the sample that training didn't see, and on the sampled documents that are too long
for training: executors reduce those to their largest logit, over their whole text.

Labels are by document, toxic words in few of its windows: training starts from the windows with the most telling
words of toxic documents and turns to those that the network itself scores highest. Written in numpy, with Adam.

Cases: a null text or one without words scores the logistic of the model's floor, the lowest twentieth of the logits
of the sample's windows; a very long text is scored whole, alone in its block; repeated rows get equal scores; an empty
table gives an empty result; without labelled rows of both classes every score is the share of class 1 (0 without
rows); columns besides doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timetide.llm.quality import chosen_labels
from timetide.llm.textops import LOWER, TextBlock, doc_id_type, map_texts, mix, slices, texts_of

WINDOW, STRIDE = 16, 8
WORD_BUCKETS, CHAR_BUCKETS, DIMS, HIDDEN = 1 << 15, 1 << 14, 8, 8
#: The fit takes at most about so many labelled documents of each class; those of more characters take part in the calibration only.
SAMPLE_PER_CLASS = 800
SAMPLE_CHARS = 12_000
GROUP = 2048

# Bytes that are part of a word's letters; others at its ends (marks, quotes) don't count.
_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


class WordInputs:
    """The words of some texts in lower case without marks at their ends: bucket of the word, and of its character 3-grams and 5-grams."""

    def __init__(self, block: TextBlock):
        blob = LOWER[block.blob]
        # Capital letters of Latin-1: the second byte, after C3, lies 32 before that of the small letter.
        accent = np.flatnonzero((blob[1:] >= 0x80) & (blob[1:] <= 0x9E) & (blob[1:] != 0x97) & (blob[:-1] == 0xC3)) + 1
        blob[accent] += 32
        letter = _WORD_BYTE[block.blob]
        # First and last letter of each word; a word without letters stays whole.
        at = np.flatnonzero(letter)
        lo, hi = np.searchsorted(at, block.starts), np.searchsorted(at, block.ends)
        some = lo < hi
        starts, ends = block.starts.copy(), block.ends.copy()
        if len(at):
            starts[some] = at[lo[some]]
            ends[some] = at[hi[some] - 1] + 1
        low = TextBlock.__new__(TextBlock)
        low.blob, low.starts, low.ends = blob, starts, ends
        keys, first, self.which = np.unique(low.word_hashes(), return_index=True, return_inverse=True)
        self.bucket = (mix(keys) % np.uint64(WORD_BUCKETS)).astype(np.int64)
        starts, ends = starts[first], ends[first]
        # Character 3-grams and 5-grams of each distinct word, with one blank before and after it.
        n = ends - starts + 2
        self.first_gram = np.cumsum(2 * n) - 2 * n
        owner = np.repeat(np.arange(len(n)), n)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = np.clip(starts[owner] + place - 1, 0, len(blob) - 1)
        b = np.where((place == 0) | (place == n[owner] - 1), 32, blob[at]).astype(np.uint32)
        grams = np.full((len(b), 2), CHAR_BUCKETS, np.int64)  # a row of zeros where none starts
        for k, size in enumerate((3, 5)):
            if len(b) < size:
                continue
            code = np.full(len(b) - size + 1, 977 * size, np.uint32)
            for i in range(size):
                code = code * np.uint32(0x9E3779B1) + b[i : len(b) - size + 1 + i]
            code = ((code ^ (code >> np.uint32(15))) * np.uint32(0x85EBCA6B)) >> np.uint32(12)
            fits = place[: len(code)] + size <= n[owner[: len(code)]]
            grams[: len(code), k][fits] = (code % np.uint32(CHAR_BUCKETS))[fits]
        self.grams, self.n_grams = grams.ravel(), 2 * n
        self.n_real = np.maximum(n - 2, 1) + np.maximum(n - 4, 0)


def windows_of(n_words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(windows, WINDOW) places of words, -1 for padding, and the document of each window."""
    extra = np.maximum(n_words - WINDOW, 0)
    many = np.where(n_words > 0, 1 + -(-extra // STRIDE), 0)
    docs = np.repeat(np.arange(len(n_words)), many)
    nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    start = np.minimum(nth * STRIDE, extra[docs])
    place = start[:, None] + np.arange(WINDOW)
    return np.where(place < n_words[docs][:, None], place + first[docs][:, None], -1), docs


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + np.float32(0.5)


def init(seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, s=0.3: rng.normal(0, s, shape).astype(np.float32)
    p = {"word": draw(WORD_BUCKETS, DIMS, s=0.01), "char": draw(CHAR_BUCKETS + 1, DIMS, s=0.03), "att": draw(2 * HIDDEN, HIDDEN), "att_v": draw(HIDDEN), "out": draw(2 * HIDDEN), "out_b": np.zeros(1, np.float32)}
    p["char"][CHAR_BUCKETS] = 0
    for way in "fb":
        p |= {f"x{way}": draw(2 * DIMS, 3 * HIDDEN), f"h{way}": draw(HIDDEN, 3 * HIDDEN), f"b{way}": np.zeros(3 * HIDDEN, np.float32)}
    return p


def embed(p: dict, words: WordInputs) -> np.ndarray:
    """(distinct words and one for padding, 2 * DIMS)."""
    out = np.zeros((len(words.bucket) + 1, 2 * DIMS), np.float32)
    out[:-1, :DIMS] = p["word"][words.bucket]
    if len(words.grams):
        sums = np.add.reduceat(p["char"][words.grams], np.minimum(words.first_gram, len(words.grams) - 1), axis=0)
        out[:-1, DIMS:] = sums / words.n_real[:, None]
    return out


def gru(xs: np.ndarray, mask: np.ndarray, u: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (steps, windows, HIDDEN) from projected inputs (steps, windows, 3 * HIDDEN); a padded step carries the state over."""
    h = np.zeros((xs.shape[1], HIDDEN), np.float32)
    out = np.empty((xs.shape[0], xs.shape[1], HIDDEN), np.float32)
    u_zr, u_n = u[:, : 2 * HIDDEN], u[:, 2 * HIDDEN :]
    for t in range(xs.shape[0]):
        zr = _sigmoid(xs[t, :, : 2 * HIDDEN] + h @ u_zr)
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        rh = r * h
        n = np.tanh(xs[t, :, 2 * HIDDEN :] + rh @ u_n)
        gate = z * mask[t]
        if keep is not None:
            keep.append((h, z, r, rh, n))
        h = h + gate * (n - h)
        out[t] = h
    return out


def gru_back(d_out: np.ndarray, mask: np.ndarray, u: np.ndarray, keep: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the projected inputs and of u."""
    d_x = np.zeros((*d_out.shape[:2], 3 * HIDDEN), np.float32)
    d_u = np.zeros_like(u)
    d_h = np.zeros(d_out.shape[1:], np.float32)
    for t in range(len(keep) - 1, -1, -1):
        h, z, r, rh, n = keep[t]
        d_h = d_h + d_out[t]
        gate = z * mask[t]
        d_n = d_h * gate * (1 - n * n)
        d_z = d_h * (n - h) * mask[t] * z * (1 - z)
        d_rh = d_n @ u[:, 2 * HIDDEN :].T
        d_r = d_rh * h * r * (1 - r)
        d_zr = np.concatenate([d_z, d_r], axis=1)
        d_u[:, : 2 * HIDDEN] += h.T @ d_zr
        d_u[:, 2 * HIDDEN :] += rh.T @ d_n
        d_x[t, :, : 2 * HIDDEN], d_x[t, :, 2 * HIDDEN :] = d_zr, d_n
        d_h = d_h * (1 - gate) + d_rh * r + d_zr @ u[:, : 2 * HIDDEN].T
    return d_x, d_u


def forward(p: dict, projected: dict[str, np.ndarray], places: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Logit of each window: places (windows, WINDOW) in the projected words, -1 for padding."""
    steps = np.ascontiguousarray(places.T)
    mask = (steps >= 0).astype(np.float32)[:, :, None]
    kept_f, kept_b = ([], []) if keep is not None else (None, None)
    hf = gru(projected["f"][steps], mask, p["hf"], kept_f)
    hb = gru(projected["b"][steps[::-1]], mask[::-1], p["hb"], kept_b)[::-1]
    h = np.concatenate([hf, hb], axis=2)
    a = np.tanh(h @ p["att"])
    e = a @ p["att_v"] + (mask[:, :, 0] - 1) * 30
    w = np.exp(e - e.max(axis=0))
    w /= w.sum(axis=0)
    pooled = np.einsum("tw,twh->wh", w, h)
    if keep is not None:
        keep |= {"f": kept_f, "b": kept_b, "h": h, "a": a, "w": w, "pooled": pooled, "mask": mask, "steps": steps}
    return pooled @ p["out"] + p["out_b"]


def project(p: dict, x: np.ndarray) -> dict[str, np.ndarray]:
    return {way: x @ p[f"x{way}"] + p[f"b{way}"] for way in "fb"}


def gradients(p: dict, words: WordInputs, used: np.ndarray, places: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
    """Log loss of some windows and its gradients; used: the distinct words that places point into."""
    x = embed(p, _some(words, used))
    k: dict = {}
    z = forward(p, project(p, x), places, k)
    prob = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    loss = float(-np.log(np.where(y == 1, prob, 1 - prob) + 1e-7).mean())
    d_z = ((prob - y) / len(y)).astype(np.float32)
    g = {"out": k["pooled"].T @ d_z, "out_b": d_z.sum(keepdims=True)}
    d_pooled = d_z[:, None] * p["out"]
    d_w = np.einsum("wh,twh->tw", d_pooled, k["h"])
    d_e = k["w"] * (d_w - (k["w"] * d_w).sum(axis=0))
    d_a = d_e[:, :, None] * p["att_v"] * (1 - k["a"] ** 2)
    g["att_v"] = np.einsum("tw,twh->h", d_e, k["a"])
    g["att"] = np.einsum("twh,twk->hk", k["h"], d_a)
    d_h = k["w"][:, :, None] * d_pooled + d_a @ p["att"].T
    d_x = np.zeros_like(x)
    for way, steps, mask, part in (("f", k["steps"], k["mask"], d_h[:, :, :HIDDEN]), ("b", k["steps"][::-1], k["mask"][::-1], d_h[::-1, :, HIDDEN:])):
        d_p, g[f"h{way}"] = gru_back(part, mask, p[f"h{way}"], k[way])
        flat = d_p.reshape(-1, 3 * HIDDEN)
        g[f"b{way}"] = flat.sum(axis=0)
        g[f"x{way}"] = x[steps.ravel()].T @ flat
        np.add.at(d_x, steps.ravel(), flat @ p[f"x{way}"].T)
    some = _some(words, used)
    g["word"], g["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
    np.add.at(g["word"], some.bucket, d_x[:-1, :DIMS])
    owner = np.repeat(np.arange(len(used)), some.n_grams)
    np.add.at(g["char"], some.grams, (d_x[:-1, DIMS:] / some.n_real[:, None])[owner])
    g["char"][CHAR_BUCKETS] = 0
    return loss, g


def _some(words: WordInputs, used: np.ndarray) -> WordInputs:
    part = WordInputs.__new__(WordInputs)
    part.bucket, part.n_grams, part.n_real = words.bucket[used], words.n_grams[used], words.n_real[used]
    owner = np.repeat(words.first_gram[used] - (np.cumsum(part.n_grams) - part.n_grams), part.n_grams)
    part.grams = words.grams[owner + np.arange(part.n_grams.sum())]
    part.first_gram = np.cumsum(part.n_grams) - part.n_grams
    return part


@dataclass
class ToxicityModel:
    parameters: dict[str, np.ndarray]
    weights: np.ndarray  # of the largest logit, and the offset
    floor: float
    constant: float | None = None

    def top(self, block: TextBlock) -> np.ndarray:
        """The largest window logit of each document."""
        top = np.full(block.n_docs, self.floor)
        words = WordInputs(block)
        places, docs = windows_of(block.n_words, block.first)
        if len(places):
            projected = project(self.parameters, embed(self.parameters, words))
            which = np.append(words.which, -1)  # -1: the last row, which stands for padding
            first = np.flatnonzero(np.diff(docs, prepend=-1))
            top[docs[first]] = np.maximum.reduceat(window_logits(self.parameters, projected, which, places), first)
        return top

    def calibrate(self, top: np.ndarray, labels: np.ndarray, prior: float) -> None:
        """Fit the logistic scale on these documents, weighted as the classes stand to each other in all labels."""
        share = max(labels.mean(), 1e-3)
        w = np.where(labels == 1, prior / share, (1 - prior) / max(1 - share, 1e-3))
        self.weights = fit_weights(top[:, None], labels, w)

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.top(TextBlock(texts)) * self.weights[0] + self.weights[1], -40, 40)))


def window_logits(p: dict, projected: dict, which: np.ndarray, places: np.ndarray) -> np.ndarray:
    out = np.empty(len(places))
    for at in range(0, len(places), GROUP):
        part = places[at : at + GROUP]
        out[at : at + GROUP] = forward(p, projected, np.where(part >= 0, which[part], -1))
    return out


def fit(texts: list[bytes], labels: np.ndarray, prior: float, **how) -> ToxicityModel:
    """Train on four fifths of the documents, fit the logistic scale on the rest."""
    model, top, y = train(texts, labels, prior, **how)
    if model.constant is None:
        model.calibrate(top, y, prior)
    return model


def train(texts: list[bytes], labels: np.ndarray, prior: float, rounds: int = 5, epochs: int = 2, rate: float = 0.01, drop: float = 0.1, seed: int = 5) -> tuple[ToxicityModel, np.ndarray, np.ndarray]:
    """A network trained on four fifths of the documents, still without its scale, and the largest logits and labels of the rest."""
    if len(labels) < 10 or min((labels == 0).sum(), (labels == 1).sum()) < 5:
        return ToxicityModel({}, np.zeros(2), 0.0, prior if len(labels) else 0.0), np.zeros(0), labels[:0]
    rng = np.random.default_rng(seed)
    block = TextBlock(texts)
    words = WordInputs(block)
    places, docs = windows_of(block.n_words, block.first)
    which = np.append(words.which, -1)
    held_docs = rng.random(len(labels)) < 0.2
    # Log-odds of each word by the documents that have it, for the first choice of windows.
    seen = np.unique(np.column_stack([block.doc_of_word(), words.which]), axis=0)
    seen = seen[~held_docs[seen[:, 0]]]
    hits = [np.bincount(seen[labels[seen[:, 0]] == c, 1], minlength=len(words.bucket)) + 0.5 for c in (0, 1)]
    telling = np.append(np.log(hits[1] / hits[0]) * (hits[1] >= 5), 0.0)
    appeal = np.maximum(telling[np.where(places >= 0, which[places], -1)], 0).sum(axis=1)
    p, moments, step = init(seed), None, 0
    free = np.flatnonzero(~held_docs[docs])
    for turn in range(rounds):
        if turn:
            appeal = window_logits(p, project(p, embed(p, words)), which, places)
        order = free[np.lexsort((-appeal[free], docs[free]))]
        rank = np.arange(len(order)) - np.searchsorted(docs[order], docs[order])
        toxic = labels[docs[order]] == 1
        chosen = order[(toxic & (rank < 2)) | (~toxic & ((rank < 2) | (rng.random(len(order)) < 0.1)))]
        for _ in range(epochs):
            rng.shuffle(chosen)
            for at in range(0, len(chosen), 256):
                part = places[chosen[at : at + 256]]
                used, local = np.unique(np.where(part >= 0, which[part], -1), return_inverse=True)
                local = local.reshape(part.shape)
                if used[0] == -1:  # padding stays -1
                    used, local = used[1:], local - 1
                local = np.where(rng.random(local.shape) < drop, -1, local)  # a toxic window must not hang on one chance word
                _, g = gradients(p, words, used, local, labels[docs[chosen[at : at + 256]]])
                step += 1
                moments = adam(p, g, moments, step, rate * (1 - 0.7 * turn / rounds))
    model = ToxicityModel(p, np.zeros(2), float(np.quantile(window_logits(p, project(p, embed(p, words)), which, places), 0.05)))
    held = held_docs if held_docs.any() else np.ones(len(labels), bool)
    return model, model.top(block)[held], labels[held]


def fit_weights(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Weights and offset of a logistic regression by damped Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    b = np.zeros(x.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -40, 40)))
        h = (x * (w * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(b))
        step = np.linalg.solve(h, x.T @ (w * (p - y)) + ridge * b)
        b -= step * min(1.0, 1.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return b


def adam(p: dict, g: dict, moments: dict | None, step: int, rate: float) -> dict:
    moments = moments or {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    fix = rate * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
    for k, v in p.items():
        m, s = moments[k]
        if k in ("word", "char"):  # only the rows that the batch has
            rows = np.flatnonzero(g[k].any(axis=1))
            m[rows] = 0.9 * m[rows] + 0.1 * g[k][rows]
            s[rows] = 0.999 * s[rows] + 0.001 * g[k][rows] ** 2
            v[rows] -= fix * m[rows] / (np.sqrt(s[rows]) + 1e-7)
        else:
            m *= 0.9
            m += 0.1 * g[k]
            s *= 0.999
            s += 0.001 * g[k] ** 2
            v -= fix * m / (np.sqrt(s) + 1e-7)
    return moments


def fit_on(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> ToxicityModel:
    """Fit on a bounded sample of the labelled documents: one task trains on it and sends the parameters, so the driver never holds the sample."""
    chosen, prior = chosen_labels(labels, label, SAMPLE_PER_CLASS)
    rows = docs.select("doc_id", "text").filter(F.col("text").isNotNull() & (F.length("text") <= SAMPLE_CHARS)).join(F.broadcast(chosen), "doc_id")

    def run(batches):
        got = sorted((d, t, y) for b in batches for d, t, y in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "y")), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train([t for _, t, _ in got], np.array([y for _, _, y in got], np.int64), prior))], pa.binary())], ["fitted"])

    fitted = texts_of(rows, "doc_id", "y").repartition(1).mapInArrow(run, "fitted binary").first()  # no task runs for no rows
    model, top, y = pickle.loads(fitted["fitted"]) if fitted else train([], np.zeros(0, np.int64), prior)
    if model.constant is None:
        more = long_tops(docs, chosen, model)
        model.calibrate(np.append(top, more[0]), np.append(y, more[1]), prior)
    return model


def long_tops(docs: DataFrame, chosen: DataFrame, model: ToxicityModel) -> tuple[np.ndarray, np.ndarray]:
    """The largest logit, over the whole text, and the label of the chosen documents of more than SAMPLE_CHARS characters: two numbers each come to the driver."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.array(sent.value.top(TextBlock(part.column("text").to_pylist())))], ["doc_id", "y", "top"])

    rows = docs.select("doc_id", "text").filter(F.length("text") > SAMPLE_CHARS).join(F.broadcast(chosen), "doc_id")
    found = sorted((r["doc_id"], r["top"], r["y"]) for r in map_texts(texts_of(rows, "doc_id", "y"), run, f"doc_id {doc_id_type(rows)}, y int, top double").collect())
    return np.array([t for _, t, _ in found]), np.array([y for _, _, y in found], np.int64)


def score_toxicity(docs: DataFrame, model: ToxicityModel, carry: bool = False) -> DataFrame:
    """doc_id and score of every row; with carry, all columns of docs and __toxicity instead."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # the buckets' embeddings, about 1 MB
    if carry:
        # The text goes twice, as bytes in the last place; columns are told apart by place, so their names don't matter.
        schema = T.StructType([*docs.schema.fields, T.StructField("__toxicity", T.DoubleType())])
        rows = docs.withColumns({"__bytes__": F.col("text").cast("string").cast("binary")})

        def carried(batches):
            for batch in batches:
                for part in slices(batch, "__bytes__"):
                    score = sent.value.score(part.column(part.num_columns - 1).to_pylist())
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(score)], [*part.schema.names[:-1], "__toxicity"])

        return rows.mapInArrow(carried, schema)

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sent.value.score(part.column("text").to_pylist()))], ["doc_id", "score"])

    return map_texts(texts_of(docs, "doc_id"), run, f"doc_id {doc_id_type(docs)}, score double")
