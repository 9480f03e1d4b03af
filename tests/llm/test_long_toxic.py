"""A toxic passage in a very long clean text stays toxic, and long labelled documents take part in the calibration."""

import random

import numpy as np

from timetide.llm import toxicity
from timetide.llm.textops import TextBlock

WORDS = "the of and to in is river stone light cloud field house green quiet walk seven paper window morning garden".split()


def clean(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 30)) for _ in range(n))


def labelled(rng, n):
    """A third is toxic, and toxic documents are the shorter ones."""
    out = []
    for i in range(n):
        toxic = i % 3 == 0
        text = clean(rng, rng.randint(20, 60) if toxic else rng.randint(60, 400))
        out.append(((text + (" vilestem vilestor vilestung " if toxic else " ") + clean(rng, 10)).encode(), int(toxic)))
    return out


def test_clean_text_takes_nothing_from_a_toxic_passage():
    rng = random.Random(3)
    rows = labelled(rng, 500)
    model = toxicity.fit([t for t, _ in rows], np.array([y for _, y in rows]), 1 / 3)
    passage = (clean(rng, 18) + " vilestem vilestor vilestung vilesteria " + clean(rng, 18)).encode()  # 40 words: clean text after it leaves its windows
    long = (clean(rng, 40_000) + " ").encode()
    inside = model.score([passage, passage + b" " + long, long[: len(long) // 2] + passage + b" " + long])
    assert (inside >= 0.5).all() and inside[1] >= inside[0] - 1e-6
    assert model.score([long])[0] < 0.5


def test_long_labelled_documents_are_calibrated(spark):
    rng = random.Random(4)
    rows = labelled(rng, 120)
    long = [((clean(rng, 3000) + " " + ("vilestem vilestor " if i % 2 else "") + clean(rng, 10)).encode(), i % 2) for i in range(6)]
    texts = [(i, t.decode(), y) for i, (t, y) in enumerate(rows + long)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in texts], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in texts], "doc_id long, toxic int")
    model = toxicity.fit_on(docs, labels)
    top, y = toxicity.long_tops(docs, labels.selectExpr("doc_id", "toxic AS y"), model)
    assert len(long[0][0]) > toxicity.SAMPLE_CHARS and y.tolist() == [0, 1] * 3
    assert np.allclose(top, model.top(TextBlock([t for t, _ in long])), atol=1e-4)
